"""Topics made of clusters of texts: their words, their merging and what to do with texts outside of them.

A topic's words are scored by class-based tf-idf: all texts of a topic are one document. Topics merge
by average linkage: every round unites all pairs that are each other's nearest, which gives the same
tree as one merge at a time, as a union is never nearer to a third topic than both its parts. Texts
without a topic go to the one whose words theirs resemble most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import lookup, materialise

#: Best words of a topic that stand for it where topics and texts are compared.
KEEP = 200


def class_words(tokens: DataFrame, topic: str, word: str) -> DataFrame:
    """``topic, word, tf, score`` for every word of every topic (null topics are left out).

    score = tf / words of the topic * ln(1 + mean words of a topic / occurrences of the word).
    """
    tf = materialise(tokens.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic"), F.col(word).alias("word")).agg(F.count("*").alias("tf")), "topic_words")
    sizes = tf.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))  # one row
    uses = tf.groupBy("word").agg(F.sum("tf").alias("uses"))
    scored = lookup(tf, uses, "word").join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "topic").crossJoin(F.broadcast(mean))
    return scored.select("topic", "word", "tf", (F.col("tf") / F.col("size") * F.ln(1 + F.col("mean") / F.col("uses"))).alias("score"))


def top_words(scored: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` words of highest score of each topic, with ``rank`` from 1; a window that is cut in each partition first."""
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _unit(scored: DataFrame, keep: int) -> DataFrame:
    """``topic, word, x``: best words at unit length."""
    best = top_words(scored, keep)
    norms = best.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    return materialise(best.join(norms, "topic").where("norm > 0").select("topic", "word", (F.col("score") / F.col("norm")).alias("x")), "unit_topics")


def merge_tree(scored: DataFrame, keep: int = KEEP) -> DataFrame:
    """``a, b, similarity``: the merges of the topics' tree; ``a`` is the smaller topic, which the union is named after.

    The similarity of two unions is the mean cosine of their topics. Topics that share no word with
    another one have similarity 0 and do not merge.
    """
    vectors = _unit(scored, keep)
    sizes = materialise(vectors.select("topic").distinct().withColumn("size", F.lit(1).cast("long")), "topic_sizes")
    merges = []
    while True:
        # Only topics that share a word meet, each with ``keep`` words; sums are formed before the shuffle.
        other = vectors.select(F.col("topic").alias("other"), "word", F.col("x").alias("y"))
        dots = vectors.join(other, "word").where("topic <> other").groupBy("topic", "other").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
        alike = dots.join(sizes, "topic").join(sizes.select(F.col("topic").alias("other"), F.col("size").alias("size2")), "other").select("topic", "other", F.round(F.col("dot") / (F.col("size") * F.col("size2")), 12).alias("similarity"))
        # Of equal ones the pair with the smallest ends, whichever end looks, so that a pair agrees.
        pair = F.struct((-F.col("similarity")).alias("s"), F.least("topic", "other").alias("a"), F.greatest("topic", "other").alias("b"))
        nearest = materialise(alike.where("similarity > 0").groupBy("topic").agg(F.min(pair).alias("p")), "nearest_topics")
        mutual = materialise(nearest.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b", (-F.col("p.s")).alias("similarity")), "merges")
        if mutual.isEmpty():
            break
        merges.append(mutual)
        names = mutual.select(F.col("b").alias("topic"), F.col("a").alias("into"))
        moved = vectors.join(names, "topic", "left").select(F.coalesce("into", "topic").alias("topic"), "word", "x")
        vectors = materialise(moved.groupBy("topic", "word").agg(F.sum("x").alias("x")), "merged_topics")
        sizes = materialise(sizes.join(names, "topic", "left").groupBy(F.coalesce("into", "topic").alias("topic")).agg(F.sum("size").alias("size")), "topic_sizes")
    kind = scored.schema["topic"].dataType.simpleString()
    tree = scored.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    for part in merges:
        tree = tree.unionByName(part)
    return tree


def cut_tree(tree: DataFrame, topics: DataFrame, n: int) -> DataFrame:
    """``topic, merged``: topics united by the tree's most alike merges until ``n`` are left (more if too
    few merge). ``topics``: one column ``topic``."""
    total = topics.count()
    order = Window.orderBy(F.desc("similarity"), "b")
    # A row for each merge, fewer than there are topics.
    taken = tree.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, total - n)).select(F.col("b").alias("topic"), "a")
    now = materialise(topics.join(taken, "topic", "left").select("topic", F.coalesce("a", "topic").alias("merged")), "cut")
    while True:
        up = now.select(F.col("topic").alias("merged"), F.col("merged").alias("root"))
        after = materialise(now.join(up, "merged").select("topic", F.col("root").alias("merged"), (F.col("root") != F.col("merged")).alias("moved")), "cut")
        if after.where("moved").isEmpty():
            return after.select("topic", "merged")
        now = after.select("topic", "merged")


def reassign(tokens: DataFrame, key: str, topic: str, word: str, scored: DataFrame, *, least: float = 0.0, keep: int = KEEP) -> DataFrame:
    """``key, topic, similarity`` for the texts without a topic: the topic of greatest cosine above ``least``.

    Of equal ones the smallest topic; texts that resemble none are not in the result. A text meets only
    the topics that hold one of its words among their best ones.
    """
    vectors = _unit(scored, keep)
    counts = materialise(tokens.where(F.col(topic).isNull()).groupBy(key, F.col(word).alias("word")).agg(F.count("*").alias("tf")), "outlier_words")
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    alike = counts.join(vectors, "word").groupBy(key, "topic").agg(F.sum(F.col("tf") * F.col("x")).alias("dot")).join(norms, key)
    alike = alike.withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 12)).where(F.col("similarity") > least)
    best = alike.groupBy(key).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "topic")).alias("p"))
    return best.select(key, F.col("p.topic").alias("topic"), (-F.col("p.s")).alias("similarity"))
