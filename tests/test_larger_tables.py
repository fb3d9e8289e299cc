"""What larger tables brought out: equal sums, broadcasts of opened rows, stored steps."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from farglass.operators import collocation, linking, ranges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_sums_are_ordered_by_id(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last digit as doubles."""
    d = str(tmp_path)
    made = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}", 0, "BUILDING") for k in (1, 2)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(n, 1 + n // 3, x, "1998-01-01", "P") for n, x in enumerate((0.3, 0.2, 0.1, 0.1, 0.2, 0.3))], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, o_orderpriority string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    assert [(r.id, r["rank"]) for r in entry.queries()["o1_o4_custom_order"](spark, d).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_intervals_in_bins_are_not_broadcast(spark):
    """Tables are small before their rows are put into bins, so a side would be sent to the driver."""
    spans = spark.createDataFrame([(k, k, k + 2**j) for k in range(20) for j in range(6)], "id long, a long, b long")
    made = ranges.overlap_join(spans, spans.withColumnRenamed("id", "other_id"), "a", "b")
    assert "Broadcast" not in plan(made)
    rows = [tuple(r) for r in spans.collect()]
    want = sorted((i, j) for i, a, b in rows for j, c, e in rows if a <= e and c <= b)
    assert sorted((r.id, r.other_id) for r in made.collect()) == want


def test_rounds_of_a_day_meet_a_span_as_one_row(spark, monkeypatch):
    seen, join = [], ranges.overlap_join
    monkeypatch.setattr(ranges, "overlap_join", lambda left, right, *rest: seen.append((right.count(), right.select("a").distinct().count())) or join(left, right, *rest))
    entry.queries()["j24_rounds_in_spans"](spark, "/root/testdata/sf0.001")
    assert seen[0][0] == seen[0][1]


def test_similar_names_are_compared_once(spark, monkeypatch):
    """Rows that share a name add rows to the result, not comparisons; grams are not broadcast."""
    left = spark.createDataFrame([(k, "x", "alpha beta" if k % 2 else "gamma delta") for k in range(40)], "id long, block string, name string")
    right = spark.createDataFrame([(k, "x", "alpha betas") for k in range(30)] + [(99, None, "alpha beta")], "id long, block string, name string")
    stored, keep = {}, linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df, name: stored.setdefault(name, []).append(df) or keep(df, name))
    found = linking.fuzzy_match(left, right, "id", "id", "name", "block", 0.6)
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == [(a, b) for a in range(1, 40, 2) for b in range(30)]
    assert [x.count() for x in stored["similar_names"]] == [1] and "Broadcast" not in plan(stored["similar_names"][0])


def test_cascade_joins_one_right_row_for_a_key(spark):
    left = spark.createDataFrame([(k, "k") for k in range(50)], "id long, a string")
    right = spark.createDataFrame([(k, "k") for k in range(100, 150)] + [(1, "")], "rid long, a string")
    made = linking.cascade_match(left, right, [(F.col("a"), F.col("a"))], "id", "rid")
    assert {(r.id, r.rid, r.step) for r in made.collect()} == {(k, 100, 0) for k in range(50)}
    assert plan(made).index("min(r") < plan(made).rindex("min(r") and plan(made).count("functions=[min(r") >= 4


def test_near_dedup_takes_candidates_from_fingerprints(spark, monkeypatch):
    """SimHash's links come first; an exact test follows."""
    import corpus_pipeline
    from farglass.llm import similar, simhash

    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *rest: asked.append(nodes.count()) or links(nodes, *rest))
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text.upper()), (4, "some other words that stand alone"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 5]
    assert asked and asked[0] >= 2
    one, other = (similar.shingles(x) for x in (text, text + " end"))
    assert bin(similar.print_of(one) ^ similar.print_of(other)).count("1") <= 4


def test_ngrams_do_not_copy_the_sentence_for_each_place(spark):
    """A slice within the lambda takes the whole array, so a long sentence took the square of its length."""
    rows = spark.createDataFrame([(1, list("abca")), (2, ["a"]), (3, []), (4, ["a", "b"])], "id long, words array<string>")
    made = rows.select("id", collocation.ngrams(F.col("words"), 3).alias("x"))
    assert {r.id: r.x for r in made.collect()} == {1: ["a", "b", "c", "a", "a b", "b c", "c a", "a b c", "b c a"], 2: ["a"], 3: [], 4: ["a", "b", "a b"]}
    assert "transform(sequence" not in plan(made)


def test_a_place_is_one_row_where_ngrams_are_counted(spark, monkeypatch):
    """Before, a place was a row for each of its n-grams, twice; n-grams were strings before they were counted."""
    stored, keep = {}, collocation.materialise
    monkeypatch.setattr(collocation, "materialise", lambda df, name: stored.setdefault(name, []).append(df) or keep(df, name))
    rows = spark.createDataFrame([(1, list("abab")), (1, ["a", "c"]), (2, ["b", "a", "d", "d"])], "year long, words array<string>")
    made = collocation.term_counts(rows, "words", ["year"])
    assert sorted((r.year, r.ngram, r.total) for r in made.collect()) == [(1, "a", 3), (1, "b", 2), (1, "b a", 1), (2, "a", 1), (2, "b", 1), (2, "b a", 1)]
    assert sum(r.total for r in stored["run_sums"][0].collect()) == 10
    pairs = collocation.term_pairs(rows, "words", made, ["year"], ["a", "b a"])
    assert sorted((r.year, r.term, r.ngram, r.both) for r in pairs.collect()) == [(1, "a", "b", 4), (1, "a", "b a", 2), (1, "b a", "a", 2), (1, "b a", "b", 2), (2, "a", "b", 1), (2, "a", "b a", 1), (2, "b a", "a", 1), (2, "b a", "b", 1)]


def test_merging_carries_no_sentence_beside_its_words(spark):
    rows = spark.createDataFrame([(1, ["new", "york", "new", "york", "x"]), (2, ["x"])], "id long, words array<string>")
    made = collocation.merge_phrases(rows, "words", spark.createDataFrame([("new", "york")], "a string, b string"), ["id"])
    assert {r.id: r.words for r in made.collect()} == {1: ["new_york", "new_york", "x"], 2: ["x"]}
    assert "posexplode(arrays_zip" in plan(made)


def test_crowded_lists_make_only_the_parts_around_them(spark, monkeypatch):
    """All 70 sets of four positions were made rows for each member; five hold the list's three."""
    from farglass.llm import simhash

    seen, explode = [], F.explode
    nodes = spark.createDataFrame([(k * 0x0123456789ABCD,) for k in range(5)], "fp long")
    crowded = simhash.postings(nodes, 3).withColumn("component", F.col("fp")).limit(40)
    monkeypatch.setattr(simhash.F, "explode", lambda c: seen.append(c) or explode(c))
    assert simhash._split(crowded, 3, 4).count() > 0
    assert {r.n for r in crowded.withColumn("base", simhash._mask(3, F.col("list"))).select(F.size(seen[0]).alias("n")).collect()} == {5}


def test_a_part_is_made_from_few_of_its_lists(spark, monkeypatch):
    """A fingerprint that is in all 56 crowded lists has 70 parts; 5 for each list would be 280 rows."""
    from farglass.llm import simhash

    crowded = simhash.postings(spark.createDataFrame([(0x0123456789ABCD,)], "fp long"), 3).withColumn("component", F.col("fp"))
    monkeypatch.setattr(type(crowded), "distinct", lambda self: self)
    made = [r["list"] for r in simhash._split(crowded, 3, 4).collect()]
    assert len(set(made)) == 70 and len(made) <= 175
    # Of any four lists of a part two are split, so it is made as long as three are crowded.
    for part in simhash.covering(4):
        assert sum(set(c) < set(part) for c in simhash.splitting(3, 4)) >= 2


def test_topic_words_make_no_python_row_for_each_word_and_topic(spark, monkeypatch):
    import pyarrow as pa

    from farglass.operators import vectors

    texts = spark.createDataFrame([(k, ["a", "b", "c"] if k % 2 else ["c", "d", "e"]) for k in range(12)], "id long, words array<string>")
    model = vectors.fit_topics(texts, "words", 2, rounds=2)
    sent, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *rest, **named: sent.append(data) or make(self, data, *rest, **named))
    found = vectors.topic_words(model, texts, "words", 3).collect()
    assert sorted((r.topic, r["rank"]) for r in found) == [(t, k) for t in range(2) for k in (1, 2, 3)]
    assert [(type(x), x.num_rows) for x in sent] == [(pa.Table, 5)]
