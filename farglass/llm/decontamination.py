"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Test items are cut into windows of consecutive words. One pass over the training texts counts how
often each test term occurs; for every window the two rarest terms are its probes. A second pass
stores the positional postings of the probe terms: (term, document, position). A window's two lists
are shifted by their terms' offsets to where the window would begin, and intersected: a join on
document, term and place leaves the places where the second-rarest term stands where it should, or
within ``slop`` words of it. What is left is verified against the words around the rarest term, which
its posting carries: all words in order make an exact phrase; most of them near make a proximity
match.

Texts are tokenised twice, however many windows there are, and never shuffled: postings are written
where they are made. Windows go to the executors in blocks of a fixed size against the stored
postings, so a benchmark of any size is handled. The place of a list is cut into bins of the slop's
width, so the join has equal keys only, and a term that a text repeats makes no pairs of all places.

Nulls: a null text or item has no words; a null item id counts as an item (named by the empty
string). Matches belong to rows by id and a hash of the text, so repeated rows and repeated ids each
get their own right result. Empty tables give no windows or no rows. Items of fewer words than a
window have exact matches only. All other columns pass through; the columns added start with
``bench_``, or where a column of the user's does so, with another underscore
(``columns.free_prefix``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farglass.llm.columns import all_of, free_prefix, own
from farglass.llm.words import license_word_count, license_words
from farglass.runtime import checked_broadcast, materialise

WINDOW = 13
SLOP = 3
NEAR_SHARE = 0.8
PREFIX = "bench_"
#: Bytes of item lists that a table of hits may have to be sent to every executor.
HIT_BYTES = 16 << 20
#: Windows sent to the executors at a time (about 150 bytes each).
BLOCK = 100_000


def item_windows(items: DataFrame, window: int = WINDOW, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, win``: distinct windows; an item of fewer words is one window."""
    words = items.select(F.coalesce(own(id_col).cast("string"), F.lit("")).alias("item_id"), license_words(own(text_col)).alias("words")).where(F.size("words") > 0)
    starts = f"sequence(0, greatest(size(words) - {window}, 0))"
    return words.select("item_id", F.explode(F.expr(f"transform({starts}, i -> slice(words, i + 1, {window}))")).alias("win")).distinct()


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``own_id, own_hash, words``. Terms come by ``posexplode_outer``, which infers no filter that
    would split the text a second time."""
    return docs.select(own(id_col).alias("own_id"), F.xxhash64(own(text_col)).alias("own_hash"), license_words(own(text_col)).alias("words"))


def probes(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``window, win, n, term, at, term2, at2, part``: each window's two rarest terms in the texts.

    Of terms of equal counts the one that comes first in the window is the rarer.
    """
    vocabulary = materialise(windows.select(F.explode("win").alias("term")).distinct(), "test_terms")
    terms = tokenised(docs, id_col, text_col).select(F.posexplode_outer("words").alias("pos", "term")).select("term")
    n = vocabulary.count()
    counted = terms.join(checked_broadcast(vocabulary, n), "term", "left_semi") if n <= BLOCK else terms
    frequency = materialise(counted.groupBy("term").agg(F.count("*").alias("n")), "test_term_counts")
    placed = windows.select("window", "win", F.posexplode("win").alias("at", "term")).join(checked_broadcast(frequency, min(n, BLOCK + 1), BLOCK), "term", "left")
    # A window with a term that no text holds occurs nowhere.
    ranked = placed.groupBy("window", "win").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("terms")).where(F.col("terms")[0]["n"] > 0)
    first, second = F.col("terms")[0], F.coalesce(F.get("terms", F.lit(1)), F.col("terms")[0])
    return ranked.select("window", "win", F.size("win").alias("n"), first["term"].alias("term"), first["at"].alias("at"), second["term"].alias("term2"), second["at"].alias("at2"), F.pmod(F.xxhash64("window"), F.lit(1 << 20)).alias("part"))


def build_index(docs: DataFrame, terms: DataFrame, reach: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings of ``terms (term, rarest)``: ``term, own_id, own_hash, pos, here, context``.

    For terms that are some window's rarest, ``context`` has the words up to ``reach`` before and
    behind the position, of which the term's own is number ``here``; for others it is null.
    """
    posted = tokenised(docs, id_col, text_col).select("own_id", "own_hash", "words", F.posexplode_outer("words").alias("pos", "term"))
    kept = posted.join(checked_broadcast(terms, limit=BLOCK), "term")
    here = F.least("pos", F.lit(reach))
    context = F.when(F.col("rarest"), F.slice("words", F.col("pos") - here + 1, here + 1 + reach))
    return materialise(kept.select("term", "own_id", "own_hash", "pos", here.alias("here"), context.alias("context")), "postings")


def intersect(index: DataFrame, probe: DataFrame, slop: int) -> DataFrame:
    """``window, own_id, own_hash, pos``: postings of windows' rarest terms where the list of the
    second-rarest, adjusted by its offset, has a place within ``slop``."""
    width = 2 * slop + 1
    wide = index.where("context is not null").select(F.col("term").alias("posting"), "own_id", "own_hash", "pos")
    blocks = max(1, -(-probe.count() // (BLOCK // 2)))  # half full on average, so that hashing fills none over
    shifted = []
    for k in range(blocks):
        block = probe.where(F.col("part") % blocks == k).select("window", "term", "at", "term2", "at2")
        shifted.append(wide.join(F.broadcast(block), (F.col("posting") == F.col("term")) & (F.col("pos") >= F.col("at"))))
    wanted = reduce(DataFrame.union, shifted).select("window", "own_id", "own_hash", "pos", "term2", (F.col("pos") - F.col("at") + F.col("at2")).alias("want"))
    bins = F.array_distinct(F.transform(F.array(F.lit(-slop), F.lit(slop)), lambda d: F.floor((F.col("want") + d) / width)))
    one = wanted.withColumn("bin", F.explode(bins)).alias("a")
    other = index.select("own_id", "own_hash", "term", F.col("pos").alias("pos2"), F.floor(F.col("pos") / width).alias("bin")).alias("b")
    same = F.col("a.own_id").eqNullSafe(F.col("b.own_id")) & (F.col("a.own_hash") == F.col("b.own_hash")) & (F.col("a.term2") == F.col("b.term")) & (F.col("a.bin") == F.col("b.bin"))
    met = one.join(other, same & (F.abs(F.col("pos2") - F.col("want")) <= slop), "left_semi")
    return met.select("window", "own_id", "own_hash", "pos").distinct()


def matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``own_id, own_hash, item_ids, first, n, exact``: places of windows in texts, each once.

    ``first`` is the word a window's place begins at, ``n`` its words, ``item_ids`` the items that
    have the window.
    """
    cut = materialise(item_windows(items, window, id_col=item_col, text_col=item_text), "item_windows")
    windows = cut.groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    windows = materialise(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    probe = materialise(probes(docs, windows.select("window", "win"), id_col, text_col), "probes")
    terms = probe.select(F.col("term"), F.lit(True).alias("rarest")).union(probe.select("term2", F.lit(False)))
    terms = materialise(terms.groupBy("term").agg(F.max("rarest").alias("rarest")), "probe_terms")
    index = build_index(docs, terms, window - 1 + slop, id_col=id_col, text_col=text_col)
    met = materialise(intersect(index, probe, slop), "met")
    # The words around: a place in a text has one posting, in whose context the window begins at here - at.
    found_at = checked_broadcast(met, met.count()).alias("m")
    around = index.where("context is not null").select("own_id", "own_hash", "pos", "here", "context").alias("c")
    same = F.col("m.own_id").eqNullSafe(F.col("c.own_id")) & (F.col("m.own_hash") == F.col("c.own_hash")) & (F.col("m.pos") == F.col("c.pos"))
    placed = around.join(found_at, same).select("window", "c.own_id", "c.own_hash", "c.pos", "here", "context")
    placed = placed.join(checked_broadcast(probe.select("window", "win", "n", "at"), limit=BLOCK), "window")
    exact = F.expr("slice(context, here - at + 1, n) = win")
    near = F.expr(f"size(array_intersect(win, slice(context, greatest(here - at - {slop}, 0) + 1, n + {2 * slop}))) >= {NEAR_SHARE} * size(array_distinct(win)) and n >= {window}")
    judged = placed.select("window", "own_id", "own_hash", (F.col("pos") - F.col("at")).alias("first"), "n", exact.alias("exact"), (near if slop else F.lit(False)).alias("near"))
    found = judged.where("exact or near").drop("near").distinct()  # repeated rows have postings each
    return found.join(checked_broadcast(windows.select("window", "item_ids"), limit=BLOCK), "window").drop("window")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``bench_n_words, bench_n_hit, bench_items`` (sorted ids of items found whole or
    in part), ``bench_n_near`` (proximity matches: places of distinct windows that are not exact) and
    ``bench_contaminated`` (at least one hit word and at least a twentieth of all words hit)."""
    p = free_prefix(docs.columns, PREFIX)
    found = matches(docs, items, window=window, slop=slop, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    # One row for each place; a place's windows differ in length only where items are short.
    per_doc = found.groupBy("own_id", "own_hash").agg(
        F.collect_set(F.when(F.col("exact"), F.struct("first", (F.col("first") + F.col("n")).alias("stop")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("item_ids")))))).alias("items"),
        F.sum(F.when(F.col("exact"), 0).otherwise(1)).alias("n_near"),
    )
    covered = F.expr("aggregate(array_sort(places), struct(0 as stop, 0 as n), (acc, x) -> struct(greatest(acc.stop, x.stop) as stop, acc.n + greatest(0, x.stop - greatest(acc.stop, x.first)) as n), acc -> acc.n)")
    hits = materialise(per_doc.select("own_id", "own_hash", covered.cast("long").alias("n_hit"), "items", "n_near"), "hits")
    rows, held = hits.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("items", ","))), F.lit(0))).first()
    hits = hits.toDF(*(f"{p}{c}" for c in ("own_id", "own_hash", "hits", "found", "near")))
    hits = F.broadcast(hits) if rows <= BLOCK and held <= HIT_BYTES else hits
    joined = docs.withColumn(f"{p}hash", F.xxhash64(own(text_col))).join(hits, own(id_col).eqNullSafe(F.col(f"{p}own_id")) & (F.col(f"{p}hash") == F.col(f"{p}own_hash")), "left")
    counted = joined.select(
        *all_of(docs),
        license_word_count(own(text_col)).alias(f"{p}n_words"),
        F.coalesce(f"{p}hits", F.lit(0).cast("long")).alias(f"{p}n_hit"),
        F.coalesce(f"{p}found", F.array().cast("array<string>")).alias(f"{p}items"),
        F.coalesce(f"{p}near", F.lit(0).cast("long")).alias(f"{p}n_near"),
    )
    return counted.withColumn(f"{p}contaminated", (F.col(f"{p}n_hit") > 0) & (20 * F.col(f"{p}n_hit") >= F.col(f"{p}n_words")))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    judged = contamination(docs, items, **options)
    return judged.where(~own(judged.columns[-1])).select(*all_of(docs))
