"""Secret scans: candidates in whole texts, judged by who has them across the corpus.

Tasks find candidates by pattern and keep a digest of each value, never the value. Digests are then
counted over the whole corpus by distinct repositories and distinct owners. A value that several owners
(or very many repositories) have is a copied example; one that few have and whose characters vary is
taken for a live credential. Spans of the base kinds are always reported; the method adds spans of
further kinds, which are too general to trust by pattern alone, where the corpus shows them to be
owner-specific.

Only digests with their owners are shuffled, pre-aggregated, and digests that many rows hold are joined
by broadcast; texts stay where they are read, and those without a hint of a candidate never leave the JVM.

Defined results: null and empty texts have no candidates; a null owner is an owner, a null repository a
repository; repeated rows are rows of their own but add no owner; positions count code points. Columns
that are asked for keep their values whatever their names are. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.llm.columns import free_prefix, own
from farglass.runtime import lookup, materialise

PREFIX = "secret_"

#: Patterns of the base kinds with the group that holds the value and its least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that their issuers begin in a known way, and signed tokens of three parts.
ISSUED = r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,500}"
#: A password in a URL.
LOGIN = r"://[A-Za-z0-9._%+-]{1,100}:([A-Za-z0-9._%+!*$-]{6,100})@"
#: Long tokens of mixed characters.
MIXED = r"[A-Za-z0-9+/_-]{24,}"
BASE = ("assign", "access", "hex")
#: In the order that spans at one start are listed in; earlier kinds win where added spans overlap.
KINDS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32), "issued": (ISSUED, 0, 12), "login": (LOGIN, 1, 6), "mixed": (MIXED, 0, 24)}
#: What a text with any candidate has in it.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|gh[pousr]_|xox[abprs]-|[rs]k_live_|AIza|eyJ|://|[A-Za-z0-9+/_-]{24}"""

#: Values that so many owners, or so many repositories, have are examples.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 100
#: Different characters that a live-looking value has at least, by kind.
VARIETY = {"assign": 8, "access": 8, "hex": 8, "issued": 8, "login": 5, "mixed": 12}

_FOUND = "array<struct<start:long,kind_no:int,end:long,digest:binary,varied:boolean>>"


def candidates_of(text: str) -> list[tuple[int, int, int, bytes, bool]]:
    """``start, number of the kind, end, digest of the value, whether it varies`` for each candidate, by start.

    Base kinds are matched each for itself. An added kind gives way to any span found before it.
    """
    out, taken = [], []
    for no, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in _COMPILED[no].finditer(text):
            value, (start, end) = m.group(group), m.span()
            if len(value) < least:
                continue
            if kind not in BASE:
                at = bisect_left(taken, (start, end))
                if at < len(taken) and taken[at][0] < end or at and taken[at - 1][1] > start:
                    continue
                if kind == "mixed" and not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
                    continue
            out.append((start, no, end, hashlib.sha256(value.encode()).digest(), len(set(value)) >= VARIETY[kind]))
        if no >= len(BASE) - 1:
            taken = _union((s, e) for s, _, e, _, _ in out)
    return sorted(out)


def _union(spans) -> list[tuple[int, int]]:
    """Disjoint spans, sorted, that cover the same places."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


_COMPILED = [re.compile(p) for p, _, _ in KINDS.values()]


def _candidates(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()), ("digest", pa.binary()), ("varied", pa.bool_())]))
    names = ("start", "kind_no", "end", "digest", "varied")
    return pa.array([[dict(zip(names, c, strict=True)) for c in candidates_of(t)] if t else [] for t in texts.to_pylist()], kind)


def candidates(docs: DataFrame, *keep: str, owner: Column, repository: Column) -> DataFrame:
    """The columns ``keep`` with ``secret_found`` (candidates), ``secret_owner`` and ``secret_repository``."""
    p = free_prefix(docs.columns, PREFIX)
    text = F.col("text").cast("string")
    return docs.select(*map(own, keep), owner.alias(f"{p}owner"), repository.alias(f"{p}repository"), F.arrow_udf(_candidates, _FOUND)(F.when(text.rlike(HINT), text)).alias(f"{p}found"))


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_owners, n_repositories`` from rows of ``digest, owner, repository``."""
    return found.groupBy("digest").agg(F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct(F.struct("repository")).alias("n_repositories"))


def scan(docs: DataFrame, *keep: str, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """A row for each document: the columns ``keep`` and ``secret_spans``.

    Spans are structs of ``start, kind_no, end, digest, varied, n_owners, n_repositories, example, live``,
    by start and kind: all of the base kinds, and those of other kinds that are live.
    """
    p = free_prefix(docs.columns, PREFIX)
    stored = candidates(docs, *keep, owner=F.col(owner), repository=F.col(repository)).withColumn(f"{p}row", F.monotonically_increasing_id())
    stored = materialise(stored, "secret_candidates")
    flat = stored.where(F.size(f"{p}found") > 0).select(F.col(f"{p}row").alias("row"), F.col(f"{p}owner").alias("owner"), F.col(f"{p}repository").alias("repository"), F.inline(f"{p}found"))
    flat = materialise(flat, "flat_candidates")
    judged = lookup(flat.drop("owner", "repository"), materialise(ownership(flat), "owners"), "digest")
    judged = judged.withColumn("example", (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))
    judged = judged.withColumn("live", F.col("varied") & ~F.col("example")).where((F.col("kind_no") < len(BASE)) | F.col("live"))
    span = F.struct("start", "kind_no", "end", "digest", "varied", "n_owners", "n_repositories", "example", "live")
    spans = judged.groupBy(F.col("row").alias(f"{p}row")).agg(F.sort_array(F.collect_list(span)).alias(f"{p}spans"))
    none = F.array().cast(spans.schema[f"{p}spans"].dataType)
    return stored.join(spans, f"{p}row", "left").select(*map(own, keep), F.coalesce(f"{p}spans", none).alias(f"{p}spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == list(KINDS).index(kind))).cast("long")
