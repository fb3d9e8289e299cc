"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, rows are sorted by their index on the
Hilbert curve through that grid, and the order is cut into runs of equal row counts. A run covers a
compact region of the grid, so a filter on any of the dimensions can skip most shards by their
minima and maxima.

Quantising: a number goes to its place on a logarithmic scale; a string to its rank among the
distinct values (a distributed sort), scaled to the grid; null to 0. Ties on the curve are ordered by the text's CRC and
the id, so equal texts with equal metadata stand side by side. The ``rows`` law holds: counts of any
two shards differ by one at most.

Only ids, sizes, CRCs and grid cells are shuffled, never texts. Repeated rows get slots of their
own; an empty table gives no rows; columns that are not dimensions are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.llm.columns import own
from farglass.runtime import materialise, numbered


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Indices on the Hilbert curve of ``coords`` (n points by d dimensions of ``bits`` bits).

    The points' bits are turned step by step into the transposed index: from the highest bit down
    each dimension either reflects the lower bits of the first or swaps them with its own; a Gray
    decoding follows.
    """
    x = [coords[:, k].astype(np.int64) for k in range(coords.shape[1])]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(d):
            is_set = (x[k] >> level) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, d):
        x[k] = x[k] ^ x[k - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[d - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x = [v ^ fix for v in x]
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> level) & 1
    return index


def log_cell(value: Column, bits: int, least: float = 1.0, most: float = float(1 << 24)) -> Column:
    """Cell of a number on a logarithmic scale from ``least`` to ``most``; null is in cell 0."""
    cells = 1 << bits
    at = F.floor((F.log2(F.greatest(value.cast("double"), F.lit(least))) - float(np.log2(least))) / float(np.log2(most / least)) * (cells - 1)) + 1
    return F.coalesce(F.least(at, F.lit(cells - 1)), F.lit(0)).cast("int")


def string_cell(df: DataFrame, column: str, bits: int) -> Column:
    """Cell of a string by its rank among the distinct values; null is in cell 0.

    Only the least value of each cell, fewer than ``2 ** bits`` strings, comes to the driver.
    """
    distinct = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    cell = (F.floor(F.col("rank") * ((1 << bits) - 2) / F.greatest(F.col("total") - 1, F.lit(1))) + 1).cast("int")
    firsts = numbered(distinct, "value").groupBy(cell.alias("cell")).agg(F.min(F.struct("rank", "value"))["value"].alias("least")).collect()
    cells = {r.cell: r.least for r in sorted(firsts)}
    bounds = F.array(*map(F.lit, cells.values())) if cells else F.array().cast("array<string>")
    numbers = F.array(*map(F.lit, (0, *cells)))
    return F.coalesce(F.get(numbers, F.size(F.filter(bounds, lambda x: x <= F.col(column)))), F.lit(0))


def shard_rows(
    docs: DataFrame, *, shards: int = 16, bits: int = 6, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source"), numbers: dict[str, Column] | None = None
) -> DataFrame:
    """Rows ``<id_col>, size, text_crc32, law, shard, slot, grown_shard, curve``."""
    text = F.coalesce(own(text_col), F.lit(""))
    numbers = {"size": F.octet_length(text) + 1} if numbers is None else numbers
    cells = {f"n{k}": log_cell(v, bits) for k, v in enumerate(numbers.values())}
    slim = docs.select(
        own(id_col).alias("own_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), *(v.alias(k) for k, v in cells.items()), *(own(c).cast("string").alias(f"s{k}") for k, c in enumerate(strings))
    )
    slim = materialise(slim, "shard_keys")
    dims = [F.col(f"n{k}") for k in range(len(cells))] + [F.when(F.col(f"s{k}").isNull(), F.lit(0)).otherwise(string_cell(slim, f"s{k}", bits)) for k in range(len(strings))]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    placed = slim.select("own_id", "size", "crc", curve(*dims).alias("curve"))
    ranked = numbered(placed, "curve", "crc", "own_id")
    return ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int")).select(
        F.col("own_id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
