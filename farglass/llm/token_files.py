"""Token-ID files: flat unsigned integers, 64-bit document offsets, bases from prefix sums.

A data set is a folder of shards. Shard ``k`` has three files:

* ``tokens-k.bin``   the ids of its documents one after another (uint16 where the vocabulary
  allows, else uint32, little-endian), each document followed by the end id;
* ``offsets-k.bin``  uint64, one more than documents: where each begins within the shard;
* ``docs-k.bin``     int64 document ids and a byte that is 0 for a null id.

The manifest, a table, has each shard's document and token counts and, as prefix sums of these, the
position of its first document and token in the whole. Shards hold rising ranges of ids, and ids rise
within each, so a document's global start is its shard's base plus its offset.

Nulls: a null text is an empty one (only the end id); a null id comes first. Equal ids are kept as
documents of their own, in the order of their texts. An empty table gives no documents. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farglass.llm import encoding, store
from farglass.llm.columns import own
from farglass.runtime import materialise, scratch_path

#: Shards go to at most so many tasks.
READ_TASKS = 10_000
IDS = np.dtype([("id", "<i8"), ("valid", "u1")])


@dataclass(frozen=True)
class TokenSet:
    """A written data set. ``shards`` has a row for each file triple: ``shard, n_docs, n_tokens,
    first_doc, first_token``."""

    folder: str
    dtype: str
    shards: DataFrame


def write_token_files(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, folder: str | None = None
) -> TokenSet:
    """Encode every whole text and write the files in rising order of ids."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    size = encoding.load(tokenizer).get_vocab_size(with_added_tokens=True)
    dtype, code = ("<u2", "H") if max(size, end_id + 1) <= 1 << 16 else ("<u4", "I")

    def write(batches):
        name = f"{TaskContext.get().partitionId():06d}.bin"
        encoder = encoding.per_worker(encoding.IdEncoder, tokenizer, code)
        end = encoder._pack([end_id])
        tokens = offsets = ids = None
        total, n = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if tokens is None:
                tokens, offsets, ids = (store.Committed(folder, f"{kind}-{name}") for kind in ("tokens", "offsets", "docs"))
                offsets.write(np.zeros(1, "<u8").tobytes())
            given = batch.column(0)
            own = np.zeros(batch.num_rows, IDS)
            own["valid"] = np.asarray(given.is_valid())
            own["id"] = given.fill_null(0).to_numpy(zero_copy_only=False)
            ids.write(own.tobytes())
            lengths = []
            for run in encoding.chunks([x or "" for x in batch.column(1).to_pylist()]):
                encoded = encoder.encode(run)
                lengths += [len(x) + len(end) for x in encoded]
                tokens.write(end.join([*encoded, b""]))
            ends = total + np.cumsum(np.array(lengths, np.uint64)) // np.uint64(len(end))
            offsets.write(ends.astype("<u8").tobytes())
            total, n = int(ends[-1]), n + batch.num_rows
        if tokens is not None:
            for f in (tokens, offsets, ids):
                f.commit()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "n_docs": [n], "n_tokens": [total]})

    sorted_docs = docs.select(own(id_col).cast("long").alias("id"), own(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows = materialise(sorted_docs.mapInArrow(write, "shard long, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    firsts = {f"first_{k}": F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in (("doc", "n_docs"), ("token", "n_tokens"))}
    return TokenSet(folder, dtype, materialise(rows.withColumns(firsts), "manifest"))


def read_token_files(spark: SparkSession, data: TokenSet, rows: int = 2000) -> DataFrame:
    """Documents of a written set: id, position, global start, count and the ids' CRC-32.

    Columns ``doc_id, position, start, n_tokens, ids_crc32``. One task for each shard; the files
    are memory-mapped and ``rows`` documents are in hand at a time.
    """
    folder, dtype = data.folder, np.dtype(data.dtype)
    schema = "doc_id long, position long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                k, name = s["shard"], f"{s['shard']:06d}.bin"
                with store.open_mapped(folder, f"tokens-{name}") as tokens, store.open_mapped(folder, f"offsets-{name}") as offsets, store.open_mapped(folder, f"docs-{name}") as ids:
                    if tokens.size() != s["n_tokens"] * dtype.itemsize or offsets.size() != 8 * (s["n_docs"] + 1):
                        raise ValueError(f"shard {k} of {folder} does not agree with its manifest")
                    for at in range(0, s["n_docs"], rows):
                        n = min(rows, s["n_docs"] - at)
                        own = np.frombuffer(ids.read_at(n * IDS.itemsize, at * IDS.itemsize), IDS)
                        ends = np.frombuffer(offsets.read_at(8 * (n + 1), 8 * at), "<u8").astype(np.int64)
                        crcs = []
                        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                            raw = tokens.read_at((b - a) * dtype.itemsize, a * dtype.itemsize)
                            crcs.append(zlib.crc32(np.frombuffer(raw, dtype).astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(own["id"].astype(np.int64), mask=own["valid"] == 0),
                                pa.array(np.arange(s["first_doc"] + at, s["first_doc"] + at + n)),
                                pa.array(s["first_token"] + ends[:-1]),
                                pa.array(ends[1:] - ends[:-1]),
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["doc_id", "position", "start", "n_tokens", "ids_crc32"],
                        )

    return data.shards.repartition(max(1, min(data.shards.count(), READ_TASKS))).mapInArrow(read, schema)
