"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens) in a folder. A text's digest is the
SHA-256 of its normalised content: runs of ASCII white space become one space and the ends are
trimmed, which the tokenizer does as well, so texts of one digest have one count. Counts are looked
up by content digest and tokenizer digest; only distinct texts that the cache lacks are encoded,
and their counts are appended to it.

A digest that holds a large part of the rows is joined by broadcast (``runtime.split_join``), so no
task gathers the copies of one text; of the copies themselves one text is encoded.

Nulls: a null text counts as an empty one. Repeated rows stay, each with its count. An empty table
gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farglass.llm import encoding
from farglass.llm.columns import own
from farglass.llm.words import BLANKS
from farglass.runtime import BROADCAST_ROWS, materialise, split_join

CACHE = "digest binary, tokenizer string, n_tokens long"


def content_digest(text):
    """SHA-256 of the normalised text, as 32 bytes."""
    normal = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))
    return F.unhex(F.sha2(normal, 256))


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; a digest that two writers have added is there once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    found = spark.read.schema(CACHE).parquet(folder) if there else spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``<id_col>, n_bytes, n_tokens, cached`` (whether the cache had the count before)."""
    spark, version = docs.sparkSession, encoding.tokenizer_digest(tokenizer)
    texts = docs.select(own(text_col).alias("text")).withColumn("digest", content_digest(F.col("text")))
    keyed = docs.select(
        own(id_col).alias("own_id"), F.octet_length(F.coalesce(own(text_col), F.lit(""))).cast("long").alias("n_bytes"), content_digest(own(text_col)).alias("digest")
    )
    keyed = materialise(keyed, "content_digests")
    known = read_cache(spark, cache, version)
    misses = materialise(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        if n <= BROADCAST_ROWS // 4:
            wanted = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            wanted = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")

        def count(batches):
            counter = encoding.per_worker(encoding.TokenCounter, tokenizer)
            for batch in batches:
                counts: list[int] = []
                for run in encoding.chunks([x or "" for x in batch.column("text").to_pylist()]):
                    counts += counter.count(run)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

        wanted.select("digest", "text").mapInArrow(count, CACHE).write.mode("append").parquet(cache)
    stored = read_cache(spark, cache, version).join(misses.withColumn("miss", F.lit(True)), "digest", "left")
    counted = split_join(keyed, stored, "digest")
    return counted.select(F.col("own_id").alias(id_col), "n_bytes", "n_tokens", F.col("miss").isNull().alias("cached"))
