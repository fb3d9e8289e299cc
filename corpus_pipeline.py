"""From raw documents to token files: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``, and
whatever other columns there are, unchanged.

Nulls and odd rows: a null or empty text fails the quality limits and goes. A null source is a source
of its own. A row with a null id is a document like any other; in a group of copies it stays only if
no row has an id. Rows that repeat an id with another text are documents of their own; rows that repeat
id and text are copies, of which one stays. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farglass.llm import decontamination, mixing, quality, similar, simhash, token_files
from farglass.llm.queries import IDS_TOKENIZER, table, tokenizer
from farglass.runtime import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned decision list reject go."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles with a similarity of 0.8 or more link, the smallest id stays.

    Candidates are SimHash fingerprints near each other, then MinHash lists for what those miss.
    """
    return simhash.keep_one(docs, materialise(similar.near_duplicates(docs, shingle=5, share=(4, 5)), "duplicates"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark passages go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), slop=0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; a row for each document in them, as read back."""
    written = token_files.write_token_files(docs, tokenizer(IDS_TOKENIZER))
    return token_files.read_token_files(spark, written).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: No SQL has XXH64 or a byte-level tokenizer; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
