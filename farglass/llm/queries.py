"""One query for each corpus operator: production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farglass.llm import decontamination, hilbert, html_text, licenses, mixing, prefix_trie, quality, ranked_search, secret_scan, simhash, token_counts, token_files, warc
from farglass.llm.columns import free_prefix
from farglass.llm.sql import ORACLES
from farglass.llm.words import license_word_count
from farglass.runtime import scratch_path

IDS_TOKENIZER = "byte_bpe_50k.json"
COUNT_TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, p = licenses.scan(docs), free_prefix(docs.columns, licenses.PREFIX)
    base = F.filter(f"{p}found", lambda d: d["base"])
    firsts = F.transform(base, lambda d: d["first"].cast("long"))
    return found.select(
        "doc_id",
        license_word_count(F.col("text")).alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join(f"{p}labels", ",").alias("labels"),
        F.col(f"{p}score").alias("score"),
        F.size(F.filter(f"{p}found", lambda d: d["kept"])).cast("long").alias("n_kept"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, p = mixing.mix(docs), free_prefix(docs.columns, mixing.PREFIX)
    return mixed.select(
        "doc_id",
        F.col(f"{p}size").alias("size"),
        F.col(f"{p}source_size").cast("long").alias("source_size"),
        F.col(f"{p}target").alias("target"),
        (F.col(f"{p}size") * F.col(f"{p}copies")).alias("taken"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer(IDS_TOKENIZER))
    return token_files.read_token_files(spark, written).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, names = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder, names).select(F.col("own_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(COUNT_TOKENIZER), scratch_path(spark, "token_counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, p = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")), free_prefix(docs.columns, decontamination.PREFIX)
    return found.select(
        "doc_id",
        F.col(f"{p}n_words").alias("n_words"),
        F.col(f"{p}n_hit").alias("n_hit"),
        F.size(f"{p}items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{p}items", ","), 256).alias("items_sha256"),
        F.col(f"{p}contaminated").alias("contaminated"),
        F.col(f"{p}n_near").alias("n_near"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    p = free_prefix(docs.columns, quality.PREFIX)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"{p}{c}").alias(c) for c in counts))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.spliced_trie(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = F.col(free_prefix(docs.columns, secret_scan.PREFIX) + "spans")
    base = F.filter(spans, lambda s: s["kind_no"] < len(secret_scan.BASE))
    return secret_scan.scan(docs, "doc_id").select(
        "doc_id",
        *(secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_examples"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_token_files, op4_hilbert_shards, op5_warc, op6_token_counts, op7_decontaminate, op8_html_text, op9_simhash, op10_quality_rules, op11_prefix_trie, op12_secret_scan, op13_ranked_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
