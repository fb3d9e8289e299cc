"""Readers, writers and the table catalogue."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed value: the shape of the ids of one source.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, *, header: bool = True, encoding: str = "UTF-8", separator: str = ",") -> DataFrame:
    """CSV with quoted line breaks. Without a schema every column is text: nothing is read twice."""
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("sep", separator).option("header", header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], *, limit: int | None = None, id_column: str | None = None, id_pattern: str = UUID, header: bool = True) -> DataFrame:
    """Distinct rows of a CSV with every column as text; ids that do not match their shape go."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = read_csv(spark, path, schema, header=header)
    rows = rows.limit(limit) if limit is not None else rows
    rows = rows.distinct()
    return rows.where(F.col(id_column).rlike(id_pattern)) if id_column else rows


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's first row in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("first_rank", rank).where("first_rank = 1").drop("first_rank")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, *, array: bool = True) -> DataFrame:
    """A file that holds one JSON array, or JSON lines."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """A reader by the file's suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix == ".csv":
        return read_csv(spark, path, **options)
    if suffix == ".json":
        return read_json(spark, path, **options)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {suffix or path!r}")


def flatten_struct(rows: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """A struct's fields as columns, beside those to keep."""
    return rows.select(*keep, f"{column}.*")


def records(rows: DataFrame, key: str) -> DataFrame:
    """``key, record``: each row's other columns as a JSON text."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("record"))


def combine(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Tables stacked by column name, missing columns null, one row for each key: the first in an
    order, or any."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return first_by_key(stacked, keys, order) if order else stacked.dropDuplicates(list(keys))


def read_jdbc(spark: SparkSession, url: str, table: str, *, columns: Sequence[str] = (), partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, fetch_size: int = 1000, **options) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **options)
    if partition_column:
        low, high = bounds
        reader = reader.options(partitionColumn=partition_column, lowerBound=low, upperBound=high, numPartitions=partitions)
    rows = reader.load()
    return rows.select(*columns) if columns else rows


def read_speeches(spark: SparkSession, path: str, row_tag: str = "speech", schema: StructType | str | None = None) -> DataFrame:
    """Speeches of an XML archive: a row for each element, attributes with a leading underscore."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(rows: DataFrame, path: str, *, kind: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV or JSON for export. Partitioned link tables are pruned when read by kind."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for {kind!r}")
    writer = rows.write.mode(mode).partitionBy(*partition_by)
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)


def names_by_id(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct (key, name) with a name."""
    return rows.where(F.col(name).isNotNull()).select(key, name).distinct()


class Catalogue:
    """Tables by name below a folder, opened when first asked for; reading itself stays lazy."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet"):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = read_any(self.spark, f"{self.folder}/{name}.{self.kind}")
        return self._open[name]

    @cached_property
    def views(self) -> list[str]:
        """Registers every open table as a temporary view of its name."""
        for name, rows in self._open.items():
            rows.createOrReplaceTempView(name)
        return sorted(self._open)


def pages_from_files(spark: SparkSession, folder: str, schema: StructType | str, results: str = "results") -> DataFrame:
    """Articles from landed API pages (a JSON file for each), one row for each result."""
    return read_json(spark, folder, schema).select(F.explode(results).alias("r")).select("r.*").dropDuplicates(["id"])
