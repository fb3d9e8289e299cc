"""Session helpers: shared scratch storage, materialised steps and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of short rows may be sent to every executor.
BROADCAST_ROWS = 200_000


def session(app: str = "farglass", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE)."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only with a local master: on a
    cluster each machine would see its own folder, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="farglass-")
    atexit.register(shutil.rmtree, root, True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders made by the job at hand; outside of any ``job`` they belong to the process.
_MADE: ContextVar[list[str]] = ContextVar("farglass_made", default=[])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    made = _MADE.get()
    made.append(f"{scratch_root(spark)}/farglass/{uuid.uuid4().hex}")
    return f"{made[-1]}/{name}"


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Release at the end what is put into the shared folder within, and nothing else."""
    token = _MADE.set([])
    try:
        yield
    finally:
        release(spark)
        _MADE.reset(token)


def release(spark: SparkSession) -> int:
    """Delete what this job (or, outside of one, this process) has put into the shared folder, once
    results are written elsewhere.

    DataFrames that read from it are of no use afterwards. Returns the number of folders.
    """
    conf, made = spark.sparkContext._jsc.hadoopConfiguration(), _MADE.get()
    n = 0
    while made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a step once to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a lost executor costs a
    re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._farglass_folder = path.rpartition("/")[0]
    return stored


def discard(*steps: DataFrame) -> None:
    """Delete the files of stored steps (results of ``materialise``) that nothing will read any more."""
    for step in steps:
        folder, spark = step._farglass_folder, step.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _MADE.get():
            _MADE.get().remove(folder)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table is known to be small; else leave the join to the optimiser.

    ``rows`` is the known row count; without it the table is counted. Only for tables of short rows.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


#: Keys that hold at least this part of the rows (1 / HOT_SHARE) are joined apart; so many are there at most.
HOT_SHARE = 10_000


def split_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], share: int | None = None) -> DataFrame:
    """Inner join of ``left`` with a table that has one row for each key, whatever a key's share is.

    Keys with at least one ``share``-th of the rows of ``left`` are at most ``share`` keys, so their
    rows of ``right`` are broadcast, and no task gathers a hot key; the rest is joined as usual. Rows
    with a null key are dropped. ``left`` is read three times and should be materialised.
    """
    on, share = [keys] if isinstance(keys, str) else list(keys), share or HOT_SHARE
    counts = left.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_rows"))
    hot = materialise(counts.where(F.col("_rows") * share >= left.count()).select(*on), "hot_keys")
    few = left.join(F.broadcast(right.join(F.broadcast(hot), on)), on)
    return few.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


def lookup(left: DataFrame, right: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``split_join`` for a table of short rows, which is sent whole where its count (``rows``, if known)
    shows it to be small."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right), list(keys)) if rows <= BROADCAST_ROWS else split_join(left, right, keys)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank`` (from 0, in the given order) and ``total``: a range sort whose partitions'
    bases are prefix sums of their counts, so that no task sees all rows. Without an order the ranks
    are only dense, and nothing is sorted."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # The partition number is in the upper bits of this id, the row's place in it in the lower 33.
    ordered = materialise(ordered.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # A row for each partition: its base is the number of rows in those before it.
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")
    bases = counts.select("_part", before.alias("_base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = ordered.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn("rank", F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_place", "_base")
