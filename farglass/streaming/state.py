"""Streams with state: late and repeated rows, joins within an interval, sessions that end by a timer.

The functions take streams and, where they can, tables of the same columns, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and lists of state need this store; set it before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def once_each(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Rows of which none with the same key came before; state is kept only as long as a copy may be late.

    A table is made distinct as a whole; of copies with other values any one stays.
    """
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def followed_within(first: DataFrame, second: DataFrame, key: str, ts: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of rows of one key, the second at the same time as the first or up to ``within`` later.

    The second's columns get the prefix ``next_``. Both sides' state is cleared by watermark.
    """
    after = second.withColumnsRenamed({c: f"next_{c}" for c in second.columns})
    if first.isStreaming:
        first, after = first.withWatermark(ts, late), after.withWatermark(f"next_{ts}", late)
    near = (F.col(key) == F.col(f"next_{key}")) & (F.col(f"next_{ts}") >= F.col(ts)) & (F.col(f"next_{ts}") <= F.col(ts) + F.expr(f"interval {within}"))
    return first.join(after, near).drop(f"next_{key}")


class SessionEnds(StatefulProcessor):
    """Open sessions of one key as ``first, last, n, total`` (times in microseconds).

    Rows may come in any order: a row extends every session that it is less than the gap away from, and
    those become one. A session is given out when the watermark has passed its last row by the gap.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total double")

    def _set(self, spans: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.put(spans)
            self.handle.registerTimer(min(s[1] for s in spans) // 1000 + self.gap // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        for batch in rows:
            for at, value in zip(batch["at"], batch["value"], strict=True):
                mine = [s for s in spans if s[0] - self.gap < at < s[1] + self.gap]
                spans = [s for s in spans if s not in mine]
                spans.append((int(min([at, *(s[0] for s in mine)])), int(max([at, *(s[1] for s in mine)])), 1 + sum(s[2] for s in mine), float(value) + sum(s[3] for s in mine)))
        self._set(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        done = [s for s in spans if s[1] + self.gap <= now]
        self._set([s for s in spans if s not in done])
        if done:
            yield pd.DataFrame([(key[0], *s) for s in sorted(done)], columns=["user_id", "first_us", "last_us", "n", "total"])

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """``user_id, first_ts, last_ts, n, total`` of the sessions of a stream (``ts, user_id, value``), when they end.

    A table's sessions are those that ``events.sessions`` has, all of them.
    """
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("value"))
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    if not events.isStreaming:
        found = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("value").alias("total"))
        return found.select("user_id", "first_ts", "last_ts", "n", "total")
    keyed = timed.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    found = keyed.groupBy("user_id").transformWithStateInPandas(SessionEnds(gap_ms), outputStructType="user_id long, first_us long, last_us long, n long, total double", outputMode="Append", timeMode="EventTime")
    return found.select("user_id", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n", "total")


def run_to(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Everything that has come since the last run, appended to a folder of Parquet; then the run ends."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
