"""Interval joins, exact draws, registered functions and streams with state."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from farglass.functions import registered
from farglass.operators import ranges, training
from farglass.streaming import events as E
from farglass.streaming import state


def intervals(n, seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randint(0, 3000) if not hot or rng.random() < 0.5 else 100
        rows.append((i, a, a + rng.choice([0, 1, 3, 10, 10, 10, 40, 2500]), rng.choice("xyz")))
    return rows + [(n, None, 5, "x"), (n + 1, 5, None, "x"), (n + 2, 50, 40, "x"), (n + 3, -70, -60, "y"), (n + 4, 10, 10, None)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_overlap_join_against_all_pairs(spark, by):
    left, right = intervals(120, 1, True), intervals(90, 2, True)
    a = spark.createDataFrame(left, "i int, a int, b int, k string")
    b = spark.createDataFrame(right, "j int, a int, b int, k string")
    b = b if by else b.drop("k")
    pairs = ranges.overlap_join(a, b, "a", "b", by)
    want = sorted((x[0], y[0]) for x in left for y in right if None not in (*x[1:3], *y[1:3]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2] and (not by or (x[3] == y[3] and x[3])))
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_join_of_nothing(spark):
    a = spark.createDataFrame([], "i int, a double, b double")
    assert ranges.overlap_join(a, a.withColumnRenamed("i", "j"), "a", "b").collect() == []


def test_a_long_interval_is_few_rows(spark):
    a = spark.createDataFrame([(0, 0, 10**9)] + [(i, i, i + 1) for i in range(1, 200)], "i long, a long, b long")
    b = a.withColumnRenamed("i", "j")
    assert ranges.overlap_join(a, b, "a", "b").where("i = 0").count() == 200


@pytest.mark.parametrize("share", [0.0, 0.2, 0.37, 1.0])
def test_exact_shares(spark, share):
    rows = [(i, random.Random(i).choice(["a", "a", "a", "b", None])) for i in range(203)] + [(500, "one")]
    table = spark.createDataFrame(rows, "id long, s string")
    got = training.take_exact(table, "s", "id", share).collect()
    n, taken = Counter(s for _, s in rows), Counter(r.s for r in got if r.taken)
    assert len(got) == len(rows) and sum(taken.values()) == -(-round(share * len(rows), 9) // 1)
    assert all(abs(taken[s] - share * n[s]) <= 1 for s in n)
    again = training.take_exact(table.repartition(7), "s", "id", share).collect()
    assert {r.id: r.taken for r in again} == {r.id: r.taken for r in got}


def test_training_sets(spark):
    rows = [(i, [1, 0, None][i % 3], i % 5 == 0) for i in range(300)]
    out = training.training_sets(spark.createDataFrame(rows, "id long, relevant int, noise boolean"), "id", "relevant", F.col("noise"))
    got = {r.id: r for r in out.collect()}
    doubtful = [i for i, label, noise in rows if noise and label != 1]
    assert len(got) == 300 and sum(got[i].relevant == 0 and got[i].part != "review" for i in doubtful if rows[i][1] is None) >= 5
    known = [r for r in got.values() if r.part != "review"]
    assert all(r.relevant + r.not_relevant == 1 for r in known) and all(r.not_relevant == 0 for r in got.values() if r.part == "review")
    for label in (0, 1):
        own = [r for r in known if r.relevant == label]
        assert abs(sum(r.part == "test" for r in own) - 0.2 * len(own)) <= 1
    assert training.training_sets(spark.createDataFrame([], "id long, relevant int, noise boolean"), "id", "relevant", F.col("noise")).collect() == []


def test_registered_functions(spark):
    registered.register(spark)
    rows = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 2.0, 2), (1, "b", None, 3), (1, "a", 5.0, 4), (2, None, 1.0, 1)], "owner long, kind string, value double, t int")
    rows.createOrReplaceTempView("steps")
    got = spark.sql("select * from runs(TABLE(steps) PARTITION BY owner ORDER BY t)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 2, 3.0), (1, "b", 1, 0.0), (1, "a", 1, 5.0), (2, None, 1, 1.0)], key=str)
    assert spark.sql("select median_deviation(value) d from steps").first().d == 0.5 and spark.sql("select median_deviation(cast(null as double)) d").first().d is None


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Events of two days as files that come out of order by less than an hour, some of them twice."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.uniform(0, 2880)), rng.randint(1, 12), rng.choice(["view", "purchase"]), float(i % 7)) for i in range(600)]
    came = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 50)))
    last = (10_000, start + timedelta(days=9), 99, "view", 0.0)  # moves the watermark past everything
    folder = str(tmp_path_factory.mktemp("landed"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def land(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")

    return rows, came, last, folder, schema, land


def test_streams_replayed_out_of_order(spark, replay, tmp_path):
    rows, came, last, folder, schema, land = replay
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_state(spark)
    try:
        table = spark.createDataFrame(rows, schema)
        stream = lambda: E.read_stream(spark, f"{folder}/*", spark.createDataFrame([], schema).schema, 1)
        parts = [came[i : i + 150] for i in range(0, 600, 150)]
        runs = {
            "once": lambda: state.once_each(stream(), "event_id", "ts", "2 hours"),
            "sessions": lambda: state.ended_sessions(stream(), "1 hour", "1 hour"),
            "pairs": lambda: state.followed_within(stream().where("event_type = 'view'"), stream().where("event_type = 'purchase'"), "user_id", "ts", "90 minutes"),
        }
        for k, part in enumerate([*parts[:2], None, *parts[2:], [last]]):
            if part is None:  # the queries stop and go on from their checkpoints
                for name, make in runs.items():
                    state.run_to(make(), f"{tmp_path}/{name}", f"{tmp_path}/check-{name}")
                continue
            copies = part[:20] if k == 1 else []
            land(part + copies, f"part-{k}")
        for name, make in runs.items():
            state.run_to(make(), f"{tmp_path}/{name}", f"{tmp_path}/check-{name}")
        got = spark.read.parquet(f"{tmp_path}/once")
        assert sorted(r.event_id for r in got.collect()) == [*range(600), 10_000]
        # Copies count twice in sessions; they are in the batch table as well.
        twice = table.unionAll(spark.createDataFrame(parts[1][:20], schema))
        want = {tuple(r) for r in state.ended_sessions(twice, "1 hour").collect()}
        ended = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/sessions").collect()}
        assert ended == want
        both = lambda t: state.followed_within(t.where("event_type = 'view'"), t.where("event_type = 'purchase'"), "user_id", "ts", "90 minutes")
        assert sorted((r.event_id, r.next_event_id) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()) == sorted((r.event_id, r.next_event_id) for r in both(twice).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_exact_quantiles(spark):
    from farglass.operators.quantiles import exact_quantiles

    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", None]), 1, rng.choice([None, 1.0, 2.5, rng.uniform(0, 9)])) for _ in range(400)] + [("b", 1, None), ("c", 1, 4.0)]
    table = spark.createDataFrame(rows, "k string, one int, x double").repartition(5)
    got = {r.k: (r.q1, r.q2, r.q3) for r in exact_quantiles(table, ["k"], "x", [0.25, 0.5, 1.0], ["q1", "q2", "q3"]).collect()}
    assert got["b"] == (None, None, None) and got["c"] == (4.0, 4.0, 4.0)
    want = table.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("q")).collect()
    assert all(got[r.k] == pytest.approx(tuple(r.q)) for r in want if r.q)
    assert exact_quantiles(table, [], "x", [0.5], ["m"]).first().m == pytest.approx(table.agg(F.median("x")).first()[0])
