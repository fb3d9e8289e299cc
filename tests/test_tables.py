import pytest
from pyspark.sql import functions as F

from farglass.operators import checks, funding, linking, shape, vectors
from farglass.sources import tables
from farglass.streaming import events


def test_split_and_explode(spark):
    df = spark.createDataFrame([(1, "A, B,c"), (2, "a,,b"), (3, None), (1, "c , A")], "id int, t string")
    assert [r[0] for r in df.select(shape.split_trim(F.col("t"))).collect()] == [["A", "B", "c"], ["a", "", "b"], [], ["c", "A"]]
    assert sorted((r.id, r.t or "") for r in shape.explode_list(df, "id", "t").collect()) == [(1, "A"), (1, "B"), (1, "c"), (2, ""), (2, "a"), (2, "b"), (3, "")]


def test_parallel_explode_guards_ragged_lists(spark):
    df = spark.createDataFrame([(1, "a;b", "x;y"), (2, "a;b", "x"), (3, "a", None)], "id int, kind string, who string")
    got = sorted((r.id, r.kind, r.who) for r in shape.explode_parallel(df, ["id"], ["kind", "who"], "who").collect())
    assert got == [(1, "a", "x"), (1, "b", "y"), (2, "a", None), (2, "b", None), (3, "a", None)]


def test_yearly_values_take_years_from_the_name(spark):
    df = spark.createDataFrame([(1, "1.5;;3"), (2, None), (3, "bad;2")], "id int, `SALES (2016,2017,2018)` string")
    got = sorted((r.id, r.year, r.value) for r in shape.yearly_values(df, "id", "SALES (2016,2017,2018)").collect())
    assert got == [(1, 2016, 1.5), (1, 2018, 3.0), (3, 2017, 2.0)]


def test_recode_and_parents(spark):
    df = spark.createDataFrame([(["a", "b", "z"],), (None,)], "x array<string>")
    assert df.select(shape.recode_list(F.col("x"), {"a": "A", "b": "A"})).first()[0] == ["A"]
    assert [r[0] for r in df.select(shape.parents(F.col("x"), {"a": ["P", "Q"]}, "none")).collect()] == [["P", "Q", "b", "z"], ["none"]]


def test_many_to_one_and_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert linking.many_to_one(left, right, "k").count() == 3
    with pytest.raises(ValueError):
        linking.many_to_one(right, left, "k")
    assert linking.missing_from(left, right, "k").count() == 2


def test_fuzzy_match_is_whole(spark):
    import itertools
    import random

    rng = random.Random(4)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    a = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names[:30])] + [(99, None, 0)], "id int, name string, block int")
    b = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names[30:])], "id int, name string, block int")
    grams = lambda s: {s[i : i + 3] for i in range(max(len(s) - 2, 1))}
    want = set()
    for (i, x), (j, y) in itertools.product(enumerate(names[:30]), enumerate(names[30:])):
        g, h = grams(x), grams(y)
        if i % 2 == j % 2 and len(g & h) / len(g | h) >= 0.5:
            want.add((i, j))
    got = {(r.left_id, r.right_id) for r in linking.fuzzy_match(a, b, "id", "id", "name", "block", 0.5).collect()}
    assert got == want


def test_cascade_prefers_earlier_steps(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, "", "p"), (3, None, None)], "id int, a string, b string")
    right = spark.createDataFrame([(10, "x", "q"), (11, "", "p"), (12, "y", "p")], "rid int, a string, b string")
    got = {r.id: (r.rid, r.step) for r in linking.cascade_match(left, right, [(F.col("a"), F.col("a")), (F.col("b"), F.col("b"))], "id", "rid").collect()}
    assert got == {1: (10, 0), 2: (11, 1)}


def test_latest_values_skip_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, None, None), (2, 1, None, None)], "k int, d int, x string, y int")
    got = {r.k: (r.x, r.y) for r in funding.latest_values(rows, "k", "d", ["x", "y"]).collect()}
    assert got == {1: ("a", 5), 2: (None, None)}


def test_checks(spark):
    t = spark.createDataFrame([(1, None), (2, "x"), (2, None), (3, None)], "k int, v string")
    assert {r.column: r.percent_null for r in checks.null_shares(t).collect()} == {"k": 0.0, "v": 75.0}
    assert {r.k for r in checks.duplicates(t, ["k"]).collect()} == {2}
    diff = {r.table: r for r in checks.snapshot_diff({"a": t, "b": t}, {"a": t.drop("v")}).collect()}
    assert diff["a"].columns_gone == ["v"] and not diff["b"].in_new
    assert {r.percent_null for r in checks.null_shares(t.limit(0)).collect()} == {0.0}


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline, b'), (2, None)], "id int, t string")
    tables.write_table(rows, f"{tmp_path}/x.csv", kind="csv")
    back = tables.read_csv(spark, f"{tmp_path}/x.csv", "id int, t string")
    assert sorted(back.collect()) == sorted(rows.collect())
    (tmp_path / "y.json").write_text('[{"id": 1, "fields": {"a": 2, "b": "x"}}]')
    flat = tables.flatten_struct(tables.read_any(spark, f"{tmp_path}/y.json"), "fields", ["id"])
    assert [tuple(r) for r in flat.collect()] == [(1, 2, "x")]
    tables.write_table(rows.withColumn("table_name", F.lit("k")), f"{tmp_path}/links.parquet", partition_by=["table_name"])
    catalogue = tables.Catalogue(spark, str(tmp_path))
    assert catalogue["links"].where("table_name = 'k'").count() == 2 and catalogue.views == ["links"]
    (tmp_path / "s.xml").write_text('<d><speech id="1">Hello</speech><speech id="2">Bye</speech></d>')
    assert tables.read_speeches(spark, f"{tmp_path}/s.xml").count() == 2
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.xlsx")


def test_text_table_keeps_shaped_ids(spark, tmp_path):
    good = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    (tmp_path / "o.csv").write_text(f"id,name\n{good},a\n{good},a\nbad,b\n,c\n")
    assert [tuple(r) for r in tables.read_text_table(spark, f"{tmp_path}/o.csv", ["id", "name"], id_column="id").collect()] == [(good, "a")]
    both = tables.combine([spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, 2), (2, 3)], "k int, y int")], ["k"], ["x"])
    assert both.count() == 2 and both.columns == ["k", "x", "y"]


def test_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0])], "id int, v array<float>")
    found = vectors.most_similar(store, store.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [r.id for r in found] == [3, 2]
    assert vectors.most_similar(store, store, "id", "v", 2, block=2).where("query = 1").orderBy("rank").collect() == found
    with pytest.raises(ValueError):
        vectors.upsert(store, store.union(store), "id")
    assert vectors.mean_vectors(store.withColumn("k", F.lit(1)), ["k"], "v").first().v == pytest.approx([0.75, 0.275])
    wanted = spark.createDataFrame([(2, 0), (9, 1)], "id int, o int")
    assert vectors.select_vectors(store, wanted, "id", "o").count() == 0 and vectors.select_vectors(store, wanted, "id", "o", strict=False).count() == 1


def test_streams_agree_with_batches(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    table.write.parquet(folder)
    stream = events.read_stream(spark, folder, table.schema)
    query = events.daily_totals(stream).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.event_type, r.day, r.n) for r in spark.table("daily").collect())
    assert got == sorted((r.event_type, r.day, r.n) for r in events.daily_totals(table).collect())
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        events.land(events.read_stream(spark, folder, table.schema), out, state)
    assert spark.read.parquet(out).count() == table.count()


def test_release_deletes_scratch_tables(spark):
    from farglass.runtime import materialise, release

    release(spark)
    kept = materialise(spark.range(5), "five")
    assert kept.count() == 5 and release(spark) == 1 and release(spark) == 0
