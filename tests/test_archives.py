"""Zipped tables and paged services as data sources."""

import json
import zipfile

from farglass.sources import archives

SCHEMA = "id long, name string, day date, x double"


def test_zipped_tables_round_trip(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "case when id % 7 = 0 then null when id % 5 = 0 then '' else concat('é \"q\", ', id, '\\n') end as name", "date_add(date'2020-01-01', cast(id % 900 as int)) as day", "case when id % 3 = 0 then null else id / 8 end as x").repartition(3)
    archives.write_zipped_csv(rows, str(tmp_path))
    back = archives.read_zipped_csv(spark, str(tmp_path), SCHEMA)
    assert back.rdd.getNumPartitions() == len(list(tmp_path.glob("*.zip"))) == 3
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_members_columns_and_empty_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "name,id,more\nb,2,z\n")
        z.writestr("deep/two.csv", "id\n3\n")
        z.writestr("empty.csv", "")
        z.writestr("notes.txt", "no table")
    got = archives.read_zipped_csv(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.id, r.name, r.day, r.x) for r in got) == [(2, "b", None, None), (3, None, None, None)]
    (tmp_path / "none").mkdir()
    assert archives.read_zipped_csv(spark, str(tmp_path / "none"), SCHEMA).collect() == []


def service(folder, pages):
    for k in range(1, pages + 1):
        results = [{"id": f"{k}-{i}", "title": f"é {i}"} for i in range(3)]
        (folder / f"{k}.json").write_text(json.dumps({"response": {"pages": pages, "results": results}}))
    return f"file://{folder}/{{page}}.json"


def test_paged_service_in_parallel_and_resumed(spark, tmp_path):
    spark.dataSource.register(archives.PagedSearch)
    (tmp_path / "service").mkdir()
    url = service(tmp_path / "service", 4)
    read = spark.read.format("paged_search").option("url", url).load()
    assert read.rdd.getNumPartitions() == 4 and read.count() == 12

    def run():
        stream = spark.readStream.format("paged_search").option("url", url).option("pagesPerBatch", 3).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    for _ in range(2):
        first = run()
    assert first == sorted(f"{k}-{i}" for k in range(1, 5) for i in range(3))
    service(tmp_path / "service", 6)  # two more pages: only these are read
    (tmp_path / "service" / "2.json").write_text("not to be read again")
    for _ in range(2):
        last = run()
    assert last == sorted(f"{k}-{i}" for k in range(1, 7) for i in range(3))
