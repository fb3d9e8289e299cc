import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat()[:19].replace("T00:00:00", "") if hasattr(value, "isoformat") else str(value)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    made = entry.queries()[name](spark, FOLDER)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(made.columns)
    want = sorted([[plain(v) for v in r] for r in found.fetchall()], key=str)
    assert sorted([[plain(r[c]) for c in names] for r in made.collect()], key=str) == want
