"""Web sources with a stub service, the discourse study, the command line, topic grids and metrics."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from farglass import cli
from farglass.functions.html import decode_references, segments, tag_texts
from farglass.operators import collocation, linking, vectors
from farglass.operators.discourse import Discourse
from farglass.runtime import numbered, split_join
from farglass.sources import paged, tables


def three_pages(asked):
    def get(url):
        asked.append(url)
        page = int(url.split("page=")[1].split("&")[0])
        return 200, {"response": {"pages": 3, "results": [{"id": f"{page}-{k}", "title": "t"} for k in range(2)]}}

    return get


def test_paged_search_and_its_cache(spark, tmp_path):
    asked, waits, folder = [], [], str(tmp_path / "cache")
    search = dict(get=three_pages(asked), wait=waits.append, key="secret")
    first = list(paged.search_pages("http://x/search", "heat pumps", folder, **search, from_date="2020"))
    assert [p for p, _ in first] == [1, 2, 3] and len(asked) == 3 and waits == [1.0, 1.0]
    assert all("api-key=secret" in u and "from-date=2020" in u and "q=heat+pumps" in u for u in asked)
    assert list(paged.search_pages("http://x/search", "heat pumps", folder, **search, from_date="2020")) == first and len(asked) == 3  # all from the cache
    list(paged.search_pages("http://x/search", "heat pumps", folder, **search, from_date="2020", use_cache=False))
    assert len(asked) == 6
    rows = paged.land_search(spark, "http://x/search", "other", str(tmp_path / "landed"), "response struct<pages:int,results:array<struct<id:string,title:string>>>", **search)
    assert sorted(r.id for r in rows.collect()) == [f"{p}-{k}" for p in (1, 2, 3) for k in (0, 1)]


def test_search_stops_at_an_error_and_goes_on_later(tmp_path):
    asked, broken = [], {2}

    def get(url):
        page = int(url.split("page=")[1].split("&")[0])
        asked.append(page)
        return (429, {}) if page in broken else (200, {"response": {"pages": 3, "results": []}})

    options = dict(get=get, wait=lambda s: None)
    assert list(paged.search_pages("u", "t", str(tmp_path), **options))[-1] == (2, {"status": 429})
    broken.clear()
    assert [p for p, _ in paged.search_pages("u", "t", str(tmp_path), **options)] == [1, 2, 3] and asked == [1, 2, 2, 3]


def test_fetch_by_id_resumes(spark, tmp_path):
    class Service(BaseHTTPRequestHandler):
        seen: list = []
        failing = {"/3"}

        def do_GET(self):
            self.seen.append(self.path)
            good = self.path not in self.failing
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"path": self.path}).encode() if good else b"")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, folder = f"http://127.0.0.1:{server.server_port}/{{}}", str(tmp_path / "funds")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 3)], "id long")
    assert paged.fetch_by_id(spark, ids, url, folder, batch=2) == 3
    Service.failing.clear()
    assert paged.fetch_by_id(spark, ids.union(spark.createDataFrame([(4,)], "id long")), url, folder) == 2  # the failed one and the new one
    server.shutdown()
    rows = spark.read.parquet(folder).where("status = 200").collect()
    assert sorted((r.id, json.loads(r.body)["path"]) for r in rows) == [(k, f"/{k}") for k in (1, 2, 3, 4)] and Service.seen.count("/1") == 1


def test_database_tables(spark):
    url = "jdbc:derby:memory:farglass;create=true"
    spark.range(20).select(F.col("id").cast("int"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).write.jdbc(url, "things", mode="overwrite")
    rows = tables.read_jdbc(spark, url, "things", columns=["id"], partition_column="id", bounds=(0, 20), partitions=3)
    assert rows.columns == ["id"] and sorted(r.id for r in rows.collect()) == list(range(20)) and rows.rdd.getNumPartitions() == 3


TEXTS = [(1, 2001, "The heat pump works. A heat pump is new."), (2, 2002, "No such thing here."), (3, 2004, "Heat pump sales rise.\nThe heat pump works"), (4, 2004, None)]


def test_discourse(spark, tmp_path):
    study = Discourse(spark.createDataFrame(TEXTS, "id long, year int, text string"), ["heat pump", "works"], min_sentences=1)
    assert sorted(r.id for r in study.documents.collect()) == [1, 3]
    assert sorted(tuple(r) for r in study.mention_counts.collect()) == [(2001, 1, 2), (2004, 1, 2)]
    assert sorted((r.year, r.n, r.total) for r in study.shares.collect()) == [(2001, 1, 1), (2002, 0, 1), (2004, 1, 2)]
    assert {r.phrase for r in study.phrases.collect()} == {"heat pump works"}
    assert study.documents is study.documents and [r.id for r in study.texts_with(["sales"]).collect()] == [3]
    study.save(str(tmp_path), ["mention_counts", "phrase_counts"])
    assert spark.read.parquet(str(tmp_path / "phrase_counts")).count() == 1
    with pytest.raises(ValueError):
        study.save(str(tmp_path), ["nonsense"])
    with pytest.raises(ValueError):
        Discourse(study.texts, [])
    assert [Discourse(study.texts, ["works"], required=[x]).documents.count() for x in ("sales", "nothing")] == [1, 0]


def test_command_line(spark, tmp_path):
    rows = [("p1", "a", "d", "2001-02-01", 1000.0, "x"), ("p2", "b", "d", "2002-10-01", 2000.0, "y")]
    tables.write_table(spark.createDataFrame(rows, "project_id string, title string, description string, start string, amount double, category string").withColumn("start", F.to_date("start")), f"{tmp_path}/p.parquet")
    cli.main(["projects", "--projects", f"{tmp_path}/p.parquet", "--out", f"{tmp_path}/o", "--by", "category", "--first", "2001", "--last", "2002"], spark)
    made = spark.read.parquet(f"{tmp_path}/o")
    assert sorted((r.category, r.period.year, r.n_projects) for r in made.collect()) == [("x", 2001, 1), ("x", 2002, 0), ("y", 2001, 0), ("y", 2002, 1)]
    with pytest.raises(SystemExit):
        cli.main(["projects", "--out", "x"], spark)


def brute_coherence(top, docs):
    scores = []
    for words in top:
        for i, x in enumerate(words):
            for y in words[:i]:
                px, py, both = (sum(all(w in d for w in ws) for d in docs) / len(docs) for ws in ((x,), (y,), (x, y)))
                scores.append(-1.0 if not both else 1.0 if both == 1 else math.log(both / (px * py)) / -math.log(both))
    return sum(scores) / len(scores)


def test_topic_search(spark):
    docs = [["apple", "pear", "plum"] * 3, ["bolt", "screw", "nail"] * 3, ["apple", "plum"], ["bolt", "nail"], ["pear", "apple"], ["screw", "bolt"]] * 4
    texts = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "id long, words array<string>")
    model, table = vectors.search_topics(texts, "words", [2, 3], n=3, rounds=15)
    assert [(k, s) for k, s, _ in table] == [(2, 1), (3, 1)]
    counter, lda = model.stages
    matrix = lda.topicsMatrix().toArray()
    top = [[counter.vocabulary[i] for i in matrix[:, t].argsort()[::-1][:3]] for t in range(matrix.shape[1])]
    best = max(score for _, _, score in table)
    assert vectors.topic_coherence(model, texts, "words", 3) == pytest.approx(best) == pytest.approx(brute_coherence(top, docs))


def test_multi_label_metrics(spark):
    rows = [(1, 0, 0.9, 0.4), (1, 1, 0.8, 0.7), (0, 0, 0.6, 0.1), (0, 1, 0.2, 0.3), (1, 0, 0.4, 0.2)]
    made = vectors.multi_label_metrics(spark.createDataFrame(rows, "a int, b int, p double, q double"), {"a": "p", "b": "q"}).first()
    assert made.micro_f1 == pytest.approx(2 * 3 / (2 * 3 + 1 + 2)) and made.subset_accuracy == pytest.approx(2 / 5)
    assert made.roc_auc == pytest.approx(((2 + 2 + 1) / 6 + (3 + 2) / 6) / 2)


def test_phrases_of_three_words(spark):
    words = [["new", "york", "city", f"w{k}"] for k in range(12)] + [[f"x{k}", f"y{k}"] for k in range(12)]
    cut = spark.createDataFrame([(k, 0, w) for k, w in enumerate(words)], "id long, pos int, words array<string>")
    made = {r.id: r.words for r in collocation.merge_ngrams(cut, "words", ["id", "pos"]).collect()}
    assert made[0] == ["new_york_city", "w0"] and made[12] == ["x0", "y0"]


def test_pairs_straight_from_sentences(spark):
    rows = [(1, 2001, 0, ["the", "cat", "the"]), (1, 2001, 1, ["the", "cat"]), (2, 2002, 0, ["a", "the", "dog"]), (3, 2002, 0, ["dog", "the"]), (4, 2002, 0, [])]
    cut = spark.createDataFrame(rows, "id long, year int, pos int, words array<string>")
    table = collocation.term_table(cut, ["id", "year", "pos"], "words", 2, 2)
    want = collocation.cooccurrence(table, ["id", "year", "pos"], ["year"], ["the", "dog"])
    counts = collocation.term_counts(cut, "words", ["year"], 2, 2)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, table.groupBy("year", "ngram").agg(F.sum("tf")).collect()))
    assert sorted(map(tuple, collocation.term_pairs(cut, "words", counts, ["year"], ["the", "dog"]).collect())) == sorted(map(tuple, want.collect()))


def test_organisation_lookup(spark):
    a = spark.createDataFrame([(1, "Acme Ltd", "Acme Holdings", "UK"), (2, "Zed", None, "UK"), (3, "Acme", "x", "FR")], "id long, name string, legal_name string, country string")
    b = spark.createDataFrame([(10, "ACME", "UK"), (11, "acme holdings", "UK"), (12, "other", "UK")], "id long, name string, country string")
    assert [(r.id, r.matches) for r in linking.organisation_lookup(a, b).collect()] == [(1, [10, 11])]


def test_a_job_releases_its_own_files_only(spark):
    from farglass.runtime import job, materialise

    outer = materialise(spark.range(3), "outer")
    with job(spark):
        inner = materialise(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception, match="(?i)exist|found"):
        inner.count()


def test_numbered_and_split_join(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(5)
    made = sorted((r.rank, r.k, r.id, r.total) for r in numbered(rows, F.col("k").desc(), "id").collect())
    assert [(k, i) for _, k, i, _ in made] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])) and [r[0] for r in made] == list(range(1000)) and made[0][3] == 1000
    assert numbered(rows.limit(0), "id").collect() == []
    left = rows.select(F.when(F.col("id") < 400, F.lit(-1)).when(F.col("id") == 999, None).otherwise(F.col("id")).alias("key"), "id")
    right = spark.range(-1, 900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    for share in (1, 10, 10_000):
        got = split_join(left, right, "key", share)
        assert got.columns == ["key", "id", "twice"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


@pytest.mark.parametrize("text,want", [(None, None), ("", ""), ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("cut &am", "cut &am"), ("cut &amp", "cut &"), ("&eacute;&#233;&lt;p&gt;&#39;", "éé<p>'"), ("R&D &quot;", 'R&D "')])
def test_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(decode_references(F.col("t"))).first()[0] == want


def test_tag_texts_match_the_parser(spark):
    html = ["<h1>A <b>b</b></h1><p>c<p>d</p>", None, "<div>x</div>", "<p>&lt;x&gt;<br>y"]
    rows = spark.createDataFrame([(h,) for h in html], "h string").select(tag_texts(F.col("h"), ["h1", "p"])).collect()
    assert [r[0] for r in rows] == [segments(h, ["h1", "p"]) for h in html] == [["A b", "cd", "d"], [], [], ["<x>y"]]
