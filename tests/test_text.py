from datetime import date

import pytest
from pyspark.sql import functions as F

from farglass.functions import dates, html, text
from farglass.operators import collocation, funding, search


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(f"c{k}") for k in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    "make,given,want",
    [
        (text.repair_sentences, "camelCase", "camel. Case"),
        (text.tidy_punctuation, "a • b", "a , b"),
        (text.tidy_punctuation, "(inside parentheses) ", "(inside parentheses, "),
        (text.tidy_punctuation, "wait...", "wait."),
        (text.clean_minimal, "1.First", "1.first"),
        (text.clean_minimal, None, "sentence is blank"),
        (text.drop_determiner, "the a x", "x"),
        (text.drop_determiner, "another x", "another x"),
        (text.company_name, "Foo & Bar Holdings Ltd.", "foo and bar"),
        (text.company_key, "Foo-Bar 1!", "foobar1"),
        (text.website, "https://www.X.com/", "x.com"),
        (text.website, None, ""),
        (text.label_text, "Deep tech (AI) 2.0", "Deep tech"),
        (text.singulars, "heat pumps cities boxes gas", "heat pump city box gas"),
        (text.postcode, "EC1A 1BB", "ec1a1bb"),
    ],
)
def test_cleaning(spark, make, given, want):
    assert one(spark, make, given) == want


def test_dates_and_descriptions(spark):
    assert one(spark, text.clean_date, "2020-01-02T03:04:05Z").isoformat() == "2020-01-02T03:04:05"
    assert one(spark, text.clean_date, "9999-01-01") is None and one(spark, text.clean_date, "bad") is None
    assert one(spark, text.impute_month, "2019") == date(2019, 1, 1) and one(spark, text.impute_month, "mar/2019") == date(2019, 3, 1)
    assert one(spark, text.scrub_description, "Acme makes,, pumps (big) see https://a.b", "Acme") == "This company makes, pumps see"
    assert one(spark, lambda a, b: text.join_texts(a, b), None, "x") == ". x"


def test_tokens_to_text(spark):
    df = spark.createDataFrame([(["best", "heat_pump"],)], "t array<string>")
    assert df.select(text.tokens_to_text(F.col("t"))).first()[0] == " best heat pump "
    assert df.select(text.tokens_to_text(F.col("t"), pad=False)).first()[0] == "best heat pump"


def test_term_search(spark):
    docs = spark.createDataFrame([(1, "heat pumps are best"), (2, "a pump"), (3, None)], "id int, text string")
    got = {r.id: (r.query_0, r.query_1, r.has_any_terms) for r in search.match_queries(docs, "text", [["heat", "pump"], ["pump"]]).collect()}
    assert got == {1: (True, True, True), 2: (False, True, True), 3: (False, False, False)}


def test_category_membership(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    cats = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "id int, category string")
    got = {r.id: (r.x, r.nope, r.any_category) for r in funding.category_membership(ids, cats, ["x", "nope"]).collect()}
    assert got == {1: (True, False, True), 2: (False, False, False), 3: (False, False, False)}


def test_sentences_and_mentions(spark):
    docs = spark.createDataFrame([(1, "2001", "One heat pump. Two heat pumps! "), (2, "2002", None), (3, "2002", " \n"), (4, "2003", "Heat pumps, yes\nno")], "id int, year string, text string")
    cut = search.sentences(docs, ["id", "year"], "text")
    assert sorted((r.id, r.pos, r.sentence) for r in cut.collect()) == [(1, 0, "One heat pump."), (1, 1, "Two heat pumps!"), (4, 0, "Heat pumps, yes"), (4, 1, "no")]
    low = cut.withColumn("sentence", F.lower("sentence"))
    assert search.mentions(low, ["heat pumps"]).count() == 1 and search.mentions(low, ["heat pumps", "heat pump"]).count() == 2


def test_html_segments(spark):
    pages = spark.createDataFrame([("<h1>t</h1><p>a <b>b</b></p><p>c &amp; d</p>",), (None,)], "h string")
    assert [r[0] for r in pages.select(html.tag_texts(F.col("h"))).collect()] == [["a b", "c & d"], []]
    assert [r[0] for r in pages.select(html.decode_references(F.lit("a &lt; b"))).collect()] == ["a < b"] * 2


def test_event_dates(spark):
    df = spark.createDataFrame([([date(2001, 1, 1), date(2003, 1, 1)],), (None,)], "d array<date>")
    a, b = date(2002, 1, 1), date(2004, 1, 1)
    got = df.select(dates.any_between(F.col("d"), a, b), F.size(dates.days_between(F.col("d"), a, b)), dates.first_day(F.col("d")), dates.period_label(dates.last_day(F.col("d")), "quarter")).collect()
    assert [tuple(r) for r in got] == [(1, 1, date(2001, 1, 1), "2003-Q1"), (0, 0, None, None)]


def test_phrases_merge_left_to_right(spark):
    rows = spark.createDataFrame([(1, ["heat", "pump", "works", "heat", "heat", "pump"]), (2, ["a", "b", "c"]), (3, ["x"]), (4, ["a", "b", "c", "d"])], "id int, words array<string>")
    phrases = spark.createDataFrame([("heat", "pump"), ("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r.id: r.words for r in collocation.merge_phrases(rows, "words", phrases, ["id"]).collect()}
    assert got[1] == ["heat_pump", "works", "heat", "heat_pump"] and got[2] == ["a_b", "c"] and got[4] == ["a_b", "c_d"]


def test_positive_pmi(spark):
    table = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 1), (3, "c", 1), (4, "c", 1)], "s int, ngram string, tf int")
    pairs = collocation.cooccurrence(table, ["s"], [], ["a"])
    n = spark.createDataFrame([(4,)], "n long")
    r = collocation.positive_pmi(table, pairs, n, []).collect()
    assert [(x.term, x.ngram, x.both) for x in r] == [("a", "b", 2)] and r[0].pmi == pytest.approx(0.75)
