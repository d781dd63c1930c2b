"""Assessments and semi-structured values on small fixtures."""

from pyspark.sql import functions as F

from sporlake.functions import documents as D
from sporlake.operators import assess as S


def test_documents(spark):
    d = spark.createDataFrame([('{"b": [2, 1], "a": " x  y ", "c": 1.00001, "d": 2.0}', "abcd"), ("no json", None), (None, "x")], "v string, t string")
    r = d.select(D.canonical_json("v").alias("c"), D.similarity(F.lit("abxd"), F.col("t")).alias("s")).collect()
    assert [x.c for x in r] == ['{"a":"x y","b":[1,2],"c":1,"d":2}', "no json", None] and r[0].s == 0.75 and r[1].s is None
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    words = lambda *w: F.array(*map(F.lit, w))
    assert one(D.contains_sequence(words("a", "b", "c"), words("b", "c"))) and not one(D.contains_sequence(words("a", "b", "c"), words("a", "c")))
    assert not one(D.contains_sequence(words("a"), words("a", "b")))
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    assert one(D.retry_after(F.lit("12"), now)) == 12.0 and one(D.retry_after(F.lit("Wed, 01 Jan 2020 00:00:30 GMT"), now)) == 30.0
    assert one(D.ungrounded_numbers(F.lit("revenue of 1 234 567 in 2020, 3 people, 99"), words("1234567", "year 2020"))) == ["99"]


def test_lookup_and_relations(spark):
    d = spark.createDataFrame([(1, "https://a.b.no/x"), (2, "https://c.se"), (3, None)], "id int, url string")
    rules = spark.createDataFrame([("b.no", "parent"), ("a.b.no", "own"), ("se", "never")], "domain string, rule string")
    assert {(r.id, r.rule) for r in S.lookup_by_domain(d, "url", "id", rules).collect()} == {(1, "own"), (2, None), (3, None)}
    parents = spark.createDataFrame([("p", None), ("a", "p"), ("b", "p"), ("z", None)], "org string, parent string")
    pairs = spark.createDataFrame([("p", "a"), ("a", "p"), ("a", "b"), ("a", "z"), ("a", "a")], "x string, y string")
    assert [r.relation for r in S.group_relation(pairs, parents, "x", "y").orderBy("relation").collect()] == ["none", "parent", "same", "sister", "subsidiary"]


def test_pages_and_links(spark):
    d = spark.createDataFrame([("Øst Bakeri AS", "974760673", "Øst bakeri", "org 974 760 673"), ("Øst Bakeri AS", "974760673", "Øst bakeri", "888888888"), ("Øst Bakeri AS", "974760673", "Øst bakeri", ""), ("Øst Bakeri AS", "974760673", "Domain for sale", "974760673"), ("Øst Bakeri AS", "974760673", None, None)], "n string, o string, t string, x string")
    got = [r.p.score for r in d.select(S.page_identity(F.col("n"), F.col("o"), F.col("t"), F.col("x")).alias("p")).collect()]
    assert got == [1.0, 0.1, 0.85, 0.1, 0.1]
    links = spark.createDataFrame([("p", u) for u in ("/jobs/long", "/jobs", "/om-oss", "/news", "/news/1", "/x")], "page string, url string")
    r = S.priority_links(links, "page", "url", {"careers": "job", "news": "news", "about": "om-oss"}, 4).orderBy("place").collect()
    assert [(x.url, x.category) for x in r] == [("/jobs", "careers"), ("/news", "news"), ("/om-oss", "about"), ("/jobs/long", "careers")]
