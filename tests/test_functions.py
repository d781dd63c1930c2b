"""Scalar functions, ranking, comparison and rollups on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sporlake.functions import keys as K
from sporlake.functions import numbers as N
from sporlake.functions import text as X
from sporlake.functions import urls as U
from sporlake.functions.readings import read
from sporlake.operators import compare as C
from sporlake.operators import ranking as R
from sporlake.operators import rollups as A


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_keys(spark):
    assert one(spark, ["123 456 785", "NO123456785MVA", "12", None], K.org_digits) == ["123456785", "123456785", None, None]
    assert one(spark, ["974760673", "974760674", None, "x"], K.has_valid_check) == [True, False, False, False]
    assert one(spark, ["Legal Name"], lambda c: K.claim_key(F.lit("1"), c, F.lit("role 1"))) == ["org:1|field:legal_name|entity:role_1"]
    assert one(spark, ["9", None], lambda c: K.compare_keys(F.lit("974760673"), c)) == ["invalid", "missing"]


def test_urls(spark):
    given_ = ["HTTP://WWW.Shared.no:80/a/", "shared.no", "https://u:p@h.no/x?b=2&utm_source=q&a=1#f", "", None, "wwf.no"]
    assert one(spark, given_, U.host) == ["shared.no", "shared.no", "h.no", None, None, "wwf.no"]
    assert one(spark, given_, U.canonical_url)[:2] == ["https://shared.no/a", "https://shared.no"]
    assert one(spark, given_, U.research_url)[2] == "https://h.no/x?a=1&b=2"
    assert one(spark, ["a.b.no"], U.host_suffixes) == [["a.b.no", "b.no"]]
    assert one(spark, ["https://facebook.com/x", "https://facebook.com/", "https://x.no/a"], U.social_platform) == ["facebook", None, None]
    assert one(spark, ["http://10.0.0.1/", "https://a.no", "ftp://a.no", "https://u@a.no", "https://localhost/"], U.is_public) == [False, True, False, False, False]
    assert one(spark, ["http://100.64.1.1/", "http://192.0.2.7", "http://198.18.0.1/", "http://8.8.8.8/", "https://10.no/", "http://240.0.0.1/"], U.is_public) == [False, False, False, True, True, False]
    assert one(spark, ["https://a.no:8443/x", "https://a.no:443/x", "http://a.no:80/x"], U.canonical_url) == ["https://a.no:8443/x", "https://a.no/x", "https://a.no/x"]
    assert one(spark, ["https://a.no/x?msclkid=1&b=2&trk=3"], U.research_url) == ["https://a.no/x?b=2"]
    assert one(spark, ["https://u:p@h.no/?token=abc&x=1"], U.redacted) == ["https://***@h.no/?token=***&x=1"]


def test_text(spark):
    assert one(spark, ["Blåbær & Co A/S", None], X.folded_name) == ["blabaer og co a s", ""]
    assert one(spark, ["Blå Bær AS", "Blå A.S", "Blå"], X.legal_form) == ["AS", "AS", None]
    assert one(spark, ["22 33 44 55", "+47 (0)22334455", "0047 22334455", "12", None], X.phone) == ["+47 22 33 44 55"] * 3 + [None, None]
    assert one(spark, ["A@B.no", "x@", None], X.email) == ["a@b.no", None, None]
    r = one(spark, ["Storgata 1, 0155 Oslo", "Storgata", None], X.address)
    assert (r[0]["street"], r[0]["postal_code"], r[0]["city"]) == ("Storgata 1", "0155", "Oslo") and r[1]["postal_code"] is None and r[2]["street"] is None


def test_numbers(spark):
    assert one(spark, ["1 234,5", "1.234.567", "12,345,678.9", "x", "", None, "1,500"], N.number) == [1234.5, 1234567.0, 12345678.9, None, None, None, 1500.0]
    r = one(spark, ["NOK 12 500 000", "12.5 million NOK", "EUR 3", None], N.amount)
    assert [(x["value"], x["currency"]) for x in r] == [(12500000.0, "NOK"), (12500000.0, "NOK"), (3.0, "EUR"), (None, "NOK")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_readings_never_fail(text):
    read(text)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=__import__("datetime").datetime(1971, 1, 1), max_value=__import__("datetime").datetime(2090, 1, 1)))
def test_readings_round_trip(t):
    from sporlake.functions.readings import as_datetime

    for f in ("%Y-%m-%dT%H:%M:%S.%fZ", "%Y%m%dT%H%M%SZ", "%d %B %Y %H:%M:%S GMT"):
        chain, r, zone = read(t.strftime(f))
        assert chain == "" and zone == "" and as_datetime(r[0]) == (t if ".%f" in f else t.replace(microsecond=0))


def test_ranking(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1), ("b", 4, 0), ("c", 5, None)], "k string, id int, s int")
    assert {(r.k, r.id) for r in R.latest_per(d, ["k"], ["s", "id"]).collect()} == {("a", 2), ("b", 3), ("c", 5)}
    assert {r.k for r in R.best_or_none(d.where("s is not null"), ["k"], "s").collect()} == {"b"}
    s = R.hash_sample(d, "id", 3, "x")
    assert [r.id for r in s.collect()] == [r.id for r in R.hash_sample(d.repartition(3), "id", 3, "x").collect()]
    assert R.hash_sample(d, "id", 9, "x", exclude=s).count() == 2
    assert {r.split for r in R.position_split(d, "id", "x").collect()} == {"development", "validation", "test"}
    big = spark.range(4000).withColumnRenamed("id", "key")
    n = {r.split: r["count"] for r in R.hash_split(big, "key", "x", {"a": 0.6, "b": 0.4}).groupBy("split").count().collect()}
    assert abs(n["a"] - 2400) < 150


def test_compare(spark):
    a = spark.createDataFrame([("k1", "m", "1"), ("k2", "n", None), ("k3", "m", "3")], "k string, m string, v string")
    b = spark.createDataFrame([("k1", "m", "1"), ("k2", "n", "0"), ("k4", "n", "4")], "k string, m string, v string")
    assert {(r.k, r.kind) for r in C.keyed_changes(a, b, ["k"], "v").collect()} == {("k1", "UNCHANGED"), ("k2", "MODIFIED"), ("k3", "REMOVED"), ("k4", "ADDED")}
    assert C.keyed_changes(a, a, ["k"], "v").where("kind != 'UNCHANGED'").count() == 0
    with pytest.raises(ValueError):
        C.require_same_members(a, b, "k")
    C.require_same_members(a, a, "k")
    m = C.fail_closed_merge(a, b, spark.createDataFrame([("n",)], "m string"), ["k"], "m")
    assert {(r.k, r.v, r.origin) for r in m.collect()} == {("k1", "1", "new"), ("k2", None, "carried over")}
    f = C.field_changes(a, b, ["k"], ["v", "m"])
    assert [(r.k, r.field, r.before, r.after) for r in f.collect()] == [("k2", "v", None, "0")]
    s = C.set_scores(a, b, ["k"]).head()
    assert (s.true_positive, s.false_positive, s.false_negative) == (2, 1, 1)
    x = spark.createDataFrame([(0, 0), (10, 25), (1000, 1060), (5, None)], "a int, b int").select(*[c.alias(n) for n, c in C.materiality(F.col("a"), F.col("b")).items()]).collect()
    assert [r.material for r in x] == [False, True, True, False] and x[3].severity == "unavailable"


def test_conflicts_and_rules(spark):
    d = spark.createDataFrame([("o", "A", 1), ("o", "a ", 5), ("o", "b", 5), ("p", "x", 1), ("q", "x", 1), ("q", "y", 2), ("r", " ", 9)], "k string, v string, a int")
    got = {r.k: (r.value, r.status, r.other) for r in A.resolve_conflicts(d, ["k"], F.col("v"), F.col("a")).collect()}
    assert got == {"o": ("a", "CONFLICTING", "b"), "p": ("x", "AVAILABLE", None), "q": ("y", "RESOLVED", None)}
    kept = spark.createDataFrame([("o", " Oslo AS ", 5), ("o", "OSLO AS", 1)], "k string, v string, a int")
    assert [(r.value, r.status) for r in A.resolve_conflicts(kept, ["k"], F.col("v"), F.col("a")).collect()] == [("Oslo AS", "AVAILABLE")]
    v = spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4)], "k string, v double")
    q = A.quantiles(v, ["k"], "v").head()
    assert (q.median, q.p50, q.p95) == (2.5, 2.0, 4.0)
    n = F.col("n")
    r = A.ranked_values(v, ["k"], "v", {"a": F.floor((n - 1) * 0.5) + 1, "b": F.least(F.floor(n * 0.5), n - 1) + 1}).head()
    assert (r.a, r.b) == (2.0, 3.0)
    same = spark.createDataFrame([("g", 5.0)] * 1000 + [("g", 1.0)] * 10, "k string, v double")
    q = A.quantiles(same, ["k"], "v").head()
    assert (q.n, q.median, q.p50, q.p95, q.min) == (1010, 5.0, 5.0, 5.0, 1.0)
    assert spark.range(1).select(A.reasons(a=F.lit(True), b=F.lit(None).cast("boolean"), c=F.lit(False))).head()[0] == ["a"]
    f = A.fingerprint(v, ["k"], ["v"]).head()
    assert f.fingerprint == A.fingerprint(v.orderBy(F.desc("v")), ["k"], ["v"]).head().fingerprint
