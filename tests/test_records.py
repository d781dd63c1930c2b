"""Register JSON, validation and marks in text on small cases: missing parts, nulls, odd bodies, empty tables."""

import json

from pyspark.sql import functions as F

from sporlake.functions import marks as M
from sporlake.functions import registry_json as J
from sporlake.operators import validate as V


def one(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in d.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_entity(spark):
    got = one(spark, [json.dumps({"organisasjonsnummer": "974760673", "navn": "X", "organisasjonsform": {"kode": "AS"}, "antallAnsatte": 3, "more": [1]}), "[]", None, "no json"], J.entity)
    assert (got[0].organisation_number, got[0].legal_form, got[0].employees, got[0].website) == ("974760673", "AS", 3, None)
    assert all(g is None or g.name is None for g in got[1:])


def test_accounts(spark):
    rec = lambda i, year, kind=None, start="01-01": {"id": i, "regnskapstype": kind, "regnskapsperiode": {"fraDato": f"{year}-{start}", "tilDato": f"{year}-12-31"}, "resultatregnskapResultat": {"aarsresultat": -i, "driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": 0}}}}
    body = json.dumps([rec(1, 2021), rec(2, 2023, "KONSERN"), rec(3, 2023, "SELSKAP", "07-01"), rec(4, 2022)])
    records, empty, odd = one(spark, [body, "{}", None], J.account_records)
    assert [r.record_id for r in records] == [1, 2, 3] and records[0].revenue == 0 and records[0].equity is None and (empty in ([], None) or empty[0].record_id is None) and odd == []
    s = one(spark, [body], J.statements)[0]
    assert [(x.record_id, x.year, x.months, x.account_type, x.currency) for x in s] == [(3, 2023, 6, "SELSKAP", "NOK"), (2, 2023, 12, "KONSERN", "NOK"), (4, 2022, 12, "SELSKAP", "NOK"), (1, 2021, 12, "SELSKAP", "NOK")]
    y = one(spark, [json.dumps(["2021", "2019", "x", "2021"]), None], lambda c: J.account_years(c, "https://r.no/{year}.pdf"))
    assert y[0].years == ["2019", "2021"] and y[0].documents[0].url == "https://r.no/2021.pdf" and y[1].years == []
    p = spark.createDataFrame([("2020-11-01", "2022-02-28"), ("2020-01-01", None), (None, None), ("2010-01-01", "2020-01-01")], "a string, b string").select(J.period(F.col("a"), F.col("b")).alias("p"))
    assert [(r.p.year, r.p.months) for r in p.collect()] == [(2022, 16), (2020, 12), (None, 12), (2020, 12)]


def test_roles_and_units(spark):
    body = {"rollegrupper": [{"type": {"kode": "STYR"}, "sistEndret": "2024-01-01", "roller": [{"type": {"kode": "LEDE"}, "person": {"navn": {"fornavn": "A", "mellomnavn": "", "etternavn": "B"}}}, {"enhet": {"navn": "E AS", "organisasjonsnummer": "1"}, "avregistrert": True}]}, {"type": {"kode": "X"}}]}
    r = one(spark, [json.dumps(body)], J.roles)[0]
    assert [(x.name, x.role_code, x.group_code, x.inactive, x.organisation_number) for x in r] == [("A B", "LEDE", "STYR", False, None), ("E AS", None, "STYR", True, "1")]
    u = one(spark, [json.dumps({"_embedded": {"underenheter": [{"navn": "U", "postadresse": {"kommune": "P"}}]}}), "{}"], J.units)
    assert u[0][0].address.kommune == "P" and u[1] is None


def test_observation_reasons(spark):
    good = {"id": "1", "organisation_number": "974760673", "platform": "news", "signal_type": "review", "source_url": "https://a.no", "retrieved_at": "t", "content_sha256": "a" * 64, "exact_entity": True, "identity_proof": "p", "acquisition_mode": "official_api", "rights_status": "approved", "evidence_span": "s", "sentiment_label": "mixed", "source_class": "public_news", "sentiment_model_version": "1"}
    why = lambda o: V.observation_reasons({k: F.lit(v) if v is not None else F.lit(None).cast("boolean" if k == "exact_entity" else "string") for k, v in o.items()}, ["news"])
    run = lambda o: spark.range(1).select(why(o).alias("w")).head().w
    assert run(good) == []
    assert run(dict.fromkeys(good)) == ["no_id", "bad_organisation", "unknown_platform", "unknown_signal", "no_url", "no_time", "no_hash", "entity_not_exact", "no_proof", "mode_not_approved", "rights_not_approved"]
    assert run(good | {"evidence_span": " ", "sentiment_label": "odd", "source_class": "own", "sentiment_model_version": None}) == ["no_span", "unknown_label", "label_not_independent", "no_model"]


def test_batch_checks(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "k string, s array<string>")
    want = spark.createDataFrame([("a",), ("b",)], "k string")
    ok = V.batch_checks(e(("a", ["available"]), ("b", ["blocked"])), "k", "s", want).head()
    assert ok.passed and ok.rows == 2
    bad = V.batch_checks(e(("a", ["available"]), ("a", ["pending"]), ("c", [])), "k", "s", want).head()
    assert (bad.passed, bad.exact_count, bad.repeated, bad.dropped, bad.unasked, bad.not_terminal) == (False, False, 1, 1, 1, 1)
    none = V.batch_checks(e(), "k", "s", want).head()
    assert not none.passed and none.dropped == 2


def test_marks(spark):
    assert one(spark, ["Hun er styrets leder.", "Daglig leder Kari", "Styremedlem", "Selger", None], M.role) == ["CHAIR", "CEO", "BOARD", "OTHER", "OTHER"]
    assert one(spark, ["Vi er 12 ansatte og 1 200 employees", None, "ansatte"], M.head_counts) == [[12, 1200], [], []]
    assert one(spark, ["Sertifisert etter ISO 9001 og Miljøfyrtårn", None], M.certificates) == [["ISO 9001", "Miljøfyrtårn"], []]
    assert one(spark, ["Ring +47 12 34 56 78 eller 004712345678.", None], M.phones) == [["12345678"], []]
    assert [str(d) for d in one(spark, ["den 31. mars 2021 og 1 may 2022", "31. februar 2021", None], M.written_day)] == ["2021-03-31", "None", "None"]
