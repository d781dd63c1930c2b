"""Sources, sinks and streams on small files."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from sporlake import sinks
from sporlake.sources import pages, records, registry
from sporlake.streaming import streams as S


def test_registry(spark, tmp_path):
    p = str(tmp_path / "r.csv.gz")
    with gzip.open(p, "wt", encoding="utf-8-sig") as f:
        f.write("organisasjonsnummer;navn;organisasjonsform.kode;antallAnsatte;konkurs;forretningsadresse.poststed;kapital.belop;registrertIMvaRegisteret\n")
        f.write("974760673;Øst AS;AS;x;true;Oslo;30 000,50;\n123;Short;AS;1;false;;;true\n888888888;\"A; B\";ENK;0;;;;false\n")
    rows = {r.organisation_number: r for r in registry.read_registry(spark, p).collect()}
    assert set(rows) == {"974760673", "888888888"}
    a, b = rows["974760673"], rows["888888888"]
    assert a.employees is None and a.bankrupt and a.business_address.poststed == "Oslo" and a.business_address.land == "Norge" and a.share_capital.amount == 30000.5 and a.vat_registered is None
    assert b.name == "A; B" and b.employees == 0 and not b.bankrupt and b.business_address is None and b.share_capital is None and b.vat_registered is False
    keys = tmp_path / "k.txt"
    keys.write_text("888 888 888\n111111111\n974760673\n")
    got = registry.lookup(registry.read_registry(spark, p), registry.read_keys(spark, str(keys))).collect()
    assert [(r.organisation_number, r.found) for r in got] == [("888888888", True), ("111111111", False), ("974760673", True)]
    keys.write_text("888888888\n888888888\n")
    with pytest.raises(ValueError):
        registry.read_keys(spark, str(keys))
    lines = tmp_path / "k.jsonl"
    lines.write_text('{"organisation_number": "974760673", "sample_slice": "s"}\n')
    assert registry.read_keys(spark, str(lines)).head().sample_slice == "s"


def test_profiles_first_path_wins(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.tar.gz"
    a.write_text('{"organisation_number": "1", "name": "first"}\nnot json\n{"organisation_number": "1", "name": "again"}\n')
    with tarfile.open(b, "w:gz") as t:
        data = b'{"organisation_number": "1", "name": "late"}\n{"organisation_number": "2", "name": "two"}\n'
        i = tarfile.TarInfo("x/rows.jsonl")
        i.size = len(data)
        t.addfile(i, io.BytesIO(data))
    got = records.read_profiles(spark, [str(a), str(b)], "organisation_number string, name string")
    assert {(r.organisation_number, r.name) for r in got.collect()} == {("1", "first"), ("2", "two")}


def test_replay_and_sitemaps(spark):
    req = records.fan_out(spark.createDataFrame([("1",)], "organisation_number string"), {"registry": "https://r/{}", "roles": "https://o/{}"})
    res = spark.createDataFrame([("https://r/1", 200, "{}", "t")], "url string, status int, body string, retrieved_at string")
    assert {(r.module, r.evidence_status) for r in records.replay(req, res).collect()} == {("registry", "available"), ("roles", "unavailable")}
    xml = spark.createDataFrame(
        [("i", '<?xml version="1.0"?><sitemapindex xmlns="http://x"><sitemap><loc>p</loc></sitemap></sitemapindex>'), ("p", '<urlset xmlns="http://x"><url><loc>https://a/1</loc></url></urlset>'), ("q", "<urlset><url><loc>https://a/2</loc>")],
        "url string, xml string",
    )
    seeds = spark.createDataFrame([("1", "i"), ("1", "q")], "org string, url string")
    assert {r.url for r in records.expand_sitemaps(seeds, xml).collect()} == {"https://a/1", "https://a/2"}
    assert spark.range(1).select(records.robots_sitemaps(F.lit("User-agent: *\nSitemap: https://a/s.xml\n"))).head()[0] == ["https://a/s.xml"]


def test_sitemap_indexes_of_any_depth(spark):
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in to) + "</sitemapindex>"
    # six levels down, and back to the first one
    xml = [(f"i{k}", index(f"i{k + 1}", "i0")) for k in range(5)] + [("i5", index("p", "i2")), ("p", "<urlset><url><loc>https://a/1</loc></url></urlset>")]
    seeds = spark.createDataFrame([("1", "i0"), ("1", "i0"), (None, "i4")], "org string, url string")
    got = records.expand_sitemaps(seeds, spark.createDataFrame(xml, "url string, xml string")).collect()
    assert sorted((r.org or "", r.url) for r in got) == [("", "https://a/1"), ("1", "https://a/1")]


def test_cases(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"cases": [{"case_id": "a"}, {"case_id": "a"}, {"case_id": "b"}]}))
    assert sorted(r.case_id for r in records.read_cases(spark, str(p), "case_id:string").collect()) == ["a", "a-2", "b"]


def test_pages(spark):
    html = '<title> A  B </title><meta name=description content=d><script type="application/ld+json">{"@type":"Organization","name":"N","sameAs":["https://facebook.com/n"]}</script><script>x()</script><p>Org 974 760 673</p><a href="/om">o</a><a href="mailto:x">m</a>'
    d = spark.createDataFrame([("1", "https://a.no/", "homepage", "t", html), ("1", "https://a.no/om", "about", "t", ""), ("1", "https://a.no/x", "about", "t", None)], "organisation_number string, url string, page_kind string, retrieved_at string, html string")
    e = pages.page_events(d)
    r = e.where("page_kind = 'homepage'").head()
    assert r.event.title == "A B" and r.event.description == "d" and r.event.links == ["https://a.no/om"] and r.event.social == ["https://facebook.com/n"] and r.event.org_name == "N" and r.event.org_numbers == ["974 760 673"] and "x()" not in r.event.text
    m = pages.merge_pages(e).head()
    assert m.pages == 3 and m.errors == 2 and m.homepage.title == "A B" and m.social == ["https://facebook.com/n"]


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.put(t, d, ["k"], ["v"])
    sinks.put(t, spark.createDataFrame([(2, "c"), (3, "d"), (2, "b")], "k int, v string"), ["k"], ["v"])
    assert {tuple(r) for r in spark.read.parquet(t).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    (tmp_path / "t").rename(tmp_path / "t-old")  # as if a run was lost between the renames
    sinks.put(t, d.limit(0), ["k"], ["v"])
    assert spark.read.parquet(t).count() == 3
    nested = spark.createDataFrame([((1, (2, [3])),)], "a struct<b: int, c: struct<d: int, e: array<int>>>")
    assert sorted(sinks.flattened(nested).columns) == ["a_b", "a_c_d", "a_c_e"]
    paths = sinks.write_reports(d, {"n": 2}, str(tmp_path / "rep"))
    assert json.load(open(paths["summary"])) == {"n": 2} and spark.read.json(paths["records"]).count() == 2
    assert sinks.manifest(spark, paths["summary"]).head().bytes > 0
    prof = spark.createDataFrame([("1",), ("2",)], "organisation_number string")
    ev = spark.createDataFrame([("1", "web", "available", "u", "h", "x" * 400, 7)], "organisation_number string, field string, status string, source_url string, content_sha256 string, evidence_excerpt string, evidence_id long")
    env = sinks.envelopes(prof, ev, "run")
    got = {r.organisation_number: r for r in env.collect()}
    assert got["1"].state == "complete" and len(got["1"].evidence[0].span) == 300 and got["2"].state == "submission_error"
    assert all(sinks.check_envelopes(env, 2).values()) and not sinks.check_envelopes(env, 3)["exact_count"]


def test_stream_deduplication(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b")], "id int, t string, v string").select("id", F.to_timestamp("t").alias("ts"), "v")
    d.write.parquet(str(tmp_path / "events.parquet"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "events.parquet"))
    assert S.drain(S.deduplicated(s, ["id"]), "append").count() == 2


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a # all of it\nAllow: /a/b\n\nUser-agent: x\nDisallow: /\n"
    rules = records.robots_rules(spark.createDataFrame([("h.no", text), ("e.no", ""), (None, text), ("n.no", None)], "host string, text string"))
    u = spark.createDataFrame([(1, "https://h.no/a/b"), (2, "https://www.h.no/c"), (3, "https://e.no/a"), (4, "https://o.no/a"), (5, None)], "id int, url string")
    assert {r.id: r.allowed for r in records.robots_allowed(u, "url", "id", rules).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
