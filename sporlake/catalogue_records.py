"""Further queries of the catalogue: register JSON, validation, change by delivery, evaluation and run reports.

The same results by SQL are in catalogue_records_sql, which reads the tables without the JSON in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporlake.catalogue import companies, company_fields, contract_envelopes, delivered, delivery_changes
from sporlake.functions import registry_json as J
from sporlake.functions import text as X
from sporlake.functions import urls as U
from sporlake.functions.canonical import canonical_value, instant
from sporlake.operators import ranking as R
from sporlake.operators import rollups as A
from sporlake.operators import validate as V
from sporlake.plans.screen import run_screen
from sporlake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- register JSON


@query
def registry_entities(spark, sf):
    """Register entries as JSON bodies, read into records."""
    c = table(spark, sf, "companies").distinct()
    body = F.to_json(F.struct(
        F.col("organisation_number").alias("organisasjonsnummer"), F.col("name").alias("navn"), F.struct(F.col("legal_form").alias("kode")).alias("organisasjonsform"), F.col("employees").alias("antallAnsatte"), F.col("bankrupt").alias("konkurs"), F.col("liquidating").alias("underAvvikling"), F.col("website").alias("hjemmeside"),
        F.struct(F.col("industry_code").alias("kode"), F.col("industry_label").alias("beskrivelse")).alias("naeringskode1"), F.struct(F.col("municipality").alias("kommune"), F.col("municipality_number").alias("kommunenummer")).alias("forretningsadresse"), F.col("latest_submitted_accounts").alias("sisteInnsendteAarsregnskap"),
    ))
    e = c.select(J.entity(body).alias("e"))
    return e.select("e.organisation_number", "e.name", "e.legal_form", "e.employees", "e.bankrupt", "e.liquidating", "e.website", F.col("e.industry.kode").alias("industry_code"), F.col("e.business_address.kommune").alias("municipality"), "e.latest_submitted_accounts")


def _account_bodies(spark, sf) -> DataFrame:
    """One JSON body of yearly accounts a customer, made of the orders: this is how the register delivers them."""
    one = F.struct(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "KONSERN").when(F.col("o_orderstatus") == "O", "SELSKAP").alias("regnskapstype"), F.struct(F.date_format("o_orderdate", "yyyy-01-01").alias("fraDato"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tilDato")).alias("regnskapsperiode"), F.when(F.col("o_orderpriority") != "5-LOW", "nok").alias("valuta"),
        F.struct(F.struct(F.struct(F.col("o_totalprice").alias("sumDriftsinntekter")).alias("driftsinntekter"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("driftsresultat")).alias("driftsresultat"), (-F.col("o_totalprice")).alias("aarsresultat")).alias("resultatregnskapResultat"), F.struct(F.col("o_totalprice").alias("sumEiendeler")).alias("eiendeler"),
    )
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("body"))


@query
def account_records(spark, sf):
    d = _account_bodies(spark, sf).select("o_custkey", F.explode(J.account_records(F.col("body"))).alias("r"))
    return d.select("o_custkey", "r.record_id", "r.account_type", F.col("r.period.tilDato").alias("period_end"), "r.currency", "r.revenue", "r.operating_result", "r.profit_before_tax", "r.annual_result", "r.assets", "r.equity", "r.debt")


@query
def account_statements(spark, sf):
    """Statements of a company, the newest year first, its own before its group's."""
    d = _account_bodies(spark, sf).select("o_custkey", F.posexplode(J.statements(F.col("body"))).alias("place", "s"))
    return d.select("o_custkey", "place", "s.record_id", "s.account_type", "s.year", "s.months", "s.currency", "s.revenue", F.when(F.col("s.operating_result").isNull(), "NOT_FOUND").otherwise("AVAILABLE").alias("operating_status"))


@query
def account_years(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.explode(F.array(F.date_format("o_orderdate", "yyyy"), F.col("o_orderpriority"))).alias("y")).distinct()
    body = o.groupBy("o_custkey").agg(F.to_json(F.collect_list("y")).alias("body"))
    y = body.select("o_custkey", J.account_years(F.col("body"), "https://register.example/{year}.pdf").alias("y"))
    return y.select("o_custkey", F.array_join("y.years", ";").alias("years"), F.size("y.documents").alias("documents"), F.try_element_at("y.documents", F.lit(1))["url"].alias("newest"))


@query
def role_rows(spark, sf):
    """Roles out of nested groups: claims on managing directors as the register would deliver them."""
    d = table(spark, sf, "snapshot_claims").where("field_name = 'managing_director'").select("claim_id", "effective_date", "confidence", F.trim("value").alias("v"))
    name = F.struct(F.regexp_extract("v", r"^(\S*)", 1).alias("fornavn"), F.lit("").alias("mellomnavn"), F.regexp_extract("v", r"^\S+\s+(.*)$", 1).alias("etternavn"))
    role = F.struct(F.struct(F.lit("DAGL").alias("kode"), F.lit("Daglig leder").alias("beskrivelse")).alias("type"), F.struct(name.alias("navn")).alias("person"), F.when(F.col("confidence") < 0.4, True).alias("avregistrert"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("LEDE").alias("kode")).alias("type"), F.col("effective_date").alias("sistEndret"), F.array(role).alias("roller"))).alias("rollegrupper")))
    r = d.select("claim_id", F.explode(J.roles(body)).alias("r"))
    return r.select("claim_id", "r.name", "r.role_code", "r.role", "r.group_code", "r.last_changed", "r.inactive")


@query
def unit_rows(spark, sf):
    """Units of an entity: nations of a region, some with a postal address only."""
    unit = F.struct(F.format_string("9%08d", F.col("n_nationkey")).alias("organisasjonsnummer"), F.col("n_name").alias("navn"), F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.col("n_name").alias("kommune"))).alias("beliggenhetsadresse"), F.struct(F.lit("POST").alias("kommune")).alias("postadresse"), F.col("n_nationkey").cast("long").alias("antallAnsatte"))
    body = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(unit).alias("underenheter")).alias("_embedded"))).alias("body"))
    u = body.select("n_regionkey", F.explode(J.units(F.col("body"))).alias("u"))
    return u.select("n_regionkey", "u.organisation_number", "u.name", F.col("u.address.kommune").alias("town"), "u.employees")


# ---- validation


@query
def observation_reasons(spark, sf):
    """Evidence as observations: every reason against publishing one, and how often each occurs."""
    c = F.col
    kind = F.when(c("field") == "news", "public_mention").when(c("field") == "jobs", "job_posting").when(c("field") == "website", "company_profile").otherwise(c("field"))
    o = {
        "id": c("evidence_id"), "organisation_number": c("organisation_number"), "platform": c("source_type"), "signal_type": kind, "source_url": c("source_url"), "retrieved_at": c("retrieved_at"), "content_sha256": c("content_sha256"), "exact_entity": c("identity_match"), "identity_proof": c("verdict"),
        "acquisition_mode": F.when(c("source_type").isin("official_registry", "official_filing"), "official_api").when(c("source_type") == "company_owned", "permitted_public_page"), "rights_status": F.when(c("validation_status") == "accepted", "approved"), "evidence_span": c("evidence_excerpt"),
        "sentiment_label": F.when(c("field") == "news", F.when(c("confidence") > 0.7, "positive").otherwise("unclear")), "source_class": F.when(c("source_type") == "news_publisher", "public_news"), "sentiment_model_version": c("note"),
    }
    why = V.observation_reasons(o, ["official_registry", "official_filing", "company_owned", "news_publisher", "partner_wire"])
    return table(spark, sf, "evidence").select("evidence_id", F.array_join(why, ";").alias("reasons"), (F.size(why) == 0).alias("publishable"))


@query
def claim_reasons(spark, sf):
    """Claims checked against their evidence: number, name, span and hash of the content."""
    c = F.col
    e = table(spark, sf, "evidence").select("evidence_id", c("evidence_excerpt").alias("content"), c("source_type"))
    reg = companies(spark, sf).select("organisation_number", "name")
    d = table(spark, sf, "raw_claims").join(e, "evidence_id").join(reg, "organisation_number")
    cols = {n: c(n) for n in ("organisation_number", "name", "source_url", "value", "evidence_span", "content", "content_sha256")} | {"authority": c("source_authority"), "search": c("source_type") == "search_result", "registry": c("source_type") == "official_registry"}
    why = V.claim_reasons(cols)
    return d.select("claim_id", F.array_join(why, ";").alias("reasons"))


@query
def batch_checks(spark, sf):
    """Envelopes of companies, one with its module states each, against the companies of the register."""
    e = table(spark, sf, "evidence").where("organisation_number is not null").groupBy("organisation_number").agg(F.collect_set("status").alias("states"))
    return V.batch_checks(e, "organisation_number", "states", companies(spark, sf).select("organisation_number"))


@query
def envelope_counts(spark, sf):
    """What the parts of a company's envelope hold together: evidence, modules, ids and the longest span."""
    p = contract_envelopes(spark, sf).select("organisation_number", "part", F.size("evidence").alias("n"), F.size("modules").alias("m"), F.array_min(F.transform("evidence", lambda e: e["evidence_id"])).alias("lo"), F.array_max(F.transform("evidence", lambda e: F.coalesce(F.length(e["span"]), F.lit(0)))).alias("span"))
    return p.groupBy("organisation_number").agg(F.count("*").alias("parts"), F.sum("n").alias("evidence"), F.sum("m").alias("modules"), F.min("lo").alias("first_id"), F.max("span").alias("longest_span"))


@query
def manifest_count_differences(spark, sf):
    """Counts by source that an older run declares, against the rows: those of repeated evidence differ."""
    e = table(spark, sf, "evidence").select("source_type", "field", "organisation_number", "source_url", "retrieved_at")
    declared = e.distinct().groupBy("source_type", "field").agg(F.count("*").alias("n"))
    return V.count_differences(e, declared, ["source_type", "field"], "n")


# ---- deliveries, each two consecutive ones


@query
def delivery_change_counts(spark, sf):
    """Changes by step, field and kind, where other writings of a value are no change."""
    d = delivery_changes(spark, sf, True).select("version_from", "version_to", F.regexp_extract("claim_key", r"\|field:([^|]*)", 1).alias("field"), "kind")
    return d.groupBy("version_from", "version_to", "field").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")])


@query
def delivery_false_change_rate(spark, sf):
    """Share of changed texts by step that are only another writing."""
    d = delivery_changes(spark, sf).where("kind = 'MODIFIED'").select("version_from", "version_to", (canonical_value(F.col("before")) == canonical_value(F.col("after"))).alias("same"))
    return d.groupBy("version_from", "version_to").agg(F.count("*").alias("changes"), F.count_if("same").alias("false_changes"), F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"))


@query
def claim_versions(spark, sf):
    """All versions of a claim key in order, with the number of its deliveries before."""
    d = delivered(spark, sf)
    return d.select("claim_key", "version", "value", (F.row_number().over(Window.partitionBy("claim_key").orderBy("version")) - 1).alias("place"))


@query
def website_changes(spark, sf):
    """Websites that move between deliveries: to another host, to another page, or only in writing."""
    d = delivery_changes(spark, sf).where("kind = 'MODIFIED'").where(F.contains("claim_key", F.lit("|field:website")))
    a, b = F.col("before"), F.col("after")
    kind = F.when(U.host(a).isNull() | U.host(b).isNull(), "appeared_or_gone").when(U.host(a) != U.host(b), "host_changed").when(U.canonical_url(a) != U.canonical_url(b), "page_changed").otherwise("same_address")
    return d.groupBy("version_from", "version_to", kind.alias("change")).agg(F.count("*").alias("n"))


# ---- joins of runs


@query
def previous_profiles(spark, sf):
    """Companies with the last known claim of their website, if any."""
    last = R.latest_per(table(spark, sf, "claim_updates").where("field_name = 'website'").select("organisation_number", instant(F.col("retrieved_at")).alias("at"), "claim_id", "value"), ["organisation_number"], ["at", "claim_id"])
    return companies(spark, sf).select("organisation_number", "website").join(last.select("organisation_number", F.col("value").alias("previous"), "claim_id"), "organisation_number", "left")


@query
def news_merge(spark, sf):
    """At most ten search hits of a company whose address no evidence has, the best ranked first."""
    seen = table(spark, sf, "evidence").where("source_url is not null").select("organisation_number", U.host(F.col("source_url")).alias("host")).distinct()
    d = table(spark, sf, "discovery_results").where("organisation_number is not null and url is not null").select("organisation_number", "result_id", "rank", "url", U.host(F.col("url")).alias("host"))
    new = d.join(seen, ["organisation_number", "host"], "left_anti")
    place = F.row_number().over(Window.partitionBy("organisation_number").orderBy(F.col("rank").asc_nulls_last(), "result_id"))
    return new.withColumn("place", place).where("place <= 10").select("organisation_number", "result_id", "url", "place")


@query
def seeds_applied(spark, sf):
    """Websites of the register, with those of claims in place of missing ones; seeds of unknown companies are counted."""
    seed = table(spark, sf, "raw_claims").where("field_name = 'website' and trim(value) != ''").groupBy("organisation_number").agg(F.max(F.struct("source_authority", "claim_id", "value")).alias("s"))
    j = companies(spark, sf).select("organisation_number", "website").join(seed, "organisation_number", "full")
    return j.select(F.col("organisation_number"), F.coalesce(F.nullif("website", F.lit("")), F.col("s.value")).alias("site"), F.when(F.col("website").isNull(), "unknown_company").when(F.col("website") != "", "registered").when(F.col("s").isNotNull(), "seeded").otherwise("none").alias("origin"))


# ---- evaluation and reports


@query
def prediction_metrics(spark, sf):
    """One row of a classifier against gold labels: accuracy, macro F1 over the labels that occur, coverage."""
    d = table(spark, sf, "name_comparisons").select((F.lower(F.trim("source_name")) == F.lower(F.trim("target_name"))).cast("string").alias("gold"), F.col("is_acceptable_match").cast("string").alias("predicted")).where("gold is not null")
    labels = A.classifier_scores(d, "gold", "predicted", ["true", "false", "unsure"]).where("support > 0")
    macro = labels.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("labels"))
    hit = d.agg(F.count("*").alias("gold_items"), F.count("predicted").alias("predictions"), F.round(F.avg(F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False)).cast("double")), 6).alias("accuracy"))
    return hit.crossJoin(F.broadcast(macro)).withColumn("coverage", F.round(F.col("predictions") / F.col("gold_items"), 6))


@query
def field_states(spark, sf):
    """States of each module over companies, as columns, missing ones included."""
    fields = table(spark, sf, "evidence").select("field").distinct()
    n = companies(spark, sf).agg(F.count("*").alias("companies"))
    e = table(spark, sf, "evidence").where("organisation_number is not null").select("field", "status", "organisation_number").distinct()
    p = e.groupBy("field").pivot("status", ["available", "not_found", "blocked", "source_error"]).agg(F.count(F.lit(1)))
    known = e.groupBy("field").agg(F.countDistinct("organisation_number").alias("known"))
    d = fields.join(p, "field", "left").join(known, "field", "left").crossJoin(F.broadcast(n))
    return d.select("field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available", "not_found", "blocked", "source_error")], (F.col("companies") - F.coalesce("known", F.lit(0))).alias("missing"))


@query
def slowest_cases(spark, sf):
    """The five slowest events of each kind."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select("event_type", "event_id", "value", F.row_number().over(w).alias("place")).where("place <= 5")


@query
def run_report(spark, sf):
    """One row of a run: companies by profile status, evidence, and mean shares."""
    p = A.profile_status(table(spark, sf, "evidence").where("organisation_number is not null"), ["organisation_number"])
    return p.agg(F.count("*").alias("companies"), *[F.count_if(F.col("profile_status") == s).alias(s) for s in ("complete", "partial", "not_found", "unavailable", "failed")], F.sum("modules").alias("evidence"), F.round(F.avg("modules"), 3).alias("mean_modules"))


@query
def score_summary(spark, sf):
    """Mean of completeness points, counts over thresholds, and the coverage of each component."""
    c = companies(spark, sf)
    parts = {"name": 10, "employees": 5, "website": 5, "latest_submitted_accounts": 5}
    have = {k: ~V.blank(F.col(k)) for k in parts}
    points = sum((F.when(h, parts[k]).otherwise(0) for k, h in have.items()), F.lit(0))
    return c.agg(F.count("*").alias("companies"), F.round(F.avg(points), 3).alias("mean"), F.count_if(points >= 15).alias("at_15"), F.count_if(points >= 25).alias("at_25"), *[F.round(F.avg(h.cast("double")), 4).alias(f"has_{k}") for k, h in have.items()])


@query
def source_kind_shares(spark, sf):
    """Share of companies that sets of sources speak of."""
    s = table(spark, sf, "evidence").where("organisation_number is not null and status = 'available'").groupBy("organisation_number").agg(F.collect_set("source_type").alias("s"))
    sets = {"official": ["official_registry", "official_filing"], "press": ["news_publisher", "partner_wire"], "own": ["company_owned", "structured_markup"]}
    return s.agg(F.count("*").alias("companies"), *[F.round(F.avg(F.arrays_overlap("s", F.array(*map(F.lit, v))).cast("double")), 4).alias(k) for k, v in sets.items()], F.round(F.avg((F.size("s") >= 2).cast("double")), 4).alias("two_or_more"))


@query
def operation_counters(spark, sf):
    """Counters by engine and operation with rates and durations."""
    d = table(spark, sf, "events").groupBy("event_type", F.pmod("user_id", F.lit(4)).alias("engine"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("value") < 100).alias("ok"), F.round(F.avg((F.col("value") < 100).cast("double")), 6).alias("success_rate"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"), F.max("value").alias("slowest"))


@query
def screen_checks(spark, sf):
    """Screens against their expected lists, members and order, as arrays."""
    want = {"legal form AS top 5 by employees": None, "with accounts top 3 by employees": None, "companies with good glassdoor reviews": None}
    out = None
    for k, text in enumerate(want):
        got = run_screen(companies(spark, sf), text, company_fields(), "organisation_number", ["organisation_number", "employees"])
        one = got.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("employees", F.lit(-1))).alias("e"), "organisation_number"))).alias("l")).select(F.lit(k).alias("screen"), F.array_join(F.transform("l", lambda x: x["organisation_number"]), ",").alias("members"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def modules_complete(spark, sf):
    """Companies whose modules were all fetched, and how many they have."""
    want = ["registry", "financials", "roles"]
    have = F.when((F.col("status") != "not_fetched") & F.col("field").isin(*want), F.col("field"))
    e = table(spark, sf, "evidence").where("organisation_number is not null").groupBy("organisation_number").agg(F.countDistinct(have).alias("fetched"), F.countDistinct("field").alias("modules"))
    return e.select("organisation_number", "modules", "fetched", (F.col("fetched") == len(want)).alias("complete"))


@query
def labelled_share(spark, sf):
    """Documents with a judgement and companies among them, by source."""
    seen = table(spark, sf, "content_labels").select("doc_id").distinct()
    d = table(spark, sf, "documents").join(seen, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("labelled"), F.countDistinct("organisation_number").alias("companies"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents")).join(d, "source", "left").select("source", "documents", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("companies", F.lit(0)).alias("companies"), F.round(F.coalesce("labelled", F.lit(0)) / F.col("documents"), 6).alias("share"))


@query
def robots_verdicts(spark, sf):
    """Search hits that recorded robots texts forbid: the first rule of a host that fits decides."""
    from sporlake.sources.records import robots_allowed, robots_rules

    text = "User-agent: bot\nDisallow: /\n\nUser-agent: *  # all\nAllow: /kontakt/om\nDisallow: /kontakt\nDisallow:\n"
    hosts = table(spark, sf, "discovery_results").select(U.host(F.col("url")).alias("host")).where("host like 'katalog-%'").distinct()
    rules = robots_rules(hosts.withColumn("text", F.lit(text)))
    return robots_allowed(table(spark, sf, "discovery_results").where("url is not null"), "url", "result_id", rules)


@query
def enrichment_points(spark, sf):
    """Weighted parts of a score, each capped at its weight."""
    parts = {"purchase": (20.0, 10), "click": (10.0, 30), "signup": (5.0, 5)}
    n = table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in parts])
    points = {k: F.round(F.least(F.lit(1.0), F.col(k) / most) * w, 3) for k, (w, most) in parts.items()}
    return n.select("user_id", *[p.alias(f"{k}_points") for k, p in points.items()], F.round(sum(points.values(), F.lit(0.0)), 3).alias("points"))


@query
def control_iterations(spark, sf):
    """A user's score day by day as kinds of events come in, and what each day adds; days without a new kind add nothing."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("day"))
    by_day = first.groupBy("user_id", "day").agg(F.count("*").alias("new"))
    w = Window.partitionBy("user_id").orderBy("day")
    d = by_day.withColumn("score", F.least(F.lit(15), 5 * F.sum("new").over(w)).cast("int"))
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "score", (F.col("score") - F.coalesce(F.lag("score").over(w), F.lit(0))).alias("gain"))


@query
def evaluation_cases(spark, sf):
    """Cases to evaluate: recorded ones first, filled up by a seeded draw."""
    d = table(spark, sf, "discovery_results").where("organisation_number is not null").select("result_id", "organisation_number", "provider")
    r = d.withColumn("r", R.hash_rank("cases", "result_id")).orderBy(F.desc(F.col("provider") == "replay"), "r", "result_id").limit(25)
    return r.select("result_id", "organisation_number")


# ---- ranking and samples


@query
def preserved_sample(spark, sf):
    """A sample that keeps the companies of an earlier one first, filled up by hash rank, and split by position."""
    c = companies(spark, sf).where("latest_submitted_accounts = '2023' and not bankrupt and not liquidating")
    kept = table(spark, sf, "raw_claims").where("source_authority = 100").select("organisation_number").distinct().withColumn("kept", F.lit(True))
    d = c.join(kept, "organisation_number", "left").select("organisation_number", F.coalesce("kept", F.lit(False)).alias("kept"), R.hash_rank("spor", "organisation_number").alias("r"))
    s = d.orderBy(F.desc("kept"), "r", "organisation_number").limit(100).select("organisation_number", "kept")
    return R.position_split(s, "organisation_number", "spor-split").select("organisation_number", "kept", "position", "split")


@query
def filer_strata(spark, sf):
    """Strata of filing companies: form, size, industry division and county."""
    c = companies(spark, sf).where("latest_submitted_accounts != ''")
    band = F.when(F.col("employees").isNull(), "missing").when(F.col("employees") < 5, "0-4").when(F.col("employees") < 50, "5-49").otherwise("50+")
    s = F.concat_ws("|", "legal_form", band, F.substring_index("industry_code", ".", 1), F.substring("municipality_number", 1, 2))
    return c.groupBy(s.alias("stratum")).agg(F.count("*").alias("companies"))


@query
def role_budget(spark, sf):
    """The first 150 companies to look up: those with a site, active, then by employees."""
    site, active = (F.col("website") != "").cast("int"), (~(F.col("bankrupt") | F.col("liquidating"))).cast("int")
    return companies(spark, sf).select("organisation_number", site.alias("site"), active.alias("active"), F.coalesce("employees", F.lit(0)).alias("employees")).orderBy(F.desc("site"), F.desc("active"), F.desc("employees"), "organisation_number").limit(150)


@query
def external_footprint(spark, sf):
    """Search hits once an address, accepted or rejected with a reason, counted by kind."""
    d = table(spark, sf, "discovery_results").where("organisation_number is not null").withColumn("key", U.canonical_url(F.col("url"))).where("key is not null")
    d = R.first_per(d, ["organisation_number", "key"], [F.col("rank").asc_nulls_last(), F.col("result_id")])
    own = companies(spark, sf).select("organisation_number", U.host(F.col("website")).alias("own"))
    j = d.join(own, "organisation_number", "left").withColumn("host", U.host(F.col("url")))
    kind = F.when(F.col("host") == F.col("own"), "own_site").when(F.col("host").rlike(r"^katalog"), "directory").otherwise("other")
    why = F.when(V.blank(F.col("title")), "no_title").when(F.col("rank") > 8, "low_rank")
    return j.groupBy(kind.alias("kind"), F.coalesce(why, F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


# ---- text


@query
def search_queries(spark, sf):
    """What to search for a company: its name with town, its name with number, its name without legal form."""
    n = X.collapse(F.col("name"))
    q = F.array_distinct(F.array(F.concat_ws(" ", n, "municipality"), F.concat_ws(" ", n, "organisation_number"), X.without_legal_form(n)))
    return companies(spark, sf).select("organisation_number", F.posexplode(q).alias("place", "query"))


@query
def candidate_domains(spark, sf):
    """Hosts a company may have, by its name joined, with hyphens and by its first word."""
    w = F.filter(F.split(X.folded_name(X.without_legal_form(F.col("name"))), " "), lambda x: ~x.isin("og", "and", ""))
    names = F.array_distinct(F.array(F.array_join(w, ""), F.array_join(w, "-"), F.try_element_at(w, F.lit(1))))
    d = companies(spark, sf).select("organisation_number", F.explode(names).alias("n")).where("length(n) >= 3")
    return d.select("organisation_number", F.concat("n", F.lit(".no")).alias("domain"))


@query
def snapshot_hashes(spark, sf):
    """Whether claims and the evidence they name have the same content hash."""
    e = table(spark, sf, "evidence").select("evidence_id", F.lower("content_sha256").alias("h"))
    d = table(spark, sf, "raw_claims").where("evidence_id is not null").join(e, "evidence_id", "left")
    s = F.when(F.col("content_sha256").isNull(), "claim_has_none").when(F.col("h").isNull(), "evidence_has_none").when(F.col("h") == F.lower("content_sha256"), "same").otherwise("differs")
    return d.groupBy(s.alias("result")).agg(F.count("*").alias("n"))


@query
def failure_classes(spark, sf):
    """Kinds of failure by what a note says."""
    n = F.lower(F.coalesce("note", F.lit("")))
    kind = F.when(n.rlike("budget|exhausted"), "BUDGET").when(n.rlike("timeout|timed out"), "TIMEOUT").when(n.rlike("rate limit|429"), "RATE_LIMIT").when(n.rlike("unauthorized|forbidden|auth"), "AUTH").when(n.rlike("not found|404"), "NOT_FOUND").when(n.rlike("parse|malformed|syntax"), "PARSE").when(n.rlike("network|connection|no answer|dns"), "NETWORK").otherwise("UNKNOWN")
    return table(spark, sf, "evidence").where("status != 'available'").groupBy("status", kind.alias("failure")).agg(F.count("*").alias("n"))
