"""Catalogue of queries over the operators, each over whole tables. The same results by SQL are in catalogue_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sporlake.functions import keys as K
from sporlake.functions import numbers as N
from sporlake.functions import text as X
from sporlake.functions import urls as U
from sporlake.functions.canonical import canonical_value, flexible_day, instant
from sporlake.operators import compare as C
from sporlake.operators import ranking as R
from sporlake.operators import rollups as A
from sporlake.plans.screen import Criterion, compiled, parse_screen, run_screen
from sporlake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = "spor"
AS_OF = "2025-06-01T00:00:00Z"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """One delivered row a company: the register holds repeated rows whose names differ in case, of which the smallest is taken."""
    cols = ("name", "legal_form", "employees", "bankrupt", "liquidating", "municipality", "municipality_number", "industry_code", "industry_label", "website", "latest_submitted_accounts")
    return table(spark, sf, "companies").groupBy("organisation_number").agg(F.min(F.struct(*cols)).alias("c")).select("organisation_number", "c.*")


def customer_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their nation as municipality and the price of their latest order as revenue."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("l"), F.count("*").alias("orders"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal", F.coalesce("orders", F.lit(0)).alias("orders"), F.col("l.o_totalprice").alias("revenue"))


# ---- screening


@query
def screen_filter_topk(spark, sf):
    fields = {"municipality": F.col("n_name"), "revenue": F.col("revenue"), "employees": F.col("orders")}
    return run_screen(customer_profiles(spark, sf), "companies in NATION_7 with at least 2 employees and revenue over 0.05 million top 50 by revenue", fields, "c_custkey", ["c_custkey", "c_name", "n_name", "orders", "revenue"])




def company_fields() -> dict:
    return {
        "municipality": F.col("municipality"), "legal_form": F.col("legal_form"), "employees": F.col("employees"), "website": F.col("website") != "", "accounts": F.coalesce(F.col("latest_submitted_accounts"), F.lit("")) != "",
        "industry": F.concat_ws(" ", "industry_code", "industry_label"),
    }


@query
def screen_companies(spark, sf):
    return run_screen(companies(spark, sf), 'legal form AS with at least 2 employees and with a website, industry contains "elektro"', company_fields(), "organisation_number", ["organisation_number", "name", "municipality", "employees"])


@query
def screen_plans(spark, sf):
    """What the language makes of a list of texts; a text with a refused term has no executable plan. The SQL gives the plans by hand."""
    texts = ["companies in Oslo with more than 10 employees", "profitable companies with revenue over NOK 2 million", "unprofitable companies with accounts", "top 500 by employees", "companies with good glassdoor reviews", "hello"]
    rows = []
    for k, t in enumerate(texts):
        p = parse_screen(t)
        rows.append((k, p.executable, len(p.criteria), ";".join(f"{c.field} {c.operator} {c.value}" for c in p.criteria), p.order_by, p.limit, p.asked, ";".join(p.modules), ";".join(p.refused)))
    return spark.createDataFrame(rows, "position int, executable boolean, criteria int, plan string, order_by string, top int, asked int, modules string, refused string")


@query
def screen_contains_casefold(spark, sf):
    c = Criterion("name", "contains", "WIDGET", "registry")
    return table(spark, sf, "part").where(compiled(c, {"name": F.col("p_name")})).select("p_partkey", "p_name", "p_brand")


@query
def search_companies(spark, sf):
    """Substring search over four columns, a page of results with the number of all."""
    q = "regnskap"
    hit = A.all_of([]) & F.exists(F.array("organisation_number", "name", "municipality", "industry_label"), lambda c: F.contains(F.lower(c), F.lit(q)))
    found = companies(spark, sf).where(hit)
    total = found.agg(F.count("*").alias("total"))
    return R.page(found.select("organisation_number", "name"), [F.col("organisation_number")], 25, 0).crossJoin(F.broadcast(total))


# ---- sources and lookups


@query
def bulk_lookup_left_fill(spark, sf):
    """Searched companies with their register rows, missing ones filled."""
    wanted = table(spark, sf, "discovery_results").select("organisation_number").where("organisation_number is not null").distinct()
    reg = companies(spark, sf).select("organisation_number", "name", "employees", F.lit(True).alias("found"))
    return wanted.join(reg, "organisation_number", "left").select("organisation_number", F.coalesce("name", F.lit("")).alias("name"), "employees", F.coalesce("found", F.lit(False)).alias("found"))


@query
def key_list_scan(spark, sf):
    """Keys however written: digits of valid ones with their writings and rows."""
    d = table(spark, sf, "raw_claims").select(K.org_digits(F.col("organisation_number")).alias("org"), "organisation_number")
    return d.where("org is not null").groupBy("org").agg(F.countDistinct("organisation_number").alias("writings"), F.count("*").alias("rows"))


@query
def mod11_check(spark, sf):
    d = table(spark, sf, "companies").select("organisation_number").distinct()
    return d.select("organisation_number", K.check_digit(F.substring("organisation_number", 1, 8)).alias("check_digit"), K.has_valid_check(F.col("organisation_number")).alias("valid"))


@query
def key_comparison(spark, sf):
    d = table(spark, sf, "raw_claims").select(F.regexp_extract(F.lower("claim_key"), r"org:([^|]*)", 1).alias("k"), "organisation_number")
    return d.select(K.compare_keys(F.col("k"), F.col("organisation_number")).alias("result")).groupBy("result").agg(F.count("*").alias("n"))


@query
def stable_claim_keys(spark, sf):
    d = table(spark, sf, "snapshot_claims").select("organisation_number", "field_name", F.regexp_extract("claim_key", r"\|entity:(.*)$", 1).alias("e"), "claim_key")
    made = K.claim_key(F.col("organisation_number"), F.col("field_name"), F.col("e"))
    return d.groupBy("field_name").agg(F.count_if(made == F.col("claim_key")).alias("same"), F.count("*").alias("n"))


# ---- changes between snapshots


def delivered(spark, sf) -> DataFrame:
    """The last retrieved row of each claim key and delivery."""
    d = table(spark, sf, "snapshot_claims").select("claim_key", "version", "source_module", "field_name", "reporting_period", "organisation_number", "value", instant(F.col("retrieved_at")).alias("at"), "claim_id")
    return R.latest_per(d, ["claim_key", "version"], ["at", "claim_id"])


def _steps(d: DataFrame) -> DataFrame:
    """version_from, version_to: consecutive deliveries (a row a delivery)."""
    v = d.select("version").distinct()
    return v.select(F.col("version").alias("version_from"), F.lead("version").over(Window.orderBy("version")).alias("version_to")).where("version_to is not null")


def delivery_changes(spark, sf, semantic: bool = False) -> DataFrame:
    """Changes of every step as rows of (version_from, version_to, claim_key): the key says which delivery comes next."""
    d = delivered(spark, sf).withColumn("value", canonical_value(F.col("value")) if semantic else F.col("value"))
    s = F.broadcast(_steps(d))
    keys = ["version_from", "version_to", "claim_key"]
    before = d.join(s, F.col("version") == F.col("version_from")).select(*keys, "field_name", "value")
    after = d.join(s, F.col("version") == F.col("version_to")).select(*keys, "field_name", "value")
    return C.keyed_changes(before, after, keys, "value")


@query
def snapshot_diff_claims(spark, sf):
    """Exact text comparison of every two consecutive deliveries; identical values are no change."""
    return delivery_changes(spark, sf).where("kind != 'UNCHANGED'")


@query
def snapshot_diff_summary(spark, sf):
    d = delivery_changes(spark, sf)
    field = F.regexp_extract("claim_key", r"\|field:([^|]*)", 1).alias("field")
    return d.select("version_from", "version_to", field, "kind").groupBy("version_from", "version_to", "field").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")])


@query
def snapshot_membership(spark, sf):
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return delivery_changes(spark, sf).groupBy("version_from", "version_to").agg(n("REMOVED").alias("only_before"), n("ADDED").alias("only_after"), n("MODIFIED", "UNCHANGED").alias("in_both"))


@query
def key_set_operations(spark, sf):
    a = table(spark, sf, "orders").where("o_orderdate < '1997-01-01'").select("o_custkey")
    b = table(spark, sf, "orders").where("o_orderdate >= '1997-01-01'").select("o_custkey")
    parts = [("both", a.intersect(b)), ("early_only", a.subtract(b)), ("late_only", b.subtract(a)), ("either", a.union(b).distinct())]
    out = None
    for name, d in parts:
        one = d.agg(F.lit(name).alias("part"), F.count("*").alias("customers"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def failclosed_merge(spark, sf):
    """Each delivery with the rows of the one before for modules that failed."""
    d = delivered(spark, sf).select("claim_key", "version", "source_module", "value")
    s = F.broadcast(_steps(d))
    prev, new = (d.join(s, F.col("version") == F.col(c)).select("version_to", "claim_key", "source_module", "value") for c in ("version_from", "version_to"))
    failed = spark.createDataFrame([("financials",), ("roles",)], "source_module string")
    return C.fail_closed_merge(prev, new, failed, ["version_to", "claim_key"], "source_module").select("version_to", "claim_key", "source_module", "value", "origin")


@query
def field_changes_by_year(spark, sf):
    """Fields of a customer's years 1997 and 1998 that differ."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderpriority", "o_totalprice")

    def of(y: int) -> DataFrame:
        return o.where(F.col("y") == y).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("status"), F.min("o_orderpriority").alias("priority"), F.max("o_totalprice").cast("decimal(12,2)").alias("largest"))

    return C.field_changes(of(1997), of(1998), ["o_custkey"], ["orders", "status", "priority", "largest"])


@query
def workforce_materiality(spark, sf):
    d = delivery_changes(spark, sf).where("kind in ('MODIFIED', 'UNCHANGED')").where(F.col("claim_key").rlike(r"\|field:employees(\||$)"))
    j = d.select("version_from", "version_to", "claim_key", N.number(F.col("before")).alias("before"), N.number(F.col("after")).alias("after"))
    m = C.materiality(F.col("before"), F.col("after"))
    return j.select("version_from", "version_to", "claim_key", "before", "after", *[c.alias(n) for n, c in m.items()])


@query
def period_restatement(spark, sf):
    """Reported amounts by period in consecutive deliveries: new periods, and restatements of old ones."""
    d = table(spark, sf, "snapshot_claims").where("field_name in ('revenue', 'total_assets') and reporting_period is not null").select("version", "organisation_number", "field_name", "reporting_period", "claim_id", N.amount(F.col("value"))["value"].alias("amount"))
    keys = ["organisation_number", "field_name", "reporting_period"]
    d = R.latest_per(d, ["version", *keys], ["claim_id"])
    s = F.broadcast(_steps(table(spark, sf, "snapshot_claims").select("version")))
    a, b = (d.join(s, F.col("version") == F.col(c)).select("version_from", "version_to", *keys, "amount") for c in ("version_from", "version_to"))
    j = C.keyed_changes(a, b, ["version_from", "version_to", *keys], "amount").where("kind != 'UNCHANGED'")
    return j.select("version_from", "version_to", *keys, F.col("before"), F.col("after"), F.when(F.col("kind") == "ADDED", "NEW_PERIOD").when(F.col("kind") == "REMOVED", "PERIOD_GONE").otherwise("RESTATED").alias("change"))


def _tidy(c):
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\u00A0]", "")


@query
def change_set_scores(spark, sf):
    """Changes of the exact comparison against those that also differ without case and blanks."""
    d = delivery_changes(spark, sf).where("kind = 'MODIFIED'")
    return C.set_scores(d.where(_tidy(F.col("before")) != _tidy(F.col("after"))), d, ["version_from", "version_to", "claim_key"])


@query
def false_change_rate(spark, sf):
    """Share of changed texts by field that are only another writing."""
    d = delivery_changes(spark, sf).where("kind = 'MODIFIED'")
    d = d.select(F.regexp_extract("claim_key", r"\|field:([^|]*)", 1).alias("field"), (_tidy(F.col("before")) == _tidy(F.col("after"))).alias("same"))
    return d.groupBy("field").agg(F.count("*").alias("changes"), F.count_if("same").alias("false_changes"), F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"))


# ---- choosing rows


@query
def latest_record_per_key(spark, sf):
    d = table(spark, sf, "claim_updates").select("claim_key", instant(F.col("retrieved_at")).alias("at"), "claim_id", "value")
    return R.latest_per(d, ["claim_key"], ["at", "claim_id"])


@query
def version_history(spark, sf):
    d = table(spark, sf, "snapshot_claims")
    return d.groupBy("claim_key").agg(F.countDistinct("version").alias("versions"), F.min("version").alias("first"), F.max("version").alias("last"), F.count("*").alias("rows"))


@query
def hash_rank_sample(spark, sf):
    return R.hash_sample(companies(spark, sf), "organisation_number", 200, SEED).select("organisation_number", "sample_rank")


@query
def extension_sample(spark, sf):
    c = companies(spark, sf)
    first = table(spark, sf, "name_comparisons").join(c.select(F.lower("name").alias("n"), "organisation_number"), F.lower("target_name") == F.col("n")).select("organisation_number")
    return R.hash_sample(c, "organisation_number", 100, SEED, exclude=first).select("organisation_number", "sample_rank")


def _stratum():
    form = F.when(F.col("legal_form").isin("AS", "ASA", "ENK"), F.col("legal_form")).otherwise("OTHER")
    e = F.col("employees")
    band = F.when(e.isNull(), "missing").when(e == 0, "0").when(e < 5, "1-4").when(e < 20, "5-19").when(e < 100, "20-99").otherwise("100+")
    return F.concat_ws("|", form, band, F.when(F.col("bankrupt") | F.col("liquidating"), "adverse").otherwise("active"), F.when(F.col("website") != "", "web").otherwise("no-web"))


@query
def stratum_counts(spark, sf):
    return companies(spark, sf).select(_stratum().alias("stratum")).groupBy("stratum").agg(F.count("*").alias("companies"))


@query
def stratified_sample(spark, sf):
    return R.stratified_sample(companies(spark, sf), _stratum(), "organisation_number", 5, SEED).select("stratum", "position", "organisation_number")


@query
def sample_split(spark, sf):
    s = R.hash_sample(companies(spark, sf), "organisation_number", 500, SEED).drop("sample_rank")
    return R.position_split(s, "organisation_number", SEED + "-split").select("organisation_number", "position", "split")


@query
def hash_split(spark, sf):
    return R.hash_split(companies(spark, sf), "organisation_number", SEED, {"development": 0.6, "validation": 0.2, "test": 0.2}).groupBy("split").agg(F.count("*").alias("companies"))


@query
def dedup_first_per_host(spark, sf):
    return R.first_per_host(companies(spark, sf), U.host(F.col("website")), "organisation_number", 300, SEED).select("organisation_number", "host", "sample_rank")


@query
def event_dedup_first_wins(spark, sf):
    d = table(spark, sf, "discovery_results").where("url is not null")
    return R.first_per(d, ["organisation_number", "url"], [F.col("rank").asc_nulls_last(), F.col("result_id")]).select("organisation_number", "url", "rank", "result_id")


@query
def top_hosts(spark, sf):
    h = table(spark, sf, "discovery_results").select(U.host(F.col("url")).alias("host")).where("host is not null")
    return h.groupBy("host").agg(F.count("*").alias("results")).orderBy(F.desc("results"), "host").limit(20)


@query
def channel_ranking(spark, sf):
    """The most frequent host of each searched company."""
    h = table(spark, sf, "discovery_results").select("organisation_number", U.host(F.col("url")).alias("host")).where("host is not null and organisation_number is not null")
    return R.first_per(h.groupBy("organisation_number", "host").agg(F.count("*").alias("n")), ["organisation_number"], [F.desc("n"), F.col("host")])


# ---- candidates


def _candidates(spark, sf) -> DataFrame:
    c = companies(spark, sf).select("organisation_number", "name", "municipality")
    r = table(spark, sf, "discovery_results").select("result_id", "organisation_number", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("rank", F.lit(10000)).alias("rank"))
    j = r.join(c, "organisation_number")
    nt, tt = X.tokens(F.col("name")), X.tokens(F.col("title"))
    both = F.array_union(tt, X.tokens(F.col("snippet")))
    in_title = F.size(F.array_except(nt, tt)) == 0
    anywhere = F.size(F.array_except(nt, both)) == 0
    in_host = F.contains(F.regexp_replace(U.host(F.col("url")), "[^a-z0-9]", ""), F.regexp_replace(X.folded_name(X.without_legal_form(F.col("name"))), " ", ""))
    town = F.size(F.array_except(X.tokens(F.col("municipality")), X.tokens(F.col("snippet")))) == 0
    has_org = F.contains(F.concat("title", "snippet"), F.col("organisation_number"))
    # Weights are fixed values, in hundredths, so that sums are exact.
    score = F.least(F.lit(100), F.when(has_org, 75).otherwise(0) + F.when(in_title, 45).when(anywhere, 25).otherwise(0) + F.when(F.coalesce(in_host, F.lit(False)), 30).otherwise(0) + F.when(town, 10).otherwise(0))
    return j.select("result_id", "organisation_number", "url", "rank", score.alias("score"))


@query
def candidate_scores(spark, sf):
    return _candidates(spark, sf).select("result_id", "organisation_number", "score")


@query
def best_candidate(spark, sf):
    d = _candidates(spark, sf).where("score >= 10")
    return R.first_per(d, ["organisation_number"], [F.desc("score"), F.col("rank"), F.col("url"), F.col("result_id")]).select("organisation_number", "result_id", "score")


@query
def best_candidate_or_abstain(spark, sf):
    return R.best_or_none(_candidates(spark, sf), ["organisation_number"], "score").select("organisation_number", "result_id", "score")


@query
def token_overlap_match(spark, sf):
    """Typed names all of whose tokens are in the target name or the other way round."""
    d = table(spark, sf, "name_comparisons").where("source_name is not null").select("comparison_id", X.tokens(F.col("target_name")).alias("t"), X.tokens(F.col("source_name")).alias("s"))
    common = F.size(F.array_intersect("t", "s"))
    kind = F.when((common == F.size("t")) & (common == F.size("s")), "same").when(common == F.size("s"), "subset").when(common == F.size("t"), "superset").when(common > 0, "partial").otherwise("none")
    return d.select("comparison_id", common.alias("common"), kind.alias("kind"))


@query
def name_match_ladder(spark, sf):
    d = table(spark, sf, "name_comparisons")
    a, b = X.collapse(F.col("target_name")), X.collapse(F.coalesce("source_name", F.lit("")))
    fa, fb = X.folded_name(X.without_legal_form(a)), X.folded_name(X.without_legal_form(b))
    la, lb = X.legal_form(a), X.legal_form(b)
    k = F.when(a == b, "exact").when(fb == "", "empty").when((fa == fb) & (la.eqNullSafe(lb)), "normalized").when((fa == fb) & (la.isNull() | lb.isNull()), "form_omitted").when(fa == fb, "form_differs").otherwise("different")
    return d.select(k.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query
def domain_suffix_join(spark, sf):
    """Search hits on a company's own host or one below it: hosts expand to their suffixes for an equi-join."""
    site = companies(spark, sf).select("organisation_number", U.host(F.col("website")).alias("own")).where("own is not null")
    hits = table(spark, sf, "discovery_results").select("result_id", "organisation_number", F.explode(U.host_suffixes(U.host(F.col("url")))).alias("own"))
    return hits.join(site, ["organisation_number", "own"]).select("result_id", "organisation_number", "own").distinct()


# ---- rollups


@query
def conflict_resolution(spark, sf):
    d = table(spark, sf, "raw_claims")
    keyed = d.select(K.org_digits(F.col("organisation_number")).alias("org"), F.lower("field_name").alias("field"), "value", "source_authority").where("org is not null")
    return A.resolve_conflicts(keyed, ["org", "field"], F.col("value"), F.col("source_authority"))


@query
def leadership_best_row(spark, sf):
    """The row of highest authority of each leader of a company."""
    d = table(spark, sf, "snapshot_claims").where("field_name = 'managing_director' and trim(value) != ''").select("organisation_number", F.lower(X.collapse(F.col("value"))).alias("person"), F.coalesce("source_authority", F.lit(-1)).alias("authority"), (-F.col("claim_id")).alias("neg"))
    return R.latest_per(d, ["organisation_number", "person"], ["authority", "neg"]).select("organisation_number", "person", "authority", (-F.col("neg")).alias("claim_id"))


@query
def profile_status(spark, sf):
    return A.profile_status(table(spark, sf, "evidence").where("organisation_number is not null"), ["organisation_number"])


@query
def module_terminal_counts(spark, sf):
    d = table(spark, sf, "evidence")
    return d.groupBy("field", "status").agg(F.count("*").alias("n"), F.countDistinct("organisation_number").alias("companies"))


@query
def coverage_by_category(spark, sf):
    c = companies(spark, sf).withColumn("industry_code", F.when(F.col("industry_code") != "00.000", F.col("industry_code")))
    fields = {"name": "identity", "legal_form": "identity", "municipality": "place", "municipality_number": "place", "industry_code": "industry", "industry_label": "industry", "employees": "size", "website": "web", "latest_submitted_accounts": "accounts"}
    return A.coverage(A.presence(c, "organisation_number", fields), "organisation_number")


@query
def category_availability(spark, sf):
    c = companies(spark, sf)
    fields = {"employees": "size", "website": "web", "industry_code": "industry", "latest_submitted_accounts": "accounts"}
    return A.presence(c, "organisation_number", fields).groupBy("category").agg(F.count_if("found").alias("found"), F.round(F.avg(F.col("found").cast("double")) * 100, 2).alias("percent"))


@query
def dashboard_top_municipalities(spark, sf):
    return companies(spark, sf).groupBy("municipality").agg(F.count("*").alias("companies"), F.count_if(F.col("website") != "").alias("with_website")).orderBy(F.desc("companies"), "municipality").limit(10)


@query
def missing_seed_antijoin(spark, sf):
    """Companies with a website of which no page was read: error rows."""
    seen = table(spark, sf, "evidence").where("field = 'website' and status = 'available'").select("organisation_number")
    return companies(spark, sf).where("website != ''").join(seen, "organisation_number", "left_anti").select("organisation_number", "website", F.lit("missing_event").alias("error"))


@query
def latency_quantiles(spark, sf):
    return A.quantiles(table(spark, sf, "events"), ["event_type"], "value")


@query
def index_quantile_rules(spark, sf):
    rules = N.rank_rules(F.col("n"), 0.95)
    return A.ranked_values(table(spark, sf, "events"), ["event_type"], "value", {"p95_floor": rules["floor_inner"], "p95_index": rules["half_up"]})


@query
def domain_request_summary(spark, sf):
    h = table(spark, sf, "evidence").select(U.host(F.col("source_url")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("requests"))
    return h.agg(F.count("*").alias("hosts"), F.sum("requests").alias("requests"), F.expr("percentile_disc(0.5) within group (order by requests)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by requests)").alias("p95"), F.max("requests").alias("most"))


@query
def request_grouping_sets(spark, sf):
    table(spark, sf, "evidence").select("source_type", "status").createOrReplaceTempView("_requests")
    return spark.sql("select source_type, status, count(*) as n from _requests group by grouping sets ((source_type), (status), ())")


@query
def duplicate_requests(spark, sf):
    same = table(spark, sf, "evidence").where("source_url is not null").groupBy("organisation_number", "source_url", "field").agg((F.count("*") - 1).alias("more"))
    return same.where("more > 0").groupBy("field").agg(F.sum("more").alias("duplicates"))


@query
def failure_rates(spark, sf):
    s = F.col("status")
    return table(spark, sf, "evidence").groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.avg(s.isin("blocked", "source_error").cast("double")), 4).alias("failed"), F.round(F.avg((s == "available").cast("double")), 4).alias("available"))


@query
def running_budget(spark, sf):
    d = A.running_budget(table(spark, sf, "events"), ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], F.col("value").cast("decimal(12,2)"), 500)
    return d.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


@query
def reduced_mode_latch(spark, sf):
    d = A.latched(table(spark, sf, "events"), ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], (F.col("event_type") == "error") & (F.col("value") > 100), "reduced")
    return d.groupBy("user_id").agg(F.count_if("reduced").alias("reduced"), F.count("*").alias("n"))


@query
def score_deltas(spark, sf):
    """Steps on which a user's running best rose, and the best: a step rises if no earlier one was as high."""
    order = [F.col("ts"), F.col("event_id")]
    d = A.running_best(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], F.to_date("ts"), order, F.col("value"), "best")
    first = d.groupBy("user_id", "best").agg(F.min(F.struct("ts", "event_id")).alias("f")).where("best > 0")
    return first.groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.max("best"), 2).alias("best"))


def _strategies(spark, sf) -> DataFrame:
    v = F.col("value").cast("decimal(12,2)")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(v < 20).alias("successes"), F.sum(v).alias("cost"), F.countDistinct("user_id").alias("profiles"))


@query
def strategy_metrics(spark, sf):
    s = _strategies(spark, sf)
    return s.select("event_type", "attempts", "successes", "cost", "profiles", F.round(F.col("successes") / F.col("attempts"), 6).alias("success_rate"), F.round(F.col("cost").cast("double") / F.col("attempts"), 4).alias("cost_each"))


@query
def strategy_promotion(spark, sf):
    """Each pair of a baseline and a challenger with the gates that fail."""
    s = _strategies(spark, sf).select("event_type", F.round(F.col("successes") / F.col("attempts"), 6).alias("rate"), F.col("cost").cast("double").alias("cost"))
    b = s.select(F.col("event_type").alias("baseline"), F.col("rate").alias("br"), F.col("cost").alias("bc"))
    # A handful of strategies, one row each: the pairs are the result.
    j = b.join(s, F.col("baseline") != F.col("event_type"))
    why = A.reasons(lower_success=F.col("rate") < F.col("br"), higher_cost=F.col("cost") > F.col("bc") * 1.1)
    return j.select("baseline", F.col("event_type").alias("challenger"), F.array_join(why, ";").alias("failed_gates"), (F.size(why) == 0).alias("promoted"))


@query
def ucb_strategy_order(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    total = s.agg(F.sum("n").alias("total"))
    d = s.crossJoin(F.broadcast(total)).withColumn("priority", F.round(F.col("m") + 0.35 * F.sqrt(F.log(F.col("total") + 1) / (F.col("n") + 1)), 4))
    return d.select("event_type", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "event_type")).alias("position"))


@query
def footprint_rollup(spark, sf):
    """Signals of a user: kinds, fresh ones, distinct values, engagement, and a score behind a gate of enough of them."""
    e = F.col("event_type")
    fresh = (F.lit("2024-01-31").cast("timestamp") >= F.col("ts")) & (F.timestamp_diff("DAY", F.col("ts"), F.lit("2024-01-31").cast("timestamp")) < 15)
    d = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("signals"), F.countDistinct("event_type").alias("kinds"), F.count_if(fresh).alias("fresh"), F.sum(F.when(e.isin("click", "view"), F.col("value").cast("decimal(12,2)"))).alias("engagement"), F.count_if(e == "purchase").alias("good"), F.count_if(e == "error").alias("bad"),
    )
    gate = (F.col("good") + F.col("bad") >= 10) & (F.col("kinds") >= 2)
    return d.withColumn("score", F.when(gate, F.round(50 + 50.0 * (F.col("good") - F.col("bad")) / (F.col("good") + F.col("bad")), 1)))


@query
def label_vote(spark, sf):
    """A label of each document's judgements: abstain below two judges, mixed if they differ."""
    d = table(spark, sf, "content_labels").groupBy("doc_id").agg(F.countDistinct("labelled_by").alias("judges"), F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    return d.select("doc_id", F.when(F.col("judges") < 2, "abstain").when(F.col("lo") != F.col("hi"), "mixed").when(F.col("hi") == 1, "toxic").otherwise("clean").alias("label"))


@query
def classifier_scores(spark, sf):
    d = table(spark, sf, "name_comparisons").select((F.lower(F.trim("source_name")) == F.lower(F.trim("target_name"))).cast("string").alias("gold"), F.col("is_acceptable_match").cast("string").alias("predicted"))
    return A.classifier_scores(d, "gold", "predicted", ["true", "false"])


@query
def score_histogram(spark, sf):
    return _candidates(spark, sf).groupBy("score").agg(F.count("*").alias("n"))


@query
def completeness_score(spark, sf):
    """Weighted points of what is known of a company, capped."""
    p = lambda c, w: F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", w).otherwise(0)
    ev = table(spark, sf, "evidence").where("status = 'available' and organisation_number is not null").groupBy("organisation_number").agg(F.countDistinct("field").alias("modules"))
    d = companies(spark, sf).join(ev, "organisation_number", "left")
    points = p("name", 10) + p("employees", 5) + p("website", 5) + p("latest_submitted_accounts", 5) + F.least(F.lit(30), 5 * F.coalesce("modules", F.lit(0)))
    return d.select("organisation_number", points.alias("points"))


# ---- validation, keys and envelopes


@query
def validation_reasons(spark, sf):
    e = lambda c: F.col(c)
    why = A.reasons(
        no_organisation=e("organisation_number").isNull(), no_url=~U.is_public(e("source_url")), unknown_class=e("source_class").isNull(), no_hash=(e("status") == "available") & e("content_sha256").isNull(), bad_hash=~e("content_sha256").rlike("^[0-9a-f]{64}$"), low_confidence=e("confidence") < 0.35, rejected=e("validation_status") == "rejected",
    )
    return table(spark, sf, "evidence").select("evidence_id", F.array_join(why, ";").alias("reasons"), (F.size(why) == 0).alias("accepted"))


@query
def provenance_claim_ids(spark, sf):
    d = table(spark, sf, "evidence")
    return d.select("evidence_id", K.short_hash(F.col("organisation_number"), F.col("field"), F.col("source_url"), F.col("content_sha256")).alias("claim_hash"))


@query
def source_policy_join(spark, sf):
    e = table(spark, sf, "evidence").select(F.regexp_replace(F.lower("source_class"), "[^a-z]", "").alias("k"), "confidence")
    p = table(spark, sf, "source_catalog").select(F.regexp_replace(F.lower("source_class"), "[^a-z]", "").alias("k"), "source_class", "source_authority")
    tier = F.when(F.col("source_authority") >= 90, "official").when(F.col("source_authority") >= 60, "first_party").when(F.col("source_authority").isNotNull(), "third_party").otherwise("unknown")
    return e.join(p, "k", "left").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("decimal(6,3)").cast("double")), 3).alias("confidence"))


@query
def freshness_window(spark, sf):
    d = table(spark, sf, "raw_claims").select(((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - instant(F.col("retrieved_at"))) / 86_400_000_000).alias("age"))
    band = F.when(F.col("age").isNull(), "unknown").when(F.col("age") < 0, "future").when(F.col("age") <= 45, "fresh").when(F.col("age") <= 365, "aging").otherwise("stale")
    return d.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query
def cache_hit_split(spark, sf):
    """Evidence keys answered by an earlier run, and those still to do."""
    want = table(spark, sf, "evidence").select("organisation_number", "field").where("organisation_number is not null").distinct()
    cache = table(spark, sf, "evidence").where("status = 'available' and organisation_number is not null").select("organisation_number", "field").distinct().withColumn("hit", F.lit(True))
    return want.join(cache, ["organisation_number", "field"], "left").groupBy("field").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("pending"))


@query
def cache_keys(spark, sf):
    return companies(spark, sf).select("organisation_number", K.short_hash(F.col("organisation_number"), F.lit("registry"), F.lit("1"), prefix="cache-").alias("cache_key"))


@query
def recommended_tasks(spark, sf):
    c = companies(spark, sf)
    task = lambda cond, kind, p: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("priority")))
    todo = F.array_compact(F.array(task(F.col("website") == "", "find_website", 1), task(F.col("employees").isNull(), "find_employees", 2), task(F.coalesce("latest_submitted_accounts", F.lit("")) == "", "find_accounts", 3)))
    d = c.select("organisation_number", F.explode(todo).alias("t")).select("organisation_number", "t.kind", "t.priority")
    return d.withColumn("task_id", K.short_hash(F.col("organisation_number"), F.col("kind")))


@query
def claim_fingerprints(spark, sf):
    return A.fingerprint(table(spark, sf, "snapshot_claims"), ["version"], ["claim_key", "value", "retrieved_at"])


@query
def contract_envelopes(spark, sf):
    """Nested records of a company's evidence, of about a thousand each: a large company has several parts."""
    e = table(spark, sf, "evidence").where("organisation_number is not null")
    parts = e.groupBy("organisation_number").agg(F.ceil(F.count("*") / 1000).cast("int").alias("parts"))
    c = e.join(parts, "organisation_number").select("organisation_number", F.pmod(F.xxhash64("evidence_id"), F.col("parts")).cast("int").alias("part"), F.struct("field", "status", F.expr("substring(evidence_excerpt, 1, 300)").alias("span"), "content_sha256", "evidence_id").alias("e"))
    return c.groupBy("organisation_number", "part").agg(F.sort_array(F.collect_list("e")).alias("evidence"), F.map_from_entries(F.array_distinct(F.sort_array(F.collect_list(F.struct(F.concat_ws(":", "e.field", F.col("e.evidence_id").cast("string")), "e.status"))))).alias("modules"))


# ---- scalar functions over columns


@query
def url_canonical(spark, sf):
    u = F.col("website")
    return table(spark, sf, "companies").select("organisation_number", "website").distinct().where("website != ''").select("organisation_number", "website", U.canonical_url(u).alias("url"), U.host(u).alias("host"), U.second_level_label(U.host(u)).alias("label"))


@query
def url_safety(spark, sf):
    d = table(spark, sf, "evidence")
    return d.groupBy(U.is_public(F.col("source_url")).alias("public")).agg(F.count("*").alias("n"))


@query
def org_numbers_in_text(spark, sf):
    """Nine digits, written together or in threes, in the texts of search hits and documents, and whether they carry their check digit."""
    r, d = table(spark, sf, "discovery_results"), table(spark, sf, "documents")
    texts = r.select(F.lit("result").alias("origin"), F.col("result_id").alias("id"), F.concat_ws(" ", "query", "title", "snippet").alias("t")).unionByName(d.select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t")))
    found = F.regexp_extract_all("t", F.lit(r"\b(\d{9}|\d{3}[ \x{A0}]\d{3}[ \x{A0}]\d{3})\b"), F.lit(1))
    n = texts.select("origin", "id", F.explode(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")))).alias("org"))
    return n.select("origin", "id", "org", K.has_valid_check(F.col("org")).alias("valid"))


@query
def mail_addresses_in_text(spark, sf):
    r = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r), F.lit(1))).alias("m"))
    return d.select(F.regexp_extract(X.email(F.col("m")), "@(.*)$", 1).alias("domain")).where("domain != ''").groupBy("domain").agg(F.count("*").alias("n"))


@query
def phone_numbers_in_text(spark, sf):
    d = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\+47 \d{3} \d{2} \d{3})"), F.lit(1))).alias("p"))
    return d.groupBy("source").agg(F.count("*").alias("phones"), F.countDistinct(X.phone(F.col("p"))).alias("numbers"), F.min(X.phone(F.col("p"))).alias("first"))


@query
def address_parts(spark, sf):
    d = table(spark, sf, "snapshot_claims").where("field_name = 'business_address' and trim(value) != ''")
    return d.select(X.address(F.col("value")).alias("a")).groupBy(F.substring("a.postal_code", 1, 2).alias("region")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("a.city")).alias("cities"))


@query
def legal_form_of_names(spark, sf):
    d = companies(spark, sf)
    return d.groupBy("legal_form", X.legal_form(F.col("name")).alias("in_name")).agg(F.count("*").alias("n"))


@query
def flexible_dates(spark, sf):
    d = table(spark, sf, "claim_updates")
    return d.select("claim_id", F.date_format(flexible_day(F.col("effective_date")), "yyyy-MM-dd").alias("day"))


@query
def amount_parse(spark, sf):
    d = table(spark, sf, "claim_updates").where("field_name in ('revenue', 'total_assets')")
    a = N.amount(F.col("value"))
    return d.select("claim_id", a["value"].alias("amount"), a["currency"].alias("currency"))


@query
def json_path_read(spark, sf):
    d = table(spark, sf, "evidence").select("field", F.get_json_object("value", "$.municipality").alias("town"), F.get_json_object("value", "$.records").try_cast("int").alias("records"))
    return d.groupBy("field").agg(F.count("records").alias("n"), F.sum("records").alias("records"), F.countDistinct("town").alias("towns"))


@query
def event_props_read(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return d.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("k").alias("total"))


@query
def profile_merge_events(spark, sf):
    """Each user's latest event by kind, the kinds in a map, and the last error."""
    d = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("l"))
    p = d.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("n"))
    last = d.groupBy("user_id").agg(F.max("l").alias("l")).select("user_id", F.col("l.event_id").alias("last_event"))
    return p.join(last, "user_id")


@query
def multi_source_parts(spark, sf):
    """Best and latest offer of each part: supplier of highest quantity, distinct suppliers."""
    d = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.max(F.struct("l_quantity", "l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber")).alias("b"))
    return d.select("l_partkey", "lines", "suppliers", F.col("b.l_suppkey").alias("best_supplier"), F.col("b.l_quantity").alias("best_quantity"))


@query
def order_value_rollup(spark, sf):
    """Revenue by region and nation with subtotals."""
    v = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o.select("o_orderkey", "r_name", "n_name"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("lines"), F.round(F.sum(v), 2).cast("double").alias("revenue"))


# ---- streams, run bounded


@query
def stream_window_counts(spark, sf):
    from sporlake.streaming import streams as S

    return S.drain(S.windowed_counts(S.event_stream(spark, sf)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query
def stream_budget_state(spark, sf):
    from sporlake.streaming import streams as S

    return S.drain(S.admitted(S.event_stream(spark, sf), 500), "update").groupBy("user_id").agg(F.max("admitted").alias("admitted"), F.max("refused").alias("refused"), F.max("spent_cents").alias("spent_cents"))


# ---- assessments


@query
def research_candidates(spark, sf):
    from sporlake.operators import assess as S

    d = table(spark, sf, "discovery_results").where("organisation_number is not null")
    return S.research_candidates(d, ["organisation_number"], "url", "rank", F.lit(0.9), "result_id").select("organisation_number", "url_key", "rank", F.col("candidate_score").alias("score"), "place")


@query
def source_rule_lookup(spark, sf):
    """Evidence by the rule of its host or a parent domain; the rules are those of the frequent second-level hosts."""
    from sporlake.operators import assess as S

    e = table(spark, sf, "evidence").select("evidence_id", "source_url").where("source_url is not null")
    rules = spark.createDataFrame([("kilde.example", "licensed"), ("example", "unknown"), ("official-registry.kilde.example", "open")], "domain string, licence string")
    return S.lookup_by_domain(e, "source_url", "evidence_id", rules).groupBy("licence", "domain").agg(F.count("*").alias("n"))


@query
def exact_title_match(spark, sf):
    """Search hits whose title holds the company's name as words that stand together."""
    from sporlake.functions.documents import contains_sequence

    c = companies(spark, sf).select("organisation_number", F.split(X.folded_name(F.col("name")), " ").alias("n"))
    d = table(spark, sf, "discovery_results").where("title is not null").select("result_id", "organisation_number", F.split(X.folded_name(F.col("title")), " ").alias("t"))
    return d.join(c, "organisation_number").select("result_id", contains_sequence(F.col("t"), F.col("n")).alias("in_title"))


@query
def search_ambiguity(spark, sf):
    from sporlake.operators import assess as S

    c = companies(spark, sf).select("organisation_number", "name")
    d = table(spark, sf, "discovery_results").join(c, "organisation_number").select("organisation_number", "name", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("query", F.lit("")).alias("q"))
    return S.ambiguity(d, "organisation_number", F.col("name"), F.col("title"), F.contains("q", "organisation_number"))


@query
def cost_shares(spark, sf):
    from sporlake.operators import assess as S

    d = S.shares(table(spark, sf, "events"), ["event_type"], F.col("value").cast("decimal(12,2)"), 0.2)
    return d.select("event_type", F.col("total").cast("double").alias("total"), "share", "bottleneck")


@query
def evidence_identity(spark, sf):
    """Score of whether evidence speaks of its company, from its title and excerpt."""
    from sporlake.operators import assess as S

    c = companies(spark, sf).select("organisation_number", "name")
    e = table(spark, sf, "evidence").select("evidence_id", "organisation_number", "source_title", "evidence_excerpt").join(c, "organisation_number")
    p = S.page_identity(F.col("name"), F.col("organisation_number"), F.col("source_title"), F.col("evidence_excerpt"))
    return e.select("evidence_id", p["score"].cast("double").alias("score"), p["status"].alias("status"))


@query
def profile_facts(spark, sf):
    """What is known of a company as facts, and notes on what isn't."""
    from sporlake.operators import assess as S

    f = S.facts({"employees": F.col("employees"), "website": F.nullif(F.col("website"), F.lit("")), "municipality": F.col("municipality")}, {"employees are not reported": F.col("employees").isNull(), "no website is registered": F.col("website") == ""})
    return companies(spark, sf).select("organisation_number", f.alias("f")).select("organisation_number", F.size("f.facts").alias("facts"), F.array_join("f.unsupported", ";").alias("notes"))


@query
def name_similarity(spark, sf):
    """Block similarity of typed and registered names (vectorised Python)."""
    from sporlake.functions.documents import similarity

    d = table(spark, sf, "name_comparisons")
    return d.select("comparison_id", similarity(F.lower("target_name"), F.lower("source_name")).alias("ratio"))


@query
def canonical_values(spark, sf):
    """Evidence values in canonical JSON: distinct ones by module (vectorised Python)."""
    from sporlake.functions.documents import canonical_json

    return table(spark, sf, "evidence").select("field", canonical_json(F.col("value")).alias("v")).groupBy("field").agg(F.countDistinct("v").alias("values"))
