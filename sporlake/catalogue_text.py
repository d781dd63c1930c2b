"""Queries over running text, search payloads and identity: extraction, candidates and verdicts by rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporlake.catalogue import companies
from sporlake.functions import keys as K
from sporlake.functions import marks as M
from sporlake.functions import text as X
from sporlake.functions import urls as U
from sporlake.operators import ranking as R
from sporlake.operators.validate import blank
from sporlake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- fields of pages


@query
def page_head_counts(spark, sf):
    """Head counts that texts name: how many, the first and the largest."""
    d = table(spark, sf, "documents").select("doc_id", M.head_counts(F.col("text")).alias("n"))
    return d.where("size(n) > 0").select("doc_id", F.size("n").alias("named"), F.col("n")[0].alias("first"), F.array_max("n").alias("largest"))


@query
def page_contacts(spark, sf):
    """Distinct phone numbers and post towns of texts, in any writing, by source."""
    d = table(spark, sf, "documents").select("doc_id", "source", M.phones(F.col("text")).alias("p"), M.postal_towns(F.col("text")).alias("t"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("p")).alias("phones"), F.count_if(F.size("p") > 0).alias("with_phone"), F.sum(F.size("t")).alias("towns"), F.count_if(F.size("t") > 0).alias("with_town"))


@query
def page_roles(spark, sf):
    """Roles that texts name, by language: each document counts once a role."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.array(*[F.when(F.lower("text").rlike(M.words_pattern(w)), F.lit(r)) for r, w in M.ROLES.items()])).alias("role")).where("role is not null")
    return d.groupBy("lang", "role").agg(F.count("*").alias("documents"))


@query
def leadership_roles(spark, sf):
    """Kinds of role titles: of evidence fields, titles and claims."""
    t = table(spark, sf, "discovery_results").where("title is not null").select(F.col("title").alias("t")).unionByName(table(spark, sf, "snapshot_claims").select(F.regexp_replace("field_name", "_", " ").alias("t")))
    return t.groupBy(M.role(F.col("t")).alias("role")).agg(F.count("*").alias("n"))


@query
def page_descriptions(spark, sf):
    """The first sentence of a text with sixty letters or more, at most 300, as its description."""
    s = F.regexp_replace(F.col("text"), r"\s+", " ")
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract(s, r"([^.!?]{60,}[.!?])", 1).alias("d")).where("d != ''")
    return d.select("doc_id", F.substring(F.trim("d"), 1, 300).alias("description"))


@query
def text_days(spark, sf):
    """The first day that a text writes out, and whether it may be its day of publication: from 2000 on, not to come, and not the day it was read unless the text says "published"."""
    d = table(spark, sf, "documents").select("doc_id", F.to_date("published_at").alias("seen"), F.lower("text").alias("t"), M.written_day(F.col("text")).alias("day")).where("day is not null")
    says = F.col("t").rlike("publisert|published|pressemelding|press release")
    ok = (F.col("day") >= F.lit("2000-01-01").cast("date")) & (F.col("day") <= F.lit("2026-01-01").cast("date")) & (says | ~F.coalesce(F.col("day") == F.col("seen"), F.lit(False)))
    return d.select("doc_id", F.date_format("day", "yyyy-MM-dd").alias("day"), ok.alias("valid"))


# ---- search payloads and feeds, as recorded


@query
def search_payload_rows(spark, sf):
    """Results out of the JSON payload of a search, ranked as delivered; those without an address are left out."""
    r = table(spark, sf, "discovery_results").where("organisation_number is not null")
    body = r.groupBy("organisation_number", "provider").agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(F.struct("result_id", "title", "url", F.col("snippet").alias("description")))).alias("results")).alias("web"))).alias("body"))
    p = F.from_json("body", "web struct<results: array<struct<result_id: long, title: string, url: string, description: string>>>")
    rows = body.select("organisation_number", "provider", F.posexplode(F.filter(p["web"]["results"], lambda x: U.host(x["url"]).isNotNull())).alias("at", "x"))
    return rows.select("organisation_number", "provider", (F.col("at") + 1).alias("rank"), "x.result_id", "x.title", F.col("x.description").alias("snippet"))


@query
def feed_items(spark, sf):
    """Items of an RSS feed a company, out of its XML: those whose title holds the company's name, in a window of years."""
    from sporlake.functions.documents import contains_sequence

    d = table(spark, sf, "documents").where("organisation_number is not null and title is not null").select("organisation_number", "doc_id", "title", F.year("published_at").alias("y"))
    esc = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(esc, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    item = F.concat(F.lit("<item><title>"), clean, F.lit("</title><guid>"), F.col("doc_id").cast("string"), F.lit("</guid><pubYear>"), F.coalesce(F.col("y").cast("string"), F.lit("")), F.lit("</pubYear></item>"))
    feed = d.select("organisation_number", F.concat(F.lit("<channel>"), item, F.lit("</channel>")).alias("xml"))
    x = F.from_xml("xml", "item array<struct<title: string, guid: long, pubYear: int>>")
    i = feed.select("organisation_number", F.explode(x["item"]).alias("i")).select("organisation_number", F.col("i.guid").alias("doc_id"), F.col("i.title").alias("title"), F.col("i.pubYear").alias("year"))
    c = companies(spark, sf).select("organisation_number", F.split(X.folded_name(X.without_legal_form(F.col("name"))), " ").alias("n"))
    j = i.where(F.col("year").between(2015, 2026)).join(c, "organisation_number")
    return j.where(contains_sequence(F.split(X.folded_name(F.col("title")), " "), F.col("n"))).select("organisation_number", "doc_id", "year")


@query
def rating_nodes(spark, sf):
    """Aggregate ratings out of JSON-LD, with the label of the rating."""
    ld = F.to_json(F.struct(F.lit("LocalBusiness").alias("@type"), F.struct(F.lit("AggregateRating").alias("@type"), (F.round(F.col("l_discount") * 40 + 1, 1)).alias("ratingValue"), F.col("l_quantity").cast("int").alias("reviewCount")).alias("aggregateRating")))
    d = table(spark, sf, "lineitem").select("l_returnflag", ld.alias("ld"))
    r = d.select("l_returnflag", F.get_json_object("ld", "$.aggregateRating.ratingValue").cast("double").alias("rating"), F.get_json_object("ld", "$.aggregateRating.reviewCount").cast("int").alias("reviews"))
    label = M.ladder({"negative": F.col("rating") <= 2, "positive": F.col("rating") >= 4}, "neutral")
    return r.where("reviews > 0").groupBy("l_returnflag", label.alias("label")).agg(F.count("*").alias("n"), F.sum("reviews").alias("reviews"))


# ---- candidates


@query
def job_board_hits(spark, sf):
    """Search hits by what their address says of jobs: a posting, a search page, a front page of a board, or none."""
    h, p = U.host(F.col("url")), F.lower(F.regexp_replace(U.path(F.col("url")), r"/+$", ""))
    q = F.lower(U.query_text(F.col("url")))
    board = h.rlike(r"(^|\.)(jobb|karriere|finn|jobbnorge)")
    kind = M.ladder({"search_page": p.rlike(r"/(sok|search)\b") | q.rlike(r"(^|&)(q|sok|search)="), "posting": p.rlike(r"/(stilling|stillinger|jobs?|jobb|careers?|karriere)(/|$)"), "board_front": board & (p == "")}, "none")
    return table(spark, sf, "discovery_results").where("url is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def news_candidates(spark, sf):
    """Search hits that may be news: an article's path and title, no section page, profile or board."""
    p, t = F.lower(F.regexp_replace(U.path(F.col("url")), r"/+$", "")), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    why = M.ladder({
        "no_address": U.host(F.col("url")).isNull(), "social": U.social_platform(F.col("url")).isNotNull(), "section": p.isin("", "/nyheter", "/news", "/presse", "/press", "/aktuelt", "/blogg", "/blog"), "navigation": p.rlike(r"^/(produkter|products?|tjenester|services?|om-oss|about|kontakt|contact|priser|hjem|home)\b"),
        "generic_title": t.isin("nyheter", "news", "aktuelt", "presse", "forside", "hjem", "om oss", "kontakt", ""), "news_path": p.rlike(r"/(nyheter|news|artikkel|article|presse|press)/"), "news_words": F.concat_ws(" ", t, F.lower(F.coalesce("snippet", F.lit("")))).rlike(r"pressemelding|press release|lanserer|kontrakt|oppkjøp"),
    }, "other")
    return table(spark, sf, "discovery_results").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@query
def scored_sites(spark, sf):
    """A second score of candidate sites: number, name, host, town and trade, and whether it reaches the threshold."""
    c = companies(spark, sf).select("organisation_number", "name", "municipality", "industry_label", F.col("website").alias("site"))
    r = table(spark, sf, "discovery_results").select("result_id", "organisation_number", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"))
    j = r.join(c, "organisation_number")
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    has = lambda a, b: F.size(F.array_except(a, b)) == 0
    words = X.tokens(F.concat_ws(" ", "title", "snippet"))
    pts = {"number": (F.contains(text, F.col("organisation_number")), 40), "name": (has(X.tokens(F.col("name")), words), 35), "registered": (U.host(F.col("url")) == U.host(F.col("site")), 20), "town": (has(X.tokens(F.col("municipality")), words), 10), "trade": (F.contains(text, F.lower(F.regexp_replace("industry_label", "^Virksomhet innen ", ""))), 10)}
    score = F.least(F.lit(100), sum((F.when(F.coalesce(rule, F.lit(False)), p).otherwise(0) for rule, p in pts.values()), F.lit(0)))
    return j.select("result_id", score.alias("score"), (score >= 70).alias("accepted"))


# ---- identity


@query
def org_number_diagnostics(spark, sf):
    """What is wrong with organisation numbers as written."""
    o = F.col("organisation_number")
    d = F.regexp_replace(F.coalesce(o, F.lit("")), r"\D", "")
    kind = M.ladder({"missing": blank(o), "no_digits": d == "", "wrong_length": F.length(d) != 9, "bad_check_digit": ~K.has_valid_check(d), "clean": o == d, "prefixed": F.upper(o).rlike(r"^\s*NO|MVA\s*$")}, "spaced")
    return table(spark, sf, "raw_claims").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def domain_relations(spark, sf):
    """How the host of a search hit relates to the company's own: the same, above, below, a sister, other."""
    own = companies(spark, sf).select("organisation_number", U.host(F.col("website")).alias("own"))
    d = table(spark, sf, "discovery_results").select("organisation_number", U.host(F.col("url")).alias("h")).join(own, "organisation_number")
    a, b = F.col("own"), F.col("h")
    kind = M.ladder({"unknown": a.isNull() | b.isNull(), "same": a == b, "subdomain": b.endswith(F.concat(F.lit("."), a)), "parent": a.endswith(F.concat(F.lit("."), b)), "same_label": U.second_level_label(a) == U.second_level_label(b)}, "other")
    return d.groupBy(kind.alias("relation")).agg(F.count("*").alias("n"))


@query
def contradictions(spark, sf):
    """Pairs of claims on one field of a company with different values: the more trusted wins, equal trust leaves it open."""
    d = table(spark, sf, "raw_claims").where("trim(value) != ''").select(K.org_digits(F.col("organisation_number")).alias("org"), F.lower("field_name").alias("field"), F.lower(F.trim("value")).alias("v"), F.coalesce("source_authority", F.lit(-1)).alias("a"))
    top = d.where("org is not null").groupBy("org", "field", "v").agg(F.max("a").alias("a"))
    two = R.first_per(top, ["org", "field"], [F.desc("a"), F.col("v")]).select("org", "field", F.col("v").alias("v1"), F.col("a").alias("a1"))
    rest = top.join(two, ["org", "field"]).where("v != v1").groupBy("org", "field", "v1", "a1").agg(F.max(F.struct("a", "v")).alias("s"), F.count("*").alias("others"))
    return rest.select("org", "field", "others", F.when(F.col("a1") > F.col("s.a"), F.col("v1")).alias("resolved"), F.when(F.col("a1") > F.col("s.a"), "RESOLVED").otherwise("UNCERTAIN").alias("status"))


@query
def evidence_support(spark, sf):
    """Claims by how their evidence supports them, and the weighted validity of each field."""
    e = table(spark, sf, "evidence").select("evidence_id", "verdict", "validation_status")
    d = table(spark, sf, "raw_claims").join(e, "evidence_id", "left")
    kind = M.ladder({"missing": F.col("evidence_id").isNull(), "contradicted": F.col("verdict") == "unsupported", "supported": (F.col("verdict") == "supported") & (F.col("validation_status") == "accepted"), "partial": F.col("validation_status") == "accepted"}, "unsupported")
    g = d.select(F.lower(F.regexp_replace(F.trim("field_name"), r"[\s-]+", "_")).alias("field"), kind.alias("k")).groupBy("field")
    n = lambda k: F.count_if(F.col("k") == k)
    return g.agg(F.count("*").alias("claims"), *[n(k).alias(k) for k in ("supported", "partial", "unsupported", "contradicted", "missing")], F.round((n("supported") + 0.5 * n("partial")) / F.count("*"), 4).alias("validity"))


@query
def evidence_validity(spark, sf):
    """Three checks of evidence: an address, a time, a hash that is one."""
    ok = {"url": U.host(F.col("source_url")).isNotNull(), "time": ~blank(F.col("retrieved_at")), "hash": F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))}
    return table(spark, sf, "evidence").agg(F.count("*").alias("items"), *[F.count_if(c).alias(f"with_{n}") for n, c in ok.items()], F.round(F.avg((ok["url"] & ok["time"] & ok["hash"]).cast("double")), 6).alias("valid_rate"))


@query
def entity_pages(spark, sf):
    """Verdict on the pages of a company: parked, another number, the own number, the name, or nothing that proves it."""
    c = companies(spark, sf).select("organisation_number", "name")
    d = table(spark, sf, "documents").where("organisation_number is not null").select("organisation_number", F.coalesce("text", F.lit("")).alias("t")).join(c, "organisation_number")
    n = F.regexp_extract_all("t", F.lit(r"\b(\d{9})\b"), F.lit(1))
    flags = d.groupBy("organisation_number").agg(
        F.count("*").alias("pages"), F.bool_or(F.lower("t").rlike("domain (is )?for sale|parked domain|domenet er til salgs")).alias("parked"), F.bool_or(F.array_contains(n, F.col("organisation_number")) & (F.length("t") >= 20)).alias("own"), F.bool_or((F.size(n) > 0) & ~F.array_contains(n, F.col("organisation_number"))).alias("foreign"),
        F.bool_or(F.contains(F.lower("t"), F.lower(X.without_legal_form(F.col("name")))) & (F.length("t") >= 50)).alias("named"),
    )
    return flags.select("organisation_number", "pages", M.ladder({"parked": F.col("parked"), "verified_by_number": F.col("own"), "abstain_other_number": F.col("foreign"), "verified_by_name": F.col("named")}, "abstain").alias("verdict"))


@query
def name_verdicts(spark, sf):
    """Categories of typed names against registered ones: equal, form or order differs, subset, shared words, none."""
    d = table(spark, sf, "name_comparisons")
    a, b = X.collapse(F.col("target_name")), X.collapse(F.coalesce("source_name", F.lit("")))
    fa, fb, la, lb = X.folded_name(X.without_legal_form(a)), X.folded_name(X.without_legal_form(b)), X.legal_form(a), X.legal_form(b)
    ta, tb = X.tokens(a), X.tokens(b)
    both = F.size(F.array_intersect(ta, tb))
    kind = M.ladder({"empty": fb == "", "exact": a == b, "same_core_form_differs": (fa == fb) & la.isNotNull() & lb.isNotNull() & (la != lb), "same_core": fa == fb, "reordered": (both == F.size(ta)) & (both == F.size(tb)), "part": (both == F.size(tb)) | (both == F.size(ta)), "shared_words": both > 0}, "different")
    return d.select("comparison_id", kind.alias("category"), both.alias("shared"))


@query
def source_tiers(spark, sf):
    """Evidence by the tier of its source, from type and host."""
    h, s = U.host(F.col("source_url")), F.lower(F.regexp_replace(F.coalesce("source_class", "source_type"), r"[^\p{L}]", ""))
    tier = M.ladder({"register": (s == "officialregistry") | h.startswith("official-registry."), "filing": s == "officialfiling", "own": s.isin("companyowned", "structuredmarkup"), "press": s.isin("newspublisher", "partnerwire"), "search": s == "searchresult"}, "third_party")
    return table(spark, sf, "evidence").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.countDistinct("organisation_number").alias("companies"))


@query
def publishable_sites(spark, sf):
    """Website evidence behind an identity gate: what isn't publishable becomes not found, with the reason."""
    e = table(spark, sf, "evidence").where("field = 'website'")
    why = F.array_compact(F.array(F.when(~F.coalesce("identity_match", F.lit(False)), "identity not shown"), F.when(F.coalesce("confidence", F.lit(0.0)) < 0.35, "low confidence"), F.when(F.col("verdict") == "unsupported", "not supported")))
    return e.select("evidence_id", F.when(F.size(why) > 0, "not_found").otherwise(F.col("status")).alias("status"), F.array_join(why, "; ").alias("reason"))
