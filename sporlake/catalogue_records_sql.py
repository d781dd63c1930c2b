"""DuckDB SQL for the queries of catalogue_records."""

from sporlake.catalogue_sql import CO, LAST, PUBLIC, collapse, folded, host, no_form, port, rank, share, url_path
from sporlake.problems_sql import canonical_sql

ACC = """acc AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'KONSERN' WHEN 'O' THEN 'SELSKAP' END AS kind, o_orderdate, CASE WHEN o_orderpriority <> '5-LOW' THEN 'nok' END AS cur, o_totalprice AS v, o_orderstatus AS st FROM orders)"""
def canon(table: str, column: str, out: str) -> str:
    """Layers that add column ``out``, the canonical text of a column of a table, in relation ``c_out``."""
    return canonical_sql(column).replace("FROM src", f"FROM {table}").replace("s1", f"{out}1").replace("s2", f"{out}2").replace("s3", f"{out}3").replace("canon AS", f"c_{out} AS").replace("ELSE s END AS c FROM", f"ELSE s END AS {out} FROM")


def blank(c: str) -> str:
    return f"coalesce(trim(CAST({c} AS VARCHAR)), '') = ''"


def canonical_url(c: str) -> str:
    return f"'https://' || {host(c)} || {port(c)} || regexp_replace({url_path(c)}, '/+$', '') || CASE WHEN contains({c}, '?') THEN '?' || regexp_extract({c}, '\\?([^#]*)', 1) ELSE '' END"


OBS = {
    "bad_organisation": r"NOT coalesce(regexp_full_match(organisation_number, '\d+'), false)",
    "unknown_platform": "coalesce(source_type, '') NOT IN ('official_registry', 'official_filing', 'company_owned', 'news_publisher', 'partner_wire')",
    "unknown_signal": "coalesce(field, '') NOT IN ('news', 'jobs', 'website')",
    "no_url": f"{host('source_url')} IS NULL",
    "no_time": blank("retrieved_at"),
    "no_hash": "length(coalesce(content_sha256, '')) <> 64",
    "entity_not_exact": "NOT coalesce(identity_match, false)",
    "no_proof": blank("verdict"),
    "mode_not_approved": "coalesce(source_type, '') NOT IN ('official_registry', 'official_filing', 'company_owned')",
    "rights_not_approved": "coalesce(validation_status, '') <> 'accepted'",
    "no_span": f"field = 'news' AND {blank('evidence_excerpt')}",
    "unknown_label": "field = 'news' AND NOT coalesce(confidence > 0.7, false)",
    "label_not_independent": "field = 'news' AND coalesce(source_type, '') <> 'news_publisher'",
    "no_model": f"field = 'news' AND {blank('note')}",
}
CLAIM = {
    "unsafe_url": f"NOT {PUBLIC}",
    "unverified_source": "coalesce(source_authority, -1) < 20",
    "search_snippet": "source_type = 'search_result'",
    "other_organisation": r"len(nums) > 0 AND NOT list_contains(nums, organisation_number)",
    "other_name": "text <> '' AND NOT contains(lower(text[1:1000]), lower(name))",
    "group_report": r"regexp_matches(lower(text), '\b(konsernregnskap|group\s+accounts|morselskap)\b') AND NOT regexp_matches(lower(text), '\b(underenhet|datterselskap|subsidiary)\b') AND NOT contains(text, organisation_number)",
    "span_not_in_source": r"text <> '' AND span <> '' AND NOT contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(span, '\s+', ' ', 'g'))) AND NOT contains(text, span[1:50])",
    "hash_differs": "text <> '' AND content_sha256 IS NOT NULL AND sha256(text) <> lower(content_sha256)",
    "no_span": "value IS NOT NULL AND span = '' AND NOT coalesce(source_type = 'official_registry', false)",
}


def names_of(rules: dict[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + ")"


def screened(k: int, where: str, n: int) -> str:
    return f"SELECT {k} AS screen, coalesce(string_agg(organisation_number, ',' ORDER BY coalesce(employees, -1) DESC, organisation_number), '') AS members FROM (SELECT organisation_number, employees FROM co WHERE {where} ORDER BY employees DESC NULLS LAST, organisation_number LIMIT {n})"


SQL = {
    "registry_entities": "SELECT organisation_number, name, legal_form, employees, bankrupt, liquidating, website, industry_code, municipality, latest_submitted_accounts FROM (SELECT DISTINCT * FROM companies)",
    "account_records": f"""WITH {ACC} SELECT o_custkey, o_orderkey AS record_id, kind AS account_type, strftime(o_orderdate, '%Y-%m-%d') AS period_end, cur AS currency, v AS revenue, CASE WHEN st <> 'P' THEN v END AS operating_result, CAST(NULL AS DOUBLE) AS profit_before_tax, -v AS annual_result, v AS assets, CAST(NULL AS DOUBLE) AS equity, CAST(NULL AS DOUBLE) AS debt
 FROM acc QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""",
    "account_statements": f"""WITH {ACC} SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, coalesce(kind, 'SELSKAP') = 'KONSERN', o_orderkey) - 1 AS INT) AS place, o_orderkey AS record_id, coalesce(kind, 'SELSKAP') AS account_type, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS months, 'NOK' AS currency, v AS revenue, CASE WHEN st = 'P' THEN 'NOT_FOUND' ELSE 'AVAILABLE' END AS operating_status FROM acc""",
    "account_years": """WITH y AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y') AS y FROM orders) SELECT o_custkey, string_agg(y, ';' ORDER BY y) AS years, CAST(count(*) AS INT) AS documents, 'https://register.example/' || max(y) || '.pdf' AS newest FROM y GROUP BY 1""",
    "role_rows": r"""SELECT claim_id, nullif(regexp_extract(trim(value), '^(\S*)', 1) || CASE WHEN regexp_extract(trim(value), '^\S+\s+(.*)$', 1) <> '' THEN ' ' || regexp_extract(trim(value), '^\S+\s+(.*)$', 1) ELSE '' END, '') AS name, 'DAGL' AS role_code, 'Daglig leder' AS role, 'LEDE' AS group_code, effective_date AS last_changed, coalesce(confidence < 0.4, false) AS inactive FROM snapshot_claims WHERE field_name = 'managing_director'""",
    "unit_rows": "SELECT n_regionkey, '9' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS organisation_number, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'POST' END AS town, CAST(n_nationkey AS BIGINT) AS employees FROM nation",
    "observation_reasons": f"WITH r AS (SELECT evidence_id, {names_of(OBS)} AS reasons FROM evidence) SELECT evidence_id, reasons, reasons = '' AS publishable FROM r",
    "claim_reasons": rf"""WITH {CO}, d AS (SELECT claim_id, r.organisation_number, name, r.source_url, value, coalesce(evidence_span, '') AS span, coalesce(evidence_excerpt, '') AS text, r.content_sha256, source_authority, source_type, regexp_extract_all(coalesce(evidence_excerpt, ''), '\b(\d{{9}})\b', 1) AS nums
 FROM (SELECT claim_id, organisation_number, source_url, value, evidence_span, content_sha256, source_authority, evidence_id FROM raw_claims) r JOIN (SELECT evidence_id, evidence_excerpt, source_type FROM evidence) e USING (evidence_id) JOIN co ON co.organisation_number = r.organisation_number)
SELECT claim_id, {names_of(CLAIM)} AS reasons FROM d""",
    "batch_checks": f"""WITH {CO}, e AS (SELECT organisation_number, bool_or(status NOT IN ('available', 'not_found', 'not_applicable', 'blocked', 'source_error')) AS bad FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1),
 j AS (SELECT e.organisation_number AS a, co.organisation_number AS b, bad FROM e FULL JOIN co USING (organisation_number)), c AS (SELECT count(a) AS rows, count(b) AS expected, CAST(0 AS BIGINT) AS repeated, count_if(a IS NULL) AS dropped, count_if(b IS NULL) AS unasked, count_if(bad) AS not_terminal FROM j)
SELECT *, rows = expected AS exact_count, true AS unique_keys, not_terminal = 0 AS all_terminal, dropped = 0 AS no_silent_drops, unasked = 0 AS same_members, rows = expected AND not_terminal = 0 AND dropped = 0 AND unasked = 0 AS passed FROM c""",
    "envelope_counts": """SELECT organisation_number, CAST(ceil(count(*) / 1000) AS BIGINT) AS parts, count(*) AS evidence, count(DISTINCT (field, evidence_id)) AS modules, min(evidence_id) AS first_id, CAST(max(least(length(coalesce(evidence_excerpt, '')), 300)) AS INT) AS longest_span FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1""",
    "manifest_count_differences": """WITH a AS (SELECT source_type, field, count(*) AS declared FROM (SELECT DISTINCT source_type, field, organisation_number, source_url, retrieved_at FROM evidence) GROUP BY 1, 2), b AS (SELECT source_type, field, count(*) AS observed FROM evidence GROUP BY 1, 2)
SELECT source_type, field, declared, observed FROM a FULL JOIN b USING (source_type, field) WHERE declared IS DISTINCT FROM observed""",
    "delivery_change_counts": rf"""WITH {LAST}, {canon("ch", "before", "cb")}, b2 AS (SELECT version_from, version_to, claim_key, kind, after, cb FROM c_cb), {canon("b2", "after", "ca")},
 k AS (SELECT version_from, version_to, regexp_extract(claim_key, '\|field:([^|]*)', 1) AS field, CASE WHEN kind IN ('ADDED', 'REMOVED') THEN kind WHEN cb = ca THEN 'UNCHANGED' ELSE 'MODIFIED' END AS kind FROM c_ca)
SELECT version_from, version_to, field, count_if(kind = 'ADDED') AS added, count_if(kind = 'REMOVED') AS removed, count_if(kind = 'MODIFIED') AS modified, count_if(kind = 'UNCHANGED') AS unchanged FROM k GROUP BY 1, 2, 3""",
    "delivery_false_change_rate": f"""WITH {LAST}, m AS (SELECT * FROM ch WHERE kind = 'MODIFIED'), {canon("m", "before", "cb")}, b2 AS (SELECT version_from, version_to, after, cb FROM c_cb), {canon("b2", "after", "ca")}
SELECT version_from, version_to, count(*) AS changes, count_if(cb = ca) AS false_changes, round({share("(cb = ca)")}, 6) AS rate FROM c_ca GROUP BY 1, 2""",
    "claim_versions": f"WITH {LAST} SELECT claim_key, version, value, CAST(row_number() OVER (PARTITION BY claim_key ORDER BY version) - 1 AS INT) AS place FROM last",
    "website_changes": f"""WITH {LAST}, h AS (SELECT version_from, version_to, {host("before")} AS a, {host("after")} AS b, {canonical_url("before")} AS ua, {canonical_url("after")} AS ub FROM ch WHERE kind = 'MODIFIED' AND contains(claim_key, '|field:website'))
SELECT version_from, version_to, CASE WHEN a IS NULL OR b IS NULL THEN 'appeared_or_gone' WHEN a <> b THEN 'host_changed' WHEN ua <> ub THEN 'page_changed' ELSE 'same_address' END AS change, count(*) AS n FROM h GROUP BY 1, 2, 3""",
    "previous_profiles": f"""WITH {CO}, l AS (SELECT organisation_number, value, claim_id FROM claim_updates WHERE field_name = 'website' QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY CAST(retrieved_at AS TIMESTAMPTZ) DESC NULLS LAST, claim_id DESC) = 1)
SELECT co.organisation_number, website, l.value AS previous, l.claim_id FROM co LEFT JOIN l ON l.organisation_number = co.organisation_number""",
    "news_merge": f"""WITH s AS (SELECT DISTINCT organisation_number, {host("source_url")} AS h FROM evidence WHERE source_url IS NOT NULL AND organisation_number IS NOT NULL), d AS (SELECT organisation_number, result_id, rank, url, {host("url")} AS h FROM discovery_results WHERE organisation_number IS NOT NULL AND url IS NOT NULL)
SELECT organisation_number, result_id, url, CAST(row_number() OVER (PARTITION BY organisation_number ORDER BY rank NULLS LAST, result_id) AS INT) AS place FROM d ANTI JOIN s USING (organisation_number, h) QUALIFY place <= 10""",
    "seeds_applied": f"""WITH {CO}, s AS (SELECT organisation_number, value FROM raw_claims WHERE field_name = 'website' AND trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY source_authority DESC NULLS LAST, claim_id DESC) = 1)
SELECT coalesce(co.organisation_number, s.organisation_number) AS organisation_number, coalesce(nullif(website, ''), s.value) AS site, CASE WHEN website IS NULL THEN 'unknown_company' WHEN website <> '' THEN 'registered' WHEN s.value IS NOT NULL THEN 'seeded' ELSE 'none' END AS origin FROM co FULL JOIN s ON s.organisation_number = co.organisation_number""",
    "prediction_metrics": """WITH d AS (SELECT CAST(lower(trim(source_name)) = lower(trim(target_name)) AS VARCHAR) AS g, CAST(is_acceptable_match AS VARCHAR) AS p FROM name_comparisons), k AS (SELECT * FROM d WHERE g IS NOT NULL), l AS (SELECT DISTINCT g AS label FROM k),
 c AS (SELECT label, count_if(g = label) AS s, count_if(p = label) AS n, count_if(g = label AND p = label) AS t FROM l CROSS JOIN k GROUP BY 1), f AS (SELECT round(CASE WHEN t > 0 THEN 2.0 * (t / n) * (t / s) / (t / n + t / s) ELSE 0.0 END, 6) AS f1 FROM c)
SELECT count(*) AS gold_items, count(p) AS predictions, round(avg(CAST(coalesce(g = p, false) AS INT)), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, (SELECT count(*) FROM f) AS labels, round(count(p) / count(*), 6) AS coverage FROM k""",
    "field_states": f"""WITH {CO}, e AS (SELECT DISTINCT field, status, organisation_number FROM evidence WHERE organisation_number IS NOT NULL), f AS (SELECT DISTINCT field FROM evidence)
SELECT f.field, count_if(status = 'available') AS available, count_if(status = 'not_found') AS not_found, count_if(status = 'blocked') AS blocked, count_if(status = 'source_error') AS source_error, (SELECT count(*) FROM co) - count(DISTINCT organisation_number) AS missing FROM f LEFT JOIN e USING (field) GROUP BY 1""",
    "slowest_cases": "SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 5",
    "run_report": """WITH p AS (SELECT organisation_number, count(*) AS modules, CASE WHEN bool_and(status = 'available') THEN 'complete' WHEN bool_or(status = 'available') THEN 'partial' WHEN bool_and(status = 'not_found') THEN 'not_found' WHEN bool_or(status IN ('blocked', 'source_error')) THEN 'unavailable' ELSE 'failed' END AS s FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1)
SELECT count(*) AS companies, count_if(s = 'complete') AS complete, count_if(s = 'partial') AS partial, count_if(s = 'not_found') AS not_found, count_if(s = 'unavailable') AS unavailable, count_if(s = 'failed') AS failed, CAST(sum(modules) AS BIGINT) AS evidence, round(avg(modules), 3) AS mean_modules FROM p""",
    "score_summary": f"""WITH {CO}, s AS (SELECT NOT ({blank("name")}) AS a, NOT ({blank("employees")}) AS b, NOT ({blank("website")}) AS c, NOT ({blank("latest_submitted_accounts")}) AS d FROM co), t AS (SELECT *, CAST(a AS INT) * 10 + CAST(b AS INT) * 5 + CAST(c AS INT) * 5 + CAST(d AS INT) * 5 AS p FROM s)
SELECT count(*) AS companies, round(avg(p), 3) AS mean, count_if(p >= 15) AS at_15, count_if(p >= 25) AS at_25, round({share("a")}, 4) AS has_name, round({share("b")}, 4) AS has_employees, round({share("c")}, 4) AS has_website, round({share("d")}, 4) AS has_latest_submitted_accounts FROM t""",
    "source_kind_shares": """WITH s AS (SELECT organisation_number, list(DISTINCT source_type) AS s FROM evidence WHERE organisation_number IS NOT NULL AND status = 'available' GROUP BY 1)
SELECT count(*) AS companies, round(avg(CAST(list_has_any(s, ['official_registry', 'official_filing']) AS INT)), 4) AS official, round(avg(CAST(list_has_any(s, ['news_publisher', 'partner_wire']) AS INT)), 4) AS press, round(avg(CAST(list_has_any(s, ['company_owned', 'structured_markup']) AS INT)), 4) AS own, round(avg(CAST(len(s) >= 2 AS INT)), 4) AS two_or_more FROM s""",
    "operation_counters": """SELECT event_type, CAST(user_id % 4 AS BIGINT) AS engine, count(*) AS n, count_if(value < 100) AS ok, round(avg(CAST(value < 100 AS INT)), 6) AS success_rate, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total, max(value) AS slowest FROM events GROUP BY 1, 2""",
    "screen_checks": f"""WITH {CO} {screened(0, "lower(legal_form) = 'as'", 5)} UNION ALL {screened(1, "coalesce(latest_submitted_accounts, '') <> ''", 3)} UNION ALL SELECT 2, ''""",
    "modules_complete": """WITH e AS (SELECT organisation_number, count(DISTINCT field) AS modules, count(DISTINCT CASE WHEN status <> 'not_fetched' AND field IN ('registry', 'financials', 'roles') THEN field END) AS fetched FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1) SELECT *, fetched = 3 AS complete FROM e""",
    "labelled_share": """WITH l AS (SELECT DISTINCT doc_id AS k FROM content_labels) SELECT source, count(*) AS documents, count(k) AS labelled, count(DISTINCT CASE WHEN k IS NOT NULL THEN organisation_number END) AS companies, round(count(k) / count(*), 6) AS share FROM documents LEFT JOIN l ON doc_id = k GROUP BY 1""",
    "robots_verdicts": f"""WITH d AS (SELECT result_id, {host("url")} AS host, {url_path("url")} AS p FROM discovery_results WHERE url IS NOT NULL) SELECT result_id, host, NOT coalesce(starts_with(host, 'katalog-') AND starts_with(p, '/kontakt') AND NOT starts_with(p, '/kontakt/om'), false) AS allowed FROM d""",
    "enrichment_points": """WITH n AS (SELECT user_id, round(least(1.0, count_if(event_type = 'purchase') / 10) * 20.0, 3) AS purchase_points, round(least(1.0, count_if(event_type = 'click') / 30) * 10.0, 3) AS click_points, round(least(1.0, count_if(event_type = 'signup') / 5) * 5.0, 3) AS signup_points FROM events GROUP BY 1) SELECT *, round(purchase_points + click_points + signup_points, 3) AS points FROM n""",
    "control_iterations": """WITH f AS (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1, 2), d AS (SELECT user_id, day, count(*) AS n FROM f GROUP BY 1, 2), s AS (SELECT user_id, day, CAST(least(15, 5 * sum(n) OVER (PARTITION BY user_id ORDER BY day)) AS INT) AS score FROM d)
SELECT user_id, CAST(day AS VARCHAR) AS day, score, score - coalesce(lag(score) OVER (PARTITION BY user_id ORDER BY day), 0) AS gain FROM s""",
    "evaluation_cases": f"""SELECT result_id, organisation_number FROM discovery_results WHERE organisation_number IS NOT NULL ORDER BY (provider = 'replay') DESC NULLS LAST, {rank("CAST(result_id AS VARCHAR)", "cases")}, result_id LIMIT 25""",
    "preserved_sample": f"""WITH {CO}, k AS (SELECT DISTINCT organisation_number FROM raw_claims WHERE source_authority = 100), d AS (SELECT co.organisation_number, k.organisation_number IS NOT NULL AS kept FROM co LEFT JOIN k ON k.organisation_number = co.organisation_number WHERE latest_submitted_accounts = '2023' AND NOT bankrupt AND NOT liquidating),
 s AS (SELECT * FROM d ORDER BY kept DESC, {rank("organisation_number")}, organisation_number LIMIT 100), p AS (SELECT *, CAST(row_number() OVER (ORDER BY {rank("organisation_number", "spor-split")}, organisation_number) AS INT) AS position, count(*) OVER () AS n FROM s)
SELECT organisation_number, kept, position, CASE WHEN position <= round(n * 0.6) THEN 'development' WHEN position <= round(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM p""",
    "filer_strata": f"""WITH {CO} SELECT concat_ws('|', legal_form, CASE WHEN employees IS NULL THEN 'missing' WHEN employees < 5 THEN '0-4' WHEN employees < 50 THEN '5-49' ELSE '50+' END, string_split(industry_code, '.')[1], municipality_number[1:2]) AS stratum, count(*) AS companies FROM co WHERE latest_submitted_accounts <> '' GROUP BY 1""",
    "role_budget": f"""WITH {CO} SELECT organisation_number, CAST(website <> '' AS INT) AS site, CAST(NOT (bankrupt OR liquidating) AS INT) AS active, coalesce(employees, 0) AS employees FROM co ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 150""",
    "external_footprint": f"""WITH {CO}, d AS (SELECT organisation_number, title, rank, result_id, {host("url")} AS h, {canonical_url("url")} AS k FROM discovery_results WHERE organisation_number IS NOT NULL),
 f AS (SELECT * FROM d WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation_number, k ORDER BY rank NULLS LAST, result_id) = 1), j AS (SELECT f.*, {host("website")} AS own FROM f LEFT JOIN co ON co.organisation_number = f.organisation_number)
SELECT CASE WHEN h = own THEN 'own_site' WHEN starts_with(h, 'katalog') THEN 'directory' ELSE 'other' END AS kind, CASE WHEN {blank("title")} THEN 'no_title' WHEN rank > 8 THEN 'low_rank' ELSE 'accepted' END AS verdict, count(*) AS n FROM j GROUP BY 1, 2""",
    "search_queries": f"""WITH {CO}, q AS (SELECT organisation_number, concat_ws(' ', {collapse("name")}, municipality) AS a, concat_ws(' ', {collapse("name")}, organisation_number) AS b, {no_form("name")} AS c FROM co)
SELECT organisation_number, CAST(0 AS INT) AS place, a AS query FROM q UNION ALL SELECT organisation_number, 1, b FROM q UNION ALL SELECT organisation_number, 2, c FROM q""",
    "candidate_domains": f"""WITH {CO}, w AS (SELECT organisation_number, list_filter(string_split({folded(no_form("name"))}, ' '), lambda x: x NOT IN ('og', 'and', '')) AS w FROM co), n AS (SELECT DISTINCT organisation_number, unnest([array_to_string(w, ''), array_to_string(w, '-'), w[1]]) AS n FROM w)
SELECT organisation_number, n || '.no' AS domain FROM n WHERE length(n) >= 3""",
    "snapshot_hashes": """WITH d AS (SELECT lower(r.content_sha256) AS a, lower(e.content_sha256) AS b FROM raw_claims r LEFT JOIN evidence e ON e.evidence_id = r.evidence_id WHERE r.evidence_id IS NOT NULL)
SELECT CASE WHEN a IS NULL THEN 'claim_has_none' WHEN b IS NULL THEN 'evidence_has_none' WHEN a = b THEN 'same' ELSE 'differs' END AS result, count(*) AS n FROM d GROUP BY 1""",
    "failure_classes": """WITH d AS (SELECT status, lower(coalesce(note, '')) AS n FROM evidence WHERE status <> 'available') SELECT status, CASE WHEN regexp_matches(n, 'budget|exhausted') THEN 'BUDGET' WHEN regexp_matches(n, 'timeout|timed out') THEN 'TIMEOUT' WHEN regexp_matches(n, 'rate limit|429') THEN 'RATE_LIMIT' WHEN regexp_matches(n, 'unauthorized|forbidden|auth') THEN 'AUTH'
 WHEN regexp_matches(n, 'not found|404') THEN 'NOT_FOUND' WHEN regexp_matches(n, 'parse|malformed|syntax') THEN 'PARSE' WHEN regexp_matches(n, 'network|connection|no answer|dns') THEN 'NETWORK' ELSE 'UNKNOWN' END AS failure, count(*) AS n FROM d GROUP BY 1, 2""",
}
