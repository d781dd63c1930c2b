"""DuckDB SQL for the catalogue."""

CO = """co AS (SELECT organisation_number, name, legal_form, employees, bankrupt, liquidating, municipality, municipality_number, industry_code, industry_label, website, latest_submitted_accounts FROM companies
 QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY name NULLS FIRST, legal_form NULLS FIRST, employees NULLS FIRST, bankrupt NULLS FIRST, liquidating NULLS FIRST, municipality NULLS FIRST, municipality_number NULLS FIRST, industry_code NULLS FIRST, industry_label NULLS FIRST, website NULLS FIRST, latest_submitted_accounts NULLS FIRST) = 1)"""

US = "CAST(epoch_us(CAST({} AS TIMESTAMPTZ)) AS BIGINT)"


LAST = """last AS (SELECT claim_key, version, field_name, source_module, value, claim_id FROM snapshot_claims QUALIFY row_number() OVER (PARTITION BY claim_key, version ORDER BY CAST(retrieved_at AS TIMESTAMPTZ) DESC NULLS LAST, claim_id DESC) = 1),
 step AS (SELECT version AS f, lead(version) OVER (ORDER BY version) AS t FROM (SELECT DISTINCT version FROM snapshot_claims)),
 p AS (SELECT f, t, claim_key, value, claim_id FROM last JOIN step ON version = f WHERE t IS NOT NULL), q AS (SELECT f, t, claim_key, value, claim_id FROM last JOIN step ON version = t),
 ch AS (SELECT f AS version_from, t AS version_to, claim_key, p.value AS before, q.value AS after, CASE WHEN p.claim_id IS NULL THEN 'ADDED' WHEN q.claim_id IS NULL THEN 'REMOVED' WHEN p.value IS NOT DISTINCT FROM q.value THEN 'UNCHANGED' ELSE 'MODIFIED' END AS kind FROM p FULL JOIN q USING (f, t, claim_key))"""


def host(c: str) -> str:
    w = f"CASE WHEN trim({c}) = '' THEN NULL WHEN regexp_matches(trim({c}), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim({c}) ELSE 'https://' || trim({c}) END"
    return rf"nullif(regexp_replace(regexp_replace(lower(regexp_extract({w}, '^[^:]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', ''), '\.$', ''), '')"


def url_path(c: str) -> str:
    w = f"CASE WHEN regexp_matches(trim({c}), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim({c}) ELSE 'https://' || trim({c}) END"
    return f"regexp_extract({w}, '^[^:]+://[^/?#]*([^?#]*)', 1)"


def port(c: str) -> str:
    """':' and the port of an address, '' for the default ones."""
    w = f"CASE WHEN regexp_matches(trim({c}), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim({c}) ELSE 'https://' || trim({c}) END"
    p = rf"regexp_extract({w}, '^[^:]+://(?:[^/@?#]*@)?[^/:?#]+(:\d+)', 1)"
    return f"CASE WHEN {p} IN (':80', ':443') THEN '' ELSE {p} END"


def number(c: str) -> str:
    t = rf"regexp_replace({c}, '[\s\x{{A0}}]', '', 'g')"
    n = rf"CASE WHEN regexp_full_match({t}, '-?\d{{1,3}}(\.\d{{3}})+(,\d+)?') THEN replace(replace({t}, '.', ''), ',', '.') WHEN regexp_full_match({t}, '-?\d{{1,3}}(,\d{{3}})+(\.\d+)?') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END"
    return rf"CASE WHEN regexp_full_match({n}, '[+-]?\d+(\.\d*)?') THEN try_cast({n} AS DOUBLE) END"


def folded(c: str) -> str:
    return rf"trim(regexp_replace(replace(replace(translate(lower(coalesce({c}, '')), 'åäáàâéèêëíìîïöóòôüúùûñçø', 'aaaaaeeeeiiiioooouuuunco'), 'æ', 'ae'), '&', ' og '), '[^a-z0-9]+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({folded(c)}, ' '), lambda x: length(x) >= 2 AND x NOT IN ('asa','ans','nuf','enk','sti','brl','as','da','sa')))"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x{{A0}}]+', ' ', 'g'))"


def form(c: str) -> str:
    last = f"upper(regexp_replace(string_split({collapse(c)}, ' ')[-1], '[./]', '', 'g'))"
    return f"CASE WHEN {last} IN ('ASA','ANS','NUF','ENK','STI','BRL','AS','DA','SA') THEN {last} END"


def no_form(c: str) -> str:
    return f"CASE WHEN {form(c)} IS NOT NULL THEN regexp_replace({collapse(c)}, ' ?[^ ]+$', '') ELSE {collapse(c)} END"


def check(c: str) -> str:
    total = " + ".join(f"try_cast(substr({c}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))
    return f"CASE WHEN (11 - ({total}) % 11) % 11 < 10 THEN CAST((11 - ({total}) % 11) % 11 AS INT) END"


def rank(key: str, seed: str = "spor") -> str:
    return f"sha256('{seed}:' || {key})"


def share(cond: str) -> str:
    return f"avg(CAST({cond} AS INT))"


TIDY = r"regexp_replace(lower(coalesce({}, '')), '[\s\x{{A0}}]', '', 'g')"
STRATUM = """concat_ws('|', CASE WHEN legal_form IN ('AS','ASA','ENK') THEN legal_form ELSE 'OTHER' END,
 CASE WHEN employees IS NULL THEN 'missing' WHEN employees = 0 THEN '0' WHEN employees < 5 THEN '1-4' WHEN employees < 20 THEN '5-19' WHEN employees < 100 THEN '20-99' ELSE '100+' END,
 CASE WHEN bankrupt OR liquidating THEN 'adverse' ELSE 'active' END, CASE WHEN website <> '' THEN 'web' ELSE 'no-web' END)"""
CAND = f"""{CO}, cd AS (SELECT result_id, d.organisation_number, url, coalesce(rank, 10000) AS rank,
 {tokens("name")} AS nt, {tokens("coalesce(title, '')")} AS tt, {tokens("coalesce(snippet, '')")} AS st, {tokens("municipality")} AS mt,
 regexp_replace({host("url")}, '[^a-z0-9]', '', 'g') AS h, replace({folded(no_form("name"))}, ' ', '') AS nc, contains(coalesce(title, '') || coalesce(snippet, ''), d.organisation_number) AS org
 FROM discovery_results d JOIN co ON co.organisation_number = d.organisation_number),
 cand AS (SELECT result_id, organisation_number, url, rank, CAST(least(100, CASE WHEN org THEN 75 ELSE 0 END
  + CASE WHEN list_has_all(tt, nt) THEN 45 WHEN list_has_all(list_concat(tt, st), nt) THEN 25 ELSE 0 END
  + CASE WHEN coalesce(contains(h, nc), false) THEN 30 ELSE 0 END + CASE WHEN list_has_all(st, mt) THEN 10 ELSE 0 END) AS INT) AS score FROM cd)"""
PUBLIC = rf"""coalesce(regexp_matches(lower(source_url), '^https?://') AND NOT regexp_matches(source_url, '^[^:]+://[^/?#]*@') AND contains({host("source_url")}, '.')
 AND NOT regexp_matches({host("source_url")}, '^(localhost|.*\.local|.*\.internal|\[|(0|10|127|22[4-9]|23\d|24\d|25[0-5]|169\.254|192\.168|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7]))\.\d[\d.]*$)') AND length(source_url) <= 2048, false)"""
PRESENT = """unnest([{}]) AS found"""


def presence(fields: dict[str, str]) -> str:
    parts = [f"SELECT organisation_number, '{g}' AS category, coalesce(trim(CAST({c} AS VARCHAR)), '') <> '' AS found FROM cx" for c, g in fields.items()]
    return "pr AS (" + " UNION ALL ".join(parts) + ")"


SQL = {
    "screen_filter_topk": """WITH l AS (SELECT o_custkey, count(*) AS orders, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS revenue FROM orders GROUP BY 1)
SELECT c_custkey, c_name, n_name, coalesce(orders, 0) AS orders, revenue FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON o_custkey = c_custkey
WHERE lower(n_name) = 'nation_7' AND coalesce(orders, 0) >= 2 AND revenue > 50000 ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 50""",
    "screen_companies": f"""WITH {CO} SELECT organisation_number, name, municipality, employees FROM co WHERE lower(legal_form) = 'as' AND employees >= 2 AND website <> ''
 AND contains(lower(concat_ws(' ', industry_code, industry_label)), 'elektro')""",
    "screen_plans": """SELECT CAST(a AS INT) AS position, b AS executable, CAST(c AS INT) AS criteria, d AS plan, e AS order_by, CAST(f AS INT) AS top, CAST(g AS INT) AS asked, h AS modules, i AS refused FROM (VALUES
 (0, true, 2, 'municipality eq OSLO;employees > 10', NULL, NULL, NULL, 'registry', ''), (1, true, 2, 'revenue > 2000000.0;annual_result > 0', NULL, NULL, NULL, 'financials', ''), (2, true, 2, 'annual_result < 0;accounts present True', NULL, NULL, NULL, 'financials', ''),
 (3, true, 0, '', 'employees', 100, 500, 'registry', ''), (4, false, 0, '', NULL, NULL, NULL, '', 'glassdoor;reviews'), (5, false, 0, '', NULL, NULL, NULL, '', '')) t(a, b, c, d, e, f, g, h, i)""",
    "screen_contains_casefold": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'widget')",
    "search_companies": f"""WITH {CO}, f AS (SELECT * FROM co WHERE contains(lower(organisation_number), 'regnskap') OR contains(lower(name), 'regnskap') OR contains(lower(municipality), 'regnskap') OR contains(lower(industry_label), 'regnskap'))
SELECT organisation_number, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY 1 LIMIT 25""",
    "bulk_lookup_left_fill": f"""WITH {CO}, w AS (SELECT DISTINCT organisation_number FROM discovery_results WHERE organisation_number IS NOT NULL)
SELECT organisation_number, coalesce(name, '') AS name, employees, co.organisation_number IS NOT NULL AS found FROM w LEFT JOIN co USING (organisation_number)""",
    "key_list_scan": r"""WITH d AS (SELECT regexp_replace(organisation_number, '\D', '', 'g') AS org, organisation_number FROM raw_claims) SELECT org, count(DISTINCT organisation_number) AS writings, count(*) AS rows FROM d WHERE length(org) = 9 GROUP BY 1""",
    "mod11_check": f"""SELECT DISTINCT organisation_number, {check("organisation_number")} AS check_digit,
 coalesce(CAST(substr(organisation_number, 9, 1) AS INT) = {check("organisation_number")}, false) AS valid FROM companies""",
    "key_comparison": r"""WITH d AS (SELECT regexp_replace(regexp_extract(lower(claim_key), 'org:([^|]*)', 1), '\D', '', 'g') AS a, organisation_number AS o, regexp_replace(organisation_number, '\D', '', 'g') AS b FROM raw_claims)
SELECT CASE WHEN length(a) <> 9 THEN 'invalid' WHEN o IS NULL OR trim(o) = '' THEN 'missing' WHEN length(b) <> 9 THEN 'invalid' WHEN a = b THEN 'exact' ELSE 'mismatch' END AS result, count(*) AS n FROM d GROUP BY 1""",
    "stable_claim_keys": r"""SELECT field_name, count_if('org:' || organisation_number || '|field:' || lower(field_name) || CASE WHEN contains(claim_key, '|entity:') THEN '|entity:' || regexp_extract(claim_key, '\|entity:(.*)$', 1) ELSE '' END = claim_key) AS same, count(*) AS n FROM snapshot_claims GROUP BY 1""",
    "snapshot_diff_claims": f"WITH {LAST} SELECT * FROM ch WHERE kind <> 'UNCHANGED'",
    "snapshot_diff_summary": rf"""WITH {LAST} SELECT version_from, version_to, regexp_extract(claim_key, '\|field:([^|]*)', 1) AS field, count_if(kind = 'ADDED') AS added, count_if(kind = 'REMOVED') AS removed, count_if(kind = 'MODIFIED') AS modified, count_if(kind = 'UNCHANGED') AS unchanged FROM ch GROUP BY 1, 2, 3""",
    "snapshot_membership": f"WITH {LAST} SELECT version_from, version_to, count_if(kind = 'REMOVED') AS only_before, count_if(kind = 'ADDED') AS only_after, count_if(kind IN ('MODIFIED', 'UNCHANGED')) AS in_both FROM ch GROUP BY 1, 2",
    "key_set_operations": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1997-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01')
SELECT 'both' AS part, count(*) AS customers FROM a JOIN b USING (o_custkey) UNION ALL SELECT 'early_only', count(*) FROM a ANTI JOIN b USING (o_custkey)
UNION ALL SELECT 'late_only', count(*) FROM b ANTI JOIN a USING (o_custkey) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "failclosed_merge": f"""WITH {LAST}, a AS (SELECT t, claim_key, last.source_module, last.value FROM last JOIN step ON version = f WHERE t IS NOT NULL), b AS (SELECT t, claim_key, source_module, value FROM last JOIN step ON version = t), n AS (SELECT * FROM b WHERE source_module NOT IN ('financials', 'roles'))
SELECT t AS version_to, claim_key, source_module, value, 'new' AS origin FROM n UNION ALL SELECT t, claim_key, source_module, value, 'carried over' FROM a WHERE source_module IN ('financials', 'roles') AND (t, claim_key) NOT IN (SELECT (t, claim_key) FROM n)""",
    "field_changes_by_year": """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(count(*) AS VARCHAR) AS orders, max(o_orderstatus) AS status, min(o_orderpriority) AS priority, CAST(CAST(max(o_totalprice) AS DECIMAL(12,2)) AS VARCHAR) AS largest FROM orders GROUP BY 1, 2),
 j AS (SELECT a.o_custkey, a.orders AS a1, b.orders AS b1, a.status AS a2, b.status AS b2, a.priority AS a3, b.priority AS b3, a.largest AS a4, b.largest AS b4 FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 1997 AND b.y = 1998)
SELECT o_custkey, 'orders' AS field, a1 AS before, b1 AS after FROM j WHERE a1 IS DISTINCT FROM b1 UNION ALL SELECT o_custkey, 'status', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2
UNION ALL SELECT o_custkey, 'priority', a3, b3 FROM j WHERE a3 IS DISTINCT FROM b3 UNION ALL SELECT o_custkey, 'largest', a4, b4 FROM j WHERE a4 IS DISTINCT FROM b4""",
    "workforce_materiality": rf"""WITH {LAST}, j AS (SELECT version_from, version_to, claim_key, {number("before")} AS before, {number("after")} AS after FROM ch WHERE kind IN ('MODIFIED', 'UNCHANGED') AND regexp_matches(claim_key, '\|field:employees(\||$)')),
 pc AS (SELECT *, after - before AS delta, CASE WHEN before = 0 THEN CASE WHEN after = 0 THEN 0.0 ELSE 100.0 END ELSE abs(after - before) * 100.0 / before END AS pct FROM j),
 m AS (SELECT *, coalesce((abs(delta) >= 10 AND pct >= 25) OR abs(delta) >= 50, false) AS material FROM pc)
SELECT version_from, version_to, claim_key, before, after, delta, CAST(round(pct, 4) AS DOUBLE) AS percent, material, CASE WHEN before IS NULL OR after IS NULL THEN 'unavailable' WHEN NOT material THEN 'none' WHEN pct >= 50 THEN 'high' ELSE 'medium' END AS severity FROM m""",
    "period_restatement": f"""WITH s AS (SELECT version, organisation_number, field_name, reporting_period, claim_id, {number("regexp_replace(upper(value), '[A-Z.]*[A-Z][A-Z.]*', '', 'g')")} AS amount FROM snapshot_claims WHERE field_name IN ('revenue', 'total_assets') AND reporting_period IS NOT NULL),
 l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY version, organisation_number, field_name, reporting_period ORDER BY claim_id DESC) = 1), step AS (SELECT version AS f, lead(version) OVER (ORDER BY version) AS t FROM (SELECT DISTINCT version FROM snapshot_claims)),
 a AS (SELECT f, t, organisation_number, field_name, reporting_period, amount, claim_id FROM l JOIN step ON version = f WHERE t IS NOT NULL), b AS (SELECT f, t, organisation_number, field_name, reporting_period, amount, claim_id FROM l JOIN step ON version = t),
 j AS (SELECT f, t, organisation_number, field_name, reporting_period, a.amount AS before, b.amount AS after, a.claim_id AS ai, b.claim_id AS bi FROM a FULL JOIN b USING (f, t, organisation_number, field_name, reporting_period))
SELECT f AS version_from, t AS version_to, organisation_number, field_name, reporting_period, before, after, CASE WHEN ai IS NULL THEN 'NEW_PERIOD' WHEN bi IS NULL THEN 'PERIOD_GONE' ELSE 'RESTATED' END AS change FROM j WHERE ai IS NULL OR bi IS NULL OR before IS DISTINCT FROM after""",
    "change_set_scores": f"""WITH {LAST}, x AS (SELECT {TIDY.format("before")} <> {TIDY.format("after")} AS real FROM ch WHERE kind = 'MODIFIED'),
 c AS (SELECT count_if(real) AS tp, count_if(NOT real) AS fp FROM x)
SELECT tp AS true_positive, fp AS false_positive, CAST(0 AS BIGINT) AS false_negative, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 1.0 END AS precision, CAST(1.0 AS DOUBLE) AS recall FROM c""",
    "false_change_rate": rf"""WITH {LAST}, x AS (SELECT regexp_extract(claim_key, '\|field:([^|]*)', 1) AS field, {TIDY.format("before")} = {TIDY.format("after")} AS same FROM ch WHERE kind = 'MODIFIED')
SELECT field, count(*) AS changes, count_if(same) AS false_changes, round({share("same")}, 6) AS rate FROM x GROUP BY 1""",
    "latest_record_per_key": f"""SELECT claim_key, {US.format("retrieved_at")} AS at, claim_id, value FROM claim_updates QUALIFY row_number() OVER (PARTITION BY claim_key ORDER BY CAST(retrieved_at AS TIMESTAMPTZ) DESC NULLS LAST, claim_id DESC) = 1""",
    "version_history": "SELECT claim_key, count(DISTINCT version) AS versions, min(version) AS first, max(version) AS last, count(*) AS rows FROM snapshot_claims GROUP BY 1",
    "hash_rank_sample": f"WITH {CO} SELECT organisation_number, {rank('organisation_number')} AS sample_rank FROM co ORDER BY 2, 1 LIMIT 200",
    "extension_sample": f"""WITH {CO} SELECT organisation_number, {rank("organisation_number")} AS sample_rank FROM co WHERE lower(name) NOT IN (SELECT lower(target_name) FROM name_comparisons WHERE target_name IS NOT NULL) ORDER BY 2, 1 LIMIT 100""",
    "stratum_counts": f"WITH {CO} SELECT {STRATUM} AS stratum, count(*) AS companies FROM co GROUP BY 1",
    "stratified_sample": f"""WITH {CO}, r AS (SELECT {STRATUM} AS stratum, organisation_number FROM co)
SELECT stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY {rank("organisation_number")}, organisation_number) AS INT) AS position, organisation_number FROM r QUALIFY position <= 5""",
    "sample_split": f"""WITH {CO}, s AS (SELECT organisation_number FROM co ORDER BY {rank("organisation_number")}, 1 LIMIT 500), p AS (SELECT *, CAST(row_number() OVER (ORDER BY {rank("organisation_number", "spor-split")}, organisation_number) AS INT) AS position, count(*) OVER () AS n FROM s)
SELECT organisation_number, position, CASE WHEN position <= round(n * 0.6) THEN 'development' WHEN position <= round(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM p""",
    "hash_split": f"""WITH {CO}, u AS (SELECT CAST(('0x' || substr({rank("organisation_number")}, 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM co)
SELECT CASE WHEN u < 0.6 THEN 'development' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS companies FROM u GROUP BY 1""",
    "dedup_first_per_host": f"""WITH {CO}, h AS (SELECT organisation_number, {host("website")} AS host, {rank("organisation_number")} AS sample_rank FROM co)
SELECT organisation_number, host, sample_rank FROM (SELECT * FROM h WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY sample_rank, organisation_number) = 1) ORDER BY sample_rank, organisation_number LIMIT 300""",
    "event_dedup_first_wins": "SELECT organisation_number, url, rank, result_id FROM discovery_results WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation_number, url ORDER BY rank NULLS LAST, result_id) = 1",
    "top_hosts": f"SELECT {host('url')} AS host, count(*) AS results FROM discovery_results WHERE {host('url')} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "channel_ranking": f"""WITH h AS (SELECT organisation_number, {host("url")} AS host, count(*) AS n FROM discovery_results WHERE organisation_number IS NOT NULL GROUP BY 1, 2)
SELECT organisation_number, host, n FROM h WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY n DESC, host) = 1""",
    "candidate_scores": f"WITH {CAND} SELECT result_id, organisation_number, score FROM cand",
    "best_candidate": f"WITH {CAND} SELECT organisation_number, result_id, score FROM cand WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY organisation_number ORDER BY score DESC, rank, url, result_id) = 1",
    "best_candidate_or_abstain": f"""WITH {CAND}, r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM cand WINDOW w AS (PARTITION BY organisation_number ORDER BY score DESC, result_id))
SELECT organisation_number, result_id, score FROM r WHERE k = 1 AND (nxt IS NULL OR nxt < score)""",
    "token_overlap_match": f"""WITH d AS (SELECT comparison_id, {tokens("target_name")} AS t, {tokens("source_name")} AS s FROM name_comparisons WHERE source_name IS NOT NULL), c AS (SELECT *, CAST(len(list_intersect(t, s)) AS INT) AS common FROM d)
SELECT comparison_id, common, CASE WHEN common = len(t) AND common = len(s) THEN 'same' WHEN common = len(s) THEN 'subset' WHEN common = len(t) THEN 'superset' WHEN common > 0 THEN 'partial' ELSE 'none' END AS kind FROM c""",
    "name_match_ladder": f"""WITH d AS (SELECT {collapse("target_name")} AS a, {collapse("coalesce(source_name, '')")} AS b FROM name_comparisons), e AS (SELECT a, b, {folded(no_form("a"))} AS fa, {folded(no_form("b"))} AS fb, {form("a")} AS la, {form("b")} AS lb FROM d)
SELECT CASE WHEN a = b THEN 'exact' WHEN fb = '' THEN 'empty' WHEN fa = fb AND la IS NOT DISTINCT FROM lb THEN 'normalized' WHEN fa = fb AND (la IS NULL OR lb IS NULL) THEN 'form_omitted' WHEN fa = fb THEN 'form_differs' ELSE 'different' END AS category, count(*) AS n FROM e GROUP BY 1""",
    "domain_suffix_join": f"""WITH {CO} SELECT DISTINCT result_id, d.organisation_number, {host("website")} AS own FROM discovery_results d JOIN co ON co.organisation_number = d.organisation_number WHERE {host("url")} = {host("website")} OR ends_with({host("url")}, '.' || {host("website")})""",
    "conflict_resolution": r"""WITH d AS (SELECT regexp_replace(organisation_number, '\D', '', 'g') AS org, lower(field_name) AS field, trim(value) AS original, lower(trim(value)) AS v, coalesce(source_authority, -1) AS a FROM raw_claims WHERE trim(value) <> ''),
 b AS (SELECT org, field, v, original, a FROM d WHERE length(org) = 9 QUALIFY row_number() OVER (PARTITION BY org, field, v ORDER BY a DESC, original) = 1), r AS (SELECT *, max(a) OVER (PARTITION BY org, field) AS top, count(*) OVER (PARTITION BY org, field) AS n FROM b)
SELECT org, field, arg_min(original, v) AS value, CAST(any_value(top) AS INT) AS authority, any_value(n) AS values, CASE WHEN any_value(n) = 1 THEN 'AVAILABLE' WHEN count(*) > 1 THEN 'CONFLICTING' ELSE 'RESOLVED' END AS status, CASE WHEN count(*) > 1 THEN arg_max(original, v) END AS other FROM r WHERE a = top GROUP BY 1, 2""",
    "leadership_best_row": f"""SELECT organisation_number, lower({collapse("value")}) AS person, coalesce(source_authority, -1) AS authority, claim_id FROM snapshot_claims WHERE field_name = 'managing_director' AND trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY organisation_number, person ORDER BY authority DESC, claim_id) = 1""",
    "profile_status": """SELECT organisation_number, count(*) AS modules, CASE WHEN bool_and(status = 'available') THEN 'complete' WHEN bool_or(status = 'available') THEN 'partial' WHEN bool_and(status = 'not_found') THEN 'not_found' WHEN bool_or(status IN ('blocked', 'source_error')) THEN 'unavailable' ELSE 'failed' END AS profile_status FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1""",
    "module_terminal_counts": "SELECT field, status, count(*) AS n, count(DISTINCT organisation_number) AS companies FROM evidence GROUP BY 1, 2",
    "coverage_by_category": f"""WITH {CO}, cx AS (SELECT * REPLACE (nullif(industry_code, '00.000') AS industry_code) FROM co),
 {presence({"name": "identity", "legal_form": "identity", "municipality": "place", "municipality_number": "place", "industry_code": "industry", "industry_label": "industry", "employees": "size", "website": "web", "latest_submitted_accounts": "accounts"})},
 c AS (SELECT organisation_number, category, count(*) AS n, count_if(found) AS k FROM pr GROUP BY 1, 2), s AS (SELECT organisation_number, CAST(sum(n) AS BIGINT) AS fields, CAST(sum(k) AS BIGINT) AS found, count(*) AS categories, count_if(k > 0) AS covered FROM c GROUP BY 1)
SELECT *, round(0.5 * found / fields + 0.5 * covered / categories, 4) AS rate FROM s""",
    "category_availability": f"""WITH {CO}, cx AS (SELECT * FROM co), {presence({"employees": "size", "website": "web", "industry_code": "industry", "latest_submitted_accounts": "accounts"})}
SELECT category, count_if(found) AS found, round({share("found")} * 100, 2) AS percent FROM pr GROUP BY 1""",
    "dashboard_top_municipalities": f"WITH {CO} SELECT municipality, count(*) AS companies, count_if(website <> '') AS with_website FROM co GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "missing_seed_antijoin": f"""WITH {CO} SELECT organisation_number, website, 'missing_event' AS error FROM co ANTI JOIN (SELECT organisation_number FROM evidence WHERE field = 'website' AND status = 'available') e USING (organisation_number) WHERE website <> ''""",
    "latency_quantiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY 1",
    "index_quantile_rules": """WITH s AS (SELECT event_type, list(value ORDER BY value) AS l, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, l[CAST(floor((n - 1) * 0.95) AS BIGINT) + 1] AS p95_floor, l[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95_index FROM s""",
    "domain_request_summary": f"""WITH h AS (SELECT {host("source_url")} AS host, count(*) AS requests FROM evidence GROUP BY 1) SELECT count(*) AS hosts, CAST(sum(requests) AS BIGINT) AS requests, quantile_disc(requests, 0.5) AS p50, quantile_disc(requests, 0.95) AS p95, max(requests) AS most FROM h WHERE host IS NOT NULL""",
    "request_grouping_sets": "SELECT source_type, status, count(*) AS n FROM evidence GROUP BY GROUPING SETS ((source_type), (status), ())",
    "duplicate_requests": "WITH k AS (SELECT field, row_number() OVER (PARTITION BY organisation_number, source_url, field ORDER BY evidence_id) AS k FROM evidence WHERE source_url IS NOT NULL) SELECT field, count(*) AS duplicates FROM k WHERE k > 1 GROUP BY 1",
    "failure_rates": f"SELECT source_type, count(*) AS n, round({share('''(status IN ('blocked', 'source_error'))''')}, 4) AS failed, round({share('''(status = 'available')''')}, 4) AS available FROM evidence GROUP BY 1",
    "running_budget": """WITH s AS (SELECT user_id, sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT user_id, count_if(spent <= 500) AS admitted, count_if(spent > 500) AS refused FROM s GROUP BY 1""",
    "reduced_mode_latch": """WITH s AS (SELECT user_id, bool_or(event_type = 'error' AND value > 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) SELECT user_id, count_if(r) AS reduced, count(*) AS n FROM s GROUP BY 1""",
    "score_deltas": """WITH b AS (SELECT user_id, ts, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events), g AS (SELECT *, best - coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gain FROM b)
SELECT user_id, count(*) AS steps, round(max(best), 2) AS best FROM g WHERE gain > 0 GROUP BY 1""",
    "strategy_metrics": """WITH s AS (SELECT event_type, count(*) AS attempts, count_if(CAST(value AS DECIMAL(12,2)) < 20) AS successes, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS cost, count(DISTINCT user_id) AS profiles FROM events GROUP BY 1)
SELECT *, round(successes / attempts, 6) AS success_rate, round(CAST(cost AS DOUBLE) / attempts, 4) AS cost_each FROM s""",
    "strategy_promotion": """WITH s AS (SELECT event_type, round(count_if(CAST(value AS DECIMAL(12,2)) < 20) / count(*), 6) AS rate, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS cost FROM events GROUP BY 1),
 j AS (SELECT b.event_type AS baseline, c.event_type AS challenger, c.rate < b.rate AS low, c.cost > b.cost * 1.1 AS dear FROM s b JOIN s c ON b.event_type <> c.event_type)
SELECT baseline, challenger, concat_ws(';', CASE WHEN low THEN 'lower_success' END, CASE WHEN dear THEN 'higher_cost' END) AS failed_gates, NOT low AND NOT dear AS promoted FROM j""",
    "ucb_strategy_order": """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT event_type, round(m + 0.35 * sqrt(ln((SELECT sum(n) FROM s) + 1) / (n + 1)), 4) AS priority FROM s)
SELECT event_type, priority, CAST(row_number() OVER (ORDER BY priority DESC, event_type) AS INT) AS position FROM p""",
    "footprint_rollup": """WITH d AS (SELECT user_id, count(*) AS signals, count(DISTINCT event_type) AS kinds, count_if(ts <= TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 15 DAY) AS fresh,
 CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(value AS DECIMAL(12,2)) END) AS DECIMAL(22,2)) AS engagement, count_if(event_type = 'purchase') AS good, count_if(event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT *, CASE WHEN good + bad >= 10 AND kinds >= 2 THEN round(50 + 50.0 * (good - bad) / (good + bad), 1) END AS score FROM d""",
    "label_vote": """WITH d AS (SELECT doc_id, count(DISTINCT labelled_by) AS j, min(toxic) AS lo, max(toxic) AS hi FROM content_labels GROUP BY 1) SELECT doc_id, CASE WHEN j < 2 THEN 'abstain' WHEN lo <> hi THEN 'mixed' WHEN hi = 1 THEN 'toxic' ELSE 'clean' END AS label FROM d""",
    "classifier_scores": """WITH d AS (SELECT CAST(lower(trim(source_name)) = lower(trim(target_name)) AS VARCHAR) AS g, CAST(is_acceptable_match AS VARCHAR) AS p FROM name_comparisons), l AS (SELECT unnest(['true', 'false']) AS label),
 c AS (SELECT label, count_if(g = label) AS support, count_if(p = label) AS predicted, count_if(g = label AND p = label) AS true_positive FROM l CROSS JOIN d GROUP BY 1),
 r AS (SELECT *, CASE WHEN predicted > 0 THEN true_positive / predicted ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN true_positive / support ELSE 0.0 END AS rc FROM c)
SELECT label, support, predicted, true_positive, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM r""",
    "score_histogram": f"WITH {CAND} SELECT score, count(*) AS n FROM cand GROUP BY 1",
    "completeness_score": f"""WITH {CO}, e AS (SELECT organisation_number, count(DISTINCT field) AS modules FROM evidence WHERE status = 'available' AND organisation_number IS NOT NULL GROUP BY 1)
SELECT organisation_number, CASE WHEN coalesce(trim(name), '') <> '' THEN 10 ELSE 0 END + CASE WHEN employees IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN coalesce(trim(website), '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(trim(latest_submitted_accounts), '') <> '' THEN 5 ELSE 0 END + least(30, 5 * coalesce(modules, 0)) AS points FROM co LEFT JOIN e USING (organisation_number)""",
    "validation_reasons": f"""WITH r AS (SELECT evidence_id, concat_ws(';', CASE WHEN organisation_number IS NULL THEN 'no_organisation' END, CASE WHEN NOT {PUBLIC} THEN 'no_url' END, CASE WHEN source_class IS NULL THEN 'unknown_class' END, CASE WHEN status = 'available' AND content_sha256 IS NULL THEN 'no_hash' END,
 CASE WHEN NOT regexp_full_match(content_sha256, '[0-9a-f]{{64}}') THEN 'bad_hash' END, CASE WHEN confidence < 0.35 THEN 'low_confidence' END, CASE WHEN validation_status = 'rejected' THEN 'rejected' END) AS reasons FROM evidence)
SELECT evidence_id, reasons, reasons = '' AS accepted FROM r""",
    "provenance_claim_ids": "SELECT evidence_id, substr(sha256(coalesce(organisation_number, '') || '|' || coalesce(field, '') || '|' || coalesce(source_url, '') || '|' || coalesce(content_sha256, '')), 1, 24) AS claim_hash FROM evidence",
    "source_policy_join": """WITH p AS (SELECT regexp_replace(lower(source_class), '[^a-z]', '', 'g') AS k, source_authority FROM source_catalog), e AS (SELECT regexp_replace(lower(source_class), '[^a-z]', '', 'g') AS k, confidence FROM evidence)
SELECT CASE WHEN source_authority >= 90 THEN 'official' WHEN source_authority >= 60 THEN 'first_party' WHEN source_authority IS NOT NULL THEN 'third_party' ELSE 'unknown' END AS tier, count(*) AS n, round(avg(CAST(CAST(confidence AS DECIMAL(6,3)) AS DOUBLE)), 3) AS confidence FROM e LEFT JOIN p USING (k) GROUP BY 1""",
    "freshness_window": f"""WITH d AS (SELECT ({US.format("TIMESTAMPTZ '2025-06-01 00:00:00+00'")} - {US.format("retrieved_at")}) / 86400000000 AS age FROM raw_claims)
SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age < 0 THEN 'future' WHEN age <= 45 THEN 'fresh' WHEN age <= 365 THEN 'aging' ELSE 'stale' END AS band, count(*) AS n FROM d GROUP BY 1""",
    "cache_hit_split": """WITH w AS (SELECT organisation_number, field, bool_or(status = 'available') AS hit FROM evidence WHERE organisation_number IS NOT NULL GROUP BY 1, 2) SELECT field, count_if(hit) AS hits, count_if(NOT coalesce(hit, false)) AS pending FROM w GROUP BY 1""",
    "cache_keys": "SELECT DISTINCT organisation_number, 'cache-' || substr(sha256(organisation_number || '|registry|1'), 1, 24) AS cache_key FROM companies",
    "recommended_tasks": f"""WITH {CO}, t AS (SELECT organisation_number, 'find_website' AS kind, 1 AS priority FROM co WHERE website = '' UNION ALL SELECT organisation_number, 'find_employees', 2 FROM co WHERE employees IS NULL UNION ALL SELECT organisation_number, 'find_accounts', 3 FROM co WHERE coalesce(latest_submitted_accounts, '') = '')
SELECT *, substr(sha256(organisation_number || '|' || kind), 1, 24) AS task_id FROM t""",
    "claim_fingerprints": """WITH h AS (SELECT version, sha256(coalesce(claim_key, '~') || '|' || coalesce(value, '~') || '|' || coalesce(retrieved_at, '~')) AS h FROM snapshot_claims)
SELECT version, count(*) AS rows, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM h GROUP BY 1""",
    "url_canonical": rf"""WITH d AS (SELECT DISTINCT organisation_number, website FROM companies WHERE website <> ''), h AS (SELECT *, {host("website")} AS host FROM d)
SELECT organisation_number, website, 'https://' || host || {port("website")} || regexp_replace({url_path("website")}, '/+$', '') AS url, host, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] ELSE host END AS label FROM h""",
    "url_safety": f"SELECT {PUBLIC} AS public, count(*) AS n FROM evidence GROUP BY 1",
    "org_numbers_in_text": rf"""WITH t AS (SELECT 'result' AS origin, result_id AS id, concat_ws(' ', query, title, snippet) AS t FROM discovery_results UNION ALL SELECT 'document', doc_id, coalesce(text, '') FROM documents),
 d AS (SELECT origin, id, unnest(list_distinct(list_transform(regexp_extract_all(t, '\b(\d{{9}}|\d{{3}}[ \x{{A0}}]\d{{3}}[ \x{{A0}}]\d{{3}})\b', 1), lambda x: regexp_replace(x, '\D', '', 'g')))) AS org FROM t)
SELECT origin, id, org, coalesce(CAST(substr(org, 9, 1) AS INT) = {check("org")}, false) AS valid FROM d""",
    "mail_addresses_in_text": r"""WITH d AS (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1))) AS m FROM documents), e AS (SELECT regexp_extract(m, '@(.*)$', 1) AS domain FROM d WHERE regexp_full_match(m, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'))
SELECT domain, count(*) AS n FROM e WHERE domain <> '' GROUP BY 1""",
    "phone_numbers_in_text": r"""WITH d AS (SELECT source, replace(substr(unnest(regexp_extract_all(coalesce(text, ''), '(\+47 \d{3} \d{2} \d{3})', 1)), 4), ' ', '') AS p FROM documents), q AS (SELECT source, '+47 ' || substr(p, 1, 2) || ' ' || substr(p, 3, 2) || ' ' || substr(p, 5, 2) || ' ' || substr(p, 7, 2) AS p FROM d)
SELECT source, count(*) AS phones, count(DISTINCT p) AS numbers, min(p) AS first FROM q GROUP BY 1""",
    "address_parts": rf"""WITH d AS (SELECT {collapse("value")} AS t FROM snapshot_claims WHERE field_name = 'business_address' AND trim(value) <> ''), a AS (SELECT nullif(regexp_extract(t, '^(.*?),? *\b(\d{{4}}) +([^\d]+)$', 2), '') AS pc, nullif(trim(regexp_extract(t, '^(.*?),? *\b(\d{{4}}) +([^\d]+)$', 3)), '') AS city FROM d)
SELECT substr(pc, 1, 2) AS region, count(*) AS n, count(DISTINCT lower(city)) AS cities FROM a GROUP BY 1""",
    "legal_form_of_names": f"WITH {CO} SELECT legal_form, {form('name')} AS in_name, count(*) AS n FROM co GROUP BY 1, 2",
    "flexible_dates": r"""SELECT claim_id, CAST(CASE WHEN regexp_matches(trim(effective_date), '^\d{4}-\d\d-\d\d([T ].*)?$') THEN try_cast(substr(trim(effective_date), 1, 10) AS DATE)
 WHEN regexp_matches(trim(effective_date), '^\d{8}$') THEN try_cast(substr(trim(effective_date), 1, 4) || '-' || substr(trim(effective_date), 5, 2) || '-' || substr(trim(effective_date), 7, 2) AS DATE)
 WHEN regexp_matches(trim(effective_date), '^\d\d[./]\d\d[./]\d{4}( .*)?$') THEN try_cast(substr(trim(effective_date), 7, 4) || '-' || substr(trim(effective_date), 4, 2) || '-' || substr(trim(effective_date), 1, 2) AS DATE) END AS VARCHAR) AS day FROM claim_updates""",
    "amount_parse": f"""SELECT claim_id, {number("regexp_replace(upper(value), '[A-Z.]*[A-Z][A-Z.]*', '', 'g')")} AS amount, CASE WHEN contains(upper(value), 'EUR') THEN 'EUR' WHEN contains(upper(value), 'USD') THEN 'USD' ELSE 'NOK' END AS currency FROM claim_updates WHERE field_name IN ('revenue', 'total_assets')""",
    "json_path_read": "WITH d AS (SELECT field, value ->> '$.municipality' AS town, CAST(value ->> '$.records' AS INT) AS records FROM evidence) SELECT field, count(records) AS n, CAST(sum(records) AS BIGINT) AS records, count(DISTINCT town) AS towns FROM d GROUP BY 1",
    "event_props_read": "WITH d AS (SELECT event_type, CAST(props ->> '$.k' AS INT) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS lo, max(k) AS hi, CAST(sum(k) AS BIGINT) AS total FROM d GROUP BY 1",
    "profile_merge_events": """SELECT user_id, nullif(count_if(event_type = 'click'), 0) AS click, nullif(count_if(event_type = 'error'), 0) AS error, nullif(count_if(event_type = 'purchase'), 0) AS purchase, nullif(count_if(event_type = 'signup'), 0) AS signup, nullif(count_if(event_type = 'view'), 0) AS view,
 arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1""",
    "multi_source_parts": """SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, arg_max(l_suppkey, (l_quantity, l_shipdate, l_suppkey, l_orderkey, l_linenumber)) AS best_supplier, max(l_quantity) AS best_quantity FROM lineitem GROUP BY 1""",
    "order_value_rollup": """SELECT r_name, n_name, count(*) AS lines, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "stream_budget_state": """WITH s AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
SELECT user_id, count_if(spent <= 50000) AS admitted, count_if(spent > 50000) AS refused, CAST(sum(c) AS BIGINT) AS spent_cents FROM s GROUP BY 1""",
    "research_candidates": rf"""WITH d AS (SELECT organisation_number, 'https://' || {host("url")} || {port("url")} || regexp_replace(regexp_replace({url_path("url")}, '/{{2,}}', '/', 'g'), '/$', '') AS url_key, rank, result_id FROM discovery_results WHERE organisation_number IS NOT NULL AND {host("url")} IS NOT NULL),
 f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY organisation_number, url_key ORDER BY rank NULLS LAST, result_id) = 1),
 s AS (SELECT *, CAST(round(least(1.0, greatest(0.1, 0.9 - 0.05 * (coalesce(rank, 20) - 1))), 4) AS DOUBLE) AS score FROM f)
SELECT organisation_number, url_key, rank, score, CAST(row_number() OVER (PARTITION BY organisation_number ORDER BY score DESC, rank NULLS LAST, url_key) AS INT) AS place FROM s""",
    "source_rule_lookup": f"""WITH h AS (SELECT {host("source_url")} AS h FROM evidence WHERE source_url IS NOT NULL), d AS (SELECT CASE WHEN h = 'official-registry.kilde.example' OR ends_with(h, '.official-registry.kilde.example') THEN 'official-registry.kilde.example' WHEN h = 'kilde.example' OR ends_with(h, '.kilde.example') THEN 'kilde.example' WHEN h = 'example' THEN 'example' END AS domain FROM h)
SELECT CASE domain WHEN 'official-registry.kilde.example' THEN 'open' WHEN 'kilde.example' THEN 'licensed' WHEN 'example' THEN 'unknown' END AS licence, domain, count(*) AS n FROM d GROUP BY 1, 2""",
    "exact_title_match": f"""WITH {CO} SELECT result_id, contains(' ' || {folded("title")} || ' ', ' ' || {folded("name")} || ' ') AS in_title FROM discovery_results d JOIN co ON co.organisation_number = d.organisation_number WHERE title IS NOT NULL""",
    "search_ambiguity": f"""WITH {CO}, d AS (SELECT co.organisation_number, contains(coalesce(query, ''), co.organisation_number) AS k, {folded(no_form("name"))} = {folded(no_form("coalesce(title, '')"))} AS n FROM discovery_results r JOIN co ON co.organisation_number = r.organisation_number),
 g AS (SELECT organisation_number, count_if(k) AS exact, count_if(n) AS named FROM d GROUP BY 1) SELECT *, exact <> 1 AND named > 1 AS ambiguous FROM g""",
    "cost_shares": """WITH g AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1), s AS (SELECT *, round(total / sum(total) OVER (), 4) AS share FROM g) SELECT *, share >= 0.2 AS bottleneck FROM s""",
    "evidence_identity": rf"""WITH {CO}, e AS (SELECT evidence_id, e.organisation_number AS org, {tokens("name")} AS want, {tokens("concat_ws(' ', source_title, evidence_excerpt)")} AS seen, lower(concat_ws(' ', source_title, evidence_excerpt)) AS t,
  regexp_extract_all(regexp_replace(coalesce(evidence_excerpt, ''), '(\d)[\s\x{{A0}}](\d)', '\1\2', 'g'), '\b(\d{{9}})\b', 1) AS nums FROM evidence e JOIN co ON co.organisation_number = e.organisation_number),
 s AS (SELECT *, len(list_intersect(want, seen)) / greatest(len(want), 1) AS share FROM e),
 c AS (SELECT evidence_id, CASE WHEN regexp_matches(t, 'domain (is )?for sale|parked domain|domenet er til salgs|under construction') THEN 0.1 WHEN list_contains(nums, org) AND share > 0 THEN 1.0 WHEN list_contains(nums, org) THEN 0.95 WHEN len(nums) > 0 THEN 0.1
  WHEN share = 1 THEN 0.85 WHEN share >= 0.5 THEN 0.65 WHEN share > 0 THEN 0.35 ELSE 0.1 END AS score FROM s)
SELECT evidence_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'verified' WHEN score >= 0.65 THEN 'review' ELSE 'rejected' END AS status FROM c""",
    "profile_facts": f"""WITH {CO} SELECT organisation_number, CAST((employees IS NOT NULL)::INT + (nullif(website, '') IS NOT NULL)::INT + (municipality IS NOT NULL)::INT AS INT) AS facts, concat_ws(';', CASE WHEN employees IS NULL THEN 'employees are not reported' END, CASE WHEN website = '' THEN 'no website is registered' END) AS notes FROM co""",
    "canonical_values": r"""SELECT field, count(DISTINCT (trim(regexp_replace(value ->> '$.municipality', '\s+', ' ', 'g')), value ->> '$.records')) FILTER (value IS NOT NULL) AS values FROM evidence GROUP BY 1""",
}
