"""DuckDB SQL for the queries of catalogue_text."""

from sporlake.catalogue_records_sql import blank
from sporlake.catalogue_sql import CO, check, collapse, folded, form, host, no_form, tokens, url_path
from sporlake.functions.marks import MONTHS, ROLES, day_pattern, words_pattern


def ladder(rules: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{n}'" for n, c in rules.items()) + f" ELSE '{otherwise}' END"


def query_text(c: str) -> str:
    return f"regexp_extract({c}, '\\?([^#]*)', 1)"


def label(h: str) -> str:
    return f"CASE WHEN len(string_split({h}, '.')) > 1 THEN string_split({h}, '.')[-2] ELSE {h} END"


def role_is(t: str, r: str) -> str:
    return f"regexp_matches(lower({t}), '{words_pattern(ROLES[r])}')"


PATH = f"lower(regexp_replace({url_path('url')}, '/+$', ''))"
SOCIAL = " OR ".join(f"({host('url')} = '{d}' OR ends_with({host('url')}, '.{d}'))" for d in ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com"))
VALID = rf"coalesce(regexp_full_match(org, '\d{{9}}') AND CAST(substr(org, 9, 1) AS INT) = {check('org')}, false)"

SQL = {
    "page_head_counts": r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\b(\d{1,3}(?:[ \x{A0}.]\d{3})+|\d{1,6}) (?:ansatte|medarbeidere|employees|people)\b', 1), lambda x: CAST(regexp_replace(x, '[^\d]', '', 'g') AS BIGINT)) AS n FROM documents)
SELECT doc_id, CAST(len(n) AS INT) AS named, n[1] AS first, list_max(n) AS largest FROM d WHERE len(n) > 0""",
    "page_contacts": r"""WITH d AS (SELECT source, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '((?:\+47|0047)[ \x{A0}]?\d(?:[ \x{A0}]?\d){7})(?:\D|$)', 1), lambda x: right(regexp_replace(x, '\D', '', 'g'), 8))) AS p, regexp_extract_all(coalesce(text, ''), ', (\d{4} [A-ZÆØÅ][a-zæøå]+)', 1) AS t FROM documents)
SELECT source, count(*) AS documents, CAST(sum(len(p)) AS BIGINT) AS phones, count_if(len(p) > 0) AS with_phone, CAST(sum(len(t)) AS BIGINT) AS towns, count_if(len(t) > 0) AS with_town FROM d GROUP BY 1""",
    "page_roles": "WITH d AS (" + " UNION ALL ".join(f"SELECT lang, '{r}' AS role FROM documents WHERE {role_is('text', r)}" for r in ROLES) + ") SELECT lang, role, count(*) AS documents FROM d GROUP BY 1, 2",
    "leadership_roles": f"WITH t AS (SELECT title AS t FROM discovery_results WHERE title IS NOT NULL UNION ALL SELECT replace(field_name, '_', ' ') FROM snapshot_claims) SELECT {ladder({r: role_is('t', r) for r in ROLES}, 'OTHER')} AS role, count(*) AS n FROM t GROUP BY 1",
    "page_descriptions": r"""WITH d AS (SELECT doc_id, regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '([^.!?]{60,}[.!?])', 1) AS d FROM documents) SELECT doc_id, substr(trim(d), 1, 300) AS description FROM d WHERE d <> ''""",
    "text_days": rf"""WITH d AS (SELECT doc_id, CAST(published_at AS DATE) AS seen, lower(text) AS t FROM documents), p AS (SELECT *, regexp_extract(t, '{day_pattern()}', 1) AS dd, regexp_extract(t, '{day_pattern()}', 2) AS mm, regexp_extract(t, '{day_pattern()}', 3) AS yy FROM d),
 m AS (SELECT *, try_cast(yy || '-' || lpad(CAST(CASE mm {" ".join(f"WHEN '{m}' THEN {k}" for m, k in MONTHS.items())} END AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day FROM p WHERE mm <> '')
SELECT doc_id, CAST(day AS VARCHAR) AS day, day BETWEEN DATE '2000-01-01' AND DATE '2026-01-01' AND (regexp_matches(t, 'publisert|published|pressemelding|press release') OR NOT coalesce(day = seen, false)) AS valid FROM m WHERE day IS NOT NULL""",
    "search_payload_rows": f"""SELECT organisation_number, provider, CAST(row_number() OVER (PARTITION BY organisation_number, provider ORDER BY result_id) AS INT) AS rank, result_id, title, snippet FROM discovery_results WHERE organisation_number IS NOT NULL AND {host("url")} IS NOT NULL""",
    "feed_items": f"""WITH {CO} SELECT d.organisation_number, doc_id, CAST(year(published_at) AS INT) AS year FROM documents d JOIN co ON co.organisation_number = d.organisation_number WHERE title IS NOT NULL AND year(published_at) BETWEEN 2015 AND 2026
 AND {folded(no_form("name"))} <> '' AND contains(' ' || {folded("title")} || ' ', ' ' || {folded(no_form("name"))} || ' ')""",
    "rating_nodes": """WITH r AS (SELECT l_returnflag, CAST(round(l_discount * 40 + 1, 1) AS DOUBLE) AS rating, CAST(l_quantity AS INT) AS reviews FROM lineitem)
SELECT l_returnflag, CASE WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive' ELSE 'neutral' END AS label, count(*) AS n, CAST(sum(reviews) AS BIGINT) AS reviews FROM r WHERE reviews > 0 GROUP BY 1, 2""",
    "job_board_hits": rf"""WITH d AS (SELECT {host("url")} AS h, {PATH} AS p, lower({query_text("url")}) AS q FROM discovery_results WHERE url IS NOT NULL)
SELECT {ladder({"search_page": r"regexp_matches(p, '/(sok|search)\b') OR regexp_matches(q, '(^|&)(q|sok|search)=')", "posting": "regexp_matches(p, '/(stilling|stillinger|jobs?|jobb|careers?|karriere)(/|$)')", "board_front": r"regexp_matches(h, '(^|\.)(jobb|karriere|finn|jobbnorge)') AND p = ''"}, "none")} AS kind, count(*) AS n FROM d GROUP BY 1""",
    "news_candidates": rf"""WITH d AS (SELECT {host("url")} AS h, {SOCIAL} AS soc, coalesce({PATH}, '') AS p, url, lower(trim(coalesce(title, ''))) AS t, lower(coalesce(snippet, '')) AS s FROM discovery_results)
SELECT {ladder({"no_address": "h IS NULL", "social": "soc AND p <> ''", "section": "p IN ('', '/nyheter', '/news', '/presse', '/press', '/aktuelt', '/blogg', '/blog')", "navigation": r"regexp_matches(p, '^/(produkter|products?|tjenester|services?|om-oss|about|kontakt|contact|priser|hjem|home)\b')", "generic_title": "t IN ('nyheter', 'news', 'aktuelt', 'presse', 'forside', 'hjem', 'om oss', 'kontakt', '')", "news_path": "regexp_matches(p, '/(nyheter|news|artikkel|article|presse|press)/')", "news_words": "regexp_matches(t || ' ' || s, 'pressemelding|press release|lanserer|kontrakt|oppkjøp')"}, "other")} AS why, count(*) AS n FROM d GROUP BY 1""",
    "scored_sites": f"""WITH {CO}, j AS (SELECT result_id, co.organisation_number AS org, lower(concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''))) AS text, {tokens("name")} AS nt, {tokens("concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''))")} AS w, {tokens("municipality")} AS mt, {host("url")} AS h, {host("website")} AS own, lower(regexp_replace(industry_label, '^Virksomhet innen ', '')) AS trade
 FROM discovery_results d JOIN co ON co.organisation_number = d.organisation_number), s AS (SELECT result_id, CAST(least(100, CASE WHEN contains(text, org) THEN 40 ELSE 0 END + CASE WHEN list_has_all(w, nt) THEN 35 ELSE 0 END + CASE WHEN coalesce(h = own, false) THEN 20 ELSE 0 END + CASE WHEN list_has_all(w, mt) THEN 10 ELSE 0 END + CASE WHEN coalesce(contains(text, trade), false) THEN 10 ELSE 0 END) AS INT) AS score FROM j)
SELECT result_id, score, score >= 70 AS accepted FROM s""",
    "org_number_diagnostics": rf"""WITH d AS (SELECT organisation_number AS o, regexp_replace(coalesce(organisation_number, ''), '\D', '', 'g') AS org FROM raw_claims)
SELECT {ladder({"missing": blank("o"), "no_digits": "org = ''", "wrong_length": "length(org) <> 9", "bad_check_digit": f"NOT {VALID}", "clean": "o = org", "prefixed": r"regexp_matches(upper(o), '^\s*NO|MVA\s*$')"}, "spaced")} AS kind, count(*) AS n FROM d GROUP BY 1""",
    "domain_relations": f"""WITH {CO}, d AS (SELECT {host("website")} AS a, {host("url")} AS b FROM discovery_results r JOIN co ON co.organisation_number = r.organisation_number)
SELECT {ladder({"unknown": "a IS NULL OR b IS NULL", "same": "a = b", "subdomain": "ends_with(b, '.' || a)", "parent": "ends_with(a, '.' || b)", "same_label": f"{label('a')} = {label('b')}"}, "other")} AS relation, count(*) AS n FROM d GROUP BY 1""",
    "contradictions": r"""WITH d AS (SELECT regexp_replace(organisation_number, '\D', '', 'g') AS org, lower(field_name) AS field, lower(trim(value)) AS v, max(coalesce(source_authority, -1)) AS a FROM raw_claims WHERE trim(value) <> '' GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY org, field ORDER BY a DESC, v) AS k, count(*) OVER (PARTITION BY org, field) AS n, lead(a) OVER (PARTITION BY org, field ORDER BY a DESC, v) AS nxt FROM d WHERE length(org) = 9)
SELECT org, field, n - 1 AS others, CASE WHEN a > nxt THEN v END AS resolved, CASE WHEN a > nxt THEN 'RESOLVED' ELSE 'UNCERTAIN' END AS status FROM r WHERE k = 1 AND n > 1""",
    "evidence_support": rf"""WITH d AS (SELECT lower(regexp_replace(trim(field_name), '[\s-]+', '_', 'g')) AS field, {ladder({"missing": "r.evidence_id IS NULL", "contradicted": "verdict = 'unsupported'", "supported": "verdict = 'supported' AND validation_status = 'accepted'", "partial": "validation_status = 'accepted'"}, "unsupported")} AS k FROM (SELECT field_name, evidence_id FROM raw_claims) r LEFT JOIN (SELECT evidence_id, verdict, validation_status FROM evidence) e USING (evidence_id))
SELECT field, count(*) AS claims, count_if(k = 'supported') AS supported, count_if(k = 'partial') AS partial, count_if(k = 'unsupported') AS unsupported, count_if(k = 'contradicted') AS contradicted, count_if(k = 'missing') AS missing, round((count_if(k = 'supported') + CAST(0.5 AS DOUBLE) * count_if(k = 'partial')) / count(*), 4) AS validity FROM d GROUP BY 1""",
    "evidence_validity": f"""WITH c AS (SELECT {host("source_url")} IS NOT NULL AS u, NOT ({blank("retrieved_at")}) AS t, coalesce(regexp_full_match(content_sha256, '[0-9a-f]{{64}}'), false) AS h FROM evidence) SELECT count(*) AS items, count_if(u) AS with_url, count_if(t) AS with_time, count_if(h) AS with_hash, round(avg(CAST(u AND t AND h AS INT)), 6) AS valid_rate FROM c""",
    "entity_pages": rf"""WITH {CO}, d AS (SELECT d.organisation_number AS org, name, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '\b(\d{{9}})\b', 1) AS n FROM documents d JOIN co ON co.organisation_number = d.organisation_number),
 g AS (SELECT org, count(*) AS pages, bool_or(regexp_matches(lower(t), 'domain (is )?for sale|parked domain|domenet er til salgs')) AS parked, bool_or(list_contains(n, org) AND length(t) >= 20) AS own, bool_or(len(n) > 0 AND NOT list_contains(n, org)) AS other, bool_or(contains(lower(t), lower({no_form("name")})) AND length(t) >= 50) AS named FROM d GROUP BY 1)
SELECT org AS organisation_number, pages, {ladder({"parked": "parked", "verified_by_number": "own", "abstain_other_number": "other", "verified_by_name": "named"}, "abstain")} AS verdict FROM g""",
    "name_verdicts": f"""WITH d AS (SELECT comparison_id, {collapse("target_name")} AS a, {collapse("coalesce(source_name, '')")} AS b FROM name_comparisons), e AS (SELECT comparison_id, a, b, {folded(no_form("a"))} AS fa, {folded(no_form("b"))} AS fb, {form("a")} AS la, {form("b")} AS lb, {tokens("a")} AS ta, {tokens("b")} AS tb FROM d), f AS (SELECT *, CAST(len(list_intersect(ta, tb)) AS INT) AS n FROM e)
SELECT comparison_id, {ladder({"empty": "fb = ''", "exact": "a = b", "same_core_form_differs": "fa = fb AND la IS NOT NULL AND lb IS NOT NULL AND la <> lb", "same_core": "fa = fb", "reordered": "n = len(ta) AND n = len(tb)", "part": "n = len(tb) OR n = len(ta)", "shared_words": "n > 0"}, "different")} AS category, n AS shared FROM f""",
    "source_tiers": rf"""WITH d AS (SELECT organisation_number, {host("source_url")} AS h, lower(regexp_replace(coalesce(source_class, source_type), '[^\p{{L}}]', '', 'g')) AS s FROM evidence)
SELECT {ladder({"register": "s = 'officialregistry' OR starts_with(h, 'official-registry.')", "filing": "s = 'officialfiling'", "own": "s IN ('companyowned', 'structuredmarkup')", "press": "s IN ('newspublisher', 'partnerwire')", "search": "s = 'searchresult'"}, "third_party")} AS tier, count(*) AS n, count(DISTINCT organisation_number) AS companies FROM d GROUP BY 1""",
    "publishable_sites": """WITH w AS (SELECT evidence_id, status, concat_ws('; ', CASE WHEN NOT coalesce(identity_match, false) THEN 'identity not shown' END, CASE WHEN coalesce(confidence, 0.0) < 0.35 THEN 'low confidence' END, CASE WHEN verdict = 'unsupported' THEN 'not supported' END) AS reason FROM evidence WHERE field = 'website')
SELECT evidence_id, CASE WHEN reason <> '' THEN 'not_found' ELSE status END AS status, reason FROM w""",
}
