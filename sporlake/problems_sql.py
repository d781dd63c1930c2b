"""The same results by DuckDB SQL, where SQL can express them."""


def canonical_sql(v: str) -> str:
    """Layers that turn column ``v`` of table ``src`` into column ``c``; see functions.canonical for the rules."""
    return rf"""
 s1 AS (SELECT *, trim(regexp_replace(lower(nfc_normalize(coalesce({v}, ''))), '[\s\p{{Z}}]+', ' ', 'g')) AS s FROM src),
 s2 AS (SELECT *, regexp_replace(regexp_replace(s, '^(nok|kr\.?) ?| ?(nok|kr\.?)$', '', 'g'), '[ +]', '', 'g') AS n FROM s1),
 s3 AS (SELECT *, CASE
    WHEN regexp_full_match(n, '-?\d{{1,3}}(\.\d{{3}})+(,\d*)?') THEN replace(replace(n, '.', ''), ',', '.')
    WHEN regexp_full_match(n, '-?\d{{1,3}}(,\d{{3}})+(\.\d*)?') THEN replace(n, ',', '')
    WHEN regexp_full_match(n, '-?\d+,\d*') THEN replace(n, ',', '.') ELSE n END AS m FROM s2),
 canon AS (SELECT *, CASE
    WHEN regexp_full_match(s, '\d{{4}}-\d\d-\d\d([t ]00:00(:00([.,]0+)?)?( ?(z|utc|[+-]00:?00))?)?') THEN replace(substr(s, 1, 10), '-', '')
    WHEN regexp_full_match(s, '\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}') THEN
      regexp_extract(s, '(\d{{4}})$', 1) || lpad(regexp_extract(s, '^\d+.(\d+)', 1), 2, '0') || lpad(regexp_extract(s, '^(\d+)', 1), 2, '0')
    WHEN regexp_full_match(s, '((nok|kr\.?) ?)?[+-]? ?\d[\d .,]*( ?(nok|kr\.?))?') THEN
      rtrim(CASE WHEN contains(m, '.') THEN regexp_replace(m, '(\.\d*?)0*$', '\1') ELSE m END, '.')
    WHEN s IN ('true', 'yes', 'ja', 'sann') THEN '1'
    WHEN s IN ('false', 'no', 'nei', 'usann') THEN '0'
    WHEN regexp_full_match(s, 'https?://\S+|www\.\S+|[^\s/@]+\.[a-z][^\s/@]+(/\S*)?') THEN
      regexp_replace(regexp_replace(s, '^(https?://)?(www\.)?', ''), '(:80|:443)?/*$', '')
    ELSE s END AS c FROM s3)"""


def _day(e: str) -> str:
    return rf"""coalesce(CASE
    WHEN regexp_matches(trim({e}), '^\d{{4}}-\d\d-\d\d([T ].*)?$') THEN try_cast(substr(trim({e}), 1, 10) AS DATE)
    WHEN regexp_matches(trim({e}), '^\d{{8}}([T ].*)?$') THEN try_cast(substr(trim({e}), 1, 4) || '-' || substr(trim({e}), 5, 2) || '-' || substr(trim({e}), 7, 2) AS DATE)
    WHEN regexp_matches(trim({e}), '^\d\d[./]\d\d[./]\d{{4}}( .*)?$') THEN try_cast(substr(trim({e}), 7, 4) || '-' || substr(trim({e}), 4, 2) || '-' || substr(trim({e}), 1, 2) AS DATE)
    END, CAST(CAST(retrieved_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE))"""


SQL = {
    "p3_found": f"""
WITH src AS (SELECT version, claim_key, value, CAST(retrieved_at AS TIMESTAMPTZ) AS seen, claim_id FROM snapshot_claims),
{canonical_sql("value")},
 w AS (SELECT version, claim_key, c FROM canon QUALIFY row_number() OVER (PARTITION BY version, claim_key ORDER BY seen DESC NULLS LAST, claim_id) = 1),
 v AS (SELECT version, lead(version) OVER (ORDER BY version) AS nxt FROM (SELECT DISTINCT version FROM w)),
 a AS (SELECT v.version AS f, v.nxt AS t, claim_key, c FROM w JOIN v USING (version) WHERE nxt IS NOT NULL),
 b AS (SELECT v.version AS f, v.nxt AS t, claim_key, c FROM w JOIN v ON w.version = v.nxt)
SELECT f AS version_from, t AS version_to, claim_key,
  CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b USING (f, t, claim_key) WHERE a.c IS DISTINCT FROM b.c""",
    "p4_found": f"""
WITH src AS (SELECT claim_key, value, {_day("effective_date")} AS day, CAST(retrieved_at AS TIMESTAMPTZ) AS seen, claim_id FROM claim_updates),
{canonical_sql("value")},
 w AS (SELECT claim_key, day, c FROM canon QUALIFY row_number() OVER (PARTITION BY claim_key, day ORDER BY seen DESC NULLS LAST, claim_id DESC) = 1),
 g AS (SELECT *, lag(c) OVER (PARTITION BY claim_key ORDER BY day) AS before FROM w),
 h AS (SELECT claim_key, day, c, lead(day) OVER (PARTITION BY claim_key ORDER BY day) AS nxt FROM g WHERE c IS DISTINCT FROM before)
SELECT claim_key, CAST(day AS VARCHAR) AS valid_from, coalesce(CAST(nxt AS VARCHAR), '9999-12-31') AS valid_to FROM h WHERE c <> ''""",
}
