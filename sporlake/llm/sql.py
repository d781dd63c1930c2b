"""The same results by DuckDB SQL, where SQL can express them."""

from sporlake.functions.canonical import NOT_KNOWN

_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in NOT_KNOWN)

P1 = rf"""
WITH r AS (
  SELECT claim_id, value, evidence_span, effective_date, reporting_period, evidence_id, source_authority,
    CAST(retrieved_at AS TIMESTAMPTZ) AS seen,
    coalesce(nullif(regexp_replace(regexp_extract(lower(claim_key), '(?:^|\|)\s*org\s*:([^|]*)', 1), '\D', '', 'g'), ''), regexp_replace(organisation_number, '\D', '', 'g')) || '|' ||
    regexp_replace(trim(coalesce(nullif(regexp_extract(lower(claim_key), '(?:^|\|)\s*field\s*:([^|]*)', 1), ''), lower(field_name))), '[\s_-]+', '_', 'g') || '|' ||
    regexp_replace(trim(regexp_extract(lower(claim_key), '(?:^|\|)\s*entity\s*:([^|]*)', 1)), '[\s_-]+', '_', 'g') AS g
  FROM raw_claims),
 c AS (SELECT regexp_replace(lower(source_class), '[^\p{{L}}\p{{N}}]', '', 'g') AS k, max(source_authority) AS a FROM source_catalog GROUP BY 1),
 e AS (SELECT evidence_id, a FROM evidence JOIN c ON k = regexp_replace(lower(source_class), '[^\p{{L}}\p{{N}}]', '', 'g')),
 t AS (SELECT r.*, coalesce(source_authority, e.a, -1) AS trust, min(claim_id) OVER (PARTITION BY g) AS group_id, count(*) OVER (PARTITION BY g) AS n FROM r LEFT JOIN e USING (evidence_id)),
 l AS (SELECT group_id, claim_id, trust, seen, unnest(['value', 'evidence_span', 'effective_date', 'reporting_period']) AS field, unnest([value, evidence_span, effective_date, reporting_period]) AS x FROM t WHERE n > 1)
SELECT group_id, field, claim_id FROM l WHERE trim(regexp_replace(lower(coalesce(x, '')), '[\s\p{{Z}}]+', ' ', 'g')) NOT IN ({_WORDS})
QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY trust DESC, seen DESC NULLS LAST, claim_id) = 1"""

SQL = {"p1_found": P1}
