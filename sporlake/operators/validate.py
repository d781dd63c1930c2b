"""Validating records: reasons as arrays of names, checks of whole batches as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporlake.functions import urls as U
from sporlake.operators.rollups import reasons

#: Values that observations may have (fixed values).
SIGNALS = ("company_profile", "profile_handle", "profile_metrics", "place_summary", "review", "review_summary", "job_posting", "workforce_snapshot", "public_post", "public_mention", "buzz_metrics")
MODES = ("official_api", "licensed_api", "company_authorized_export", "permitted_public_page")
LABELS = ("positive", "neutral", "negative", "mixed")
INDEPENDENT = ("customer_review", "employee_review", "licensed_news", "public_news", "public_mention")
TERMINAL = ("available", "not_found", "not_applicable", "blocked", "source_error")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def observation_reasons(o: dict[str, Column], platforms: list[str], signals: tuple[str, ...] = SIGNALS) -> Column:
    """The fifteen reasons for which an observation isn't published, in order; o: columns by name, null where unknown."""
    lacks = lambda c, values: ~F.coalesce(c.isin(*values), F.lit(False))
    labelled = o["sentiment_label"].isNotNull()
    return reasons(
        no_id=blank(o["id"]), bad_organisation=~F.coalesce(o["organisation_number"].rlike(r"^\d+$"), F.lit(False)), unknown_platform=lacks(o["platform"], platforms), unknown_signal=lacks(o["signal_type"], signals), no_url=U.host(o["source_url"]).isNull(), no_time=blank(o["retrieved_at"]),
        no_hash=F.length(F.coalesce(o["content_sha256"], F.lit(""))) != 64, entity_not_exact=~F.coalesce(o["exact_entity"], F.lit(False)), no_proof=blank(o["identity_proof"]), mode_not_approved=lacks(o["acquisition_mode"], MODES), rights_not_approved=~F.coalesce(o["rights_status"] == "approved", F.lit(False)),
        no_span=F.coalesce(o["signal_type"].isin("review", "public_post", "public_mention"), F.lit(False)) & blank(o["evidence_span"]),
        unknown_label=labelled & lacks(o["sentiment_label"], LABELS), label_not_independent=labelled & lacks(o["source_class"], INDEPENDENT), no_model=labelled & blank(o["sentiment_model_version"]),
    )


def claim_reasons(c: dict[str, Column], least_authority: int = 20) -> Column:
    """The reasons against a claim: its address, its source, whose number and name the content shows, its span, its hash.

    c: organisation_number, name, source_url, authority, search (whether it is a search hit), value, evidence_span,
    content, content_sha256, registry (whether a register is the source). Checks of content need content.
    """
    text = F.coalesce(c["content"], F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"\b(\d{9})\b"), F.lit(1))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    span = F.coalesce(c["evidence_span"], F.lit(""))
    group = F.lower(text).rlike(r"\b(konsernregnskap|group\s+accounts|morselskap)\b") & ~F.lower(text).rlike(r"\b(underenhet|datterselskap|subsidiary)\b")
    return reasons(
        unsafe_url=~U.is_public(c["source_url"]), unverified_source=F.coalesce(c["authority"], F.lit(-1)) < least_authority, search_snippet=c["search"], other_organisation=(F.size(numbers) > 0) & ~F.array_contains(numbers, c["organisation_number"]),
        other_name=(text != "") & ~F.contains(F.lower(F.substring(text, 1, 1000)), F.lower(c["name"])), group_report=group & ~F.contains(text, c["organisation_number"]),
        span_not_in_source=(text != "") & (span != "") & ~F.contains(squeeze(text), squeeze(span)) & ~F.contains(text, F.substring(span, 1, 50)),
        hash_differs=(text != "") & c["content_sha256"].isNotNull() & (F.sha2(text, 256) != F.lower(c["content_sha256"])), no_span=c["value"].isNotNull() & (span == "") & ~c["registry"],
    )


def batch_checks(rows: DataFrame, key: str, states: str, expected: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """One row of checks of a batch against the keys that were asked for (one row each): count, uniqueness, terminal
    states (``states``: an array a row), nothing dropped, no key that wasn't asked for, and whether all passed."""
    k = rows.select(F.col(key).alias("_k"), F.exists(states, lambda s: ~F.coalesce(s.isin(*terminal), F.lit(False))).alias("_bad"))
    by_key = k.groupBy("_k").agg(F.count("*").alias("_n"), F.count_if("_bad").alias("_bad"))
    j = by_key.join(expected.select(F.col(key).alias("_k"), F.lit(1).alias("_e")), "_k", "full")
    c = j.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("_e").alias("expected"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_n").isNull()).alias("dropped"), F.count_if(F.col("_e").isNull()).alias("unasked"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("not_terminal"))
    ok = {"exact_count": F.col("rows") == F.col("expected"), "unique_keys": F.col("repeated") == 0, "all_terminal": F.col("not_terminal") == 0, "no_silent_drops": F.col("dropped") == 0, "same_members": F.col("unasked") == 0}
    d = c.select("*", *[v.alias(n) for n, v in ok.items()])
    return d.withColumn("passed", F.col("exact_count") & F.col("unique_keys") & F.col("all_terminal") & F.col("no_silent_drops") & F.col("same_members"))


def count_differences(observed: DataFrame, declared: DataFrame, keys: list[str], n: str) -> DataFrame:
    """keys, declared, observed of the counts that a manifest declares and that the rows have where they differ."""
    a = declared.select(*keys, F.col(n).alias("declared"))
    b = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    return a.join(b, keys, "full").where(~F.col("declared").eqNullSafe(F.col("observed")))
