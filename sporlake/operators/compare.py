"""Comparing keyed tables: changes of claims and fields, membership, fail-closed merges, expected against observed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, kind (ADDED, REMOVED, MODIFIED, UNCHANGED); null to a value is a change."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("before").eqNullSafe(F.col("after")), "UNCHANGED").otherwise("MODIFIED")
    return a.join(b, keys, "full").withColumn("kind", kind).drop("_a", "_b")


def field_changes(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, before, after of the fields that differ, for the keys of both sides."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(keys, fields, "field", name)

    both = long(before, "before").join(long(after, "after"), [*keys, "field"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def membership(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: keys of either side alone and of both."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), after.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("only_before"), F.count_if(F.col("_a").isNull()).alias("only_after"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both")
    )


def require_same_members(before: DataFrame, after: DataFrame, key: str) -> None:
    """Raises unless both sides have the same keys."""
    r = membership(before, after, key).head()
    if r["only_before"] or r["only_after"]:
        raise ValueError(f"membership differs: {r['only_before']} keys only before, {r['only_after']} only after")


def fail_closed_merge(previous: DataFrame, new: DataFrame, failed: DataFrame, keys: list[str], module: str) -> DataFrame:
    """New rows, and the previous rows of modules that failed: a failed fetch is never a deletion."""
    fresh = new.join(failed.select(module).distinct(), module, "left_anti").withColumn("origin", F.lit("new"))
    kept = previous.join(failed.select(module).distinct(), module, "left_semi").join(fresh.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("carried over"))
    return fresh.unionByName(kept)


def materiality(before: Column, after: Column, least: float = 10, share: float = 25, always: float = 50) -> dict[str, Column]:
    """delta, percent (100 from zero), material and severity of a change of a count; a missing value is never material.

    The default thresholds are fixed values.
    """
    delta = after - before
    pct = F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.abs(delta) * 100.0 / before)
    material = F.coalesce(((F.abs(delta) >= least) & (pct >= share)) | (F.abs(delta) >= always), F.lit(False))
    return {
        "delta": delta,
        "percent": F.round(pct, 4),
        "material": material,
        "severity": F.when(before.isNull() | after.isNull(), "unavailable").when(~material, "none").when(pct >= 2 * share, "high").otherwise("medium"),
    }


def set_scores(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall of two key sets."""
    a, b = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    c = a.join(b, keys, "full").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_o").isNotNull()).alias("true_positive"), F.count_if(F.col("_e").isNull()).alias("false_positive"), F.count_if(F.col("_o").isNull()).alias("false_negative")
    )
    share = lambda n, d: F.when(d > 0, F.round(n / d, 6)).otherwise(F.lit(1.0))
    return c.withColumn("precision", share(F.col("true_positive"), F.col("true_positive") + F.col("false_positive"))).withColumn("recall", share(F.col("true_positive"), F.col("true_positive") + F.col("false_negative")))
