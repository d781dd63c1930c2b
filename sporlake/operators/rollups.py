"""Rollups: conflicts of sources, coverage, rates, latencies, strategies, classifiers and running state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_conflicts(df: DataFrame, keys: list[str], value: Column, authority: Column) -> DataFrame:
    """keys, value, authority, values, status, other: the value of highest authority, as its source wrote it.

    Values are the same if they are without case and blanks at the ends. status is AVAILABLE, RESOLVED (several values,
    one has the highest authority) or CONFLICTING (the highest authority has several; the smallest is given and the
    largest is ``other``). Of several writings of a value the smallest of its highest authority is given. Rows without
    a value don't count. Two aggregations, both partial before the shuffle; nothing is collected.
    """
    v = df.select(*keys, F.trim(value).alias("original"), F.coalesce(authority, F.lit(-1)).alias("authority")).where("original != ''").withColumn("value", F.lower("original"))
    by_value = v.groupBy(*keys, "value").agg(F.max("authority").alias("authority"), F.min(F.struct((-F.col("authority")).alias("na"), "original"))["original"].alias("original"))
    out = by_value.groupBy(*keys).agg(F.count("*").alias("values"), F.max(F.struct("authority", "value", "original")).alias("hi"), F.min(F.struct((-F.col("authority")).alias("na"), "value", "original")).alias("lo"))
    tie = F.col("hi.value") != F.col("lo.value")
    return out.select(*keys, F.col("lo.original").alias("value"), F.col("hi.authority").alias("authority"), "values", F.when(F.col("values") == 1, "AVAILABLE").when(tie, "CONFLICTING").otherwise("RESOLVED").alias("status"), F.when(tie, F.col("hi.original")).alias("other"))


def profile_status(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Status of a profile from those of its modules."""
    s = F.col(status)
    flags = df.groupBy(*keys).agg(
        F.bool_and(s == "available").alias("all_ok"), F.bool_or(s == "available").alias("any_ok"), F.bool_and(s == "not_found").alias("none"), F.bool_or(s.isin("blocked", "source_error")).alias("broken"), F.count("*").alias("modules")
    )
    name = F.when(F.col("all_ok"), "complete").when(F.col("any_ok"), "partial").when(F.col("none"), "not_found").when(F.col("broken"), "unavailable").otherwise("failed")
    return flags.select(*keys, "modules", name.alias("profile_status"))


def presence(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Long form (key, category, field, found) of a wide table; fields: column to category."""
    cols = [F.struct(F.lit(c).alias("field"), F.lit(g).alias("category"), (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias("found")) for c, g in fields.items()]
    return df.select(key, F.explode(F.array(*cols)).alias("x")).select(key, "x.category", "x.field", "x.found")


def coverage(long: DataFrame, key: str) -> DataFrame:
    """key, fields, found, categories, covered, rate: half of the share of fields and half of that of categories."""
    by_category = long.groupBy(key, "category").agg(F.count("*").alias("n"), F.count_if("found").alias("k"))
    out = by_category.groupBy(key).agg(F.sum("n").alias("fields"), F.sum("k").alias("found"), F.count("*").alias("categories"), F.count_if(F.col("k") > 0).alias("covered"))
    return out.withColumn("rate", F.round(0.5 * F.col("found") / F.col("fields") + 0.5 * F.col("covered") / F.col("categories"), 4))


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], splits: int = 63) -> DataFrame:
    """The values at given ranks (from 1, columns of n) of each group's sorted values, exact: one row a group.

    Equal values are counted first; approximate quantiles then cut a group's values into ranges that are summed apart,
    so that no group is sorted or held in one task. Only the ranges' totals, ``splits`` + 1 a group, come together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    at = F.array(*[F.lit(k / (splits + 1)) for k in range(1, splits + 1)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, at, 1000).alias("_cuts"))
    ranged = counts.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("c").alias("_t"))
    w = Window.partitionBy(*keys)
    before = totals.select(*keys, "_range", F.sum("_t").over(w).alias("n"), (F.sum("_t").over(w.orderBy("_range")) - F.col("_t")).alias("_before"))
    run = ranged.join(before, [*keys, "_range"]).withColumn("_upto", F.col("_before") + F.sum("c").over(Window.partitionBy(*keys, "_range").orderBy(value)))
    here = {name: (F.col("_upto") >= r) & (F.col("_upto") - F.col("c") < r) for name, r in ranks.items()}
    return run.where(reduce(lambda x, y: x | y, here.values())).groupBy(*keys).agg(*[F.max(F.when(c, F.col(value))).alias(name) for name, c in here.items()])


def quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, true median, nearest-rank p50 and p95, min and max of each group."""
    v, n = F.col(value), F.col("n")
    rank = lambda q: F.greatest(F.lit(1), F.ceil(n * q))
    r = ranked_values(df, keys, value, {"p50": rank(0.5), "p95": rank(0.95), "_lo": F.floor((n + 1) / 2), "_hi": F.ceil((n + 1) / 2)})
    base = df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return base.join(r, keys, "left").withColumn("median", F.round((F.col("_lo") + F.col("_hi")) / 2, 6)).select(*keys, "n", "mean", "median", "p50", "p95", "min", "max")


def _running(df: DataFrame, keys: list[str], block: Column, order: list[Column], step: Column, fold, join, start) -> DataFrame:
    """_run: fold of ``step`` over a key's rows in order, with the folds of earlier blocks joined in.

    A block is a stretch of the order (an hour, a day): rows are sorted within blocks only, so that a hot key spreads
    over as many tasks as it has blocks; what comes together of a key is one row a block.
    """
    d = df.withColumn("_block", block).withColumn("_step", step)
    by_block = d.groupBy(*keys, "_block").agg(fold(F.col("_step")).alias("_f"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_block.select(*keys, "_block", fold(F.col("_f")).over(w).alias("_earlier"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = d.withColumn("_here", fold(F.col("_step")).over(inner)).join(earlier, [*keys, "_block"])
    return j.withColumn("_run", join(F.col("_here"), F.coalesce("_earlier", start))).drop("_block", "_step", "_here", "_earlier")


def running_budget(df: DataFrame, keys: list[str], block: Column, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """spent: the running cost in order, and admitted: whether it is still within the budget. block: a stretch of the order."""
    d = _running(df, keys, block, order, cost, F.sum, lambda a, b: a + b, F.lit(0))
    return d.withColumn("spent", F.round("_run", 2)).withColumn("admitted", F.col("spent") <= budget).drop("_run")


def latched(df: DataFrame, keys: list[str], block: Column, order: list[Column], condition: Column, name: str) -> DataFrame:
    """name: true from the first row in order on which the condition holds."""
    d = _running(df, keys, block, order, F.coalesce(condition, F.lit(False)), F.max, lambda a, b: a | b, F.lit(False))
    return d.withColumnRenamed("_run", name)


def running_best(df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """name: the greatest value up to each row."""
    return _running(df, keys, block, order, value, F.max, lambda a, b: F.greatest(a, b), F.lit(None)).withColumnRenamed("_run", name)


def classifier_scores(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, support, true_positive, precision, recall, f1: one pass, labels as columns and unpivoted."""
    g, p = F.col(gold), F.col(predicted)
    one = df.agg(*[x for k, v in enumerate(labels) for x in (F.count_if(g == v).alias(f"s{k}"), F.count_if(p == v).alias(f"p{k}"), F.count_if((g == v) & (p == v)).alias(f"t{k}"))])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("label"), F.col(f"s{k}").alias("support"), F.col(f"p{k}").alias("predicted"), F.col(f"t{k}").alias("true_positive")) for k, v in enumerate(labels)])).alias("x")).select("x.*")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = rate(F.col("true_positive"), F.col("predicted")), rate(F.col("true_positive"), F.col("support"))
    return rows.select("label", "support", "predicted", "true_positive", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0), 6).alias("f1"))


def reasons(**rules: Column) -> Column:
    """Names of the rules that hold, in order; a null rule doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, rows, fingerprint: order-free sums of two 60-bit halves of row hashes, so that no group is collected or sorted."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.concat(part(1), F.lit("-"), part(16)).alias("fingerprint"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
