"""Numbers, amounts and quantile rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Number of a text with blanks, a comma as the decimal sign or grouped thousands; else null."""
    t = F.regexp_replace(c, r"[\s\u00A0]", "")
    t = (
        F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.translate(t, ",.", "."))
        .when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.translate(t, ",", ""))
        .otherwise(F.translate(t, ",", "."))
    )
    return F.when(t.rlike(r"^[+-]?\d+(\.\d*)?$"), t.try_cast("double"))


def amount(c: Column) -> Column:
    """Struct of value and currency (NOK unless another is named); million and mill multiply."""
    u = F.upper(c)
    million = u.rlike(r"\d\s*(MILLION(ER)?|MILL\.?)\b")
    value = number(F.regexp_replace(u, r"[A-Z.]*[A-Z][A-Z.]*", ""))
    return F.struct(F.when(million, value * 1_000_000).otherwise(value).alias("value"), F.when(u.contains("EUR"), "EUR").when(u.contains("USD"), "USD").otherwise("NOK").alias("currency"))


def true_median(c: Column) -> Column:
    return F.median(c)


def rank_rules(n: Column, q: float) -> dict[str, Column]:
    """Ranks (from 1) in sorted values by the three index rules, which differ for small n."""
    return {
        "floor_inner": F.floor((n - 1) * q) + 1,
        "half_up": F.least(F.floor(n * q), n - 1) + 1,
    }
