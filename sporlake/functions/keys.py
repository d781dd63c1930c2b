"""Organisation numbers and stable keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the first eight digits of an organisation number (fixed values).
WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)


def org_digits(c: Column) -> Column:
    """Nine digits of a key in any writing, else null."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) == 9, d)


def check_digit(first8: Column) -> Column:
    """Check digit modulo 11 of eight digits; null where it would be 10 or the text isn't eight digits."""
    total = sum((F.substring(first8, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    digit = F.pmod(F.lit(11) - total % 11, F.lit(11))
    return F.when(first8.rlike(r"^\d{8}$") & (digit < 10), digit)


def has_valid_check(c: Column) -> Column:
    """True where nine digits carry their check digit; false otherwise, also for null."""
    return F.coalesce(c.rlike(r"^\d{9}$") & (F.substring(c, 9, 1).try_cast("int") == check_digit(F.substring(c, 1, 8))), F.lit(False))


def compare_keys(requested: Column, found: Column) -> Column:
    """exact, missing, mismatch or invalid."""
    a, b = org_digits(requested), org_digits(found)
    return F.when(a.isNull(), "invalid").when(found.isNull() | (F.trim(found) == ""), "missing").when(b.isNull(), "invalid").when(a == b, "exact").otherwise("mismatch")


def claim_key(org: Column, field: Column, entity: Column | None = None) -> Column:
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    key = F.concat(F.lit("org:"), org, F.lit("|field:"), tidy(field))
    return key if entity is None else F.when(F.coalesce(F.trim(entity), F.lit("")) != "", F.concat(key, F.lit("|entity:"), tidy(entity))).otherwise(key)


def short_hash(*parts: Column, length: int = 24, prefix: str = "") -> Column:
    """Prefix and the first digits of SHA-256 over the parts joined by '|'; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))
