"""Semi-structured values and similarity, where Spark has no built-in: vectorised Python over Arrow batches."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(v):
    if isinstance(v, dict):
        return {k: _canonical(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        items = [_canonical(x) for x in v]
        return sorted(items, key=lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False))
    if isinstance(v, str):
        return " ".join(v.split())
    if isinstance(v, float):
        r = round(v, 4)
        return int(r) if r.is_integer() else r
    return v


@F.pandas_udf(T.StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """JSON with sorted keys and lists, single blanks and floats of four digits; text that is no JSON stays as it is."""

    def one(s):
        if s is None:
            return None
        try:
            return json.dumps(_canonical(json.loads(s)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return s

    return c.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts (0 to 1, four digits); null with a null side."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


def contains_sequence(words: Column, part: Column) -> Column:
    """Whether the words of ``part`` stand together, in order, in ``words``."""
    n = F.size(part)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return (n > 0) & (n <= F.size(words)) & F.exists(starts, lambda i: F.slice(words, i, n) == part)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header of seconds or an HTTP date; null if it is neither, never negative."""
    when = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(F.trim(header).try_cast("double"), (F.unix_micros(when) - F.unix_micros(now)) / 1e6))


def ungrounded_numbers(text: Column, supplied: Column) -> Column:
    """Numbers of an explanation above 5 that no supplied text holds."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d\s\u00A0\u202F]*(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s\p{Z}]", "")))
    plain = F.transform(supplied, lambda s: F.regexp_replace(s, r"[\s\p{Z}]", ""))
    return F.filter(numbers, lambda x: (F.coalesce(F.translate(x, ",", ".").try_cast("double"), F.lit(0.0)) > 5) & ~F.exists(plain, lambda s: s.contains(x)))
