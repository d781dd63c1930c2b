"""History of changing attributes: unit intervals merged pairwise over logarithmic rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.functions.canonical import canonical_value, flexible_day, instant
from sporlake.session import parallelism

OPEN = (np.datetime64("9999-12-31") - np.datetime64("1970-01-01")).astype(int).item()
BUCKET_ROWS = 1_000_000


def merge_runs(entity: np.ndarray, start: np.ndarray, end: np.ndarray, payload: np.ndarray) -> tuple[np.ndarray, ...]:
    """Interval runs in order of entity and start; neighbours of one entity that touch and are equal become one.

    A round merges the neighbours (0, 1), (2, 3), ... and then (1, 2), (3, 4), ...; a run of n equal units needs
    about log2(n) rounds.
    """
    while True:
        before = len(entity)
        for parity in (0, 1):
            i = np.arange(parity, len(entity) - 1, 2)
            i = i[(entity[i] == entity[i + 1]) & (payload[i] == payload[i + 1]) & (end[i] == start[i + 1])]
            end = end.copy()
            end[i] = end[i + 1]
            keep = np.ones(len(entity), bool)
            keep[i + 1] = False
            entity, start, end, payload = entity[keep], start[keep], end[keep], payload[keep]
        if len(entity) == before:
            return entity, start, end, payload


def _coalesce(t: pa.Table) -> pa.Table:
    keys = t.column("k").combine_chunks().dictionary_encode()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    code, day, value, blank = keys.indices.to_numpy(zero_copy_only=False), *(t.column(c).to_numpy() for c in ("day", "value", "blank"))
    order = np.lexsort((day, code))
    code, day, value, blank = code[order], day[order].astype(np.int64), value[order], blank[order]
    end = np.append(day[1:], OPEN)
    end[:-1][code[1:] != code[:-1]] = OPEN
    # A blank value ends a period and begins none: its units are dropped, the gap they leave keeps equal values apart.
    code, start, end, _ = merge_runs(*(x[~blank] for x in (code, day, end, value)))
    text = lambda d: pa.array(np.datetime_as_string(d.astype("datetime64[D]")), pa.string())
    return pa.table({"k": keys.dictionary.take(pa.array(code)), "valid_from": text(start), "valid_to": text(end)})


def value_history(
    df: DataFrame,
    key: str = "claim_key",
    value: str = "value",
    effective: str = "effective_date",
    retrieved_at: str = "retrieved_at",
    tie: str = "claim_id",
    canonical=canonical_value,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Periods of each key's values: ``key``, valid_from, valid_to (exclusive, 9999-12-31 if open).

    An update holds from its effective day, or from the UTC day of its retrieval if that is missing or unreadable;
    with neither it is left out, as is a null key. Of several updates of a key for a day the one retrieved last
    counts, then the larger ``tie``. Null and blank values end a period. Repeated rows change nothing, an empty
    table gives no rows, other columns are not read.

    The map side keeps one update a key and day, so a key of any number of rows has at most as many as there are
    days. Buckets of keys then turn into unit intervals, which are merged pairwise.
    """
    at = instant(F.col("r"))
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(effective).alias("e"), F.col(retrieved_at).alias("r"), F.col(tie).alias("tie")).where("k is not null")
    rows = rows.select("k", F.coalesce(F.unix_date(flexible_day(F.col("e"))), F.floor(at / F.lit(86_400_000_000)).cast("int")).alias("day"), F.coalesce(at, F.lit(-(2**62))).alias("at"), "tie", canonical(F.col("v")).alias("c")).where("day is not null")
    rows = rows.select("k", "day", F.struct("at", "tie", F.xxhash64("c").alias("value"), (F.col("c") == "").alias("blank")).alias("w"))
    days = rows.groupBy("k", "day").agg(F.max("w").alias("w"))
    buckets = max(parallelism(df.sparkSession), -(-df.count() // bucket_rows))
    units = days.select(F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("bucket"), "k", "day", "w.value", "w.blank")
    return units.groupBy("bucket").applyInArrow(_coalesce, "k string, valid_from string, valid_to string").withColumnRenamed("k", key)
