"""Mixed timestamp formats: all readings of a value, the order of numeric dates chosen by Viterbi over each source's records."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.functions.readings import read
from sporlake.session import cut, parallelism, spread

#: Costs of a reading that its text doesn't allow, of a switch of order between two records, of a jump back in time.
INVALID, SWITCH, BACK = 1.0, 50.0, 0.01
#: Records in one stretch of a source; stretches are summed up by a 3 x 3 matrix of costs.
STRETCH = 4096
_NONE = -(2**63)


#: How a numeric date begins, whose order of day and month may be another; any other value has one reading.
NUMERIC = r"^[\s\p{Z}\x1C-\x1F\x85]*\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}"


def _readings(batches):
    """The reading of each value that has only one."""
    for batch in batches:
        got = [read(v) for v in batch.column(3).to_pylist()]
        take = pa.array([i for i, x in enumerate(got) if x is not None], pa.int64())
        got = [x for x in got if x is not None]
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], pa.array([x[1][0] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())], ["id", "field", "source", "micros", "zone"])


def _step(t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Cost of going from each order of one record to each order of the next."""
    c = np.where(np.eye(3, dtype=bool), 0.0, SWITCH)
    back = (t1[None, :] < t0[:, None]) & (t0[:, None] != _NONE) & (t1[None, :] != _NONE)
    return c + BACK * back


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest cost of a path through two parts; each matrix has the costs from its first to its last order."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def total(times: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive parts. times: (n, 2, 3), the readings of each part's first and last record."""
    m = parts[0]
    for k in range(1, len(parts)):
        m = _then(_then(m, _step(times[k - 1, 1], times[k, 0])), parts[k])
    return m


def decode(times: np.ndarray, parts: list[np.ndarray], start: int | None = None, end: int | None = None) -> np.ndarray:
    """Viterbi: the order at the start and end of each part on the cheapest path; (n, 2)."""
    n = len(parts)
    enter = np.full(3, 0.0) if start is None else np.where(np.arange(3) == start, 0.0, np.inf)
    back_in, back_prev = [], []
    for k in range(n):
        if k:
            through = enter[:, None] + _step(times[k - 1, 1], times[k, 0])
            back_prev.append(through.argmin(axis=0))
            enter = through.min(axis=0)
        out = enter[:, None] + parts[k]
        back_in.append(out.argmin(axis=0))
        enter = out.min(axis=0)
    s = int(enter.argmin()) if end is None else end
    path = np.empty((n, 2), np.int64)
    for k in range(n - 1, -1, -1):
        path[k, 1] = s
        path[k, 0] = s = int(back_in[k][s])
        if k:
            s = int(back_prev[k - 1][s])
    return path


def _single(readings: np.ndarray) -> list[np.ndarray]:
    """A record as a part: it begins and ends in one order, at the cost of a reading that isn't there."""
    cost = np.where(readings == _NONE, INVALID, 0.0)
    return [np.where(np.eye(3, dtype=bool), c, np.inf) for c in cost]


def _stretches(batches):
    """Reads runs of one source's records in their order, as packed arrays of all readings with the matrix of each run."""
    held, who, seq = [], None, 0

    def flush():
        nonlocal held, seq
        r = np.array([x[2] for x in held], np.int64)
        parts = _single(r)
        m = total(np.stack([r, r], axis=1), parts)
        row = {"source": who[0], "chain": who[1], "seq": seq, "ids": [x[0] for x in held], "fields": [x[1] for x in held], "zones": [x[3] for x in held], "readings": r.ravel().tolist(), "first": r[0].tolist(), "last": r[-1].tolist(), "matrix": m.ravel().tolist()}
        held, seq = [], seq + 1
        return pa.RecordBatch.from_pylist([row], schema=_STRETCH_ARROW)

    for batch in batches:
        for source, chain, id_, field, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x := read(text)) is None:
                continue
            now = (source, chain)
            if held and (now != who or len(held) >= STRETCH):
                yield flush()
            who = now
            held.append((id_, field, [_NONE if y is None else y for y in x[1]], x[2]))
    if held:
        yield flush()


_STRETCH_ARROW = pa.schema([("source", pa.string()), ("chain", pa.string()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("fields", pa.list_(pa.string())), ("zones", pa.list_(pa.string())), ("readings", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("matrix", pa.list_(pa.float64()))])
_STRETCH_SQL = "source string, chain string, seq long, ids array<long>, fields array<string>, zones array<string>, readings array<long>, first array<long>, last array<long>, matrix array<double>"


def _arrays(p: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    times = np.stack([np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)]) for a, b in zip(p["first"], p["last"], strict=True)])
    return times, [np.asarray(m, float).reshape(3, 3) for m in p["matrix"]]


def _sum_up(p: pd.DataFrame) -> pd.DataFrame:
    """The stretches of one source in one partition as a single part."""
    p = p.sort_values("seq")
    times, parts = _arrays(p)
    return pd.DataFrame([{"source": p["source"].iloc[0], "chain": p["chain"].iloc[0], "part": p["part"].iloc[0], "first": times[0, 0].tolist(), "last": times[-1, 1].tolist(), "matrix": total(times, parts).ravel().tolist()}])


def _ends_of_parts(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("part")
    path = decode(*_arrays(p))
    return p[["source", "chain", "part"]].assign(enters=path[:, 0], leaves=path[:, 1])


def _ends_of_stretches(p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("seq")
    path = decode(*_arrays(p), int(p["enters"].iloc[0]), int(p["leaves"].iloc[0]))
    return p[["source", "chain", "part", "seq"]].assign(enters=path[:, 0], leaves=path[:, 1])


def _unfold(batches):
    """The chosen reading of each record of a stretch whose first and last order are known."""
    for batch in batches:
        for row in batch.to_pylist():
            r = np.asarray(row["readings"], np.int64).reshape(-1, 3)
            path = decode(np.stack([r, r], axis=1), _single(r), row["enters"], row["leaves"])
            got = r[np.arange(len(r)), path[:, 0]]
            n = len(r)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["fields"], pa.string()), pa.array([row["source"]] * n, pa.string()), pa.array(got.tolist(), pa.int64(), mask=got == _NONE), pa.array(row["zones"], pa.string())], ["id", "field", "source", "micros", "zone"])


def unambiguous_times(df: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("retrieved_at", "published_at", "as_of"), id: str = "evidence_id", source: str = "source_type", source_key: str = "source_class", local_zone: str = "local_zone") -> DataFrame:
    """One UTC time of each value that denotes a real time or day: ``id``, field, utc (YYYY-MM-DDTHH:MM:SS.ffffffZ).

    All valid readings of a value are made as an array. Numeric dates such as 03/04/2021 have several; for each
    source and way of writing the order is chosen over its records in id order, where a reading the text doesn't
    allow, a switch of order and a jump back in time cost. Values whose text is no real time, and null and blank
    ones, give no row. A zone or offset in the text counts, else the source's local zone, else UTC. A local time
    that occurs twice is the first, a skipped one moves on by the gap, a day is its midnight.

    A source of any size is cut into range partitions and these into stretches, each summed up by a 3 x 3 matrix of
    costs; the best path is found over partitions, then over stretches, then inside each. Only matrices meet in one
    task: one a partition of the source.
    """
    spark = df.sparkSession
    wide = df.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("v")).where("id is not null")
    values = wide.select("id", "v.field", F.coalesce("source", F.lit("")).alias("source"), "v.text").where("text is not null")
    numeric = F.col("text").rlike(NUMERIC)
    # Each value is read once: numeric dates after they are placed in their source's order, the others where they are.
    plain = spread(values.where(~numeric)).mapInArrow(_readings, "id long, field string, source string, micros long, zone string")
    n = parallelism(spark)
    chain = F.regexp_extract("text", r"\p{Nd}([./-])", 1).alias("chain")
    ordered = values.where(numeric).select("source", chain, "id", "field", "text").repartitionByRange(n, "source", "chain", "id", "field").sortWithinPartitions("source", "chain", "id", "field")
    stretches = cut(ordered.mapInArrow(_stretches, _STRETCH_SQL).withColumn("part", F.spark_partition_id()))
    sums = stretches.select("source", "chain", "part", "seq", "first", "last", "matrix")
    parts = sums.groupBy("source", "chain", "part").applyInPandas(_sum_up, "source string, chain string, part int, first array<long>, last array<long>, matrix array<double>")
    ends = parts.groupBy("source", "chain").applyInPandas(_ends_of_parts, "source string, chain string, part int, enters int, leaves int")
    inner = sums.join(ends, ["source", "chain", "part"]).groupBy("source", "chain", "part").applyInPandas(_ends_of_stretches, "source string, chain string, part int, seq long, enters int, leaves int")
    chosen = stretches.select("source", "chain", "part", "seq", "ids", "fields", "zones", "readings").join(inner, ["source", "chain", "part", "seq"]).mapInArrow(_unfold, "id long, field string, source string, micros long, zone string")
    all_ = plain.unionByName(chosen).where("micros is not null")
    zones = sources.select(F.col(source_key).alias("source"), F.col(local_zone).alias("local")).where("source is not null").groupBy("source").agg(F.max("local").alias("local"))
    placed = all_.join(zones, "source", "left").select("id", "field", "micros", F.coalesce("zone", "local", F.lit("")).alias("zone"))
    t = F.timestamp_micros("micros")
    utc = F.when(F.col("zone") == "", t).otherwise(F.to_utc_timestamp(t, F.when(F.col("zone") == "", "UTC").otherwise(F.col("zone"))))
    return placed.select(F.col("id").alias(id), "field", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("utc"))

