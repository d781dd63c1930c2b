"""What changed between full snapshots: hash buckets of compact arrays, compared in numpy, values read for differing keys only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporlake.functions.canonical import canonical_value, instant
from sporlake.session import cut, parallelism

#: Rows that one bucket is meant to hold (40 bytes each).
BUCKET_ROWS = 1_000_000
#: Most differing keys of a version (8 bytes each) that are sent to every task, so that only their rows are shuffled; with more, all rows meet them in a join.
SENT_KEYS = 1_000_000
#: Rows that a map task compacts and packs at once.
PACK_ROWS = 250_000

_FIELDS = ("key", "key2", "version", "at", "value")


def _last_of_each(a: np.ndarray) -> np.ndarray:
    """Of the rows (columns as in _FIELDS) of a key in a version, the one retrieved last; ties go to the larger value hash."""
    if len(a) < 2:
        return a
    a = a[np.lexsort((a[:, 4], a[:, 3], a[:, 1], a[:, 0], a[:, 2]))]
    same = (a[1:, :3] == a[:-1, :3]).all(axis=1)
    return a[np.append(~same, True)]


def _pack(buckets: int):
    """Compacts a stretch of rows and yields one row of packed arrays a bucket: a hot key leaves here as a row a version."""

    def emit(parts: list[np.ndarray]):
        a = _last_of_each(np.concatenate(parts))
        b = (a[:, 1].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        starts = np.concatenate(([0], cuts)).astype(np.int64)
        ends = np.append(cuts, len(a))
        return pa.RecordBatch.from_arrays([pa.array(b[starts], pa.int64()), pa.array([a[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "packed"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]).astype(np.int64, copy=False))
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield emit(parts)
                parts, n = [], 0
        if n:
            yield emit(parts)

    return run


def _compare(pairs: list[tuple[int, int]]):
    """Sorted set differences of each two consecutive versions of a bucket: the keys to look at exactly."""

    def run(t: pa.Table) -> pa.Table:
        a = _last_of_each(np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 5) for c in t.column("packed").chunks for x in c]))
        out: list[tuple[np.ndarray, int, int]] = []
        by = {int(v): a[i:j] for v, i, j in _runs(a[:, 2])}
        none = a[:0]
        for v, w in pairs:
            p, q = by.get(v, none), by.get(w, none)
            if not len(p) and not len(q):
                continue
            out.append((_differing(p, q), v, w))
        keys = np.concatenate([x for x, _, _ in out]) if out else np.empty(0, np.int64)
        return pa.table(
            {
                "key": pa.array(keys, pa.int64()),
                "version_from": pa.array(np.repeat([v for _, v, _ in out], [len(x) for x, _, _ in out]).astype(np.int64) if out else [], pa.int64()),
                "version_to": pa.array(np.repeat([w for _, _, w in out], [len(x) for x, _, _ in out]).astype(np.int64) if out else [], pa.int64()),
            }
        )

    return run


def _runs(sorted_: np.ndarray):
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    starts = np.concatenate(([0], cuts)).astype(np.int64)
    return [(sorted_[i], int(i), int(j)) for i, j in zip(starts, np.append(cuts, len(sorted_)), strict=True)] if len(sorted_) else []


def _differing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """First key hashes whose presence or value hash differs, or that two keys of these versions share."""

    def missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(y[:, 0], x[:, 0])
        found = np.zeros(len(x), bool)
        ok = at < len(y)
        found[ok] = y[at[ok], 0] == x[ok, 0]
        return x[~found, 0]

    at = np.searchsorted(p[:, 0], q[:, 0])
    at = np.minimum(at, max(len(p) - 1, 0))
    both = (p[at, 0] == q[:, 0]) if len(p) else np.zeros(len(q), bool)
    i, j = at[both], np.flatnonzero(both)
    changed = q[j[(p[i, 4] != q[j, 4]) | (p[i, 1] != q[j, 1])], 0]
    shared = [x[1:, 0][x[1:, 0] == x[:-1, 0]] for x in (p, q)]
    return np.unique(np.concatenate([missing(p, q), missing(q, p), changed, *shared]))


def snapshot_changes(
    df: DataFrame,
    key: str = "claim_key",
    version: str = "version",
    value: str = "value",
    retrieved_at: str = "retrieved_at",
    canonical=canonical_value,
    bucket_rows: int = BUCKET_ROWS,
    sent_keys: int = SENT_KEYS,
) -> DataFrame:
    """Keys added, removed or changed between consecutive delivered versions.

    Result: version_from, version_to, ``key``, change_kind. Of several rows of a key in a version the one
    retrieved last counts (a null or unreadable time is earliest; for equal times the larger value hash, so that
    repeated rows don't matter). Null and blank are one value. Rows with a null key or version are left out, an
    empty table or a single version gives no rows. Other columns, whatever their names, are not read.

    A map task turns its rows into 40-byte rows of hashes and keeps one row a key and version, so a hot key is
    small before the shuffle. Buckets hold about ``bucket_rows`` rows. Hash pairs that differ, and first hashes
    that two keys share, are looked at again with the full keys and values; the result doesn't rest on key hashes.
    Up to ``sent_keys`` of them are sent to the tasks that read the table again, and only rows of these keys are shuffled.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(version).cast("long").alias("version"), F.col(value).alias("v"), F.col(retrieved_at).alias("r")).where("k is not null and version is not null")
    at = F.coalesce(instant(F.col("r")), F.lit(-(2**62)))
    hashed = rows.select(F.xxhash64("k").alias("key"), F.xxhash64(F.lit("second"), "k").alias("key2"), "version", at.alias("at"), F.xxhash64(canonical(F.col("v"))).alias("value"))
    # The deliveries are few: one row each comes to the driver.
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(version).cast("long")).count().collect() if r[0] is not None}
    versions = sorted(sizes)
    pairs = list(zip(versions[:-1], versions[1:], strict=True))
    buckets = max(parallelism(spark), -(-sum(sizes.values()) // bucket_rows))
    packed = hashed.mapInArrow(_pack(buckets), "bucket long, packed binary")
    candidates = packed.groupBy("bucket").applyInArrow(_compare(pairs), "key long, version_from long, version_to long")
    candidates = cut(candidates.select("key", "version_from", "version_to"))
    sides = candidates.select("key", "version_from", "version_to", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("version_from").alias("version")), F.struct(F.lit(1).alias("side"), F.col("version_to").alias("version")))).alias("s")).select("key", "version_from", "version_to", "s.side", "s.version")
    full = rows.select(F.xxhash64("k").alias("key"), "version", "k", "v", "r")
    keys = sides.select(F.xxhash64("key", "version").alias("kv")).distinct()
    if keys.limit(sent_keys + 1).count() <= sent_keys:
        full = full.withColumn("kv", F.xxhash64("key", "version")).join(F.broadcast(keys), "kv", "left_semi")
    found = full.join(sides, ["key", "version"]).select("version_from", "version_to", "k", "side", at.alias("at"), canonical(F.col("v")).alias("c"))
    found = found.select("version_from", "version_to", "k", "side", F.struct("at", F.xxhash64("c").alias("h"), "c").alias("w"))
    exact = found.groupBy("k", "version_from", "version_to").agg(F.max(F.when(F.col("side") == 0, F.col("w"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("w"))).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.c") != F.col("b.c"), "changed")
    return exact.select(F.col("version_from").cast("int").alias("version_from"), F.col("version_to").cast("int").alias("version_to"), F.col("k").alias(key), kind.alias("change_kind")).where("change_kind is not null")
