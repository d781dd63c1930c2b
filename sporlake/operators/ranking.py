"""Choosing rows: latest, first, top, samples and splits. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_per(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """One row a key, the one with the greatest ``at`` columns: a max of structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in at], *[F.col(c) for c in rest if c not in at])
    return df.groupBy(*keys).agg(F.max(packed).alias("_w")).select(*keys, *[F.col("_w")[c].alias(c) for c in rest])


def best_or_none(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The best row a key, or none where several have the best score; two aggregations that combine before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, score)]
    by_score = df.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_r"))
    return latest_per(by_score, keys, [score]).where("_n = 1").select(*keys, score, *[F.col("_r")[c].alias(c) for c in rest])


def hash_rank(seed: str, key: str) -> Column:
    """Hexadecimal SHA-256 by which rows are drawn: the same on every run and cluster."""
    return F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """n rows by hash rank, without the keys of ``exclude``; a bounded heap a task, no full sort."""
    if exclude is not None:
        df = df.join(exclude.select(key).distinct(), key, "left_anti")
    return df.withColumn("sample_rank", hash_rank(seed, key)).orderBy("sample_rank", key).limit(n)


def stratified_sample(df: DataFrame, stratum: str | Column, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by hash rank; the window keeps n rows a task and stratum before the shuffle."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    w = Window.partitionBy("stratum").orderBy("sample_rank", key)
    out = df.withColumn("stratum", s).withColumn("sample_rank", hash_rank(seed, key))
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def hash_split(df: DataFrame, key: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """A split of all rows by the first 48 bits of the hash rank: no sort, stable when rows are added."""
    u = F.conv(F.substring(hash_rank(seed, key), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    upto, col = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        col = F.when(u < round(upto, 12), name) if col is None else col.when(u < round(upto, 12), name)
    return df.withColumn("split", col.otherwise(names[-1]) if col is not None else F.lit(names[0]))


def position_split(df: DataFrame, key: str, seed: str) -> DataFrame:
    """A sample of bounded size split 60/20/20 by its position in hash order."""
    w = Window.orderBy("sample_rank", key)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = df.withColumn("sample_rank", hash_rank(seed, key)).withColumn("position", F.row_number().over(w)).withColumn("_n", n)
    p, total = F.col("position"), F.col("_n")
    return out.withColumn("split", F.when(p <= F.round(total * 0.6), "development").when(p <= F.round(total * 0.8), "validation").otherwise("test")).drop("_n")


def first_per_host(df: DataFrame, host: Column, key: str, n: int, seed: str, exclude_hosts: list[str] = ()) -> DataFrame:
    """The first n rows in hash order with no two on a host; rows without a host and excluded hosts are left out."""
    out = df.withColumn("host", host).where("host is not null")
    if exclude_hosts:
        out = out.where(~F.col("host").isin(*exclude_hosts))
    out = out.withColumn("sample_rank", hash_rank(seed, key))
    return first_per(out, ["host"], [F.col("sample_rank"), F.col(key)]).orderBy("sample_rank", key).limit(n)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of an ordered result; pages count from 0."""
    return df.orderBy(*order).offset(size * number).limit(size)
