"""Sinks: JSON lines, reports, keyed tables and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporlake.operators.ranking import latest_per


def write_json_lines(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines by Spark's commit protocol; a single file only where a reader needs one."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def put(table: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
    """Rows of a keyed parquet table replaced by newer ones; of several new rows of a key the greatest by ``order`` counts.

    A new folder is written, then takes the old one's place. Where a run was lost between the two renames the table is in
    the folder "-old" and is taken back first.
    """
    spark = rows.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    path, fresh, old = fs.Path(table), fs.Path(table + "-new"), fs.Path(table + "-old")
    hdfs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not hdfs.exists(path) and hdfs.exists(old):
        hdfs.rename(old, path)
    out = latest_per(rows, keys, order).select(*rows.columns)
    if hdfs.exists(path):
        out = spark.read.parquet(table).join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(out)
    out.write.mode("overwrite").parquet(str(fresh))
    hdfs.delete(old, True)
    if hdfs.exists(path):
        hdfs.rename(path, old)
    hdfs.rename(fresh, path)
    hdfs.delete(old, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def flattened(df: DataFrame) -> DataFrame:
    """Fields of structs as columns a_b, arrays and maps as JSON."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        df = df.select(*[F.col(f"`{c}`.`{f.name}`").alias(f"{c}_{f.name}") for c, t in df.dtypes if t.startswith("struct") for f in df.schema[c].dataType.fields], *[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("struct")])
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map")) else F.col(c) for c, t in df.dtypes])


def write_reports(records: DataFrame, summary: dict, folder: str) -> dict[str, str]:
    """Records as JSON lines and flat CSV, the summary as JSON and Markdown, all on the folder's file system."""
    spark = records.sparkSession
    write_json_lines(records, f"{folder}/records.jsonl")
    flattened(records).write.mode("overwrite").csv(f"{folder}/records.csv", header=True)
    _write_text(spark, f"{folder}/summary.json", json.dumps(summary, sort_keys=True, ensure_ascii=False))
    _write_text(spark, f"{folder}/summary.md", "| Measure | Value |\n| --- | --- |\n" + "".join(f"| {k} | {v} |\n" for k, v in sorted(summary.items())))
    return {k: f"{folder}/{n}" for k, n in (("records", "records.jsonl"), ("csv", "records.csv"), ("summary", "summary.json"), ("markdown", "summary.md"))}


def manifest(spark, pattern: str) -> DataFrame:
    """file, bytes and SHA-256 of files."""
    return spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def envelopes(profiles: DataFrame, evidence: DataFrame, run_id: str, key: str = "organisation_number") -> DataFrame:
    """A contract record a company: claims and evidence with ids, terminal states by module.

    Evidence of one company is gathered into one record, as the contract wants; companies of unusual size are better
    written in parts (see contract_envelopes in the catalogue).
    """
    e = evidence.select(key, F.struct(F.col("field").alias("module"), "status", "source_url", "content_sha256", F.substring("evidence_excerpt", 1, 300).alias("span"), F.concat(F.lit("ev-"), F.col("evidence_id").cast("string")).alias("id")).alias("e"))
    g = e.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    j = profiles.join(g, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(g.schema["evidence"].dataType)))
    claims = F.transform(F.filter("evidence", lambda x: x["status"] == "available"), lambda x: F.struct(x["module"].alias("field"), x["id"].alias("evidence_id")))
    state = F.when(F.size("evidence") == 0, "submission_error").when(F.forall("evidence", lambda x: x["status"] == "available"), "complete").when(F.exists("evidence", lambda x: x["status"] == "available"), "partial").otherwise("failed")
    return j.select(key, F.lit(run_id).alias("run_id"), state.alias("state"), claims.alias("claims"), "evidence")


def check_envelopes(e: DataFrame, expected: int, key: str = "organisation_number") -> dict[str, bool]:
    r = e.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.bool_and(F.col("state").isin("complete", "partial", "failed", "submission_error")).alias("terminal")).head()
    return {"exact_count": r["n"] == expected, "unique": r["n"] == r["keys"], "terminal_states": bool(r["terminal"])}
