"""JSON lines and archives, replayed responses, sitemaps and evaluation cases."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporlake.functions import urls as U
from sporlake.operators.ranking import first_per
from sporlake.session import cut


def read_archive_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """Lines of the members of tar.gz files, as text; unreadable archives give none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def lines(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> list[str]:
            try:
                with tarfile.open(fileobj=io.BytesIO(b), mode="r:*") as t:
                    return [x for m in t if m.isfile() and m.name.endswith(suffix) for x in t.extractfile(m).read().decode("utf-8", "replace").splitlines() if x.strip()]
            except tarfile.TarError:
                return []

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select(F.explode(lines("content")).alias("value"))


def read_profiles(spark: SparkSession, paths: list[str], schema: str, key: str = "organisation_number") -> DataFrame:
    """Rows of JSON lines files (plain, gzip or in tar.gz); the first path that has a key wins, corrupt lines are skipped."""
    out = None
    for k, p in enumerate(paths):
        text = read_archive_lines(spark, p) if p.endswith((".tar.gz", ".tgz")) else spark.read.text(p)
        d = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.monotonically_increasing_id().alias("line")).select("r.*", F.lit(k).alias("source_order"), "line")
        out = d if out is None else out.unionByName(d)
    return first_per(out.where(F.col(key).isNotNull()), [key], [F.col("source_order"), F.col("line")]).drop("source_order", "line")


def fan_out(keys: DataFrame, modules: dict[str, str], key: str = "organisation_number") -> DataFrame:
    """(key, module, url) of every module of every key; modules: name to an address with {}."""
    parts = F.array(*[F.struct(F.lit(m).alias("module"), F.replace(F.lit(u), F.lit("{}"), F.col(key)).alias("url")) for m, u in modules.items()])
    return keys.select(key, F.explode(parts).alias("x")).select(key, "x.module", "x.url")


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their recorded responses, a status of the evidence and the hash of the body.

    responses: url, status, body, retrieved_at. An address without a recording is unavailable, never not_found.
    """
    j = requests.join(responses.select("url", "status", "body", "retrieved_at"), "url", "left")
    s = F.col("status")
    state = F.when(s.isNull(), "unavailable").when(s == 200, "available").when(s.isin(404, 410), "not_found").when(s == 429, "rate_limited").when(s.isin(401, 403), "blocked").otherwise("source_error")
    return j.withColumn("evidence_status", state).withColumn("content_sha256", F.when(F.col("body").isNotNull(), F.sha2("body", 256)))


def sitemap_entries(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds page_urls and index_urls of sitemap XML; a regular expression reads what isn't well formed."""
    clean = F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    well = F.col(xml).rlike(r"(?s)^\s*(<\?xml[^>]*>\s*)?<(urlset|sitemapindex)\b.*</(urlset|sitemapindex)>\s*$")
    loose = F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    is_index = F.col(xml).contains("<sitemapindex")
    empty = F.array().cast("array<string>")
    pick = lambda path, cond: F.when(well, F.xpath(clean, F.lit(path))).when(cond, loose).otherwise(empty)
    return pages.withColumn("page_urls", pick("//url/loc/text()", ~is_index)).withColumn("index_urls", pick("//sitemap/loc/text()", is_index))


def expand_sitemaps(seeds: DataFrame, recorded: DataFrame) -> DataFrame:
    """Page addresses below seeds (org, url), following sitemap indexes until none is new; indexes may name each other.

    Eager: each level of indexes is computed once and cut.
    """
    front, pages, seen = seeds.select("org", "url").distinct(), None, None
    while True:
        front = cut(front)
        if pages is not None and front.isEmpty():
            return pages.distinct()
        seen = front if seen is None else seen.unionByName(front)
        read = cut(sitemap_entries(front.join(recorded.select("url", "xml"), "url")).select("org", "page_urls", "index_urls"))
        found = read.select("org", F.explode("page_urls").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        # Null-safe, as in a set: a seed without org is followed once, too.
        below = read.select("org", F.explode("index_urls").alias("url")).distinct().alias("b")
        front = below.join(seen.alias("s"), F.col("b.org").eqNullSafe(F.col("s.org")) & (F.col("b.url") == F.col("s.url")), "left_anti")


def robots_sitemaps(c):
    return F.regexp_extract_all(c, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases of a JSON list, {cases: []} or JSON lines; a repeated case id gets a number."""
    d = spark.read.text(path, wholetext=not path.endswith(".jsonl"))
    body = F.col("value")
    as_list = F.when(F.trim(body).startswith("["), F.from_json(body, f"array<struct<{schema}>>")).otherwise(F.coalesce(F.from_json(body, f"struct<cases:array<struct<{schema}>>>")["cases"], F.array(F.from_json(body, f"struct<{schema}>"))))
    rows = d.select(F.monotonically_increasing_id().alias("_l"), F.posexplode(as_list)).select("_l", "pos", "col.*")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("_l", "pos"))
    return rows.withColumn("_n", n).withColumn("case_id", F.when(F.col("_n") > 1, F.concat_ws("-", "case_id", F.col("_n").cast("string"))).otherwise(F.col("case_id"))).drop("_l", "pos", "_n")


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, place, path, allow of the rules for all agents in recorded robots texts (host, text), in the order of the file.

    A file's rules hold from "User-agent: *" to the next agent; comments, blank paths and other lines say nothing.
    """
    lines = robots.where("host is not null and text is not null").select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("place", "line"))
    part = lambda k: F.trim(F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"(?i)^\s*(user-agent|disallow|allow)\s*:\s*(.*)$", k))
    said = lines.select("host", "place", F.lower(part(1)).alias("word"), part(2).alias("path")).where("word != ''")
    # A file is one value; its few lines are looked at together.
    agent = F.last(F.when(F.col("word") == "user-agent", F.col("path")), ignorenulls=True).over(Window.partitionBy("host").orderBy("place"))
    return said.withColumn("agent", agent).where("agent = '*' and word != 'user-agent' and path != ''").select("host", "place", "path", (F.col("word") == "allow").alias("allow"))


def robots_allowed(urls: DataFrame, url: str, id: str, rules: DataFrame) -> DataFrame:
    """id and allowed: the first rule of the host whose path begins the address decides; without one it is allowed."""
    u = urls.select(F.col(id), U.host(F.col(url)).alias("host"), F.concat(U.path(F.col(url)), F.when(U.query_text(F.col(url)) != "", F.concat(F.lit("?"), U.query_text(F.col(url)))).otherwise("")).alias("_at"))
    hit = u.join(rules, "host").where(F.startswith("_at", "path")).groupBy(id).agg(F.min(F.struct("place", "allow")).alias("_r"))
    return u.join(hit, id, "left").select(id, "host", F.coalesce("_r.allow", F.lit(True)).alias("allowed"))
