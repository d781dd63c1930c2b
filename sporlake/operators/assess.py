"""Assessing pages, candidates and relations: scores and ladders as columns, lookups by domain as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporlake.functions import text as X
from sporlake.functions import urls as U
from sporlake.operators.ranking import first_per


def research_candidates(results: DataFrame, keys: list[str], url: str, rank: str, base: Column, tie: str) -> DataFrame:
    """Results of a key once an address, best rank first, with score base - 0.05 (rank - 1) between 0.1 and 1, and its place."""
    d = results.withColumn("url_key", U.research_url(F.col(url))).where("url_key is not null")
    d = first_per(d, [*keys, "url_key"], [F.col(rank).asc_nulls_last(), F.col(tie)])
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), base - 0.05 * (F.coalesce(F.col(rank), F.lit(20)) - 1))), 4)
    w = Window.partitionBy(*keys).orderBy(F.desc("candidate_score"), F.col(rank).asc_nulls_last(), "url_key")
    return d.withColumn("candidate_score", score).withColumn("place", F.row_number().over(w))


def lookup_by_domain(df: DataFrame, url: str, id: str, rules: DataFrame) -> DataFrame:
    """Each row with the rule of its host or of the nearest parent domain. rules: domain and other columns, one row a domain."""
    hosts = df.select(id, F.posexplode(U.host_suffixes(U.host(F.col(url)))).alias("_depth", "domain"))
    near = hosts.join(rules, "domain")
    rest = [c for c in rules.columns if c != "domain"]
    best = near.groupBy(id).agg(F.min(F.struct("_depth", "domain", *rest)).alias("_r"))
    return df.join(best, id, "left").select(*df.columns, F.col("_r.domain").alias("domain"), *[F.col("_r")[c].alias(c) for c in rest])


def ambiguity(pairs: DataFrame, target: str, name: Column, candidate_name: Column, same_key: Column) -> DataFrame:
    """target, exact, named, ambiguous: a target is ambiguous if no key decides and several candidates bear its name."""
    d = pairs.groupBy(target).agg(F.count_if(same_key).alias("exact"), F.count_if(X.folded_name(X.without_legal_form(name)) == X.folded_name(X.without_legal_form(candidate_name))).alias("named"))
    return d.withColumn("ambiguous", (F.col("exact") != 1) & (F.col("named") > 1))


def group_relation(pairs: DataFrame, parents: DataFrame, a: str, b: str) -> DataFrame:
    """Relation of each given pair by parent pointers (org, parent): same, parent, subsidiary, sister or none."""
    p = parents.select("org", "parent")
    j = pairs.join(p.select(F.col("org").alias(a), F.col("parent").alias("_pa")), a, "left").join(p.select(F.col("org").alias(b), F.col("parent").alias("_pb")), b, "left")
    kind = F.when(F.col(a) == F.col(b), "same").when(F.col("_pb") == F.col(a), "parent").when(F.col("_pa") == F.col(b), "subsidiary").when(F.col("_pa") == F.col("_pb"), "sister").otherwise("none")
    return j.withColumn("relation", kind).drop("_pa", "_pb")


def page_identity(name: Column, org: Column, title: Column, text: Column) -> Column:
    """Struct of score and status of whether a page is a company's own, by its number, its name and signs of a parked page."""
    want = X.tokens(name)
    seen = X.tokens(F.concat_ws(" ", title, text))
    share = F.size(F.array_intersect(want, seen)) / F.greatest(F.size(want), F.lit(1))
    digits = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[\s\u00A0](?=\d)", ""), F.lit(r"(?<!\d)(\d{9})(?!\d)"), F.lit(1))
    own, other = F.array_contains(digits, org), F.size(F.array_distinct(digits)) > 0
    parked = F.lower(F.concat_ws(" ", title, text)).rlike(r"domain (is )?for sale|parked domain|domenet er til salgs|under construction")
    score = F.when(parked, 0.1).when(own & (share > 0), 1.0).when(own, 0.95).when(other, 0.1).when(share == 1, 0.85).when(share >= 0.5, 0.65).when(share > 0, 0.35).otherwise(0.1)
    return F.struct(score.alias("score"), F.when(score >= 0.85, "verified").when(score >= 0.65, "review").otherwise("rejected").alias("status"))


def priority_links(links: DataFrame, page: str, url: str, categories: dict[str, str], limit: int = 7) -> DataFrame:
    """The ``limit`` best links of a page: the best one of each category in their order, then by rank and length.

    categories: name to a pattern of the address, the most wanted first.
    """
    names = list(categories)
    cat = F.lit(None).cast("int")
    for k, n in reversed(list(enumerate(names))):
        cat = F.when(F.lower(F.col(url)).rlike(categories[n]), k).otherwise(cat)
    d = links.select(page, url).distinct().withColumn("_cat", cat).where("_cat is not null")
    first = F.row_number().over(Window.partitionBy(page, "_cat").orderBy(F.length(url), url)) == 1
    w = Window.partitionBy(page).orderBy(F.col("_first").desc(), "_cat", F.length(url), url)
    out = d.withColumn("_first", first).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return out.select(page, url, F.array(*map(F.lit, names))[F.col("_cat")].alias("category"), "place")


def shares(df: DataFrame, keys: list[str], amount: Column, least: float) -> DataFrame:
    """keys, total, share of all, and whether the share is a bottleneck."""
    g = df.groupBy(*keys).agg(F.sum(amount).alias("total"))
    return g.withColumn("share", F.round(F.col("total").cast("double") / F.sum(F.col("total").cast("double")).over(Window.partitionBy()), 4)).withColumn("bottleneck", F.col("share") >= least)


def facts(topic_rules: dict[str, Column], notes: dict[str, Column]) -> Column:
    """Struct of the facts that are known and the notes on those that aren't, each in the order given."""
    known = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("fact"), c.cast("string").alias("value"))) for n, c in topic_rules.items()]))
    missing = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in notes.items()]))
    return F.struct(known.alias("facts"), missing.alias("unsupported"))
