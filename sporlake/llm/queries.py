"""Queries of the operators of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sporlake.llm.abuse import rates, scored, to_review
from sporlake.llm.leakage import leaked_items
from sporlake.llm.linkage import company_records, meant_companies
from sporlake.llm.sql import SQL  # noqa: F401
from sporlake.llm.survivor import surviving_claims
from sporlake.llm.tokenizer import token_ids
from sporlake.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return surviving_claims(table(spark, sf, "raw_claims"), table(spark, sf, "evidence"), table(spark, sf, "source_catalog"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return meant_companies(company_records(table(spark, sf, "name_comparisons"), table(spark, sf, "discovery_results")), table(spark, sf, "companies"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return to_review(table(spark, sf, "documents"))


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rates(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}

