"""Queries of the core training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sporlake.operators.history import value_history
from sporlake.operators.snapshot_diff import snapshot_changes
from sporlake.operators.timestamps import unambiguous_times
from sporlake.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return unambiguous_times(table(spark, sf, "evidence"), table(spark, sf, "source_catalog"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "snapshot_claims"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return value_history(table(spark, sf, "claim_updates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found}
