"""The screening language: what it understands, what it refuses, how nulls and ties sort."""

import pytest
from pyspark.sql import functions as F

from sporlake.plans.screen import Criterion, compiled, parse_screen, run_screen


@pytest.mark.parametrize(
    "text,criteria",
    [
        ("Companies in Oslo with more than 10 employees", [("municipality", "eq", "OSLO"), ("employees", ">", 10)]),
        ("revenue at least NOK 2,5 million", [("revenue", ">=", 2_500_000.0)]),
        ("over 1.5 bn revenue", [("revenue", ">", 1.5e9)]),
        ("unprofitable companies", [("annual_result", "<", 0)]),
        ("profitable with accounts and has a website", [("annual_result", ">", 0), ("website", "present", True), ("accounts", "present", True)]),
        ("legal form ASA", [("legal_form", "eq", "ASA")]),
        ("employees <= 5", [("employees", "<=", 5)]),
        ("industry contains 'Bakeri'", [("industry", "contains", "bakeri")]),
        ("hello there", []),
        ("with fewer than 3 registered employees in Nord-Aurdal and revenue < 500", [("municipality", "eq", "NORD-AURDAL"), ("employees", "<", 3), ("revenue", "<", 500.0)]),
        ("municipality = Ålesund where organisation form is AS", [("municipality", "eq", "ÅLESUND"), ("legal_form", "eq", "AS")]),
        ("profitable or loss-making", [("annual_result", "<", 0)]),
        ("nonprofitable undertakings", []),
        ("companies that have an official website", [("website", "present", True)]),
        ("above 10 million or so", []),
    ],
)
def test_parse(text, criteria):
    assert [(c.field, c.operator, c.value) for c in parse_screen(text).criteria] == criteria


def test_refuses():
    p = parse_screen("companies in Oslo with good glassdoor reviews")
    assert p.criteria and not p.executable and set(p.refused) == {"glassdoor", "reviews"}
    assert not parse_screen("without a website").executable
    assert parse_screen("top 500 by employees").limit == 100 and parse_screen("top 500 by employees").asked == 500 and parse_screen("top 5 by revenue").modules == ["financials"]


def test_run(spark):
    d = spark.createDataFrame([("1", "Oslo", None), ("2", "OSLO", 5), ("3", "oslo", 9), ("4", "Bergen", 9), ("5", None, 7), ("6", "Oslo", 5)], "org string, municipality string, employees int")
    fields = {"municipality": F.col("municipality"), "employees": F.col("employees")}
    assert [r.org for r in run_screen(d, "in oslo top 10 by employees", fields, "org", ["org"]).collect()] == ["3", "2", "6", "1"]
    assert run_screen(d, "linkedin in oslo", fields, "org", ["org"]).count() == 0
    less = compiled(Criterion("employees", "<", 6, ""), fields)
    assert {r.org for r in d.where(less).collect()} == {"2", "6"}
    assert {r.org for r in d.where(compiled(Criterion("municipality", "eq", "", ""), fields)).collect()} == {"5"}
