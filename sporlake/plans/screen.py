"""A closed screening language: text to plan, plan to columns. What isn't understood makes it abstain.

A text is split into words, numbers, signs and quoted strings; phrases are read from it at any place:

    in TOWN | municipality [is] TOWN           (a town ends at "with", "and", "having", "that", "where", "top")
    legal form [is] FORM | organisation form [is] FORM
    COMPARISON N [registered] employees | employees COMPARISON N
    revenue COMPARISON [NOK] AMOUNT [UNIT] | COMPARISON [NOK] AMOUNT [UNIT] revenue
    profitable | positive annual result | unprofitable | loss making | negative annual result
    with|has|have [a|an] [official] website | with|has|have [annual] accounts
    industry [contains|is] "TEXT"
    top N by revenue|employees
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest list a "top N" may ask for, words of comparison and of units (fixed values).
MOST = 100
_OPERATORS = {"more than": ">", "over": ">", "above": ">", "at least": ">=", "fewer than": "<", "less than": "<", "under": "<", "at most": "<=", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "=": "="}
_UNITS = {"billion": 1e9, "bn": 1e9, "million": 1e6, "m": 1e6}
#: Legal forms that can be asked for (fixed values).
_FORMS = {"asa", "as", "enk", "nuf", "ans", "da", "sa", "sti", "brl"}
#: Terms for which no permitted data exist (fixed values).
_REFUSED = ("sentiment", "glassdoor", "linkedin", "traffic", "reviews", "buzz", "without a website")
_TOWN_ENDS = {"with", "and", "having", "that", "where", "top"}
_FIELDS = ("municipality", "legal_form", "employees", "revenue", "annual_result", "website", "accounts", "industry")
_LEX = re.compile(r"\"[^\"]*\"|'[^']*'(?!\w)|\d+(?:[.,]\d+)*(?![\w])|[<>]=?|=|[^\s\"<>=,;:()]+")


@dataclass(frozen=True)
class Criterion:
    field: str
    operator: str
    value: object
    module: str


@dataclass(frozen=True)
class Screen:
    text: str
    criteria: tuple[Criterion, ...] = ()
    order_by: str | None = None
    limit: int | None = None
    refused: tuple[str, ...] = field(default=())
    #: The length of list that was asked for; ``limit`` is at most MOST.
    asked: int | None = None

    @property
    def executable(self) -> bool:
        return bool(self.criteria or self.order_by) and not self.refused

    @property
    def modules(self) -> list[str]:
        extra = {None: set(), "revenue": {"financials"}}.get(self.order_by, {"registry"})
        return sorted({c.module for c in self.criteria} | extra)


class _Words:
    """The words of a text and a place among them."""

    def __init__(self, words: list[str], at: int = 0):
        self.words, self.at = words, at

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def skip(self, *any_of: str) -> _Words:
        """Past the next word if it is one of these."""
        if self.peek() in any_of:
            self.at += 1
        return self

    def phrase(self, *phrases: str) -> str | None:
        """The first of the phrases that stands here, which is passed."""
        for p in phrases:
            parts = p.split()
            if self.words[self.at : self.at + len(parts)] == parts:
                self.at += len(parts)
                return p
        return None

    def comparison(self) -> str | None:
        return _OPERATORS.get(self.phrase(*_OPERATORS) or "")

    def number(self) -> float | None:
        w = self.peek()
        if not w[:1].isdigit() or w.count(",") + w.count(".") > 1:
            return None
        self.at += 1
        return float(w.replace(",", "."))

    def amount(self) -> float | None:
        n = self.skip("nok").number()
        if n is None:
            return None
        unit = self.phrase(*_UNITS)
        return n * _UNITS[unit] if unit else n


def _town(w: _Words) -> Criterion | None:
    if w.phrase("in"):
        pass
    elif w.phrase("municipality"):
        w.skip("is", "=")
    else:
        return None
    town = []
    while w.peek() and w.peek() not in _TOWN_ENDS:
        town.append(w.peek())
        w.at += 1
    return Criterion("municipality", "eq", " ".join(town).upper(), "registry") if town else None


def _form(w: _Words) -> Criterion | None:
    if w.phrase("legal form", "organisation form") and w.skip("is", "=").peek() in _FORMS:
        return Criterion("legal_form", "eq", w.peek().upper(), "registry")
    return None


def _employees(w: _Words) -> Criterion | None:
    named = w.phrase("employees", "employee")
    op = w.comparison()
    n = w.number() if op else None
    if n is None or n != int(n) or not named and not w.skip("registered").phrase("employees", "employee"):
        return None
    return Criterion("employees", op, int(n), "registry")


def _revenue(w: _Words) -> Criterion | None:
    named = w.phrase("revenue")
    op = w.comparison()
    n = w.amount() if op else None
    return Criterion("revenue", op, n, "financials") if n is not None and (named or w.phrase("revenue")) else None


def _result(w: _Words) -> Criterion | None:
    if w.phrase("unprofitable", "loss making", "loss-making", "negative annual result"):
        return Criterion("annual_result", "<", 0, "financials")
    if w.phrase("profitable", "positive annual result"):
        return Criterion("annual_result", ">", 0, "financials")
    return None


def _has(w: _Words) -> Criterion | None:
    if not w.phrase("with", "has", "have"):
        return None
    w.skip("a", "an").skip("official", "annual")
    if w.phrase("website"):
        return Criterion("website", "present", True, "website")
    return Criterion("accounts", "present", True, "financials") if w.phrase("accounts") else None


def _industry(w: _Words) -> Criterion | None:
    if w.phrase("industry") and len(q := w.skip("contains", "is", "=").peek()) > 2 and q[0] in "\"'" and q[-1] == q[0]:
        return Criterion("industry", "contains", q[1:-1], "registry")
    return None


_READERS: tuple[Callable[[_Words], Criterion | None], ...] = (_town, _form, _employees, _revenue, _result, _has, _industry)


def parse_screen(text: str) -> Screen:
    """The plan of a text. Of several phrases about one field the first counts; of both results the loss."""
    clean = " ".join(text.split())
    low = clean.casefold()
    words = _LEX.findall(low)
    found: dict[str, Criterion] = {}
    order_by = asked = None
    for at in range(len(words)):
        for reader in _READERS:
            if c := reader(_Words(words, at)):
                if c.field not in found or c.field == "annual_result" and c.operator == "<":
                    found[c.field] = c
        w = _Words(words, at)
        if order_by is None and w.phrase("top") and (n := w.number()) is not None and w.phrase("by") and (by := w.phrase("revenue", "employees")):
            order_by, asked = by, int(n)
    criteria = tuple(found[f] for f in _FIELDS if f in found)
    return Screen(clean, criteria, order_by, asked and min(asked, MOST), tuple(t for t in _REFUSED if t in low), asked)


def compiled(c: Criterion, fields: dict[str, Column]) -> Column:
    """A comparison with null is false; equality doesn't see case and takes null for empty."""
    x = fields[c.field]
    if c.operator == "eq":
        return F.lower(F.coalesce(x, F.lit(""))) == F.lower(F.lit(c.value))
    if c.operator == "present":
        return F.coalesce(x, F.lit(False)) == F.lit(c.value)
    if c.operator == "contains":
        return F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lower(F.lit(c.value)))
    value = F.lit(c.value)
    return F.coalesce({">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value, "=": x == value}[c.operator], F.lit(False))


def run_screen(profiles: DataFrame, text: str, fields: dict[str, Column], key: str, columns: list[Column | str]) -> DataFrame:
    """Rows that meet every criterion; sorted by the asked field with nulls last, then by key. Abstains (no rows) if it must."""
    plan = parse_screen(text)
    if not plan.executable:
        return profiles.select(*columns).limit(0)
    out = profiles.where(reduce(lambda a, b: a & b, [compiled(c, fields) for c in plan.criteria], F.lit(True)))
    if plan.order_by:
        out = out.orderBy(fields[plan.order_by].desc_nulls_last(), F.col(key).asc()).limit(plan.limit)
    return out.select(*columns)
