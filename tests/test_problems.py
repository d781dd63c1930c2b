"""The core training-data operators against plain Python, and on the cases their docstrings name."""

import random

import brute
import duckdb
import pytest

from sporlake.operators.history import merge_runs, value_history
from sporlake.operators.snapshot_diff import snapshot_changes
from sporlake.operators.timestamps import decode, total, unambiguous_times

CLAIMS = "claim_id long, claim_key string, version int, value string, retrieved_at string, effective_date string, k string, v int, side string, at string, bucket int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def claim(i, key, version, value, at="2025-01-01T00:00:00Z", eff=None):
    return (i, key, version, value, at, eff, "clash", 1, "clash", "clash", 2)


def found3(spark, data):
    return rows(snapshot_changes(spark.createDataFrame(data, CLAIMS)), "version_from", "version_to", "claim_key", "change_kind")


def test_changes_as_brute_force(spark, sf_small):
    t = duckdb.execute(f"select version, claim_key, value, retrieved_at from '{sf_small}/snapshot_claims.parquet'").fetchall()
    df = snapshot_changes(spark.read.parquet(f"{sf_small}/snapshot_claims.parquet"))
    assert set(rows(df, "version_from", "version_to", "claim_key", "change_kind")) == brute.changes(t)


def test_changes_of_notations(spark):
    pairs = [
        ("NOK 1234567", "1.234.567", 0), ("1 234 567,00", "1234567.00", 0), ("kr 12 345", "12,345", 0), ("3.0", " 3 ", 0), ("2020-01-05", "05.01.2020", 0), ("20200105", "2020-01-05T00:00:00Z", 0), ("true", "1", 0),
        ("FALSE", "0", 0), ("HTTPS://WWW.Å.example/", "å.example", 0), ("Øst  Vest", "øst vest ", 0), ("AS", "as", 0), ("", None, 0), ("  ", None, 0), ("1", "2", 1), ("a & b", "a og b", 1), ("x.example/a", "x.example/b", 1), (None, "x", 1), ("12", "120", 1),
    ]
    data = [claim(i, f"k{i}", v, (a, b)[v - 1]) for i, (a, b, _) in enumerate(pairs) for v in (1, 2)]
    assert found3(spark, data) == sorted((1, 2, f"k{i}", "changed") for i, p in enumerate(pairs) if p[2])


def test_changes_edge_cases(spark):
    assert found3(spark, []) == []
    assert found3(spark, [claim(1, "a", 1, "x")]) == []
    data = [claim(1, "a", 1, "x"), claim(2, "a", 1, "y", "2025-01-01T02:00:00+03:00"), claim(3, "a", 1, "x"), claim(4, "a", 4, "x", None), claim(5, "b", 4, None), claim(6, None, 4, "q"), claim(7, "c", None, "q"), claim(8, "d", 1, "1")]
    # versions 1 and 4 are consecutive; the row retrieved last counts; a key with a null value is present
    assert found3(spark, data) == [(1, 4, "b", "added"), (1, 4, "d", "removed")]


def test_changes_hot_key(spark):
    data = [claim(i, "hot" if i % 3 else f"k{i}", 1 + i % 2, str(i % 7), f"2025-01-01T00:00:{i % 60:02d}Z") for i in range(3000)]
    want = brute.changes([(r[2], r[1], r[3], r[4]) for r in data if r[1] != "hot"])
    assert {x for x in found3(spark, data) if x[2] != "hot"} == want


def found4(spark, data):
    return rows(value_history(spark.createDataFrame(data, CLAIMS)), "claim_key", "valid_from", "valid_to")


def test_history_as_brute_force(spark, sf_small):
    t = duckdb.execute(f"select claim_id, claim_key, value, effective_date, retrieved_at from '{sf_small}/claim_updates.parquet'").fetchall()
    df = value_history(spark.read.parquet(f"{sf_small}/claim_updates.parquet"))
    assert set(rows(df, "claim_key", "valid_from", "valid_to")) == brute.history(t)


def test_history_edge_cases(spark):
    assert found4(spark, []) == []
    data = [
        claim(1, "a", 1, "x", eff="2020-01-01"), claim(2, "a", 1, "X ", eff="02.01.2020"), claim(3, "a", 1, "", eff="20200105"), claim(4, "a", 1, "x", eff="2020-01-07"), claim(5, "a", 1, "y", "2020-01-31T23:30:00-01:00"),
        claim(6, "b", 1, None, eff="2020-01-01"), claim(7, "c", 1, "q", "bad", None), claim(8, None, 1, "q", eff="2020-01-01"), claim(9, "d", 1, "old", "2020-01-01T00:00:00Z", "2020-01-01"), claim(10, "d", 1, "new", "2020-01-02T00:00:00Z", "2020-01-01"),
    ]
    data += data[:3]
    assert found4(spark, data) == [("a", "2020-01-01", "2020-01-05"), ("a", "2020-01-07", "2020-02-01"), ("a", "2020-02-01", "9999-12-31"), ("d", "2020-01-01", "9999-12-31")]


def test_merge_runs_like_a_scan():
    import numpy as np

    r = random.Random(7)
    for _ in range(200):
        n = r.randrange(0, 40)
        e = np.sort(np.array([r.randrange(3) for _ in range(n)], dtype=np.int64))
        p = np.array([r.randrange(2) for _ in range(n)], dtype=np.int64)
        s = np.arange(n, dtype=np.int64)
        end = s + 1 - np.array([r.random() < 0.2 for _ in range(n)], dtype=np.int64) * 0
        gap = np.array([r.random() < 0.2 for _ in range(n)], dtype=bool)
        s = s * 10
        end = np.where(gap, s + 5, s + 10)
        want = []
        for i in range(n):
            if want and want[-1][0] == e[i] and want[-1][3] == p[i] and want[-1][2] == s[i]:
                want[-1][2] = end[i]
            else:
                want.append([e[i], s[i], end[i], p[i]])
        got = [list(x) for x in zip(*merge_runs(e, s, end, p), strict=True)] if n else []
        assert [[int(v) for v in x] for x in got] == [[int(v) for v in x] for x in want]


EVID = "evidence_id long, source_type string, retrieved_at string, published_at string, as_of string, id string, field string, chain string, zone string"


def found2(spark, data, zones=(("a", 1, "Europe/Oslo"), ("u", 1, "UTC"))):
    df = spark.createDataFrame([(*d, "clash", "clash", "clash", "clash") for d in data], EVID)
    s = spark.createDataFrame(list(zones), "source_class string, source_authority int, local_zone string")
    return rows(unambiguous_times(df, s), "evidence_id", "field", "utc")


def test_times_as_brute_force(spark, sf_small):
    c = duckdb.connect()
    zones = dict(c.execute(f"select source_class, local_zone from '{sf_small}/source_catalog.parquet'").fetchall())
    t = [(i, f, x, s) for f in ("retrieved_at", "published_at", "as_of") for i, x, s in c.execute(f"select evidence_id, {f}, source_type from '{sf_small}/evidence.parquet' where {f} is not null").fetchall()]
    df = unambiguous_times(spark.read.parquet(f"{sf_small}/evidence.parquet"), spark.read.parquet(f"{sf_small}/source_catalog.parquet"))
    assert set(rows(df, "evidence_id", "field", "utc")) == brute.utc_times(t, zones)


@pytest.mark.parametrize(
    "text,utc",
    [
        ("2020-10-25 02:30:00", "2020-10-25T00:30:00.000000Z"), ("2021-03-28 02:30:00", "2021-03-28T01:30:00.000000Z"), ("2020-06-01", "2020-05-31T22:00:00.000000Z"), ("2020-W53-7", "2021-01-02T23:00:00.000000Z"), ("2020-366", "2020-12-30T23:00:00.000000Z"),
        ("2021-366", None), ("2021-02-29", None), ("25:61", None), ("", None), (" \t", None), ("ukjent", None), ("1577836800", "2020-01-01T00:00:00.000000Z"), ("1577836800123456", "2020-01-01T00:00:00.123456Z"), ("2020-01-01T00:00:00.1234567Z", "2020-01-01T00:00:00.123456Z"),
        ("12:05 am on 3 May 2024", "2024-05-02T22:05:00.000000Z"), ("12:05 pm on 3 May 2024", "2024-05-03T10:05:00.000000Z"), ("Fri, 01 Aug 2025 12:55:03 +0200", "2025-08-01T10:55:03.000000Z"), ("2020-01-01 00:00:00 CEST", "2019-12-31T22:00:00.000000Z"),
        ("2020-01-01 00:00:00 America/New_York", "2020-01-01T05:00:00.000000Z"), ("2020-01-01T00:00:00 XX", None), ("fredag 10. april 2020 01:45", "2020-04-09T23:45:00.000000Z"), ("x" * 100_000, None),
    ],
)
def test_time_readings(spark, text, utc):
    assert [r[2] for r in found2(spark, [(1, "a", text, None, None)])] == ([utc] if utc else [])


def test_times_order_is_chosen_by_source(spark):
    data = [(i, "a", f"{13 + i % 10:02d}/03/2020", None, None) for i in range(30)] + [(i + 100, "u", f"03/{13 + i % 10:02d}/2020", None, None) for i in range(30)]
    data += [(50, "a", "04/03/2020", None, None), (150, "u", "04/03/2020", None, None), (51, "a", "31/02/2020", None, None), (52, "zz", "2020-01-01", None, None), (53, None, "2020-01-01T00:00:00Z", None, None)]
    got = {r[0]: r[2][:10] for r in found2(spark, data)}
    assert got[50] == "2020-03-03" and got[150] == "2020-04-03" and 51 not in got and got[52] == got[53] == "2020-01-01"
    assert found2(spark, []) == []


def test_viterbi_in_parts_is_viterbi():
    import numpy as np

    from sporlake.operators.timestamps import _single

    r = np.random.default_rng(3)
    reads = r.integers(0, 10**6, (60, 3)) * 10**6
    reads[r.random((60, 3)) < 0.3] = -(2**63)
    whole = decode(np.stack([reads, reads], axis=1), _single(reads))[:, 0]
    cut = [reads[a:b] for a, b in ((0, 7), (7, 8), (8, 40), (40, 60))]
    parts = [total(np.stack([c, c], axis=1), _single(c)) for c in cut]
    ends = decode(np.stack([np.stack([c[0], c[-1]]) for c in cut]), parts)
    again = np.concatenate([decode(np.stack([c, c], axis=1), _single(c), int(e[0]), int(e[1]))[:, 0] for c, e in zip(cut, ends, strict=True)])

    def cost(p):
        m = np.stack([reads, reads], axis=1)
        from sporlake.operators.timestamps import _step

        s = _single(reads)
        return sum(s[k][p[k], p[k]] for k in range(60)) + sum(_step(m[k - 1, 1], m[k, 0])[p[k - 1], p[k]] for k in range(1, 60))

    assert cost(again) == pytest.approx(cost(whole))
