"""Exact medians by radix selection: all values distinct, ties, negatives."""

import random
import statistics

import pytest

from reviewlens.operators import profile as pf


@pytest.mark.parametrize("limit", [3, 200])
@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_median_of_distinct_values_equals_the_sorted_one(spark, monkeypatch, limit, n):
    monkeypatch.setattr(pf, "WINDOW_ROWS", limit)
    rng = random.Random(n)
    rows = [(rng.uniform(0.5, 1) if i % 5 else rng.choice([-1e300, 1e-300, -0.0, 0.0, 3.5, -7.25, None]),
             rng.randint(-5, 5), float(i), rng.choice(["train", "test"])) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, k int, y double, split string")
    got = {r.measure: r for r in pf.numeric_summary(df, ("x", "k", "y")).collect()}
    for i, c in enumerate(("x", "k", "y")):
        known = [r[i] for r in rows if r[i] is not None]
        assert got[c].n == len(known)
        if known:
            assert got[c].median == pytest.approx(statistics.median(known), abs=0)
            assert (got[c].min, got[c].max) == (min(known), max(known))
            assert got[c].mean == pytest.approx(statistics.fmean(known), rel=1e-9)


def test_both_ways_give_the_same_profile(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame(
        [(rng.choice("ab"), rng.choice([None, 1, 2, 5]), rng.random() * 5, rng.randint(0, 3000), "c", rng.choice(["train", "test"]))
         for _ in range(2000)],
        "ai_classification string, extracted_rating int, store_avg_rating double, text_length int, store_category string, split string")
    want = {r.split: r.asDict() for r in pf.profile_scalars(df, ["split"]).collect()}
    monkeypatch.setattr(pf, "WINDOW_ROWS", 20)
    got = {r.split: r.asDict() for r in pf.profile_scalars(df, ["split"]).collect()}
    for side in ("train", "test"):
        assert {k: pytest.approx(v, rel=1e-9) for k, v in want[side].items() if k != "split"} == {
            k: v for k, v in got[side].items() if k != "split"}


def test_ordered_bits_sort_like_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(
        "i", pf.ordered_bits(pf.F.col("v")).alias("b")).orderBy("i").collect()
    bits = [r.b for r in rows]
    assert bits == sorted(bits) and len(set(bits)) == len(bits) - 1
