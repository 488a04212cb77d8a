"""Ranks by range and quantiles by selection, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranging, selection


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ranks_by_range_with_ties_over_borders(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows = [(i, int(p), None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(x)) for i, (p, x) in enumerate(zip(rng.integers(0, 3, 900), rng.choice([0.0, 1.0, 1.0, 1.0, 2.5, -7.0, 1e300], 900)))]
    rows += [(1000 + i, 7, float(i)) for i in range(40)] + [(2000, 8, 5.0), (2001, 9, None), (2002, None, 1.0)]
    df = spark.createDataFrame(rows, "entity long, eom int, v double").repartition(4)
    got = ranging.ranked(df, "v", "eom", ["entity"], partitions).withColumns({"avg": ranging.average(), "pct": ranging.percent(), "ten": ranging.tenth(), "sc": ranging.scaled(), "ds": ranging.dense_scaled(), "pr": ranging.prediction()}).toPandas()
    assert len(got) == len(rows) and sorted(got["entity"]) == sorted(r[0] for r in rows)
    want = pd.DataFrame(rows, columns=["entity", "eom", "v"]).set_index("entity")
    want.loc[want["eom"].isna(), "v"] = np.nan
    g = want.groupby("eom", dropna=False)["v"]
    want["avg"], want["pct"] = g.rank(), g.rank(pct=True)
    want = want.reset_index().sort_values(["eom", "v", "entity"])
    n = want.groupby("eom")["v"].transform("count")
    want["ten"] = np.where(want["v"].notna(), (want.groupby("eom").cumcount() * 10) // n.clip(lower=1), np.nan)
    want["sc"] = np.where(n > 1, (want["avg"] - 1) / (n - 1).clip(lower=1) * 2 - 1, np.where(want["v"].notna(), 0.0, np.nan))
    dense = want.groupby("eom")["v"].rank("dense") - 1
    most = dense.groupby(want["eom"]).transform("max")
    want["ds"] = np.where(most > 0, dense / most.clip(lower=1) * 2 - 1, 0.0)
    want["ds"] = want["ds"].where(want["v"].notna(), 0.0)
    want["pr"] = 2 * want["avg"] / (n + 1) - 1
    both = got.merge(want, on="entity", suffixes=("", "_w"))
    for c in ("avg", "pct", "ten", "sc", "ds", "pr"):
        assert np.allclose(both[c].astype(float), both[f"{c}_w"].astype(float), equal_nan=True), c


def test_one_period_spreads_over_all_tasks(spark):
    """60,000 rows of one period, a third of them one value: no range holds more than two sixtieths."""
    df = spark.range(60_000).select(F.col("id").alias("entity"), F.lit(1).alias("eom"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(7)).alias("v"))
    got = ranging.ranked(df, "v", "eom", ["entity"], 60).select("entity", "v", "_rank.*")
    path = got.inputFiles()
    assert got.agg(F.max("place"), F.count_distinct("place"), F.max("n")).first() == (60_000, 60_000, 60_000)
    hot = got.where("v = 0.5").agg(F.count_distinct("less"), F.min("ties"), F.max("ties"), F.count("*")).first()
    assert hot[0] == 1 and hot[1] == hot[2] == hot[3] >= 20_000
    ranges = spark.read.parquet(*[p for p in path if "/ranges-" in p]).groupBy("_range").count()
    assert ranges.count() >= 55 and ranges.agg(F.max("count")).first()[0] <= 2 * 60_000 / 60


@pytest.mark.parametrize("gather", [0, 5, 1000])
def test_quantiles_by_selection(spark, monkeypatch, gather):
    monkeypatch.setattr(selection, "GATHER", gather)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = np.random.default_rng(gather)
    a, b = np.exp(5 * rng.normal(size=700)), rng.choice([1.0, 1.0, 2.0, -3e300, 3e300], 700)
    rows = [(i % 3, float(a[i]) if i % 11 else None, float(b[i]) if i % 7 else float("nan")) for i in range(700)] + [(5, 1.0, None), (6, None, None), (7, 1.0, 2.0), (7, 3.0, 2.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(3)
    shares = [0.0, 0.01, 0.2, 0.5, 0.99, 1.0]
    for how in ("linear", "nearest"):
        got = {(r["g"], r["name"], r["share"]): r["value"] for r in selection.quantiles(df, ["a", "b"], shares, ["g"], how).collect()}
        want = {}
        for g in (0, 1, 2, 5, 7):
            for k, name in ((1, "a"), (2, "b")):
                x = np.sort([r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]])
                for q in shares if len(x) else ():
                    at = q * (len(x) - 1)
                    low, part = int(np.floor(at)), at - np.floor(at)
                    high = min(low + 1, len(x) - 1)
                    want[g, name, q] = x[int(np.floor(at + 0.5))] if how == "nearest" else x[low] if x[low] == x[high] or part == 0 else (1 - part) * x[low] + part * x[high]
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-12), (how, k)


def test_whole_columns_medians_and_fills(spark):
    df = spark.createDataFrame([(1, 1, 2.0, None), (2, 1, None, None), (3, 1, 4.0, None), (4, 2, float("nan"), None), (5, None, None, 1.0)], "k int, eom int, a double, b double")
    assert selection.bounds(df, ["a", "b"], [0.5]) == {"a": [3.0], "b": [1.0]}
    assert selection.bounds(df.limit(0), ["a"], [0.5]) == {"a": None}
    assert selection.medians(df, ["a"], ["eom"]).collect()[0].asDict() == {"eom": 1, "a": 3.0}
    got = {r["k"]: (r["a"], r["b"]) for r in selection.median_filled(df, ["a", "b"]).collect()}
    assert got == {1: (2.0, 1.0), 2: (3.0, 1.0), 3: (4.0, 1.0), 4: (3.0, 1.0), 5: (3.0, 1.0)}
    infinite = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,)], "a double")
    assert selection.bounds(infinite, ["a"], [0.5]) == {"a": [0.0]}


def test_no_percentile_buffer_in_the_plan(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("eom"), F.col("id").cast("double").alias("a"))
    plan = selection.quantiles(df, ["a"], [0.5], ["eom"])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan
