"""The whole run for each kind of book, on a small panel; streams."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import betas
from panelspark.plans import pipeline
from panelspark.spec import Settings
from panelspark.streaming import scoring

S = Settings(
    ridge_alphas=(1.0,), risk_min_months=6, risk_window=24, spec_window=12, spec_min=4, per_side=15, max_weight=0.2, v2_max_weight=0.2, v3_smooth=(1.0, 0.5), v4_windows=(6,), v4_gross=(1.0,), v4_risk=(1.0,), v4_turnover=(0.0, 0.05),
    v4_min_names=4, v4_beta_limit=0.5, v4_size_balance=0.5, lambda_tc=(0.1,), lambda_beta=(10.0,), lambda_risk=(0.0,), lambda_factor=(0.0, 100.0), rank_depths=(2,), rank_trees=20, rank_every=10, rank_leaf_weight=5.0,
    cfi_min_pairs=10, cfi_min_months=3, cfi_repeats=1, cfi_shares=(0.5,), cfi_cuts=(0.75,), beta_check_t=0.0,
)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m in range(70):
        t = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
        f = rng.uniform(-1, 1, (50, 3))
        y = 0.03 * f[:, 0] + 0.05 * rng.normal(size=50)
        b = 1 + 0.2 * rng.normal(size=50)
        rows += [(i, t, (pd.Timestamp(t) + pd.offsets.MonthEnd(1)).date(), float(y[i]), "ab"[i % 2], i % 3 > 0, float(b[i]), 0.02, float(1 + i), int(i % 4 == 0), f"T{i}", f"name {i}", *map(float, f[i])) for i in range(50)]
    names = "entity long, eom date, target_month date, target double, sector string, short_eligible boolean, beta_kf double, beta_var double, size_raw double, has_filing int, ticker string, company_name string, f0 double, f1 double, f2 double"
    df = spark.createDataFrame(rows, names).repartition(4)
    months = sorted({r[1] for r in rows})
    market = spark.createDataFrame([(t, 2.0, float(0.01 * rng.normal())) for t in months], "eom date, rate double, index_ret double")
    filings = df.where("has_filing = 1").select("entity", F.date_add("eom", -3).alias("filing_date"))
    return df, market, df.select("entity", "eom", F.col("target").alias("ret")), filings


def test_a_run_of_all_books(spark, world, tmp_path):
    """Every book on validation months, betas fixed, the choice among them, its run on test months, the checks and the report."""
    df, market, rets, filings = world
    tried = lambda model: betas.variants(df, model, ["f1"], ["a", "b"], df.select("entity", "eom", F.lit(1.5).alias("beta_raw")))
    out = pipeline.run(spark, df, ["f0", "f1", "f2"], ["f1"], market, [2000, 2001], S, "ridge", "auto", root=f"file://{tmp_path}", returns_history=rets, filings=filings, variants=tried)
    tells = out.selection["validation"]
    assert set(tells) == {"spec", "v2", "v3_s1", "v3_s0.5", "v4"} and out.choice["book"] == out.selection["chosen"]
    fine = {k: v for k, v in tells.items() if v["beta"] is not None and abs(v["beta"]) <= 0.2}
    assert not fine or tells[out.choice["book"]]["ir"] == max(v["ir"] for v in fine.values())
    w = out.weights.groupBy("eom").agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n")).collect()
    assert len(w) >= 20 and all(r["g"] > 0.5 and abs(r["n"]) < 0.5 for r in w)
    assert out.stats["mean_ic"] > 0.2 and out.leaks["passed"] and abs(out.leaks["shuffled_ic"]) < 0.15
    assert [i["test_year"] for i in out.infos] == [2000, 2001] and all(i["max_target"] < date(i["test_year"], 1, 1) for i in out.infos)
    assert out.beta["warning"] and set(out.beta["variants"]) == {"kf", "b60_shrunk", "factor"} and out.beta["chosen"] in out.beta["variants"]
    assert {len(v) for v in out.selection["v4"].values()} == {2} and set(out.selection["v4"]) == {2000, 2001}
    report = pipeline.pack(out, df, None)
    assert report["unlabelled"] == 0 and report["composition"].count() == 1 and report["holdings"].count() == out.weights.count() and report["statistics"] is out.stats
    desk, grid = pipeline.Desk(df, market, S), spark.createDataFrame([(0, 1.0)], "config_id long, smooth double")
    got = pipeline.ablations(desk, df, {"all": (["f0", "f1"], "ridge"), "without_f0": (["f1"], "ridge")}, [2001], S, "v3", grid)
    assert set(got) == {"all", "without_f0"} and got["all"]["test_ic"] > got["without_f0"]["test_ic"] + 0.1
    assert got["all"]["has_filing_ic"] is not None and set(got["all"]["val_ic_by_year"]) == {2001}


def test_streamed_filings_are_scored_once(spark, tmp_path):
    src, out, check = (f"file://{tmp_path / n}" for n in ("in", "out", "check"))
    first = spark.createDataFrame([(1, "good words"), (2, "bad")], "document_id long, text string")
    first.write.parquet(src)
    for n in (2, 2, 3):
        if n == 3:
            spark.createDataFrame([(3, "fine")], first.schema).write.mode("append").parquet(src)
        scoring.score_stream(spark, src, first.schema, out, check).awaitTermination(120)
        assert spark.read.parquet(out).count() == n
    events = spark.createDataFrame([(datetime(2024, 1, 1, 5), "a"), (datetime(2024, 1, 1, 9), "a"), (datetime(2024, 1, 2), "b")], "ts timestamp, event_type string")
    assert sorted((r["start"].day, r["event_type"], r["n"]) for r in scoring.event_counts(events).collect()) == [(1, "a", 2), (2, "b", 1)]
