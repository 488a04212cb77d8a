"""The graph of stages, the run from tables to files, the lattice of books."""

import json


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import books, joins
from panelspark.plans import pipeline, tune, whole
from panelspark.plans.graph import Graph, contents_tag
from panelspark.spec import Settings


# ---------------------------------------------------------------- graph
def test_only_what_lies_below_a_change_is_made_again(spark, tmp_path):
    def built(a_rows, factor=2):
        g = Graph(spark, f"file://{tmp_path}/root")
        g.frame("a", spark.createDataFrame(a_rows, "k long, v double"))
        g.files("b", f"file://{tmp_path}/b")
        g.stage("doubled", lambda a: a.withColumn("v", F.col("v") * factor), "a", settings=factor)
        g.stage("other", lambda b: b.withColumn("w", F.col("k") + 1), "b")
        g.value("most", lambda d: d.agg(F.max("v").alias("m")).first()["m"], "doubled")
        g.stage("above", lambda b, most: b.withColumn("most", F.lit(most)), "other", "most")
        return g, sorted(map(tuple, g.get("above").collect()))

    spark.range(3).select(F.col("id").alias("k")).write.parquet(f"file://{tmp_path}/b")
    g, got = built([(1, 1.0), (2, 5.0)])
    assert got == [(0, 1, 10.0), (1, 2, 10.0), (2, 3, 10.0)] and sorted(g.ran) == ["above", "doubled", "most", "other"]
    assert built([(2, 5.0), (1, 1.0)])[0].ran == []  # the same rows in another order
    # another frame whose greatest value is the same: what follows from the value is read
    g, again = built([(1, 2.0), (2, 5.0)])
    assert again == got and sorted(g.ran) == ["doubled", "most"]
    g, got = built([(1, 2.0), (2, 7.0)])
    assert got[0] == (0, 1, 14.0) and sorted(g.ran) == ["above", "doubled", "most"]
    g, got = built([(1, 2.0), (2, 7.0)], 3)
    assert got[0] == (0, 1, 21.0) and "other" not in g.ran
    # one more file of b
    spark.range(3, 4).select(F.col("id").alias("k")).write.mode("append").parquet(f"file://{tmp_path}/b")
    g, got = built([(1, 2.0), (2, 7.0)], 3)
    assert len(got) == 4 and sorted(g.ran) == ["above", "other"]
    assert {r["name"] for r in g.lineage()} == {"a", "b", "doubled", "other", "most", "above"}
    with pytest.raises(ValueError):
        g.stage("x", lambda y: y, "nowhere")


def test_contents_tags_tell_rows_counts_and_schemas_apart(spark):
    make = lambda rows, schema="k long, v double": contents_tag(spark.createDataFrame(rows, schema))
    assert make([(1, 1.0), (2, None)]) == make([(2, None), (1, 1.0)])
    tags = [make([(1, 1.0)]), make([(1, 1.0)] * 2), make([(1, 1.0)] * 3), make([]), make([(1, None)]), make([(None, 1.0)]), make([(1, 1.0)], "k long, w double")]
    assert len(set(tags)) == len(tags)


# ---------------------------------------------------------------- from tables to files
S = Settings(
    ridge_alphas=(1.0,), risk_min_months=6, risk_window=24, spec_window=12, spec_min=4, per_side=10, max_weight=0.3, lambda_tc=(0.1,), lambda_beta=(10.0,), lambda_risk=(0.0,), lambda_factor=(0.0,),
    gru_epochs=1, gru_hidden=4, gru_decay=(0.0,), size_quantile=0.05, missing_share=0.2, beta_check_t=1e9,
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(3)
    rows, docs = [], []
    for m in range(64):
        t = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
        f = rng.uniform(-1, 1, (32, 2))
        y = 0.04 * f[:, 0] + 0.03 * rng.normal(size=32)
        for i in range(32):
            b = 1 + 0.2 * rng.normal()
            rows.append((i, t, 10.0 + i, float(50 + i), float(20 + (7 * i + m) % 30), float((i * 3 + m) % 9) / 9, "ab"[i % 2] + "x9", float(y[i]), float(y[i]), float(f[i, 0]), float(f[i, 1]) if i % 3 else None, b, b + 0.1, f"T{i}", f"Firm {i}"))
            if (i + m) % 5 == 0:
                docs.append((len(docs), i, str(t.replace(day=5)), ["1.01"] if i % 2 else ["2.02", "1.01"], "good gain for Firm" if y[i] > 0 else "bad loss", f"h{len(docs)}", f"Firm {i}", f"T{i}"))
    names = "id long, month date, price double, size double, volume double, idle double, code string, target double, ret double, f0 double, f1 double, b0 double, b1 double, ticker string, company_name string"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"file://{root}/panel")
    spark.createDataFrame(docs, "document_id long, id long, filing_date string, items array<string>, text string, text_sha256 string, company_name string, ticker string").write.parquet(f"file://{root}/filings")
    months = sorted({r[1] for r in rows})
    spark.createDataFrame([(str(t), 2.0) for t in months], "eom string, tb3ms double").coalesce(1).write.csv(f"file://{root}/rate", header=True)
    spark.createDataFrame([(str(t), float(0.01 * rng.normal())) for t in months[1:]], "eom string, sp500_ret double").coalesce(1).write.csv(f"file://{root}/index", header=True)
    at = lambda name: f"file://{root}/{name}"
    return whole.Inputs(
        at("panel"), at("filings"), at("rate"), at("index"), ("f0", "f1"), ("f0",), ("b0", "b1"), "b0", (2000, 2001), "1997-12-31", entity="id", period="month", beta_raw="b1", flags=("1.01", "2.02"), counted=("1.01",),
        embedding_sizes=(1, 2), short_limits=(0.2, 0.4), buckets=4, filter_rounds=2,
    )


def read_json(spark, path):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def test_a_run_from_tables_to_files(spark, tables, tmp_path):
    root, out_dir = f"file://{tmp_path}/root", f"file://{tmp_path}/out"
    out, files, g = whole.run(spark, tables, root, out_dir, S, "ridge", "spec", select=False, ablate=False, stop_on_leak=False)
    assert {"panel", "universe", "betas", "events", "tones", "embedding_1", "embedding_2", "frame", "predictions"} <= {r["name"] for r in out.lineage}
    assert set(files) >= {"predictions.parquet", "holdings.csv", "returns.csv", "settings_log.json", "statistics.json", "leakage_tests.json", "ablations.json", "failed_inputs.parquet", "charts/contributors.parquet", "charts/return_histogram.parquet"}
    assert sum(f.startswith("charts/") for f in files) == 7
    # the axes: one frame, a size and a limit in each row, the choice among them
    first = out.net["first_grid"]
    assert {(r["d"], r["short_q"]) for r in first} == {(d, q) for d in (1, 2) for q in (0.2, 0.4)} and out.choice["d"] in (1, 2) and out.choice["short_q"] in (0.2, 0.4)
    assert {r["short_q"] for r in out.grid} == {0.2, 0.4} and f"gru{out.choice['d']}_1" in out.features
    preds = spark.read.parquet(files["predictions.parquet"])
    assert preds.columns == ["entity", "eom", "score", "ret_hat"] and preds.where("ret_hat IS NULL").count() == 0 and preds.count() > 300
    assert out.stats["mean_ic"] > 0.2 and out.stats["oos_r2"] is not None
    assert spark.read.csv(files["returns.csv"], header=True).columns == ["Date", "total", "excess", "active", "long_leg", "short_leg", "benchmark", "sp500"]
    assert spark.read.csv(files["holdings.csv"], header=True).columns == ["Date", "PERMNO", "TICKER", "COMPANY NAME", "WEIGHT"]
    log = read_json(spark, files["settings_log.json"])
    assert log["net_of_fee"]["ir_net"] < log["net_of_fee"]["ir"] and log["net_of_fee"]["spec_book"]["ir"] == pytest.approx(log["book_selection"]["test"]["spec"]["ir"])
    assert read_json(spark, files["leakage_tests.json"])["passed"] is True
    # nothing changed: the stages are read
    g2 = Graph(spark, root)
    whole.stages(g2, tables, S)
    assert g2.get("frame").count() == g.get("frame").count() and g2.ran == []
    # other text in one input: what hangs on filings is made, what does not is read
    spark.createDataFrame([(9999, 1, "1999-03-05", ["1.01"], "strong growth", "new", "Firm 1", "T1")], spark.read.parquet(tables.filings).schema).write.mode("append").parquet(tables.filings)
    g3 = Graph(spark, root)
    whole.stages(g3, tables, S)
    g3.get("frame")
    assert sorted(g3.ran) == ["doc_tones", "events", "frame", "tones"]


def test_another_frame_under_one_root_gives_other_predictions(spark, tmp_path):
    from panelspark.operators import learn

    def frame(sign):
        rows = []
        for m in range(60):
            t = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
            x = np.random.default_rng(m).uniform(-1, 1, 12)
            rows += [(i, t, (pd.Timestamp(t) + pd.offsets.MonthEnd(1)).date(), float(sign * x[i]), float(x[i]), float(x[i] ** 2)) for i in range(12)]
        return spark.createDataFrame(rows, "entity long, eom date, target_month date, target double, f0 double, f1 double")

    got = []
    for sign in (1, -1, 1):
        g = Graph(spark, f"file://{tmp_path}")
        g.frame("frame", frame(sign))
        g.stage("predictions", lambda f: learn.with_ret_hat(learn.run_schedule(f, ["f0", "f1"], [2000], S, "ridge"), f), "frame", settings=S)
        got.append((g.get("predictions").agg(F.corr("score", "ret_hat"), F.max("val_ic"), F.sum("score")).first(), g.ran))
    assert got[0][0] == got[2][0] != got[1][0] and [r for _, r in got] == [["predictions"], ["predictions"], []]


def test_a_leak_stops_the_run_and_inputs_of_failed_months_are_kept(spark, tmp_path):
    rows = []
    for m in range(66):
        t = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
        x = np.random.default_rng(m).normal(size=14)
        rows += [(i, t, (pd.Timestamp(t) + pd.offsets.MonthEnd(1)).date(), float(0.05 * x[i]), "ab"[i % 2], True, 1.0, 0.02, float(10 + i), float(x[i]), float(x[i])) for i in range(14)]
    df = spark.createDataFrame(rows, "entity long, eom date, target_month date, target double, sector string, short_eligible boolean, beta_kf double, beta_var double, size_raw double, f0 double, lead double")
    months = sorted({r[1] for r in rows})
    market = spark.createDataFrame([(t, 2.0, 0.001 * i) for i, t in enumerate(months)], "eom date, rate double, index_ret double")
    s = S.but(max_weight=0.01)  # fourteen names can't hold the gross, so every month is held
    with pytest.raises(pipeline.LeakError, match="lead"):
        pipeline.run(spark, df, ["f0", "lead"], ["f0"], market, [2000], s, "ridge", "spec", root=f"file://{tmp_path}/a")
    out = pipeline.run(spark, df, ["f0", "lead"], ["f0"], market, [2000], s, "ridge", "spec", root=f"file://{tmp_path}/a", stop_on_leak=False)
    assert not out.leaks["passed"] and "lead" in out.leaks["suspects"] and out.weights.count() == 0
    kept = out.failed
    assert kept.select("eom").distinct().count() == 12 and {"entity", "eom", "score", "beta_kf", "sector", "status"} <= set(kept.columns) and kept.count() == 12 * 14
    kept.write.parquet(f"file://{tmp_path}/failed")
    assert spark.read.parquet(f"file://{tmp_path}/failed").where("status LIKE 'hold%'").count() == 12 * 14


# ---------------------------------------------------------------- lattice
def test_a_lattice_equals_separate_runs(spark):
    """Six axes in one frame: ratios of all books at once are those of each size and limit by itself."""
    rng = np.random.default_rng(8)
    rows, scores = [], []
    for m in range(6):
        t = (pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(m)).date()
        for i in range(24):
            rows.append((i, t, float(0.1 * rng.normal()), "ab"[i % 2], float(1 + 0.1 * rng.normal()), 0.02, float(5 + i), i / 24, (i * 5 % 24) / 24, bool(i % 4)))
            scores += [(d, i, t, float(rng.normal())) for d in (8, 16)]
    frame = spark.createDataFrame(rows, "entity long, eom date, target double, sector string, beta_kf double, beta_var double, size_raw double, size_pct double, volume_pct double, calm boolean")
    preds = spark.createDataFrame(scores, "d long, entity long, eom date, score double")
    market = spark.createDataFrame([((pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(m)).date(), 1.0, 0.01 * m) for m in range(8)], "eom date, rate double, index_ret double")
    s = S.but(max_weight=0.4, gross=1.0)
    six = {"d": (8, 16), "short_q": (0.1, 0.5), "lam_tc": (0.0, 0.1), "lam_beta": (10.0,), "lam_risk": (0.0,), "lam_factor": (0.0,)}
    grid = joins.grid(spark, **six)
    desk = pipeline.Desk(frame, market, s)
    together = {(r["d"], r["short_q"], r["lam_tc"]): (r["ir"], r["n_months"]) for r in desk.ratios(desk.weights(preds, "spec", grid, limits=[0.1, 0.5]), grid).collect()}
    assert len(together) == 8 and all(v[1] == 6 for v in together.values()) and len({v[0] for v in together.values()}) > 4
    own = joins.grid(spark, **{k: v for k, v in six.items() if k not in ("d", "short_q")})
    for d in (8, 16):
        for q in (0.1, 0.5):
            alone = pipeline.Desk(pipeline._with_limit(frame, q, s), market, s)
            for r in alone.ratios(alone.weights(preds.where(F.col("d") == d).drop("d"), "spec", own), own).collect():
                assert together[d, q, r["lam_tc"]] == (pytest.approx(r["ir"], rel=1e-6), r["n_months"])
    assert tune.choose(desk.ratios(desk.weights(preds, "spec", grid, limits=[0.1, 0.5]), grid))["d"] in (8, 16)


def test_variants_of_betas_in_one_run(spark):
    rng = np.random.default_rng(9)
    rows = []
    for m in range(14):
        t = (pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(m)).date()
        rows += [(i, t, float(rng.normal()), float(0.1 * rng.normal()), "ab"[i % 2], float(1 + 0.3 * rng.normal()), 0.02, True, float(5 + i)) for i in range(16)]
    frame = spark.createDataFrame(rows, "entity long, eom date, score double, target double, sector string, beta_kf double, beta_var double, short_eligible boolean, size_raw double")
    market = spark.createDataFrame([((pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(m)).date(), 1.0, float(0.02 * rng.normal())) for m in range(16)], "eom date, rate double, index_ret double")
    s = S.but(max_weight=0.4, gross=1.0)
    desk, val = pipeline.Desk(frame.drop("score"), market, s), frame.select("entity", "eom", "score")
    some = {"kf": frame.select("entity", "eom", "beta_kf", "beta_var"), "flat": frame.select("entity", "eom", F.lit(1.0).alias("beta_kf"), "beta_var")}
    one = joins.grid(spark, lam_tc=(0.1,), lam_beta=(10.0,), lam_risk=(0.0,), lam_factor=(0.0,))
    found = pipeline.variant_betas(desk, val, one, some).collect()
    assert [abs(r["beta"]) for r in found] == sorted(abs(r["beta"]) for r in found) and {r["beta_set"] for r in found} == {"kf", "flat"}
    from panelspark.operators import betas

    for r in found:
        alone = pipeline.Desk(betas.swapped(desk.frame, some[r["beta_set"]]), market, s)
        told = alone.told(alone.weights(val, "spec", one))
        assert r["beta"] == pytest.approx(told["beta"], rel=1e-6) and r["ir"] == pytest.approx(told["ir"], rel=1e-6)


def test_the_ladder_of_limits():
    s = Settings()
    got = books.v2_ladder(s)
    assert got[0] == (s.sector_band, s.size_band, s.v2_beta_tol, 1.0) and len(got) == 1 + 9 + 48 + 7 and got[-1][3] == 4.0
    assert got[9][0] == pytest.approx(s.sector_band + 0.45) and got[57][2] == pytest.approx(0.5) and got[58][3] == 1.25
    assert all(sum(a != b for a, b in zip(x, y)) in (1, 2) and all(b >= a for a, b in zip(x, y)) for x, y in zip(got, got[1:]))
