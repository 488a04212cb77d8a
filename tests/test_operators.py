"""Hand-made inputs, constraints, and changes to the future that must not change the past."""

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import ranks
from panelspark.operators import agent, betas, books, gru, joins, kalman, leakage, learn, metrics, report, risk, spread, text, universe
from panelspark.operators.convex import Problem, solve
from panelspark.plans import models, relational, tune
from panelspark.sources import tables
from panelspark.sources.tables import Materializer, jsonable
from panelspark.spec import Settings

D = [date(2020, m, d) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30), (5, 31), (6, 30))]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- ranks
def test_ranks_skip_nulls_and_nan(spark):
    df = frame(spark, [(1, D[0], 1.0), (2, D[0], 1.0), (3, D[0], 3.0), (4, D[0], None), (5, D[0], float("nan"))], "entity long, eom date, x double")
    got = {r["entity"]: r for r in df.select("entity", ranks.average_rank("x", "eom").alias("a"), ranks.pct_rank("x", "eom").alias("p"), ranks.zscore("x", "eom").alias("z"), ranks.rank_scaled("x", "eom").alias("s")).collect()}
    assert [got[i]["a"] for i in range(1, 6)] == [1.5, 1.5, 3.0, None, None] and got[3]["p"] == 1.0
    assert got[4]["z"] == 0.0 and got[3]["s"] == 1.0
    dense = {r["entity"]: r["x"] for r in ranks.with_dense_scaled(df, ["x"]).collect()}
    assert dense == {1: -1.0, 2: -1.0, 3: 1.0, 4: 0.0, 5: 0.0}
    same = ranks.with_dense_scaled(df.withColumn("x", F.lit(2.0)), ["x"]).collect()
    assert {r["x"] for r in same} == {0.0}


def test_quantile_nearest_and_linear(spark):
    df = spark.range(1, 51).select(F.lit(1).alias("eom"), F.col("id").cast("double").alias("x"))
    assert ranks.with_quantile(df, "q", "x", 0.2, "eom").first()["q"] == 11.0
    assert ranks.with_quantile(df, "q", "x", 0.2, "eom", "linear").first()["q"] == pytest.approx(10.8)


def test_universe_cut_is_over_all_rows(spark):
    df = spark.range(0, 50).select(F.col("id").alias("entity"), F.lit(D[0]).alias("eom"), F.when(F.col("id") % 7 == 0, -10.0).otherwise(F.when(F.col("id") % 5 == 0, 1.0).otherwise(20.0)).alias("prc"), (F.col("id") + 1).cast("double").alias("me"), (F.col("id") + 1).cast("double").alias("vol"))
    kept = {r["entity"] for r in universe.build_universe(df, "prc", "me", "vol").collect()}
    assert kept == {i for i in range(50) if i + 1 > 11 and (i % 7 == 0 or i % 5)}


def test_unique_keys(spark):
    df = frame(spark, [(1, 1), (1, 1)], "entity long, eom int")
    with pytest.raises(ValueError):
        universe.check_unique(df, ["entity", "eom"])
    assert leakage.duplicate_keys(df, ["entity"]).first()["duplicates"] == 1


# ---------------------------------------------------------------- joins, text
def test_asof_tie_takes_the_earlier(spark):
    left = frame(spark, [(1, date(2020, 1, 10)), (2, date(2020, 1, 10))], "k long, d date")
    right = frame(spark, [(1, date(2020, 1, 8), "a"), (1, date(2020, 1, 12), "b"), (1, date(2020, 1, 10), None)], "k long, t date, v string")
    assert {r["k"]: r["o"] for r in joins.asof_nearest(left, right, "k", "d", "t", "v", "o").collect()} == {1: "a", 2: None}


def test_event_flags_by_month(spark):
    f = frame(spark, [("a", 1, date(2020, 1, 5), ["1", "2"]), ("b", 1, date(2020, 1, 9), None), ("c", 1, date(2020, 2, 3), ["2"])], "document_id string, entity long, filing_date date, items array<string>")
    keys = frame(spark, [(1, date(2020, 1, 31)), (1, date(2020, 3, 31)), (1, date(2021, 1, 31)), (1, date(2021, 2, 28))], "entity long, eom date")
    got = {r["eom"]: r for r in text.event_flags(f, keys, ["1", "2"], ["2"]).collect()}
    jan, mar = got[date(2020, 1, 31)], got[date(2020, 3, 31)]
    assert (jan["has_filing"], jan["n_filings"], jan["item_1"], jan["hist_2"]) == (1, 2, 1, 1)
    assert (mar["has_filing"], mar["n_filings"], mar["item_1"], mar["hist_2"]) == (0, None, None, 2)
    assert got[date(2021, 1, 31)]["hist_2"] == 1 and got[date(2021, 2, 28)]["hist_2"] == 0


def test_anonymise(spark):
    assert text.anonymise_text("Acme Corp and ACME beat ALL of All", ["Acme", "Acme Corp"], ["ALL"]) == "  and   beat   of All"
    df = frame(spark, [("Acme x acmes ALL all", ["Acme"], ["ALL"])], "t string, n array<string>, k array<string>")
    got = df.select(text.anonymise(F.col("t"), F.col("n"), F.col("k")).alias("a"), text.anonymise_constant(F.col("t"), ["Acme"], ["ALL"]).alias("b")).first()
    assert got["a"] == got["b"] == "  x acmes   all"


def test_tones_and_chunks(spark):
    df = frame(spark, [(1, "good good bad x"), (2, ""), (3, None)], "document_id long, text string")
    got = {r["document_id"]: r for r in text.doc_tones(df, 4, 2).collect()}
    assert got[1]["tone_mean"] == 0.25 and got[1]["tone_min"] == -0.5 and got[2]["tone_mean"] is None and got[3]["tone_min"] is None
    model = text.doc_tones_model(df, lambda: lambda parts: [float(len(p)) for p in parts], 4, 2).collect()
    assert {r["document_id"]: r["tone_mean"] for r in model} == {1: 2.0, 2: None, 3: None}


def test_tones_of_whole_texts(spark, tmp_path):
    """tone_features reads a text to its end: what stands behind the first eight chunks counts."""
    words = ["x"] * 4080 + ["bad"] * 510 + ["good"] * 51
    df = frame(spark, [(720, " ".join(words), "en", "s")], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tones = text.doc_tones(df.withColumnRenamed("doc_id", "document_id"), most=None).first()
    assert (tones["tone_mean"], tones["tone_min"]) == (0.0, -1.0)
    got = relational.tone_features(spark, str(tmp_path)).first()
    assert (got["tone_mean"], got["tone_min"]) == (0.0, -1.0)


def test_quotes(spark):
    f = frame(spark, [("d1", date(2020, 1, 1), "He said “Net  sales rose”."), ("d2", date(2020, 3, 1), "later words")], "document_id string, filing_date date, text string")
    facts = frame(spark, [(1, "net sales ROSE", "d1"), (2, "net sales rose", "d9"), (3, "net sales", None), (4, "later words", "d2"), (5, " ", None)], "fact_id long, quote string, document_id string")
    assert {r["fact_id"] for r in text.verify_quotes(facts, f, F.lit("2020-01-31").cast("date")).collect()} == {1, 3}


# ---------------------------------------------------------------- metrics
def test_turnover_and_legs(spark):
    w = frame(spark, [(1, D[0], 1.0), (2, D[0], -1.0), (1, D[1], 0.7), (3, D[1], -0.7)], "entity long, eom date, weight double")
    assert {r["eom"]: round(r["turnover"], 9) for r in metrics.turnover(w).collect()} == {D[0]: 2.0, D[1]: 2.0}
    panel = frame(spark, [(1, D[0], 0.10), (2, D[0], None), (1, D[1], -0.1), (3, D[1], 0.2)], "entity long, eom date, target double")
    market = frame(spark, [(D[1], 12.0, 0.05), (D[2], 24.0, 0.01)], "eom date, rate double, index_ret double")
    got = {r["eom"]: r for r in metrics.book_returns(w, panel, market).collect()}
    a, b = got[D[0]], got[D[1]]
    assert (a["long_leg"], a["short_leg"], a["n_missing"], a["rf"]) == (0.1, 0.0, 1, 0.01) and a["total"] == pytest.approx(0.11)
    assert b["excess"] == pytest.approx(-0.07 - 0.14) and b["rf"] == 0.02 and a["date"] == date(2020, 2, 1)
    out = metrics.summary(metrics.book_returns(w, panel, market))
    assert out["n_months"] == 2 and out["max_drawdown"] < 0


def test_hac_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    y = 0.3 + 0.5 * x + rng.normal(size=60)
    got = metrics.ols_hac(frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double"), "y", "x", "t").first()
    X = np.c_[np.ones(60), x]
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    u = y - X @ b
    g = X * u[:, None]
    s = g.T @ g
    for k in range(1, 4):
        c = g[k:].T @ g[:-k]
        s += (1 - k / 4) * (c + c.T)
    inv = np.linalg.inv(X.T @ X)
    t = b / np.sqrt(np.diag(inv @ s @ inv))
    assert got["alpha"] == pytest.approx(b[0]) and got["beta"] == pytest.approx(b[1]) and got["alpha_t"] == pytest.approx(t[0]) and got["beta_t"] == pytest.approx(t[1])


# ---------------------------------------------------------------- learning
def panel_with_signal(n=40, months=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(months):
        eom = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
        f = rng.uniform(-1, 1, (n, 3))
        y = 0.05 * f[:, 0] + 0.02 * rng.normal(size=n)
        rows += [(i, eom, float(f[i, 0]), float(f[i, 1]), float(f[i, 2]), float(y[i])) for i in range(n)]
    return pd.DataFrame(rows, columns=["entity", "eom", "f0", "f1", "f2", "target"])


def test_pairwise_trees_find_a_planted_signal():
    f = panel_with_signal()
    f["label"] = f.groupby("eom")["target"].rank(method="first").sub(1).mul(10).floordiv(40)
    f["part"] = np.where(f["eom"] < date(1997, 7, 1), "train", np.where(f["eom"] < date(1998, 1, 1), "val", "test"))
    s = Settings(rank_trees=40, rank_every=20, rank_leaf_weight=5.0, rank_depths=(2,))
    out, info = learn.fit_window(f, ["f0", "f1", "f2"], s)
    both = out[out["part"] == "test"].merge(f, on=["entity", "eom"])
    days = both["eom"].to_numpy().astype("datetime64[D]").astype(int)
    assert info["val_ic"] > 0.5 and learn.mean_ic(days, both["score"].to_numpy(), both["target"].to_numpy()) > 0.5
    assert learn.fit_window(f, ["f0", "f1", "f2"], s, model="ridge")[1]["val_ic"] > 0.5
    again = f.copy()
    again.loc[again["part"] == "test", "target"] = 9.0
    assert np.array_equal(learn.fit_window(again, ["f0", "f1", "f2"], s)[0]["score"], out["score"])


def test_ridge_equals_closed_form(spark):
    f = panel_with_signal(20, 10)
    w, c = learn.ridge(spark.createDataFrame(f), ["f0", "f1", "f2"], "target", 3.0, F.lit(True))
    x, y = f[["f0", "f1", "f2"]].to_numpy(), f["target"].to_numpy()
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(w, want) and c == pytest.approx(y.mean() - x.mean(0) @ want)


def test_clusters_and_candidates(spark):
    f = panel_with_signal(30, 14)
    f["f3"] = f["f0"] + 0.01 * f["f1"]
    got = learn.clusters(spark.createDataFrame(f), ["f0", "f1", "f2", "f3"], Settings(cfi_min_pairs=10, cfi_min_months=3))
    assert got[0.75] == [["f0", "f3"], ["f1"], ["f2"]]
    assert learn.clusters(spark.createDataFrame(f), ["f0", "f1"], Settings(cfi_min_pairs=10, cfi_min_months=99))[0.75] == [["f0"], ["f1"]]
    rows = [(2000, 0.75, 0, 3, ["a", "b"], 0.1), (2000, 0.75, 1, 3, ["c"], 0.3), (2000, 0.75, 2, 3, ["d"], 0.1), (2000, 0.85, 0, 1, ["c"], 0.2)]
    found = frame(spark, rows, "test_year int, cut double, group_no int, n_groups int, members array<string>, drop double")
    assert sorted(r["members"] for r in learn.candidates(found, (0.25, 0.5, 0.75)).collect()) == [["a", "b", "c"], ["a", "b", "c", "d"], ["c"]]
    assert learn.complete_linkage(np.array([[0, 0.1, 0.5], [0.1, 0, 0.4], [0.5, 0.4, 0]]), 0.45) == [[0, 1], [2]]


def test_raw_features_are_scaled_where_they_are_correlated(spark, sf):
    """The same correlations as from scaled ranks, without a table of ranks kept: nothing is written."""
    nan = float("nan")
    rows = [(D[m], [1.0, 2.0, None, nan, 5.0, 5.0][i], float(i * i % 5), [3.0, None, 1.0, 2.0, 3.0, -1.0][i] if m else None) for m in (0, 1) for i in range(6)]
    df = frame(spark, rows, "eom date, a double, b double, c double")
    told = lambda x, **kw: sorted((r["eom"], r["i"], r["j"], str(r["rho"]), r["n"]) for r in learn.month_correlations(x, ["a", "b", "c"], **kw).collect())
    assert told(df, dense=True) == told(ranks.with_dense_scaled(df, ["a", "b", "c"]))
    kept = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Materializer, "scratch", lambda self, df, name: kept.append(name) or df)
        models.month_rank_correlations(spark, sf)
    assert not kept


def test_cfi_schedule_tries_all_that_the_settings_say(spark, sf, monkeypatch):
    asked = []

    def keep(df, features, factors, years, s):
        asked.append((features, factors, years, s))
        return df.selectExpr("1 AS test_year", "'val' AS part", "entity", "eom", "0D AS score", "0D AS val_ic", "1 AS n_features"), {}

    monkeypatch.setattr(models.learn, "selected_schedule", keep)
    models.cfi_schedule(spark, sf)
    features, factors, years, s = asked[0]
    assert factors == features and years == [1999, 2000, 2001]
    assert all(getattr(s, n) == getattr(Settings(), n) for n in ("rank_trees", "rank_every", "rank_depths", "cfi_repeats", "cfi_cuts", "cfi_shares"))


def test_a_subset_must_be_strictly_better():
    every, nan = ["a", "b", "c"], float("nan")
    assert learn.best_subset(0.1, [(0.1, ["a"])], every) == (every, 0.1)
    assert learn.best_subset(0.1, [(0.2, ["a", "b"]), (0.2, ["c"]), (nan, ["b"])], every) == (["c"], 0.2)
    assert learn.best_subset(nan, [(-0.3, ["a"])], every) == (["a"], -0.3)
    assert learn.best_subset(0.1, [(nan, ["a"])], every) == (every, 0.1)


def test_importance_finds_the_feature_that_matters(spark):
    f = panel_with_signal(40, 60)
    f["target_month"] = [(pd.Timestamp(d) + pd.offsets.MonthEnd(1)).date() for d in f["eom"]]
    df, s = spark.createDataFrame(f), Settings(rank_trees=30, rank_every=15, rank_leaf_weight=5.0, rank_depths=(2,), cfi_repeats=2, cfi_min_pairs=10, cfi_min_months=3)
    features = ["f0", "f1", "f2"]
    models = learn.fitted(df, features, [2000], s)
    tagged = learn.tag_windows(learn.labelled(df, features), [2000])
    got = {tuple(r["members"]): r["drop"] for r in learn.importance(tagged, features, models, {2000: {0.75: [["f0"], ["f1", "f2"]]}}, s).collect()}
    assert got[("f0",)] > 0.4 > 0.1 > abs(got[("f1", "f2")])
    # the same figures from all months at once, rows moved month by month
    model, trees, _ = models[2000]
    val = tagged.where("part = 'val'").toPandas().sort_values(["eom", "entity"]).reset_index(drop=True)
    days, y = learn._days(val, "eom"), val["target"].to_numpy(float)
    base = learn.mean_ic(days, model.predict(learn._matrix(val, features), trees), y)
    for members, drop in got.items():
        falls = []
        for k in range(s.cfi_repeats):
            x = val[features].copy()
            for rows in learn.month_groups(days):
                order = np.random.default_rng([s.seed + k, int(days[rows[0]])]).permutation(len(rows))
                x.loc[rows, list(members)] = val.loc[rows[order], list(members)].to_numpy()
            falls.append(base - learn.mean_ic(days, model.predict(learn._matrix(x, features), trees), y))
        assert drop == pytest.approx(np.mean(falls), abs=1e-9)
    scores, told = learn.selected_schedule(df, features, ["f0", "f1"], [2000], s)
    assert told[2000]["val_ic"] >= told[2000]["base_ic"] and "f0" in told[2000]["factors"]
    info = learn.infos(scores).first()
    assert info["n_features"] == len(told[2000]["factors"]) + 1 and info["max_target"] < date(2000, 1, 1) and info["trees"] in (15, 30)


def test_spread_quantiles_are_those_of_all_rows():
    rng = np.random.default_rng(5)
    qs = np.linspace(0, 1, 33)[1:-1]
    for x in (rng.normal(size=5001), np.round(rng.uniform(-1, 1, 700), 1), np.zeros(9), np.array([-2.5]), rng.normal(size=40) * 1e-30):
        x = x.astype(np.float32)
        assert np.array_equal(spread.quantiles(x, qs, spread.Ring()), np.quantile(x, qs))


def test_large_windows_are_fitted_by_all_tasks_together(spark, monkeypatch):
    """The same trees, scores and choices as in one task, and no task gets a window."""
    f = panel_with_signal(40, 60)
    f["target_month"] = [(pd.Timestamp(d) + pd.offsets.MonthEnd(1)).date() for d in f["eom"]]
    f.loc[::11, "target"] = None
    df = spark.createDataFrame(f)
    s = Settings(rank_trees=30, rank_every=10, rank_leaf_weight=5.0, rank_depths=(2, 3), cfi_repeats=2, cfi_min_pairs=10, cfi_min_months=3)
    features = ["f0", "f1", "f2"]
    ask = lambda: (learn.run_schedule(df, features, [1999, 2000], s).toPandas(), learn.selected_schedule(df, features, ["f0", "f1"], [2000], s))
    want, (picked, told) = ask()
    picked = picked.toPandas()
    monkeypatch.setattr(spread, "ROWS", 100)
    monkeypatch.setattr(learn, "fit_window", None)
    got, (picked2, told2) = ask()
    for a, b in ((want, got), (picked, picked2.toPandas())):
        both = a.merge(b, on=["test_year", "part", "entity", "eom"])
        assert len(a) == len(b) == len(both) and np.allclose(both["score_x"], both["score_y"], atol=1e-9) and np.allclose(both["val_ic_x"], both["val_ic_y"])
        for c in ("depth", "trees", "max_target", "n_features", "model"):
            assert (both[f"{c}_x"] == both[f"{c}_y"]).all()
    assert told[2000]["factors"] == told2[2000]["factors"] and told[2000]["candidates"] == told2[2000]["candidates"]


def test_windows_and_shuffle(spark):
    w = learn.windows(date(2015, 2, 1), [2021, 2022], date(2022, 8, 31))
    assert w[0]["train"][1] == date(2018, 12, 31) and w[1]["test"] == (date(2022, 1, 1), date(2022, 8, 31)) and not leakage.window_errors(w)
    f = spark.createDataFrame(panel_with_signal(20, 5))
    a, b = f.groupBy("eom").agg(F.sort_array(F.collect_list("target")).alias("x")), learn.shuffled_labels(f, "target").groupBy("eom").agg(F.sort_array(F.collect_list("target")).alias("x"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# ---------------------------------------------------------------- state, risk, books
def test_kalman_recovers_and_widens(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(60):
        d = 0.0
        for m in range(48):
            d = 0.9 * d + math.sqrt(0.02) * rng.normal()
            if not (e == 0 and 20 <= m < 30):
                eom = (pd.Timestamp("1996-01-31") + pd.offsets.MonthEnd(m)).date()
                rows.append((e, eom, "s", float(1 + d + 0.2 * rng.normal()), float(1 + d + 0.3 * rng.normal())))
    df = spark.createDataFrame(rows, "entity long, eom date, sector string, a double, b double")
    made = kalman.prepare(df, ["a", "b"], "a", 4)
    made.cache()
    theta, _ = kalman.fit(made, 2, rounds=12)
    p = kalman.parameters(theta, ["a", "b"])
    assert 0.75 < p["phi"] < 0.98 and 0.008 < p["q"] < 0.05 and 0.01 < p["R"]["a"] < 0.12
    out = kalman.smooth(made, theta).where("entity = 0").orderBy("eom").toPandas()
    assert out["beta_var"].iloc[20] > out["beta_var"].iloc[19] > 0


def test_kalman_fit_goes_on_to_the_maximum(monkeypatch):
    """Without a number of rounds the fit ends at a point that no small move betters; six rounds don't reach it."""
    rng, rows = np.random.default_rng(4), []
    for e in range(40):
        d = 0.0
        for t in range(40):
            d = 0.95 * d + math.sqrt(0.002) * rng.normal()
            rows.append((e, t, True, 1.0, 1 + d + 0.5 * rng.normal(), 1 + d + 0.05 * rng.normal()))
    f = pd.DataFrame(rows, columns=["entity", "t", "fit", "m", "y0", "y1"])
    monkeypatch.setattr(kalman, "likelihoods", lambda prepared, thetas: np.array([kalman.run_filter(prepared, np.asarray(x), True)[0] for x in thetas]))
    few, most = kalman.fit(f, 2, rounds=6)[1], kalman.fit(f, 2, rounds=None)
    around = [most[0] + k * 0.02 * v for v in np.eye(4) for k in (1, -1)]
    assert most[1] > few + 0.1 and max(kalman.likelihoods(f, around)) < most[1] + 0.01


def test_kalman_betas_fits_without_a_number_of_rounds(spark, sf, monkeypatch):
    asked = {}
    monkeypatch.setattr(models.kalman, "fit", lambda made, n, **kw: asked.update(kw) or (np.array([2.0, np.log(0.02), *[np.log(0.05)] * n]), 0.0))
    models.kalman_betas(spark, sf)
    assert asked["rounds"] is None


def test_risk_model_uses_the_known_past_only(spark):
    f = panel_with_signal(25, 30).assign(sector="a", f1=0.0)
    s = Settings(risk_min_months=5, risk_window=12, spec_min=3)

    def made(x):
        df = spark.createDataFrame(x)
        months, resid = risk.factor_returns(df, ["f0"], ["a"])
        m = {r["eom"]: r["chol"] for r in risk.model(months, df.select("eom"), s).collect()}
        v = {(r["entity"], r["eom"]): r["spec_var"] for r in risk.specific_variance(df, resid, s).collect()}
        return m, v

    a = made(f)
    g = f.copy()
    cut = sorted(g["eom"].unique())[20]
    g.loc[g["eom"] >= cut, "target"] *= -7
    b = made(g)
    assert all(np.allclose(a[0][t], b[0][t]) for t in a[0] if t <= cut) and not np.allclose(a[0][max(a[0])], b[0][max(b[0])])
    assert all(a[1][k] == pytest.approx(b[1][k]) for k in a[1] if k[1] <= cut) and len(a[0]) == 25


def test_ledoit_wolf_against_the_definition():
    x = np.random.default_rng(0).normal(size=(24, 40))
    xc, delta, mu = risk.ledoit_wolf(x)
    s = xc.T @ xc / 24
    d2 = ((s - mu * np.eye(40)) ** 2).sum() / 40
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in xc) / 24**2 / 40, d2)
    assert delta == pytest.approx(b2 / d2) and mu == pytest.approx(np.trace(s) / 40)
    w = np.ones(40) / 40
    assert risk.variance(xc, delta, mu, w) == pytest.approx(w @ ((1 - delta) * s + delta * mu * np.eye(40)) @ w)


def month(n=300, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"entity": np.arange(n), "eom": D[0], "score": rng.normal(size=n), "short_eligible": rng.random(n) < 0.7, "beta_kf": 1 + 0.3 * rng.normal(size=n), "beta_var": rng.uniform(0.005, 0.05, n), "sector": rng.integers(0, 6, n).astype(str), "size_z": rng.normal(size=n), "spec_var": rng.uniform(0.001, 0.01, n)})


def ready(spark, f, s):
    return books.candidates(spark.createDataFrame(f), s).toPandas()


def test_candidates_are_the_tails(spark):
    f = month(100).assign(beta_kf=lambda x: x["beta_kf"].where(x["entity"] % 7 > 0))
    got = ready(spark, f, Settings(per_side=10))
    longs, shorts = set(got[got["side"] > 0]["entity"]), set(got[got["side"] < 0]["entity"])
    rank = f.sort_values(["score", "entity"], ascending=[False, True])["entity"].tolist()
    worst = [e for e in rank[::-1] if f["short_eligible"][e]]
    assert longs == set(rank[:10]) and shorts == set(worst[:10])
    filled = got[got["entity"] % 7 == 0]["beta_kf"]
    assert np.allclose(filled, f["beta_kf"].median())


def test_spec_book_obeys_its_limits(spark):
    f, s = month(), Settings(per_side=120)
    c, again = ready(spark, f, s), ready(spark, month(seed=1), s)
    w, info = books.spec_month(c, {}, {"lam_tc": 0.1, "lam_beta": 10.0}, s)
    v = f["entity"].map(w).fillna(0.0).to_numpy()
    assert info["status"] == "solved" and abs(np.abs(v).sum() - 2) < 1e-3 and abs(v.sum()) < 0.2 + 1e-3 and np.abs(v).max() < 0.015 + 1e-6
    assert abs(v @ f["beta_kf"]) < info["beta_tol"] + 1e-3 and abs(v @ f["size_z"]) < 0.05 + 1e-3
    assert all(abs(v[f["sector"] == k].sum()) < info["sector_band"] + 1e-3 for k in f["sector"].unique())
    assert not (v[~f["short_eligible"]] < 0).any() and info["turnover"] == pytest.approx(np.abs(v).sum(), abs=1e-3)
    cheap = books.spec_month(again, w, {"lam_tc": 10.0, "lam_beta": 10.0}, s)[1]
    assert cheap["turnover"] < books.spec_month(again, w, {"lam_tc": 0.0, "lam_beta": 10.0}, s)[1]["turnover"]
    assert books.spec_month(c.head(20), {1: 0.5}, {"lam_tc": 0.0, "lam_beta": 0.0}, s)[0] == {1: 0.5}


def test_v2_book_keeps_its_volatility(spark):
    f, s = month(), Settings(per_side=120, v2_max_weight=0.02)
    chol = np.eye(7) * 0.03
    w, info = books.v2_month(ready(spark, f.assign(f0=0.0), s), {}, {"ic": 0.05}, s, ([], sorted(f["sector"].unique()), chol, None, 0.1))
    v = f["entity"].map(w).fillna(0.0).to_numpy()
    assert info["status"] == "solved" and info["vol"] <= s.v2_vol * info["vol_times"] + 1e-3 and np.abs(v).sum() <= 2 + 1e-3 and len(w) > 20


def plain_tails(f, smooth, s):
    """The tail book month by month, in plain Python."""
    before, out = {}, {}
    for t in sorted(f["eom"].unique()):
        g = f[f["eom"] == t].sort_values("entity")
        z = ((g["score"] - g["score"].mean()) / g["score"].std()).fillna(0.0)
        score = {e: smooth * v + (1 - smooth) * before.get(e, v) for e, v in zip(g["entity"], z)}
        before, rows, tail = score, {r.entity: r for r in g.itertuples()}, s.v3_tail
        while True:
            sides, budget = {}, {}
            for sec in sorted(g["sector"].unique()):
                inside = [e for e in rows if rows[e].sector == sec]
                ok = [e for e in inside if rows[e].short_eligible]
                top = sorted(inside, key=lambda e: (-score[e], e))[: math.ceil(tail * len(inside))]
                low = sorted((e for e in ok if e not in top), key=lambda e: (score[e], e))[: math.ceil(tail * len(ok))]
                if top and low:
                    budget[sec], sides[sec] = len(inside), (top, low)
            if sum(len(a) + len(b) for a, b in sides.values()) <= s.max_names or tail <= 0.02:
                break
            tail -= 0.01
        base = [{e: budget[k] / sum(budget.values()) / len(v[i]) for k, v in sides.items() for e in v[i]} for i in (0, 1)]
        bl, bs = (sum(w * rows[e].beta_kf for e, w in b.items()) for b in base)
        net = min(max(2 * s.gross * bs / (bl + bs) - s.gross, -s.net_band), s.net_band)
        for b, sign in zip(base, (1, -1)):
            leg = (s.gross + sign * net) / 2
            w = {e: x * leg for e, x in b.items()}
            for _ in range(99):
                over = {e for e in w if w[e] > s.max_weight + 1e-12}
                at = {e for e in w if w[e] >= s.max_weight - 1e-12}
                if not over:
                    break
                rest = sum(w[e] for e in w if e not in at)
                w = {e: s.max_weight if e in at else x * (leg - s.max_weight * len(at)) / rest for e, x in w.items()}
            out |= {(e, t): sign * x for e, x in w.items()}
    return out


def test_tail_book_against_plain_code(spark):
    """Three months with a gap and new names, a cap that binds, more names than allowed."""
    months = [month(300, seed).assign(eom=D[0] if seed == 0 else (pd.Timestamp(D[0]) + pd.offsets.MonthEnd(seed)).date()) for seed in range(3)]
    months[1] = months[1][months[1]["entity"] % 5 > 0]
    f = pd.concat(months, ignore_index=True)
    for s in (Settings(max_weight=0.1), Settings(max_weight=0.022), Settings(max_weight=0.2, max_names=40)):
        grid = spark.createDataFrame([(0, 1.0), (1, 0.5)], "config_id long, smooth double")
        got = books.run_books(spark.createDataFrame(f), grid, "v3", s).collect()
        for k, smooth in ((0, 1.0), (1, 0.5)):
            want = plain_tails(f, smooth, s)
            have = {(r["entity"], r["eom"]): r["weight"] for r in got if r["config_id"] == k}
            assert have.keys() == want.keys() and all(have[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_tone_features_score_each_text_once(spark):
    rows = [(i, i % 3, f"2020-0{1 + i % 4}-05", float(i % 7)) for i in range(60)]
    f = spark.createDataFrame(rows, "document_id long, entity long, filing_date string, x double").withColumn("filing_date", F.to_date("filing_date"))
    scored = spark.sparkContext.accumulator(0)

    def tone(x):
        scored.add(1)
        return x

    t = F.udf(tone, "double")(F.col("x"))
    tones = f.select("document_id", t.alias("tone_mean")).withColumn("tone_min", F.col("tone_mean"))
    keys = f.select("entity", F.last_day("filing_date").alias("eom")).distinct()
    got = {(r["entity"], r["eom"].month): r for r in text.tone_features(f, tones, keys).collect()}
    assert scored.value == 60 and len(got) == 12
    mean = lambda e, m: np.mean([x for _, k, d, x in rows if k == e and int(d[6]) == m])
    for (e, m), r in got.items():
        assert r["tone_mean"] == pytest.approx(mean(e, m)) and (r["tone_surprise"] is None if m == 1 else r["tone_surprise"] == pytest.approx(mean(e, m) - np.mean([mean(e, k) for k in range(1, m)])))


def test_quotes_read_each_text_once(spark):
    docs = spark.createDataFrame([(i, f"Alpha beta  gamma delta w{i} end") for i in range(20)], "document_id long, x string")
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    filings = docs.select("document_id", F.udf(told, "string")("x").alias("text"))
    facts = [(1, "beta gamma", 3), (2, "delta w5 end", None), (3, "delta w50 end", None), (4, "w7", None), (5, "gamma delta", None), (6, "beta gamma", 99)]
    got = text.verify_quotes(spark.createDataFrame(facts, "fact_id long, quote string, document_id long"), filings)
    assert {r["fact_id"] for r in got.collect()} == {1, 2, 4, 5} and seen.value == 20


def test_ret_hat_ranks_lie_over_tasks(spark):
    """One month of one window, ties and a missing score: ranks come from several ranges, none of which holds the month."""
    x = [float(i % 40) if i != 7 else None for i in range(200)]
    y = [float((i * 13) % 17) for i in range(200)]
    panel = spark.createDataFrame([(i, D[0], y[i]) for i in range(200)], "entity long, eom date, target double")
    scores = spark.createDataFrame([(1999, "val", i, D[0], x[i]) for i in range(200)], "test_year int, part string, entity long, eom date, score double")
    got = {r["entity"]: r["ret_hat"] for r in learn.with_ret_hat(scores, panel, rows_per_task=20).collect()}
    r = (pd.Series(x).rank() - 1) / (199 - 1) * 2 - 1
    b, a = np.polyfit(r.drop(7), np.delete(np.array(y), 7), 1)
    assert got[7] is None and all(got[i] == pytest.approx(a + b * r[i]) for i in range(200) if i != 7)
    plan = learn.with_ret_hat(scores, panel, rows_per_task=20)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "test_year" in line for line in plan.splitlines())


def test_limits_of_shorts_share_ranks(spark):
    """Equal scores, small sectors and three limits on one row a name: each limit's book is that of plain code on the names it leaves."""
    months = [month(150, seed).assign(eom=(pd.Timestamp(D[0]) + pd.offsets.MonthEnd(seed)).date() if seed else D[0]) for seed in range(2)]
    f = pd.concat(months, ignore_index=True)
    f["score"] = f["score"].round()
    f["size"] = (f["entity"] * 37 % 100) / 100
    limits = [0.2, 0.5, 0.9]
    rows = f.drop(columns="short_eligible").assign(open=[[q for q in limits if x >= q] for x in f["size"]])
    grid = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate((q, a) for q in limits for a in (1.0, 0.5))], "config_id long, short_q double, smooth double")
    for s in (Settings(max_weight=0.1), Settings(max_weight=0.2, max_names=30)):
        got = books.run_books(spark.createDataFrame(rows), grid, "v3", s).collect()
        for c in grid.collect():
            want = plain_tails(f.assign(short_eligible=f["size"] >= c["short_q"]), c["smooth"], s)
            have = {(r["entity"], r["eom"]): r["weight"] for r in got if r["config_id"] == c["config_id"]}
            assert have.keys() == want.keys() and all(have[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_v4_book_is_exact_and_falls_back(spark):
    rng = np.random.default_rng(3)
    f = month().assign(beta_raw=lambda x: x["beta_kf"], size_group=lambda x: np.where(x["size_z"] > 0, "big", "small"), x=[rng.normal(0, 0.05, 24).tolist() for _ in range(300)])
    p, s = {"gross": 1.5, "risk_penalty": 3000.0, "turnover_penalty": 0.05}, Settings(per_side=80, v4_min_names=10)
    c = books.v4_candidates(spark.createDataFrame(f), s).toPandas()
    assert (c["main"] > 0).sum() == 80 == (c["main"] < 0).sum() and set(c[c["fallback"].notna()].groupby(["size_group", "fallback"]).size()) == {50}
    w, info = books.v4_month(c, {}, p, s)
    v = f["entity"].map(w).fillna(0.0).to_numpy()
    assert info["status"] == "solved" and v.sum() == pytest.approx(0, abs=1e-4) and np.abs(v).sum() == pytest.approx(1.5, abs=1e-4) and abs(v @ f["beta_raw"]) <= 0.0502
    held, info = books.v4_month(c.assign(has=False), {5: 0.1}, p, s)
    assert held == {5: 0.1} and info["attempt"] == "hold"
    assert books.v4_month(c.assign(main=np.where(c["main"] < 0, np.nan, c["main"])), {}, p, s)[1]["attempt"] == "fallback"
    limits = books.v4_limits(np.array([0.5, 0.25, -0.75]), np.zeros(3), np.array(["a", "b", "a"]), {"gross": 1.5}, s.but(v4_min_names=3))
    assert books.broken(limits) == ["long_share", "size_a", "size_b"]
    assert "net" in books.broken(books.v4_limits(np.array([np.nan, 1.0]), np.zeros(2), np.array(["a", "a"]), {"gross": 1.5}, s))


def test_book_settings_by_year(spark):
    """Weights held carry on when the settings change with the target year."""
    f = pd.concat([month(120, k).assign(eom=date(1999, 11 + k, 30 + k)) for k in range(2)], ignore_index=True)
    f = f.assign(beta_raw=f["beta_kf"], size_group="all", x=[np.random.default_rng(i).normal(0, 0.05, 12).tolist() for i in range(240)])
    years = spark.createDataFrame([(0, 1999, 1.0, 3000.0, 0.0), (0, 2000, 2.0, 3000.0, 0.0)], "config_id long, year int, gross double, risk_penalty double, turnover_penalty double")
    got = books.run_books(spark.createDataFrame(f), years, "v4", Settings(per_side=40, v4_min_names=4, v4_beta_limit=0.5)).toPandas()
    sums = got.groupby("eom")["weight"].apply(lambda w: w.abs().sum())
    assert sums[date(1999, 11, 30)] == pytest.approx(1.0, abs=1e-4) and sums[date(1999, 12, 31)] == pytest.approx(2.0, abs=1e-4)


def test_beta_variants(spark):
    f = spark.createDataFrame(panel_with_signal(10, 4).assign(sector="a", beta_kf=1.2, beta_var=0.1))
    risk_ = spark.createDataFrame([(D[0], [0.5, 2.0, 3.0])], "eom date, b array<double>").withColumn("eom", F.lit(date(1996, 2, 29)))
    raw = f.select("entity", "eom", F.when(F.col("entity") > 0, F.col("entity").cast("double")).alias("beta_raw"))
    got = betas.variants(f, risk_, ["f0"], ["a"], raw, floored=lambda: f.withColumn("beta_kf", F.lit(7.0)))
    assert list(got) == ["kf", "kf_rfloor", "b60_shrunk", "factor"] and got["kf_rfloor"].where("beta_kf = 7").count() == 40
    x = {r["entity"]: r["f0"] for r in f.where("eom = DATE '1996-02-29'").collect()}
    for r in got["factor"].collect():
        want = 0.5 + 2 * x[r["entity"]] + 3.0 if r["eom"] == date(1996, 2, 29) else 1.2
        assert r["beta_kf"] == pytest.approx(want)
    assert {r["entity"]: round(r["beta_kf"], 6) for r in got["b60_shrunk"].collect()} == {e: 1.2 if e == 0 else round(0.67 * e + 0.33, 6) for e in range(10)}


def test_solver_against_a_known_answer():
    n = 5
    got = solve(Problem(-np.arange(n, dtype=float), np.zeros(n), np.full(n, 0.4), np.ones((1, n)), np.array([1.0]), np.array([1.0])))
    assert got.feasible and np.allclose(got.w, [0, 0, 0.2, 0.4, 0.4], atol=1e-4)
    assert not solve(Problem(np.zeros(n), np.zeros(n), np.full(n, 0.1), np.ones((1, n)), np.array([1.0]), np.array([1.0]))).feasible


def test_choices(spark):
    r = frame(spark, [(0, 0.5), (1, 0.9), (2, 0.9), (3, None)], "config_id long, ir double")
    assert tune.choose(r)["config_id"] == 1 and tune.choose(r, True)["config_id"] == 2
    assert tune.choose_book([{"name": "a", "ir": 2.0, "beta": 0.5}, {"name": "b", "ir": 1.0, "beta": 0.1}])["name"] == "b"
    assert tune.ic_by_year({1: 0.2, 2: None}, [1, 2]) == {1: 0.2, 2: 0.2}
    row = lambda i, ir, gross: {"config_id": i, "ir": ir, "gross": gross, "risk_penalty": 1.0, "turnover_penalty": 0.0}
    got = tune.v4_settings({2001: [row(0, None, 1.0), row(1, None, 2.0)], 2002: [row(0, 0.5, 1.0), row(1, 0.5, 2.0)], 2003: [row(0, None, 1.0), row(1, float("nan"), 2.0)]})
    assert {y: r["config_id"] for y, r in got.items()} == {2001: 1, 2002: 1, 2003: 1}


# ---------------------------------------------------------------- agent, tables
def test_agent_checks_facts_and_dates():
    f = [{"document_id": "d1", "filing_date": date(2020, 1, 1), "text": "Net sales rose."}]
    replies = iter([{"tool": "get_filings", "args": {"entity": 99, "date": "2030-01-01"}}, '```json\n{"thesis": "up", "facts": [{"quote": "net sales rose", "document_id": "d1"}, {"quote": "invented"}]}\n```'])
    asked = []
    out = agent.explain(lambda m: next(replies), {"get_filings": lambda e, d: asked.append((e, d)) or f}, 7, date(2020, 1, 31), "long")
    assert asked == [(7, date(2020, 1, 31))] and len(out["facts"]) == 1 and out["dropped"] == 1 and out["thesis"] == "up"
    assert agent.parse_reply('broken {"thesis": "still here') == {"thesis": "still here"}
    assert agent.parse_reply('x {"a": 1} {"thesis": "t {y}", "facts": []} z') == {"thesis": "t {y}", "facts": []} and agent.parse_reply("none") == {}
    odd = [{"document_id": "d", "filing_date": date(2020, 1, 1), "text": "rose\u00a05\u2011fold \u2026 it\u2032s"}]
    assert agent.verify([{"quote": "Rose 5-fold . it's"}], odd)


def test_agent_keeps_a_cache_file(spark, tmp_path):
    path = str(tmp_path / "cache.json")
    holdings = frame(spark, [(1, D[0], 0.5), (2, D[0], -0.5)], "entity long, eom date, weight double")
    none = frame(spark, [], "document_id string, entity long, filing_date date, text string")
    panel = frame(spark, [(1, D[0], 1.0)], "entity long, eom date, score double")
    asked = []

    def post(messages):
        asked.append(1)
        if len(asked) == 2:
            raise ValueError("once")
        return '{"thesis": "t", "facts": [{"quote": "q"}]}'

    with open(path, "w") as f:
        f.write("{damaged")
    first = agent.run(spark, post, holdings, none, panel, panel, ["score"], cache_path=path)
    assert len(first["answers"]) == 1 and len(first["failed"]) == 1 and first["verification_rate"] == 0.0
    again = agent.run(spark, post, holdings, none, panel, panel, ["score"], cache_path=path)
    assert len(again["answers"]) == 2 and len(asked) == 3
    down = agent.run(spark, lambda m: (_ for _ in ()).throw(ConnectionError("down")), holdings, none, panel, panel, [], cache={})
    assert down["stopped"] == "down" and not down["answers"]


def test_quotes_are_found_wherever_they_stand(spark):
    f = frame(spark, [(i, date(2020, 1, 1 + i % 9), f"Start {i} words a\u2009b \u201cc\u201d tail{i}") for i in range(30)], "document_id long, filing_date date, text string")
    facts = frame(spark, [(0, "tail7", None), (1, "ail3", None), (2, "start 4 WORDS a b", None), (3, "words a b nothing", None), (4, "s a", None), (5, "", None), (6, "start 5", 5), (7, "start 5", 6), (8, "x", 99), (9, 'b "c"', None)], "fact_id long, quote string, document_id long")
    assert sorted(r["fact_id"] for r in text.verify_quotes(facts, f).collect()) == [0, 1, 2, 4, 6, 9]


def test_quotes_with_words_that_every_text_holds(spark):
    """Hot words, quotes by their ends only, repeated words, and a text that is empty."""
    texts = [f"the the the of {a}the {b} the of the end{i}" for i, (a, b) in enumerate((x, y) for x in ("un", "over", "") for y in ("fold", "ad", "the"))] + ["", None]
    f = frame(spark, [(i, date(2020, 1, 1), t) for i, t in enumerate(texts)], "document_id long, filing_date date, text string")
    quotes = ["the", "the of", "he o", "the the the", "the the the the the", "of unthe fold the", "of unthe fold the of the end0", "n fold", "nthe fo", "verthe ad", "verthe adx", "d0 the", "zz", "e", "the end8", "of the the the the of", "the  the", "f overthe the the o", "absent words in the of the run"]
    facts = frame(spark, [(i, q, None) for i, q in enumerate(quotes)], "fact_id long, quote string, document_id long")
    plain = [" ".join((t or "").lower().split()) for t in texts]
    want = {i for i, q in enumerate(quotes) if any(" ".join(q.lower().split()) in t for t in plain)}
    assert {r["fact_id"] for r in text.verify_quotes(facts, f).collect()} == want and 3 < len(want) < len(quotes)


def test_trailing_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(int(e), int(i), float(v)) for e, i, v in zip(rng.integers(0, 5, 200), rng.integers(600, 640, 200), rng.normal(size=200))]
    keys = sorted({(e, date(50 + (i - 1) // 12, (i - 1) % 12 + 1, 28)) for e, i, _ in rows} | {(9, date(52, 1, 28)), (0, date(55, 1, 28))})
    k, facts = frame(spark, [*keys, keys[0]], "entity long, eom date"), frame(spark, rows, "entity long, idx int, v double")
    for offsets in (range(12), range(1, 13), range(1)):
        got = {(r["entity"], r["eom"]): (r["s"], r["m"]) for r in joins.trailing(k, facts, offsets, {"s": F.sum("v"), "m": F.avg("v")}).collect()}
        want = {}
        for e, t in keys:
            found = [v for a, i, v in rows if a == e and t.year * 12 + t.month - i in offsets]
            if found:
                want[e, t] = (sum(found), sum(found) / len(found))
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_many_columns_are_one_aggregate(spark):
    """147 features: the plan has one sum, and weights are those of the closed form."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 147)).round(3)
    y = x[:, 0] - 0.5 * x[:, 146] + 0.1 * rng.normal(size=400)
    names = [f"c{i}" for i in range(147)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(3)
    w, c = learn.ridge(df, names, "y", 2.0, F.lit(True))
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(147), xc.T @ (y - y.mean()))
    assert np.allclose(w, want, atol=1e-8) and c == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-8)
    m = learn.moments(df, names[:2], "y", F.col("c0") > 0)
    assert m[0, 0] == (x[:, 0] > 0).sum() and m[1, 2] == pytest.approx((x[:, 0] * x[:, 1])[x[:, 0] > 0].sum())


def test_filings_are_scored_without_names(spark):
    f = frame(spark, [(1, 7, date(2020, 1, 5), "ACME Corp rose good", "Acme Corp", "AC"), (2, 7, date(2020, 1, 9), "AC and Old fell bad", "Acme Corp", "AC"), (3, 8, date(2020, 1, 9), "good", None, None)], "document_id long, entity long, filing_date date, text string, company_name string, ticker string")
    panel = frame(spark, [(7, date(2020, 1, 31), "Old", "OLD")], "entity long, eom date, company_name string, ticker string")
    seen = lambda d: d.select("document_id", F.length("text").cast("double").alias("tone_mean"), F.length(F.trim("text")).cast("double").alias("tone_min"))
    got = {r["document_id"]: r["tone_min"] for r in text.score_filings(f, panel, score=seen).collect()}
    assert got == {1: len("rose good"), 2: len("and   fell bad")}
    done = frame(spark, [(1, 0.5, 0.5), (9, 0.1, 0.1)], "document_id long, tone_mean double, tone_min double")
    assert {r["document_id"] for r in text.score_filings(f, panel, done, score=seen).collect()} == {1, 2}
    assert text.score_filings(f, panel, None, 1, seen).count() == 1


def test_specific_variance_looks_back(spark):
    """Against each period's own months; the least squares are made once and read by both frames."""
    rng = np.random.default_rng(5)
    ends = [d.date() for d in pd.date_range("2020-01-31", periods=9, freq="ME")]
    rows = [(e, t, float(rng.normal())) for e in range(6) for t in ends if rng.random() < 0.7 and t != ends[3]]
    resid, df = frame(spark, rows[:-4], "entity long, eom date, resid double"), frame(spark, [r[:2] for r in rows], "entity long, eom date")
    got = {(r["entity"], r["eom"]): r["spec_var"] for r in risk.specific_variance(df, resid, Settings(spec_window=3, spec_min=2)).collect()}
    known, want = sorted({r[1] for r in rows[:-4]}), {}
    for t in sorted({r[1] for r in rows}):
        used = [m for m in known if m < t][-3:]  # known a month later
        own = {e: [x for k, m, x in rows[:-4] if k == e and m in used] for e in range(6)}
        var = {e: float(np.var(own[e], ddof=1)) for k, m, _ in rows if m == t for e in [k] if len(own[e]) >= 2}
        rest = [float(np.median(list(var.values())))] if var else [float(np.var(sum(own.values(), []), ddof=1))] if used and len(sum(own.values(), [])) > 1 else [None]
        want |= {(e, t): var.get(e, rest[0]) for e, m, _ in rows if m == t and used}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
    panel = frame(spark, [(e, t, x, x * 2 + e, "a") for e, t, x in rows], "entity long, eom date, f0 double, target double, sector string")
    for kept in risk.factor_returns(panel, ["f0"], ["a"]):
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan


def test_solver_ends_where_no_book_exists():
    """An infeasible problem is told by a proof long before the last round; one just feasible is solved."""
    n, side = 40, np.where(np.arange(40) < 20, 1.0, -1.0)
    for most, fits in ((0.01, False), (0.06, True)):
        rows = [(side, 1.0, 1.0), (np.where(np.arange(n) < 20, 1.0, 0.0), 0.4, most + 0.44)]
        a, low, high = (np.array([r[i] for r in rows]) for i in range(3))
        if not fits:
            low[1], high[1] = 0.9, 0.95  # more on the long side than the net band lets
            a, low, high = np.vstack([a, np.ones(n)]), np.append(low, -0.2), np.append(high, 0.2)
        got = solve(Problem(np.linspace(-1, 1, n), np.where(side > 0, 0.0, -0.05), np.where(side > 0, 0.05, 0.0), a, low, high, np.full(n, 0.1)), 2000)
        assert got.feasible == fits and (fits or got.rounds < 1000)


def test_gru_gradients_and_training():
    rng = np.random.default_rng(0)
    net, x, m = gru.Autoencoder(2, 2, 3, 4, 1), rng.normal(size=(5, 4, 2)), (rng.random((5, 4)) < 0.8).astype(float)
    _, g = net.loss(x, m, True)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        kept = v[at]
        v[at] = kept + 1e-5
        up = net.loss(x, m)
        v[at] = kept - 1e-5
        down = net.loss(x, m)
        v[at] = kept
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8), k


def test_gru_embed_trains_with_the_settings_of_its_own(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(models.gru, "embed", lambda win, d, train, val, s: asked.append(s))
    models.gru_embed(spark, sf)
    names = [n for n in vars(Settings()) if n.startswith("gru_")]
    assert {n: getattr(asked[0], n) for n in names} == {n: getattr(Settings(), n) for n in names}


def test_gru_trains_in_shards(spark, monkeypatch):
    """A table of several shards: every window is read once an epoch, weights are the mean of the shards' by rows, and all rows are encoded."""
    nets = [gru.Training(gru.Autoencoder(1, 1, 2, 3, k)) for k in (1, 2)]
    want = {k: 0.25 * nets[0].net.p[k] + 0.75 * nets[1].net.p[k] for k in nets[0].net.p}
    got = gru.averaged([(10, nets[0]), (30, nets[1])]).net.p
    assert all(np.allclose(got[k], want[k]) for k in want)
    months = [date(2020 + i // 12, i % 12 + 1, 28) for i in range(24)]
    rng = np.random.default_rng(3)
    panel = frame(spark, [(e, m, float(v)) for e in range(12) for m, v in zip(months, rng.normal(size=24).cumsum())], "entity long, eom date, x double")
    win, s = gru.windows(panel, ["x"], 4), Settings(gru_hidden=3, gru_epochs=2, gru_decay=(0.0, 1e-3), gru_batch=16, seq_min_valid=3)
    ask = lambda: {(r["entity"], r["eom"]): r["gru_1"] for r in gru.embed(win, 1, F.year("eom") == 2020, F.year("eom") == 2021, s).collect()}
    whole = ask()
    monkeypatch.setattr(gru, "SHARD", 40)
    parted = ask()
    assert whole.keys() == parted.keys() and len(parted) == 12 * 24
    assert all((v is None) == (parted[k] is None) for k, v in whole.items()) and sum(v is not None for v in parted.values()) == 12 * 21
    assert any(v != parted[k] for k, v in whole.items()) and all(abs(v - parted[k]) < 0.5 for k, v in whole.items() if v is not None)


def test_csv_readers_and_writers(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return f"file://{tmp_path / name}"

    assert tables.read_names(spark, put("n.csv", "variable,x\na,1\n,2\nb,3\n")) == ["a", "b"]
    m = tables.read_market(spark, put("r.csv", "eom,tb3ms\n2020-01-31,1.2\n"), put("i.csv", "eom,sp500_ret\n2020-02-29,0.1\n"))
    assert sorted((r["eom"], r["rate"], r["index_ret"]) for r in m.collect()) == [(date(2020, 1, 31), 1.2, None), (date(2020, 2, 29), None, 0.1)]
    for head in ("WEIGHT", "WEIGHT %"):
        h = tables.read_holdings(spark, put("h.csv", f"Date,PERMNO,TICKER,COMPANY NAME,{head}\n2020-02-01,7,A,Acme,1.5\n")).first()
        assert (h["date"], h["entity"], h["weight"]) == (date(2020, 2, 1), 7, 0.015)
    panel = frame(spark, [(1, D[0], float("nan"))], "id long, t date, x double")
    panel.write.parquet(f"file://{tmp_path}/p")
    got = tables.read_panel(spark, f"file://{tmp_path}/p", "id", "t").first()
    assert got["x"] is None and got["target_month"] == date(2020, 2, 29) and tables.columns_of(spark, f"file://{tmp_path}/p") == ["id", "t", "x"]
    panel.unionByName(panel).write.parquet(f"file://{tmp_path}/twice")
    with pytest.raises(ValueError):
        tables.read_panel(spark, f"file://{tmp_path}/twice", "id", "t")
    w = frame(spark, [(1, D[0], 0.25)], "entity long, eom date, weight double")
    names = frame(spark, [(1, D[0], None, None)], "entity long, eom date, ticker string, company_name string")
    tables.write_csv(report.holdings(w, names, None), f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).first().asDict() == {"Date": "2020-02-01", "PERMNO": "1", "TICKER": None, "COMPANY NAME": None, "WEIGHT": "25.0"}
    info = Materializer(spark, f"file://{tmp_path}/m").get_with_info("k", lambda: (w, {"phi": 0.5}))
    assert info[0].count() == 1 and info[1] == {"phi": 0.5}


def test_materializer_and_json(spark, tmp_path):
    m, calls = Materializer(spark, f"file://{tmp_path}"), []
    make = lambda: calls.append(1) or spark.range(3)
    assert m.get("x", make, {"a": 1}).count() == m.get("x", make, {"a": 1}).count() == 3 and len(calls) == 1
    m.get("x", make, {"a": 2})
    assert len(calls) == 2
    assert m.append_new("c", spark.range(3), "id", lambda d: d).count() == 3 and m.append_new("c", spark.range(5), "id", lambda d: d).count() == 5
    assert jsonable({(1, 2): float("nan"), "d": date(2020, 1, 1), "a": np.array([1.0])}) == {"1|2": None, "d": "2020-01-01", "a": [1.0]}


def test_pair_sums_of_long_months_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    for spread in (0.01, 1.0, 12.0):
        s, y = np.round(rng.normal(size=900) * spread, 3), rng.integers(0, 10, 900).astype(float)
        above = y[:, None] > y[None, :]
        p = np.where(above, 1 / (1 + np.exp(s[:, None] - s[None, :])), 0.0)
        q = p * (1 - p)
        for got, want in zip(learn.PairwiseTrees.gradients(s, y, [np.arange(900)]), (p.sum(0) - p.sum(1), q.sum(0) + q.sum(1))):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    n = 400_000  # 160 billion pairs
    g, _ = learn.smooth_pairs(rng.normal(size=n), rng.integers(0, 10, n).astype(float))
    assert abs(g.sum()) < 1e-6 * np.abs(g).sum()


def test_ridge_schedule_needs_no_window_in_one_task(spark, monkeypatch):
    rng, months = np.random.default_rng(2), pd.date_range("1995-01-31", "1999-12-31", freq="ME")
    f = pd.DataFrame([(e, t.date()) for t in months for e in range(40)], columns=["entity", "eom"])
    f[["a", "b"]] = rng.normal(size=(len(f), 2))
    f["target"] = f["a"] - 0.5 * f["b"] + rng.normal(size=len(f))
    f["target_month"] = (pd.to_datetime(f["eom"]) + pd.offsets.MonthEnd(1)).dt.date
    f.loc[::7, "target"] = None
    y, s = pd.to_datetime(f["target_month"]).dt.year, Settings()
    f["part"] = np.where(y < 1997, "train", np.where(y < 1999, "val", "test"))
    want, info = learn.fit_window(f[y <= 1999], ["a", "b"], s, model="ridge")
    monkeypatch.setattr(learn, "fit_window", None)
    got = learn.run_schedule(spark.createDataFrame(f.drop(columns="part")), ["a", "b"], [1999], s, "ridge").toPandas()
    both = got.merge(want, on=["entity", "eom"])
    assert len(both) == len(got) == len(want) and np.allclose(both["score_x"], both["score_y"], atol=1e-5)
    assert set(got["alpha"]) == {info["alpha"]} and np.isclose(got["val_ic"].iloc[0], info["val_ic"]) and set(got["max_target"]) == {info["max_target"]}


def test_v4_tasks_get_candidates_and_the_shrinkage_of_all(spark):
    rng, n = np.random.default_rng(3), 300
    f = pd.DataFrame({"entity": np.arange(n), "eom": date(2020, 1, 31), "score": rng.normal(size=n), "beta_raw": 1.0, "size_group": "big", "short_eligible": True})
    f["x"] = list(rng.normal(size=(n, 24)))
    rows = [*f.itertuples(index=False, name=None), *[(*r[:1], date(2020, 2, 29), *r[2:-1], None) for r in f.itertuples(index=False, name=None)]]
    frame = spark.createDataFrame([(*r[:-1], None if r[-1] is None else r[-1].tolist()) for r in rows], "entity long, eom date, score double, beta_raw double, size_group string, short_eligible boolean, x array<double>")
    ready = books.v4_candidates(frame, Settings(per_side=20))
    held = books.v4_held(ready, ["eom"]).toPandas()
    _, delta, mu = risk.ledoit_wolf(np.array(f["x"].tolist()).T)
    some = held[held["has"]]
    assert 40 <= len(some) <= 140 and np.allclose(some["lw_delta"], delta) and np.allclose(some["lw_mu"], mu)
    assert len(held[~held["has"]]) == 2  # a month without candidates is still met
    p, s = {"gross": 1.0, "risk_penalty": 10.0, "turnover_penalty": 0.0}, Settings(per_side=20, v4_min_names=4, v4_beta_limit=0.5)
    whole = books.v4_month(ready.where("eom = DATE '2020-01-31'").toPandas(), {}, p, s)[0]
    slim = books.v4_month(held[held["eom"] == date(2020, 1, 31)], {}, p, s)[0]
    assert whole and set(whole) == set(slim) and all(np.isclose(whole[k], slim[k], atol=1e-9) for k in whole)


def test_scaled_ranks_of_a_month_need_not_fit_a_task(spark):
    rng = np.random.default_rng(4)
    f = [(e, date(2020, m, 28), float(rng.integers(0, 9)) if e % 5 else None, float(rng.normal()), 1.0) for m in (1, 2) for e in range(60)]
    df = spark.createDataFrame(f, "entity long, eom date, a double, b double, c double")
    want = {(r["entity"], r["eom"]): r for r in ranks.with_dense_scaled(df, ["a", "b", "c"]).collect()}
    made = ranks.with_dense_scaled(df, ["a", "b", "c"], "eom", ["entity", "eom"])
    assert "windowspecdefinition(eom" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["entity"], r["eom"]): r for r in made.collect()}
    assert got == want and len(got) == 120


def test_universe_and_eligibility_need_no_month_in_a_task(spark, monkeypatch):
    f = [(e, date(2020, m, 28), 10.0, float(e % 50), float(e % 7), float(e % 11)) for m in (1, 2) for e in range(100)]
    df = spark.createDataFrame(f, "entity long, eom date, prc double, me double, vol double, idle double")
    monkeypatch.setattr(ranks, "pct_rank", None)
    monkeypatch.setattr(ranks, "with_quantile", None)
    u = universe.build_universe(df, "prc", "me", "vol")
    assert u.count() == 2 * 78 and u.agg(F.max("size_pct")).first()[0] == 0.995
    mid, got = u.groupBy("eom").agg(F.median("idle").alias("mid")), universe.with_short_eligible(u)
    assert got.where("short_eligible").count() == u.join(mid, "eom").where("size_pct >= 0.4 AND volume_pct >= 0.3 AND idle <= mid").count() > 0


def test_filter_buckets_follow_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(e, date(2020, m, 28), "s", 1.0 + e + m) for e in range(60) for m in range(1, 11)], "entity long, eom date, sector string, a double")
    few = kalman.prepare(df, ["a"], "a", 2)
    assert few.select("bucket").distinct().count() == 2
    monkeypatch.setattr(kalman, "BUCKET_ROWS", 50)
    many = kalman.prepare(df, ["a"], "a", 2)
    assert many.groupBy("bucket").count().agg(F.max("count")).first()[0] < 300
    theta = np.array([2.0, np.log(0.02), np.log(0.05)])
    key = lambda d: sorted((r["entity"], r["eom"], r["beta_kf"]) for r in kalman.smooth(d, theta).collect())
    assert key(few) == key(many)
