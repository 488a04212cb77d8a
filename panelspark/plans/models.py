"""Queries of the numeric operators: ridge, trees, clusters, risk, filters, embeddings, books. Where SQL can say the same it is in SQL below; tests hold
the others to closed forms, constraints and planted signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.dates import month_index, next_month_end
from ..operators import betas, books, gru, joins, kalman, learn, metrics, risk, tails, universe
from ..sources import adapters
from ..spec import Settings
from . import relational as rel

Q: dict = {}
SQL: dict[str, str] = {}
#: The tables have some hundred entities a month and seven years: grids and limits of the real settings, sized to them.
S = Settings(rank_trees=60, rank_every=20, rank_leaf_weight=20.0, per_side=40, v4_min_names=20, cfi_min_pairs=20, risk_min_months=24)
FEATURES = ["revenue", "qty", "n_lines", "disc", "ret"]
FACTORS = ["revenue", "qty", "disc"]


def query(name: str):
    def keep(f):
        Q[name] = f
        return f

    return keep


def ranked(spark, d) -> DataFrame:
    """Part panel with features scaled by month and the target month."""
    p = adapters.panel_part(spark, d)
    out, _ = universe.preprocess(p, FEATURES, "sector", F.col("eom") <= F.lit("1998-12-31").cast("date"), keys=["entity", "eom"])
    return out.withColumn("target_month", next_month_end(F.col("eom")))


def scored(spark, d) -> DataFrame:
    """entity, eom, score, short_eligible, beta_kf, beta_var, sector, size_z, spec_var, and the risk factors: what books need."""
    return scored_fits(spark, d)[0]


def scored_fits(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scored(), monthly factor returns, sectors), each step made once and kept: several steps read it."""
    from ..sources.tables import Materializer

    keep = Materializer(spark)
    scaled = keep.scratch(ranks.with_dense_scaled(marked(spark, d), FACTORS, "eom"), "scaled")
    sectors = risk.sectors_of(scaled)
    months, resid = risk.factor_returns(scaled, FACTORS, sectors)
    return keep.scratch(scaled.join(risk.specific_variance(scaled, resid, S), ["entity", "eom"], "left"), "scored"), months, sectors


def marked(spark, d) -> DataFrame:
    """The part of scored() that needs no risk model: all that tail books read."""
    p = adapters.panel_supp(spark, d)
    raw = p.withColumn("idle", 1.0 / F.col("qty")).withColumns({"size_pct": ranks.pct_rank("revenue", "eom"), "volume_pct": ranks.pct_rank("qty", "eom")})
    raw = raw.withColumn("short_eligible", universe.short_eligible()).withColumn("sector", F.substring("sector", 1, 1))
    return raw.withColumns({"score": ranks.zscore("disc", "eom"), "size_z": ranks.zscore(F.ln("revenue"), "eom"), "beta_kf": 1 + 0.2 * ranks.zscore("n_lines", "eom"), "beta_var": F.lit(0.02) + F.lit(0.01) / F.col("n_lines")})


def risk_model(spark, d) -> tuple[DataFrame, list[str], DataFrame]:
    """(risk.model() of every month, sectors, scored())."""
    f, months, sectors = scored_fits(spark, d)
    _, index = adapters.market(spark, d)
    return risk.model(months, f.select("eom"), S, "eom", index.select(F.col("eom").alias("known"), F.col("index_ret").alias("m"))), sectors, f


@query("ridge_scores")
def ridge_scores(spark, d):
    r = ranked(spark, d)
    w, c = learn.ridge(r, FEATURES, "target", 10.0, F.col("eom") <= F.lit("1998-12-31").cast("date"))
    return rel.rounded(r.select("entity", "eom", learn.linear_score(FEATURES, w, c).alias("score")), "score")


@query("ridge_walk_forward")
def ridge_walk_forward(spark, d):
    return learn.run_schedule(ranked(spark, d), FEATURES, [1999, 2000, 2001], S, "ridge")


@query("pairwise_rank_scores")
def pairwise_rank_scores(spark, d):
    return learn.run_schedule(ranked(spark, d), FEATURES, [1999, 2000, 2001], S)


@query("shuffle_labels")
def shuffle_labels(spark, d):
    r = ranked(spark, d).where("target IS NOT NULL").select("entity", "eom", ranks.decile("target", "eom", "entity").alias("label"))
    return learn.shuffled_labels(r, "label")


@query("month_rank_correlations")
def month_rank_correlations(spark, d):
    c = learn.month_correlations(adapters.panel_part(spark, d), FEATURES, dense=True)
    return c.select("eom", "i", "j", (F.round(F.nanvl("rho", F.lit(None).cast("double")), 6) + F.lit(0.0)).alias("rho"), "n")


@query("cfi_clusters")
def cfi_clusters(spark, d):
    found = learn.clusters(ranked(spark, d).where(F.col("eom") <= F.lit("1998-12-31").cast("date")), FEATURES, S)
    return spark.createDataFrame([(float(cut), i, g) for cut, groups in found.items() for i, g in enumerate(groups)], "cut double, group_no int, features array<string>")


@query("factor_returns")
def factor_returns(spark, d):
    return scored_fits(spark, d)[1]


@query("factor_cov")
def factor_cov(spark, d):
    return risk_model(spark, d)[0]


@query("spec_var")
def spec_var(spark, d):
    return scored(spark, d).select("entity", "eom", "spec_var")


@query("ledoit_wolf")
def ledoit_wolf(spark, d):
    p = adapters.panel_supp(spark, d)
    return risk.shrinkage(p, p.select("eom"), 24)


def _measures(spark, d) -> DataFrame:
    p = adapters.panel_supp(spark, d)
    w = Window.partitionBy("eom")
    rel = {f"b_{c}": F.col(c) / F.avg(c).over(w) for c in ("revenue", "qty", "n_lines")}
    p = p.withColumns(rel)
    past = Window.partitionBy("entity").orderBy(month_index(F.col("eom"))).rangeBetween(-11, 0)
    return p.withColumn("b_year", F.avg("b_revenue").over(past))


MEASURES = ["b_revenue", "b_qty", "b_n_lines", "b_year"]


@query("beta_variants")
def beta_variants(spark, d):
    """Every variant of the betas on one frame, side by side."""
    model, sectors, f = risk_model(spark, d)
    made = betas.variants(f, model, FACTORS, sectors, f.select("entity", "eom", (F.col("beta_kf") * 2).alias("beta_raw")), F.year("eom") <= 1998, s=S)
    out = f.select("entity", "eom")
    for name, b in made.items():
        out = out.join(b.select("entity", "eom", F.col("beta_kf").alias(name)), ["entity", "eom"], "left")
    return out


@query("cfi_schedule")
def cfi_schedule(spark, d):
    """Walk-forward scores on features chosen window by window: every feature may go, every depth and number of trees of the settings is tried."""
    whole = Settings()
    s = S.but(rank_trees=whole.rank_trees, rank_every=whole.rank_every)
    scores, _ = learn.selected_schedule(ranked(spark, d), FEATURES, FEATURES, [1999, 2000, 2001], s)
    return scores.select("test_year", "part", "entity", "eom", "score", "val_ic", "n_features")


@query("kalman_filter")
def kalman_filter(spark, d):
    """Fixed parameters: one pass."""
    import numpy as np

    made = kalman.prepare(_measures(spark, d), MEASURES, "b_year", 8, F.col("eom") <= F.lit("1998-12-31").cast("date"))
    return kalman.smooth(made, np.array([2.0, np.log(0.02), *[np.log(0.05)] * 4]), 3)


@query("kalman_betas")
def kalman_betas(spark, d):
    """Parameters by maximum likelihood, to its end."""
    from ..sources.tables import Materializer

    made = kalman.prepare(_measures(spark, d), MEASURES, "b_year", 8, F.col("eom") <= F.lit("1998-12-31").cast("date"))
    made = Materializer(spark).scratch(made, "kalman")
    theta, _ = kalman.fit(made, 4, rounds=None)
    return kalman.smooth(made, theta, 3)


@query("beta_shrunk")
def beta_shrunk(spark, d):
    f = scored(spark, d).withColumn("raw", F.col("beta_kf") * 2)
    return f.select("entity", "eom", (F.round(kalman.shrunk("raw"), 6) + F.lit(0.0)).alias("beta"))


@query("gru_windows")
def gru_windows(spark, d):
    w = gru.windows(adapters.panel_supp(spark, d), ["revenue", "qty"], 11)
    told = F.aggregate(F.transform("changes", lambda x, i: (i + 1) * (x[0] + 2 * x[1])), F.lit(0.0), lambda a, x: a + x)
    return w.select("entity", "eom", "n_valid", F.concat_ws("", F.transform("mask", lambda m: m.cast("string"))).alias("mask"), (F.round(told, 2) + F.lit(0.0)).alias("changes"))


@query("gru_embed")
def gru_embed(spark, d):
    """Trained as far as the settings' own epochs, patience, width and decays say."""
    p = ranks.with_dense_scaled(adapters.panel_supp(spark, d), ["revenue", "qty"])
    win = gru.windows(p, ["revenue", "qty"], 11)
    return gru.embed(win, 4, F.col("eom") <= F.lit("1998-11-30").cast("date"), F.year("eom").isin(1999, 2000), S)


@query("book_spec")
def book_spec(spark, d):
    model, sectors, f = risk_model(spark, d)
    grid = joins.grid(spark, lam_tc=(0.0, 0.1), lam_beta=(10.0,), lam_risk=(0.0,), lam_factor=(0.0, 300.0))
    s = S.but(max_weight=0.05, gross=1.0)
    return books.run_books(f, grid, "spec", s, model, FACTORS, sectors)


@query("book_v2")
def book_v2(spark, d):
    model, sectors, f = risk_model(spark, d)
    grid = joins.grid(spark, ic=(0.01, 0.03))
    return books.run_books(f, grid, "v2", S.but(v2_max_weight=0.02), model, FACTORS, sectors)


def kept_marks(spark, d) -> DataFrame:
    """marked(), cut to what tail books read and written once: their counts, tails and sides each read it."""
    from ..sources.tables import Materializer

    slim = marked(spark, d).select("entity", "eom", "score", "short_eligible", "sector", "beta_kf")
    return Materializer(spark).scratch(slim, "marks")


@query("book_v3")
def book_v3(spark, d):
    out = books.run_books(kept_marks(spark, d), joins.grid(spark, smooth=S.v3_smooth), "v3", S.but(max_weight=0.2))
    return out.select("config_id", "entity", "eom", F.round("weight", 9).alias("weight"))


def v4_frame(spark, d) -> DataFrame:
    """marked(), written once, once a covariance window, with each name's history of that length; the risk model's columns are no part of these books."""
    from ..sources.tables import Materializer

    f = Materializer(spark).scratch(marked(spark, d).select("entity", "eom", "ret", "score", "short_eligible", "beta_kf", "size_pct"), "marks")
    rets, hist = f.select("entity", "eom", "ret"), None
    f = f.drop("ret")
    for w in S.v4_windows:
        x = risk.full_history(rets, f.select("eom"), w).withColumn("window", F.lit(float(w)))
        hist = x if hist is None else hist.unionByName(x)
    windows = spark.createDataFrame([(float(w),) for w in S.v4_windows], "window double")
    wide = f.crossJoin(F.broadcast(windows)).join(hist, ["entity", "eom", "window"], "left")  # two rows a window
    return wide.withColumn("beta_raw", F.col("beta_kf")).withColumn("size_group", F.when(F.col("size_pct") > 0.5, "big").otherwise("small"))


V4 = S.but(per_side=40, v4_beta_limit=0.1, v4_size_balance=0.2)


@query("book_v4_sides")
def book_v4_sides(spark, d):
    """Who may be held on which side, in the main lists and in those by size group."""
    f = books.v4_candidates(v4_frame(spark, d).where(F.col("window") == 24.0), V4)
    return f.where("main IS NOT NULL OR fallback IS NOT NULL").select("entity", "eom", "main", "fallback")


@query("book_v4")
def book_v4(spark, d):
    grid = joins.grid(spark, gross=(1.0, 1.5), cov_window=tuple(map(float, S.v4_windows)), risk_penalty=(10.0,), turnover_penalty=(0.05,))
    return books.run_books(v4_frame(spark, d), grid, "v4", V4)


@query("book_v4_by_year")
def book_v4_by_year(spark, d):
    """One book whose settings change with the target year; weights held carry on."""
    rows = [(0, y, 1.0 + 0.5 * (y % 2), 24.0, 10.0, 0.05) for y in range(1992, 2003)]
    years = spark.createDataFrame(rows, "config_id long, year int, gross double, cov_window double, risk_penalty double, turnover_penalty double")
    return books.run_books(v4_frame(spark, d), years, "v4", V4)


@query("book_grid_choice")
def book_grid_choice(spark, d):
    """Every book of a grid, its information ratio, best first."""
    from ..sources.tables import Materializer
    from .tune import grid_ratios

    p = adapters.panel_supp(spark, d)
    rate, index = adapters.market(spark, d)
    grid = joins.grid(spark, smooth=(1.0, 0.75, 0.5))
    weights = Materializer(spark).scratch(books.run_books(kept_marks(spark, d), grid, "v3", S.but(max_weight=0.2)), "weights")  # returns and turnover read them
    return rel.rounded(grid_ratios(weights, p, joins.market_full(rate, index), grid), "ir")


@query("rolling_beta_entities")
def rolling_beta_entities(spark, d):
    """12-month beta of each supplier on the index: rolling windows by entity."""
    p = adapters.panel_supp(spark, d).where("ret IS NOT NULL")
    _, index = adapters.market(spark, d)
    b = p.join(F.broadcast(index), "eom").select("entity", "eom", F.col("ret").alias("excess"), F.col("ret").alias("active"), "index_ret", F.lit(0.0).alias("rf"))
    return metrics.rolling(b, "eom", 12, "entity").select("entity", "eom", (F.round("rolling_beta", 6) + F.lit(0.0)).alias("rolling_beta"))


# ---------------------------------------------------------------- SQL
def _z(x: str) -> str:
    return f"coalesce(({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0), 0.0)"


#: scored() in SQL, as far as the queries below need it.
SCORED = f"""{rel.SUPP},
sc0 AS (SELECT *, 1.0 / qty AS idle, {rel.avg_rank_sql('revenue', 'eom')} / count(revenue) OVER (PARTITION BY eom) AS size_pct,
        {rel.avg_rank_sql('qty', 'eom')} / count(qty) OVER (PARTITION BY eom) AS volume_pct FROM p),
sc AS (SELECT entity, eom, target, substring(sector, 1, 1) AS sector, size_pct, {_z('disc')} AS score, 1 + 0.2 * {_z('n_lines')} AS beta,
        coalesce(size_pct >= 0.4 AND volume_pct >= 0.3 AND idle <= median(idle) OVER (PARTITION BY eom), false) AS ok
       FROM sc0 WINDOW w AS (PARTITION BY eom))"""


def _tail_sql(configs: list[tuple], cap: float, scored: str = "SELECT *, 0 AS d, score AS sd FROM sc", ok: str = "x.ok") -> str:
    """Weights (config_id, entity, eom, weight) of the tail books: the average as a weighted sum over the run, every tail tried on every row. configs: (smooth, d, q);
    scored has a row a name, month and d, with its score sd; ok may use q."""
    tails_ = ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(tails.tail_ladder(S.v3_tail)))
    grid = ", ".join(f"({i}, CAST({a} AS DOUBLE), {d}, CAST({q} AS DOUBLE))" for i, (a, d, q) in enumerate(configs))
    cell, month = "PARTITION BY config_id, eom, sector", "PARTITION BY config_id, eom"
    return f"""{SCORED},
zz AS (SELECT *, {_z('sd')} AS z, dense_rank() OVER (ORDER BY eom) AS mn FROM ({scored}) WINDOW w AS (PARTITION BY eom, d)),
zr AS (SELECT *, mn - row_number() OVER (PARTITION BY entity, d ORDER BY mn) AS run FROM zz),
zf AS (SELECT *, min(mn) OVER (PARTITION BY entity, d, run) AS mn0 FROM zr),
ema AS (SELECT config_id, x.entity, x.eom, x.sector, {ok} AS ok, x.beta,
          sum(y.z * CASE WHEN y.mn = y.mn0 THEN pow(1 - a, x.mn - y.mn) ELSE a * pow(1 - a, x.mn - y.mn) END ORDER BY y.mn) AS s
        FROM zf x JOIN zf y ON x.entity = y.entity AND x.d = y.d AND x.run = y.run AND y.mn <= x.mn JOIN (VALUES {grid}) c(config_id, a, d, q) ON x.d = c.d GROUP BY ALL),
hi AS (SELECT *, row_number() OVER ({cell} ORDER BY s DESC, entity) AS hi, count(*) OVER ({cell}) AS n, count(*) FILTER (ok) OVER ({cell}) AS n_ok FROM ema),
tl AS (SELECT hi.*, idx, ceil(tail * n) AS nl, ceil(tail * n_ok) AS ns FROM hi, (VALUES {tails_}) t(idx, tail)),
lo AS (SELECT *, row_number() OVER (PARTITION BY config_id, eom, sector, idx, ok AND hi > nl ORDER BY s, entity) AS lo FROM tl),
sd AS (SELECT *, CASE WHEN hi <= nl THEN 1 WHEN ok AND lo <= ns THEN -1 END AS side FROM lo),
bo AS (SELECT * FROM (SELECT *, max(side) OVER v AS top, min(side) OVER v AS low FROM sd WHERE side IS NOT NULL WINDOW v AS (PARTITION BY config_id, eom, sector, idx)) WHERE top = 1 AND low = -1),
nm AS (SELECT config_id, eom, idx, count(*) AS c FROM bo GROUP BY ALL),
pk AS (SELECT config_id, eom, coalesce(min(idx) FILTER (c <= {S.max_names}), max(idx)) AS idx FROM nm GROUP BY ALL),
hd AS (SELECT bo.* FROM bo JOIN pk USING (config_id, eom, idx)),
st AS (SELECT config_id, eom, sum(n) AS stocks FROM (SELECT DISTINCT config_id, eom, sector, n FROM hd) GROUP BY ALL),
bs AS (SELECT hd.*, n / stocks / count(*) OVER (PARTITION BY config_id, eom, sector, side) AS base FROM hd JOIN st USING (config_id, eom)),
lb AS (SELECT *, sum(base * beta) FILTER (side = 1) OVER ({month}) AS bl, sum(base * beta) FILTER (side = -1) OVER ({month}) AS bsh FROM bs),
ln AS (SELECT *, greatest(least(2 * CASE WHEN bl + bsh > 1e-9 THEN {S.gross} * bsh / (bl + bsh) ELSE {S.gross} / 2 END - {S.gross}, {S.net_band}), -{S.net_band}) AS net FROM lb),
lg AS (SELECT *, ({S.gross} + side * net) / 2 AS leg, row_number() OVER o - 1 AS m, sum(base) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM ln WINDOW o AS (PARTITION BY config_id, eom, side ORDER BY base DESC, entity)),
cp AS (SELECT *, base * (leg - m * {cap}) / below > {cap} + 1e-12 AS capped FROM lg),
w3 AS (SELECT config_id, entity, eom, side * CASE WHEN capped THEN {cap} ELSE base * (leg - {cap} * count(*) FILTER (capped) OVER g) / sum(base) FILTER (NOT capped) OVER g END AS weight
       FROM cp WINDOW g AS (PARTITION BY config_id, eom, side))"""

SQL["book_v3"] = f"WITH {_tail_sql([(a, 0, 0) for a in S.v3_smooth], 0.2)} SELECT CAST(config_id AS BIGINT) AS config_id, entity, eom, round(weight, 9) AS weight FROM w3"

SQL["book_v4_sides"] = f"""WITH {SCORED},
h AS (SELECT *, count(*) OVER (PARTITION BY entity ORDER BY mi RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS nh FROM p WHERE ret IS NOT NULL),
c AS (SELECT sc.*, CASE WHEN size_pct > 0.5 THEN 'big' ELSE 'small' END AS grp, 2 * {rel.avg_rank_sql('score', 'eom')} / (count(score) OVER (PARTITION BY eom) + 1) - 1 AS s FROM sc),
k AS (SELECT c.* FROM c JOIN h USING (entity, eom) WHERE nh = 24),
a AS (SELECT *, row_number() OVER (PARTITION BY eom ORDER BY s DESC, entity) AS hi, row_number() OVER (PARTITION BY eom, grp ORDER BY s DESC, entity) AS gh, least(50, count(*) OVER (PARTITION BY eom, grp) // 2) AS gk FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY eom, ok AND hi > 40 ORDER BY s, entity) AS lo, row_number() OVER (PARTITION BY eom, grp, ok AND gh > gk ORDER BY s, entity) AS gl FROM a),
r AS (SELECT entity, eom, CASE WHEN hi <= 40 THEN 1 WHEN ok AND lo <= 40 THEN -1 END AS main, CASE WHEN gh <= gk THEN 1 WHEN ok AND gl <= gk THEN -1 END AS fallback FROM b)
SELECT entity, eom, CAST(main AS INTEGER) AS main, CAST(fallback AS INTEGER) AS fallback FROM r WHERE main IS NOT NULL OR fallback IS NOT NULL"""

SQL["beta_shrunk"] = f"WITH {SCORED} SELECT entity, eom, {rel.r('0.67 * (2 * beta) + 0.33', 'beta')} FROM sc"

SQL["shuffle_labels"] = f"""WITH {rel.PART}, t AS (SELECT entity, eom, CAST(floor(10 * (row_number() OVER (PARTITION BY eom ORDER BY target, entity) - 1) / count(*) OVER (PARTITION BY eom)) AS INTEGER) AS label FROM p WHERE target IS NOT NULL),
a AS (SELECT entity, eom, row_number() OVER (PARTITION BY eom ORDER BY entity) AS i FROM t), b AS (SELECT eom, label, row_number() OVER (PARTITION BY eom ORDER BY md5(entity || '|42'), entity) AS i FROM t)
SELECT a.entity, a.eom, b.label FROM a JOIN b USING (eom, i)"""


def _correlations() -> str:
    scaled = ", ".join(f"coalesce(CASE WHEN max({c}) OVER (PARTITION BY eom) > 0 THEN {c} * 1.0 / max({c}) OVER (PARTITION BY eom) * 2 - 1 ELSE 0.0 END, 0.0) AS {c}" for c in FEATURES)
    dense = ", ".join(f"{rel._dense_sql(c)} AS {c}" for c in FEATURES)
    placed = ", ".join(f"{rel.avg_rank_sql(c, 'eom')} AS {c}" for c in FEATURES)
    rho = lambda a, b: f"CASE WHEN count(*) > 2 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"
    pairs = [f"SELECT eom, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, {rel.r(rho(a, b), 'rho')}, count(*) AS n FROM k GROUP BY eom" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j]
    return f"WITH {rel.PART}, d AS (SELECT entity, eom, {dense} FROM p), f AS (SELECT entity, eom, {scaled} FROM d), k AS (SELECT entity, eom, {placed} FROM f) {' UNION ALL '.join(pairs)}"


SQL["month_rank_correlations"] = _correlations()


def _scaled_sql() -> str:
    """f: the features of the part panel as ranks in [-1, 1], with the target."""
    scaled = ", ".join(f"coalesce(CASE WHEN max({c}) OVER (PARTITION BY eom) > 0 THEN {c} * 1.0 / max({c}) OVER (PARTITION BY eom) * 2 - 1 ELSE 0.0 END, 0.0) AS {c}" for c in FEATURES)
    return f"{rel.PART}, d AS (SELECT entity, eom, target, {', '.join(f'{rel._dense_sql(c)} AS {c}' for c in FEATURES)} FROM p), f AS (SELECT entity, eom, target, {scaled} FROM d)"


def _ridge_sql(alpha: float, last: str) -> str:
    """Normal equations, solved by elimination: step p clears column p of every other row."""
    k = len(FEATURES)
    cov = lambda a, b: f"sum({a} * {b}) - count(*) * avg({a}) * avg({b})"
    cells = [f"{cov(a, b)}{f' + {alpha}' if a == b else ''} AS a{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate([*FEATURES, "target"])]
    steps = [f"e0 AS (SELECT {', '.join(cells)}, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(FEATURES))}, avg(target) AS my FROM f WHERE target IS NOT NULL AND eom <= DATE '{last}')"]
    for p in range(k):
        new = [f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" if i != p else f"a{i}_{j}" for i in range(k) for j in range(k + 1)]
        steps.append(f"e{p + 1} AS (SELECT {', '.join(new)}, {', '.join(f'm{i}' for i in range(k))}, my FROM e{p})")
    w = [f"a{i}_{k} / a{i}_{i}" for i in range(k)]
    steps.append(f"sol AS (SELECT {', '.join(f'{x} AS w{i}' for i, x in enumerate(w))}, my - ({' + '.join(f'm{i} * {x}' for i, x in enumerate(w))}) AS c FROM e{k})")
    return ", ".join(steps)


SQL["ridge_scores"] = f"WITH {_scaled_sql()}, {_ridge_sql(10.0, '1998-12-31')} SELECT entity, eom, {rel.r('c + ' + ' + '.join(f'w{i} * {x}' for i, x in enumerate(FEATURES)), 'score')} FROM f, sol"

SQL["gru_windows"] = f"""WITH {rel.SUPP}, c AS (SELECT entity, eom, mi, lag(mi) OVER w = mi - 1 AS ok, revenue - lag(revenue) OVER w AS a, qty - lag(qty) OVER w AS b FROM p WINDOW w AS (PARTITION BY entity ORDER BY eom)),
g AS (SELECT x.entity, x.eom, o, y.mi IS NOT NULL AS hit, coalesce(y.a + 2 * y.b, 0.0) AS v FROM c x CROSS JOIN (SELECT unnest(range(0, 11)) AS o) LEFT JOIN c y ON y.entity = x.entity AND y.mi = x.mi - 10 + o AND y.ok)
SELECT entity, eom, count(*) FILTER (hit) AS n_valid, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY o) AS mask, round(sum((o + 1) * v), 2) + 0.0 AS changes FROM g GROUP BY entity, eom"""

SQL["rolling_beta_entities"] = f"""WITH {rel.SUPP}, v AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS eom, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1),
idx AS (SELECT * FROM (SELECT eom, v / lag(v) OVER (ORDER BY eom) - 1 AS x FROM v) WHERE x IS NOT NULL), b AS (SELECT entity, eom, ret, x FROM p JOIN idx USING (eom) WHERE ret IS NOT NULL)
SELECT entity, eom, {rel.r('CASE WHEN count(*) OVER w = 12 THEN covar_samp(ret, x) OVER w / nullif(var_samp(x) OVER w, 0) END', 'rolling_beta')} FROM b WINDOW w AS (PARTITION BY entity ORDER BY eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
