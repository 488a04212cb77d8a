"""Queries of staged runs: a frame made from tables stage by stage, a lattice of books, forecasts by window. Each has its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import joins, learn, metrics, text
from ..sources import adapters
from ..sources.tables import Materializer
from . import models, pipeline
from . import relational as rel
from .graph import Graph
from .relational import PART, SUPP, avg_rank_sql, r, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


# ---------------------------------------------------------------- from tables to a frame
ORDERED = "f AS (SELECT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS eom, o_orderpriority AS t FROM orders)"


@query("staged_frame", f"""WITH {SUPP}, {ORDERED},
u AS (SELECT *, {avg_rank_sql('revenue', 'eom')} / count(revenue) OVER (PARTITION BY eom) AS size_pct, {avg_rank_sql('qty', 'eom')} / count(qty) OVER (PARTITION BY eom) AS volume_pct,
        1.0 / qty <= median(1.0 / qty) OVER (PARTITION BY eom) AS calm FROM p),
fm AS (SELECT entity, eom, count(*) AS n_filings, max(CASE WHEN t = '1-URGENT' THEN 1 ELSE 0 END) AS item, sum(CASE WHEN t = '1-URGENT' THEN 1 ELSE 0 END) AS hist, year(eom) * 12 + month(eom) AS mi FROM f GROUP BY entity, eom),
h AS (SELECT u.entity, u.eom, sum(fm.hist) AS hist FROM u JOIN fm ON fm.entity = u.entity AND fm.mi BETWEEN u.mi - 11 AND u.mi GROUP BY 1, 2)
SELECT u.entity, u.eom, {r('size_pct')}, {', '.join(f'coalesce(size_pct >= {q} AND volume_pct >= 0.3 AND calm, false) AS open_{round(q * 100)}' for q in (0.3, 0.4, 0.5))},
  CAST(fm.n_filings IS NOT NULL AS INTEGER) AS has_filing, fm.n_filings, CAST(fm.item AS INTEGER) AS urgent, CAST(coalesce(h.hist, 0) AS BIGINT) AS urgent_12, {r('target')}
FROM u LEFT JOIN fm ON fm.entity = u.entity AND fm.eom = u.eom LEFT JOIN h ON h.entity = u.entity AND h.eom = u.eom""")  # fmt: skip
def staged_frame(spark, d):
    """Suppliers by month with eligibility at every limit and the flags of orders as filings, as a graph of stages over the tables' files."""
    g = Graph(spark, f"{Materializer(spark).root}/staged-{uuid.uuid4().hex}")
    for name in ("lineitem", "supplier", "orders"):
        g.files(name, f"{d}/{name}.parquet")
    g.stage("panel", lambda *_: adapters.panel_supp(spark, d), "lineitem", "supplier")
    idle = 1.0 / F.col("qty")
    pct = {"size_pct": ranks.pct_rank("revenue", "eom"), "volume_pct": ranks.pct_rank("qty", "eom"), "calm": idle <= F.median(idle).over(Window.partitionBy("eom"))}
    g.stage("universe", lambda p: p.withColumns(pct), "panel")
    g.stage("filings", lambda o: o.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filing_date"), F.array("o_orderpriority").alias("items")), "orders")
    g.stage("events", lambda f, u: text.event_flags(f, u.select("entity", "eom"), ["1-URGENT"], ["1-URGENT"]), "filings", "universe")
    opened = lambda u: pipeline.with_eligible(u.select("entity", "eom", "size_pct", "volume_pct", "calm"), [0.3, 0.4, 0.5])
    g.stage("eligible", lambda u: opened(u).groupBy("entity", "eom").pivot("short_q", [0.3, 0.4, 0.5]).agg(F.first("short_eligible")).toDF("entity", "eom", "open_30", "open_40", "open_50"), "universe")
    g.stage("frame", lambda u, e, o: u.join(e, ["entity", "eom"], "left").join(o, ["entity", "eom"], "left"), "universe", "events", "eligible")
    out = g.get("frame").select("entity", "eom", "size_pct", "open_30", "open_40", "open_50", "has_filing", "n_filings", F.col("item_1-URGENT").alias("urgent"), F.col("hist_1-URGENT").alias("urgent_12"), "target")
    return rounded(out, "size_pct", "target")


# ---------------------------------------------------------------- books over embedding sizes and limits
SIZES, LIMITS = {1: "disc", 2: "n_lines", 3: "qty"}, (0.3, 0.4, 0.5)
LATTICE = [(a, d, q) for d in SIZES for q in LIMITS for a in models.S.v3_smooth]
_SCORES = " UNION ALL ".join(f"SELECT sc.*, {d} AS d, ({c} - avg({c}) OVER (PARTITION BY eom)) AS sd FROM sc" for d, c in SIZES.items())


def _ratio_sql(weights: str, columns: str, rows: str, names: str) -> str:
    """Information ratios of the weights w3, a row a config."""
    return f"""WITH {weights},
g3 AS (SELECT w3.config_id, w3.eom, sum(weight * coalesce(p.target, 0.0)) - 0.04 / 12 AS active FROM w3 LEFT JOIN p ON p.entity = w3.entity AND p.eom = w3.eom GROUP BY 1, 2)
SELECT CAST(c.config_id AS BIGINT) AS config_id, {columns}, {r('sqrt(12) * avg(active) / nullif(stddev_samp(active), 0)', 'ir')}, count(*) AS n_months
FROM g3 JOIN (VALUES {rows}) c(config_id, {names}) ON c.config_id = g3.config_id GROUP BY ALL"""


def _lattice_sql() -> str:
    scored = models.SCORED.replace("SELECT entity, eom, target, substring", "SELECT entity, eom, target, disc, n_lines, qty, volume_pct, idle <= median(idle) OVER (PARTITION BY eom) AS calm, substring")
    weights = models._tail_sql(LATTICE, 0.2, _SCORES, "coalesce(x.size_pct >= c.q AND x.volume_pct >= 0.3 AND x.calm, false)").replace(models.SCORED, scored)
    rows = ", ".join(f"({i}, {d}, CAST({q} AS DOUBLE), CAST({a} AS DOUBLE))" for i, (a, d, q) in enumerate(LATTICE))
    return _ratio_sql(weights, "CAST(d AS BIGINT) AS d, q AS short_q, a AS smooth", rows, "d, q, a")


_SMOOTH = (1.0, 0.75, 0.5)
SQL["book_grid_choice"] = _ratio_sql(models._tail_sql([(a, 0, 0) for a in _SMOOTH], 0.2), "a AS smooth", ", ".join(f"({i}, CAST({a} AS DOUBLE))" for i, a in enumerate(_SMOOTH)), "a")


@query("book_lattice", _lattice_sql())
def book_lattice(spark, d):
    """Ratios of tail books over three axes: scores once a size d, eligibility once a limit, and each book the two it names."""
    frame = models.marked(spark, d).withColumn("calm", F.col("idle") <= F.median("idle").over(Window.partitionBy("eom")))
    frame = Materializer(spark).scratch(frame.select("entity", "eom", "target", "sector", "beta_kf", "size_pct", "volume_pct", "calm", *SIZES.values()), "lattice")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("d"), F.col(c).cast("double").alias("score")) for k, c in SIZES.items()])).alias("x")
    scores = frame.select("entity", "eom", each).select("entity", "eom", "x.d", "x.score")
    rows = [(i, k, q, a) for i, (a, k, q) in enumerate(LATTICE)]
    grid = spark.createDataFrame(rows, "config_id long, d long, short_q double, smooth double")
    rate, index = adapters.market(spark, d)
    desk = pipeline.Desk(frame, joins.market_full(rate, index), models.S.but(max_weight=0.2))
    weights = Materializer(spark).scratch(desk.weights(scores, "v3", grid, limits=list(LIMITS)), "weights")  # returns and turnover read them
    return rounded(desk.ratios(weights, grid), "ir")


# ---------------------------------------------------------------- forecasts by window
YEARS = [1999, 2000, 2001]
_WINDOWS = f"""{PART}, y AS (SELECT unnest({YEARS}) AS test_year), t AS (SELECT *, last_day(eom + INTERVAL 1 DAY) AS tm FROM p),
x AS (SELECT test_year, CASE WHEN tm < make_date(test_year - 2, 1, 1) THEN 'train' WHEN tm < make_date(test_year, 1, 1) THEN 'val' WHEN tm < make_date(test_year + 1, 1, 1) THEN 'test' END AS part, entity, eom, revenue, target
      FROM t, y WHERE tm >= DATE '1996-02-01' AND tm <= DATE '2001-06-30'),
k AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN ({avg_rank_sql('revenue', 'test_year, part, eom')} - 1) / (count(*) OVER w - 1) * 2 - 1 ELSE 0.0 END AS sr FROM x WHERE part IN ('val', 'test') WINDOW w AS (PARTITION BY test_year, part, eom)),
ft AS (SELECT test_year, regr_slope(target, sr) AS b, regr_intercept(target, sr) AS a FROM k WHERE part = 'val' AND target IS NOT NULL GROUP BY test_year)"""


def _forecasts(spark, d) -> tuple[DataFrame, DataFrame]:
    from datetime import date

    p = adapters.panel_part(spark, d).withColumn("target_month", rel.next_month_end(F.col("eom")))
    tagged = learn.tag_windows(p, YEARS, first=date(1996, 2, 1), last=date(2001, 6, 30)).where("part <> 'train'")
    return learn.with_ret_hat(tagged.select("test_year", "part", "entity", "eom", F.col("revenue").alias("score")), p), p


@query("walk_forward_ret_hat", f"WITH {_WINDOWS} SELECT test_year, part, entity, eom, {r('a + b * sr', 'ret_hat')} FROM k JOIN ft USING (test_year)")
def walk_forward_ret_hat(spark, d):
    """Each window's forecast on its validation and test months, between a first and a last target month."""
    out, _ = _forecasts(spark, d)
    return rounded(out.select("test_year", "part", "entity", "eom", "ret_hat"), "ret_hat")


@query("walk_forward_r2", f"WITH {_WINDOWS}, e AS (SELECT test_year, target, a + b * sr AS f FROM k JOIN ft USING (test_year) WHERE part = 'test' AND target IS NOT NULL) SELECT {r('1 - sum((target - f) * (target - f)) / sum(target * target)', 'oos_r2')}, count(*) AS n FROM e")
def walk_forward_r2(spark, d):
    """Out-of-sample R2 of the forecasts of all test months."""
    out, p = _forecasts(spark, d)
    return rounded(metrics.oos_r2(out.where("part = 'test'").join(p.select("entity", "eom", "target"), ["entity", "eom"]), "target", "ret_hat"), "oos_r2")
