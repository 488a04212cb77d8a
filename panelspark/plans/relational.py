"""Queries of the relational operators over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.dates import month_index, next_month_end
from ..operators import joins, metrics, ranging, selection, text, universe
from ..sources import adapters
from ..sources.tables import Materializer
from ..spec import Settings

S = Settings()
PLACES = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to PLACES decimals, so that sums in another order compare equal; never minus zero."""
    return df.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c in columns})


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, {PLACES}) + 0.0 AS {name or x}"


# ---------------------------------------------------------------- shared SQL
def panel_sql(entity: str, join: str, columns: str) -> str:
    return f"""
m AS (SELECT {entity} AS entity, last_day(CAST(l_shipdate AS DATE)) AS eom,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
        count(*) AS n_lines, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS disc
      FROM lineitem GROUP BY 1, 2),
p0 AS (SELECT m.*, {columns}, year(eom) * 12 + month(eom) AS mi FROM m JOIN {join}),
p AS (SELECT *,
        CASE WHEN lag(mi) OVER w = mi - 1 THEN revenue / nullif(lag(revenue) OVER w, 0) - 1 END AS ret,
        CASE WHEN lead(mi) OVER w = mi + 1 THEN lead(revenue) OVER w / nullif(revenue, 0) - 1 END AS target
      FROM p0 WINDOW w AS (PARTITION BY entity ORDER BY eom))"""


PART = panel_sql("l_partkey", "part ON p_partkey = entity", "p_retailprice AS price, substring(p_brand, 7, 1) AS sector, p_size AS size")
SUPP = panel_sql("l_suppkey", "supplier ON s_suppkey = entity", "CAST(s_nationkey AS VARCHAR) AS sector, s_acctbal AS price")


def avg_rank_sql(x: str, by: str) -> str:
    """Average rank among non-null values of a column."""
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END)"


RANK_REVENUE, RANK_LINES = avg_rank_sql("revenue", "eom"), avg_rank_sql("n_lines", "eom")

#: A plain book: the 50 largest revenues of the month long, the 50 smallest short, equal weights.
BOOK = f"""{PART},
l AS (SELECT *, row_number() OVER (PARTITION BY eom ORDER BY revenue DESC NULLS LAST, entity) AS hi FROM p),
l2 AS (SELECT *, row_number() OVER (PARTITION BY eom, hi > 50 ORDER BY revenue NULLS LAST, entity) AS lo FROM l),
lists AS (SELECT eom, entity, CASE WHEN hi <= 50 THEN 1 ELSE -1 END AS side FROM l2 WHERE hi <= 50 OR lo <= 50),
weights AS (SELECT eom, entity, side * 1.0 / count(*) OVER (PARTITION BY eom, side) AS weight FROM lists),
rate AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS eom, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) * 12.0 / count(*) AS rate FROM orders GROUP BY 1),
v AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS eom, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1),
idx AS (SELECT * FROM (SELECT eom, v / lag(v) OVER (ORDER BY eom) - 1 AS index_ret FROM v) WHERE index_ret IS NOT NULL),
mk0 AS (SELECT coalesce(rate.eom, idx.eom) AS eom, rate, index_ret FROM rate FULL JOIN idx ON rate.eom = idx.eom),
mk AS (SELECT last_day(eom - INTERVAL 1 MONTH) AS eom, rate / 1200 AS rf, index_ret FROM mk0),
wt AS (SELECT w.*, coalesce(p.target, 0.0) AS rr, p.target IS NULL AS missing FROM weights w LEFT JOIN p ON p.entity = w.entity AND p.eom = w.eom),
g AS (SELECT eom, coalesce(sum(CASE WHEN weight > 0 THEN weight * rr END), 0.0) AS long_leg, coalesce(sum(CASE WHEN weight < 0 THEN weight * rr END), 0.0) AS short_leg,
        sum(abs(weight)) AS gross, sum(weight) AS net, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short, count(*) FILTER (missing) AS n_missing
      FROM wt GROUP BY eom),
months AS (SELECT eom, lead(eom) OVER (ORDER BY eom) AS nxt FROM (SELECT DISTINCT eom FROM weights)),
mv AS (SELECT entity, eom, sum(weight) AS d FROM (
        SELECT entity, eom, weight FROM weights UNION ALL
        SELECT entity, nxt AS eom, -weight AS weight FROM weights JOIN months USING (eom) WHERE nxt IS NOT NULL) GROUP BY 1, 2),
tn AS (SELECT eom, sum(abs(d)) AS turnover FROM mv GROUP BY eom),
br AS (SELECT g.eom, CAST(date_trunc('month', g.eom + INTERVAL 1 DAY) AS DATE) AS date, rf + long_leg + short_leg AS total, long_leg + short_leg AS excess,
        long_leg + short_leg - 0.04 / 12 AS active, long_leg, short_leg, rf + 0.04 / 12 AS benchmark, index_ret, gross, net, n_long, n_short, turnover, rf, n_missing
      FROM g JOIN tn USING (eom) LEFT JOIN mk USING (eom))"""


def book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, panel, market) of the plain book."""
    panel = adapters.panel_part(spark, d)
    lists = universe.tail_lists(panel.withColumn("ok", F.lit(True)), "revenue", "ok", 50, 50)
    n = F.count(F.lit(1)).over(Window.partitionBy("eom", "side"))
    rate, index = adapters.market(spark, d)
    return lists.withColumn("weight", F.col("side") * 1.0 / n).drop("side"), panel, joins.market_full(rate, index)


def returns(spark: SparkSession, d: str) -> DataFrame:
    weights, panel, market = book(spark, d)
    return metrics.book_returns(weights, panel, market)


def _idle() -> Column:
    return 1.0 / F.col("qty")


def _universe(spark, d):
    p = adapters.panel_part(spark, d).withColumn("idle", _idle()).select("entity", "eom", "price", "revenue", "qty", "idle", "target", "sector")
    return universe.build_universe(p, "price", "revenue", "qty")


UNIVERSE_SQL = f"""{PART},
c AS (SELECT *, 1.0 / qty AS idle, {avg_rank_sql('revenue', 'eom')} / count(revenue) OVER (PARTITION BY eom) AS size_pct,
        row_number() OVER (PARTITION BY eom ORDER BY revenue) AS rn, round((count(revenue) OVER (PARTITION BY eom) - 1) * 0.2) + 1 AS place FROM p),
c2 AS (SELECT *, max(CASE WHEN rn = place THEN revenue END) OVER (PARTITION BY eom) AS cut FROM c),
u AS (SELECT *, {avg_rank_sql('qty', 'eom')} / count(qty) OVER (PARTITION BY eom) AS volume_pct FROM c2 WHERE abs(price) >= 5.0 AND revenue > cut)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- universe, ranks
@query("rank_ic_monthly", f"WITH {UNIVERSE_SQL}, s AS (SELECT eom, {avg_rank_sql('revenue', 'eom')} AS a, target, revenue FROM u WHERE target IS NOT NULL), k AS (SELECT eom, {avg_rank_sql('revenue', 'eom')} AS rs, {avg_rank_sql('target', 'eom')} AS ry FROM s) SELECT eom, {r('corr(rs, ry)', 'ic')}, count(*) AS n FROM k GROUP BY eom HAVING count(*) > 2")
def rank_ic_monthly(spark, d):
    u = universe.preprocess(_universe(spark, d), ["revenue"], "sector", F.lit(True))[0]
    return rounded(metrics.rank_ic(u, "revenue", "target").where("n > 2"), "ic")


@query("ic_summary", f"WITH {UNIVERSE_SQL}, s AS (SELECT eom, revenue, target FROM u WHERE target IS NOT NULL), k AS (SELECT eom, {avg_rank_sql('revenue', 'eom')} AS rs, {avg_rank_sql('target', 'eom')} AS ry FROM s), i AS (SELECT eom, corr(rs, ry) AS ic, count(*) AS n FROM k GROUP BY eom) SELECT {r('avg(ic)', 'mean_ic')}, {r('avg(ic) / stddev_samp(ic) * sqrt(12)', 'icir')}, count(*) AS n_months FROM i WHERE ic IS NOT NULL AND n > 2")
def ic_summary(spark, d):
    ics = metrics.rank_ic(_universe(spark, d), "revenue", "target").where("n > 2")
    return rounded(metrics.ic_summary(ics), "mean_ic", "icir")


@query("universe_filter", f"WITH {UNIVERSE_SQL} SELECT entity, eom, revenue, {r('size_pct')}, {r('volume_pct')} FROM u")
def universe_filter(spark, d):
    return rounded(_universe(spark, d).select("entity", "eom", "revenue", "size_pct", "volume_pct"), "size_pct", "volume_pct")


@query("short_eligible", f"WITH {UNIVERSE_SQL} SELECT entity, eom, coalesce(size_pct >= 0.4 AND volume_pct >= 0.3 AND idle <= median(idle) OVER (PARTITION BY eom), false) AS short_eligible FROM u")
def short_eligible(spark, d):
    return universe.with_short_eligible(_universe(spark, d)).select("entity", "eom", "short_eligible")


@query("short_eligible_grid", f"WITH {UNIVERSE_SQL}, e AS (SELECT *, median(idle) OVER (PARTITION BY eom) AS mid FROM u), q AS (SELECT unnest([0.3, 0.4, 0.5]) AS q) SELECT CAST(q AS DOUBLE) AS q, eom, count(*) FILTER (size_pct >= q AND volume_pct >= 0.3 AND idle <= mid) AS n FROM e CROSS JOIN q GROUP BY 1, 2")
def short_eligible_grid(spark, d):
    u = universe.with_short_eligible(_universe(spark, d), "calm", least_size=-1.0)  # the limit of size is counted below; volume and idleness once for all
    u = u.withColumn("q", F.explode(F.array(*[F.lit(x) for x in S.short_size_grid])))
    return u.groupBy("q", "eom").agg(F.count_if(F.col("calm") & (F.col("size_pct") >= F.col("q"))).alias("n"))


@query("pct_rank_avg", f"WITH {PART} SELECT entity, eom, {r(avg_rank_sql('n_lines', 'eom') + ' / count(n_lines) OVER (PARTITION BY eom)', 'pct')} FROM p")
def pct_rank_avg(spark, d):
    p = ranging.ranked(adapters.panel_part(spark, d).select("entity", "eom", "n_lines"), "n_lines", "eom", ["entity"])
    return rounded(p.select("entity", "eom", ranging.percent().alias("pct")), "pct")


@query("quantile_nearest", f"WITH {PART}, c AS (SELECT eom, revenue, row_number() OVER (PARTITION BY eom ORDER BY revenue) AS rn, round((count(*) OVER (PARTITION BY eom) - 1) * 0.2) + 1 AS place FROM p) SELECT eom, max(revenue) AS cut, count(*) AS n FROM c WHERE rn = place GROUP BY eom")
def quantile_nearest(spark, d):
    cut = selection.quantiles(adapters.panel_part(spark, d), ["revenue"], [0.2], ["eom"], "nearest")
    return cut.select("eom", F.col("value").alias("cut"), F.lit(1).cast("long").alias("n"))


@query("quantile_linear", f"WITH {PART} SELECT eom, {r('quantile_cont(revenue, 0.2)', 'cut')} FROM p GROUP BY eom")
def quantile_linear(spark, d):
    cut = selection.quantiles(adapters.panel_part(spark, d), ["revenue"], [0.2], ["eom"])
    return rounded(cut.select("eom", F.col("value").alias("cut")), "cut")


def _dense_sql(x: str) -> str:
    rank = f"(CASE WHEN {x} IS NOT NULL THEN dense_rank() OVER (PARTITION BY eom ORDER BY {x} NULLS LAST) - 1 END)"
    return rank


DENSE = ("revenue", "qty", "disc", "ret")


@query("dense_rank_scaled", f"WITH {PART}, k AS (SELECT entity, eom, {', '.join(f'{_dense_sql(c)} AS {c}' for c in DENSE)} FROM p) SELECT entity, eom, {', '.join(r(f'coalesce(CASE WHEN max({c}) OVER (PARTITION BY eom) > 0 THEN {c} * 1.0 / max({c}) OVER (PARTITION BY eom) * 2 - 1 ELSE 0.0 END, 0.0)', c) for c in DENSE)} FROM k")
def dense_rank_scaled(spark, d):
    out = ranks.with_dense_scaled(adapters.panel_part(spark, d).select("entity", "eom", *DENSE), list(DENSE), "eom", ["entity", "eom"])
    return rounded(out.select("entity", "eom", *DENSE), *DENSE)


@query("dense_rank_scaled_wide", SQL["dense_rank_scaled"])
def dense_rank_scaled_wide(spark, d):
    """The long form: one sort for all columns."""
    out = ranks.with_dense_scaled(adapters.panel_part(spark, d).select("entity", "eom", *DENSE), list(DENSE), "eom", ["entity", "eom"])
    return rounded(out, *DENSE)


@query("missing_flags", f"WITH {PART} SELECT entity, eom, CAST(ret IS NULL AS INTEGER) AS ret_miss, CAST(target IS NULL AS INTEGER) AS target_miss FROM p")
def missing_flags(spark, d):
    p = adapters.panel_part(spark, d)
    flags = universe.flag_columns(p.where(F.col("eom") <= F.lit("1999-12-31").cast("date")), ["revenue", "qty", "ret", "target"])
    return universe.with_flags(p, flags).select("entity", "eom", *[f"{c}_miss" for c in flags])


@query("sector_code", f"WITH {PART} SELECT coalesce(substring(sector, 1, 2), 'NA') AS sector, count(*) AS n FROM p GROUP BY 1")
def sector_code(spark, d):
    p = adapters.panel_part(spark, d).withColumn("sector", F.coalesce(F.substring("sector", 1, 2), F.lit("NA")))
    return p.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("decile_labels", f"WITH {PART} SELECT entity, eom, CAST(floor(10 * (row_number() OVER (PARTITION BY eom ORDER BY target, entity) - 1) / count(*) OVER (PARTITION BY eom)) AS INTEGER) AS label FROM p WHERE target IS NOT NULL")
def decile_labels(spark, d):
    p = ranging.ranked(adapters.panel_part(spark, d).where("target IS NOT NULL").select("entity", "eom", "target"), "target", "eom", ["entity"])
    return p.select("entity", "eom", ranging.tenth().alias("label"))


@query("score_rank_scaled", f"WITH {PART} SELECT entity, eom, {r(f'CASE WHEN count(revenue) OVER (PARTITION BY eom) > 1 THEN ({RANK_REVENUE} - 1) / (count(revenue) OVER (PARTITION BY eom) - 1) * 2 - 1 ELSE 0.0 END', 'score_rank')} FROM p")
def score_rank_scaled(spark, d):
    p = ranging.ranked(adapters.panel_part(spark, d).select("entity", "eom", "revenue"), "revenue", "eom", ["entity"])
    return rounded(p.select("entity", "eom", ranging.scaled().alias("score_rank")), "score_rank")


@query("zscore_month", f"WITH {PART} SELECT entity, eom, {r('coalesce((revenue - avg(revenue) OVER w) / nullif(stddev_samp(revenue) OVER w, 0), 0.0)', 'z')}, {r('coalesce((lr - avg(lr) OVER w) / nullif(stddev_samp(lr) OVER w, 0), 0.0)', 'size_z')} FROM (SELECT *, CASE WHEN revenue > 0 THEN ln(revenue) END AS lr FROM p) WINDOW w AS (PARTITION BY eom)")
def zscore_month(spark, d):
    p = adapters.panel_part(spark, d).withColumn("lr", F.when(F.col("revenue") > 0, F.ln("revenue")))
    return rounded(p.select("entity", "eom", ranks.zscore("revenue", "eom").alias("z"), ranks.zscore("lr", "eom").alias("size_z")), "z", "size_z")


@query("median_fill", f"WITH {PART} SELECT entity, eom, {r('coalesce(ret, median(ret) OVER (PARTITION BY eom), (SELECT median(ret) FROM p))', 'filled')} FROM p")
def median_fill(spark, d):
    p = Materializer(spark).scratch(adapters.panel_part(spark, d).select("entity", "eom", "ret"), "returns")  # read three times
    p = selection.median_filled(p, ["ret"])
    return rounded(p.select("entity", "eom", F.col("ret").alias("filled")), "filled")


@query("clip_p1_p99", f"WITH {PART}, b AS (SELECT quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM p WHERE eom <= DATE '1999-12-31') SELECT entity, eom, {r('greatest(least(ret, hi), lo)', 'clipped')} FROM p, b WHERE ret IS NOT NULL")
def clip_p1_p99(spark, d):
    p = adapters.panel_part(spark, d)
    out = universe.clip_quantiles(p, ["ret"], fit=F.col("eom") <= F.lit("1999-12-31").cast("date")).where("ret IS NOT NULL")
    return rounded(out.select("entity", "eom", F.col("ret").alias("clipped")), "clipped")


@query("clip_nearest", f"WITH {PART}, f AS (SELECT ret, row_number() OVER (ORDER BY ret) - 1 AS i, count(*) OVER () - 1 AS m FROM p WHERE ret IS NOT NULL AND eom <= DATE '1999-12-31'), b AS (SELECT max(ret) FILTER (i = round(0.01 * m)) AS lo, max(ret) FILTER (i = round(0.99 * m)) AS hi FROM f) SELECT entity, eom, {r('greatest(least(ret, hi), lo)', 'clipped')} FROM p, b WHERE ret IS NOT NULL")
def clip_nearest(spark, d):
    p = adapters.panel_part(spark, d)
    out = universe.clip_quantiles(p, ["ret"], fit=F.col("eom") <= F.lit("1999-12-31").cast("date"), interpolation="nearest").where("ret IS NOT NULL")
    return rounded(out.select("entity", "eom", F.col("ret").alias("clipped")), "clipped")


@query("smoke_sample", f"WITH {PART}, k AS (SELECT entity FROM (SELECT DISTINCT entity FROM p) ORDER BY md5(entity || '|42'), entity LIMIT 100) SELECT entity, eom, {r('revenue')} FROM p SEMI JOIN k USING (entity)")
def smoke_sample(spark, d):
    """The feature is the sample: rows of 100 entities by a seeded hash."""
    return rounded(universe.sample_entities(adapters.panel_part(spark, d), 100).select("entity", "eom", "revenue"), "revenue")


@query("topk_disjoint_lists", f"WITH {UNIVERSE_SQL}, e AS (SELECT *, coalesce(size_pct >= 0.4 AND volume_pct >= 0.3 AND idle <= median(idle) OVER (PARTITION BY eom), false) AS ok, row_number() OVER (PARTITION BY eom ORDER BY revenue DESC, entity) AS hi FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY eom, (ok AND hi > 30) ORDER BY revenue, entity) AS lo FROM e) SELECT eom, entity, CASE WHEN hi <= 30 THEN 1 ELSE -1 END AS side FROM f WHERE hi <= 30 OR (ok AND lo <= 30)")
def topk_disjoint_lists(spark, d):
    u = universe.with_short_eligible(_universe(spark, d), "ok")
    return universe.tail_lists(u, "revenue", "ok", 30, 30)


@query("size_group_lists", f"WITH {PART}, e AS (SELECT *, size % 4 AS grp FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY eom, grp ORDER BY revenue DESC, entity) AS hi, least(50, count(*) OVER (PARTITION BY eom, grp) // 2) AS k FROM e), h AS (SELECT *, row_number() OVER (PARTITION BY eom, grp, hi > k ORDER BY revenue, entity) AS lo FROM f) SELECT eom, grp, entity, CASE WHEN hi <= k THEN 1 ELSE -1 END AS side FROM h WHERE hi <= k OR lo <= k")
def size_group_lists(spark, d):
    p = adapters.panel_part(spark, d).withColumn("grp", F.col("size") % 4).withColumn("ok", F.lit(True))
    return universe.group_tail_lists(p, "revenue", "ok", "grp")


@query("prediction_score", f"WITH {PART} SELECT entity, eom, {r(f'2 * {RANK_LINES} / (count(n_lines) OVER (PARTITION BY eom) + 1) - 1', 'score')} FROM p")
def prediction_score(spark, d):
    p = ranging.ranked(adapters.panel_part(spark, d).select("entity", "eom", "n_lines"), "n_lines", "eom", ["entity"])
    return rounded(p.select("entity", "eom", ranging.prediction().alias("score")), "score")


@query("walk_forward_tags", f"WITH {PART}, t AS (SELECT last_day(eom + INTERVAL 1 DAY) AS tm, target FROM p WHERE target IS NOT NULL), y AS (SELECT unnest([1999, 2000, 2001]) AS test_year), x AS (SELECT test_year, CASE WHEN tm < make_date(test_year - 2, 1, 1) THEN 'train' WHEN tm < make_date(test_year, 1, 1) THEN 'val' WHEN tm < make_date(test_year + 1, 1, 1) THEN 'test' END AS part FROM t, y) SELECT test_year, part, count(*) AS n FROM x WHERE part IS NOT NULL GROUP BY 1, 2")
def walk_forward_tags(spark, d):
    from ..operators.learn import tag_windows

    p = adapters.panel_part(spark, d).where("target IS NOT NULL").withColumn("target_month", next_month_end(F.col("eom")))
    tagged = tag_windows(p, [1999, 2000, 2001])
    return tagged.groupBy("test_year", "part").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins
@query("asof_nearest_label", """WITH l AS (SELECT DISTINCT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS eom FROM orders),
rr AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS dt, min(o_orderpriority) AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
j AS (SELECT l.entity, l.eom, rr.label, row_number() OVER (PARTITION BY l.entity, l.eom ORDER BY abs(date_diff('day', rr.dt, l.eom)), rr.dt) AS n FROM l JOIN rr USING (entity))
SELECT l.entity, l.eom, label FROM l LEFT JOIN (SELECT * FROM j WHERE n = 1) j USING (entity, eom)""")
def asof_nearest_label(spark, d):
    left = adapters.panel_cust(spark, d).select("entity", "eom")
    o = adapters.table(spark, d, "orders").where("o_orderstatus = 'F'")
    right = o.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("dt"), F.col("o_orderpriority").alias("p"))
    return joins.asof_nearest(left, right, "entity", "eom", "dt", "p", "label").select("entity", "eom", "label")


CUST = "c AS (SELECT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS eom, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_orders FROM orders GROUP BY 1, 2), ci AS (SELECT *, year(eom) * 12 + month(eom) AS mi FROM c)"


@query("trailing_counts", f"WITH {CUST} SELECT a.entity, a.eom, CAST(sum(b.n_orders) AS BIGINT) AS n12 FROM ci a JOIN ci b ON a.entity = b.entity AND b.mi BETWEEN a.mi - 11 AND a.mi GROUP BY 1, 2")
def trailing_counts(spark, d):
    c = adapters.panel_cust(spark, d)
    facts = c.select("entity", month_index(F.col("eom")).alias("idx"), "n_orders")
    return joins.trailing(c, facts, range(12), {"n12": F.sum("n_orders")})


@query("trailing_surprise", f"WITH {CUST}, h AS (SELECT a.entity, a.eom, avg(b.total) AS past FROM ci a JOIN ci b ON a.entity = b.entity AND b.mi BETWEEN a.mi - 12 AND a.mi - 1 GROUP BY 1, 2) SELECT c.entity, c.eom, {r('c.total - past', 'surprise')} FROM c LEFT JOIN h USING (entity, eom)")
def trailing_surprise(spark, d):
    c = adapters.panel_cust(spark, d)
    facts = c.select("entity", month_index(F.col("eom")).alias("idx"), "total")
    past = joins.trailing(c, facts, range(1, 13), {"past": F.avg("total")})
    return rounded(c.join(past, ["entity", "eom"], "left").select("entity", "eom", (F.col("total") - F.col("past")).alias("surprise")), "surprise")


@query("consecutive_changes", f"WITH {CUST}, v AS (SELECT entity, eom, mi, CASE WHEN lag(mi) OVER (PARTITION BY entity ORDER BY eom) = mi - 1 THEN 1 ELSE 0 END AS ok FROM ci) SELECT entity, eom, CAST(sum(ok) OVER (PARTITION BY entity ORDER BY mi RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_valid FROM v")
def consecutive_changes(spark, d):
    from ..operators.gru import valid_changes

    return valid_changes(adapters.panel_cust(spark, d), 11).select("entity", "eom", "n_valid")


@query("semi_scored_docs", "WITH f AS (SELECT doc_id AS document_id, source AS entity, last_day(DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER)) AS eom FROM documents), k AS (SELECT DISTINCT source AS entity, last_day(DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER)) AS eom FROM documents WHERE lang = 'en') SELECT document_id, entity, eom FROM f WHERE EXISTS (SELECT 1 FROM k WHERE k.entity = f.entity AND k.eom = f.eom)")
def semi_scored_docs(spark, d):
    f = adapters.documents(spark, d)
    keys = f.where("lang = 'en'").select("entity", F.last_day("filing_date").alias("eom"))
    return text.to_score(f, keys, None).select("document_id", "entity", "eom")


@query("anti_uncached_docs", "SELECT doc_id AS document_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_uncached_docs(spark, d):
    f = adapters.documents(spark, d)
    keys = f.select("entity", F.last_day("filing_date").alias("eom"))
    done = adapters.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return text.to_score(f, keys, done).select("document_id")


@query("market_full_join", f"WITH {BOOK} SELECT eom, {r('rate')}, {r('index_ret')} FROM mk0")
def market_full_join(spark, d):
    return rounded(joins.market_full(*adapters.market(spark, d)), "rate", "index_ret")


@query("grid_cross", "SELECT count(*) AS n, CAST(sum(a * 1000 + b) AS DOUBLE) AS check_sum FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5]) AS a), (SELECT unnest([0.0, 10.0, 100.0, 1000.0]) AS b), (SELECT unnest([0.3, 0.4, 0.5]) AS c), (SELECT unnest([0.0, 100.0]) AS e), (SELECT unnest([0.0, 300.0, 1000.0, 3000.0, 10000.0]) AS f)")
def grid_cross(spark, d):
    g = joins.grid(spark, lam_tc=S.lambda_tc, lam_beta=S.lambda_beta, short_q=S.short_size_grid, lam_risk=S.lambda_risk, lam_factor=S.lambda_factor)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lam_tc") * 1000 + F.col("lam_beta")).alias("check_sum"))


@query("union_parts", f"WITH {PART} SELECT year(eom) AS y, count(*) AS n FROM p GROUP BY 1")
def union_parts(spark, d):
    p = adapters.panel_part(spark, d).select(F.year("eom").cast("long").alias("y"))
    return p.where("y <= 1996").unionByName(p.where("y > 1996")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- text
@query("dedup_first_filing", "SELECT document_id, entity FROM (SELECT doc_id AS document_id, source AS entity, row_number() OVER (PARTITION BY source, md5(text) ORDER BY DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER), doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_filing(spark, d):
    return text.dedup_first(adapters.documents(spark, d)).select("document_id", "entity")


@query("event_flags", """WITH f AS (SELECT user_id AS entity, CAST(ts AS DATE) AS eom, event_type AS t FROM events),
m AS (SELECT entity, eom, count(*) AS n_filings, CAST(max(t = 'purchase') AS INTEGER) AS item_purchase, CAST(max(t = 'error') AS INTEGER) AS item_error,
        count(*) FILTER (t = 'error') AS hist_error, count(*) FILTER (t = 'signup') AS hist_signup FROM f GROUP BY 1, 2),
k AS (SELECT u.entity, CAST(dd.day AS DATE) AS eom FROM (SELECT DISTINCT user_id AS entity FROM events) u, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) dd),
h AS (SELECT k.entity, k.eom, CAST(sum(m.hist_error) AS BIGINT) AS he, CAST(sum(m.hist_signup) AS BIGINT) AS hs FROM k JOIN m ON m.entity = k.entity AND m.eom BETWEEN k.eom - 11 AND k.eom GROUP BY 1, 2)
SELECT k.entity, k.eom, CAST(m.n_filings IS NOT NULL AS INTEGER) AS has_filing, m.n_filings, m.item_purchase, m.item_error, coalesce(h.he, 0) AS hist_error, coalesce(h.hs, 0) AS hist_signup
FROM k LEFT JOIN m USING (entity, eom) LEFT JOIN h USING (entity, eom)""")
def event_flags(spark, d):
    f = adapters.filings(spark, d)
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    keys = f.select("entity").distinct().withColumn("eom", days)
    return text.event_flags(f, keys, ["purchase", "error"], ["error", "signup"], period="day")


@query("chunk_tokens", """WITH w AS (SELECT doc_id AS document_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x : x <> '')) AS n FROM documents)
SELECT document_id, CAST(c AS INTEGER) AS chunk, CAST(least(510, least(n, 4080) - c * 510) AS INTEGER) AS n_tokens FROM w, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS c) WHERE c * 510 < least(n, 4080)""")
def chunk_tokens(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    parts = adapters.documents(spark, d).select("document_id", F.posexplode(text.chunks(words, S.chunk_tokens, S.max_chunks)).alias("chunk", "part"))
    return parts.select("document_id", "chunk", F.size("part").alias("n_tokens"))


@query("anonymise_constant", r"SELECT doc_id AS document_id, md5(regexp_replace(regexp_replace(text, '\b(?:that|the)\b', ' ', 'gi'), '\bOn\b', ' ', 'g')) AS clean_md5 FROM documents")
def anonymise_constant(spark, d):
    docs = adapters.documents(spark, d)
    clean = text.anonymise_constant(F.col("text"), ["the", "that"], ["On"])
    return docs.select("document_id", F.md5(clean.cast("binary")).alias("clean_md5"))


@query("anonymise_terms")
def anonymise_terms(spark, d):
    docs = adapters.documents(spark, d)
    first = F.slice(F.split("text", r"\s+"), 1, 2)
    return docs.select("document_id", F.md5(text.anonymise(F.col("text"), first, F.array(F.lit("On"))).cast("binary")).alias("clean_md5"))


TONE = f"""
w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x : x <> '') AS ws FROM documents),
ch AS (SELECT doc_id, source, list_slice(ws, c * 510 + 1, least(c * 510 + 510, 4080)) AS part FROM w, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS c) WHERE c * 510 < least(len(ws), 4080)),
sc AS (SELECT doc_id, (len(list_filter(part, lambda x : lower(x) IN {text.GOOD})) - len(list_filter(part, lambda x : lower(x) IN {text.BAD}))) * 1.0 / len(part) AS s FROM ch),
tone AS (SELECT doc_id AS document_id, avg(s) AS tone_mean, min(s) AS tone_min FROM sc GROUP BY 1)"""


#: The same over whole texts.
TONE_WHOLE = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x : x <> '') AS ws FROM documents),
ch AS (SELECT doc_id, list_slice(ws, c * 510 + 1, c * 510 + 510) AS part FROM (SELECT doc_id, ws, unnest(range((len(ws) + 509) // 510)) AS c FROM w)),
sc AS (SELECT doc_id, (len(list_filter(part, lambda x : lower(x) IN {text.GOOD})) - len(list_filter(part, lambda x : lower(x) IN {text.BAD}))) * 1.0 / len(part) AS s FROM ch),
tone AS (SELECT doc_id AS document_id, avg(s) AS tone_mean, min(s) AS tone_min FROM sc GROUP BY 1)"""


@query("doc_tones", f"WITH {TONE} SELECT d.doc_id AS document_id, {r('tone_mean')}, {r('tone_min')} FROM documents d LEFT JOIN tone ON tone.document_id = d.doc_id")
def doc_tones(spark, d):
    return rounded(text.doc_tones(adapters.documents(spark, d)), "tone_mean", "tone_min")


@query("tone_features", f"""WITH {TONE_WHOLE},
f AS (SELECT doc_id, source AS entity, last_day(DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER)) AS eom FROM documents),
m AS (SELECT entity, eom, year(eom) * 12 + month(eom) AS mi, avg(tone_mean) AS tone_mean, min(tone_min) AS tone_min FROM f JOIN tone ON tone.document_id = f.doc_id WHERE tone_mean IS NOT NULL GROUP BY 1, 2),
k AS (SELECT DISTINCT entity, eom, year(eom) * 12 + month(eom) AS mi FROM f),
h AS (SELECT k.entity, k.eom, avg(m.tone_mean) AS past FROM k JOIN m ON m.entity = k.entity AND m.mi BETWEEN k.mi - 12 AND k.mi - 1 GROUP BY 1, 2)
SELECT k.entity, k.eom, {r('m.tone_mean', 'tone_mean')}, {r('m.tone_min', 'tone_min')}, {r('m.tone_mean - past', 'tone_surprise')} FROM k LEFT JOIN m USING (entity, eom) LEFT JOIN h USING (entity, eom)""")
def tone_features(spark, d):
    f = adapters.documents(spark, d)
    keys = f.select("entity", F.last_day("filing_date").alias("eom")).distinct()
    return rounded(text.tone_features(f, text.doc_tones(f, most=None), keys), "tone_mean", "tone_min", "tone_surprise")


@query("quote_verify", r"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
q AS (SELECT doc_id AS fact_id, doc_id AS document_id, substring(t, 11, 30) AS quote FROM n
      UNION ALL SELECT doc_id + 1000000, doc_id, 'no such words' FROM n
      UNION ALL SELECT item_id + 2000000, NULL, substring(text, 1, 60) FROM benchmark),
qq AS (SELECT *, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS k FROM q)
SELECT fact_id FROM qq WHERE k <> '' AND ((document_id IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.doc_id = qq.document_id AND contains(n.t, qq.k)))
  OR (document_id IS NULL AND EXISTS (SELECT 1 FROM n WHERE contains(n.t, qq.k))))""")
def quote_verify(spark, d):
    f = adapters.documents(spark, d)
    body = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    one = f.select(F.col("document_id").alias("fact_id"), "document_id", F.substring(body, 11, 30).alias("quote"))
    two = f.select((F.col("document_id") + 1000000).alias("fact_id"), "document_id", F.lit("no such words").alias("quote"))
    loose = adapters.table(spark, d, "benchmark").select((F.col("item_id") + 2000000).alias("fact_id"), F.lit(None).cast("long").alias("document_id"), F.substring("text", 1, 60).alias("quote"))
    return text.verify_quotes(one.unionByName(two).unionByName(loose), f).select("fact_id")


@query("latest_filings", "SELECT doc_id AS document_id, DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER) AS filing_date FROM documents WHERE source = 'src1' AND DATE '2020-01-01' + CAST(doc_id % 720 AS INTEGER) <= DATE '2021-06-30' ORDER BY filing_date DESC, doc_id DESC LIMIT 5")
def latest_filings(spark, d):
    return text.latest_filings(adapters.documents(spark, d), "src1", "2021-06-30", 5).select("document_id", "filing_date")


# ---------------------------------------------------------------- metrics
RETURN_COLUMNS = ("total", "excess", "active", "long_leg", "short_leg", "benchmark", "index_ret", "gross", "net", "turnover", "rf")


@query("book_returns", f"WITH {BOOK} SELECT eom, date, {', '.join(r(c) for c in RETURN_COLUMNS)}, n_long, n_short, n_missing FROM br")
def book_returns(spark, d):
    return rounded(returns(spark, d), *RETURN_COLUMNS)


@query("net_of_fee", f"WITH {BOOK} SELECT eom, {r('total - 0.001 * turnover', 'total')}, {r('active - 0.001 * turnover', 'active')} FROM br")
def net_of_fee(spark, d):
    return rounded(metrics.net_of_fee(returns(spark, d)).select("eom", "total", "active"), "total", "active")


@query("turnover_union", f"WITH {BOOK} SELECT eom, {r('turnover')} FROM tn")
def turnover_union(spark, d):
    return rounded(metrics.turnover(book(spark, d)[0]), "turnover")


ROLL = "WINDOW w AS (ORDER BY eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query("rolling_ir", f"WITH {BOOK} SELECT eom, {r('CASE WHEN count(*) OVER w = 12 THEN avg(active) OVER w * 12 END', 'rolling_active')}, {r('CASE WHEN count(*) OVER w = 12 THEN sqrt(12) * avg(active) OVER w / nullif(stddev_samp(active) OVER w, 0) END', 'rolling_ir')} FROM br {ROLL}")
def rolling_ir(spark, d):
    return rounded(metrics.rolling(returns(spark, d)).select("eom", "rolling_active", "rolling_ir"), "rolling_active", "rolling_ir")


@query("rolling_beta", f"WITH {BOOK}, x AS (SELECT *, index_ret - rf AS xr FROM br WHERE index_ret IS NOT NULL AND rf IS NOT NULL) SELECT eom, {r('CASE WHEN count(*) OVER w = 12 THEN covar_samp(excess, xr) OVER w / nullif(var_samp(xr) OVER w, 0) END', 'rolling_beta')} FROM x {ROLL}")
def rolling_beta(spark, d):
    b = returns(spark, d).where("index_ret IS NOT NULL AND rf IS NOT NULL")
    return rounded(metrics.rolling(b).select("eom", "rolling_beta"), "rolling_beta")


@query("drawdown", f"WITH {BOOK}, x AS (SELECT eom, exp(sum(ln(1 + benchmark)) OVER (ORDER BY eom)) AS wb, exp(sum(ln(1 + index_ret)) OVER (ORDER BY eom)) AS wealth FROM br WHERE index_ret IS NOT NULL) SELECT eom, {r('wealth')}, {r('wealth / greatest(1.0, max(wealth) OVER (ORDER BY eom)) - 1', 'drawdown')} FROM x")
def drawdown(spark, d):
    b = returns(spark, d).where("index_ret IS NOT NULL")
    return rounded(metrics.with_drawdown(b, "index_ret").select("eom", "wealth", "drawdown"), "wealth", "drawdown")


@query("calendar_years", f"WITH {BOOK} SELECT CAST(year(date) AS INTEGER) AS year, {r('product(1 + benchmark) - 1', 'benchmark')}, {r('product(1 + index_ret) - 1', 'index_ret')} FROM br WHERE index_ret IS NOT NULL GROUP BY 1")
def calendar_years(spark, d):
    b = returns(spark, d).where("index_ret IS NOT NULL")
    return rounded(metrics.calendar_years(b, ["benchmark", "index_ret"]), "benchmark", "index_ret")


@query("leg_statistics", f"WITH {BOOK} SELECT {r('avg(index_ret)', 'mean_monthly')}, {r('avg(index_ret) * 12', 'ann_arith')}, {r('product(1 + index_ret) - 1', 'cumulative')}, {r('pow(product(1 + index_ret), 12.0 / count(*)) - 1', 'cagr')} FROM br WHERE index_ret IS NOT NULL")
def leg_statistics(spark, d):
    b = returns(spark, d).where("index_ret IS NOT NULL")
    names = ("mean_monthly", "ann_arith", "cagr", "cumulative")
    return rounded(b.agg(*[v.alias(k) for k, v in metrics.leg("index_ret").items()]), *names)


@query("ratio_statistics", f"WITH {BOOK} SELECT {r('sqrt(12) * avg(active) / stddev_samp(active)', 'ir')}, {r('avg(CASE WHEN excess > 0 AND active > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')}, {r('max(excess)', 'best')}, {r('min(excess)', 'worst')}, count(*) AS n FROM br")
def ratio_statistics(spark, d):
    b = returns(spark, d)
    out = b.agg(metrics.information_ratio("active").alias("ir"), F.avg(((F.col("excess") > 0) & (F.col("active") > 0)).cast("double")).alias("hit_rate"), F.max("excess").alias("best"), F.min("excess").alias("worst"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "ir", "hit_rate", "best", "worst")


HAC = f"""{BOOK}, o AS (SELECT eom, excess AS y, index_ret - rf AS x FROM br WHERE index_ret IS NOT NULL AND rf IS NOT NULL),
ft AS (SELECT regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM o),
e AS (SELECT o.*, y - alpha - beta * x AS u, row_number() OVER (ORDER BY eom) AS i FROM o, ft),
pr AS (SELECT a.i - b.i AS l, a.u * b.u AS g00, a.u * b.u * (a.x + b.x) / 2 AS g01, a.u * a.x * b.u * b.x AS g11 FROM e a JOIN e b ON a.i - b.i BETWEEN 0 AND 3),
mt AS (SELECT sum(g00 * CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 4.0) END) AS s00, sum(g01 * CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 4.0) END) AS s01, sum(g11 * CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / 4.0) END) AS s11 FROM pr),
iv AS (SELECT ft.*, mt.*, sxx / (n * sxx - sx * sx) AS a, -sx / (n * sxx - sx * sx) AS b, n / (n * sxx - sx * sx) AS c FROM ft, mt)"""


@query("ols_alpha_beta", f"WITH {HAC} SELECT {r('alpha')}, {r('beta')}, n AS n_months FROM ft")
def ols_alpha_beta(spark, d):
    b = returns(spark, d).withColumn("x", F.col("index_ret") - F.col("rf"))
    return rounded(metrics.ols_hac(b, "excess", "x", "eom").select("alpha", "beta", "n_months"), "alpha", "beta")


@query("newey_west_t", f"WITH {HAC} SELECT {r('alpha / sqrt(a * a * s00 + 2 * a * b * s01 + b * b * s11)', 'alpha_t')}, {r('beta / sqrt(b * b * s00 + 2 * b * c * s01 + c * c * s11)', 'beta_t')} FROM iv")
def newey_west_t(spark, d):
    b = returns(spark, d).withColumn("x", F.col("index_ret") - F.col("rf"))
    return rounded(metrics.ols_hac(b, "excess", "x", "eom").select("alpha_t", "beta_t"), "alpha_t", "beta_t")


RET_HAT = f"{PART}, k AS (SELECT entity, eom, target, CASE WHEN count(revenue) OVER (PARTITION BY eom) > 1 THEN ({avg_rank_sql('revenue', 'eom')} - 1) / (count(revenue) OVER (PARTITION BY eom) - 1) * 2 - 1 ELSE 0.0 END AS sr FROM p), ft AS (SELECT regr_slope(target, sr) AS b, regr_intercept(target, sr) AS a FROM k WHERE target IS NOT NULL AND year(eom) IN (1998, 1999))"


@query("ret_hat_fit", f"WITH {RET_HAT} SELECT entity, eom, {r('a + b * sr', 'ret_hat')} FROM k, ft")
def ret_hat_fit(spark, d):
    from ..operators.learn import ret_hat

    p = adapters.panel_part(spark, d)
    return rounded(ret_hat(p, "revenue", "target", F.year("eom").isin(1998, 1999)).select("entity", "eom", "ret_hat"), "ret_hat")


@query("oos_r2", f"WITH {RET_HAT} SELECT {r('1 - sum((target - a - b * sr) * (target - a - b * sr)) / sum(target * target)', 'oos_r2')}, count(*) AS n FROM k, ft WHERE target IS NOT NULL AND year(eom) > 1999")
def oos_r2(spark, d):
    from ..operators.learn import ret_hat

    p = ret_hat(adapters.panel_part(spark, d), "revenue", "target", F.year("eom").isin(1998, 1999))
    return rounded(metrics.oos_r2(p.where(F.year("eom") > 1999), "target", "ret_hat"), "oos_r2")


@query("contributors", f"WITH {BOOK} SELECT entity, {r('sum(weight * rr)', 'contribution')}, max(eom) AS last_eom FROM wt GROUP BY entity")
def contributors(spark, d):
    from ..operators.report import contributions

    weights, panel, _ = book(spark, d)
    return rounded(contributions(weights, panel), "contribution")


@query("composition", f"""WITH {BOOK}, a AS (SELECT eom, abs(weight) AS a, row_number() OVER (PARTITION BY eom ORDER BY abs(weight) DESC, entity) AS n FROM weights),
t AS (SELECT eom, sum(CASE WHEN n <= 10 THEN a END) / sum(a) AS share, max(a) AS top FROM a GROUP BY eom),
s AS (SELECT w.eom, -w.weight AS a, p.revenue, CASE WHEN p.size <= 10 THEN -w.weight ELSE 0.0 END AS small FROM weights w JOIN p USING (entity, eom) WHERE w.weight < 0),
sm AS (SELECT eom, sum(a * revenue) / sum(a) AS wavg, sum(small) / sum(a) AS small FROM s GROUP BY eom)
SELECT {r('(SELECT max(top) FROM t)', 'largest_weight')}, {r('(SELECT avg(share) FROM t)', 'top10_share')}, {r('(SELECT avg(wavg) FROM sm)', 'short_avg_size')}, {r('(SELECT median(revenue) FROM s)', 'short_median_size')}, {r('(SELECT avg(small) FROM sm)', 'short_small_share')}""")
def composition(spark, d):
    from ..operators.report import composition as made

    weights, panel, _ = book(spark, d)
    names = ("largest_weight", "top10_share", "short_avg_size", "short_median_size", "short_small_share")
    return rounded(made(weights, panel.withColumn("small", F.col("size") <= 10), "revenue", "small").select(*names), *names)


@query("top_holdings", f"WITH {BOOK}, a AS (SELECT entity, CASE WHEN avg(weight) > 0 THEN 'long' ELSE 'short' END AS side, avg(weight) AS w, count(*) AS n, arg_max(eom, struct_pack(a := abs(weight), b := -epoch(eom))) AS peak FROM weights GROUP BY entity), k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(abs(w), 9) DESC, entity) AS rn FROM a) SELECT side, entity, {r('w', 'avg_weight')}, n FROM k WHERE rn <= 10")
def top_holdings(spark, d):
    from ..operators.report import top_holdings as made

    return rounded(made(book(spark, d)[0], 10).select("side", "entity", "avg_weight", "n"), "avg_weight")


# ---------------------------------------------------------------- leakage
@query("corr_leak_scan", f"WITH {PART} SELECT 'revenue' AS feature, {r('corr(revenue, target)', 'correlation')} FROM p UNION ALL SELECT 'qty', {r('corr(qty, target)', 'correlation')} FROM p UNION ALL SELECT 'disc', {r('corr(disc, target)', 'correlation')} FROM p")
def corr_leak_scan(spark, d):
    from ..operators.leakage import target_correlations

    return rounded(target_correlations(adapters.panel_part(spark, d), ["revenue", "qty", "disc"], "target").select("feature", "correlation"), "correlation")


@query("dup_keys", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def dup_keys(spark, d):
    from ..operators.leakage import duplicate_keys

    return duplicate_keys(adapters.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("filing_leaks", """WITH f AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS dt, last_day(CAST(o_orderdate AS DATE)) AS eom FROM orders),
m AS (SELECT entity, eom, max(dt) AS last_dt FROM f GROUP BY 1, 2),
k AS (SELECT DISTINCT entity, eom FROM f)
SELECT count(*) AS n_keys, count(*) FILTER (last_dt > k.eom) AS after_formation, count(*) FILTER (last_dt IS NULL) AS flag_without_filing FROM k LEFT JOIN m USING (entity, eom)""")
def filing_leaks(spark, d):
    from ..operators.leakage import filing_leaks as made

    o = adapters.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filing_date"))
    keys = o.select("entity", F.last_day("filing_date").alias("eom")).distinct().withColumn("has_filing", F.lit(1))
    return made(o, keys)
