"""Book returns and their statistics, information coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import holding_date
from ..functions.ranks import average_rank, clean, correlation
from .joins import market_to_formation


def rank_ic(df: DataFrame, score: str, target: str, by: str = "eom") -> DataFrame:
    """(by, ic, n): correlation of average ranks within each period, over rows with both."""
    d = df.select(by, clean(score).alias("s"), clean(target).alias("y")).where("s IS NOT NULL AND y IS NOT NULL")
    d = d.select(by, average_rank("s", by).alias("rs"), average_rank("y", by).alias("ry"))
    return d.groupBy(by).agg(correlation(F.col("rs"), F.col("ry")).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """mean_ic, icir = mean / sd * sqrt(12), n_months over the periods that have an IC."""
    d = ics.where("ic IS NOT NULL AND NOT isnan(ic)")
    sd = F.stddev_samp("ic")
    return d.agg(F.avg("ic").alias("mean_ic"), F.when(sd > 0, F.avg("ic") / sd * math.sqrt(12)).alias("icir"), F.count(F.lit(1)).alias("n_months"))


def turnover(weights: DataFrame, entity: str = "entity", by: str = "eom") -> DataFrame:
    """(by, turnover): sum over the union of names of |w - w before|; the first book is bought from cash. "Before" is the book's previous period.

    Each weight is posted at its period and, negated, at the book's next one, then summed by name: no pivot, no self join.
    """
    months = weights.select(by).distinct().withColumn("next", F.lead(by).over(Window.orderBy(by)))  # a row a period
    later = weights.join(F.broadcast(months), by).where("next IS NOT NULL").select(entity, F.col("next").alias(by), (-F.col("weight")).alias("weight"))
    moved = weights.select(entity, by, "weight").unionByName(later).groupBy(entity, by).agg(F.sum("weight").alias("d"))
    return moved.groupBy(by).agg(F.sum(F.abs("d")).alias("turnover"))


def book_returns(weights: DataFrame, panel: DataFrame, market: DataFrame, premium: float = 0.04, entity: str = "entity", by: str = "eom", target: str = "target", rate: str = "rate", index: str = "index_ret") -> DataFrame:
    """A row a formation month: legs, excess, total, benchmark, active, exposures, counts, turnover, n_missing. market is keyed on its own month; rate is annual percent."""
    w = weights.select(entity, by, "weight").join(panel.select(entity, by, target), [entity, by], "left")
    r = F.coalesce(clean(target), F.lit(0.0))
    c, long_, short_ = F.col("weight") * r, F.col("weight") > 0, F.col("weight") < 0
    part = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    g = w.groupBy(by).agg(
        part(long_, c).alias("long_leg"), part(short_, c).alias("short_leg"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"),
        F.count_if(long_).alias("n_long"), F.count_if(short_).alias("n_short"), F.count_if(clean(target).isNull()).alias("n_missing"),
    )
    mk = market_to_formation(market, by).select(by, (F.col(rate) / 1200).alias("rf"), F.col(index).alias("index_ret"))
    out = g.join(turnover(weights, entity, by), by).join(mk, by, "left")
    excess = F.col("long_leg") + F.col("short_leg")
    return out.select(
        by, holding_date(F.col(by)).alias("date"), (F.col("rf") + excess).alias("total"), excess.alias("excess"), (excess - premium / 12).alias("active"),
        "long_leg", "short_leg", (F.col("rf") + premium / 12).alias("benchmark"), "index_ret", "gross", "net", "n_long", "n_short", "turnover", "rf", "n_missing",
    )


def net_of_fee(returns: DataFrame, fee: float = 0.001) -> DataFrame:
    return returns.withColumns({c: F.col(c) - fee * F.col("turnover") for c in ("total", "active", "excess")})


def information_ratio(c: str) -> Column:
    sd = F.stddev_samp(c)
    return F.when(sd > 0, math.sqrt(12) * F.avg(c) / sd)


def leg(c: str) -> dict[str, Column]:
    """Arithmetic and compound statistics of a monthly series."""
    cum = F.product(1 + F.col(c)) - 1
    return {"mean_monthly": F.avg(c), "ann_arith": F.avg(c) * 12, "cagr": F.pow(1 + cum, F.lit(12.0) / F.count(c)) - 1, "cumulative": cum}


def with_drawdown(returns: DataFrame, c: str, order: str = "eom", by: str | None = None, start: bool = True) -> DataFrame:
    """wealth and drawdown below the running peak; with ``start`` the peak begins at 1."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("wealth", F.product(1 + F.col(c)).over(w))
    peak = F.max("wealth").over(w)
    return out.withColumn("drawdown", F.col("wealth") / (F.greatest(F.lit(1.0), peak) if start else peak) - 1)


def rolling(returns: DataFrame, order: str = "eom", n: int = 12, by: str | None = None) -> DataFrame:
    """12-month active return (annual), information ratio and beta on the index, null until n rows are there."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(w) == n
    x = F.col("index_ret") - F.col("rf")
    ir = math.sqrt(12) * F.avg("active").over(w) / F.nullif(F.stddev_samp("active").over(w), F.lit(0.0))
    beta = F.try_divide(F.covar_samp("excess", x).over(w), F.nullif(F.var_samp(x).over(w), F.lit(0.0)))
    return returns.withColumns({"rolling_active": F.when(full, F.avg("active").over(w) * 12), "rolling_ir": F.when(full, ir), "rolling_beta": F.when(full, beta)})


def calendar_years(returns: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    return returns.groupBy(F.year(date).alias("year")).agg(*[(F.product(1 + F.col(c)) - 1).alias(c) for c in columns])


def ols_hac(df: DataFrame, y: str, x: str, order: str, lags: int = 3) -> DataFrame:
    """alpha, beta and their Newey-West t (Bartlett weights, no small-sample factor) of y on a constant and x; needs 5 rows.

    The series is one row a period, so its windows over a single order hold months, not data.
    """
    d = df.select(order, clean(y).cast("double").alias("y"), clean(x).cast("double").alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    fit = d.agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    u = d.crossJoin(fit).withColumn("u", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    # meat: S = sum over lags of weights times cross products of (u, u x)
    terms = {"s00": F.lit(0.0), "s01": F.lit(0.0), "s11": F.lit(0.0)}
    ux = F.col("u") * F.col("x")
    terms = {"s00": F.col("u") * F.col("u"), "s01": F.col("u") * ux, "s11": ux * ux}
    for k in range(1, lags + 1):
        weight = 2.0 * (1 - k / (lags + 1))
        lu, lx = F.coalesce(F.lag("u", k).over(w), F.lit(0.0)), F.coalesce(F.lag("x", k).over(w), F.lit(0.0))
        terms["s00"] += weight * F.col("u") * lu
        terms["s01"] += weight / 2 * F.col("u") * lu * (F.col("x") + lx)
        terms["s11"] += weight * ux * lu * lx
    s = u.select("alpha", "beta", "n", "sx", "sxx", *[v.alias(k) for k, v in terms.items()])
    s = s.groupBy("alpha", "beta", "n", "sx", "sxx").agg(F.sum("s00").alias("s00"), F.sum("s01").alias("s01"), F.sum("s11").alias("s11"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    a, b, c = F.col("sxx") / det, -F.col("sx") / det, F.col("n") / det  # inverse of X'X: [[a, b], [b, c]]
    va = a * a * F.col("s00") + 2 * a * b * F.col("s01") + b * b * F.col("s11")
    vb = b * b * F.col("s00") + 2 * b * c * F.col("s01") + c * c * F.col("s11")
    ok = F.col("n") >= 5
    return s.select("alpha", "beta", F.when(ok & (va > 0), F.col("alpha") / F.sqrt(va)).alias("alpha_t"), F.when(ok & (vb > 0), F.col("beta") / F.sqrt(vb)).alias("beta_t"), F.col("n").alias("n_months"))


def oos_r2(df: DataFrame, target: str, forecast: str) -> DataFrame:
    """1 - sum (r - f)^2 / sum r^2 over rows with both."""
    r, f = clean(target), clean(forecast)
    return df.where(r.isNotNull() & f.isNotNull()).agg((1 - F.sum((r - f) * (r - f)) / F.sum(r * r)).alias("oos_r2"), F.count(F.lit(1)).alias("n"))


def summary(returns: DataFrame, premium: float = 0.04, lags: int = 3, order: str = "eom") -> dict:
    """Headline statistics of a monthly book, as a dict; a handful of small aggregates."""
    tot = F.col("total") - F.col("rf")
    sd = F.stddev_samp(tot)
    block = {f"{c}_{n}": f(c) for c in ("gross", "net", "turnover", "n_long", "n_short") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))}
    legs = {f"{c}_{k}": v for c in ("total", "benchmark", "index_ret", "long_leg", "short_leg") for k, v in leg(c).items()}
    aggs = {
        "n_months": F.count(F.lit(1)), "ir": information_ratio("active"), "sharpe": F.when(sd > 0, math.sqrt(12) * F.avg(tot) / sd),
        "best_month": F.max("total"), "worst_month": F.min("total"), "hit_rate": F.avg(((F.col("excess") > 0) & (F.col("active") > 0)).cast("double")),
        "corr_index": correlation(F.col("total"), F.col("index_ret")),
    } | block | legs
    out = returns.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict()
    for name, c in (("max_drawdown", "total"), ("index_max_drawdown", "index_ret")):
        out[name] = with_drawdown(returns.where(F.col(c).isNotNull()), c, order).agg(F.min("drawdown").alias("d")).first()["d"]
    fit = ols_hac(returns.withColumn("_x", F.col("index_ret") - F.col("rf")), "excess", "_x", order, lags).collect()
    if fit:
        out |= {k: v for k, v in fit[0].asDict().items() if k != "n_months"} | {"alpha_annual": fit[0]["alpha"] * 12 if fit[0]["alpha"] is not None else None}
    out["calendar_years"] = {r["year"]: r.asDict() for r in calendar_years(returns, ["total", "benchmark", "index_ret"]).collect()}
    return out
