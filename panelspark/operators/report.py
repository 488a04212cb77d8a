"""Report frames: contributions, composition, holdings, chart data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import holding_date
from ..functions.ranks import clean
from .joins import fill_labels
from .metrics import rolling, with_drawdown


def contributions(weights: DataFrame, panel: DataFrame, entity: str = "entity", by: str = "eom", target: str = "target") -> DataFrame:
    """(entity, contribution, last_eom): sum of weight times return; a missing return is none."""
    w = weights.select(entity, by, "weight").join(panel.select(entity, by, target), [entity, by], "left")
    return w.groupBy(entity).agg(F.sum(F.col("weight") * F.coalesce(clean(target), F.lit(0.0))).alias("contribution"), F.max(by).alias("last_eom"))


def label(ticker: str = "ticker", name: str = "company_name") -> Column:
    return F.concat(F.coalesce(ticker, F.lit("?")), F.lit(", "), F.initcap(F.coalesce(name, F.lit("?"))))


def labelled_contributions(weights: DataFrame, panel: DataFrame, filings: DataFrame, entity: str = "entity", by: str = "eom") -> DataFrame:
    """Contributions with the label of the last holding month, filled from the filing nearest to it; best first."""
    c = contributions(weights, panel, entity, by).withColumnRenamed("last_eom", by)
    c = c.join(panel.select(entity, by, "ticker", "company_name"), [entity, by], "left")
    c = fill_labels(c, filings, ["ticker", "company_name"], entity, by, "filing_date")
    return c.select(entity, label().alias("label"), "contribution").orderBy(F.desc("contribution"), entity)


def composition(weights: DataFrame, panel: DataFrame, size: str, small: str, entity: str = "entity", by: str = "eom", top: int = 10) -> DataFrame:
    """One row: largest weight, mean share of the top ten in gross, and the short side's size and small share (means over months)."""
    a = weights.withColumn("a", F.abs("weight"))
    a = a.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("a"), entity)))
    t = a.groupBy(by).agg((F.sum(F.when(F.col("n") <= top, F.col("a"))) / F.sum("a")).alias("share"), F.max("a").alias("top"))
    t = t.agg(F.max("top").alias("largest_weight"), F.avg("share").alias("top10_share"))
    s = weights.where("weight < 0").join(panel.select(entity, by, F.col(size).alias("_size"), F.col(small).alias("_small")), [entity, by], "left").withColumn("a", -F.col("weight"))
    m = s.groupBy(by).agg(
        (F.sum(F.col("a") * F.coalesce("_size", F.lit(0.0))) / F.sum("a")).alias("w"), (F.sum(F.when(F.col("_small"), F.col("a")).otherwise(0.0)) / F.sum("a")).alias("small")
    )
    means = m.agg(F.avg("w").alias("short_avg_size"), F.avg("small").alias("short_small_share"))
    return t.crossJoin(means).crossJoin(s.agg(F.median("_size").alias("short_median_size")))  # three one-row frames


def top_holdings(weights: DataFrame, n: int, entity: str = "entity", by: str = "eom") -> DataFrame:
    """The n names a side with the largest mean weight, and the month of their peak (the first of equals)."""
    g = weights.groupBy(entity).agg(F.avg("weight").alias("avg_weight"), F.count(F.lit(1)).alias("n"), F.max_by(by, F.struct(F.abs("weight").alias("a"), (-F.unix_date(by)).alias("b"))).alias("peak"))
    g = g.withColumn("side", F.when(F.col("avg_weight") > 0, "long").otherwise("short"))
    w = Window.partitionBy("side").orderBy(F.round(F.abs("avg_weight"), 9).desc(), entity)
    return g.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def holdings(weights: DataFrame, panel: DataFrame, filings: DataFrame | None, entity: str = "entity", by: str = "eom") -> DataFrame:
    """Submission rows: Date, PERMNO, TICKER, COMPANY NAME, WEIGHT in percent."""
    h = weights.select(entity, by, "weight").join(panel.select(entity, by, "ticker", "company_name"), [entity, by], "left")
    if filings is not None:
        h = fill_labels(h, filings, ["ticker", "company_name"], entity, by, "filing_date")
    return h.orderBy(by, entity).select(
        F.date_format(holding_date(F.col(by)), "yyyy-MM-dd").alias("Date"), F.col(entity).alias("PERMNO"), F.coalesce("ticker", F.lit("")).alias("TICKER"),
        F.coalesce("company_name", F.lit("")).alias("COMPANY NAME"), F.round(F.col("weight") * 100, 6).alias("WEIGHT"),
    )


def chart_data(returns: DataFrame, by: str = "eom") -> DataFrame:
    """What the charts draw, a row a month: cumulative returns, drawdowns (peak from the data, as charts show it), rolling figures."""
    out = rolling(returns, by)
    for c in ("total", "index_ret", "benchmark"):
        d = with_drawdown(returns.where(F.col(c).isNotNull()).select(by, c), c, by, start=False)
        out = out.join(d.select(by, (F.col("wealth") - 1).alias(f"cumulative_{c}"), F.col("drawdown").alias(f"drawdown_{c}")), by, "left")
    return out


def return_histogram(returns: DataFrame, bins: int = 30, columns: tuple[str, ...] = ("total", "benchmark")) -> DataFrame:
    """(series, bin, low, high, n): counts of monthly returns in equal bins from the least to the greatest of all the series; the last bin is closed."""
    long = returns.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), clean(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*").where("x IS NOT NULL")
    ends = long.agg(F.min("x").alias("least"), F.max("x").alias("most"))
    width = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) / bins).otherwise(F.lit(1.0))
    d = long.crossJoin(F.broadcast(ends)).withColumn("width", width)  # one row
    d = d.withColumn("bin", F.least(F.floor((F.col("x") - F.col("least")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    out = d.groupBy("series", "bin", "least", "width").agg(F.count(F.lit(1)).alias("n"))
    return out.select("series", "bin", (F.col("least") + F.col("bin") * F.col("width")).alias("low"), (F.col("least") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def extreme_contributors(contributions_: DataFrame, n: int = 10) -> DataFrame:
    """The n largest and the n smallest contributions, a name once; ties by the other columns."""
    order = [c for c in contributions_.columns if c != "contribution"]
    high = F.row_number().over(Window.orderBy(F.desc("contribution"), *order))
    low = F.row_number().over(Window.orderBy("contribution", *order))
    top = contributions_.orderBy(F.desc("contribution"), *order).limit(n).withColumn("place", high).withColumn("end", F.lit("top"))
    bottom = contributions_.orderBy("contribution", *order).limit(n).withColumn("place", low).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom.join(top.select(*order), order, "left_anti"))


def charts(returns: DataFrame, by: str = "eom") -> dict[str, DataFrame]:
    """The data of every chart drawn from monthly returns, by the chart's name; contributors come from extreme_contributors()."""
    d = chart_data(returns, by)
    lines = {
        "cumulative_returns": ["cumulative_total", "cumulative_index_ret", "cumulative_benchmark"], "underwater": ["drawdown_total", "drawdown_index_ret"],
        "rolling_active_return": ["rolling_active"], "rolling_ir": ["rolling_ir"], "rolling_beta": ["rolling_beta"],
    }
    return {name: d.select(by, *columns) for name, columns in lines.items()} | {"return_histogram": return_histogram(returns)}
