"""Ranks, quantiles and z-scores within a period. NaN is null throughout; nulls are never ranked.

A window partition is one cross-section, so its size is the number of entities, not of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """NaN to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c)


def _by(by) -> list:
    return [by] if isinstance(by, (str, Column)) else list(by)


def average_rank(c: Column | str, by) -> Column:
    """1-based rank, ties averaged."""
    c = clean(c)
    first = F.rank().over(Window.partitionBy(*_by(by)).orderBy(c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*_by(by), c))
    return F.when(c.isNotNull(), first + (ties - 1) / 2.0)


def pct_rank(c: Column | str, by) -> Column:
    return average_rank(c, by) / F.count(clean(c)).over(Window.partitionBy(*_by(by)))


def quantile_over(c: Column | str, q: float, by, interpolation: str = "nearest") -> Column:
    """Quantile within the group, on every row. nearest: the value at round(q * (n - 1)), halves up; linear: interpolated."""
    c, w = clean(c).cast("double"), Window.partitionBy(*_by(by))
    if interpolation == "linear":
        return F.percentile(c, F.lit(q)).over(w)
    if interpolation != "nearest":
        raise ValueError(f"interpolation: {interpolation}")
    place = F.row_number().over(w.orderBy(c.asc_nulls_last()))
    at = F.round((F.count(c).over(w) - 1) * F.lit(float(q))) + 1
    # two windows: the place first, then the value standing there
    return F.struct(c.alias("v"), (place == at).alias("hit"))


def with_quantile(df: DataFrame, name: str, c: str, q: float, by, interpolation: str = "nearest") -> DataFrame:
    if interpolation == "linear":
        return df.withColumn(name, quantile_over(c, q, by, interpolation))
    marked = df.withColumn("_q", quantile_over(c, q, by))
    return marked.withColumn(name, F.max(F.when(F.col("_q.hit"), F.col("_q.v"))).over(Window.partitionBy(*_by(by)))).drop("_q")


def with_dense_scaled(df: DataFrame, columns: list[str], by: str = "eom", keys: list[str] | None = None) -> DataFrame:
    """Replace each column by its dense rank in the period scaled to [-1, 1]; one value only, or null: 0.

    With ``keys`` that identify a row, rows are ranked in long form, dealt by range of (period, column, value), and pivoted back: no period has to fit a task (see ranging). Without keys
    each column gets a window.
    """

    def scaled(c: Column, w: list) -> tuple[Column, Column]:
        rank = F.when(c.isNotNull(), F.dense_rank().over(Window.partitionBy(*w).orderBy(c.asc_nulls_last())) - 1)
        return rank, Window.partitionBy(*w)

    def final(rank: str, most: Column) -> Column:
        return F.coalesce(F.when(most > 0, F.col(rank) / most * 2 - 1).otherwise(F.lit(0.0)), F.lit(0.0))

    if not keys:
        out = df
        for c in columns:
            out = out.withColumn(f"_r_{c}", scaled(clean(c), [by])[0])
        for c in columns:
            out = out.withColumn(c, final(f"_r_{c}", F.max(f"_r_{c}").over(Window.partitionBy(by)))).drop(f"_r_{c}")
        return out
    from ..operators import ranging
    from ..sources.tables import Materializer

    df = Materializer(df.sparkSession).scratch(df, "unscaled")  # read for its ranks and for the rest
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), clean(c).cast("double").alias("v")) for c in columns])).alias("p")
    long = df.select(*keys, pairs).select(*keys, F.col("p.k").alias("k"), F.col("p.v").alias("v")).where("v IS NOT NULL")
    long = ranging.ranked(long.withColumn("_cell", F.when(F.col(by).isNotNull(), F.concat_ws("|", by, "k"))), "v", "_cell", keys).withColumn("v", ranging.dense_scaled())
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in columns])
    out = df.drop(*columns).join(wide, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns}).select(*df.columns)


def decile(c: Column | str, by: str, tie: str) -> Column:
    """0 to 9 by place, floor(10 * (place - 1) / n); ties by the tie column."""
    w = Window.partitionBy(by)
    place = F.row_number().over(w.orderBy(clean(c).asc_nulls_last(), tie))
    return F.floor(F.lit(10) * (place - 1) / F.count(F.lit(1)).over(w)).cast("int")


def rank_scaled(c: Column | str, by: str) -> Column:
    """Average rank scaled to [-1, 1]; a lone row is 0."""
    n = F.count(clean(c)).over(Window.partitionBy(*_by(by)))
    return F.when(n > 1, (average_rank(c, by) - 1) / (n - 1) * 2 - 1).when(clean(c).isNotNull(), F.lit(0.0))


def zscore(c: Column | str, by: str) -> Column:
    """(x - mean) / sample deviation within the period; no deviation or null: 0."""
    c, w = clean(c).cast("double"), Window.partitionBy(*_by(by))
    return F.coalesce(F.try_divide(c - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))), F.lit(0.0))


def median_filled(c: Column | str, by: str) -> Column:
    """Null to the period's median, then to the median of all rows' values given by the caller's frame."""
    c = clean(c).cast("double")
    return F.coalesce(c, F.median(c).over(Window.partitionBy(*_by(by))))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: the correlation over rows with both; null where one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
