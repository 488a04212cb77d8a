"""As-of, trailing-window, market and grid joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import next_month_end, period_index


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: str, out: str) -> DataFrame:
    """left with the value of the right row nearest in date; of two as near the earlier, then the lesser value. Null values on the right don't count.

    Dates of both sides stand in one line per key: the last value at or before a date and the first one after it are running values, forth and back. A key's
    rows are sorted twice and never paired.
    """
    r = right.select(F.col(by).alias(by), F.col(right_on).alias("_on"), F.col(value).alias("_v")).where(F.col(by).isNotNull() & F.col("_v").isNotNull() & F.col("_on").isNotNull())
    r = r.groupBy(by, "_on").agg(F.min("_v").alias("_v"))
    keys = left.select(by, F.col(left_on).alias("_on")).where(F.col(by).isNotNull() & F.col("_on").isNotNull()).distinct()
    line = keys.select(by, "_on", F.lit(1).alias("_asks"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v")).unionByName(r.select(by, "_on", F.lit(0).alias("_asks"), "_v"))
    known = F.when(F.col("_asks") == 0, F.struct(F.col("_on").alias("o"), F.col("_v").alias("v")))
    w = Window.partitionBy(by)
    line = line.withColumn("_b", F.last(known, ignorenulls=True).over(w.orderBy("_on", "_asks")))
    line = line.withColumn("_a", F.last(known, ignorenulls=True).over(w.orderBy(F.desc("_on"), F.desc("_asks"))))
    nearer = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.datediff("_a.o", "_on") < F.datediff("_on", "_b.o")))
    near = line.where("_asks = 1").select(by, F.col("_on").alias(left_on), F.when(nearer, F.col("_a.v")).otherwise(F.col("_b.v")).alias(out))
    return left.join(near, [by, left_on], "left")


def fill_labels(keys: DataFrame, other: DataFrame, columns: list[str], by: str, left_on: str, right_on: str) -> DataFrame:
    """Fill nulls of each column from the nearest dated row of ``other``, one column at a time."""
    out = keys
    for c in columns:
        out = asof_nearest(out, other, by, left_on, right_on, c, "_fill").withColumn(c, F.coalesce(F.col(c), F.col("_fill"))).drop("_fill")
    return out


def trailing(keys: DataFrame, facts: DataFrame, offsets: range, aggs: dict[str, Column], entity: str = "entity", date: str = "eom", period: str = "month") -> DataFrame:
    """(entity, date, aggs) over facts(entity, idx, ...) of the periods idx - o, o in offsets (one after another), for each (entity, date) of keys.

    Keys and facts stand in one line per entity and every key looks back over a range of it: each row is sent once. The aggregates must skip nulls, which keys have for
    the facts' columns. Keys without facts in their window don't appear.
    """
    asked = keys.select(entity, date).distinct().withColumn("idx", period_index(F.col(date), period))
    line = facts.withColumn("_fact", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(entity).orderBy("idx").rangeBetween(-max(offsets), -min(offsets))
    found = line.select(entity, date, F.sum("_fact").over(w).alias("_n"), *[agg.over(w).alias(name) for name, agg in aggs.items()])
    return found.where(F.col(date).isNotNull() & (F.col("_n") > 0)).drop("_n")


def market_full(a: DataFrame, b: DataFrame, on: str = "eom") -> DataFrame:
    """Both series on the union of their dates."""
    return a.join(b, on, "full")


def market_to_formation(market: DataFrame, date: str = "eom") -> DataFrame:
    """Key a month's market row on the month-end before it, where books of that month are formed."""
    return market.withColumn(date, next_month_end(F.col(date), -1))


def grid(spark: SparkSession, **axes: tuple) -> DataFrame:
    """A row a combination, numbered config_id in the order of the axes."""
    rows = [(i, *v) for i, v in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["config_id", *axes])
