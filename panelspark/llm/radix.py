"""Distributed radix selection: the k greatest values of each group, without bringing a group together.

Each round counts a group's values by their next digit (a histogram of at most 1,024 buckets, counted before the shuffle), finds the bucket that holds
the k-th value and goes on inside it. Where one value remains and still holds many rows, the ties are told apart by the UTF-8 bytes of their item, two
bytes a round after what they share. Once no group's open bucket holds more than ``gather`` rows, the rows at or above the thresholds are gathered and ranked.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch

DIGIT, GATHER = 10, 1000


def digit_shift(low: Column, high: Column, digit: int = DIGIT) -> Column:
    """How far to shift offsets within [low, high] so that fewer than 2 ** digit buckets are left."""
    return F.greatest(F.lit(0), F.length(F.bin(high - low)) - digit)


def locate(hist: DataFrame, groups: list[str], bucket: str, need: Column, keep: list[str] = ()) -> DataFrame:
    """Of (groups, bucket, n, ...): each group's bucket, ascending, at which the running count reaches ``need``, with ``before``, the count of earlier ones; the last
    bucket where all together hold less."""
    order = Window.partitionBy(*groups).orderBy(bucket)
    run = hist.withColumn("upto", F.sum("n").over(order)).withColumn("last", F.lead(bucket).over(order).isNull())
    hit = run.where(((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)) | (F.col("last") & (F.col("upto") < need)))
    return hit.select(*groups, bucket, "n", (F.col("upto") - F.col("n")).alias("before"), *keep)


@F.pandas_udf(StringType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """What two hex strings share, in whole bytes."""
    out = [os.path.commonprefix([x, y]) for x, y in zip(a, b)]
    return pd.Series([s[: len(s) // 2 * 2] for s in out], dtype="object")


def _each(rows: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    return rows.join(state, groups)


def top_k(rows: DataFrame, scratch: Scratch, groups: list[str], value: str, item: str, k: int, gather: int = GATHER) -> DataFrame:
    """(groups, item, value, rank) of each group's k greatest values, ties to the smaller item by its bytes; groups with fewer rows give all.

    ``rows`` is a table that can be read repeatedly; groups, value (a long within +-2 ** 62) and item (a string) hold no nulls. No rows give none.
    """
    rows = rows.select(*groups, F.col(value).alias("value"), F.col(item).alias("item"))
    state = rows.groupBy(*groups).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).withColumn("above", F.lit(0).cast("long"))
    state = scratch.keep(state, "state")
    many = (F.col("n") > gather) & (F.col("n") + F.col("above") > k)
    columns = [*groups, "lo", "hi", "n", "above"]
    while state.where(many & (F.col("hi") > F.col("lo"))).limit(1).count():
        going = state.where(many & (F.col("hi") > F.col("lo"))).withColumn("shift", digit_shift(F.col("lo"), F.col("hi"))).drop("n")
        inside = _each(rows, going, groups).where("value BETWEEN lo AND hi")
        hist = inside.groupBy(*groups, "lo", "hi", "above", "shift", F.expr("shiftright(hi - value, shift)").alias("bucket")).agg(F.count("*").alias("n"))
        at = locate(hist, groups, "bucket", F.lit(k) - F.col("above"), ["lo", "hi", "above", "shift"])
        top = F.expr("hi - shiftleft(bucket, shift)")
        found = at.select(*groups, F.greatest(F.col("lo"), top - F.expr("shiftleft(1L, shift)") + 1).alias("lo"), top.alias("hi"), "n", (F.col("above") + F.col("before")).alias("above"))
        state = scratch.keep(found.unionByName(state.where(~(many & (F.col("hi") > F.col("lo")))).select(*columns)), "state")
    state = scratch.keep(state.select(*columns, F.lit("").alias("bytes")), "state")
    hexed = F.hex(F.col("item").cast("binary"))
    while state.where(many).limit(1).count():
        going = state.where(many)
        tied = _each(rows, going.drop("n"), groups).where(F.col("value") == F.col("lo")).withColumn("hex", hexed).where(F.col("hex").startswith(F.col("bytes")))
        ends = tied.groupBy(*groups).agg(F.min("hex").alias("first"), F.max("hex").alias("final"))
        shared = scratch.keep(going.drop("bytes", "n").join(ends, groups).select(*groups, "lo", "hi", "above", _common("first", "final").alias("bytes"), (F.col("first") == F.col("final")).alias("one")), "shared")
        inside = _each(rows, shared.where("NOT one"), groups).where(F.col("value") == F.col("lo")).withColumn("hex", hexed).where(F.col("hex").startswith(F.col("bytes")))
        hist = inside.groupBy(*groups, "lo", "hi", "above", "bytes", F.expr("substring(hex, length(bytes) + 1, 4)").alias("bucket")).agg(F.count("*").alias("n"))
        at = locate(hist, groups, "bucket", F.lit(k) - F.col("above"), ["lo", "hi", "above", "bytes"])
        found = at.select(*groups, "lo", "hi", "n", (F.col("above") + F.col("before")).alias("above"), F.concat("bytes", "bucket").alias("bytes"))
        # equal rows without end: k of them are as good as all
        same = shared.where("one").select(*groups, "lo", "hi", F.lit(0).cast("long").alias("n"), "above", "bytes")
        state = scratch.keep(found.unionByName(same).unionByName(state.where(~many)), "state")
    near = _each(rows, state.select(*groups, "lo", "bytes"), groups).where("value >= lo")
    hexes = F.when(F.col("bytes") != "", hexed)
    near = near.where((F.col("value") > F.col("lo")) | (F.col("bytes") == "") | (hexes < F.col("bytes")) | hexes.startswith(F.col("bytes")))
    order = Window.partitionBy(*groups).orderBy(F.desc("value"), "item")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*groups, F.col("item").alias(item), F.col("value").alias(value), "rank")
