"""Exact quantiles and medians by selection: histograms find the bin that holds a place, and only that bin is looked into.

A percentile aggregate keeps every distinct value of a group in one buffer. Here a group's values are counted in BINS equal bins between its least and greatest, counted before the
shuffle; the bin in which the wanted place lies is divided again, for all columns and groups at once, until it holds one value or at most GATHER rows. A group of any size is spread
over all tasks in every pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import clean

BINS, GATHER = 1024, 1000
_MOST = 1.7976931348623157e308


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """Place of x among BINS equal parts of [lo, hi]; halves, so that no difference leaves the range of doubles. It never falls as x rises."""
    part = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2) * BINS
    return F.least(F.floor(part), F.lit(BINS - 1)).cast("int")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] = (), interpolation: str = "linear") -> DataFrame:
    """(by, name, share, value): exact quantiles of each column in each group; nulls and NaN don't count, infinities count as the largest doubles.

    linear: interpolated between the places around share * (n - 1); nearest: the value at round(share * (n - 1)), halves up. A group without values has no rows, nor has one with a null among
    ``by``. An empty frame gives none. df is read once and its columns kept as a table.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"interpolation: {interpolation}")
    from ..sources.tables import Materializer

    keep, by = Materializer(df.sparkSession), list(by)
    finite = lambda c: F.greatest(F.least(clean(c).cast("double"), F.lit(_MOST)), F.lit(-_MOST))
    slim = keep.scratch(df.select(*by, *[F.when(clean(c).isNotNull(), finite(c)).alias(f"x{i}") for i, c in enumerate(columns)]).dropna(subset=by or None, how="any" if by else "all"), "selection")
    rows = slim.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(len(columns))])).alias("p")).select(*by, "p.i", "p.x").where("x IS NOT NULL")
    group = [*by, "i"]
    sizes = keep.scratch(rows.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")), "sizes")
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    at = F.col("share") * (F.col("n") - 1)
    wanted = wanted.withColumns({"low": F.floor(at) if interpolation == "linear" else F.floor(at + 0.5), "high": F.ceil(at) if interpolation == "linear" else F.floor(at + 0.5), "part": at - F.floor(at)})
    state = wanted.select(*group, F.explode(F.array_distinct(F.array("low", "high"))).alias("place"), "lo", "hi", "n").distinct().withColumn("before", F.lit(0).cast("long"))
    state = keep.scratch(state, "state")
    open_ = (F.col("lo") < F.col("hi")) & (F.col("n") > GATHER)
    while state.where(open_).limit(1).count():
        spans = state.where(open_).select(*group, "lo", "hi", "before").distinct()
        binned = rows.join(spans, group).where("x BETWEEN lo AND hi").withColumn("bin", _bin(F.col("x"), F.col("lo"), F.col("hi")))
        hist = binned.groupBy(*group, F.col("lo").alias("from"), "before", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*group, "from").orderBy("bin"))
        hist = hist.withColumn("upto", upto).select(*group, "from", "lo", "hi", "n", "upto")
        going = state.where(open_).select(*group, "place", F.col("lo").alias("from"))
        found = going.join(hist, [*group, "from"]).where("place < upto AND place >= upto - n")
        state = keep.scratch(found.select(*group, "place", "lo", "hi", "n", (F.col("upto") - F.col("n")).alias("before")).unionByName(state.where(~open_)), "state")
    few = rows.join(state.where("lo < hi"), group).where("x BETWEEN lo AND hi")  # at most GATHER rows a place
    told = few.groupBy(*group, "place", "before").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    told = told.select(*group, "place", F.element_at("xs", (F.col("place") - F.col("before") + 1).cast("int")).alias("v")).unionByName(state.where("lo = hi").select(*group, "place", F.col("lo").alias("v")))
    told = keep.scratch(told, "told")
    out = wanted.select(*group, "share", F.col("low").alias("place"), "high", "part").join(told.withColumnRenamed("v", "v_low"), [*group, "place"])
    out = out.select(*group, "share", "part", "v_low", F.col("high").alias("place")).join(told.withColumnRenamed("v", "v_high"), [*group, "place"])
    value = F.col("v_low") if interpolation == "nearest" else F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise((1 - F.col("part")) * F.col("v_low") + F.col("part") * F.col("v_high"))
    return out.select(*by, F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("name"), "share", value.alias("value"))


def bounds(df: DataFrame, columns: list[str], shares: list[float], interpolation: str = "linear") -> dict[str, list[float] | None]:
    """Quantiles of whole columns, a few numbers each; None for a column without values."""
    got = {(r["name"], r["share"]): r["value"] for r in quantiles(df, columns, shares, (), interpolation).collect()}
    return {c: [got[c, float(q)] for q in shares] if (c, float(shares[0])) in got else None for c in columns}


def medians(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, a column each): medians of every column in every group; a group with no value at all has no row."""
    return quantiles(df, columns, [0.5], by).groupBy(*by).pivot("name", columns).agg(F.first("value"))


def median_filled(df: DataFrame, columns: list[str], by: str = "eom") -> DataFrame:
    """df with nulls and NaN of each column as the median of their period, then of all rows; where nothing is known they stay null."""
    own = medians(df, columns, [by]).withColumnsRenamed({c: f"_m_{c}" for c in columns})
    over = bounds(df, columns, [0.5])
    out = df.join(own, by, "left")  # a row a period
    filled = {c: F.coalesce(clean(c).cast("double"), F.col(f"_m_{c}"), F.lit(over[c][0] if over[c] else None).cast("double")) for c in columns}
    return out.withColumns(filled).select(*df.columns)
