"""Ranks within periods where no period has to fit a task.

Rows are dealt by range of (period, value, key), so a period lies over as many tasks as it needs and so does a value that many rows share. Each range ranks its own rows; a small table of
ranges (rows, distinct values, first and last value of each period in it) gives what stands before a range and which ties run over its borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import clean


def ranked(df: DataFrame, value: str, by: str, keys: list[str], partitions: int | None = None) -> DataFrame:
    """df with ``_rank``, a struct for rows that have a value: n rows with a value in the period, less (rows below it), ties (rows that share it, itself counted), place (1 to n, ties by
    keys), dense (distinct values below it), kinds (distinct values of the period). Rows without a value or a period, or with NaN, have a null there.

    keys with ``by`` identify a row; rows that share them share places in no set order. partitions: how many ranges; by default the session's shuffle partitions.
    """
    from ..sources.tables import Materializer

    spark = df.sparkSession
    partitions = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = F.when(F.col(by).isNotNull(), clean(value).cast("double"))
    dealt = df.withColumn("_v", v).repartitionByRange(partitions, by, "_v", *keys).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy("_range", by)
    local = dealt.withColumns({
        "_place": F.row_number().over(own.orderBy(F.col("_v").asc_nulls_last(), *keys)), "_less": F.rank().over(own.orderBy(F.col("_v").asc_nulls_last())) - 1,
        "_dense": F.dense_rank().over(own.orderBy(F.col("_v").asc_nulls_last())) - 1, "_ties": F.count(F.lit(1)).over(Window.partitionBy("_range", by, "_v")),
    })
    keep = Materializer(spark)
    every = keep.scratch(local, "ranges")
    local = every.where("_v IS NOT NULL")
    table = local.groupBy(by, "_range").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_v").alias("first"), F.max("_v").alias("last"), F.min_by("_ties", "_v").alias("n_first"), F.max_by("_ties", "_v").alias("n_last"), (F.max("_dense") + 1).alias("kinds"),
    )
    table = keep.scratch(table, "range_table")  # a row a period and range
    line, whole = Window.partitionBy(by).orderBy("_range"), Window.partitionBy(by)
    goes_on = (F.col("first") == F.lag("last").over(line)).cast("int")
    table = table.withColumn("goes_on", F.coalesce(goes_on, F.lit(0)))
    table = table.withColumns({
        "before": F.sum("rows").over(line) - F.col("rows"), "n": F.sum("rows").over(whole), "all_kinds": F.sum(F.col("kinds") - F.col("goes_on")).over(whole),
        "kinds_before": F.sum(F.col("kinds") - F.col("goes_on")).over(line) - F.col("kinds"),
    })
    # a value that runs over a border is first or last in every range that has it
    edge = F.explode(F.array(F.struct(F.col("first").alias("v"), F.col("n_first").alias("c"), F.col("before").alias("less")), F.struct(F.col("last").alias("v"), F.when(F.col("last") > F.col("first"), F.col("n_last")).otherwise(0).alias("c"), (F.col("before") + F.col("rows") - F.col("n_last")).alias("less")))).alias("e")
    edges = table.select(by, edge).groupBy(by, F.col("e.v").alias("_v")).agg(F.sum("e.c").alias("edge_ties"), F.min("e.less").alias("edge_less"))
    out = local.join(table.select(by, "_range", "before", "kinds_before", "n", "all_kinds"), [by, "_range"]).join(edges, [by, "_v"], "left")
    rank = F.struct(
        "n", F.coalesce("edge_less", F.col("before") + F.col("_less")).alias("less"), F.coalesce("edge_ties", "_ties").alias("ties"), (F.col("before") + F.col("_place")).alias("place"),
        (F.col("kinds_before") + F.col("_dense")).alias("dense"), F.col("all_kinds").alias("kinds"),
    )
    shape = "struct<n:bigint,less:bigint,ties:bigint,place:bigint,dense:bigint,kinds:bigint>"
    done = out.select(*df.columns, rank.cast(shape).alias("_rank"))
    return done.unionByName(every.where("_v IS NULL").select(*df.columns, F.lit(None).cast(shape).alias("_rank")))


def average() -> Column:
    """1-based rank, ties averaged."""
    return F.col("_rank.less") + (F.col("_rank.ties") + 1) / 2.0


def percent() -> Column:
    return average() / F.col("_rank.n")


def scaled() -> Column:
    """Average rank scaled to [-1, 1]; a lone row is 0."""
    return F.when(F.col("_rank.n") > 1, (average() - 1) / (F.col("_rank.n") - 1) * 2 - 1).when(F.col("_rank").isNotNull(), F.lit(0.0))


def dense_scaled() -> Column:
    """Dense rank scaled to [-1, 1]; one value only, or null: 0."""
    return F.coalesce(F.when(F.col("_rank.kinds") > 1, F.col("_rank.dense") / (F.col("_rank.kinds") - 1) * 2 - 1), F.lit(0.0))


def tenth() -> Column:
    """0 to 9 by place, floor(10 * (place - 1) / n)."""
    return F.floor(F.lit(10) * (F.col("_rank.place") - 1) / F.col("_rank.n")).cast("int")


def prediction() -> Column:
    """2 * average rank / (n + 1) - 1."""
    return 2 * average() / (F.col("_rank.n") + 1) - 1
