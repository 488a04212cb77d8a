"""Panels, market series and event streams made of the star-schema tables. Money is summed as decimals, so order does not matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measures(lines: DataFrame, entity: str) -> DataFrame:
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    grouped = lines.groupBy(F.col(entity).alias("entity"), month_end(F.col("l_shipdate")).alias("eom"))
    return grouped.agg(
        dec("l_extendedprice").alias("revenue"), dec("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines"), (dec("l_discount") / F.count(F.lit(1))).alias("disc")
    )


def _changes(df: DataFrame) -> DataFrame:
    """ret: change of revenue on the month before; target: change to the next. Null across gaps."""
    w, m = Window.partitionBy("entity").orderBy("eom"), month_index(F.col("eom"))
    before, after = F.lag("revenue").over(w), F.lead("revenue").over(w)
    ret = F.when(F.lag(m).over(w) == m - 1, F.try_divide(F.col("revenue"), before) - 1)
    target = F.when(F.lead(m).over(w) == m + 1, F.try_divide(after, F.col("revenue")) - 1)
    return df.withColumns({"ret": ret, "target": target})


def panel_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sectional panel of parts: entity, eom, revenue, qty, n_lines, disc, price, sector, size, ret, target."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("price"), F.substring("p_brand", 7, 1).alias("sector"), F.col("p_size").alias("size"))
    return _changes(_measures(table(spark, sf_dir, "lineitem"), "l_partkey").join(part, "entity"))


def panel_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense time-series panel of suppliers: as panel_part, with sector = nation and size = sign of the balance."""
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("string").alias("sector"), F.col("s_acctbal").alias("price"))
    return _changes(_measures(table(spark, sf_dir, "lineitem"), "l_suppkey").join(supp, "entity"))


def panel_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse panel of customers with gaps: entity, eom, total, n_orders."""
    dec = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), month_end(F.col("o_orderdate")).alias("eom"))
    return grouped.agg(dec.alias("total"), F.count(F.lit(1)).alias("n_orders"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as filings: document_id, entity, filing_date, items."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("document_id"), F.col("user_id").alias("entity"), F.to_date("ts").alias("filing_date"), F.array("event_type").alias("items"), "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings: document_id, entity (source), filing_date, text, text_hash."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(720)).cast("int"))
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("entity"), day.alias("filing_date"), "text", "lang", F.md5(F.col("text").cast("binary")).alias("text_hash"))


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two monthly series that only partly overlap: a rate (share of urgent orders) and an index return (change of all order value)."""
    o = table(spark, sf_dir, "orders").withColumn("eom", month_end(F.col("o_orderdate")))
    rate = o.groupBy("eom").agg((F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)) * 12.0 / F.count(F.lit(1))).alias("rate"))
    value = o.groupBy("eom").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    index = value.withColumn("index_ret", F.col("v") / F.lag("v").over(Window.orderBy("eom")) - 1).where("index_ret IS NOT NULL").select("eom", "index_ret")
    return rate, index
