"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard, entering at each node the child with the least draw. A shard draws -ln(u) / weight, where u in
(0, 1) is a hash of the key and the shard's path; a rack draws the least of its shards' draws, a region the least of its racks'. The least of
exponential draws is an exponential draw whose rate is the sum of theirs, so each node is entered in proportion to the weight below it,
and its draw depends on nothing else. Hence:

* a shard whose weight grows can only win keys, and one that shrinks only lose some: keys move into or out of the changed shard, and
  between subtrees only where one's weight changes;
* one more shard, wherever it stands in the tree, takes rows only into itself, at any count.

All of it is JVM expressions; no row moves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

REGIONS, RACKS, SHARDS = 3, 2, 4


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = RACKS, per_rack: int = SHARDS) -> list[Leaf]:
    """Racks of per_rack shards, regions of racks racks, filled in order: a larger count only adds leaves."""
    return [Leaf(f"r{i // (racks * per_rack)}", f"k{i // per_rack % racks}", i) for i in range(shards)]


def _draw(key: Column, label: str, weight: float) -> Column:
    """Exponential draw with rate weight: the top 53 bits of a 64-bit hash, shifted off zero."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(label)), 11).cast("double")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(children: list[Column]) -> Column:
    """The child with the least draw; each is a struct (draw, shard), ties go to the lesser shard."""
    return children[0] if len(children) == 1 else F.least(*children)


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key in the tree that the leaves make; leaves of no weight take nothing. Draws are made once each and their minima
    carried up with the shard below them, which is where the descent ends."""
    tree: dict[str, dict[str, list[Column]]] = {}
    for x in leaves:
        if x.weight > 0:
            drawn = F.struct(_draw(key, f"{x.region}/{x.rack}/{x.shard}", x.weight).alias("draw"), F.lit(x.shard).alias("shard"))
            tree.setdefault(x.region, {}).setdefault(x.rack, []).append(drawn)
    if not tree:
        raise ValueError("no shard has any weight")
    regions = [_least([_least(shards) for shards in racks.values()]) for racks in tree.values()]
    return _least(regions)["shard"].cast("int")


def with_slots(df: DataFrame, group: str, order: list[str], column: str = "slot", rows_per_bucket: int = 50_000) -> DataFrame:
    """Number each group's rows 0, 1, ... without ever putting a group into one task.

    Rows are dealt by a hash of the order columns into buckets, as many as keep a bucket small at any size; counts per
    (group, bucket) give each bucket its first number. The rows must not change between two readings.
    """
    spark = df.sparkSession
    rows = df.count()
    buckets = max(16, shuffle_partitions(spark), rows // rows_per_bucket)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).drop("_n")
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_in", F.row_number().over(within))
    return numbered.join(first, [group, "_bucket"]).withColumn(column, (F.col("_first") + F.col("_in") - 1).cast("long")).drop("_bucket", "_first", "_in")


def shard(df: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard); other columns of df are dropped.

    A null key is a key like any other; a null text has size 8 and crc 0. Rows with equal keys share a shard and get
    slots of their own; very long texts are only measured. An empty table gives no rows. Sizes and checksums are taken where the text is
    read; only the narrow columns are dealt out for the slots.
    """
    k = F.col(key)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        k,
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        place(k, leaves).alias("shard"),
        (place(k, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [key, "text_crc32", "size"])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law ``key``; see shard()."""
    out = shard(table(spark, sf_dir, "documents"), layout(24), layout(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_hash_tree_shards": op3_shards}
SQL: dict[str, str] = {}
