"""What the operators share: scratch tables in the shared folder, row handling, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts use it: space and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='scratch-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, not a re-run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[tuple[str, str]] = []

    def path(self, name: str = "t") -> str:
        self.n += 1
        self.paths.append((name, f"{self.root}/{name}{self.n}"))
        return self.paths[-1][1]

    def named(self, name: str) -> list[str]:
        """Paths of the tables kept under that name."""
        return [p for n, p in self.paths if n == name]

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return it reread."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, buckets: int, *columns: str, name: str = "b") -> DataFrame:
        """Write df as a table of ``buckets`` sorted files and return it: joins on the columns read it in place, without an exchange.

        df is dealt by the columns already, as after a group-by of them; else a bucket has several files.
        """
        table_name, path = f"{name}_{uuid.uuid4().hex}", self.path(name)
        df.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(table_name, format="parquet")
        out = self.spark.table(table_name)
        out._scratch_path, out._table = path, table_name
        return out

    def drop(self, *frames: DataFrame | str) -> None:
        """Remove tables that nothing reads any more."""
        for frame in frames:
            if getattr(frame, "_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {frame._table}")
            path = frame if isinstance(frame, str) else getattr(frame, "_scratch_path", None)
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_HELD: dict = {}


def hold(kind: str, key, make):
    """The worker's one cache: made when another kind or key held the place. Workers outlive stages; what an earlier stage kept must not
    stand beside what the next one needs."""
    if _HELD.get("key") != (kind, key):
        _HELD.clear()
        give_back()
        _HELD.update(key=(kind, key), value=make())
    return _HELD["value"]


def give_back() -> None:
    """Freed memory goes back to the system where Arrow's pool and the C library can do that; else they keep it for a worker's life."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Drop the worker's cache: called by tasks that have no use for one."""
    hold("", None, lambda: None)


def sealed(docs: DataFrame, **parts: Column) -> DataFrame:
    """All columns of docs in one struct ``row``, beside columns of our own: no name of theirs can meet one of ours."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[c.alias(name) for name, c in parts.items()])


def unsealed(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of docs again, in order, those in ``new`` replaced, further ones of ``new`` after them."""
    own = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names]
    return df.select(*own, *[c.alias(n) for n, c in new.items() if n not in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_cuts(df: DataFrame, parts: int, column: str = "doc_id") -> list[int]:
    """Ascending cut points that deal the ids into about equal parts; at most ``parts`` numbers reach the driver."""
    if parts <= 1:
        return []
    got = df.select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()
    return sorted(set(got["q"] or []))


def components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge names; root is the component's smallest node.

    Alternating large-star and small-star rounds over the links as a table (Kiveris et al. 2014). Each round is a
    partially aggregated minimum and an equi-join on the node, which the adaptive planner can split where a
    node is hot; each is written to the shared folder. Nothing but a change count reaches the driver.
    """
    spark = edges.sparkSession
    low, high = F.least(src, dst), F.greatest(src, dst)
    links = scratch.keep(edges.where(F.col(src) != F.col(dst)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, "large")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = large.join(near, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        fresh = scratch.keep(small.where("u != v").distinct(), "links")
        # a star: every node has one link, and no target has a link of its own
        moved = fresh.groupBy("u").count().where("count > 1").limit(1).count()
        moved = moved or fresh.join(fresh.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        scratch.drop(links, large)
        links = fresh
        if not moved:
            break
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
