"""Line dedup against levelled sorted runs of line hashes.

The index keeps runs of (h1, h2): 128-bit hashes of the line keys seen so far, as tables bucketed and sorted by them, in levels. A batch
of documents brings its distinct hashes, dealt once into the same buckets, and merge-joins every run: a run is read in its order,
neither shuffled nor sorted again. Lines that a run or an earlier document of the batch holds go; the batch's new hashes become a run of level 0.
When a level holds ``fanout`` runs they are merged, bucket by bucket, into one of the next level, so n batches leave O(fanout * log n)
runs and each hash is rewritten O(log n) times.

Skew: the distinct hashes of a batch come from a partially aggregated group-by, so a line that a third of all
documents hold is one row a task before the shuffle; marking goes through an equi-join of tables whose hot side Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import ASCII_SPACE, Scratch, ascii_lower, id_cuts, release, sealed, shuffle_partitions, table, unsealed

LEAST_CHARS, FANOUT, BATCHES = 10, 2, 4
NO_ID = (1 << 63) - 1
_ON = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


@contextmanager
def _bucket_order(spark: SparkSession):
    """Scans of bucketed tables with a file a bucket tell that they are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineIndex:
    """Runs in the shared folder; runs[level] lists them, oldest first. buckets: how many tasks a join has, fixed for the index's life."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch or Scratch(spark, "lines"), fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.runs: list[list[DataFrame]] = []

    def bucketed(self, df: DataFrame) -> DataFrame:
        """df, dealt by (h1, h2) or not, as a table of ``buckets`` sorted files."""
        with _bucket_order(self.spark):
            return self.scratch.bucketed(df, self.buckets, *_ON, name="run")

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.runs for run in level]

    def marked(self, hashes: DataFrame) -> DataFrame:
        """hashes (one row each) with ``old``: whether a run holds it. One merge join a run; the runs share no hash."""
        hashes = hashes.withColumn("old", F.lit(False))
        for run in self.all_runs():
            hit = run.select(*_ON, F.lit(True).alias("hit")).hint("merge")
            hashes = hashes.join(hit, _ON, "left").withColumn("old", F.col("old") | F.coalesce("hit", F.lit(False))).drop("hit")
        return hashes

    def add(self, fresh: DataFrame) -> None:
        """fresh: distinct hashes that no run holds, dealt in any way."""
        self.put(0, self.bucketed(fresh.repartition(self.buckets, *_ON)))

    def put(self, level: int, run: DataFrame) -> None:
        while len(self.runs) <= level:
            self.runs.append([])
        self.runs[level].append(run)
        if len(self.runs[level]) >= self.fanout:
            old, self.runs[level] = self.runs[level], []
            merged = old[0]
            for other in old[1:]:
                merged = merged.hint("merge").join(other, _ON, "full_outer")  # a merge of two sorted files a bucket
            self.put(level + 1, self.bucketed(merged))
            self.scratch.drop(*old)


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, pos, h1, h2) of every line whose key is long enough to count; row tells rows of one key apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("row"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    keyed = rows.withColumn("k", line_key(F.col("line"))).where(F.char_length("k") >= least_chars)
    return keyed.select("doc", "row", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))


def lost_lines(hashed: DataFrame, index: LineIndex) -> DataFrame:
    """(doc, row, gone): places of the lines that a run of the index or an earlier document of the batch holds; the index gains the batch."""
    first = hashed.groupBy(*_ON).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    known = index.bucketed(index.marked(first))
    # read as plain files, not as buckets: with an exchange on both sides the planner can split a line that a third of all rows hold
    plain = index.spark.read.schema(known.schema).parquet(known._scratch_path)
    repeated = plain.where(F.col("old") | (F.col("first") < F.col("last"))).select(*_ON, "first", "old")  # only these cost somebody a line
    gone = hashed.join(repeated, _ON).where(F.col("old") | (F.col("doc") > F.col("first")))
    out = index.scratch.keep(gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    index.put(0, index.bucketed(known.where(~F.col("old")).select(*_ON)))
    index.scratch.drop(known)
    return out


def rebuilt(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines in gone, plus n_lines and n_dropped (int)."""
    docs = docs.drop("n_lines", "n_dropped")
    body = F.coalesce(F.col(text), F.lit(""))
    rest = docs.drop(text)
    rows = sealed(docs, doc=F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), hash=F.xxhash64(body), text=body)
    rows = rows.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in rest.columns]))
    marked = rows.join(gone.select(F.col("doc").alias("d"), F.col("row").alias("r"), "gone"), (F.col("doc") == F.col("d")) & (F.col("hash") == F.col("r")), "left")
    marked = marked.select("row", "text", "gone")
    kind = StructType([StructField("row", marked.schema["row"].dataType), StructField("text", StringType()), StructField("n_lines", IntegerType()), StructField("n_dropped", IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            kept, n, dropped = [], [], []
            for t, out in zip(b["text"].to_pylist(), b["gone"].to_pylist()):
                lines = t.split("\n")
                n.append(len(lines))
                dropped.append(len(out or ()))
                if out:
                    lost = set(out)
                    t = "\n".join([x for i, x in enumerate(lines) if i not in lost])
                kept.append(t)
            yield pa.record_batch([b["row"], pa.array(kept, pa.string()), pa.array(n, pa.int32()), pa.array(dropped, pa.int32())], names=["row", "text", "n_lines", "n_dropped"])

    return unsealed(marked.mapInArrow(cut, kind), docs.columns, **{text: F.col("text"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})


def dedup_batch(docs: DataFrame, index: LineIndex, least_chars: int = LEAST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``text`` cut to its kept lines, plus n_lines and n_dropped (int); the index gains the batch's lines.

    Documents of a batch go in ascending key order, rows with a null key after all others as one document. Rows of one
    key are one document: none takes lines from another. A null text is an empty one and has one empty line. Very long texts are cut in one
    piece by the task that holds them. Columns of any name and type pass through, except the two that are added.
    """
    hashed = index.scratch.keep(hashed_lines(docs, least_chars, key, text), "hashed")
    gone = lost_lines(hashed, index)
    index.scratch.drop(hashed)
    return rebuilt(docs, gone, key, text)


def dedup(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """All documents in ``batches`` ascending ranges of the key through one index: each line that at least two hold stays in the first.

    The texts are read twice, to hash their lines and to cut them; batches run over the hashes. See dedup_batch() for nulls, ties and names.
    """
    index = LineIndex(docs.sparkSession)
    scratch = index.scratch
    cuts = id_cuts(docs, batches, key)
    hashed = scratch.keep(hashed_lines(docs, least_chars, key, text), "hashed")
    parts: list[DataFrame] = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = hashed if low is None else hashed.where(F.col("doc") >= low)
        parts.append(lost_lines(part if high is None else part.where(F.col("doc") < high), index))
    scratch.drop(hashed)
    scratch.drop(*index.all_runs())
    gone = parts[0]
    for p in parts[1:]:
        gone = gone.unionByName(p)
    return rebuilt(docs, gone, key, text)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents; see dedup_batch() for nulls and ties."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_lines}
SQL = {
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
}
