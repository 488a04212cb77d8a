"""Hard negatives by distributed radix selection.

Vectors lie in chunks; anchors are sent to every chunk and stream by it, a matrix product a batch, so all scores are made where the vectors are and none is stored. First each
anchor's positives are found. Each (anchor, positive) then has a window of scores. A pass counts the scores of other labels that fall in each window by their next
digit; what a chunk sends are the counts down to its own k-th score at most. Summed, they tell the bucket of the window's k-th score, which the next pass divides, until few rows lie at or
above it. The last pass gathers only rows that qualify: of a chunk's rows at or above a window's threshold the k best, so that ties, however many, stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import radix
from .common import Scratch, shuffle_partitions, table
from .knn import _matrix, _scores, quantised

CHUNK, CHUNK_BYTES, DIGIT = 20_000, 64 << 20, 8
_WINDOWS = "array<struct<w int, positive_id bigint, positive_score bigint, lo bigint, hi bigint, top bigint, need bigint, shift int>>"
_SENT = f"chunk int, asks int, aid long, id long, label string, v array<double>, windows {_WINDOWS}"


def _stream(width: int, names: list[str], answer: Callable) -> Callable:
    """Of a task's rows, sorted by (chunk, asks): the vectors of a chunk, then the anchors sent to it. Labels become numbers of the
    chunk, -1 where it has no such label. ``answer(anchor rows, their labels, scores, the chunk's labels, ids)`` gives lists of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, xs, ids, labels, known = None, [], None, None, None, {}
        for b in batches:
            place = np.stack([b["chunk"].to_numpy(), b["asks"].to_numpy()], 1)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1), True])
            for i, z in zip(edges, edges[1:]):
                chunk, asks, part = int(place[i, 0]), place[i, 1], b.slice(i, z - i)
                if chunk != at:
                    at, held, xs = chunk, [], None
                if not asks:
                    held.append((part["id"].to_numpy(), np.asarray(part["label"].to_pylist(), object), _matrix(part["v"], width)))
                    continue
                if xs is None:
                    ids, labels, xs = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros((0, width)))
                    order = np.argsort(ids, kind="stable")  # ties by id are then ties by place
                    kinds, code = np.unique(labels.astype(str), return_inverse=True)
                    known = {k: n for n, k in enumerate(kinds)}
                    ids, labels, xs, held = ids[order], code[order], xs[order], []
                for s in range(0, part.num_rows, 128):
                    rows = part.slice(s, 128)
                    own = [known.get(x, -1) for x in rows["label"].to_pylist()]
                    got = answer(rows, own, _scores(_matrix(rows["v"], width), xs), labels, ids)
                    if got and len(got[0]):
                        yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in got], names=names)

    return run


def _first(score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k of ``rows`` (ascending places) with the greatest scores, ties to the earlier place."""
    s = score[rows]
    if len(rows) > k:
        floor = np.partition(s, len(s) - k)[len(s) - k]
        above, level = np.flatnonzero(s > floor), np.flatnonzero(s == floor)
        return rows[np.concatenate([above, level[: k - len(above)]])]
    return rows


def _positives(k: int) -> Callable:
    def answer(anchors: pa.RecordBatch, own: list[int], scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> list:
        out: list = [[], [], [], []]
        for i, (aid, anchor, label) in enumerate(zip(anchors["aid"].to_pylist(), anchors["id"].to_pylist(), own)):
            near = _first(scores[i], np.flatnonzero((labels == label) & (ids != anchor)), k)
            for column, x in zip(out, (np.full(len(near), aid), np.full(len(near), anchor), ids[near], scores[i, near])):
                column.append(x)
        return out

    return answer


def _histogram(anchors: pa.RecordBatch, own: list[int], scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> list:
    """(aid, w, bucket, n): counts of a window's scores by digit from its upper end, down to the bucket of the chunk's own k-th."""
    out: list = [[], [], [], []]
    for i, (aid, label, windows) in enumerate(zip(anchors["aid"].to_pylist(), own, anchors["windows"].to_pylist())):
        others = scores[i][labels != label]
        for w in windows:
            s = others[(others >= w["lo"]) & (others <= w["hi"])]
            if not len(s):
                continue
            n = np.bincount((w["hi"] - s) >> w["shift"])
            n = n[: int(np.searchsorted(np.cumsum(n), w["need"])) + 1]
            at = np.flatnonzero(n)
            for column, x in zip(out, (np.full(len(at), aid), np.full(len(at), w["w"]), at, n[at])):
                column.append(x)
    return out


def _gather(k: int) -> Callable:
    """(aid, w, positive_id, positive_score, negative_id, negative_score) of rows from a window's threshold up."""

    def answer(anchors: pa.RecordBatch, own: list[int], scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> list:
        out: list = [[] for _ in range(6)]
        for i, (aid, label, windows) in enumerate(zip(anchors["aid"].to_pylist(), own, anchors["windows"].to_pylist())):
            other = labels != label
            for w in windows:
                near = _first(scores[i], np.flatnonzero(other & (scores[i] >= w["lo"]) & (scores[i] <= w["top"])), k)
                fixed = [np.full(len(near), x) for x in (aid, w["w"], w["positive_id"], w["positive_score"])]
                for column, x in zip(out, (*fixed, ids[near], scores[i, near])):
                    column.append(x)
        return out

    return answer


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK, gather: int = 4,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale x), scores are integer inner products, higher first, ties to the smaller id. Anchors are the rows whose id ``every`` divides. An anchor's
    positives are its best ``positives`` other rows of its label; its negatives for one of them the best ``negatives`` rows of other labels whose score is from ``low`` to ``high`` per cent of
    the positive's. Fewer rows give all; a positive without negatives, or with a negative score, gives none.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that share the anchor's id are not its positives; of anchors with one id and unlike
    vectors each asks for itself, equal ones ask once. Shorter vectors end in zeros. An empty table gives no rows; other columns are ignored. A window is divided until at most ``gather`` times
    ``negatives`` rows lie at or above its threshold, or a single score is left.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = quantised(vectors.where(F.col(label).isNotNull()), scale, key, vector, label)
    rows = scratch.keep(rows.withColumn("n", F.xxhash64(F.monotonically_increasing_id())), "rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size["width"] or 0)
    most = max(128, min(chunk, CHUNK_BYTES // (8 * width), size["n"] // (2 * shuffle_partitions(spark))))
    chunks = max(1, -(-size["n"] // most))
    none = F.lit(None).cast(_WINDOWS)
    held = rows.select(F.pmod(F.col("n"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("asks"), F.lit(0).cast("long").alias("aid"), "id", "label", "v", none.alias("windows"))
    anchors = rows.where(F.col("id") % every == 0).withColumn("aid", F.xxhash64("id", "label", "v")).groupBy("aid", "id").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    anchors = scratch.keep(anchors, "anchors")

    def ask(who: DataFrame, names: str, answer: Callable) -> DataFrame:
        sent = who.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("asks"), "aid", "id", "label", "v", "windows")
        met = held.unionByName(sent).repartition("chunk").sortWithinPartitions("chunk", "asks")
        columns = names.split()
        return met.mapInArrow(_stream(width, columns, answer), ", ".join(f"{c} long" for c in columns))

    best = Window.partitionBy("aid").orderBy(F.desc("positive_score"), "positive_id")
    found = ask(anchors.withColumn("windows", none), "aid anchor_id positive_id positive_score", _positives(positives)).withColumn("w", F.row_number().over(best)).where(F.col("w") <= positives)
    # ceil(low / 100 s) and floor(high / 100 s), s = 100 t + r with 0 <= r < 100: no product leaves the long range
    r = F.pmod("positive_score", F.lit(100))
    t = F.call_function("div", F.col("positive_score") - r, F.lit(100))
    lo, hi = t * low + F.call_function("div", r * low + 99, F.lit(100)), t * high + F.call_function("div", r * high, F.lit(100))
    state = found.select("aid", "w", "positive_id", "positive_score", lo.alias("lo"), hi.alias("hi"), hi.alias("top"), F.lit(negatives).cast("long").alias("need")).where("lo <= hi")
    state = scratch.keep(state.withColumn("open", F.lit(True)), "state")
    fields = [f.split()[0] for f in _WINDOWS[len("array<struct<") : -2].split(", ")]

    def with_windows(windows: DataFrame) -> DataFrame:
        shift = radix.digit_shift(F.col("lo"), F.col("hi"), DIGIT).cast("int")
        each = windows.withColumn("shift", shift).withColumn("w", F.col("w").cast("int"))
        return anchors.join(each.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("windows")), "aid")  # at most ``positives`` windows an anchor

    while state.where("open").limit(1).count():
        going = state.where("open")
        hist = ask(with_windows(going), "aid w bucket n", _histogram).groupBy("aid", "w", "bucket").agg(F.sum("n").alias("n"))
        shifted = going.withColumn("shift", radix.digit_shift(F.col("lo"), F.col("hi"), DIGIT)).drop("open")
        at = radix.locate(hist.join(shifted.select("aid", "w", "need"), ["aid", "w"]), ["aid", "w"], "bucket", F.col("need")).join(shifted, ["aid", "w"])
        top = F.expr("hi - shiftleft(bucket, shift)")
        narrow = at.select(
            "aid", "w", "positive_id", "positive_score", F.greatest(F.col("lo"), top - F.expr("shiftleft(1L, shift)") + 1).alias("lo"), top.alias("hi"), "top",
            (F.col("need") - F.col("before")).alias("need"), ((F.col("n") + negatives - F.col("need") + F.col("before") > gather * negatives) & (F.col("shift") > 0)).alias("open"),
        )
        state = scratch.keep(narrow.unionByName(state.where("NOT open")), "state")
    met = ask(with_windows(state), "aid w positive_id positive_score negative_id negative_score", _gather(negatives))
    order = Window.partitionBy("aid", "w").orderBy(F.desc("negative_score"), "negative_id")
    kept = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each vector whose id 100 divides, every seventh vector under the next label; see mine()."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved))


QUERIES = {"op13_hard_negatives": op13_negatives}
SQL = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS vec_id, a.label = x.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
}
