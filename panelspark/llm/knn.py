"""Exact top-k by inner product: a Voronoi kNN join.

Vectors belong to the cell of their nearest pivot. With d = |x - p| the score obeys q.p - |q| d <= q.x <= q.p + |q| d, so a cell's summary (its size,
largest and few smallest d) bounds every score in it. A query's k-th best lower bound over all cells is a score it is sure to reach;
it is sent to the cells whose upper bound is not below that, and to no other. Cells are cut into chunks of bounded size. Each vector is sent
once, to its chunk; a task holds one chunk at a time and the queries sent there stream by, a matrix product a batch. The local winners
are merged. Pruning depends on the data; the result does not.

Pivots come from a sample of at most SAMPLE vectors (the smallest id hashes); all vectors are assigned, summarised and searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, table

PIVOTS, SAMPLE, ROUNDS, CHUNK, QUERY_BLOCK = 64, 4096, 5, 20_000, 1_000_000
EXACT = float(1 << 53)
OWN = 64


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """(id, v), and ``label`` as a string if asked for: v is floor(scale * x) of each component, as doubles, the largest double where scale * x leaves their range. Rows with a null
    id, a null vector, or a null or non-finite component go."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & x.isNotNull() & ~bad)
    # a double, not floor()'s long: huge components stay finite; below 2^53 they are exact integers
    most = F.lit(1.7976931348623157e308)
    scaled = lambda c: F.greatest(F.least(c.cast("double") * scale, most), -most)
    whole = lambda c: F.when(F.abs(scaled(c)) < EXACT, scaled(c) - F.pmod(scaled(c), F.lit(1.0))).otherwise(scaled(c))
    more = [F.col(label).cast("string").alias("label")] if label else []
    return kept.select(F.col(key).cast("long").alias("id"), *more, F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.flatten(), float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width)), 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """A few Lloyd rounds over a bounded sample."""
    got = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    x = np.zeros((len(got), width))
    for i, r in enumerate(got):
        x[i, : len(r["v"])] = r["v"]
    x = np.unique(x, axis=0)
    p = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)] if len(x) else np.zeros((1, width))
    for _ in range(ROUNDS if len(x) else 0):
        near = _distances(x, p).argmin(1)
        for c in range(len(p)):
            if (near == c).any():
                p[c] = x[near == c].mean(0)
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond the long range they are cut to it."""
    most = (np.abs(q).max(initial=0) or 1) * (np.abs(x).max(initial=0) or 1) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(big(q) @ big(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(own: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best of one chunk, ids ascending; ties go to the smaller id; rows of the query's own id don't count."""
    out = []
    for i, q in enumerate(own):
        rest = np.flatnonzero(ids != q)
        s = score[i, rest]
        n = min(k, len(rest))
        if n:
            floor = np.partition(s, len(s) - n)[len(s) - n]
            above, level = np.flatnonzero(s > floor), np.flatnonzero(s == floor)
            near = rest[np.concatenate([above, level[: n - len(above)]])]
            out.append((np.repeat(q, n), ids[near], score[i, near]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _solver(width: int, k: int):
    """Of a task's rows, sorted by (block, cell, chunk, asks): the vectors of a chunk, then the queries sent to it, a batch at a time."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_ids, held, xs, ids = None, [], [], None, None
        for b in batches:
            place = np.stack([b[c].to_numpy() for c in ("block", "cell", "chunk", "asks")], 1)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1), True])
            for i, z in zip(edges, edges[1:]):
                here, asks, part = tuple(place[i, :3].tolist()), place[i, 3], b.slice(i, z - i)
                if here != at:
                    at, held_ids, held, xs = here, [], [], None
                if not asks:
                    held_ids.append(part["id"].to_numpy()), held.append(_matrix(part["v"], width))
                    continue
                if xs is None:
                    ids = np.concatenate(held_ids) if held_ids else np.zeros(0, np.int64)
                    order = np.argsort(ids, kind="stable")
                    xs, ids = (np.concatenate(held) if held else np.zeros((0, width)))[order], ids[order]
                    held_ids, held = [], []
                own, q = part["id"].to_numpy(), _matrix(part["v"], width)
                for s in range(0, len(own), 256):
                    found = _best(own[s : s + 256], _scores(q[s : s + 256], xs), ids, k)
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return solve


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, chunk: int = CHUNK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the k best of the other rows.

    Ties go to the smaller id. Rows that share the query's id are not its candidates and ask together: of their scores the k best; rows without an id take no part; a missing component counts as
    zero. Fewer rows than k give all. An empty table gives no rows; other columns are ignored. Vectors are sent once for every ``query_block``
    queries, so that no chunk's task has more than these to answer.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    rows = quantised(vectors, scale, key, vector)
    p = choose_pivots(rows, pivots)
    width = p.shape[1]
    model = spark.sparkContext.broadcast(p)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                d = _distances(_matrix(part["v"], width), model.value)
                cell = d.argmin(1)
                yield pa.record_batch([part["id"], part["v"], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["id", "v", "cell", "d"])

    placed = scratch.keep(rows.mapInArrow(assign, "id long, v array<double>, cell int, d double"), "placed")
    queries = placed.where(F.col("id") % every == 0)
    asked = queries.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("ids"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    # of the best bounds as many may be of the query's own rows as rows share an id; beyond OWN of them nothing is pruned
    own = min(asked["most"] or 1, OWN + 1)
    # summaries: the least distances of a cell by a two-step top-k that keeps no cell in one task
    salted = placed.select("cell", "d", F.pmod(F.xxhash64("id"), F.lit(max(8, shuffle_partitions(spark)))).alias("s"))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("cell", "s").orderBy("d"))).where(F.col("n") <= k + own)
    least = few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("d")), 1, k + own).alias("least"))
    wide = placed.groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("n"))
    summary = [r.asDict() for r in wide.join(least, "cell").collect()]  # a row a pivot
    total = sum(s["n"] for s in summary)
    size = min(chunk, max(128, total // (2 * shuffle_partitions(spark))))
    blocks = max(1, -(-(asked["rows"] or 0) // query_block))
    bounds = spark.sparkContext.broadcast((summary, k + own - 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = bounds.value
        if not cells:
            return
        at = np.array([s["cell"] for s in cells])
        r = np.array([s["r"] for s in cells])
        chunks = np.array([-(-s["n"] // size) for s in cells])
        of, ds = np.concatenate([[i] * len(s["least"]) for i, s in enumerate(cells)]).astype(int), np.concatenate([s["least"] for s in cells])
        for b in batches:
            for from_ in range(0, b.num_rows, 1024):
                part = b.slice(from_, 1024)
                q = _matrix(part["v"], width)
                norm = np.sqrt((q * q).sum(1))
                mid = q @ model.value[at].T
                low = mid[:, of] - norm[:, None] * ds
                # with one row an id, the (k + 1)-th best bound: one of the best may be the query itself
                sure = -np.partition(-low, n, axis=1)[:, n] if low.shape[1] > n and own <= OWN else np.full(len(q), -np.inf)
                slack = 1e-9 * (np.abs(mid).max(1, initial=1) + norm * (r.max(initial=0) + 1))
                i, c = np.nonzero(mid + norm[:, None] * r >= (sure - slack)[:, None])
                rep = chunks[c]
                rows_at, cell = np.repeat(i, rep), np.repeat(at[c], rep)
                numbers = np.concatenate([np.arange(x) for x in rep]) if len(rep) else np.zeros(0, int)
                for s in range(0, len(rows_at), 10_000):
                    z = slice(s, s + 10_000)
                    picked = part.take(pa.array(rows_at[z]))
                    yield pa.record_batch([picked["id"], picked["v"], pa.array(cell[z], pa.int32()), pa.array(numbers[z], pa.int32())], names=["id", "v", "cell", "chunk"])

    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    sent = queries.select("id", "v").mapInArrow(send, "id long, v array<double>, cell int, chunk int").select("id", "v", block.alias("block"), "cell", "chunk", F.lit(1).alias("asks"))
    chunk_count = F.element_at(F.array(*[F.lit(-(-n // size)) for n in _dense(summary, len(p))]), F.col("cell") + 1)
    held = placed.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", F.pmod(F.xxhash64("id", F.lit("chunk")), chunk_count).cast("int").alias("chunk"), F.lit(0).alias("asks"))
    met = held.unionByName(sent).repartition("block", "cell", "chunk").sortWithinPartitions("block", "cell", "chunk", "asks")
    local = met.mapInArrow(_solver(width, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(summary: list[dict], cells: int) -> list[int]:
    out = [1] * max(1, cells)
    for s in summary:
        out[s["cell"]] = s["n"]
    return out


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best for each vector whose id 50 divides; see top_k()."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_voronoi_top_k": op8_top_k}
SQL = {
    "op8_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(x.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
