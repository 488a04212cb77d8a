"""Harmonic packing of whole documents, with cuts only to fill what they leave.

Document lengths fall into reciprocal-capacity classes: class j has the lengths in (capacity / (j + 1), capacity / j], and a bin of the class
takes exactly j of its documents, so a document's bin follows from its number within its class alone and workers fill bins independently.

What a bin of whole documents leaves empty is filled with cut ones. A share of the documents, chosen by hash and just large enough for the
gaps, what is left of documents longer than a sequence after their full sequences, and what a class has beyond full bins are laid out as one
line of tokens; the gaps, and fresh sequences after them, are another. Where the two lines are laid on each other, each document is cut at
the ends of the gaps it lies over. Both lines are numbered by counts per bucket, and laid on each other cell by cell, so no task sees more than a cell.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, release, shuffle_partitions, table
from .sharding import with_slots
from .sstable import pack_ids, unpack_ids
from .units import Cache, slices, tokenizer_cache

CAPACITY, END_ID, CELL = 2048, 1, 1 << 20
#: Cut documents beyond what the gaps are expected to take, as a share of all: the rest fills sequences of its own.
SPARE = 0.005

_TOKENS = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def _encoded(batches: Iterator[pa.RecordBatch], cache: Cache, end: bytes, lean: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text", 1_000_000 if lean else 4_000_000):
            raws = [raw + end for raw in cache.texts(b["text"].to_pylist())]
            yield pa.record_batch([b["key"], b["rid"], [len(r) // 4 for r in raws], [zlib.crc32(r) for r in raws], [pack_ids(r) for r in raws]], schema=_TOKENS)
            if lean:
                give_back()


def tokens(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, lean: bool = False) -> DataFrame:
    """(key, rid, n, crc, ids) a row a document, end_id last; rid numbers the rows once the frame is written. ids: see sstable.pack_ids().

    lean: the same ids from less memory and in more time. A task takes a quarter of the text at once, knows half as many words and gives memory back.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = end_id.to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, tokenizer_cache(model.value, 200_000 if lean else 400_000), end, lean)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))
    return rows.mapInArrow(task, "key long, rid long, n long, crc long, ids binary")


def running_sum(df: DataFrame, value: str, order: str, name: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before this one, in some order that no task holds whole. ``order`` tells rows apart."""
    buckets = max(16, shuffle_partitions(df.sparkSession), df.count() // rows_per_bucket)
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("_b").agg(F.sum(value).alias("_s"))
    first = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_f"))  # a row a bucket
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(order)) - F.col(value)
    return dealt.withColumn("_i", inside).join(first, "_b").withColumn(name, (F.col("_f") + F.col("_i")).cast("long")).drop("_b", "_i", "_f")


def cut_share(fitting: dict[int, tuple[int, int]], left_over: int, capacity: int) -> float:
    """The share of fitting documents to cut, so that these and left_over tokens fill the gaps beside the others. fitting: {class: (documents, tokens)}."""
    held = sum(t for _, t in fitting.values())
    gaps = sum(n / j * capacity for j, (n, _) in fitting.items()) - held
    return min(1.0, max(0.0, (gaps - left_over) / (held + gaps) + SPARE)) if held else 1.0


def laid_over(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
    """Pieces (rid, start, length, sequence_id, offset) where documents f (rid, start, n, at) lie over gaps g (sequence_id, used, room, at) of one cell; both lines
    are without holes, and each row is cut to its cell already."""
    if f.empty or g.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rid", "start", "length", "sequence_id", "offset")})
    f, g = f.sort_values("at"), g.sort_values("at")
    p, q = f["at"].to_numpy(), g["at"].to_numpy()
    last = min(int((f["at"] + f["n"]).max()), int((g["at"] + g["room"]).max()))
    edges = np.unique(np.concatenate([p, q, [last]]))
    edges = edges[(edges >= max(p[0], q[0])) & (edges <= last)]
    s, length = edges[:-1], np.diff(edges)
    i, k = np.searchsorted(p, s, "right") - 1, np.searchsorted(q, s, "right") - 1
    return pd.DataFrame({"rid": f["rid"].to_numpy()[i], "start": f["start"].to_numpy()[i] + s - p[i], "length": length, "sequence_id": g["sequence_id"].to_numpy()[k], "offset": g["used"].to_numpy()[k] + s - q[k]})


def _in_cells(df: DataFrame, size: str, moved: str, cell: int) -> DataFrame:
    """Each row of a line once for every cell it touches, cut to it; ``moved`` grows by what is cut off before."""
    at, n = F.col("at"), F.col(size)
    d = df.withColumn("cell", F.explode(F.sequence(F.floor(at / cell), F.floor((at + n - 1) / cell))))
    low, high = F.greatest(at, F.col("cell") * cell), F.least(at + n, (F.col("cell") + 1) * cell)
    d = d.withColumns({"_l": low, "_n": high - low, "_m": F.col(moved) + low - at})
    return d.drop("at", size, moved).withColumnsRenamed({"_l": "at", "_n": size, "_m": moved})


def place(lens: DataFrame, capacity: int, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """(rid, start, length, sequence_id, offset) of every piece; lens: (rid, n), n at least 1. At most ``capacity`` rows, a class each, reach the driver."""
    spark = lens.sparkSession
    whole = F.col("n") <= capacity
    j = F.floor(F.lit(capacity) / F.col("n")).cast("int")
    rows = lens.select("rid", "n", F.when(whole, j).alias("class"))
    got = rows.groupBy("class").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.sum(F.col("n") % capacity).alias("rest")).collect()
    share = cut_share({r["class"]: (r["rows"], r["tokens"]) for r in got if r["class"]}, sum(r["rest"] for r in got if not r["class"]), capacity)
    cut = F.pmod(F.xxhash64("rid", F.lit("cut")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    kept = scratch.keep(with_slots(rows.where(whole & ~cut), "class", ["rid"], "number"), "kept")
    base, bins = [], 0
    for r in kept.groupBy("class").agg(F.count("*").alias("n")).orderBy("class").collect():
        base.append((r["class"], bins, r["n"] // r["class"]))
        bins += r["n"] // r["class"]
    classes = spark.createDataFrame(base, "class int, first long, full long")  # at most capacity rows
    binned = kept.join(F.broadcast(classes), "class").withColumn("bin", F.floor(F.col("number") / F.col("class")))
    full = binned.where("bin < full").select("rid", "n", (F.col("first") + F.col("bin")).alias("sequence_id"))
    inside = F.sum("n").over(Window.partitionBy("sequence_id").orderBy("rid"))
    placed = full.select("rid", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), "sequence_id", (inside - F.col("n")).alias("offset"))
    used = full.groupBy("sequence_id").agg(F.sum("n").alias("used")).withColumn("room", F.lit(capacity) - F.col("used")).where("room > 0")
    # full sequences of long documents
    long_ = scratch.keep(running_sum(rows.where(~whole).withColumn("times", F.floor(F.col("n") / capacity)), "times", "rid", "before"), "long")
    cut_up = long_.select("rid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times").cast("long") - 1)).alias("k"), "before")
    cut_up = cut_up.select("rid", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.lit(bins) + F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins += long_.agg(F.sum("times").alias("t")).first()["t"] or 0
    # the line of what is cut, and the line of the gaps with fresh sequences after them
    rests = long_.select("rid", (F.col("times") * capacity).alias("start"), (F.col("n") % capacity).alias("n")).where("n > 0")
    zero = F.lit(0).cast("long").alias("start")
    filler = rests.unionByName(rows.where(whole & cut).select("rid", zero, "n")).unionByName(binned.where("bin >= full").select("rid", zero, "n"))
    filler = scratch.keep(running_sum(filler, "n", "rid", "at"), "filler")
    gaps = scratch.keep(running_sum(used, "room", "sequence_id", "at"), "gaps")
    room, need = (d.agg(F.sum(c).alias("t")).first()["t"] or 0 for d, c in ((gaps, "room"), (filler, "n")))
    fresh = spark.range(max(0, -(-(need - room) // capacity))).select((F.lit(bins) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(capacity).cast("long").alias("room"), (F.lit(room) + F.col("id") * capacity).alias("at"))
    line = gaps.select("sequence_id", "used", "room", "at").unionByName(fresh)
    left = _in_cells(filler.select("rid", "start", "n", "at"), "n", "start", cell).groupBy("cell")
    right = _in_cells(line, "room", "used", cell).groupBy("cell")
    pieces = left.cogroup(right).applyInPandas(laid_over, "rid long, start long, length long, sequence_id long, offset long")
    return placed.unionByName(cut_up).unionByName(pieces)


_OUT = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end_id: int = END_ID, with_ids: bool = True, lean: bool = False) -> DataFrame:
    """(key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset), a row a piece.

    A null text is an empty one: one piece with end_id. Null and repeated keys are rows like any other; a very long text takes full sequences
    and one cut rest. An empty table gives no rows. Other columns are dropped. Sequences hold at most ``capacity`` ids; they are meant to be padded to it.
    lean: see tokens().
    """
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.keep(tokens(docs, tokenizer_json, key, text, end_id, lean), "tokens")
    pieces = place(made.select("rid", "n"), capacity, scratch)
    lists = scratch.keep(pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")), "pieces")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            cols: list[list] = [[] for _ in _OUT]
            put = [c.append for c in cols]
            for k, n, crc, packed, parts in zip(*(b[c].to_pylist() for c in ("key", "n", "crc", "ids", "pieces"))):
                raw = None if len(parts) == 1 and not with_ids else unpack_ids(packed)
                for x in parts:
                    part = None if raw is None else raw[4 * x["start"] : 4 * (x["start"] + x["length"])]
                    for f, v in zip(put, (k, x["start"], x["length"], part if with_ids else None, crc if part is None else zlib.crc32(part), n, x["sequence_id"], x["offset"])):
                        f(v)
            yield pa.record_batch(cols, schema=_OUT)

    named = lists.select(F.col("rid").alias("r"), "pieces")
    joined = made.join(named, made["rid"] == named["r"]).select("key", "n", "crc", "ids", "pieces")
    out = joined.mapInArrow(sliced, "key long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return (out if with_ids else out.drop("ids")).withColumnRenamed("key", key)


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 2048; see pack(). tokenizer: path of a tokenizers JSON."""
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return pack(table(spark, sf_dir, "documents"), f.read(), with_ids=False)


QUERIES = {"op5_harmonic_packing": op5_packing}
SQL: dict[str, str] = {}
