"""Repeated passages by sampled shingles and the windows around them.

1. Anchors: of every WINDOW consecutive GRAM-word shingles the one with the least hash is kept. What is kept depends on the words around it
   only, and every passage of LEAST = GRAM + WINDOW - 1 words or more holds an anchor, the same one wherever it stands.
2. Windows: every LEAST words in a row whose anchor's shingle stands twice become a row: a 64-bit hash of the words, 32 bits of the shingle's hash, document
   and place. Two places share LEAST words if and only if they share such a window, so no pair is missed, however many others share the shingle.
3. Windows are sorted by range on window and place. The key is unique, so no window, however common, is one task's. A task tells of each window's
   places which is first; windows that lie over a border of tasks are told from the first and last window of each task.
4. A window of two documents is repeated. Its first place, by (document, word), is kept; the others may go: a word goes only if an earlier place
   holds a window around it. A longer passage is the union of its windows.

A document is a key and a text: rows that share a key, or have none, are told apart by their texts. Keys ascend, null ones come last; under one key the
texts' hashes decide. Equal texts are handled once, under their digest: of several, all but the first repeat in whole.

Why windows and not each anchor's neighbours in a sorted suffix array: the neighbour that agrees longest to the right need not agree to the left. Two
texts that share 30 words before a common sentence of 20, with other texts sorted between them, would be missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import Scratch, give_back, release, sealed, shuffle_partitions, table, unsealed
from .units import slices

GRAM, WINDOW = 10, 41
LEAST = GRAM + WINDOW - 1
LAST_ID = (1 << 63) - 1
TASK_ROWS = 1_000_000  # windows that a task sorts
_MULT = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(LEAST)], np.uint64)
_WORD = re.compile(r"\S+")


class WordHash:
    """64-bit hashes of words; a cache, emptied when full."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n consecutive elements."""
    size, out = 1, x
    while size * 2 <= n:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words from their hashes h."""
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g += h[i : i + m] * _MULT[i]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    return g


def anchors(h: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and shingle hashes of the anchors in word hashes h. Texts under gram + window - 1 words have none."""
    n = len(h) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _mixed(h, gram)
    least = _slide(g, window, np.minimum)
    # i is an anchor if the least of some window over it is its own: the greatest of those leasts equals g[i]
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, window, np.maximum) == g)
    if len(at) > 1 and ((np.diff(at) < window) & (g[at[1:]] == g[at[:-1]])).any():  # periodic text: one in each window is enough
        kept = [int(at[0])]
        for i in at[1:].tolist():
            if g[i] != g[kept[-1]] or i - kept[-1] >= window // 2:
                kept.append(i)
        at = np.array(kept)
    return at, g[at].view(np.int64)


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _document(key: str):
    """A key and whether it is null, in the order of documents."""
    return F.struct(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(key).isNull().alias("none"))


def _text_id(uid: str, none: str):
    """63 bits of a text's hash under a sign that puts texts of null keys after those of the greatest key."""
    h = F.xxhash64(uid)
    return F.when(F.col(none), h.bitwiseAND(F.lit(LAST_ID))).otherwise(h.bitwiseOR(F.lit(-LAST_ID - 1)))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    hashed = WordHash()
    for b in batches:
        for from_ in range(0, b.num_rows, 500):
            part = b.slice(from_, 500)
            of, places, grams = [], [], []
            for i, t in enumerate(part["text"].to_pylist()):
                words = (t or "").split()
                if len(words) >= LEAST:
                    at, g = anchors(hashed(words))
                    of.append(np.full(len(at), i)), places.append(at), grams.append(g)
            if of:
                yield pa.record_batch([part["uid"].take(pa.array(np.concatenate(of))), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(grams))], names=["uid", "pos", "gram"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor's shingle is one of grams. at: the shingle's upper 32 bits, then the place."""
    release()
    hashed = WordHash()
    for b in batches:
        for from_ in range(0, b.num_rows, 100):
            part = b.slice(from_, 100)
            out = []
            for t, first, text, grams in zip(part["text"].to_pylist(), part["first"].to_pylist(), part["id"].to_pylist(), part["grams"].to_pylist()):
                h = hashed(t.split())
                least = _slide(_mixed(h, GRAM), WINDOW, np.minimum)
                pos = np.flatnonzero(np.isin(least, np.array(grams, np.int64).view(np.uint64)))
                at = (least[pos] >> np.uint64(32) << np.uint64(32)) + pos.astype(np.uint64)
                out.append((_mixed(h, LEAST)[pos].view(np.int64), at.view(np.int64), np.full(len(pos), first), np.full(len(pos), text)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["window", "at", "first", "id"])


_PLACE = "first long, id long, pos int"
_MATCH_SQL = f"kind int, window long, gram int, {_PLACE}, low_first long, low_id long, low_pos int, high_first long, high_id long, high_pos int, goes boolean"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_MATCH = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in _MATCH_SQL.split(", "))])


def _grouped(within: bool):
    """Of a task's sorted windows: places of those that stand twice and whether they go (kind 0, with the first place of each); the places of the task's
    first and last window, which others may share (kind 1); and one row of each of these two with its first and last place (kind 2)."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        data = list(batches)
        if not sum(b.num_rows for b in data):
            return
        window, at, first, text = (np.concatenate([b[c].to_numpy() for b in data]) for c in ("window", "at", "first", "id"))
        data.clear()
        gram, pos = (at >> 32).astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32)
        order = np.lexsort((pos, text, first, gram, window))
        window, gram, first, text, pos = window[order], gram[order], first[order], text[order], pos[order]
        starts = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (gram[1:] != gram[:-1])])
        ends = np.r_[starts[1:], len(window)]
        of = np.repeat(np.arange(len(starts)), ends - starts)
        # the range sort is by (window, at, ...): all of a window's places with one shingle stand together, so borders are a task's first and last
        edge = np.zeros(len(starts), bool)
        edge[window[starts] == window[0]] = edge[window[starts] == window[-1]] = True
        other = lambda a, b: (first[a] != first[b]) | (text[a] != text[b])
        place = lambda i, part="": {f"{part}first": first[i], f"{part}id": text[i], f"{part}pos": pos[i]}

        def rows(kind: int, i: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
            columns |= place(i) | place(starts[of[i]], "low_") | {"kind": np.full(len(i), kind, np.int32)}
            return pa.record_batch([pa.array(columns[f.name]) if f.name in columns else pa.nulls(len(i), f.type) for f in _MATCH], schema=_MATCH)

        for from_ in range(0, len(window), 100_000):
            i = np.arange(from_, min(from_ + 100_000, len(window)))
            low, high, border = starts[of[i]], ends[of[i]] - 1, edge[of[i]]
            many, far = other(low, high), pos[i] - pos[low] >= LEAST
            if within:
                many = many | far | (pos[high] - pos[i] >= LEAST)
            told = many & ~border
            yield rows(0, i[told], goes=(other(i, low) | far)[told])
            b = i[border]
            yield rows(1, b, window=window[b], gram=gram[b], **place(high[border], "high_"))
        b = starts[edge]
        yield rows(2, b, window=window[b], gram=gram[b], **place(ends[edge] - 1, "high_"))

    return grouped


def _met(windows: DataFrame, scratch: Scratch, within: bool) -> DataFrame:
    """(first, id, pos, goes, root): repeated windows by place; goes: an earlier place has it; root: the key of its first place's document."""
    spark = windows.sparkSession
    tasks = max(shuffle_partitions(spark), -(-windows.count() // TASK_ROWS))
    sorted_ = windows.repartitionByRange(tasks, "window", "at", "first", "id").mapInArrow(_grouped(within), _MATCH_SQL)
    met = scratch.keep(sorted_, "matches")
    scratch.drop(windows)
    # a row each of the windows at the tasks' borders, mostly two a task, so it can be broadcast; no other task holds a window that is not in it
    ends = [F.struct(*[f"{side}_{c}" for c in ("first", "id", "pos")]) for side in ("low", "high")]
    over = met.where("kind = 2").groupBy("window", "gram").agg(F.min(ends[0]).alias("low"), F.max(ends[1]).alias("high"))
    over = scratch.keep(over, "over")
    low, high = F.col("low"), F.col("high")
    many = (low["low_first"] != high["high_first"]) | (low["low_id"] != high["high_id"])
    far = (F.col("pos") - low["low_pos"]) >= LEAST
    if within:
        many |= far | ((high["high_pos"] - F.col("pos")) >= LEAST)
    # a place that overlaps the first one stays: what it would lose is the first place's own
    goes = (F.col("first") != low["low_first"]) | (F.col("id") != low["low_id"]) | far
    places = met.where("kind < 2").join(F.broadcast(over), ["window", "gram"], "left").where((F.col("kind") == 0) | many)
    first = [F.coalesce(low[c], c).alias(c) for c in ("low_first", "low_id")]
    told = places.select("first", "id", "pos", F.coalesce("goes", goes).alias("goes"), *first)
    return told.select("first", "id", "pos", "goes", F.when(F.col("low_id") < 0, F.col("low_first")).alias("root"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """A table by text digest, of texts that stand twice or hold repeated windows: (uid, first, none, copies, pos, goes, root), the last three arrays with
    an element a repeated window, places ascending, see _met(). first, none: the first document's key and whether that is null."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    rows = docs.select(_document(key).alias("d"), _digest(text).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.groupBy("uid").agg(F.min("d").alias("d"), F.count("*").alias("copies"))
    copies = scratch.keep(counted.select("uid", F.col("d.doc").alias("first"), F.col("d.none").alias("none"), "copies"), "copies")
    rows = rows.select(F.col("d.doc").alias("doc"), "uid", "text")
    found = scratch.keep(rows.select("uid", "text").mapInArrow(_find, "uid binary, pos int, gram long").distinct(), "anchors")
    # a table, not a plan: with an exchange on either side the planner can split a shingle that a third of the anchors share
    twice = scratch.keep(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("g")), "twice")
    places = found.join(twice, found["gram"] == twice["g"]).groupBy("uid").agg(F.collect_set("gram").alias("grams"))
    named = copies.select("uid", "first", _text_id("uid", "none").alias("id"))
    wanted = places.join(named, "uid").select(F.col("uid").alias("u"), "first", "id", "grams")
    texts = rows.join(wanted, (rows["doc"] == wanted["first"]) & (rows["uid"] == wanted["u"])).dropDuplicates(["uid"]).select("text", "first", "id", "grams")
    windows = scratch.keep(texts.mapInArrow(_windows, "window long, at long, first long, id long"), "windows")
    scratch.drop(found, twice)
    mark = F.struct("pos", "goes", "root")
    marks = _met(windows, scratch, within).groupBy("first", "id").agg(F.sort_array(F.collect_list(mark)).alias("m"))
    spans = marks.select(F.col("first").alias("f"), "id", F.col("m.pos").alias("pos"), F.col("m.goes").alias("goes"), F.col("m.root").alias("root"))
    spans = spans.join(named, (spans["f"] == named["first"]) & (spans["id"] == named["id"])).select("uid", "pos", "goes", "root")
    spans = scratch.keep(spans, "spans")
    scratch.drop(*scratch.named("matches"), *scratch.named("over"))
    both = copies.join(spans, "uid", "left").where((F.col("copies") > 1) | F.col("pos").isNotNull())
    return scratch.keep(both, "told")  # a table: joins with it have an exchange on either side, so that many copies of a text can be split


def _joined(pos: np.ndarray) -> list[list[int]]:
    """Union of the windows at ascending places."""
    if not len(pos):
        return []
    new = np.flatnonzero(np.diff(pos) > LEAST) + 1
    return np.stack([pos[np.r_[0, new]], pos[np.r_[new - 1, len(pos) - 1]] + LEAST], 1).tolist()


def find_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """(key, whole_copy_of, spans, cut_spans, partners), a row a document that shares LEAST words in a row with another place.

    spans: its repeated word spans [start, end); cut_spans: those another place holds first; partners: the documents with those first
    places, ascending, one without a key as a null at the end. whole_copy_of: the first document with the very text, null for that one and for
    texts of their own; a copy's spans are those of its text. Texts under LEAST words, null and empty ones never appear. A null key counts as
    after all others. Rows of one key, or of none, are documents of their own if their texts differ, and one document if they don't. Repeats of
    a text within itself count only with ``within``, if they don't overlap. A very long text is read whole, by one task at a time; its windows
    are dealt like all others. Other columns are dropped.
    """
    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [None if p is None else _joined(p[g.astype(bool)]) for p, g in zip(b["pos"], b["goes"])]
            yield b[["uid", "first", "none", "copies", "partners"]].assign(spans=[None if p is None else _joined(p) for p in b["pos"]], cut_spans=cut)

    kinds = "uid binary, first long, none boolean, copies long, partners array<string>, spans array<array<int>>, cut_spans array<array<int>>"
    gone = F.transform(F.filter(F.arrays_zip("goes", "root"), lambda x: x["goes"]), lambda x: x["root"])
    # as text, since a null among numbers would make them doubles in pandas
    told = repeated(docs, key, text, within).withColumn("partners", F.array_sort(F.array_distinct(gone)).cast("array<string>"))
    by_text = told.drop("root").mapInPandas(tidy, kinds).withColumn("partners", F.col("partners").cast("array<long>"))
    long_enough = F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")) >= LEAST
    rows = docs.select(F.col(key), _digest(text).alias("u"), long_enough.alias("long_enough"))
    out = rows.join(by_text, rows["u"] == by_text["uid"]).where(F.col("long_enough"))
    copy = (F.col("copies") > 1) & (_document(key) != F.struct(F.col("first").alias("doc"), F.col("none")))
    return out.select(key, F.when(copy, F.col("first")).alias("whole_copy_of"), "spans", "cut_spans", "partners")


def cut_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """docs without the passages that another place holds first, nor whole copies but the first; texts left without a word go.

    Documents without repeated passages pass unchanged, nulls and empty texts too. Rows of one key and text count as one, null keys too: all stay or
    go. Rows of one key and different texts lose what they share as those of two keys do. A very long text is cut whole, by one task.
    """
    body, doc = F.coalesce(F.col(text), F.lit("")), _document(key)
    enough = F.size(F.split(F.trim(body), r"\s+")) >= LEAST
    rows = sealed(docs, doc=doc, uid=_digest(text), text=F.col(text), enough=enough)
    rows = rows.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != text]))
    gone = F.transform(F.filter(F.arrays_zip("pos", "goes"), lambda x: x["goes"]), lambda x: x["pos"])
    first = F.struct(F.col("first").alias("doc"), F.col("none"))
    by_text = repeated(docs, key, text, within).select(F.col("uid").alias("u"), first.alias("first"), "copies", gone.alias("cut"))
    joined = rows.join(by_text, rows["uid"] == by_text["u"], "left")
    kept = joined.where(~F.coalesce((F.col("copies") > 1) & (F.col("doc") != F.col("first")) & F.col("enough"), F.lit(False))).select("row", "text", "cut")
    kind = StructType([StructField("row", kept.schema["row"].dataType), StructField("text", StringType()), StructField("empty", BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (part for batch in batches for part in slices(batch, "text", 1_000_000)):
            texts, empty = b["text"].to_pylist(), []
            for i, pos in enumerate(b["cut"].to_pylist()):
                spans = _joined(np.array(pos)) if pos else []
                if spans:
                    t, parts, here = texts[i], [], 0
                    at = [w.span() for w in _WORD.finditer(t)]
                    for a, z in spans:
                        parts.append(t[here : at[a][0]])
                        here = at[z][0] if z < len(at) else len(t)
                    texts[i] = "".join(parts) + t[here:]
                empty.append(bool(spans) and not texts[i].strip())
            yield pa.record_batch([b["row"], pa.array(texts, pa.string()), pa.array(empty)], names=["row", "text", "empty"])
            give_back()

    return unsealed(kept.mapInArrow(cut, kind).where("NOT empty"), docs.columns, **{text: F.col("text")})


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 50 words in a row with another; see find_passages()."""
    return find_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op4_repeated_passages": op4_passages}
SQL: dict[str, str] = {}
