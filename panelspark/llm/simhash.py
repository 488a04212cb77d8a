"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a 64-bit fingerprint gets a vector m(i) of r + 1 bits. Table v (every non-zero vector) keeps the bits with
<m(i), v> = 1 over GF(2). r differing bits span at most r dimensions, so some v is orthogonal to them all: that table
drops every differing bit, and the two fingerprints meet in it (Pagh 2016). No pair within the radius is missed.
The vectors are chosen so that each table keeps about half the bits: a simplex code for small radii, the first-order
Reed-Muller code for radius 6.

Only distinct fingerprints enter the tables, 16 bytes a row. A bucket is solved in blocks with numpy, which emits a spanning
forest of its links, never its pairs. A bucket larger than BLOCK is cut into blocks and its pairs of blocks go to tasks
of their own: exact, and no task sees more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, components, release, sealed, shuffle_partitions, table, unsealed

BITS, SEED, BLOCK, FLUSH = 64, 42, 20_000, 2_000_000


def fingerprint(text: str | None, words: int, distinct: bool = False) -> int:
    """Unsigned fingerprint of the text's word shingles; 0 without words. distinct: each shingle counts once."""
    w = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    elif words == 1:
        shingles = w
    else:
        joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]).tolist()
        starts = [0, *ends]
        shingles = [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :])]
    if distinct:
        shingles = list(set(shingles))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            fp = np.array([fingerprint(t, words, distinct) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": b["key"], "fp": fp})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def masks(radius: int) -> list[int]:
    """The kept bits of each table, as signed longs."""
    if not 0 <= radius <= 6:
        raise ValueError("radius is 0 to 6")
    n = 1 << (radius + 1)
    vector = [64 + i if radius == 6 else i % (n - 1) + 1 for i in range(BITS)]
    out = []
    for v in range(1, n):
        m = sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A star a component of the links a-b: (node, least node)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        fresh = root.copy()
        np.minimum.at(fresh, root[x], low)
        np.minimum.at(fresh, root[y], low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, root):
            break
        root = fresh
    moved = root != np.arange(len(nodes))
    return pa.record_batch({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})


def _solver(radius: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts = [(b["g"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if not parts:
            return
        g, fp = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(g, kind="stable")
        g, fp = g[order], fp[order]
        bits = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0
        # small buckets all at once: element i against element i + d of its bucket
        last = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 256), sizes))
        d = 1
        while len(at):
            at = at[at + d < last[at]]
            near = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= radius]
            left.append(fp[near]), right.append(fp[near + d])
            held += len(near)
            d += 1
            if held > FLUSH:
                yield _forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        for s, n in zip(starts[sizes > 256], sizes[sizes > 256]):
            x = bits[s : s + n]
            step = max(1, 4_000_000 // n)
            for i in range(0, n, step):
                p, q = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ x[None, i:]) <= radius)
                keep = p < q
                left.append(x[i + p[keep]].view(np.int64)), right.append(x[i + q[keep]].view(np.int64))
                held += int(keep.sum())
                if held > FLUSH:
                    yield _forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
        if held:
            yield _forest(np.concatenate(left), np.concatenate(right))

    return solve


def links(distinct: DataFrame, radius: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within the radius do. distinct: unique fp long."""
    kept = masks(radius)
    # 31 or 127 arguments of one hash a table: the table's number and the kept bits
    keyed = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(kept)])).alias("g"))
    # Which buckets may be large: counted over one fingerprint in 16, chosen by hash; this plans the work and drops nothing
    probe = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(16)) == 0)
    counted = probe.select(F.explode(F.array(*[F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(kept)])).alias("g"))
    large = counted.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= max(block // 32, 1))
    large = scratch.keep(large.select("g", F.ceil(F.col("n") * 16 / F.lit(block)).cast("int").alias("blocks")), "large")
    if large.limit(1).count():
        own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        joined = keyed.join(large, "g", "left")  # the planner broadcasts the list if it is small, and can split a hot bucket if not
        mates = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))
        paired = joined.withColumn("own", own).withColumn("mate", F.explode(mates))
        low, high = F.least("own", "mate"), F.greatest("own", "mate")
        keyed = paired.select("fp", F.when(F.col("mate") < 0, F.col("g")).otherwise(F.xxhash64("g", low, high)).alias("g"))
    return keyed.repartition("g").mapInArrow(_solver(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text", distinct_shingles: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, fp, component_id) for every row of docs.

    component_id: the least key reachable by links of at most ``radius`` bits, the row's own included. Null and empty texts have
    fingerprint 0 and are linked like any other; null keys are never the least unless a component has no other. Very long texts are hashed
    whole. An empty table gives no rows; other columns are dropped.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, words, key, text, distinct_shingles), "fp")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius, scratch, block), scratch)
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = scratch.keep(linked.join(least, "root").select("fp", "least"), "moved")
    named = nodes.join(moved, "fp", "left").select(F.col("fp").alias("f"), F.coalesce("least", "first").alias("component_id"))
    named = scratch.keep(named, "named")
    return rows.join(named, rows["fp"] == named["f"]).select(key, "fp", "component_id")


def shingle_set(text: str, words: int) -> bytes:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles))).tobytes()


def shingler(words: int):
    """For mapInPandas: ``text`` gives way to ``sh``, its shingle set."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sh=[shingle_set(t, words) for t in b["text"]]).drop(columns="text")

    return shingled


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared)


def _alike(a: bytes, others: list[bytes], least: float) -> bool:
    """Whether a is as like as that to any of others; sizes settle most pairs."""
    return any(min(len(a), len(b)) >= least * max(len(a), len(b)) and jaccard(a, b) >= least for b in others)


class Shingles:
    """Sorted distinct hashes of a text's word shingles from hashes of its words: what shingle_set() tells apart, at a part of its cost."""

    def __init__(self, words: int, most: int = 200_000):
        self.words, self.most, self.known = words, most, {}
        self.mult = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(words)], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        w, known = text.encode().lower().split(), self.known
        if len(known) > self.most:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x, SEED)
        h = np.fromiter((known[x] for x in w), np.uint64, len(w))
        n = max(1, len(h) - self.words + 1)
        g = np.zeros(n, np.uint64)
        for i in range(min(self.words, len(h))):
            g += h[i : i + n] * self.mult[i]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(g ^ (g >> np.uint64(29)))


def _meet(similarity: float):
    """Pairs of one bucket (g) whose sizes and places (np: set's size << 32 | place of the shared shingle in the set's order) allow that Jaccard."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts = [[b[c].to_numpy() for c in ("g", "id", "comp", "np")] for b in batches]
        if not parts:
            return
        g, doc, comp, both = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((both, g))
        g, doc, comp, both = g[order], doc[order], comp[order], both[order]
        n, place = both >> 32, both & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        last = np.repeat(np.r_[starts[1:], len(g)], np.diff(np.r_[starts, len(g)]))
        held, kept, d = 0, [], 1
        at = np.arange(len(g))

        def flush() -> pa.RecordBatch:
            a, b = np.unique(np.concatenate(kept, 1), axis=1)
            kept.clear()
            return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        while len(at):
            at = at[at + d < last[at]]
            at = at[n[at] >= similarity * n[at + d] - 1e-6]  # sizes ascend in a bucket: later ones are no nearer
            j = at + d
            most = np.minimum(n[at] - place[at], n[j] - place[j])  # shared ones, if this is the first
            ok = (comp[at] != comp[j]) & (most * (1 + similarity) >= similarity * (n[at] + n[j]) - 1e-6)
            a, b = doc[at[ok]], doc[j[ok]]
            kept.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            held += len(a)
            d += 1
            if held > FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    return solve


MAP_BITS = 4096


def _bitmap(s: np.ndarray) -> bytes:
    """A bit for every element's hash modulo MAP_BITS."""
    out = np.zeros(MAP_BITS, np.uint8)
    out[s & np.uint64(MAP_BITS - 1)] = 1
    return np.packbits(out).tobytes()


def _may(similarity: float):
    """Pairs that may be as like as that: each bit in which two bitmaps differ is an element of one set only, so sets of m and n whose maps differ in d bits share
    (m + n - d) / 2 at most. What goes cannot reach the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("lbits", "rbits"))
            total = b["ln"].to_numpy().astype(np.int64) + b["rn"].to_numpy()
            most = (total - np.bitwise_count(x ^ y).sum(1).astype(np.int64)) // 2
            ok = most >= similarity * (total - most) - 1e-6
            yield pa.record_batch([b[c].filter(pa.array(ok)) for c in ("a", "b", "lcomp", "rcomp")], names=["a", "b", "lcomp", "rcomp"])

    return keep


def alike_links(texts: DataFrame, words: int, similarity: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): components that hold two texts whose shingles' Jaccard is at least ``similarity``. texts: uid, comp, text; a uid a text.

    Exact, by prefixes: sets of m and n shingles that alike share one of the first n - ceil(similarity n) + 1 of each in any one order of
    all shingles. The order is by hash, with those that are frequent in a sample of texts last, so that common ones seldom decide; the sample
    drops nothing. A frequent shingle's bucket is cut into blocks and its pairs of blocks go to tasks of their own. Pairs that meet are
    compared in whole.
    """
    share = max(32, texts.count() // 20_000)
    name = F.xxhash64("uid")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        sets = Shingles(words)
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"s": sets(t).view(np.int64)})

    sample = texts.where(F.pmod(name, F.lit(share)) == 0).select("text").mapInPandas(seen, "s long")
    counted = sample.groupBy("s").agg(F.count("*").alias("n")).where("n >= 8").toPandas()  # at most an eighth of 20,000 texts' shingles
    often = counted["s"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(often)
    shared = texts.sparkSession.sparkContext.broadcast((often[by], counted["n"].to_numpy(np.int64)[by] * share))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sets, (often, counts) = Shingles(words), shared.value
        for b in batches:
            for from_ in range(0, b.num_rows, 200):
                part = b.slice(from_, 200)
                out = []
                for doc, comp, t in zip(part["id"].to_pylist(), part["comp"].to_pylist(), part["text"].to_pylist()):
                    s = sets(t)
                    n = len(s)
                    count = np.zeros(n, np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        count = np.where(often[at] == s, counts[at], 0)
                    order = np.lexsort((s, count))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                    g, place = s[order], np.arange(len(order))
                    blocks = -(-count[order] // block)
                    if (blocks > 1).any():
                        pieces = [(g[blocks <= 1], place[blocks <= 1])]
                        for x, i, k in zip(g[blocks > 1].tolist(), place[blocks > 1].tolist(), blocks[blocks > 1].tolist()):
                            own = doc % k
                            pairs = np.array([min(own, m) * k + max(own, m) + 1 for m in range(k)], np.uint64)
                            pieces.append((np.uint64(x) ^ pairs * np.uint64(0x9E3779B97F4A7C15), np.full(k, i)))
                        g, place = (np.concatenate(x) for x in zip(*pieces))
                    out.append((g, np.full(len(g), doc), np.full(len(g), comp), (n << 32) + place))
                g, doc, comp, both = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch({"g": pa.array(g.view(np.int64)), "id": pa.array(doc), "comp": pa.array(comp), "np": pa.array(both)})

    keyed = texts.select(name.alias("id"), F.xxhash64("comp").alias("comp"), "text").mapInArrow(prefixes, "g long, id long, comp long, np long")
    pairs = scratch.keep(keyed.repartition("g").mapInArrow(_meet(similarity), "a long, b long").distinct(), "pairs")
    def of(links_: DataFrame) -> DataFrame:
        """The texts that links name; the narrow list of names meets them by uid, so that texts dealt by it stay where they are."""
        wanted = links_.select(F.col("a").alias("i")).unionByName(links_.select(F.col("b").alias("i"))).distinct()
        known = scratch.keep(texts.select(F.col("uid").alias("u"), name.alias("id")).join(wanted, F.col("id") == F.col("i"), "left_semi"), "known")
        return texts.join(known, texts["uid"] == known["u"]).select("id", "comp", "text")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Shingles(words)
        for b in batches:
            each = [sets(t) for t in b["text"]]
            yield b.drop(columns="text").assign(n=[len(x) for x in each], bits=[_bitmap(x) for x in each])

    # most pairs that meet share a passage and little else: bitmaps settle them, and only what is left is compared in whole
    marks = scratch.keep(of(pairs).mapInPandas(marked, "id long, comp binary, n int, bits binary"), "marks")
    sides = [marks.select(*[F.col(c).alias(f"{k}{c}") for c in ("id", "comp", "n", "bits")]) for k in "lr"]
    both = pairs.join(sides[0], F.col("a") == F.col("lid")).join(sides[1], F.col("b") == F.col("rid"))
    likely = both.select("a", "b", "lcomp", "rcomp", "ln", "rn", "lbits", "rbits").mapInArrow(_may(similarity), "a long, b long, lcomp binary, rcomp binary")
    likely = scratch.keep(likely, "likely")
    scratch.drop(pairs, marks)
    sets = scratch.keep(of(likely).select("id", "text").mapInPandas(shingler(words), "id long, sh binary"), "sets")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[_alike(x, [y], similarity) for x, y in zip(b["sa"], b["sb"])], ["a", "b"]]

    met = likely.join(sets.select(F.col("id").alias("i"), F.col("sh").alias("sa")), F.col("a") == F.col("i")).join(sets.select(F.col("id").alias("j"), F.col("sh").alias("sb")), F.col("b") == F.col("j"))
    return met.select(F.col("lcomp").alias("a"), F.col("rcomp").alias("b"), "sa", "sb").mapInPandas(verified, "a binary, b binary").distinct()


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, key: str = "doc_id", text: str = "text", leaders: int = 64, chunk: int = 500) -> DataFrame:
    """docs without near-copies: each row that goes has a staying row of a lesser key, their word shingles' Jaccard at least ``similarity``.

    Candidates are the components of fingerprints over the set of distinct words within ``radius`` bits, joined where alike_links() finds
    texts of two components alike: no pair of that similarity lies in two. Within a component, in rounds,
    the ``leaders`` least rows settle among themselves, and all others are compared with those that stay, in chunks; what is left
    goes into the next round, with twice as many leaders up to 1,024. Exact copies go first, of rows of one key and text one stays; a null key
    counts as after all others; texts without words are never copies of each other, nulls among them. Very long texts are compared whole.
    Rows that stay pass unchanged, in columns of any name.

    Texts are shuffled once, one row a text and task, into a table bucketed by their digest, which all later joins read in place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    body = F.coalesce(F.col(text), F.lit(""))
    wordless = F.length(F.btrim(body, F.lit(ASCII_SPACE))) == 0
    plain = [F.col(f"`{c.name}`") for c in docs.schema if c.dataType.typeName() != "map"]
    rows = sealed(docs.where(~wordless), uid=F.unhex(F.md5(body.cast("binary"))), doc=F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), tie=F.xxhash64(*plain))
    one = rows.groupBy("uid").agg(F.min_by("row", F.struct("doc", "tie")).alias("row"), F.min("doc").alias("first"))
    kept = scratch.bucketed(one, shuffle_partitions(spark), "uid", name="texts")
    texts = kept.select("uid", F.col("row").getField(text).alias("text"))
    near = near_duplicates(texts, 1, radius, "uid", "text", distinct_shingles=True)
    placed = scratch.keep(near.select("uid", F.col("component_id").alias("comp")), "placed")
    joined = components(alike_links(texts.join(placed, "uid"), words, similarity, scratch), scratch)
    moved = placed.join(joined, placed["comp"] == joined["node"], "left").select("uid", F.coalesce("root", "comp").alias("comp"))
    placed = scratch.keep(moved, "placed")
    # a table: the join with it can then be split where a component is large
    sizes = scratch.keep(placed.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("comp", "c"), "sizes")
    members = scratch.keep(placed.join(sizes, placed["comp"] == sizes["c"]).select(F.col("uid").alias("u"), "comp"), "members")
    schema = "comp binary, uid binary, first long, sh binary"
    mates = kept.join(members, kept["uid"] == members["u"]).select("comp", "uid", "first", F.col("row").getField(text).alias("text"))
    left = scratch.keep(mates.mapInPandas(shingler(words), schema), "open")

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        stay: list[bytes] = []
        goes = []
        for sh in g.sort_values("first")["sh"]:
            goes.append(_alike(sh, stay, similarity))
            if not goes[-1]:
                stay.append(sh)
        return g.sort_values("first").assign(goes=goes)

    def compare(m: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        stay = list(lead["sh"])
        return m.drop(columns="salt").assign(goes=[_alike(sh, stay, similarity) for sh in m["sh"]])

    gone: list[DataFrame] = []
    while left.limit(1).count():
        salt = F.pmod(F.xxhash64("uid"), F.lit(64))
        few = left.select("comp", "uid", "first", salt.alias("s")).withColumn("k", F.row_number().over(Window.partitionBy("comp", "s").orderBy("first"))).where(F.col("k") <= leaders)
        lead = few.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy("first"))).where(F.col("k") <= leaders).select(F.col("uid").alias("lu"))
        marked = scratch.keep(left.join(lead, left["uid"] == lead["lu"], "left").withColumn("lead", F.col("lu").isNotNull()).drop("lu"), "marked")
        settled = marked.where("lead").drop("lead").groupBy("comp").applyInPandas(settle, f"{schema}, goes boolean")
        settled = scratch.keep(settled, "settled")
        gone.append(settled.where("goes").select("uid"))
        parts = marked.where("not lead").groupBy("comp").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).withColumnRenamed("comp", "c")
        parts = scratch.keep(parts, "parts")
        rest = marked.where("not lead").drop("lead").join(parts, F.col("comp") == F.col("c")).withColumn("salt", F.pmod(F.xxhash64("uid", F.lit("chunk")), F.col("parts")).cast("int")).drop("c", "parts")
        sent = settled.where("not goes").drop("goes").join(parts, F.col("comp") == F.col("c")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("c", "parts")
        judged = scratch.keep(rest.groupBy("comp", "salt").cogroup(sent.groupBy("comp", "salt")).applyInPandas(compare, f"{schema}, goes boolean"), "judged")
        gone.append(judged.where("goes").select("uid"))
        scratch.drop(left, marked)
        left, leaders = judged.where("not goes").drop("goes"), min(2 * leaders, max(leaders, 1024))
    lost = gone[0] if gone else left.select("uid").limit(0)
    for g in gone[1:]:
        lost = lost.unionByName(g)
    out = kept.join(scratch.keep(lost, "lost"), "uid", "left_anti").select("row")
    return unsealed(out.unionByName(sealed(docs.where(wordless))), docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, radius 4, all documents; see near_duplicates()."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_components": op10_simhash}
SQL: dict[str, str] = {}
