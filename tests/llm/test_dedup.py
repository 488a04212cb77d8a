import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from panelspark.llm import line_dedup, passages, simhash
from panelspark.llm.common import Scratch, components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and got[301] == 300 and got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------- lines
def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    rank = lambda k: (k is None, k or 0)
    first = {}
    for k, t in rows:
        for x in (t or "").split("\n"):
            q = key(x)
            first[q] = min(first.get(q, rank(k)), rank(k))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(k)]
        out.append((k is None, k or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(docs, rows):
    for batches in (1, 2, 5):
        got = line_dedup.dedup(docs, batches).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == brute_lines(rows)
    assert {r["score"] for r in got} == {"keep"}


def test_lines_empty(none):
    assert line_dedup.dedup(none).count() == 0


def test_line_index_merges_runs(spark):
    index = line_dedup.LineIndex(spark)
    for i in range(5):
        index.add(spark.createDataFrame([(i, i), (i + 100, -i)], "h1 long, h2 long"))
    assert [len(x) for x in index.runs] == [1, 0, 1]
    got = index.marked(spark.createDataFrame([(3, 3), (4, 4), (3, 4), (104, -4)], "h1 long, h2 long"))
    assert {(r["h1"], r["h2"]): r["old"] for r in got.collect()} == {(3, 3): True, (4, 4): True, (3, 4): False, (104, -4): True}


def test_runs_are_merged_without_shuffle_or_sort(spark):
    index = line_dedup.LineIndex(spark)
    for i in range(3):
        index.add(spark.range(1000 * i, 1000 * i + 1000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2")))
    batch = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    with line_dedup._bucket_order(spark):
        marked = index.marked(batch)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert marked.where("old").count() == 3000
    assert len(index.all_runs()) == 2 and plan.count("SortMergeJoin") == 2
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_columns_of_any_name(spark):
    """Names that the row-keeping operators use themselves pass through all of them, values and types too."""
    names = ["row", "text_", "doc", "hash", "gone", "pos", "h1", "d", "r", "uid", "first", "copies", "cut", "new", "had", "_doc", "_row", "_uid", "_first", "_all", "_marks", "_text", "_cut", "_u", "a.b", "score", "comp", "node"]
    rows = [(i, f"a line of some length {i % 2}\nown line number {i}", *[f"{c}{i}" for c in names]) for i in range(6)] + [(6, None, *names)]
    df = spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(c, StringType()) for c in names]]))
    for made in (line_dedup.dedup(df).drop("n_lines", "n_dropped"), simhash.near_dedup(df), passages.cut_passages(df)):
        assert made.columns == df.columns
        got = {r[0]: tuple(r)[2:] for r in made.collect()}
        assert got == {r[0]: r[2:] for r in rows}


# ---------------------------------------------------------------- fingerprints
def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(0)
    for radius in range(7):
        kept = [m % (1 << 64) for m in simhash.masks(radius)]
        assert len(kept) == 2 ** (radius + 1) - 1 and min(bin(m).count("1") for m in kept) >= 16
        for _ in range(200):
            flip = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(m & flip == 0 for m in kept)


def brute_components(prints, radius):
    ids = sorted(prints, key=lambda k: (k is None, k or 0))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            if x != y:
                lo, hi = sorted((x, y), key=lambda k: (k is None, k or 0))
                root[hi] = lo
    return {i: find(i) for i in ids}


def plain_print(text, n=4):
    """The contract's fingerprint, bit by bit."""
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = {(k, t): plain_print(t) for k, t in rows}
    assert sorted(r["fp"] % (1 << 64) for r in got) == sorted(plain_print(t) for _, t in rows)
    named = {k: plain_print(t) for k, t in rows if k is not None}
    want = brute_components(named, 4)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert prints[4, None] == prints[5, ""] == 0 and want[5] == 4


def test_simhash_many_near_prints_in_blocks(spark):
    """A dense cluster, solved in blocks: buckets far above the block size."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre} | {centre ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)) for _ in range(1500)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    want = brute_components(dict(zip(sorted(prints), sorted(prints))), 4)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    edges = simhash.links(frame, 4, Scratch(spark, "t"), block=200)
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(edges, Scratch(spark, "t")).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()) if sum(m[k] == v for k in m) > 1)
    assert groups(got) == groups(want)


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_near_dedup_keeps_one_of_each_group(docs, rows):
    kept = {r["doc_id"] for r in simhash.near_dedup(docs).collect()}
    assert 1 in kept and not kept & {2, 3}
    assert {4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, None, -5} <= kept


def test_near_dedup_in_rounds(spark, pytestconfig):
    """More members than leaders a round; every one that goes has a staying text 0.8 alike."""
    base = pytestconfig.prose(300, 3).split()
    texts = []
    for i in range(150):
        w = base.copy()
        w[(7 * i) % 300] = f"edit{i}"
        w[(11 * i + 5) % 300] = f"more{i}"
        texts.append((i, " ".join(w)))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string"), leaders=4, chunk=10).collect()}
    sets = {k: simhash.shingle_set(t, 5) for k, t in texts}
    for k in sets:
        assert k in kept or any(simhash.jaccard(sets[k], sets[j]) >= 0.8 for j in kept if j < k)
    assert not any(simhash.jaccard(sets[a], sets[b]) >= 0.8 for a, b in itertools.combinations(sorted(kept), 2))


def test_near_dedup_finds_appended_cut_and_short_copies(spark, pytestconfig):
    """Copies with a block appended, cut short, or of few words: their word fingerprints lie far apart, their shingles alike."""
    p = pytestconfig.prose
    texts = []
    for i in range(40):
        base = p(200, 700 + i)
        texts += [(10 * i, base), (10 * i + 1, f"{base} {p(35, 900 + i)}"), (10 * i + 2, " ".join(base.split()[:170])), (10 * i + 3, p(20, 1100 + i))]
        texts.append((10 * i + 4, " ".join(p(20, 1100 + i).split()[:-1] + ["other"])))
    sets = {k: simhash.shingle_set(t, 5) for k, t in texts}
    want = []
    for k in sorted(sets):
        if not any(simhash.jaccard(sets[k], sets[j]) >= 0.8 for j in want):
            want.append(k)
    far = [a for a, b in itertools.combinations(range(len(texts)), 2) if simhash.jaccard(sets[texts[a][0]], sets[texts[b][0]]) >= 0.8 and (simhash.fingerprint(texts[a][1], 1, True) ^ simhash.fingerprint(texts[b][1], 1, True)).bit_count() > 6]
    assert len(far) > 20 and len(want) == 80
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.near_dedup(frame).collect()) == want


def test_bitmaps_never_drop_an_alike_pair():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 900, 9000):
        for share in (0.5, 0.79, 0.8, 0.81, 0.95):
            own = int(n * (1 - share) / (1 + share)) + 1
            shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, own, max(0, own - 1)))
            x, y = np.unique(np.r_[shared, a]), np.unique(np.r_[shared, b])
            batch = pa.record_batch([[1], [2], [b"x"], [b"y"], pa.array([len(x)], pa.int32()), pa.array([len(y)], pa.int32()), [simhash._bitmap(x)], [simhash._bitmap(y)]], names=["a", "b", "lcomp", "rcomp", "ln", "rn", "lbits", "rbits"])
            kept = sum(out.num_rows for out in simhash._may(0.8)(iter([batch])))
            assert kept or simhash.jaccard(x.tobytes(), y.tobytes()) < 0.8


def test_alike_links_in_blocks(spark, pytestconfig):
    """Shingles that most texts hold, in buckets far above the block size; every pair that alike is linked."""
    p = pytestconfig.prose
    common = p(120, 5)
    texts = [(i.to_bytes(16), i.to_bytes(16), f"{common} {p(20 + i % 7, 40 + i)}") for i in range(600)]
    frame = spark.createDataFrame(texts, "uid binary, comp binary, text string")
    got = {(bytes(min(r)), bytes(max(r))) for r in simhash.alike_links(frame, 5, 0.7, Scratch(spark, "t"), block=50).collect()}
    sets = [simhash.shingle_set(t, 5) for _, _, t in texts]
    want = {(a.to_bytes(16), b.to_bytes(16)) for a, b in itertools.combinations(range(600), 2) if simhash.jaccard(sets[a], sets[b]) >= 0.7}
    assert got == want and len(want) > 1000


# ---------------------------------------------------------------- passages
def brute_passages(rows, n=passages.LEAST):
    where = {}
    texts = {}
    for k, t in rows:
        texts.setdefault(t or "", k)
    for t, k in texts.items():
        w = t.split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add((k, i))
    out = {}
    for v in where.values():
        if len({k for k, _ in v}) > 1:
            for k, i in v:
                out.setdefault(k, set()).update(range(i, i + n))
    return out


def spread(spans):
    return {j for a, z in spans or [] for j in range(a, z)}


def test_passages_against_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in passages.find_passages(docs.where("doc_id IS NOT NULL")).collect()}
    want = brute_passages([r for r in rows if r[0] is not None])
    assert {k: spread(r["spans"]) for k, r in got.items() if r["spans"] and k != 2} == want
    assert got[2]["whole_copy_of"] == 1 and 7 in want and 8 in want
    assert got[8]["partners"] == [7] and not got[7]["cut_spans"]


def test_a_passage_in_many_documents(spark, pytestconfig):
    p = pytestconfig.prose
    passage = p(60, 99)
    rows = [(i, f"{p(20 + i % 50, 2000 + i)} {passage} {p(30, 5000 + i)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in passages.find_passages(df).collect()}
    assert {k: spread(r["spans"]) for k, r in got.items()} == brute_passages(rows)
    cut = {r["doc_id"]: r["text"] for r in passages.cut_passages(df).collect()}
    assert sum(passage in t for t in cut.values()) == 1 and passage in cut[0]
    want = brute_passages(rows)  # the passage, and a word more where two documents happen to share it
    for k, t in cut.items():
        w, left = dict(rows)[k].split(), t.split()
        if k:
            gone = len(w) - len(left)
            start = next(i for i in range(len(w)) if left[:i] + w[i : i + gone] + left[i:] == w and set(range(i, i + gone)) <= want[k])
            assert 60 <= gone <= len(want[k]) and start <= 20 + k % 50
        else:
            assert left == w


def test_a_passage_over_the_borders_of_many_tasks(spark, pytestconfig):
    """Some 60 tasks hold a few rows each of one passage's chain, so borders are joined in two levels."""
    p = pytestconfig.prose
    passage = p(60, 99)
    rows = [(i, f"{p(20 + i % 50, 2000 + i)} {passage} {p(30, 5000 + i)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r for r in passages.find_passages(df).collect()}
        cut = {r["doc_id"]: r["text"] for r in passages.cut_passages(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: spread(r["spans"]) for k, r in got.items()} == brute_passages(rows)
    assert not got[0]["cut_spans"] and all(0 in r["partners"] for k, r in got.items() if k)
    assert [k for k, t in cut.items() if passage in t] == [0]


def test_passages_around_a_frequent_sentence(spark, pytestconfig):
    """Two documents share words before a sentence that many hold, each followed by other text: all sort between the two."""
    p = pytestconfig.prose
    rows, n = [], 0
    for c in range(2):
        sentence = p(35, 10 + c)
        rows += [(i, f"{p(60, 100 * c + 20_000 + i)} {sentence} {p(60, 100 * c + 30_000 + i)}") for i in range(n, n + 80)]
        n += 80
        for k in range(15):
            own = p(20 + k % 10, 40_000 + 100 * c + k)
            rows += [(n + i, f"{p(40, 50_000 + n + i)} {own} {sentence} {p(40, 60_000 + n + i)}") for i in range(2)]
            n += 2
    got = {r["doc_id"]: r for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute_passages(rows)
    assert len(want) >= 60 and {k: spread(r["spans"]) for k, r in got.items()} == want


def test_cut_loses_no_words(spark, pytestconfig):
    """Overlapping excerpts of one source go only where an earlier document holds 50 words of them; of a text that repeats itself its first place stays."""
    source, period = pytestconfig.prose(150, 77).split(), pytestconfig.prose(10, 78)
    join = " ".join
    rows = [(1, join(source[69:])), (3, join(source[:100])), (7, join(source)), (20, join([period] * 12)), (21, join(["start", *[period] * 12]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r["text"].strip() for r in passages.cut_passages(df).collect()}
    assert cut == {1: rows[0][1], 3: rows[1][1], 20: join([period] * 5), 21: "start"}
    got = {r["doc_id"]: r for r in passages.find_passages(df).collect()}
    assert not got[1]["cut_spans"] and not got[3]["cut_spans"] and got[7]["cut_spans"] == [[0, 150]] and got[7]["partners"] == [1, 3]


def test_cut_leaves_clean_documents(docs, rows, none):
    cut = [(r["doc_id"], r["text"]) for r in passages.cut_passages(docs).collect()]
    left = [r for r in rows if r[0] not in (2, 3, 8)]
    assert sorted([r for r in cut if r[0] not in (2, 3, 8)], key=str) == sorted(left, key=str)
    assert passages.cut_passages(none).count() == 0 and passages.find_passages(none).count() == 0


def test_passages_of_rows_without_a_key_of_their_own(spark, pytestconfig):
    """Null keys, repeated keys and the greatest key beside null: rows are told apart by their texts, null keys come last."""
    p = pytestconfig.prose
    shared = [p(60, 300 + i) for i in range(4)]
    wrap = lambda i, s: f"{p(25, 400 + i)} {s} {p(25, 500 + i)}"
    most = passages.LAST_ID
    rows = [
        (None, wrap(0, shared[0])), (None, wrap(1, shared[0])), (None, p(70, 9)), (None, None), (None, ""),
        (5, wrap(2, shared[1])), (5, wrap(3, shared[1])), (5, wrap(3, shared[1])),
        (most, wrap(4, shared[2])), (None, wrap(5, shared[2])),
        (None, wrap(6, shared[3])), (7, wrap(7, shared[3])), (None, wrap(7, shared[3])), (most, wrap(8, p(60, 888))), (None, wrap(8, p(60, 888))),
    ]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = passages.find_passages(df).collect()
        assert {r["doc_id"] for r in got} == {None, 5, 7, most}
        assert sum(r["doc_id"] is None and r["whole_copy_of"] == most for r in got) == 1 and sum(r["whole_copy_of"] == 7 for r in got) == 1
        assert {spread(r["spans"]) == set(range(25, 85)) for r in got if r["spans"]} == {True}
        partners = [(str(r["doc_id"]), r["partners"]) for r in got if r["partners"]]
        assert partners.count(("5", [5])) in (1, 2) and ("None", [None]) in partners and ("None", [most]) in partners and ("None", [7]) in partners
        cut = [(r["doc_id"], r["text"]) for r in passages.cut_passages(df).collect()]
        for s in shared:
            assert len({(k, t) for k, t in cut if s in (t or "")}) == 1
        left = {s: next(k for k, t in cut if s in (t or "")) for s in shared}
        assert [left[s] for s in shared] == [None, 5, most, 7]
        assert sum(t == rows[13][1] for _, t in cut) == 1 and (most, rows[13][1]) in cut and (None, None) in cut and (None, "") in cut and rows[2] in cut


def test_anchors_cover_every_long_passage():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, passages.LEAST, dtype=np.uint64)
    for _ in range(50):
        found = []
        for _ in range(2):
            a, b = rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64), rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64)
            at, _g = passages.anchors(np.concatenate([a, shared, b]))
            found.append({int(x) - len(a) for x in at if len(a) <= x <= len(a) + passages.LEAST - passages.GRAM})
        assert found[0] & found[1]
    assert len(passages.anchors(np.zeros(500, np.uint64))[0]) < 60


# ---------------------------------------------------------------- the pipeline
def test_pipeline_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark, "t").keep(stage(spark, docs, sf))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        n = out.count()
        assert 0.5 * before < n <= before and n == out.select("doc_id").distinct().count()
        docs, before = out, n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before


def test_pipeline_handles_hard_rows(spark, docs, sf):
    hard = docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        hard = Scratch(spark, "t").keep(stage(spark, hard, sf))
    assert hard.count() > 0
