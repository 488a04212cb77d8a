import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import knn, merkle, sharding, toxicity


# ---------------------------------------------------------------- sharding
def test_shards_slots_and_growth(docs, rows):
    got = sharding.shard(docs, sharding.layout(24), sharding.layout(25)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["grown_shard"] in (r["shard"], 24)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)


def test_shards_are_even_and_move_little(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard(ids, sharding.layout(24), sharding.layout(25))
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 1.25 * 20_000 / 24 and min(sizes) > 0.75 * 20_000 / 24
    moved = got.where("shard <> grown_shard").count()
    assert 0.7 * 20_000 / 25 < moved < 1.3 * 20_000 / 25


def test_movement_stays_in_the_changed_subtree(spark):
    old = [sharding.Leaf(f"r{i}", f"k{j}", 4 * i + 2 * j + s) for i in range(3) for j in range(2) for s in range(2)]
    new = [x._replace(weight=2.0) if x.shard == 5 else x for x in old]
    ids = spark.range(20_000).select(F.col("id").alias("k"))
    got = ids.select(sharding.place(F.col("k"), old).alias("a"), sharding.place(F.col("k"), new).alias("b")).where("a <> b").collect()
    region, rack = {x.shard: x.region for x in old}, {x.shard: (x.region, x.rack) for x in old}
    assert got and all(r["b"] == 5 for r in got)
    assert {region[r["a"]] for r in got} == {"r0", "r1", "r2"} and len({rack[r["a"]] for r in got}) == 6


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """At every count from 1 to 64, and into even shares."""
    shards = [sharding.place(F.col("k"), sharding.layout(n)).alias(f"n{n}") for n in range(1, 66)]
    ids = spark.range(3000).select(F.col("id").alias("k")).repartition(4)
    for at in range(0, 64, 8):
        got = ids.select(*shards[at : at + 9]).collect()
        for n in range(at + 1, at + 9):
            assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for r in got)
            assert sum(r[f"n{n + 1}"] == n for r in got) > 3000 / (n + 1) / 3


def test_shards_against_a_plain_descent(spark):
    """The drawn shard, by the same 64-bit hashes and plain arithmetic from the root down."""
    leaves = [x._replace(weight=1.0 + x.shard % 3) for x in sharding.layout(13)]
    labels = {x.shard: f"{x.region}/{x.rack}/{x.shard}" for x in leaves}
    ids = spark.range(500).select(F.col("id").alias("k"), sharding.place(F.col("id"), leaves).alias("s"), *[F.xxhash64("id", F.lit(t)).alias(f"h{i}") for i, t in labels.items()])
    for r in ids.collect():
        draw = {x.shard: -math.log((((r[f"h{x.shard}"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)) / x.weight for x in leaves}
        least = lambda name, part: min(draw[x.shard] for x in leaves if getattr(x, name) == part)
        region = min({x.region for x in leaves}, key=lambda n: least("region", n))
        inside = [x for x in leaves if x.region == region]
        rack = min({x.rack for x in inside}, key=lambda n: min(draw[x.shard] for x in inside if x.rack == n))
        assert r["s"] == min((x.shard for x in inside if x.rack == rack), key=draw.get)


def test_shards_empty(none):
    assert sharding.shard(none, sharding.layout(24)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), [sharding.Leaf("r", "k", 0, 0.0)])


# ---------------------------------------------------------------- fingerprints
def plain_tree(text):
    """(fingerprint, distinct leaves) by plain code: XXH64 chains of sentences, paragraphs and sections, md5 at the root."""
    import hashlib
    import re
    import struct

    import xxhash

    string = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)

    def chain(numbers, label):
        h = 42
        for n in numbers:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", n), h)
        return string(label, h)

    signed = lambda n: n - (1 << 64) if n >> 63 else n
    sentence = re.compile(r"[\s\S]{1,200}?(?:[.!?]+[ \t\n\x0b\f\r]*|\Z)|[\s\S]{200}")
    leaves = [[string(m) for m in sentence.findall(p)] for p in (text or "").split("\n")]
    paragraphs = [chain(x, "paragraph") for x in leaves]
    ends = [i for i, p in enumerate(paragraphs, 1) if i == len(paragraphs) or signed(p) % 4 == 0]
    sections = [chain(paragraphs[a:z], "section") for a, z in zip([0, *ends], ends)]
    root = hashlib.md5(",".join(str(signed(x)) for x in sections).encode()).hexdigest()
    parts = [f"{x:016x}.{z - a}" for x, a, z in zip(sections, [0, *ends], ends)], [f"{p:016x}.{len(x)}" for p, x in zip(paragraphs, leaves)], [f"{h:016x}" for x in leaves for h in x]
    return "|".join([root, *map(",".join, parts)]), {h for x in leaves for h in x}


def plain_likeness(a, b):
    (f, x), (g, y) = plain_tree(a), plain_tree(b)
    return 1.0 if f.split("|")[0] == g.split("|")[0] else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_merkle_against_plain_code(docs, rows):
    kept = docs.where("doc_id IS NOT NULL AND doc_id <> 13")
    texts = {k: t or "" for k, t in rows if k is not None and k != 13}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in merkle.fingerprint_pairs(kept).collect()}
    assert set(got) == set(texts)
    for i, k in enumerate(order):
        t, after = texts[k], texts[order[(i + 1) % len(order)]]
        n = len(t) // 3
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited"] == t[: len(t) - n] + after[:n]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_tree(t)[0], plain_tree(r["edited"])[0])
        assert r["near_edited"] == pytest.approx(plain_likeness(t, r["edited"])) and r["near_next"] == pytest.approx(plain_likeness(t, after))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[2]["near_next"] == 1.0 and got[3]["near_edited"] > 0.4 and got[8]["near_next"] < 0.5


def test_merkle_locates_edits(spark):
    a = "One two three. Four five.\nSix seven eight.\nNine ten."
    b = a.replace("seven", "SEVEN")
    f = merkle.with_tree(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), "text").select("doc_id", merkle.as_text().alias("f"))
    x, y = [r["f"] for r in f.orderBy("doc_id").collect()]
    out = spark.createDataFrame([(x, y)], "x string, y string").select(merkle.edited_paragraphs(F.col("x"), F.col("y")).alias("at"), merkle.text_likeness(F.col("x"), F.col("y")).alias("n"), merkle.text_likeness(F.col("x"), F.col("x")).alias("same")).first()
    assert out["at"] == [1] and 0.5 < out["n"] < 1 and out["same"] == 1.0


def test_merkle_ties_nulls_and_empty(docs, none, rows):
    assert merkle.fingerprint_pairs(docs).count() == len(rows)
    assert merkle.fingerprint_pairs(none).count() == 0
    one = merkle.fingerprint_pairs(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert merkle.fingerprint_pairs(docs.where("doc_id IS NULL")).count() == 2


def test_merkle_over_many_ranges(spark):
    """Every row beside the next below it, however the keys are dealt out, with gaps and a crowd at one end."""
    keys = [i * i for i in range(300)] + [-5 - i for i in range(200)]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, t string").repartition(6)
    order = sorted(keys, reverse=True)
    want = {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}
    for size in (7, 1000):
        out = merkle.beside_next(df, ["t"], rows_per_range=size)
        assert {r["doc_id"]: r["n"] for r in out.select("doc_id", F.col("next.t").alias("n")).collect()} == want | {order[-1]: f"t{order[0]}"}
        assert "from_json" not in out._jdf.queryExecution().executedPlan().toString()


def test_merkle_runs_no_python(docs):
    plan = merkle.fingerprint_pairs(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")


# ---------------------------------------------------------------- top-k
def brute_top(vectors, k, every):
    clean = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q in clean:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(clean[q], clean[x])), x) for x in clean if x != q)[:k]
            out += [(q, n, x, -s) for n, (s, x) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    hot = [0.5] * 8
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)] + [(300 + i, hot) for i in range(150)]
    vectors += [(460, None), (461, [1.0, None] + hot[:6]), (462, [float("nan")] * 8), (463, [float("inf")] + hot[:7]), (None, hot), (464, [0.0] * 8), (470, [0.25, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, every=10).collect())
    assert got == brute_top(vectors, 5, 10)


def test_top_k_in_many_chunks_and_blocks(spark):
    """Small chunks and query blocks, names like the operator's own, integers of which many tie."""
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, cell string, asks int, chunk int").repartition(6)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, every=10, pivots=7, chunk=150, query_block=20).collect())
    assert got == brute_top(vectors, 5, 10)


def test_top_k_of_repeated_ids(spark):
    """Several rows of one id ask together, as in SQL; none is its own candidate, whatever their number."""
    rng = np.random.default_rng(4)
    for copies in (3, 100):
        rows = [(0, [9.0, 9.0])] * copies + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(1, 200)]
        got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=1000, pivots=9).collect()
        one = [(x, v) for _, _, x, v in brute_top([rows[0], *rows[copies:]], 5, 1000)]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [x for x in one for _ in range(copies)][:5]


def test_top_k_few_rows_and_huge_numbers(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    got = knn.top_k(df, every=2).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    assert knn.top_k(df.where("vec_id = 0")).count() == 0 and knn.top_k(df.where("vec_id > 9")).count() == 0


# ---------------------------------------------------------------- toxicity
@pytest.fixture(scope="module")
def model(spark, pytestconfig):
    p = pytestconfig.prose
    rows = [(i, f"{p(40, i)} {['wretch', 'vermin'][i % 2] if i % 4 < 2 else 'friend'} {p(20, 900 + i)}") for i in range(400)]
    labels = [(i, int(i % 4 < 2)) for i in range(400)] + [(9999, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_held_out_and_disguised(spark, model, pytestconfig):
    p = pytestconfig.prose
    say = lambda w: f"{p(30, 77)} {w} {p(30, 78)}"
    cases = [("wretch", 1), ("VERMIN!", 1), ("wr3tch", 1), ("w r e t c h", 1), ("w.r.e.t.c.h", 1), ("verrrrmin", 1), ("v3rm1n", 1), ("friend", 0), ("nothing here", 0)]
    df = spark.createDataFrame([(i, say(w), "x") for i, (w, _) in enumerate(cases)] + [(50, None, "x"), (51, "", "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert [int(got[i] >= 0.5) for i in range(len(cases))] == [y for _, y in cases]
    assert got[50] == got[51] < 0.5


def test_toxicity_without_labels_or_documents(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.train(docs, empty)
    assert toxicity.score(docs, m).where("score >= 0.5").count() == 0
    assert toxicity.score(none, toxicity.train(none, empty)).count() == 0


def test_viterbi_and_lattice():
    lm = toxicity.language_model(np.bincount(np.arange(1 << 18) * 0, minlength=1 << 18))
    assert toxicity.viterbi(toxicity.lattice("b4dd"), lm) == "badd"
    assert toxicity.disguised("h3llo") and toxicity.disguised("sooo") and not toxicity.disguised("hello") and not toxicity.disguised("123")
    assert toxicity.Words.runs("a b c d hello x y".split()) == ["a b c d"]


def test_viterbi_against_all_paths():
    """The likeliest of every path through short lattices, and no other score."""
    import itertools

    rng = np.random.default_rng(5)
    lm = toxicity.language_model(rng.integers(0, 50, 1 << 18))
    one = lambda ch: int(toxicity._CLASS[ord(ch)])

    def worth(path):
        a, b, total = 0, 0, 0.0
        for s, cost in [*path, (" ", 0.0)]:
            total += cost
            for ch in s:
                total += float(lm[a, b, one(ch)])
                a, b = b, one(ch)
        return total

    for span in ("b4d", "1d10t", "s-o-o", "stuuu", "f.4.$", "*h1t", "w000w", "a||"):
        columns = toxicity.lattice(span)
        paths = list(itertools.product(*columns))
        best = max(map(worth, paths))
        got = toxicity.viterbi(columns, lm)
        assert got in {"".join(s for s, _ in p).strip() for p in paths if worth(p) > best - 1e-4}, span


def test_scores_by_plain_code(spark, model, pytestconfig):
    """A score is the constant and the weights of the cues in the text, whatever the row's length, number or neighbours."""
    p = pytestconfig.prose
    texts = [p(30, 1), f"{p(9, 2)} WRETCH, vermin$$$ {p(9, 3)}", "vermin " * 3, f"{p(60_000, 4)} wretch", "wretch", "wretch", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, held_out int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(texts):
        words = {w.strip(".,;:?!$").lower() for w in (t or "").split()}
        cues = {c for w in words for c in [*(w[:n] for n in range(3, min(8, len(w)) + 1)), w + "$"]}
        total = model.constant + sum(v for c, v in model.weights.items() if c in cues)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    assert got[4] == got[5] and got[1] > 0.9 > 0.1 > got[0] and got[3] > 0.5


def test_held_out_quality(spark):
    """On the rows that training never sees: ranks, recall and false alarms at one half."""
    d = "/root/testdata/sf0.1"
    out = toxicity.op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = [(r["score"], r["toxic"]) for r in out.select("score", "toxic").collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert len(pos) > 80 and auc > 0.95
    assert sum(s >= 0.5 for s in pos) / len(pos) > 0.85 and sum(s >= 0.5 for s in neg) / len(neg) < 0.02


def test_held_out_fifth(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
