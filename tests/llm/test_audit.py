"""Operators 11 to 13 and the radix selection under two of them, against plain code."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import divergence, hyperdim, negatives, radix
from panelspark.llm.common import Scratch


# ---------------------------------------------------------------- radix selection
def ranked(rows, k):
    by = defaultdict(list)
    for g, v, t in rows:
        by[g].append((-v, t.encode(), t))
    return sorted((g, t, -v, i + 1) for g, mine in by.items() for i, (v, _, t) in enumerate(sorted(mine)[:k]))


@pytest.mark.parametrize(("k", "gather"), [(1, 0), (4, 2), (10, 5), (10, 1000)])
def test_radix_selection_with_ties(spark, k, gather):
    r = random.Random(k)
    rows = [("hot", r.choice([-5, 7, 7, 7, 1 << 40]), f"common prefix {'é' * r.randint(0, 3)}{r.randint(0, 400)}") for _ in range(600)]
    rows += [("far", r.randint(-(1 << 61), 1 << 61), str(i)) for i in range(300)] + [("few", 3, "b"), ("few", 3, "a"), ("zero", 0, "")]
    rows += [("same", 9, "x")] * 40 + [("deep", 1, "p" * 90 + chr(97 + i % 26) + str(i)) for i in range(80)]
    scratch = Scratch(spark, "radix")
    df = scratch.keep(spark.createDataFrame(rows, "g string, v long, t string").repartition(5))
    got = radix.top_k(df, scratch, ["g"], "v", "t", k, gather)
    assert got.columns == ["g", "t", "v", "rank"]
    assert sorted(map(tuple, got.collect())) == ranked(rows, k)


def test_radix_selection_of_nothing(spark):
    scratch = Scratch(spark, "radix")
    assert radix.top_k(scratch.keep(spark.createDataFrame([], "g string, v long, t string")), scratch, ["g"], "v", "t", 3).count() == 0


# ---------------------------------------------------------------- divergence
def audited(rows, least, top, scale=divergence.SCALE):
    """The definition, in fractions, over all terms of every group."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, words in docs if g == lang for t in set(words))
        kept = [t for t, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for g, s, words in docs:
            if g == lang:
                count[s].update(w for w in words if df[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + scale * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: int(Fraction((p - q) ** 2, p + q))
        shares, own = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(shares[s][t], own[t]), t) for t in kept if count[s][t] and shares[s][t] > own[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def articles(rows):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Ünder", "naïve", "straße", "日本", "A", "ÀB"]
    out = [(" ".join(r.choices(words, range(36, 0, -1), k=r.randint(0, 60))) + "'s X-y_z9", r.choice(["en", "en", "de", None]), f"s{r.choice([0, 0, 0, 1, 2, 3, 4])}") for _ in range(150)]
    out += [(t, "fr", f"s{i or 0}") for i, t in rows] + [(None, "it", None), ("one two", "xx", "only"), ("", None, None), ("same same", "en", "s1"), ("same same", "en", "s1")]
    return out + [("uno", "pt", "a"), ("dos", "pt", "b"), (" 12 ,", "pt", "c")]


@pytest.mark.parametrize(("least", "top", "cells"), [(10, 10, 200_000), (2, 3, 7), (1, 5, 1)])
def test_divergence_against_the_definition(spark, monkeypatch, articles, least, top, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    df = spark.createDataFrame([(*a, i, "x") for i, a in enumerate(articles)], "text string, lang string, source string, value long, term string").repartition(4)
    got = divergence.audit(df, least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(articles, least, top)


def test_divergence_of_many_terms_ties_by_bytes(spark):
    """A source with thousands of equal terms, so that bytes decide."""
    base = " ".join(f"t{i:05d}é" for i in range(3000))
    rows = [(base, "en", "a"), (base, "en", "a"), (" ".join(f"u{i}" for i in range(50)), "en", "b"), (base.replace("t0", "v"), "en", "c")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=1)
    assert sorted(map(tuple, got.collect())) == audited(rows, 1, 10)


def test_terms_of_long_texts_are_counted_across_slices(spark, monkeypatch, articles):
    monkeypatch.setattr(divergence, "SLICE", 16)
    df = spark.createDataFrame(articles, "text string, lang string, source string")
    got = divergence.term_counts(df).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).where("term <> ''").collect()
    words = [(lang or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, lang, _ in articles]
    df_, tf = Counter((g, t) for g, w in words for t in set(w)), Counter((g, t) for g, w in words for t in w)
    assert {(r["lang"], r["term"]): (r["d"], r["n"]) for r in got} == {k: (df_[k], tf[k]) for k in tf}


def test_divergence_of_an_empty_table(spark, none):
    assert divergence.audit(none).count() == 0


# ---------------------------------------------------------------- language
def test_trigram_vectors_bind_permuted_letters():
    v = 1 - 2 * np.unpackbits(hyperdim.letter_vectors(np.array([97, 98, 0])).view(np.uint8), axis=1).astype(int)
    a, b, border = v
    turn = lambda x, n: np.concatenate([x[-64 * n :], x[: -64 * n]])
    packed = np.array([97 << 42 | 98 << 21 | 0, 98 << 42 | 97 << 21 | 98], np.uint64)
    got = hyperdim.trigram_vectors(packed)
    assert (got[0] == turn(a, 2) * turn(b, 1) * border).all() and (got[1] == turn(b, 2) * turn(a, 1) * b).all()
    assert abs(a @ b) < 200 and abs(v.mean()) < 0.1


def plain_grams(text):
    s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return Counter(s[i : i + 3] for i in range(len(s) - 2)) if s.strip() else Counter()


@pytest.mark.parametrize("points", [1, 3, 7, 1 << 18])
def test_bundles_are_sums_over_all_trigrams(monkeypatch, points):
    monkeypatch.setattr(hyperdim, "POINTS", points)
    texts = ["", None, "  12!", "x", "a b", "Hello, World -- hello!", "naïve 日本語 Straße", "...ab...", "a1b2c3", "word " * 30]
    got = hyperdim.bundles(texts)
    for t, v in zip(texts, got):
        want = np.zeros(hyperdim.DIMS)
        for g, n in plain_grams(t or "").items():
            code = [0 if c == " " else ord(c) for c in g]
            want += n * hyperdim.trigram_vectors(np.array([code[0] << 42 | code[1] << 21 | code[2]], np.uint64))[0]
        assert (v == want).all(), t


SYLLABLES = {"aa": "ka ro mi tu lo sa", "bb": "sch ung ver ein lich ä", "cc": "tion ed th ing er a"}


def tongue(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages_are_told_on_held_out_texts(spark):
    rows = [(i, tongue(lang, 5 + i % 90, i), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", hyperdim.held_out(F.col("doc_id")))
    protos = hyperdim.prototypes(df.where("NOT held_out"))
    assert sorted(protos) == sorted(SYLLABLES)
    got = hyperdim.identify(df, protos).where("held_out").collect()
    assert len(got) > 40 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    # the same sums however the rows lie
    again = hyperdim.prototypes(df.where("NOT held_out").repartition(7))
    assert all((protos[k] == again[k]).all() for k in protos)


def test_languages_of_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(hyperdim, "LANGS", 2)
    train = spark.createDataFrame([(tongue(x, 200, 1), x) for x in SYLLABLES] + [("noch was", None), (None, "bb"), ("12", "dd"), ("zz", "ee")], "text string, lang string")
    protos = hyperdim.prototypes(train)
    assert sorted(protos) == ["aa", "bb", "cc", "ee"]
    texts = [None, "", " 12 ++ ", "x", tongue("bb", 3000, 2) * 40, tongue("cc", 40, 3), tongue("cc", 40, 3), "ZZ"]
    df = spark.createDataFrame([(i, t, "aa", "keep", 5) for i, t in enumerate(texts)], "id long, text string, lang_pred string, row string, told int")
    got = {r["id"]: r for r in hyperdim.identify(df, protos).collect()}
    assert set(got[0].asDict()) == {"id", "text", "lang_pred", "row", "told", "score"} and got[0]["row"] == "keep"
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and [got[i]["score"] for i in (0, 1, 2)] == [0.0] * 3
    assert got[3]["lang_pred"] in protos and [got[i]["lang_pred"] for i in (4, 5, 6, 7)] == ["bb", "cc", "cc", "ee"] and got[5]["score"] == got[6]["score"]
    nothing = hyperdim.identify(df, {}).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert hyperdim.prototypes(train.limit(0)) == {} and hyperdim.identify(df.limit(0), protos).count() == 0


# ---------------------------------------------------------------- hard negatives
def mined(rows, every=100, k=5, n=10, low=30, high=90, scale=256):
    ok = [(i, np.floor(np.array(v, float) * scale).astype(np.int64), label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in ok), default=1)
    ok = [(i, np.r_[v, np.zeros(width - len(v), np.int64)], label) for i, v, label in ok]
    out, asked = [], set()
    for i, v, label in ok:
        if i % every or (i, tuple(v), label) in asked:
            continue
        asked.add((i, tuple(v), label))
        scored = [(-int(v @ x), j, own) for j, x, own in ok]
        for ps, j, _ in sorted(s for s in scored if s[2] == label and s[1] != i)[:k]:
            near = sorted(s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)[:n]
            out += [(i, j, r + 1, x, -ps, -s) for r, (s, x, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "levels", "gather"), [(3, 9, 4), (1, 3, 0), (16, 400, 0)])
def test_negatives_against_the_definition(spark, dims, levels, gather):
    r = random.Random(dims)
    rows = [(i, [r.randint(-levels, levels) / 16 for _ in range(dims)], r.choice([0, 1, 1, 1, 2])) for i in range(-120, 500)]
    rows += [(700 + i, [0.5] * dims, i % 2) for i in range(80)] + [(300, [0.25] * dims, 2), (300, [0.25] * dims, 2), (7, [1.0] * dims, 1), (7, [1.0] * dims, 1)]
    rows += [(1000, None, 1), (1100, [float("nan")] * dims, 1), (1200, [1.0] * dims, None), (None, [1.0] * dims, 1), (1300, [None] * dims, 1), (1400, [1.0] * (dims + 1), 1), (1401, [], 0), (1402, [float("inf")], 1)]
    df = spark.createDataFrame([(*x, "s", 1.0) for x in rows], "vec_id long, embedding array<double>, label int, chunk string, score double").repartition(6)
    got = negatives.mine(df, gather=gather, chunk=150)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_with_most_rows_alike(spark):
    """Ties far beyond k, all in one window, with labels as strings."""
    rows = [(i, [1.0, 0.0], "a") for i in range(0, 400, 50)] + [(i, [0.8, 0.1], "b") for i in range(1, 1500) if i % 50]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4), chunk=200)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_negatives_of_few_and_of_no_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema)).count() == 0
    huge = [(0, [1e300], 1), (1, [1e308], 1), (2, [1e299], 2)]
    assert negatives.mine(spark.createDataFrame(huge, schema)).count() >= 0


# ---------------------------------------------------------------- the queries
@pytest.mark.parametrize("module", [divergence, negatives])
def test_queries_equal_sql(spark, sf, module):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in module.SQL.items():
        got, want = module.QUERIES[name](spark, sf), c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_language_query_on_held_out_documents(spark, sf):
    got = hyperdim.op12_language(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    told = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert told and sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.95
