import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import bpe, packing, sstable, units


@pytest.fixture(scope="module")
def whole(tokenizer_json):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", " ", "\n", "a\n", "\na b.", " lead", "trail ", "a  b", "a \n b", "tab\tx y", "wow!!! ok?! (a) [b], c;", "it's 5 o'clock.\nHe'll go ñandú, été.", "nb\xa0sp x\x01y z", "<|endoftext|> in text", "x" * 300, "a\r\nb c"]


def test_cached_pieces_equal_whole_texts(tokenizer_json, whole, rows):
    texts = [t for _, t in rows] + ODD
    got = units.tokenizer_cache(tokenizer_json).texts(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [whole(t) for t in texts]


def test_common_words_outlive_a_full_cache():
    asked = []

    def encode(words, *_):
        asked.extend(words)
        return [w.encode() for w in words]

    cache = units.Cache(encode, encode, most=40)
    for i in range(60):
        rare = "".join(chr(97 + int(x)) for x in str(i))
        assert cache.texts([f"the {rare}q {rare}z", "so the\n", None, ""]) == [f"the{rare}q{rare}z".encode(), b"sothe\n", b"", b""]
        assert len(cache.known) <= 60
    assert asked.count("the") == 2 and asked.count("so") == 1  # a word that opens a line and one after a space are two pieces
    assert cache.texts([]) == []


def test_sstable_round_trip(spark, docs, rows, tokenizer_json, whole):
    manifest = sstable.write(docs, tokenizer_json)
    got = sstable.read(spark, manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r["key"] is not None, r["key"] or 0, r["ids_crc32"]) for r in got) == sorted((k is not None, k or 0, crc(whole(t) + [0])) for k, t in order)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    keys = [r["key"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    found = [sstable.open_shard(m["path"]).get(13) for m in manifest]
    assert sum(map(len, found)) == 2
    assert not any(sstable.open_shard(m["path"]).get(999) for m in manifest)
    assert sum(len(sstable.open_shard(m["path"]).get(None)) for m in manifest) == 2


def test_sstable_empty(spark, none, tokenizer_json):
    assert sstable.read(spark, sstable.write(none, tokenizer_json)).count() == 0


def test_sstable_lookup_over_many_blocks(tmp_path):
    path = tmp_path / "s.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, block=300)
        for i in range(-500, 500):
            w.add(sstable.key_of(i * 3), np.arange(i & 7, dtype="<u4").tobytes())
        w.close()
    r = sstable.open_shard(f"file://{path}")
    assert len(r.blocks) > 5 and r.entries == 1000
    assert [len(r.get(i)) for i in (-1500, -1499, 0, 3, 1497, 1500)] == [1, 0, 1, 1, 1, 0]
    assert r.get(21) == [np.arange(7, dtype="<u4").tobytes()]
    assert [i for i, _, _ in r.items()] == [i * 3 for i in range(-500, 500)]


def check_packed(got, want, capacity):
    covered, bins = {}, {}
    for r in got:
        ids = want[r["doc_id"], r["doc_tokens"]]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        covered.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(range(r["start"], r["start"] + r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return covered, bins


def test_packing(docs, rows, tokenizer_json, whole):
    kept = docs.where("doc_id IS NOT NULL")
    got = packing.pack(kept, tokenizer_json).collect()
    want = {(k, len(whole(t)) + 1): whole(t) + [1] for k, t in rows if k is not None}
    covered, bins = check_packed(got, want, 2048)
    for (k, n), at in covered.items():
        copies = sum(1 for i, t in rows if i == k and len(whole(t)) + 1 == n)
        assert sorted(at) == sorted(list(range(n)) * copies)
    assert sorted(bins) == list(range(len(bins)))
    total = sum(len(x) for x in covered.values())
    assert len(bins) <= total // 2048 + 2
    assert packing.pack(docs, tokenizer_json, with_ids=False).where("doc_id IS NULL").count() >= 2


def test_lean_packing_takes_less_text_at_once_and_gives_the_same(spark, docs, tokenizer_json, monkeypatch):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole, lean = (sorted(map(tuple, packing.pack(docs, tokenizer_json, with_ids=False, lean=x).select(*columns).collect()), key=repr) for x in (False, True))
    assert lean == whole and whole
    texts, taken, back = ["word " * 20_000] * 30 + [None, ""], [], []  # 3 MB
    cache = units.tokenizer_cache(tokenizer_json, 200_000)
    assert cache.most == 200_000
    monkeypatch.setattr(packing, "give_back", lambda: back.append(1))

    class Watched:
        def texts(self, some):
            taken.append(sum(len(t or "") for t in some))
            return cache.texts(some)

    n = len(texts)
    batch = pa.record_batch({"key": pa.array(range(n), pa.int64()), "rid": pa.array(range(n), pa.int64()), "text": pa.array(texts)})
    got = [x for b in packing._encoded([batch], Watched(), b"\x01\0\0\0", True) for x in b["crc"].to_pylist()]
    assert max(taken) <= 1_000_000 and sum(taken) == 3_000_000 and len(back) == len(taken)
    assert got == [x for b in packing._encoded([batch], cache, b"\x01\0\0\0", False) for x in b["crc"].to_pylist()]


def test_packing_empty(none, tokenizer_json):
    assert packing.pack(none, tokenizer_json).count() == 0


def test_whole_documents_and_full_sequences(spark):
    """Most documents that fit stay whole, sequences are full but for a few, every token lies in one piece, at any mix of lengths."""
    from panelspark.llm.common import Scratch

    rng = np.random.default_rng(6)
    for n in (rng.integers(1, 900, 4000), rng.integers(1100, 2049, 1500), np.r_[rng.integers(1, 40, 3000), rng.integers(3000, 9000, 60)], np.full(700, 2048), np.array([5])):
        lens = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "rid long, n long").repartition(5)
        got = packing.place(lens, 2048, Scratch(spark, "t"), cell=10_000).collect()
        by, bins = {}, {}
        for r in got:
            by.setdefault(r["rid"], []).append((r["start"], r["length"]))
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, x in enumerate(n):
            at = 0
            for start, length in sorted(by[i]):
                assert start == at and length > 0
                at += length
            assert at == x
        assert sorted(bins) == list(range(len(bins))) and len(bins) <= n.sum() / 2048 * 1.01 + 2
        for b in bins.values():
            at = 0
            for o, length in sorted(b):
                assert o == at
                at += length
            assert at <= 2048
        fit = [i for i, x in enumerate(n) if x <= 2048]
        assert len(n) < 1000 or sum(len(by[i]) == 1 for i in fit) > 0.6 * len(fit)


def test_bpe_against_whole_texts(docs, rows):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((k is not None, k or 0, enc.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows)
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=5000).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got) == want
    assert all(r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_bpe_odd_texts_and_empty(spark, none):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(df, ranks, public_tokenizers.PATTERN).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(ODD)}
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
