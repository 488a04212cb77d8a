"""Byte-level BPE by a global shuffle of distinct words.

1. A task cuts a block of documents into pre-tokens, numbers the block's distinct words, and writes the block's documents as a list
   of word numbers, one per position, to a file in the shared folder (entropy-coded, about two bytes a position). It emits one
   entry a distinct word and block, packed into a row a block and word range: a word that stands everywhere is sent once a block.
2. Rows are dealt by word range (a hash of the word) and sorted by it, so each distinct word of the corpus is encoded once, and its ids go back to
   each block that asked for them, a row a block and range. A task holds the words of one range, no more.
3. Blocks are put together by position from their file and the returned ids. Decoding looks ids up in the table of token bytes,
   whose size is the vocabulary's.

Rows are put in order within each task before blocks are cut, and blocks are named by task and number: a task that is run again cuts the same
blocks, whatever order a shuffle before it hands out the same rows in, and writes the same files under the same names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, table
from .units import slices, units

BLOCK_BYTES = 32_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def _cut(texts: list[str], pattern) -> tuple[list[str], np.ndarray, list[int]]:
    """Distinct words, word number at each position of all texts, positions a text."""
    piece_no: dict[str, int] = {}
    word_no: dict[str, int] = {}
    spelled: list[list[int]] = []
    seq: list[np.ndarray] = []
    for t in texts:
        us = units(t)
        for u in us:
            if u not in piece_no:
                piece_no[u] = len(piece_no)
                spelled.append([word_no.setdefault(w, len(word_no)) for w in pattern.findall(u)])
        seq.append(np.fromiter((piece_no[u] for u in us), np.int64, len(us)))
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    flat = np.fromiter((w for s in spelled for w in s), np.uint32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    lengths = [int(sizes[s].sum()) for s in seq]
    every = np.concatenate(seq) if seq else np.zeros(0, np.int64)
    return list(word_no), _ragged(flat, starts[every], sizes[every]), lengths


_WORDS = pa.schema([("block", pa.int64()), ("deal", pa.int32()), ("words", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("found", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes: high bytes, mostly alike, lie together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _pack(*parts: bytes) -> bytes:
    """Parts with their lengths, compressed together."""
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[e - s : e] for e, s in zip(ends, np.frombuffer(raw, "<u4", n, 4).astype(np.int64))]


_OUT = "key {kind}, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", full: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of every row; ids are 4 little-endian bytes each.

    ids and decoded are null unless ``full``. A null or empty text has no ids. Rows of equal keys or texts are rows like any other,
    null keys too; an empty table gives no rows. Other columns are dropped. A very long text is a block of its own, which one task cuts and one
    puts together again; its distinct words are dealt like those of any other block.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/bpe-{uuid.uuid4().hex}"
    model = spark.sparkContext.broadcast((pattern, ranks))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).sortWithinPartitions("key", F.xxhash64("text"))
    kind = docs.schema[key].dataType.simpleString()
    deals = 2 * shuffle_partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyarrow import fs
        from pyspark import TaskContext

        part, n, words_of = TaskContext.get().partitionId(), 0, regex.compile(model.value[0])
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for b in slices(batch, "text", block_bytes):
                block, n = part << 32 | n, n + 1
                words, codes, lengths = _cut(b["text"].fill_null("").to_pylist(), words_of)
                body = _pack(_planes(codes))
                head = pa.table({"key": b["key"], "length": pa.array(lengths, pa.int64())})
                temp = f"{root}/_{block}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(temp) as f:
                    with pa.ipc.new_stream(f, pa.schema([("codes", pa.binary())])) as w:
                        w.write_batch(pa.record_batch([[body]], names=["codes"]))
                    with pa.ipc.new_stream(f, head.schema) as w:
                        w.write_table(head)
                system.move(temp, f"{root}/{block}")
                spelled = [w.encode() for w in words]
                if not words:  # a block of empty texts still has rows
                    yield pa.record_batch([[block], [0], [_pack(b"", b"", b"")]], schema=_WORDS)
                    continue
                deal = np.fromiter((xxhash.xxh32_intdigest(w) % deals for w in spelled), np.int64, len(spelled))
                order = np.argsort(deal, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(deal[order]) != 0, True])
                rows = []
                for a, z in zip(edges, edges[1:]):
                    at = order[a:z]
                    some = [spelled[i] for i in at]
                    sizes = np.fromiter(map(len, some), np.int64, len(some))
                    rows.append((int(deal[at[0]]), _pack(_planes(np.diff(at, prepend=0)), _planes(sizes), b"".join(some))))
                yield pa.record_batch([[block] * len(rows), [r[0] for r in rows], [r[1] for r in rows]], schema=_WORDS)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=model.value[0], mergeable_ranks=model.value[1], special_tokens={})
        known: dict[bytes, bytes] = {}
        here = None
        for b in batches:
            for block, deal, packed in zip(b["block"].to_pylist(), b["deal"].to_pylist(), b["words"].to_pylist()):
                if deal != here:
                    known, here = {}, deal
                steps, sizes, body = _unpack(packed)
                ends = np.cumsum(_unplanes(sizes)).tolist() if sizes else []
                words = [body[a:z] for a, z in zip([0, *ends], ends)]
                for w in words:
                    if w not in known:
                        known[w] = np.array(encoder.encode_ordinary(w.decode()), "<u4").tobytes()
                ids = [known[w] for w in words]
                found = _pack(steps, _planes(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), _planes(np.frombuffer(b"".join(ids), "<u4")))
                yield pa.record_batch([[block], [found]], schema=_BACK)

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{root}/{group['block'].iloc[0]}") as f:
            body = pa.ipc.open_stream(f).read_all()["codes"][0].as_py()
            head = pa.ipc.open_stream(f).read_all()
        seq = _unplanes(_unpack(body)[0])
        parts = [_unpack(x) for x in group["found"]]
        code = np.concatenate([np.cumsum(_unplanes(p[0])) for p in parts]).astype(np.int64)
        size = np.concatenate([_unplanes(p[1]) for p in parts]).astype(np.int64)
        flat = np.concatenate([_unplanes(p[2]) for p in parts])
        starts = np.cumsum(size) - size
        place = np.empty(len(code), np.int64)
        if len(code) != len(np.unique(code)) or (len(code) and code.max() != len(code) - 1) or (len(seq) and seq.max() >= len(code)):
            raise ValueError("a block lacks words")
        place[code] = np.arange(len(code))
        tokens = sorted(model.value[1].items(), key=lambda x: x[1])
        most = tokens[-1][1] + 1 if tokens else 0
        token_size = np.zeros(most, np.int64)
        for t, r in tokens:
            token_size[r] = len(t)
        token_start, token_bytes = np.cumsum(token_size) - token_size, np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        out: dict[str, list] = {c: [] for c in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
        at = 0
        for n in head["length"].to_pylist():
            words = place[seq[at : at + n]]
            at += n
            ids = _ragged(flat, starts[words], size[words])
            raw, decoded = ids.tobytes(), _ragged(token_bytes, token_start[ids], token_size[ids]).tobytes()
            for c, v in zip(out, (len(ids), raw if full else None, decoded if full else None, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest())):
                out[c].append(v)
        return pd.DataFrame({"key": head["key"].to_pandas(integer_object_nulls=True), **out})

    asked = rows.mapInArrow(cut, "block long, deal int, words binary")
    back = asked.repartition("deal").sortWithinPartitions("deal", "block").mapInArrow(spell, "block long, found binary")
    return back.groupBy("block").applyInPandas(assemble, _OUT.format(kind=kind)).withColumnRenamed("key", key)


def op2_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """All documents encoded and decoded; see encode(). ranks: path of a rank file."""
    import public_tokenizers

    found = load_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(table(spark, sf_dir, "documents"), found, public_tokenizers.PATTERN, full=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op2_byte_bpe": op2_bpe}
SQL: dict[str, str] = {}
