"""Token ids in sorted-string-table shards.

A shard is one file, keys ascending, over one range of identifiers:

    magic | data block ... | index | Bloom filter | footer

* key: a null byte, or 1 and the identifier as 8 big-endian bytes with the sign bit flipped, so bytes sort as numbers do;
* block: entries (shared, unshared, value length as varints, key rest, value); every RESTART entries the key is whole, and the
  restart places end the block, so a lookup is a binary search over restarts and a short scan; zstd over the block;
* index: a block's first key, last key, place and length, and its first token's number: sparse, searched by bisection;
* Bloom filter: 10 bits and 7 probes a distinct key, answers most misses without reading a block;
* footer: 56 bytes with the places, counts and a checksum of index and filter.

Values are ids of 2 or 4 little-endian bytes (a leading byte says which). A task writes its shard under a name of its attempt in
the shared folder and renames it, so a retried task leaves whole files only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .units import slices, tokenizer_cache

MAGIC, RESTART, BLOCK, END_ID = b"PSSST001", 16, 1 << 18, 0
_FOOTER = struct.Struct("<6QI4x8s")  # index place and length, filter place and length, entries, tokens, checksum, magic


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def pack_ids(raw: bytes) -> bytes:
    """raw: ids of 4 bytes."""
    ids = np.frombuffer(raw, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + raw


def unpack_ids(value: bytes) -> bytes:
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[:1] == b"\x02" else value[1:]


class Writer:
    """Keys must come in ascending order; equal keys may repeat."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block_size, self.at = out, block, 0
        self.zip = zstandard.ZstdCompressor(level=3)
        self.index: list[tuple[bytes, bytes, int, int, int]] = []
        self.keys: list[int] = []
        self.entries = self.tokens = 0
        self._write(MAGIC)
        self._open()

    def _write(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def _open(self) -> None:
        self.buf, self.restarts, self.n, self.first, self.last, self.base = bytearray(), [], 0, b"", b"", self.tokens

    def add(self, key: bytes, raw: bytes) -> None:
        if self.n and len(self.buf) > self.block_size:
            self._close()
        value, shared = pack_ids(raw), 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.buf))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if not self.n:
            self.first = key
        if not self.entries or key != self.last_key:
            self.keys.append(xxhash.xxh64_intdigest(key))
        self.buf += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = self.last_key = key
        self.n += 1
        self.entries += 1
        self.tokens += len(raw) // 4

    def _close(self) -> None:
        if self.n:
            tail = struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            body = self.zip.compress(bytes(self.buf) + tail)
            self.index.append((self.first, self.last, self.at, len(body), self.base))
            self._write(body)
        self._open()

    def close(self) -> None:
        self._close()
        index = b"".join(_varint(len(a)) + a + _varint(len(z)) + z + struct.pack("<QIQ", at, n, base) for a, z, at, n, base in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for h in self.keys:
            for p in _probes(h, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        where = self.at
        self._write(index)
        self._write(struct.pack("<Q", bits) + bytes(bloom))
        check = zlib.crc32(bytes(bloom), zlib.crc32(index))
        self._write(_FOOTER.pack(where, len(index), where + len(index), 8 + len(bloom), self.entries, self.tokens, check, MAGIC))


def _probes(h: int, bits: int) -> list[int]:
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(7)]


class Reader:
    """Over a seekable binary file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, check, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        f.seek(index_at)
        index = f.read(index_n)
        f.seek(bloom_at)
        bloom = f.read(bloom_n)
        if zlib.crc32(bloom[8:], zlib.crc32(index)) != check:
            raise ValueError("index or filter is damaged")
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            first, at = index[at : at + n], at + n
            n, at = _read_varint(index, at)
            last, at = index[at : at + n], at + n
            self.blocks.append((first, last, *struct.unpack_from("<QIQ", index, at)))
            at += 20
        self.lasts = [b[1] for b in self.blocks]

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        self.f.seek(self.blocks[i][2])
        b = zstandard.ZstdDecompressor().decompress(self.f.read(self.blocks[i][3]))
        n = struct.unpack("<I", b[-4:])[0]
        return b[: -4 - 4 * n], list(struct.unpack(f"<{n}I", b[-4 - 4 * n : -4]))

    @staticmethod
    def _scan(b: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            size, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            yield key, b[at : at + size]
            at += size

    def items(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(identifier, tokens before it in the shard, ids of 4 bytes) in key order."""
        for i, block in enumerate(self.blocks):
            start = block[4]
            for key, value in self._scan(self._block(i)[0], 0):
                raw = unpack_ids(value)
                yield id_of(key), start, raw
                start += len(raw) // 4

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of every entry of that identifier."""
        key = key_of(doc_id)
        h = xxhash.xxh64_intdigest(key)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(h, self.bits)):
            return []
        found = []
        for i in range(bisect_left(self.lasts, key), len(self.blocks)):
            if self.blocks[i][0] > key:
                break
            b, restarts = self._block(i)
            at = bisect_left(restarts, True, key=lambda r: next(self._scan(b, r))[0] >= key)
            for k, value in self._scan(b, restarts[max(0, at - 1)]):
                if k > key:
                    break
                if k == key:
                    found.append(unpack_ids(value))
        return found


def open_shard(uri: str) -> Reader:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return Reader(system.open_input_file(path), system.get_file_info(path).size)


_MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("entries", pa.int64()), ("tokens", pa.int64())])


def write(docs: DataFrame, tokenizer_json: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> list[dict]:
    """Encode every row's text, end_id last, into shards of ascending key; the manifest, a dict a shard in key order.

    A null text is an empty one. A null key sorts before all others; rows of one key stand side by side, ordered by a hash of the
    text. An empty table makes no shard. Other columns are not stored. The keys must be integers. A very long text is
    encoded whole by one task and is one entry, the last of its block, which grows to hold it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    model = spark.sparkContext.broadcast(tokenizer_json)
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        cache, context = tokenizer_cache(model.value), TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        part, out, writer = context.partitionId(), None, None
        name = f"{root}/_writing-{part}-{context.taskAttemptId()}"
        for batch in batches:
            for b in slices(batch, "text"):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(name)
                    writer = Writer(out)
                for doc_id, raw in zip(b["key"].to_pylist(), cache.texts(b["text"].to_pylist())):
                    writer.add(key_of(doc_id), raw + end)
        if writer is None:
            return
        writer.close()
        out.close()
        system.move(name, f"{root}/part-{part:06d}.sst")
        yield pa.record_batch([[f"{folder}/part-{part:06d}.sst"], [part], [writer.entries], [writer.tokens]], schema=_MANIFEST)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    made = ordered.mapInArrow(task, "path string, part int, entries long, tokens long").collect()  # a row a shard
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["tokens"]
    return manifest


_ROWS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids, ids_crc32) of every entry, read from the shards; a task reads whole shards, block by block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                rows: list[tuple] = []
                size = 0
                for doc_id, start, raw in open_shard(uri).items():
                    rows.append((doc_id, base + start, len(raw) // 4, raw if with_ids else None, zlib.crc32(raw)))
                    size += len(raw) if with_ids else 64
                    if size > 8_000_000:
                        yield pa.record_batch([list(x) for x in zip(*rows)], schema=_ROWS)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([list(x) for x in zip(*rows)], schema=_ROWS)

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(task, "key long, start long, n_tokens long, ids binary, ids_crc32 long")


def op1_sstable(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents through the shard files and back; see write() for nulls and ties. tokenizer: path of a tokenizers JSON."""
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        manifest = write(table(spark, sf_dir, "documents"), f.read())
    return read(spark, manifest, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_sstable_token_shards": op1_sstable}
SQL: dict[str, str] = {}
