"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of DIMS signs, made from its code point by a hash. A trigram's vector binds its letters' vectors, each permuted by
its place (permutation: a turn by 64 coordinates; binding: the product of signs, an exclusive-or of bits). A text's vector bundles (adds) the vectors of all its
trigrams, a language's prototype those of its texts, each of unit length. A text has the language whose prototype is nearest to its vector by cosine.

Letters are what Unicode calls so, lower-cased; each run of other characters is one border. A text is held as counts of its trigrams, so bundling is a product
of the counts of a few hundred texts with the vectors of the trigrams these texts have. No table of trigrams or vocabulary is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sealed, table, unsealed

DIMS, UNIT = 1024, 1 << 20
TEXTS, POINTS, LANGS = 128, 1 << 18, 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of the multiply and shift kind, an element at a time."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(points: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(n, dims / 64) words of random bits of each code point."""
    at = points.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(dims // 64, dtype=np.uint64)[None]
    return _mixed((at + np.uint64(1)) * _ODD)


def trigram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(n, dims) signs, as floats, of trigrams packed 21 bits a letter."""
    mask = np.uint64((1 << 21) - 1)
    letters, back = np.unique(np.stack([grams >> np.uint64(42), (grams >> np.uint64(21)) & mask, grams & mask]), return_inverse=True)
    v, (a, b, c) = letter_vectors(letters, dims), back.reshape(3, -1)
    bound = np.roll(v, 2, axis=1)[a] ^ np.roll(v, 1, axis=1)[b] ^ v[c]
    return 1 - 2 * np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32)


_LETTER = np.array([chr(i).isalpha() for i in range(0x250)])


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters as they are, runs of anything else as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _LETTER[np.minimum(points, 0x24F)]
    far = np.flatnonzero(points >= 0x250)
    if len(far):
        kinds, back = np.unique(points[far], return_inverse=True)
        is_letter[far] = np.array([chr(k).isalpha() for k in kinds])[back]
    kept = np.where(is_letter, points, 0)
    return kept[is_letter | np.r_[True, is_letter[:-1]]] if len(kept) else kept


def _grams(text: str) -> Iterator[np.ndarray]:
    """Packed trigrams of " text ", some hundred thousand at a time; nothing for a text without a letter."""
    before = np.zeros(1, np.uint64)
    for at in range(0, len(text), POINTS):
        now = letters_of(text[at : at + POINTS]).astype(np.uint64)
        if before[-1] == 0 and len(now) and now[0] == 0:
            now = now[1:]  # one border, also where pieces meet
        row = np.r_[before, now, np.zeros(1 if at + POINTS >= len(text) and (len(now) and now[-1] or not len(now) and before[-1]) else 0, np.uint64)]
        if len(row) > 2:
            yield row[:-2] << np.uint64(42) | row[1:-1] << np.uint64(21) | row[2:]
        before = row[-2:]


def bundles(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """(n, dims): the sum of the trigram vectors of each text; zero for a null text or one without letters."""
    out = np.zeros((len(texts), dims))
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def add() -> None:
        if not parts:
            return
        kinds, back = np.unique(np.concatenate(parts), return_inverse=True)
        owners, row = np.unique(np.repeat(rows, [len(p) for p in parts]), return_inverse=True)
        counts = np.bincount(row * len(kinds) + back, minlength=len(owners) * len(kinds)).reshape(len(owners), len(kinds)).astype(np.float32)
        for at in range(0, len(kinds), 8192):
            out[owners] += counts[:, at : at + 8192] @ trigram_vectors(kinds[at : at + 8192], dims)
        rows.clear(), parts.clear()

    size = 0
    for i, t in enumerate(texts):
        for g in _grams(t or ""):
            rows.append(i), parts.append(g)
            size += len(g)
            if size >= POINTS or len(parts) >= TEXTS:
                add()
                size = 0
    add()
    return out


def held_out(key: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Each language's bundle. Texts count by unit vectors in whole numbers (UNIT a length of one), so the sum is the same in any order. Rows with a null language, a null text
    or no letter teach nothing."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                v = bundles(part["text"].to_pylist(), dims)
                size = np.sqrt((v * v).sum(1))
                unit = np.rint(v / np.maximum(size, 1)[:, None] * UNIT).astype(np.int64)
                for code, n in zip(part["lang"].to_pylist(), range(len(v))):
                    if size[n]:
                        sums[code] = sums[code] + unit[n] if code in sums else unit[n]
                if len(sums) > 256:
                    yield rows()
                    sums = {}
        yield rows()

    learned = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    each = learned.mapInArrow(add, "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x"))
    summed = each.groupBy("lang", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))
    got = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    return {r["lang"]: np.array(r["v"]) for r in got.orderBy("lang").collect()}  # dims numbers a language


def _teller(share):
    """Of a block of languages, the nearest and its cosine; null where nothing can be told."""

    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, vectors = share.value
        for b in batches:
            best, score = np.full(len(b), None, object), np.zeros(len(b))
            for at in range(0, len(b) if langs else 0, TEXTS):
                v = bundles([t if isinstance(t, str) else None for t in b.iloc[at : at + TEXTS]], vectors.shape[1])
                size = np.sqrt((v * v).sum(1))
                cos = v @ vectors.T / np.maximum(size, 1)[:, None]
                at_best = cos.argmax(1)
                for i in np.flatnonzero(size):
                    best[at + i], score[at + i] = langs[at_best[i]], min(1.0, max(-1.0, cos[i, at_best[i]]))
            yield pd.DataFrame({"lang": best, "score": score})

    return F.pandas_udf(tell, "lang string, score double")


def identify(docs: DataFrame, protos: dict[str, np.ndarray], text: str = "text", none: str = "und") -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (0 to 1: the cosine with that language's prototype, 0 if negative), in place of columns of these names.

    ``none`` and 0 for a null text, a text without letters, and where nothing was learned; of equal cosines the first language by name. A very long text is bundled whole,
    piece by piece; repeated rows come out alike; other columns pass through. Languages are compared LANGS at a time, so that no broadcast grows with their number.
    """
    spark = docs.sparkSession
    names = sorted(protos)
    unit = [protos[n] / max(np.linalg.norm(protos[n]), 1e-300) for n in names]
    blocks = [(names[i : i + LANGS], np.array(unit[i : i + LANGS])) for i in range(0, max(1, len(names)), LANGS)]
    told = sealed(docs, told=F.array(*[_teller(spark.sparkContext.broadcast(b))(F.col(text)) for b in blocks]))
    start = F.lit(None).cast("struct<lang string, score double>")
    best = F.aggregate(F.filter("told", lambda t: t["lang"].isNotNull()), start, lambda a, t: F.when(a.isNull() | (t["score"] > a["score"]), t).otherwise(a))
    told = told.select("row", best.alias("best"))
    return unsealed(told, docs.columns, lang_pred=F.coalesce("best.lang", F.lit(none)), score=F.coalesce(F.greatest(F.col("best.score"), F.lit(0.0)), F.lit(0.0)))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, told by prototypes of those outside the held-out third; see prototypes() and identify()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    protos = prototypes(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), protos).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op12_hyperdimensional_language": op12_language}
SQL: dict[str, str] = {}
