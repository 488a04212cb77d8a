"""Toxicity of noisy text: decode disguised words, then score the restored text.

Channel: a written word may stand for another through look-alike signs (LOOKS), letters set apart ("i d i o t", "i.d.i.o.t") or
letters drawn out ("stuuuupid"). A disguised span becomes a lattice, one column a character, of the letters it may stand for; Viterbi
finds the likeliest path under a character trigram model. The model's counts come from every document; its table has 64 cubed
entries at any input size.

Score: a logistic model over cues, a restored word and its first 3 to 8 letters. The classifier is fitted on a bounded sample of labelled rows, at most
SAMPLE of each class (smallest hash of the id): its cues are the CUES of most gain in that sample, and its constant is set back to the share
of toxic rows among all training labels. Inputs of a score are the text's words and nothing else; every text is decoded and scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hold, table

CUES, SAMPLE, LEAST_DOCS, LEAST_GAIN, RIDGE = 2000, 5000, 3, 8.0, 0.1
#: Signs and the letters they are written for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
SWAP, STRETCH, GAP = -1.0, -0.5, -3.0  # log costs: a look-alike, a run cut short, a word border between letters set apart
_LONG, _ENDS = re.compile(r"(.)\1\1"), "\"'`.,;:?!()[]{}<>«»¡¿-_…"
_CORE = re.compile(r"[^\W\d_](?:.*[^\W\d_])?")
_APART = re.compile(r"(?:[^\W\d_][.\-_*·]){2,}[^\W\d_]")

#: Character classes of the model: 0 border, 1-26 a-z, 27-59 the letters U+00DF to U+00FF, 60 digits, 61 other letters.
_CLASS = np.zeros(0x250, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[0xDF:0x100] = np.arange(27, 60)
_CLASS[0xC0:0xDF] = np.arange(28, 59)
_CLASS[ord("0") : ord("9") + 1] = 60
_CLASS[0x100:] = 61


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], 61).astype(np.int64)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts by (class, class, class) over all texts; at most 64 ** 3 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for b in batches:
            for t in b["text"].to_pylist():
                if t:
                    for at in range(0, len(t), 1 << 20):
                        c = classes(" " + t[max(0, at - 2) : at + (1 << 20)] + " ")
                        total += np.bincount(c[:-2] << 12 | c[1:-1] << 6 | c[2:], minlength=1 << 18)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["t", "n"])

    made = docs.select(F.col(text).alias("text")).mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 18, np.int64)
    for r in made:
        out[r["t"]] = r["n"]
    return out


def language_model(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """log P(third | first two), [64, 64, 64]."""
    n = counts.reshape(64, 64, 64) + smooth
    return np.log(n / n.sum(2, keepdims=True)).astype(np.float32)


def viterbi(columns: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest string; a column's alternatives are (string, log cost), the string may be empty, a letter, a letter twice or a space."""
    one = lambda ch: int(_CLASS[ord(ch)]) if ord(ch) < 0x250 else 61
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for column in [*columns, [(" ", 0.0)]]:
        fresh: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, done) in paths.items():
            for s, cost in column:
                x, y, now = a, b, score + cost
                for ch in s:
                    z = one(ch)
                    now += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in fresh or now > fresh[x, y][0]:
                    fresh[x, y] = (now, done + s)
        paths = fresh
    return max(paths.values())[1].strip()


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Columns of a lower-cased span. Signs without a letter, and separators between single letters, may vanish or end a word."""
    out, at = [], 0
    while at < len(span):
        ch, n = span[at], 1
        while at + n < len(span) and span[at + n] == ch:
            n += 1
        letters = [(ch, 0.0)] if ch.isalpha() else [(x, SWAP) for x in LOOKS.get(ch, "")]
        if not letters:
            out.append([("", 0.0), (" ", GAP)])
        elif n > 2:
            out.append([(x * k, cost + STRETCH) for x, cost in letters for k in (1, 2)])
        else:
            out.extend([letters] * n)
        at += n
    return out


def disguised(word: str) -> bool:
    """Lower-cased word without end marks: letters with look-alikes among them, letters set apart, or a drawn-out letter."""
    if word.isalpha():
        return _LONG.search(word) is not None
    if not any(c.isalpha() for c in word):
        return False
    return any(c in LOOKS for c in word) or _LONG.search(word) is not None or _APART.fullmatch(word) is not None


class Words:
    """What cues of words stand for; a worker's cache, emptied when full. ``meaning`` maps a cue to what a caller counts; None: to itself."""

    def __init__(self, model: np.ndarray, meaning: dict[str, int] | None = None, most: int = 150_000):
        self.model, self.meaning, self.most, self.known = model, meaning, most, {}

    @staticmethod
    def cues(word: str) -> list[str]:
        return [word[:n] for n in range(3, min(8, len(word)) + 1)] + [word + "$"]

    def _told(self, cues: Iterable[str]) -> tuple:
        return tuple(set(cues)) if self.meaning is None else tuple({self.meaning[c] for c in cues if c in self.meaning})

    def of(self, token: str) -> tuple:
        """Of a white-space token as it stands, without signs at its ends, and as it is restored."""
        got = self.known.get(token)
        if got is None:
            w = token.strip(_ENDS)
            found = self.cues(w)
            core = _CORE.search(w)
            if core and core[0] != w:
                found += self.cues(core[0])
            left = token.lstrip("\"'`.,;:?()[]{}<>«»¡¿-_…").rstrip(_ENDS)  # a leading ! or | may be a letter
            if disguised(left):
                for part in viterbi(lattice(left), self.model).split():
                    found += self.cues(part)
            got = self._told(found)
            if len(token) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = got
        return got

    def text(self, text: str | None) -> set:
        """Of a whole text."""
        words = (text or "").lower().split()
        out: set = set()
        for w in set(words):
            got = self.of(w)
            if got:
                out.update(got)
        for run in self.runs(words):
            for part in viterbi(lattice(run), self.model).split():
                out.update(self._told(self.cues(part)))
        return out

    @staticmethod
    def runs(words: list[str]) -> list[str]:
        """Three or more single characters in a row, joined by spaces."""
        out, run = [], []
        for i in [i for i, w in enumerate(words) if len(w) == 1] + [-9]:
            if run and i != run[-1] + 1:
                if len(run) > 2:
                    out.append(" ".join(words[j] for j in run))
                run = []
            run.append(i)
        return out


def _words(shared, meaning=None) -> Words:
    """One cache a worker, model and use; it holds both, so no others can take their ids."""
    return hold("words", (id(shared), id(meaning)), lambda: Words(shared, meaning))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """What a score needs: the character model, a weight a cue, a constant."""

    def __init__(self, lm: np.ndarray, weights: dict[str, float], constant: float):
        self.lm, self.weights, self.constant = lm, weights, constant


def _fit(x: np.ndarray, shares: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 60, block: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression on x (0 and 1, in bytes) times the root of shares, with a ridge on all but the constant, by Newton steps, halved where the loss would
    rise. Rows become numbers a block at a time."""
    scale = np.r_[np.sqrt(shares), 1.0]
    pull = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def blocks():
        for at in range(0, len(x), block):
            part = x[at : at + block]
            yield np.concatenate([part, np.ones((len(part), 1), np.uint8)], 1) * scale, y[at : at + block]

    def loss(w: np.ndarray) -> float:
        return sum(float(np.logaddexp(0, np.where(t > 0, -1, 1) * (z @ w)).sum()) for z, t in blocks()) + float((pull * w * w).sum()) / 2

    w = np.zeros(len(scale))
    now = loss(w)
    for _ in range(rounds):
        curve, slope = np.diag(pull), pull * w
        for z, t in blocks():
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (p - t)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def gain(a, b, n_pos: int, n_neg: int):
    """Log-likelihood ratio of a cue's table (a of n_pos toxic, b of n_neg other texts hold it), as Columns; 0 where it speaks against the label."""
    hit, total = a + b, n_pos + n_neg

    def term(o, rows, with_cue):
        expected = F.lit(float(rows)) * with_cue / F.lit(float(total))
        return F.when(o > 0, o * F.ln(o / expected)).otherwise(F.lit(0.0))

    terms = term(a, n_pos, hit) + term(b, n_neg, hit) + term(n_pos - a, n_pos, total - hit) + term(n_neg - b, n_neg, total - hit)
    return F.when(a * n_neg > b * n_pos, terms).otherwise(F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most_cues: int = CUES) -> Model:
    """Fit on the labelled rows outside the held-out fifth. Null labels or keys don't count, of several labels of one key the greatest does; without toxic
    rows every score is the constant's. ``sample`` bounds the rows of a class that the classifier is fitted on; the language model reads all texts."""
    spark = docs.sparkSession
    lm = language_model(trigram_counts(docs, text))
    share = spark.sparkContext.broadcast(lm)
    y = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    y = y.groupBy(F.col(key).alias("k")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return Model(lm, {}, 30.0 if total.get(1) else -30.0)
    # chosen among the narrow labels; then at most 2 * sample rows pick their texts out of the scan
    parts = [y.where(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(sample) for v in (0, 1)]
    rows = docs.where(~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(text).alias("text"))
    scratch = Scratch(spark, "toxic")
    picked = scratch.keep(rows.join(F.broadcast(parts[0].unionByName(parts[1])), "k").select("y", "text"), "sample")
    sizes = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log(total[1] / total[0]))
    if not n_pos or not n_neg:
        return Model(lm, {}, prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _words(share.value), Counter()
        for b in batches:
            for label_, t in zip(b["y"].to_pylist(), b["text"].to_pylist()):
                counts.update((c, label_) for c in words.text(t))
                if len(counts) > 500_000:
                    yield pa.record_batch([[c for c, _ in counts], pa.array([v for _, v in counts], pa.int32()), list(counts.values())], names=["cue", "y", "n"])
                    counts = Counter()
        yield pa.record_batch([pa.array([c for c, _ in counts], pa.string()), pa.array([v for _, v in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["cue", "y", "n"])

    of = lambda v: F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0))
    counted = picked.mapInArrow(count, "cue string, y int, n long").groupBy("cue").agg(of(1).alias("a"), of(0).alias("b")).where(F.col("a") >= LEAST_DOCS)
    ranked = counted.select("cue", gain(F.col("a"), F.col("b"), n_pos, n_neg).alias("g")).where(F.col("g") > LEAST_GAIN)
    cues = {r["cue"]: i for i, r in enumerate(ranked.orderBy(F.desc("g"), "cue").limit(most_cues).collect())}
    if not cues:
        return Model(lm, {}, prior)
    index = spark.sparkContext.broadcast(cues)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(share.value, index.value)
        for b in batches:
            yield pa.record_batch([b["y"], pa.array([sorted(words.text(t)) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], names=["y", "x"])

    got = picked.mapInArrow(vectors, "y int, x array<int>").collect()  # at most 2 * sample short lists
    x, target = np.zeros((len(got), len(cues)), np.uint8), np.array([r["y"] for r in got], float)
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
    scratch.drop(picked)
    # equal columns share a weight; one each keeps the Newton steps small
    kinds, back, shares = np.unique(x, axis=1, return_inverse=True, return_counts=True)
    w, c = _fit(kinds, shares, target)
    w = (w / np.sqrt(shares))[back.ravel()]
    return Model(lm, {cue: float(w[i]) for cue, i in cues.items()}, float(c + prior - np.log(n_pos / n_neg)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1), in place of a column of that name if there is one. A null or empty text scores as one without cues; a very long text
    is read whole; repeated rows score alike. Rows and other columns pass through."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(model.lm)
    names = sorted(model.weights)
    rest = spark.sparkContext.broadcast(({c: i for i, c in enumerate(names)}, np.array([model.weights[c] for c in names]), model.constant))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, weights, constant = rest.value
        words = _words(share.value, index)
        for b in batches:
            total = [constant + float(weights[sorted(words.text(t))].sum()) for t in b]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(total, float), -60, 60))))

    return docs.drop("score").withColumn("score", run(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; see train() and score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op7_noisy_channel_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
