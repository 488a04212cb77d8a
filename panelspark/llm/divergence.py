"""How far the sources of a language differ in their words, exactly and in whole numbers.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the V terms that at least ``least_docs`` of its documents hold. A (language, source) group
with N occurrences of kept terms gives a term of which it has c the share p = 1 + floor(SCALE (c + 2) / (N + 2 V)), also where c is 0; two shares differ by
f(p, q) = floor((p - q)^2 / (p + q)).

Pairs of sources are sums of f over all V terms, made from what is there only: with b a group's share of a term that it lacks,
  sum = V f(bg, bh) + sum over g's terms of (f(p, bh) - f(bg, bh)) + the same for h + sum over shared terms of (f(p, q) - f(p, bh) - f(bg, q) + f(bg, bh)).
The middle sums come from each group's histogram of shares; the last is summed within the task that holds a term and leaves it as one number a pair.
The terms that mark a group against its language are found by radix selection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import radix
from .common import Scratch, table

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
ENTRIES, CELLS, SLICE = 200_000, 200_000, 1 << 22
#: Letters keep their byte (A-Z lower-cased), bytes of non-ASCII characters too; all else parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a few megabytes at a time, cut between terms."""
    plain, at = text.translate(_TERM), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield (plain if at == 0 and end == len(plain) else plain[at:end]).split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d), several rows a key: occurrences and documents of a term. Nulls read as ''. Each group has a row of the empty term, with zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            for (g, s), (n, d) in held.items():
                terms = [b"", *n]
                yield pa.record_batch(
                    [pa.array([g] * len(terms)), pa.array([s] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )

        size = 0
        for b in batches:
            for raw, g, s in zip(b["text"], b["lang"].to_pylist(), b["source"].to_pylist()):
                n, d = held.setdefault((g, s), (Counter(), Counter()))
                before, seen = len(n), None
                for words in _pieces(raw.as_buffer().to_pybytes() if raw.is_valid else b""):
                    n.update(words)
                    fresh = set(words) if seen is None else set(words) - seen
                    d.update(fresh)
                    if len(raw.as_buffer()) > SLICE:
                        seen = (seen or set()) | fresh
                size += len(n) - before + 1
                if size > ENTRIES:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    named = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    return named.mapInArrow(count, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 2) / total), exact for any long."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block(sources: np.ndarray, terms: np.ndarray, p: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, source, sum) over the terms of a block, of sources whose corrections don't cancel; rows sorted by (term, source)."""
    names, code = np.unique(sources, return_inverse=True)
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    sizes = np.diff(np.r_[starts, len(terms)])
    left = np.repeat(sizes, sizes) - (np.arange(len(terms)) - np.repeat(starts, sizes)) - 1  # rows of the same term behind each
    keys, sums, at, step = [], [], np.flatnonzero(left > 0), 1
    while len(at):
        to = at + step
        v = _gaps(p[at], p[to]) - _gaps(p[at], base[to]) - _gaps(base[at], p[to]) + _gaps(base[at], base[to])
        pair, back = np.unique(code[at] * len(names) + code[to], return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back, v)
        keys.append(pair), sums.append(total)
        step += 1
        at = at[left[at] >= step]
        if len(keys) > 256 or not len(at):
            pair, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, back, np.concatenate(sums))
            keys, sums = [pair], [total]
    if not keys:
        return names[:0], names[:0], np.zeros(0, np.int64)
    return names[keys[0] // len(names)], names[keys[0] % len(names)], sums[0]


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of rows (lang, source, term, p, b) sorted by (lang, term, source): sums over the terms of a block, a before b. Blocks end with a term."""
    kept: list[pa.RecordBatch] = []
    size = 0

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = rows["lang"].to_numpy()
        edges = np.flatnonzero(np.r_[True, langs[1:] != langs[:-1], True])
        for i, z in zip(edges, edges[1:]):
            part = rows.slice(i, z - i)
            a, b, v = _block(*(part[c].to_numpy() for c in ("source", "term", "p", "b")))
            if len(v):
                yield pa.record_batch([pa.array([langs[i]] * len(v), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v)], names=["lang", "a", "b", "value"])

    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size < CELLS:
            continue
        rows = pa.Table.from_batches(kept).combine_chunks()
        lang, term = rows["lang"].to_numpy(), rows["term"].to_numpy()
        open_ = np.flatnonzero((term != term[-1]) | (lang != lang[-1]))
        whole = int(open_[-1]) + 1 if len(open_) else 0
        yield from solved(rows.slice(0, whole))
        kept = rows.slice(whole).to_batches()
        size = 0 if whole else size // 2
    if kept:
        yield from solved(pa.Table.from_batches(kept).combine_chunks())


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language and the sum of f over all kept terms, all ranks. Part ``term``: each kept term of which the group has more
    than its language (p > q), f against the language, ranks to ``top``. Ranks are by value descending, then the item's UTF-8 bytes.

    A null text, language or source reads as ''. Each row is a document, so repeated rows count each time. Groups without terms take part in pairs; a language
    without kept terms has pairs of value 0; one with a single source has no pairs. Texts are read whole at any length. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    raw = term_counts(docs, text, lang, source).repartition("lang", "term")  # what follows stays in place
    one = raw.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    whole = one.withColumn("docs", F.sum("d").over(term)).withColumn("n_lang", F.sum("n").over(term)).withColumn("place", F.row_number().over(term.orderBy("source")))
    kept = whole.where((F.col("docs") >= least_docs) | (F.col("term") == ""))
    cells = scratch.keep(kept.select("lang", "source", "term", "n", "n_lang", ((F.col("place") == 1) & (F.col("term") != "")).cast("long").alias("new")), "cells")
    langs = cells.groupBy("lang").agg(F.sum("new").alias("v"), F.sum("n").alias("N_lang"))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("N")).join(langs, "lang")
    sized = lambda n: F.greatest(F.col(n) + 2 * F.col("v"), F.lit(1))
    groups = scratch.keep(groups.select("lang", "source", "v", sized("N").alias("total"), sized("N_lang").alias("total_lang"), share(F.lit(0), sized("N")).alias("b")), "groups")
    held = cells.where("n > 0").join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))
    held = scratch.keep(held.select("lang", "source", "term", "p", share(F.col("n_lang"), F.col("total_lang")).alias("q"), "b"), "held")

    marks = held.where("p > q").select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
    terms = radix.top_k(scratch.keep(marks, "marks"), scratch, ["lang", "source"], "value", "term", top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("b").alias("b2"))
    both = groups.select("lang", "source", "v", "b").join(other, "lang").where("source <> item")
    base = both.select("lang", "source", "item", (F.col("v") * gap(F.col("b"), F.col("b2"))).alias("value"))
    shares = held.groupBy("lang", "source", "b", "p").agg(F.count("*").alias("m")).join(other, "lang").where("source <> item")
    single = shares.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("b2")) - gap(F.col("b"), F.col("b2")))).alias("value"))
    shared = held.select("lang", "source", "term", "p", "b").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_corrections, "lang string, a string, b string, value long")
    shared = shared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # both directions of one aggregate: (source, item) and (item, source)
    half = single.select("lang", "source", "item", "value").unionByName(shared.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"))
    turned = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value").select("lang", "e.source", "e.item", "value")
    pairs = base.unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the ten terms that mark each source; see audit()."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {"op11_source_divergence": op11_divergence}
SQL = {
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
o AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT x.lang, source, term, n, v, sum(n) OVER (PARTITION BY x.lang, source) AS big, sum(n) OVER (PARTITION BY x.lang, term) AS n2, sum(n) OVER (PARTITION BY x.lang) AS big2
      FROM x JOIN v ON x.lang = v.lang),
p AS (SELECT lang, source, term, n,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // CAST(big + 2 * v AS HUGEINT) AS BIGINT) AS p,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * (n2 + 2)) // CAST(big2 + 2 * v AS HUGEINT) AS BIGINT) AS q
      FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
          FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
}
