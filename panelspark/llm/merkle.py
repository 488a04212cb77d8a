"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections. DataFrame functions only.

Leaves are the sentences of a paragraph (a line), cut where one runs on past LEAF characters. A paragraph hashes its leaves. A
section is a run of paragraphs that ends where a paragraph's own hash says so (one in SECTION), so an edit moves no
boundary but those next to it. The root hashes the sections. Equal texts have equal roots; where roots differ, only the
sections, paragraphs and leaves whose hashes differ need a look, and those are where the edit is.

As text: ``root|sections|paragraphs|leaves``: md5 of the section hashes, then 16 hex digits a section and a paragraph (with
the number of its children after a dot) and a leaf, comma-separated. All hashes below the root have 64 bits.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

LEAF, SECTION = 200, 4
#: A sentence with its end marks and following spaces, or LEAF characters of one without an end.
_SENTENCE = r"[\s\S]{1,%d}?(?:[.!?]+\s*|$)|[\s\S]{%d}" % (LEAF, LEAF)


def leaf_hashes(text: Column) -> Column:
    """A paragraph an element: its leaves' 64-bit hashes."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_SENTENCE), F.lit(0)), lambda s: F.xxhash64(s)))


def paragraph_hashes(leaves: Column) -> Column:
    return F.transform(leaves, lambda x: F.xxhash64(x, F.lit("paragraph")))


def section_ends(paragraphs: Column) -> Column:
    """1-based place of the last paragraph of each section."""
    n = F.size(paragraphs)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.element_at(paragraphs, i), F.lit(SECTION)) == 0))


def section_hashes(paragraphs: Column, ends: Column) -> Column:
    def one(end, k):
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return F.xxhash64(F.slice(paragraphs, before + 1, end - before), F.lit("section"))

    return F.transform(ends, one)


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds {prefix}leaves (array of arrays), paragraphs, ends, sections and root (hex)."""
    p = prefix
    out = df.withColumn(f"{p}leaves", leaf_hashes(F.col(text)))
    out = out.withColumn(f"{p}paragraphs", paragraph_hashes(F.col(f"{p}leaves")))
    out = out.withColumn(f"{p}ends", section_ends(F.col(f"{p}paragraphs")))
    out = out.withColumn(f"{p}sections", section_hashes(F.col(f"{p}paragraphs"), F.col(f"{p}ends")))
    return out.withColumn(f"{p}root", F.md5(F.concat_ws(",", F.transform(f"{p}sections", lambda x: x.cast("string"))).cast("binary")))


def as_text(prefix: str = "") -> Column:
    """The fingerprint string of the columns that with_tree() made."""
    p = prefix
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    ends = F.col(f"{p}ends")
    sections = F.transform(f"{p}sections", lambda x, k: F.concat(wide(x), F.lit("."), (F.get(ends, k) - F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))).cast("string")))
    leaves = F.col(f"{p}leaves")
    paragraphs = F.transform(f"{p}paragraphs", lambda x, k: F.concat(wide(x), F.lit("."), F.size(F.get(leaves, k)).cast("string")))
    flat = F.transform(F.flatten(leaves), wide)
    return F.lower(F.concat_ws("|", F.col(f"{p}root"), F.array_join(sections, ","), F.array_join(paragraphs, ","), F.array_join(flat, ",")))


def likeness(a_root: Column, a: Column, b_root: Column, b: Column) -> Column:
    """1 for equal roots; else twice the shared distinct leaves over the distinct leaves of both. a, b: leaves."""
    x, y = F.array_distinct(F.flatten(a)), F.array_distinct(F.flatten(b))
    total = F.size(x) + F.size(y)
    shared = F.size(F.array_intersect(x, y)) * 2.0
    return F.when(a_root == b_root, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(shared / total)


def leaves_of(fingerprint: Column) -> Column:
    """The leaf hashes (hex) in a fingerprint string."""
    return F.filter(F.split(F.element_at(F.split(fingerprint, r"\|", -1), -1), ","), lambda x: x != "")


def text_likeness(a: Column, b: Column) -> Column:
    """likeness() of two fingerprint strings."""
    x, y = F.array_distinct(leaves_of(a)), F.array_distinct(leaves_of(b))
    total = F.size(x) + F.size(y)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) * 2.0 / total)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """0-based paragraphs of ``b`` (fingerprint strings) whose hash ``a`` does not have: where the edit is."""
    def parts(f):
        return F.transform(F.split(F.get(F.split(f, r"\|", -1), F.lit(2)), ","), lambda s: F.substring_index(s, ".", 1))

    old, new = parts(a), parts(b)
    at = F.transform(new, lambda h, i: F.when(F.array_contains(old, h), F.lit(-1)).otherwise(i))
    return F.when(a == b, F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: i >= 0))


def _squared(values: list[int | None]) -> Column:
    """A constant array of arrays of about equal size; one text in the plan, however many values."""
    side = max(1, int(len(values) ** 0.5))
    rows = [values[i : i + side] for i in range(0, len(values), side)]
    return F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")


def _at(values: list[int | None], i: Column) -> Column:
    """values[i]."""
    side = max(1, int(len(values) ** 0.5))
    return F.get(F.get(_squared(values), F.floor(i / side).cast("int")), (i % side).cast("int"))


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at or below the key; 0 for null. Two steps of the root of their number each."""
    if not cuts:
        return F.lit(0)
    side = max(1, int(len(cuts) ** 0.5))
    heads = F.transform(_squared(cuts), lambda row: F.get(row, F.lit(0)))
    below = F.size(F.filter(heads, lambda c: c <= key)) - 1
    inside = F.size(F.filter(F.get(_squared(cuts), below), lambda c: c <= key))
    return F.when(key.isNull() | (below < 0), F.lit(0)).otherwise(below * side + inside).cast("int")


def range_cuts(df: DataFrame, parts: int, key: str) -> list[int]:
    """Ascending first keys of all but the least of about ``parts`` even ranges. Only keys move, and a number a range reaches the driver."""
    if parts <= 1:
        return []
    ranged = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).repartitionByRange(parts, "k")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()
    return sorted({r["k"] for r in firsts})[1:]


def beside_next(df: DataFrame, columns: list[str], key: str = "doc_id", rows_per_range: int = 50_000) -> DataFrame:
    """Each row with ``next``: the given columns of the row next below it by the key; after the least, the greatest.

    The order is descending key (nulls last), then text hash. A window over one order for all rows would be one task, so keys are
    dealt into ranges of about ``rows_per_range`` rows, and each range borrows the greatest row of the range below it. Two numbers a
    range are all that reaches the driver. Rows of one key, and those without one, are in one range; document ids are meant to be unique.
    """
    parts = max(4 * shuffle_partitions(df.sparkSession), df.count() // rows_per_range)
    cuts = range_cuts(df, parts, key)
    bucket = _bucket(F.col(key).cast("long"), cuts)
    tops = {r["b"]: r["m"] for r in df.groupBy(bucket.alias("b")).agg(F.max(F.col(key).cast("long")).alias("m")).collect() if r["m"] is not None}
    if tops:
        held = sorted(tops)
        after = dict(zip(held, held[1:] + held[:1]))
        n = held[-1] + 1
        goes = _at([after.get(b) for b in range(n)], bucket)
        greatest = F.col(key).cast("long") == _at([tops.get(b) for b in range(n)], bucket)
        lent = F.when(greatest, F.array(F.struct(goes.cast("int").alias("b"), F.lit(1).alias("lent"))))
    else:
        lent = F.array(F.struct(F.lit(0).alias("b"), F.lit(1).alias("lent")))  # null keys only: one range
    own = F.array(F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("lent")))
    dealt = df.withColumn("_at", F.explode(F.coalesce(F.concat(own, lent), own)))
    w = Window.partitionBy("_at.b").orderBy("_at.lent", F.col(key).desc_nulls_last(), F.xxhash64(*columns))
    out = dealt.withColumn("next", F.lead(F.struct(*columns)).over(w))
    return out.where("_at.lent = 0").drop("_at")


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    edited: the text with its last floor(n / 3) code points replaced by the first as many of the next document's text. A null text is
    empty: its tree has one paragraph without leaves. A very long text is a long list of leaves. Rows with equal keys are ordered by a hash
    of their text. An empty table gives no rows. Other columns are dropped.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_leaves", leaf_hashes(F.col("_t")))
    rows = beside_next(rows, ["_t", "_leaves"], key)
    n = F.char_length("_t")
    tail = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("_t"), F.lit(1), n - tail), F.substring(F.coalesce(F.col("next._t"), F.col("_t")), F.lit(1), tail)))
    for p, leaves in (("a_", F.col("_leaves")), ("b_", leaf_hashes(F.col("edited"))), ("c_", F.coalesce(F.col("next._leaves"), F.col("_leaves")))):
        rows = rows.withColumn(f"{p}leaves", leaves).withColumn(f"{p}paragraphs", paragraph_hashes(F.col(f"{p}leaves")))
        rows = rows.withColumn(f"{p}ends", section_ends(F.col(f"{p}paragraphs")))
        rows = rows.withColumn(f"{p}sections", section_hashes(F.col(f"{p}paragraphs"), F.col(f"{p}ends")))
        rows = rows.withColumn(f"{p}root", F.md5(F.concat_ws(",", F.transform(f"{p}sections", lambda x: x.cast("string"))).cast("binary")))
    return rows.select(
        key, "n_chars", "edited", as_text("a_").alias("fingerprint"), as_text("b_").alias("edited_fingerprint"),
        likeness(F.col("a_root"), F.col("a_leaves"), F.col("b_root"), F.col("b_leaves")).alias("near_edited"),
        likeness(F.col("a_root"), F.col("a_leaves"), F.col("c_root"), F.col("c_leaves")).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see fingerprint_pairs()."""
    out = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op6_merkle_fingerprints": op6_fingerprints}
SQL: dict[str, str] = {}
