"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``documents``; the
last returns the pieces of the packed sequences. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import line_dedup, packing, passages, simhash, toxicity
from panelspark.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go. The model is fitted on the labelled rows outside the held-out fifth."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents that have lost lines and have no word left."""
    kept = line_dedup.dedup(docs)
    return _sized(kept.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose 5-word shingles are 0.8 alike, the first stays."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place only."""
    return _sized(passages.cut_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lean: the executors' heaps have grown in the stages before."""
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return packing.pack(docs, f.read(), with_ids=False, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
#: No SQL: the stages fit a model, tokenize and place by hashes; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
