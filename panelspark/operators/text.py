"""Filings: event flags, anonymising, chunks, tone, quotes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_index, period_index
from .joins import trailing

#: The default scorer's words.
GOOD = ("gain", "good", "strong", "improve", "growth", "the", "on")
BAD = ("loss", "bad", "weak", "decline", "trash", "stupid", "th")


def item_name(item: str) -> str:
    return item.replace(".", "_")


def event_flags(filings: DataFrame, keys: DataFrame, flags: list[str], counted: list[str], entity: str = "entity", date: str = "filing_date", out: str = "eom", period: str = "month", span: int = 12) -> DataFrame:
    """Per key: has_filing, n_filings and item_* of its period (null without a filing), hist_* over the last ``span`` periods (0 without).

    History counts all filings of the entity, in periods that have no key too.
    """
    at = month_end(F.col(date)) if period == "month" else F.to_date(date)
    has = lambda x: F.coalesce(F.array_contains("items", x), F.lit(False)).cast("int")
    f = filings.select(entity, at.alias(out), *[has(x).alias(f"item_{item_name(x)}") for x in flags], *[has(x).alias(f"hist_{item_name(x)}") for x in counted])
    current = [f"item_{item_name(x)}" for x in flags]
    history = [f"hist_{item_name(x)}" for x in counted]
    m = f.groupBy(entity, out).agg(F.count(F.lit(1)).alias("n_filings"), *[F.max(c).alias(c) for c in current], *[F.sum(c).alias(c) for c in history])
    facts = m.select(entity, period_index(F.col(out), period).alias("idx"), *history)
    past = trailing(keys, facts, range(span), {c: F.sum(c) for c in history}, entity, out, period)
    got = keys.select(entity, out).join(m.select(entity, out, "n_filings", *current), [entity, out], "left")
    got = got.withColumn("has_filing", F.col("n_filings").isNotNull().cast("int")).join(past, [entity, out], "left")
    return got.select(entity, out, "has_filing", "n_filings", *current, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in history])


def _pattern(terms: list, flags: int) -> re.Pattern | None:
    words = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", flags) if words else None


def anonymise_text(text: str | None, names: list, tickers: list) -> str:
    """Whole-word names in any case, then tickers as written, each replaced by a space; longer terms first."""
    text = text or ""
    for p in (_pattern(names, re.IGNORECASE), _pattern(tickers, 0)):
        text = p.sub(" ", text) if p else text
    return text


def anonymise_constant(text: Column, names: list[str], tickers: list[str]) -> Column:
    """The same for terms that are alike for all rows: JVM regular expressions."""
    for terms, mode in ((names, "(?iu)"), (tickers, "")):
        words = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
        if words:
            quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
            text = F.regexp_replace(text, rf"{mode}(?<!\w)(?:{quoted})(?!\w)", " ")
    return text


def anonymise(text: Column, names: Column, tickers: Column) -> Column:
    """Terms by row: arrays of names and of tickers."""

    def run(t: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([anonymise_text(a, list(b) if b is not None else [], list(c) if c is not None else []) for a, b, c in zip(t, n, k)])

    return F.pandas_udf(run, "string")(text, names, tickers)


def chunks(tokens: Column, size: int = 512, most: int | None = 8) -> Column:
    """Arrays of at most size - 2 tokens (two places are for marks), at most ``most`` of them (None: as many as there are); none for no tokens."""
    step = size - 2
    used = F.size(tokens) if most is None else F.least(F.size(tokens), F.lit(step * most))
    starts = F.when(used > 0, F.sequence(F.lit(0), used - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, step))


def word_tone(words: Column) -> Column:
    """Default score of a chunk: (good - bad) / words."""
    worth = lambda w: F.when(w.isin(*GOOD), 1).when(w.isin(*BAD), -1).otherwise(0)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + worth(F.lower(w)))  # one pass over the words
    return F.try_divide(total.cast("double"), F.size(words).cast("double"))


def doc_tones(filings: DataFrame, size: int = 512, most: int | None = 8, score: Callable[[Column], Column] = word_tone, text: str = "text") -> DataFrame:
    """(document_id, tone_mean, tone_min) over a document's first ``most`` chunks (None: all); a document without words has nulls."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    scored = filings.withColumn("_s", F.transform(chunks(words, size, most), score))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    return scored.select("document_id", F.try_divide(total, F.size("_s").cast("double")).alias("tone_mean"), F.array_min("_s").alias("tone_min"))


def doc_tones_model(filings: DataFrame, load: Callable[[], Callable[[list[list[str]]], list[float]]], size: int = 512, most: int = 8, batch: int = 256, text: str = "text") -> DataFrame:
    """The same with a model: load() is called once a task and returns a function from chunks (word lists) to scores. Chunks are scored in order of
    length in batches, so padding stays small."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            parts: list[tuple[int, list[str]]] = []
            for i, t in enumerate(f["text"]):
                words = (t or "").split()
                parts += [(i, words[a : a + size - 2]) for a in range(0, min(len(words), (size - 2) * most), size - 2)]
            order, scores = sorted(range(len(parts)), key=lambda j: len(parts[j][1])), [0.0] * len(parts)
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                for j, v in zip(some, model([parts[j][1] for j in some])):
                    scores[j] = float(v)
            by: list[list[float]] = [[] for _ in range(len(f))]
            for (i, _), v in zip(parts, scores):
                by[i].append(v)
            yield pd.DataFrame({"document_id": f["document_id"], "tone_mean": [sum(v) / len(v) if v else None for v in by], "tone_min": [min(v) if v else None for v in by]})

    kind = filings.schema["document_id"].dataType.simpleString()
    return filings.select("document_id", F.col(text).alias("text")).mapInPandas(run, f"document_id {kind}, tone_mean double, tone_min double")


def to_score(filings: DataFrame, panel: DataFrame, done: DataFrame | None, most: int | None = None, entity: str = "entity", date: str = "filing_date", period: str = "eom") -> DataFrame:
    """Filings of (entity, month) in the panel that are not done yet, the first ``most`` by document_id."""
    f = filings.withColumn(period, month_end(F.col(date))).join(panel.select(entity, period).distinct(), [entity, period], "left_semi")
    if done is not None:
        f = f.join(done.select("document_id"), "document_id", "left_anti")
    return f.orderBy("document_id").limit(most) if most is not None else f


def score_filings(filings: DataFrame, panel: DataFrame, done: DataFrame | None = None, most: int | None = None, score: Callable[[DataFrame], DataFrame] = doc_tones, entity: str = "entity", date: str = "filing_date", period: str = "eom") -> DataFrame:
    """Tones of the filings of the panel's (entity, month)s: those in ``done`` (document_id, tone_mean, tone_min), and the others scored without the names and
    tickers of the filing and of the panel's row, where they have such columns. ``most`` bounds how many are scored anew, by document_id."""
    todo = to_score(filings, panel, done, most, entity, date, period)
    if {"company_name", "ticker"} <= set(panel.columns):
        known = panel.groupBy(entity, period).agg(F.first("company_name", True).alias("_name"), F.first("ticker", True).alias("_ticker"))
        todo = todo.join(known, [entity, period], "left")
    terms = lambda *names: F.array_compact(F.array(*[F.col(c).cast("string") for c in names if c in todo.columns])) if any(c in todo.columns for c in names) else F.array().cast("array<string>")
    clean = todo.withColumn("text", anonymise(F.coalesce("text", F.lit("")), terms("company_name", "_name"), terms("ticker", "_ticker")))
    fresh = score(clean).select("document_id", "tone_mean", "tone_min")
    if done is None:
        return fresh
    wanted = to_score(filings, panel, None, None, entity, date, period).select("document_id")
    return done.select("document_id", "tone_mean", "tone_min").join(wanted, "document_id", "left_semi").unionByName(fresh)


def tone_features(filings: DataFrame, tones: DataFrame, keys: DataFrame, entity: str = "entity", date: str = "filing_date", span: int = 12) -> DataFrame:
    """Per key: tone_mean, tone_min of the month, and tone_surprise = tone_mean less the mean of the monthly means of the ``span`` months before. Texts are scored once: the tones are kept,
    else each use of them, and each test whether they are null, would score them again."""
    from ..sources.tables import Materializer

    tones = Materializer(filings.sparkSession).scratch(tones, "tones")
    f = filings.select("document_id", entity, month_end(F.col(date)).alias("eom")).join(tones, "document_id").where("tone_mean IS NOT NULL")
    m = f.groupBy(entity, "eom").agg(F.avg("tone_mean").alias("tone_mean"), F.min("tone_min").alias("tone_min"))
    facts = m.select(entity, month_index(F.col("eom")).alias("idx"), "tone_mean")
    past = trailing(keys, facts, range(1, span + 1), {"_past": F.avg("tone_mean")}, entity)
    out = keys.select(entity, "eom").join(m, [entity, "eom"], "left").join(past, [entity, "eom"], "left")
    return out.select(entity, "eom", "tone_mean", "tone_min", (F.col("tone_mean") - F.col("_past")).alias("tone_surprise"))


#: Typographic signs and the plain ones they are read as.
SIGNS = {
    0x2018: "'", 0x2019: "'", 0x201A: "'", 0x2032: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"',
    0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2015: "-", 0x2212: "-",
    0xA0: " ", 0x202F: " ", 0x2009: " ", 0x2026: ".",
}


def normalised_quote(c: Column) -> Column:
    """Plain quotes, dashes, points and spaces; single spaces, lower case."""
    plain = F.translate(c, "".join(map(chr, SIGNS)), "".join(SIGNS.values()))
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def _shifted(words: Column, n: int) -> Column:
    """Every n words in a row as a struct with fields 0 to n - 1. The array is evaluated once a shift, not once an element."""
    parts = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(0))) for k in range(n)]
    return F.filter(F.arrays_zip(*parts), lambda x: x[str(n - 1)].isNotNull())


def _runs(words: Column, n: int) -> Column:
    """Hashes of every n words in a row, each once."""
    return F.array_distinct(F.transform(_shifted(words, n), lambda x: F.xxhash64(F.lit(n), *[x[str(k)] for k in range(n)])))


def _pieces(word: Column) -> Column:
    """What a word can be found by: its pieces of one to three characters (any), its first (start) and last (end) ones."""
    size = F.length(word)

    def cut(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    inside = F.array_distinct(F.concat(*[cut(n) for n in (1, 2, 3)]))
    return F.concat(F.transform(inside, lambda p: F.concat(F.lit("any "), p)), *[F.array(F.concat(F.lit("start "), F.substring(word, 1, n)), F.concat(F.lit("end "), F.substring(word, -n, n))) for n in (1, 2, 3)])


def _short_met(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of quotes (_q) of one or two words those that stand in a text (_d, _t): by a list of the texts' distinct words, found by pieces of three characters, and for
    two words the pairs of neighbours that start with a word ending in the first."""
    words = F.split("_q", " ")
    one = quotes.where(F.size(words) == 1).select("_q", F.lit("any").alias("how"), F.col("_q").alias("part"))
    two = quotes.where(F.size(words) == 2)
    parts = one.unionByName(two.select("_q", F.lit("end").alias("how"), words[0].alias("part"))).unionByName(two.select("_q", F.lit("start").alias("how"), words[1].alias("part")))
    probe = F.when(F.col("how") == "end", F.expr("right(part, 3)")).otherwise(F.expr("left(part, 3)"))
    parts = parts.withColumn("piece", F.concat("how", F.lit(" "), probe))
    listed = texts.select(F.explode(F.array_distinct(F.split("_t", " "))).alias("w")).distinct()
    pieces = listed.select("w", F.explode(F.array_distinct(_pieces(F.col("w")))).alias("piece")).join(parts.select("piece").distinct(), "piece", "left_semi")
    fits = F.when(F.col("how") == "any", F.contains("w", "part")).when(F.col("how") == "end", F.endswith("w", "part")).otherwise(F.startswith("w", "part"))
    hits = pieces.join(parts, "piece").where(fits).select("_q", "how", "w").distinct()
    ends, starts = hits.where("how = 'end'").select("_q", F.col("w").alias("w1")), hits.where("how = 'start'").select("_q", F.col("w").alias("w2"))
    near = F.explode(F.array_distinct(F.transform(_shifted(F.split("_t", " "), 2), lambda x: F.struct(x["0"].alias("w1"), x["1"].alias("w2")))))
    pairs = texts.select(near.alias("p")).select("p.*").join(ends.select("w1").distinct(), "w1", "left_semi").distinct()
    return hits.where("how = 'any'").select("_q").unionByName(pairs.join(ends, "w1").join(starts, ["_q", "w2"]).select("_q")).distinct()


def verify_quotes(facts: DataFrame, filings: DataFrame, formation: Column | None = None) -> DataFrame:
    """Facts (fact_id, quote, document_id or null) whose quote stands in the named filing, or in any for a null id. An empty quote, an unknown
    id, or a filing after ``formation`` doesn't count.

    All words of a quote but its ends are whole words of a text that has it. So a quote without an id is looked for by hashed runs of three of these words (single
    words where it has fewer): the texts' runs that any quote asks for make lists of documents, each quote takes its rarest list, and only these documents are read for it. Quotes of one or two
    words, which have no inner word, go by the list of words: see _short_met().
    """
    from ..sources.tables import Materializer

    keep = Materializer(filings.sparkSession)
    f = filings if formation is None else filings.where(F.col("filing_date") <= formation)
    f = f.select(F.col("document_id").alias("_d"), normalised_quote(F.col("text")).alias("_t"))
    # normalised once: the test for nulls, lists, pairs and named filings read them
    f = keep.scratch(f, "texts").where("_t IS NOT NULL")
    q = facts.withColumn("_q", normalised_quote(F.col("quote"))).where("_q <> ''")
    named = q.where("document_id IS NOT NULL").join(f, F.col("document_id") == F.col("_d")).where(F.contains("_t", "_q"))
    words = F.split("_q", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    # kept as tables, so that the planner knows how large they are when texts meet them
    loose = keep.scratch(q.where("document_id IS NULL").select("_q").distinct(), "loose")
    n = F.when(F.size(inner) >= 3, F.lit(3)).otherwise(F.lit(1))
    asked = keep.scratch(loose.select("_q", n.alias("n"), F.explode(F.when(F.size(inner) >= 3, _runs(inner, 3)).otherwise(_runs(inner, 1))).alias("g")), "asked")
    met = loose.limit(0)
    lengths = [r["n"] for r in asked.select("n").distinct().collect()]  # 1, 3 or both
    if lengths:
        text_words = F.split("_t", " ")
        wanted = keep.scratch(asked.select("g").distinct(), "wanted")
        lists = keep.scratch(f.select("_d", F.explode(F.concat(*[_runs(text_words, k) for k in lengths])).alias("g")).join(wanted, "g", "left_semi"), "lists")
        sizes = asked.join(lists.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("n", "size"), "g", "left")  # a run that no text has settles its quote
        rarest = sizes.groupBy("_q").agg(F.min_by("g", F.struct(F.coalesce("size", F.lit(0)), "g")).alias("g"))
        pairs = keep.scratch(lists.join(rarest, "g").select("_d", "_q").distinct(), "pairs")
        met = pairs.join(f, "_d").where(F.contains("_t", "_q")).select("_q").distinct()
    short = loose.where(F.size(words) <= 2)
    if short.limit(1).count():
        met = met.unionByName(_short_met(short, f))
    met = keep.scratch(met.distinct(), "met")
    anywhere = q.where("document_id IS NULL").join(met, "_q", "left_semi")
    return named.select(*facts.columns).unionByName(anywhere.select(*facts.columns))


def latest_filings(filings: DataFrame, entity: str, before: str, most: int, by: str = "entity") -> DataFrame:
    """The entity's last ``most`` filings up to a date."""
    return filings.where((F.col(by) == entity) & (F.col("filing_date") <= F.lit(before).cast("date"))).orderBy(F.desc("filing_date"), F.desc("document_id")).limit(most)


def dedup_first(filings: DataFrame, entity: str = "entity") -> DataFrame:
    """The first filing of each (entity, text hash) by date, then id; rows without an entity go."""
    w = Window.partitionBy(entity, "text_hash").orderBy("filing_date", "document_id")
    return filings.where(F.col(entity).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
