"""The whole run: from tables to files, as one graph of stages.

panel, filings, rate and index files -> universe -> filtered betas, event flags, tones, embeddings -> frame -> scores, books, checks (pipeline.py) -> files. A run under a root that has
seen the same inputs and settings reads its stages; a changed input makes anew only what depends on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.dates import next_month_end
from ..operators import betas, gru, joins, kalman, text, universe
from ..sources import tables
from ..spec import Settings
from . import pipeline
from .graph import Graph


@dataclass(frozen=True)
class Inputs:
    """Where the tables are and what their columns are called; dates are ISO texts, the last months of the rows that fits may see."""

    panel: str
    filings: str
    rate: str
    index: str
    features: tuple[str, ...]
    factors: tuple[str, ...]
    measures: tuple[str, ...]
    prior: str
    test_years: tuple[int, ...]
    fit_end: str
    entity: str = "entity"
    period: str = "eom"
    price: str = "price"
    size: str = "size"
    volume: str = "volume"
    idle: str = "idle"
    code: str = "code"
    target: str = "target"
    ret: str = "ret"
    beta_raw: str | None = None
    flags: tuple[str, ...] = ()
    counted: tuple[str, ...] = ()
    embedding_sizes: tuple[int, ...] = ()
    short_limits: tuple[float, ...] = ()
    smoke_entities: int | None = None
    buckets: int = 64
    filter_rounds: int = 40


def stages(g: Graph, i: Inputs, s: Settings = Settings(), score: Callable[[DataFrame], DataFrame] = text.doc_tones, scorer: str = "lexicon") -> dict[str, list[str]]:
    """Put the stages up to ``frame`` into the graph: panel, filings, market, history, universe, betas, events, tones, embedding_<d>, frame. Returns the groups of feature columns.
    ``scorer`` names the scoring function in the tones' key."""
    own = {i.entity: "entity", i.period: "eom", i.target: "target", i.ret: "ret"}

    def read(spark: SparkSession, path: str) -> DataFrame:
        df = tables.read_panel(spark, path, i.entity, i.period).withColumnsRenamed(own)
        return df if i.smoke_entities is None else universe.sample_entities(df, i.smoke_entities, s.seed)

    fit = F.col("eom") <= F.lit(i.fit_end).cast("date")
    g.files("panel", i.panel, read, settings=[own, i.smoke_entities, s.seed])
    g.files("filings", i.filings, lambda spark, path: tables.read_filings(spark, path, i.entity).withColumnRenamed(i.entity, "entity"), settings=i.entity)
    series = lambda name, column: lambda spark, path: spark.read.csv(path, header=True).select(F.to_date("eom").alias("eom"), F.col(column).cast("double").alias(name))
    g.files("rate", i.rate, series("rate", "tb3ms"))
    g.files("index", i.index, series("index_ret", "sp500_ret"))
    g.stage("market", joins.market_full, "rate", "index")
    g.stage("history", lambda p: p.select("entity", "eom", "ret"), "panel")

    def made_universe(panel: DataFrame) -> DataFrame:
        kept = universe.build_universe(panel, i.price, i.size, i.volume, s)
        idle = ranks.clean(i.idle).cast("double")
        calm = F.coalesce(idle <= F.median(idle).over(Window.partitionBy("eom")), F.lit(False))
        kept = kept.withColumns({"size_raw": F.col(i.size), "calm": calm})
        kept = kept.withColumn("short_eligible", F.coalesce((F.col("size_pct") >= s.short_size_pct) & (F.col("volume_pct") >= s.short_volume_pct) & F.col("calm"), F.lit(False)))
        out, _ = universe.preprocess(kept, list(i.features), i.code, fit, s, keys=["entity", "eom"])
        flags = [c for c in out.columns if c.endswith("_miss")]
        labels = [c for c in ("ticker", "company_name") if c in out.columns]
        columns = dict.fromkeys(["entity", "eom", "target_month", "target", "ret", "sector", "size_raw", "size_pct", "volume_pct", "calm", "short_eligible", *labels, *i.features, *flags])
        return out.select(*columns)

    g.stage("universe", made_universe, "panel", settings={"inputs": asdict(i), "settings": s})

    # betas, on all entities of the raw panel
    measured = {"measures": i.measures, "prior": i.prior, "fit_end": i.fit_end, "buckets": i.buckets, "settings": s}
    place = i.measures.index(i.prior) if i.prior in i.measures else None
    g.stage("measures", lambda p: kalman.prepare(p.withColumn("sector", F.substring(i.code, 1, 2)), list(i.measures), i.prior, i.buckets, fit), "panel", settings=measured)
    for name, floor in (("betas", None), ("betas_floored", s.noise_floor)):
        g.value(f"{name}_fit", lambda m, floor=floor: [float(x) for x in kalman.fit(m, len(i.measures), floor, i.filter_rounds)[0]], "measures", settings=[measured, floor, i.filter_rounds])
        g.stage(name, lambda m, theta: kalman.smooth(m, np.array(theta), place), "measures", f"{name}_fit")

    # filings
    g.stage("events", lambda f, u: text.event_flags(f, u.select("entity", "eom"), list(i.flags), list(i.counted)), "filings", "universe", settings=[i.flags, i.counted])
    g.stage("doc_tones", lambda f, u: text.score_filings(f, u, score=score), "filings", "universe", settings=scorer)
    g.stage("tones", lambda f, t, u: text.tone_features(f, t, u.select("entity", "eom")), "filings", "doc_tones", "universe")

    # embeddings of sequences
    if i.embedding_sizes:
        g.stage("sequences", lambda u: gru.windows(u, list(i.features), s.seq_len), "universe", settings=[i.features, s.seq_len])
    year = F.year(next_month_end(F.col("eom")))
    first = min(i.test_years)
    groups: dict[str, list[str]] = {}
    for d in i.embedding_sizes:
        groups[f"embedding_{d}"] = [f"gru{d}_{k + 1}" for k in range(d)]
        make = lambda w, d=d: gru.embed(w, d, year < first - 2, (year >= first - 2) & (year < first), s).withColumnsRenamed({f"gru_{k + 1}": f"gru{d}_{k + 1}" for k in range(d)})
        g.stage(f"embedding_{d}", make, "sequences", settings={"d": d, "first": first, "settings": s})

    def frame(u: DataFrame, *more: DataFrame) -> DataFrame:
        for df in more:
            u = u.join(df, ["entity", "eom"], "left")
        return u

    parts = ["betas", "events", "tones", *[f"embedding_{d}" for d in i.embedding_sizes]]
    g.stage("frame", frame, "universe", *parts)
    names = lambda node: [c for c in g.get(node).columns if c not in ("entity", "eom")]
    groups |= {"base": list(i.features) + [c for c in names("universe") if c.endswith("_miss")], "events": [c for c in names("events")], "tones": names("tones")}
    return groups


def run(spark: SparkSession, i: Inputs, root: str, out_dir: str | None = None, s: Settings = Settings(), model: str = "trees", kind: str = "auto", axes: dict | None = None, select: bool = True, ablate: bool = True, score: Callable[[DataFrame], DataFrame] = text.doc_tones, scorer: str = "lexicon", stop_on_leak: bool = True) -> tuple[pipeline.Run, dict[str, str], Graph]:
    """(run, files written to ``out_dir`` by name, graph). On a structural leak the files are written and then LeakError is raised, unless stop_on_leak is off.

    Ablation sets: factors alone by ridge and by the model, then flags, embedding, events and tones added in turn, then the main run (with selection of features where it is on).
    """
    g = Graph(spark, root)
    groups = stages(g, i, s, score, scorer)
    features, factors = groups["base"] + groups["events"] + groups["tones"], list(i.factors)
    sizes = {d: groups[f"embedding_{d}"] for d in i.embedding_sizes}

    def variants(risk_model: DataFrame) -> dict[str, DataFrame]:
        frame = g.get("frame")
        raw = None if i.beta_raw is None else g.get("panel").select("entity", "eom", F.col(i.beta_raw).alias("beta_raw"))
        sectors = [r[0] for r in frame.select(F.coalesce("sector", F.lit("NA")).alias("s")).distinct().orderBy("s").collect()]
        fit = F.col("eom") <= F.lit(i.fit_end).cast("date")
        return betas.variants(frame, risk_model, factors, sectors, raw, fit, lambda: g.get("betas_floored"), s)

    sets: dict | bool = False
    if ablate:
        base, own = groups["base"], sizes.get(min(sizes)) if sizes else []
        sets = {"1_ridge_factors": (list(i.features), "ridge"), "2_factors": (list(i.features), model), "3_embedding": (base + own, model), "4_events": (base + own + groups["events"], model), "5_tones": (base + own + groups["events"] + groups["tones"], model), "6_main": None}
    out = pipeline.run(
        spark, "frame", features, factors, "market", list(i.test_years), s, model, kind, axes, ablate=sets, returns_history="history", filings="filings", variants=variants,
        factors_chosen=list(i.features) if select else None, embeddings=sizes or None, short_grid=i.short_limits or None, graph=g, stop_on_leak=False,
    )
    files = pipeline.write(out, out_dir, g.get("frame"), g.get("filings")) if out_dir else {}
    if stop_on_leak and not out.leaks["passed"]:
        raise pipeline.LeakError({k: out.leaks[k] for k in ("windows", "filings", "target_months", "duplicates", "suspects")})
    return out, files, g
