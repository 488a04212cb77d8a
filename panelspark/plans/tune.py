"""Choices over grids of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.joins import market_to_formation
from ..functions.ranks import clean
from ..spec import Settings


def grid_returns(weights: DataFrame, panel: DataFrame, market: DataFrame, premium: float = 0.04, target: str = "target", by: str = "eom") -> DataFrame:
    """(config_id, eom, total, excess, active, turnover) of every book at once."""
    w = weights.select("config_id", "entity", by, "weight").join(panel.select("entity", by, target), ["entity", by], "left")
    g = w.groupBy("config_id", by).agg(F.sum(F.col("weight") * F.coalesce(clean(target), F.lit(0.0))).alias("excess"))
    steps = weights.select("config_id", by).distinct().withColumn("next", F.lead(by).over(Window.partitionBy("config_id").orderBy(by)))
    later = weights.join(steps, ["config_id", by]).where("next IS NOT NULL").select("config_id", "entity", F.col("next").alias(by), (-F.col("weight")).alias("weight"))
    moved = weights.select("config_id", "entity", by, "weight").unionByName(later).groupBy("config_id", "entity", by).agg(F.sum("weight").alias("d"))
    turn = moved.groupBy("config_id", by).agg(F.sum(F.abs("d")).alias("turnover"))
    mk = market_to_formation(market, by).select(by, (F.col("rate") / 1200).alias("rf"))
    out = g.join(turn, ["config_id", by], "left").join(F.broadcast(mk), by, "left")  # a row a month
    return out.select("config_id", by, (F.coalesce("rf", F.lit(0.0)) + F.col("excess")).alias("total"), "excess", (F.col("excess") - premium / 12).alias("active"), "turnover")


def grid_ratios(weights: DataFrame, panel: DataFrame, market: DataFrame, grid: DataFrame, fee: float = 0.0, premium: float = 0.04) -> DataFrame:
    """grid with ir (after the fee on turnover) and n_months, best first; of equals the first config."""
    r = metrics.net_of_fee(grid_returns(weights, panel, market, premium), fee)
    ir = r.groupBy("config_id").agg(metrics.information_ratio("active").alias("ir"), F.count(F.lit(1)).alias("n_months"))
    return grid.join(ir, "config_id", "left").orderBy(F.desc_nulls_last("ir"), "config_id")


def choose(ratios: DataFrame, last_of_equals: bool = False) -> dict | None:
    """The config of the best finite ratio: the first of equals, or the last."""
    order = F.desc("config_id") if last_of_equals else F.asc("config_id")
    got = ratios.where("ir IS NOT NULL AND NOT isnan(ir)").orderBy(F.desc("ir"), order).limit(1).collect()
    return got[0].asDict() if got else None


def choose_complete(ratios: DataFrame, log: DataFrame) -> dict | None:
    """The best config of those that never held a month for want of a solution; the last of equals. log: see books.split_log()."""
    held = log.where(F.col("status").startswith("hold")).select("config_id").distinct()
    return choose(ratios.join(held, "config_id", "left_anti"), True)


def choose_book(candidates: list[dict], limit: float = 0.2) -> dict | None:
    """Of {name, ir, beta}: the best ratio among those whose |beta| is within the limit, else the least |beta|."""
    fine = [c for c in candidates if c["beta"] is not None and abs(c["beta"]) <= limit and c["ir"] is not None]
    if fine:
        return max(fine, key=lambda c: c["ir"])
    rest = [c for c in candidates if c["beta"] is not None]
    return min(rest, key=lambda c: abs(c["beta"])) if rest else None


def v4_settings(by_year: dict[int, list[dict]]) -> dict[int, dict]:
    """Settings by test year from rows {config_id, its settings, ir}: the best finite net ratio, the last of equals; with none, last year's choice, and in
    the first year the most risk-averse settings of full gross."""
    out: dict[int, dict] = {}
    for year in sorted(by_year):
        rows = sorted(by_year[year], key=lambda r: r["config_id"])
        known = [r for r in rows if r["ir"] is not None and r["ir"] == r["ir"]]
        careful = max(rows, key=lambda r: (r["gross"], r["risk_penalty"], r["turnover_penalty"]))
        out[year] = max(known, key=lambda r: (r["ir"], r["config_id"])) if known else out[max(out)] if out else careful
    return out


def beta_check(fit: dict, s: Settings = Settings()) -> bool:
    """Whether a validation book's beta is clearly not zero."""
    return fit.get("beta_t") is not None and abs(fit["beta_t"]) > s.beta_check_t


def ic_by_year(val_ic: dict[int, float | None], years: list[int]) -> dict[int, float]:
    """Validation IC for each test year; a missing one is the mean of the others."""
    known = [v for v in val_ic.values() if v is not None and v == v]
    mean = sum(known) / len(known) if known else 0.0
    return {y: (val_ic.get(y) if val_ic.get(y) is not None and val_ic.get(y) == val_ic.get(y) else mean) for y in years}
