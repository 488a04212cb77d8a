"""Beta estimates that a book can be balanced with: the filtered one and its variants, each (entity, eom, beta_kf, beta_var)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import clean
from ..spec import Settings
from .kalman import shrunk
from .universe import clip_quantiles


def factor_beta(frame: DataFrame, risk: DataFrame, factors: list[str], sectors: list[str], by: str = "eom") -> DataFrame:
    """A row's exposures times the month's factor betas (risk.model(), known by then), the filtered beta where there are none."""
    b = F.col("_b")
    total = b[0]
    for i, c in enumerate(factors):
        total = total + b[i + 1] * F.coalesce(clean(c).cast("double"), F.lit(0.0))
    place = F.array_position(F.array(*[F.lit(x) for x in sectors]), F.coalesce(F.col("sector").cast("string"), F.lit("NA")))
    total = total + F.when(place > 0, F.get(b, (place + len(factors)).cast("int"))).otherwise(F.lit(0.0))
    joined = frame.join(F.broadcast(risk.select(by, F.col("b").alias("_b"))), by, "left")  # a row a month
    return joined.select("entity", by, F.when(b.isNotNull(), total).otherwise(F.col("beta_kf")).alias("beta_kf"), "beta_var")


def shrunk_beta(frame: DataFrame, raw: DataFrame, fit, s: Settings = Settings(), by: str = "eom") -> DataFrame:
    """(1 - k) raw + k, the raw beta (entity, eom, beta_raw) clipped to its 1st and 99th percentile over the rows of fit; the filtered one where it lacks."""
    clipped = clip_quantiles(raw.select("entity", by, "beta_raw"), ["beta_raw"], fit=fit, interpolation="nearest")
    both = frame.join(clipped, ["entity", by], "left")
    return both.select("entity", by, shrunk("beta_raw", "beta_kf", s).alias("beta_kf"), "beta_var")


def variants(frame: DataFrame, risk: DataFrame | None, factors: list[str], sectors: list[str], raw: DataFrame | None = None, fit=None, floored: Callable[[], DataFrame] | None = None, s: Settings = Settings(), by: str = "eom") -> dict[str, DataFrame]:
    """By name, those that can be made from what is given: kf always; kf_rfloor from floored(), the filter with a noise floor; b60_shrunk from raw; factor
    from a risk model."""
    out = {"kf": frame.select("entity", by, "beta_kf", "beta_var")}
    if floored is not None:
        out["kf_rfloor"] = frame.select("entity", by).join(floored().select("entity", by, "beta_kf", "beta_var"), ["entity", by], "left")
    if raw is not None:
        out["b60_shrunk"] = shrunk_beta(frame, raw, fit if fit is not None else F.lit(True), s, by)
    if risk is not None:
        out["factor"] = factor_beta(frame, risk, factors, sectors, by)
    return out


def swapped(frame: DataFrame, beta: DataFrame, by: str = "eom") -> DataFrame:
    """frame with the betas of a variant."""
    return frame.drop("beta_kf", "beta_var").join(beta, ["entity", by], "left")
