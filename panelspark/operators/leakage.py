"""Checks that nothing from after a formation date reaches a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import clean, correlation


def filing_leaks(filings: DataFrame, keys: DataFrame, entity: str = "entity", date: str = "filing_date", period: str = "eom") -> DataFrame:
    """One row: keys flagged has_filing, those whose last filing of the month is after formation, those without any."""
    last = filings.groupBy(entity, F.last_day(date).alias(period)).agg(F.max(date).alias("last_date"))
    k = keys.where("has_filing = 1").join(last, [entity, period], "left")
    return k.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("last_date") > F.col(period)).alias("after_formation"), F.count_if(F.col("last_date").isNull()).alias("flag_without_filing"))


def target_correlations(df: DataFrame, features: list[str], target: str, limit: float = 0.99) -> DataFrame:
    """(feature, correlation, suspect): all correlations in one pass; suspect if it is near one, or the name says that it looks ahead."""
    row = df.agg(*[correlation(clean(c), clean(target)).alias(c) for c in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in features])).alias("p")
    out = row.select(pairs).select("p.*")
    return out.withColumn("suspect", F.contains("feature", F.lit("lead")) | F.coalesce(F.abs("correlation") > limit, F.lit(False)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def window_errors(windows: list[dict]) -> list[str]:
    """Windows whose training, validation and test parts are out of order or overlap."""
    bad = []
    for w in windows:
        dates = [*w["train"], *w["val"], *w["test"]]
        if not (dates[0] <= dates[1] < dates[2] <= dates[3] < dates[4] <= dates[5]):
            bad.append(str(w.get("year", w)))
    return bad


def target_month_errors(infos: list[dict]) -> list[str]:
    """Windows whose fitted months reach into their test months."""
    return [str(i["year"]) for i in infos if i["last_fit_month"] >= i["first_test_month"]]
