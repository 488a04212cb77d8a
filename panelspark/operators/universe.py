"""Universe filter, short eligibility, missing flags, scaling, membership lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..spec import Settings
from . import ranging, selection


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or ValueError naming a key that stands twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} not unique: {twice[0].asDict()}")
    return df


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; unlike dropDuplicates always the same one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sample_entities(df: DataFrame, most: int, seed: int = 42, entity: str = "entity") -> DataFrame:
    """Rows of at most ``most`` entities, chosen by a seeded hash: a smoke run's sample, the same on every run."""
    keep = df.select(entity).distinct().orderBy(F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.lit(str(seed)))), entity).limit(most)
    return df.join(keep, entity, "left_semi")


def build_universe(panel: DataFrame, price: str, size: str, volume: str, s: Settings = Settings(), by: str = "eom", entity: str = "entity") -> DataFrame:
    """Rows with |price| at least min_price and size above its period quantile over all rows of that period; adds size_pct (over all rows)
    and volume_pct (over what is left), so it takes two passes of ranks around the filter. Both are dealt by range: no period has to fit a task."""
    from ..sources.tables import Materializer

    ranked = ranging.ranked(panel, size, by, [entity])
    at = F.round((F.col("_rank.n") - 1) * F.lit(float(s.size_quantile))) + 1
    place = ranked.where(F.col("_rank.place") == at).groupBy(by).agg(F.max(ranks.clean(size)).alias("_cut"))
    cut = ranked.withColumn("size_pct", ranging.percent()).drop("_rank").join(F.broadcast(place), by)  # a row a period
    kept = cut.where((F.abs(price) >= s.min_price) & (ranks.clean(size) > F.col("_cut"))).select(*panel.columns, "size_pct")
    out = ranging.ranked(kept, volume, by, [entity]).withColumn("volume_pct", ranging.percent()).select(*panel.columns, "size_pct", "volume_pct")
    return Materializer(panel.sparkSession).scratch(out, "universe")


def short_eligible(size_pct: str = "size_pct", volume_pct: str = "volume_pct", idle: str = "idle", least_size: float | Column = 0.40, least_volume: float = 0.30, by: str = "eom") -> Column:
    """Big and traded enough, and idle no more than the median of the rows now in the frame; null is false."""
    x = ranks.clean(idle).cast("double")
    calm = x <= F.median(x).over(Window.partitionBy(by))
    return F.coalesce((F.col(size_pct) >= least_size) & (F.col(volume_pct) >= least_volume) & calm, F.lit(False))


def with_short_eligible(df: DataFrame, name: str = "short_eligible", idle: str = "idle", least_size: float | Column = 0.40, least_volume: float = 0.30, by: str = "eom") -> DataFrame:
    """df with short_eligible() as a column, the medians found by selection: no period has to fit a task."""
    mid = selection.medians(df, [idle], [by]).withColumnRenamed(idle, "_mid")
    calm = ranks.clean(idle).cast("double") <= F.col("_mid")
    out = df.join(F.broadcast(mid), by, "left")  # a row a period
    return out.withColumn(name, F.coalesce((F.col("size_pct") >= least_size) & (F.col("volume_pct") >= least_volume) & calm, F.lit(False))).drop("_mid")


def flag_columns(train: DataFrame, columns: list[str], share: float = 0.20) -> list[str]:
    """Columns whose share of nulls in the training rows is above ``share``; one pass for all."""
    got = train.agg(*[F.avg(ranks.clean(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if got[c] is not None and got[c] > share]


def with_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_miss": ranks.clean(c).isNull().cast("int") for c in columns}) if columns else df


def preprocess(univ: DataFrame, columns: list[str], code: str, train: Column, s: Settings = Settings(), by: str = "eom", keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Flags from the raw nulls, then ranks in [-1, 1], then the sector (first two characters of a code)."""
    flags = flag_columns(univ.where(train), columns, s.missing_share)
    out = ranks.with_dense_scaled(with_flags(univ, flags), columns, by, keys)
    return out.withColumn("sector", F.coalesce(F.substring(code, 1, 2), F.lit("NA"))), [f"{c}_miss" for c in flags]


def clip_quantiles(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, fit: Column | None = None, interpolation: str = "linear") -> DataFrame:
    """Clip each column to its quantiles over the rows of ``fit`` (all rows by default), found by selection for all columns at once; a column without values stays as it is."""
    got = selection.bounds(df if fit is None else df.where(fit), columns, [low, high], interpolation)
    return df.withColumns({c: F.when(ranks.clean(c).isNotNull(), F.greatest(F.least(clean_double(c), F.lit(got[c][1])), F.lit(got[c][0]))) for c in columns if got[c]})


def clean_double(c: str) -> Column:
    return ranks.clean(c).cast("double")


def with_sides(df: DataFrame, score: str, eligible: str, long_n: Column | int, short_n: Column | int, keys: list[str], entity: str = "entity", name: str = "side") -> DataFrame:
    """df with a side a row of each group of keys: 1 for the long_n best, -1 for the short_n worst of the eligible that are not among them, else null; ties by
    entity. The numbers may be columns, constant within a group."""
    high = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), entity))
    tagged = df.withColumn("_long", high <= long_n)
    open_ = F.coalesce(F.col(eligible), F.lit(False)) & ~F.col("_long")
    low = F.row_number().over(Window.partitionBy(*keys, open_).orderBy(F.col(score).asc_nulls_last(), entity))
    return tagged.withColumn(name, F.when(F.col("_long"), F.lit(1)).when(open_ & (low <= short_n), F.lit(-1))).drop("_long")


def tail_lists(df: DataFrame, score: str, eligible: str, long_n: int, short_n: int, by: str = "eom", entity: str = "entity") -> DataFrame:
    """(by, entity, side): the long_n best, then the short_n worst of the eligible that are not among them; ties by entity."""
    place = lambda o: F.row_number().over(Window.partitionBy(by).orderBy(*o))
    slim = df.select(by, entity, F.col(score).alias("_s"), F.coalesce(F.col(eligible), F.lit(False)).alias("_ok"))
    # only the first rows of a period are wanted, so tasks cut to these before they send
    longs = slim.withColumn("_n", place([F.col("_s").desc_nulls_last(), entity])).where(F.col("_n") <= long_n).select(by, entity, F.lit(1).alias("side"))
    rest = slim.where("_ok").join(F.broadcast(longs.select(by, entity)), [by, entity], "left_anti")  # long_n rows a period
    shorts = rest.withColumn("_n", place([F.col("_s").asc_nulls_last(), entity])).where(F.col("_n") <= short_n).select(by, entity, F.lit(-1).alias("side"))
    return longs.unionByName(shorts)


def with_group_sides(df: DataFrame, score: str, eligible: str, keys: list[str], most: int = 50, entity: str = "entity", name: str = "side") -> DataFrame:
    """with_sides() of k = min(most, n // 2) names a side in each group of n."""
    k = F.least(F.lit(most), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2))
    return with_sides(df.withColumn("_k", k), score, eligible, F.col("_k"), F.col("_k"), keys, entity, name).drop("_k")


def group_tail_lists(df: DataFrame, score: str, eligible: str, group: str, most: int = 50, by: str = "eom", entity: str = "entity") -> DataFrame:
    """Per size group of n names the k = min(most, n // 2) best, and the k worst eligible of the rest."""
    return with_group_sides(df, score, eligible, [by, group], most, entity).where("side IS NOT NULL").select(by, group, entity, "side")


def prediction_score(score: str, by: str = "eom") -> Column:
    """2 * average rank / (n + 1) - 1."""
    return 2 * ranks.average_rank(score, by) / (F.count(ranks.clean(score)).over(Window.partitionBy(by)) + 1) - 1
