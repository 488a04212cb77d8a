"""Sector-neutral tail books as DataFrame steps: smoothed scores, tails, legs, capped weights.

A month's weights depend on no other month's weights, only on smoothed scores, so months and configurations run side by side: each step is a
window or an aggregate over (config, month) or a finer key, and nothing leaves the JVM. Configs that differ in their limit of shorts alone share a line of smoothed scores and its ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..spec import Settings


#: Columns by which a scored frame may hold several versions of a month: embedding size, size limit of shorts, betas. A config meets the versions it names.
AXES = ("d", "short_q", "beta_set")


def axes_of(scored: DataFrame, configs: DataFrame) -> list[str]:
    """The axes that both name."""
    return [c for c in AXES if c in scored.columns and c in configs.columns]


def tail_ladder(first: float, least: float = 0.02, step: float = 0.01) -> list[float]:
    """Tail shares that are tried in turn; the first one at or below ``least`` is the last."""
    out = [first]
    while out[-1] > least:
        out.append(out[-1] - step)
    return out


def smoothed(slim: DataFrame, lines: DataFrame, by: str = "eom", axes: list[str] = ()) -> DataFrame:
    """slim (entity, by, axes, score, sector, beta, oks) once a line (line, axes, a), with s in place of the score: an exponential average of the month's z-score over the months in a
    row, by the frame's months, that the name has been there; after a gap it starts anew. A line meets the rows of its own values of the axes.

    The average is folded along each name's run of months: one group a (line, name, run), at most as long as the panel has months. A row's other columns go along.
    """
    months = slim.select(by).distinct().withColumn("month_no", F.row_number().over(Window.orderBy(by)))  # a row a month
    z = slim.select("entity", by, *axes, "sector", "beta", "oks", ranks.zscore("score", [by, *axes]).alias("z")).join(F.broadcast(months), by)
    run = F.col("month_no") - F.row_number().over(Window.partitionBy("entity", *axes).orderBy("month_no"))
    kept = ("sector", "beta", "oks")
    runs = z.withColumn("run", run).groupBy("entity", *axes, "run").agg(F.sort_array(F.collect_list(F.struct("month_no", by, "z", *kept))).alias("m"))
    runs = runs.join(F.broadcast(lines), list(axes)) if axes else runs.crossJoin(F.broadcast(lines))  # a few rows

    def one_more(done: Column, x: Column) -> Column:
        before = F.when(F.size(done) == 0, x["z"]).otherwise(F.element_at(done, -1)["s"])
        return F.concat(done, F.array(F.struct(x[by].alias(by), *[x[c].alias(c) for c in kept], (F.col("a") * x["z"] + (1 - F.col("a")) * before).alias("s"))))

    kind = slim.schema[by].dataType.simpleString()
    none = F.array().cast(f"array<struct<{by}:{kind},sector:string,beta:double,oks:array<boolean>,s:double>>")
    folded = runs.select("line", "entity", F.explode(F.aggregate("m", none, one_more)).alias("x"))
    return folded.select("line", "entity", *[F.col(f"x.{c}").alias(c) for c in (by, *kept, "s")])


def members(df: DataFrame, tails: list[float], most_names: int, limits: int = 1, by: str = "eom") -> DataFrame:
    """df (line, entity, by, sector, s, oks) once a place ``i`` of the ``limits`` in oks, with side (1 or -1), tail and sector_n: in each sector the best ceil(tail * n) and, of the
    eligible rest, the worst ceil(tail * n eligible).

    tail is the first of ``tails`` with which a month has at most most_names names, else the last; sectors without both sides are left out. Ranks are made once for all limits, and only rows
    that the longest tails may take go on: how many names a tail takes follows from counts by rank.
    """
    from ..sources.tables import Materializer

    cell, most = ["line", by, "sector"], max(tails)
    w, each = Window.partitionBy(*cell), range(limits)
    d = df.withColumn("sector", F.coalesce(F.col("sector").cast("string"), F.lit("NA"))).withColumn("high", F.row_number().over(w.orderBy(F.desc("s"), "entity")))
    # eligible rows as good or better: the rows are in that order already
    as_good = w.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_ge{i}": F.count_if(F.col("oks")[i]).over(as_good) for i in each})
    d = d.withColumns({"n": F.count(F.lit(1)).over(w), **{f"_ok{i}": F.count_if(F.col("oks")[i]).over(w) for i in each}})
    d = d.withColumn("at", F.array(*[F.struct(F.col("oks")[i].alias("ok"), F.col(f"_ok{i}").alias("n_ok"), (F.col(f"_ok{i}") - F.col(f"_ge{i}")).alias("worse")) for i in each]))
    longs = lambda t: F.ceil(F.lit(t) * F.col("n"))
    may = (F.col("high") <= longs(most)) | F.exists("at", lambda x: x["ok"] & (x["worse"] < F.ceil(F.lit(most) * x["n_ok"])))
    d = Materializer(df.sparkSession).scratch(d.where(may).select(*cell, "entity", "beta", "s", "high", "n", "at"), "tails")
    d = d.select(*[c for c in d.columns if c != "at"], F.posexplode("at").alias("i", "x")).select("*", "x.*").drop("x")
    cell = [*cell, "i"]
    counts = d.groupBy(*cell).agg(F.first("n").alias("n"), F.first("n_ok").alias("n_ok"), *[F.count_if(F.col("ok") & (F.col("high") <= longs(t))).alias(f"in{k}") for k, t in enumerate(tails)])
    shorts = lambda k, t: F.least(F.ceil(F.lit(t) * F.col("n_ok")), F.col("n_ok") - F.col(f"in{k}"))
    sized = counts.select(*cell, "n", F.array(*[F.struct(F.lit(t).alias("tail"), longs(t).alias("longs"), shorts(k, t).alias("shorts")) for k, t in enumerate(tails)]).alias("tried"))
    both = lambda x: F.when((x["longs"] > 0) & (x["shorts"] > 0), x["longs"] + x["shorts"]).otherwise(F.lit(0))
    totals = sized.groupBy("line", "i", by).agg(*[F.sum(both(F.col("tried")[k])).alias(f"t{k}") for k in range(len(tails))])
    pick = F.coalesce(*[F.when(F.col(f"t{k}") <= most_names, F.lit(k)) for k in range(len(tails))], F.lit(len(tails) - 1))
    chosen = sized.join(totals.select("line", "i", by, pick.alias("pick")), ["line", "i", by])
    chosen = chosen.select(*cell, F.col("n").alias("sector_n"), F.col("tried")[F.col("pick")].alias("at")).where("at.longs > 0 AND at.shorts > 0")
    d = d.drop("n", "n_ok").join(chosen.select(*cell, "sector_n", F.col("at.tail").alias("tail"), "at.longs", "at.shorts"), cell)
    # who has as many worse ones as there are shorts is none of them
    open_ = F.col("ok") & (F.col("high") > F.col("longs"))
    d = d.where((F.col("high") <= F.col("longs")) | (open_ & (F.col("worse") < F.col("shorts"))))
    low = F.row_number().over(Window.partitionBy(*cell, open_).orderBy("s", "entity"))
    side = F.when(F.col("high") <= F.col("longs"), F.lit(1)).when(open_ & (low <= F.col("shorts")), F.lit(-1))
    return d.withColumn("side", side).where("side IS NOT NULL").drop("ok", "high", "worse")


def legs(held: DataFrame, s: Settings, by: str = "eom") -> DataFrame:
    """held with base (a leg's weights sum to 1: a sector's share of names, dealt evenly within the side) and leg, the sum that the side gets:
    the betas of both sides cancel, as far as net exposure stays within the band."""
    month = Window.partitionBy("config_id", by)
    names = F.count(F.lit(1)).over(Window.partitionBy("config_id", by, "sector", "side"))
    # a sector's stocks count once a sector: they are spread over its rows and summed
    per_row = held.withColumn("names", names).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("config_id", by, "sector")))
    per_row = per_row.withColumn("stocks", F.round(F.sum(F.col("sector_n") / F.col("rows")).over(month)))
    d = per_row.withColumn("base", F.col("sector_n") / F.col("stocks") / F.col("names"))
    of = lambda k: F.sum(F.when(F.col("side") == k, F.col("base") * F.col("beta"))).over(month)
    d = d.withColumns({"bl": of(1), "bs": of(-1)})
    raw = F.when(F.col("bl") + F.col("bs") > 1e-9, s.gross * F.col("bs") / (F.col("bl") + F.col("bs"))).otherwise(F.lit(s.gross / 2))
    net = F.greatest(F.least(2 * raw - s.gross, F.lit(s.net_band)), F.lit(-s.net_band))
    d = d.withColumn("net", net)
    return d.withColumn("leg", (F.lit(s.gross) + F.col("side") * F.col("net")) / 2).drop("names", "rows", "stocks", "bl", "bs", "net")


def capped(d: DataFrame, weight: str, total: str, cap: float, keys: list[str]) -> DataFrame:
    """``weight`` of each group of keys scaled to its ``total``, with no entry above the cap while another has room; in place.

    In falling order, entry m stands at the cap if (total - m cap) spread over it and all below it would still put it above: the entries for which that
    holds come first, and the rest share what these leave in proportion.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), "entity")
    below = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumns({"_m": F.row_number().over(order) - 1, "_below": below})
    full = F.col(weight) * (F.col(total) - F.col("_m") * F.lit(cap)) / F.col("_below") > F.lit(cap + 1e-12)
    d = d.withColumn("_full", full)
    group = Window.partitionBy(*keys)
    d = d.withColumns({"_k": F.count_if("_full").over(group), "_rest": F.sum(F.when(~F.col("_full"), F.col(weight))).over(group)})
    shared = F.col(weight) * (F.col(total) - F.col("_k") * F.lit(cap)) / F.col("_rest")
    return d.withColumn(weight, F.when(F.col("_full"), F.lit(cap)).otherwise(shared)).drop("_m", "_below", "_full", "_k", "_rest")


def tail_book(scored: DataFrame, configs: DataFrame, s: Settings = Settings(), by: str = "eom") -> DataFrame:
    """(config_id, entity, eom, weight, status) of a tail book a config. scored: entity, eom, score, short_eligible, sector, beta_kf; a missing beta is the
    month's median, or 1. A month without a sector that has both sides holds nothing.

    In place of short_eligible and the axis short_q a row may hold ``open``, the limits by which its name may be sold short: scores are then smoothed and ranked once for all limits."""
    from ..sources.tables import Materializer

    axes, limits = axes_of(scored, configs), [None]
    oks = F.array(F.coalesce(F.col("short_eligible"), F.lit(False))) if "short_eligible" in scored.columns else None
    place = F.lit(0)
    if "open" in scored.columns and "short_q" in configs.columns:
        limits = sorted(r["short_q"] for r in configs.select("short_q").distinct().collect())  # a grid of a few rows
        oks = F.array(*[F.coalesce(F.array_contains("open", q), F.lit(False)) for q in limits])
        place = (F.array_position(F.array(*[F.lit(q) for q in limits]), F.col("short_q")) - 1).cast("int")
    grid = configs.withColumn("a", F.col("smooth").cast("double")).withColumns({"line": F.dense_rank().over(Window.orderBy("a", *axes)), "i": place})
    beta = F.coalesce(ranks.median_filled("beta_kf", [by, *axes]), F.lit(1.0)).alias("beta")
    slim = scored.select("entity", by, *axes, F.col("score").cast("double").alias("score"), oks.alias("oks"), F.col("sector").cast("string").alias("sector"), beta)
    slim = Materializer(scored.sparkSession).scratch(slim, "slim")
    sides = members(smoothed(slim, grid.select("line", "a", *axes).distinct(), by, axes), tail_ladder(s.v3_tail), s.max_names, len(limits), by)
    held = legs(sides.join(F.broadcast(grid.select("config_id", "line", "i")), ["line", "i"]), s, by)
    out = capped(held, "base", "leg", s.max_weight, ["config_id", by, "side"])
    return out.select(F.col("config_id").cast("long").alias("config_id"), "entity", by, (F.col("side") * F.col("base")).alias("weight"), F.lit("solved").alias("status"))
