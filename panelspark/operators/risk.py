"""Factor risk model: exposures, cross-sectional factor returns, trailing covariances, specific variances, Ledoit-Wolf form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index, next_month_end
from ..functions.ranks import clean
from ..spec import Settings


def sectors_of(df: DataFrame, sector: str = "sector") -> list[str]:
    return [r[0] for r in df.select(F.coalesce(sector, F.lit("NA")).alias("s")).distinct().orderBy("s").collect()]


def exposures(f: pd.DataFrame, factors: list[str], sectors: list[str]) -> np.ndarray:
    """Constant, characteristics (missing is 0), a dummy a sector; linearly dependent on purpose."""
    sec = f["sector"].fillna("NA").to_numpy()
    x = np.nan_to_num(f[factors].to_numpy(float))
    return np.hstack([np.ones((len(f), 1)), x, (sec[:, None] == np.array(sectors)[None, :]).astype(float)])


def factor_returns(df: DataFrame, factors: list[str], sectors: list[str], target: str = "target", by: str = "eom") -> tuple[DataFrame, DataFrame]:
    """((by, known, f, xs_vol), (entity, by, resid)): least squares of least norm in each period; f is known a month later.

    One group is one period's cross-section. The fits are made once and kept: both frames read them.
    """
    from ..sources.tables import Materializer

    slim = df.where(clean(target).isNotNull()).select("entity", by, "sector", F.col(target).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in factors])

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("entity", kind="stable")
        x, y = exposures(f, factors, sectors), f[target].to_numpy(float)
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return pd.DataFrame({"entity": f["entity"], by: f[by], "resid": y - x @ b, "f": [b, *[None] * (len(f) - 1)], "xs_vol": y.std(ddof=1) if len(y) > 1 else np.nan})

    kinds = {c.name: c.dataType.simpleString() for c in slim.schema}
    out = slim.groupBy(by).applyInPandas(one, f"entity {kinds['entity']}, {by} {kinds[by]}, resid double, f array<double>, xs_vol double")
    out = Materializer(df.sparkSession).scratch(out, "fits")
    months = out.groupBy(by).agg(F.first("f", True).alias("f"), F.first("xs_vol").alias("xs_vol")).withColumn("known", next_month_end(F.col(by)))
    return months, out.select("entity", by, "resid")


def model(months: DataFrame, dates: DataFrame, s: Settings = Settings(), by: str = "eom", market: DataFrame | None = None) -> DataFrame:
    """(by, n, xs_vol, k, chol, b) for each date with enough known months: covariance of the trailing factor returns, shrunk, as its
    Cholesky factor (row-major), the mean cross-section volatility, and factor betas on market(known, m) if given.

    Months by months: a theta join of a few hundred rows a side.
    """
    m = months if market is None else months.join(market, "known", "left")
    m = m.withColumn("m", F.col("m") if market is not None else F.lit(None).cast("double"))
    past = dates.select(F.col(by).alias("_t")).distinct().join(F.broadcast(m), F.col("known") <= F.col("_t"))  # rows: one a month
    past = past.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("known")))).where(F.col("_n") <= s.risk_window)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("known")
        t, n = f["_t"].iloc[0], len(f)
        if n < s.risk_min_months:
            return pd.DataFrame({by: [], "n": [], "xs_vol": [], "k": [], "chol": [], "b": []}, dtype=object)
        x = np.array(f["f"].tolist())
        c = np.cov(x, rowvar=False)
        k = len(c)
        c = 0.9 * c + 0.1 * np.trace(c) / k * np.eye(k) + 1e-8 * np.eye(k)
        have = f["m"].notna().to_numpy()
        b = None
        if have.sum() >= s.risk_min_months:
            z = f["m"].to_numpy(float)[have]
            z = z - z.mean()
            b = (z @ (x[have] - x[have].mean(0))) / (z @ z)
        return pd.DataFrame({by: [t], "n": [n], "xs_vol": [float(f["xs_vol"].mean())], "k": [k], "chol": [np.linalg.cholesky(c).ravel()], "b": [b]})

    kind = dates.schema[by].dataType.simpleString()
    slim = past.select("_t", "known", "f", "xs_vol", "m")
    return slim.groupBy("_t").applyInPandas(one, f"{by} {kind}, n long, xs_vol double, k long, chol array<double>, b array<double>")


def specific_variance(df: DataFrame, resid: DataFrame, s: Settings = Settings(), by: str = "eom") -> DataFrame:
    """(entity, by, spec_var): variance of the residuals of the last spec_window known months, null under spec_min of them, then the period's
    median, then the pooled variance of those months. Periods without a known month don't appear."""
    known = resid.select(F.col(by).alias("_s")).distinct().withColumn("_known", next_month_end(F.col("_s"))).withColumn("_no", F.row_number().over(Window.orderBy("_known")))  # a row a month
    each = resid.groupBy(F.col(by).alias("_s")).agg(F.count("resid").alias("n"), F.avg("resid").alias("mean"), F.var_pop("resid").alias("var"))
    at = df.select(F.col(by).alias("_t")).distinct().join(F.broadcast(known), F.col("_known") <= F.col("_t")).groupBy("_t").agg(F.max("_no").alias("_last"))
    used = at.join(F.broadcast(known.join(each, "_s")), (F.col("_no") <= F.col("_last")) & (F.col("_no") > F.col("_last") - s.spec_window))  # months by months
    total = used.groupBy("_t").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    spread = F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col("all")) ** 2)) / (F.first("total") - 1)
    pooled = used.join(F.broadcast(total.select("_t", F.col("n").alias("total"), F.col("mean").alias("all"))), "_t").where("total > 1").groupBy("_t").agg(spread.alias("pooled"))
    # residuals and periods in one line an entity, by the number of the last known month: each row is sent once and looks back
    told = resid.join(F.broadcast(known), resid[by] == F.col("_s")).select("entity", "_no", "resid", F.lit(None).cast(df.schema[by].dataType).alias(by))
    asks = df.select("entity", by).join(F.broadcast(at), df[by] == F.col("_t")).select("entity", F.col("_last").alias("_no"), F.lit(None).cast("double").alias("resid"), by)
    w = Window.partitionBy("entity").orderBy("_no").rangeBetween(1 - s.spec_window, 0)
    v = F.when((F.count("resid").over(w) >= s.spec_min) & F.col("entity").isNotNull(), F.var_samp("resid").over(w))
    out = told.unionByName(asks).withColumn("v", v).where(F.col(by).isNotNull()).join(F.broadcast(pooled.withColumnRenamed("_t", by)), by, "left")
    return out.select("entity", by, F.coalesce("v", F.median("v").over(Window.partitionBy(by)), "pooled").alias("spec_var"))


def full_history(rets: DataFrame, at: DataFrame, window: int, by: str = "eom", ret: str = "ret") -> DataFrame:
    """(entity, by, x): the last ``window`` monthly returns, oldest first, of entities that have them all, at each period of ``at``."""
    m = rets.where(clean(ret).isNotNull()).withColumn("_m", month_index(F.col(by)))
    w = Window.partitionBy("entity").orderBy("_m").rangeBetween(1 - window, 0)
    m = m.withColumn("x", F.collect_list(F.struct("_m", F.col(ret).cast("double").alias("r"))).over(w)).where(F.size("x") == window)
    x = F.transform(F.array_sort("x"), lambda s: s["r"])
    return m.select("entity", by, x.alias("x")).join(at.select(by).distinct(), by, "left_semi")


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """x: months by names. (centred x, delta, mu) with covariance (1 - delta) Xc'Xc / T + delta mu I; only the T by T products are formed."""
    t, p = x.shape
    if p == 0:
        return x, 0.0, 0.0
    xc = x - x.mean(0)
    return xc, *gram_shrinkage(xc @ xc.T, p)


def gram_shrinkage(gram: np.ndarray, p: int) -> tuple[float, float]:
    """(delta, mu) from the months by months products of p centred columns."""
    t = len(gram)
    mu = float(np.trace(gram)) / (t * p)
    s2 = float((gram**2).sum()) / t**2  # |S|_F^2
    d2 = (s2 - 2 * mu * np.trace(gram) / t + p * mu * mu) / p
    b2 = (float((np.diag(gram) ** 2).sum()) / t - s2) / (p * t)
    return float(min(b2, d2) / d2) if d2 > 0 else 0.0, mu


def shrinkages(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lw_delta, lw_mu): ledoit_wolf() of each group's x, from sums of the names' own months by months products; a task leaves one matrix a group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            _, first, at = np.unique(np.asarray(b["_no"]), return_index=True, return_inverse=True)
            x = np.asarray(b["x"].flatten(), float)
            ends = np.cumsum(np.asarray(b["_t"]))
            for g, row in enumerate(first):
                rows = np.flatnonzero(at == g)
                t = int(b["_t"][row].as_py())
                xc = x[(ends[rows] - t)[:, None] + np.arange(t)]
                xc = xc - xc.mean(1, keepdims=True)
                key = tuple(b[k][int(row)].as_py() for k in keys)
                n, m = total.get(key, (0, 0.0))
                total[key] = (n + len(rows), m + xc.T @ xc)
        for key, (n, m) in total.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], kinds_[k]) for k, v in zip(keys, key)], pa.array([n], pa.int64()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=[*keys, "n", "m"])

    def one(rows: pa.Table) -> pa.Table:
        n, gram = sum(rows["n"].to_pylist()), sum(np.array(v) for v in rows["m"].to_pylist())
        t = round(len(gram) ** 0.5)
        delta, mu = gram_shrinkage(gram.reshape(t, t), n)
        return rows.select(keys).slice(0, 1).append_column("lw_delta", pa.array([delta], pa.float64())).append_column("lw_mu", pa.array([mu], pa.float64()))

    from pyspark.sql.pandas.types import to_arrow_type

    kinds_ = {k: to_arrow_type(history.schema[k].dataType) for k in keys}
    shape = ", ".join(f"{k} {history.schema[k].dataType.simpleString()}" for k in keys)
    slim = history.where("x IS NOT NULL").select(*keys, F.xxhash64(*keys).alias("_no"), F.size("x").alias("_t"), F.col("x"))
    return slim.mapInArrow(add, f"{shape}, n long, m array<double>").groupBy(*keys).applyInArrow(one, f"{shape}, lw_delta double, lw_mu double")


def variance(xc: np.ndarray, delta: float, mu: float, w: np.ndarray) -> float:
    y = xc @ w
    return float((1 - delta) / len(xc) * (y @ y) + delta * mu * (w @ w))


def shrinkage(rets: DataFrame, at: DataFrame, window: int, by: str = "eom") -> DataFrame:
    """(by, n, delta, mu) of the Ledoit-Wolf form at each period."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("entity")
        _, delta, mu = ledoit_wolf(np.array(f["x"].tolist()).T)
        return pd.DataFrame({by: [f[by].iloc[0]], "n": [len(f)], "delta": [delta], "mu": [mu]})

    kind = rets.schema[by].dataType.simpleString()
    return full_history(rets, at, window, by).groupBy(by).applyInPandas(one, f"{by} {kind}, n long, delta double, mu double")
