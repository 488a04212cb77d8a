"""Reading inputs, caching stages, writing results."""

from __future__ import annotations

import hashlib
import json
import math
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_end, next_month_end
from ..functions.ranks import clean
from ..operators.universe import check_unique, first_by, sample_entities


def read_panel(spark: SparkSession, path: str, entity: str, period: str, columns: list[str] | None = None) -> DataFrame:
    """Panel with its period as a month-end, target_month, NaN as null; ValueError where a key repeats."""
    df = spark.read.parquet(path)
    df = df.select(*(columns or df.columns)).withColumn(period, month_end(F.col(period)))
    df = df.withColumns({f.name: clean(f.name) for f in df.schema if f.dataType.simpleString() in ("double", "float")})
    return check_unique(df.withColumn("target_month", next_month_end(F.col(period))), [entity, period])


def read_filings(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Filings with a date; the first of each (entity, text hash)."""
    cols = ["document_id", entity, "filing_date", "items", "text", "text_sha256", "company_name", "ticker"]
    f = spark.read.parquet(path).select(*cols).where(F.col(entity).isNotNull()).withColumn("filing_date", F.to_date("filing_date"))
    return first_by(f, [entity, "text_sha256"], ["filing_date", "document_id"])


def read_names(spark: SparkSession, path: str, column: str = "variable") -> list[str]:
    """One column of a CSV, nulls left out: the list of features."""
    return [r[0] for r in spark.read.csv(path, header=True).select(column).where(F.col(column).isNotNull()).collect()]


def read_market(spark: SparkSession, rate_path: str, index_path: str) -> DataFrame:
    """(eom, rate, index_ret) on the union of the dates of two CSVs."""
    rate = spark.read.csv(rate_path, header=True).select(F.to_date("eom").alias("eom"), F.col("tb3ms").cast("double").alias("rate"))
    index = spark.read.csv(index_path, header=True).select(F.to_date("eom").alias("eom"), F.col("sp500_ret").cast("double").alias("index_ret"))
    return rate.join(index, "eom", "full")


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Submission CSV; the weight column may be WEIGHT or WEIGHT %."""
    h = spark.read.csv(path, header=True)
    w = "WEIGHT" if "WEIGHT" in h.columns else "WEIGHT %"
    return h.select(F.to_date("Date").alias("date"), F.col("PERMNO").cast("long").alias("entity"), "TICKER", "COMPANY NAME", (F.col(f"`{w}`").cast("double") / 100).alias("weight"))


def columns_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def smoke(panel: DataFrame, filings: DataFrame, most: int = 1500, seed: int = 42, entity: str = "entity") -> tuple[DataFrame, DataFrame]:
    kept = sample_entities(panel, most, seed, entity)
    return kept, filings.join(kept.select(entity).distinct(), entity, "left_semi")


class Materializer:
    """Stages kept as Parquet under a root; the file name has a hash of the settings, so other settings never read it."""

    def __init__(self, spark: SparkSession, root: str | None = None, suffix: str = ""):
        sc = spark.sparkContext
        found = root or sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("name a root, or set spark.checkpoint.dir, in a folder that all machines share")
        self.spark, self.suffix = spark, suffix
        self.root = (found or f"file://{tempfile.mkdtemp(prefix='panel-')}").rstrip("/")

    def path(self, name: str, settings: Any = None) -> str:
        tag = hashlib.sha256(json.dumps(jsonable(settings), sort_keys=True).encode()).hexdigest()[:12]
        return f"{self.root}/{name}{self.suffix}-{tag}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, name: str, make: Callable[[], DataFrame], settings: Any = None) -> DataFrame:
        """The kept frame, or make() kept now."""
        path = self.path(name, settings)
        if not self._exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def get_with_info(self, name: str, make: Callable[[], tuple[DataFrame, dict]], settings: Any = None) -> tuple[DataFrame, dict]:
        """A frame with a dict beside it."""
        path = self.path(name, settings)
        if not (self._exists(f"{path}/_SUCCESS") and self._exists(f"{path}.info/_SUCCESS")):
            df, info = make()
            df.write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(json.dumps(jsonable(info)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.info")
        return self.spark.read.parquet(path), json.loads(self.spark.read.text(f"{path}.info", wholetext=True).first()[0])

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """df written under a name of its own and read again: lineage ends here."""
        return self.spark.read.schema(df.schema).parquet(self.path_of(df, name))

    def path_of(self, df: DataFrame, name: str) -> str:
        """df written under a name of its own; where."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def append_new(self, name: str, todo: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Incremental cache: rows of todo whose key is not there yet go through make() and are appended; the whole cache is returned."""
        path = f"{self.root}/{name}{self.suffix}"
        if self._exists(f"{path}/_SUCCESS"):
            todo = todo.join(self.spark.read.parquet(path).select(key), key, "left_anti")
        make(todo).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)


def jsonable(x: Any) -> Any:
    """Plain JSON values: NaN and infinities are null, tuple keys strings, dates ISO, arrays and frames lists."""
    if isinstance(x, dict):
        return {k if isinstance(k, str) else "|".join(map(str, k)) if isinstance(k, tuple) else str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    if isinstance(x, PurePath):
        return str(x)
    if isinstance(x, DataFrame):
        return [jsonable(r.asDict()) for r in x.collect()]
    if hasattr(x, "to_dict") and hasattr(x, "columns"):
        return jsonable(x.to_dict("records"))
    if hasattr(x, "tolist"):
        return jsonable(x.tolist())
    if hasattr(x, "__dataclass_fields__"):
        return {k: jsonable(getattr(x, k)) for k in x.__dataclass_fields__}
    return str(x)


def write_json(obj: Any, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(jsonable(obj), f, indent=2)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header: a submission, thousands of rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


RETURNS_COLUMNS = ["Date", "total", "excess", "active", "long_leg", "short_leg", "benchmark", "sp500"]


def returns_csv(returns: DataFrame) -> DataFrame:
    named = returns.withColumn("Date", F.date_format("date", "yyyy-MM-dd")).withColumnRenamed("index_ret", "sp500")
    return named.orderBy("Date").select(*RETURNS_COLUMNS)
