"""Session settings the engine expects; everything also runs in a session made elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Results depend on the time zone only; the others are tuning defaults.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "panelspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with DEFAULTS; ``extra`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_REMOTE" not in os.environ:
        builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
