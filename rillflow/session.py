"""Session defaults and the folder for intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "rillflow", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys use _ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there. A cluster
    names the folder in spark.checkpoint.dir; where that is unset, a temporary one
    is used, if all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="rillflow-"))
    return df.checkpoint(eager=True)
