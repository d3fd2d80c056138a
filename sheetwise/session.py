"""Sessions, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "sheetwise", **settings: str) -> SparkSession:
    """A session with adaptive execution; the cluster's own settings hold where it names them."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def literal(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A few rows of the plan itself: a table from Python's rows starts Python workers on every core."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the checkpoint folder that the cluster names (spark.checkpoint.dir), so that many readers share it and a lost executor costs nothing of it. It is a compressed table: readers take the columns they need.

    Only a local session that names no folder (tests) gets one of this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sheetwise-"))
    path = f"{context.getCheckpointDir().rstrip('/')}/settled-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
