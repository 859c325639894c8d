"""Stored intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. AQE sizes the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at ``path``; empty where there is none yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in spark.createDataFrame([], schema).schema.fields))


#: What a table may have at most to be broadcast, as counted by ``is_small``.
BROADCAST_BYTES = 32 << 20


def is_small(stored: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table, counted in rows and the bytes of their strings and arrays (16 an item of an array), may be broadcast."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    sizes = [F.coalesce(wide[kind](c), F.lit(0)) if kind in wide else (64 if "struct" in kind or "string" in kind else 16) * F.greatest(F.size(c), F.lit(0)) if kind.startswith("array") else F.lit(16) for c, kind in stored.dtypes]
    row = stored.agg(F.sum(sum(sizes, F.lit(16)).cast("long"))).first()
    return (row[0] or 0) <= most_bytes


def broadcast_if_small(stored: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(stored) if is_small(stored, most_bytes) else stored
