"""Scheduled polling of file manifests, as a stream that takes what is there and stops.

Each micro-batch registers its new artifacts in a partition of its own (stream, run, batch), written with
dynamic overwrite. ``run`` is the id that Spark keeps in the checkpoint: a batch that is replayed after a failure has
the same run and number and replaces itself, while batches after a lost checkpoint belong to another run and
replace nothing. Every batch is held against the whole registry but its own partition, so an artifact registers once
however often it is seen. Spark commits its offsets, the checkpoint, only after the batch function has returned. A late
file is found by its key, not by a time cursor, so no watermark is used and none is dropped.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ingest import register_artifacts, with_keys
from colloquy.sources.store import read_or_empty

MANIFEST = "provider string, external_file_id string, modified_time timestamp, checksum string, uri string, mime string, name string, source_location_id string"
REGISTRY = f"{MANIFEST}, artifact_key string, version string, stream string, run string, batch long"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """What has been registered so far; empty before the first batch."""
    return read_or_empty(spark, path, REGISTRY)


def register_batch(batch: DataFrame, registry_path: str, stream: str, run: str, number: int) -> None:
    """Add a batch's new artifacts to the registry; the same (stream, run, number) again replaces its own rows only."""
    own = (F.col("stream") == stream) & (F.col("run") == run) & (F.col("batch") == number)
    known = registry(batch.sparkSession, registry_path).filter(~own)
    names = {"stream": F.lit(stream), "run": F.lit(run), "batch": F.lit(number).cast("long")}
    new = register_artifacts(with_keys(batch), known).withColumns(names)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(registry_path)


def poll_once(spark: SparkSession, manifests: str, registry_path: str, checkpoint: str, stream: str = "drive", file_format: str = "parquet") -> None:
    """Register all new artifacts of the manifests that have come since the last call."""
    started, run = Event(), []

    def register(batch: DataFrame, number: int) -> None:
        started.wait()
        register_batch(batch, registry_path, stream, run[0], number)

    incoming = spark.readStream.schema(MANIFEST).format(file_format).load(manifests)
    query = incoming.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.append(str(query.id))
    started.set()
    query.awaitTermination()
