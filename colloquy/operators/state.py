"""The pipeline's states, as an append-only log of events (call_id, state, ts, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.ranges import windowed

#: The states of a call (fixed values).
STATES = ["DISCOVERED", "METADATA_READY", "TRANSCRIPT_READY", "ANALYSIS_QUEUED", "ANALYZING", "ANALYZED", "BLOCKED", "NEEDS_REVIEW", "FAILED_RETRYABLE", "FAILED_PERMANENT"]
FORWARD = STATES[:6]
FAILURES = ["BLOCKED", "FAILED_RETRYABLE", "FAILED_PERMANENT"]


def allowed_transitions() -> list[tuple[str, str]]:
    """The forward path; any unfinished stage may fail, block or ask for review; a retry enters the stage that failed."""
    steps = list(zip(FORWARD, FORWARD[1:]))
    stops = [(s, x) for s in FORWARD[:-1] for x in ("BLOCKED", "NEEDS_REVIEW", "FAILED_RETRYABLE", "FAILED_PERMANENT")]
    back = [(x, s) for x in ("BLOCKED", "FAILED_RETRYABLE") for s in FORWARD[:-1]]
    return [*steps, *stops, *back, ("ANALYZED", "NEEDS_REVIEW"), ("ANALYZED", "ANALYSIS_QUEUED"), ("NEEDS_REVIEW", "ANALYSIS_QUEUED"), ("NEEDS_REVIEW", "ANALYZED"), ("FAILED_RETRYABLE", "FAILED_PERMANENT")]


def current_state(events: DataFrame, key: str = "call_id", state: str = "state", ts: str = "ts", seq: str = "seq") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.col(state), F.struct(ts, seq)).alias("state"), F.max(ts).alias("since"))


def with_previous(events: DataFrame, key: str = "call_id", state: str = "state", ts: str = "ts", seq: str = "seq") -> DataFrame:
    return windowed(events, [key], [F.col(ts), F.col(seq)], {"previous": lambda w: F.lag(state).over(w)}, before=1)


def illegal_transitions(spark: SparkSession, events: DataFrame, allowed: list[tuple[str, str]] | None = None, first: str = "DISCOVERED", **cols) -> DataFrame:
    """Events whose step from the one before is not allowed, or that begin with another state than ``first``."""
    table = spark.createDataFrame(allowed or allowed_transitions(), "__from string, __to string")
    state = F.col(cols.get("state", "state"))
    steps = with_previous(events, **cols)
    begins = steps.filter(F.col("previous").isNull() & (state != first))
    moves = steps.filter("previous IS NOT NULL").join(F.broadcast(table), (F.col("previous") == F.col("__from")) & (state == F.col("__to")), "left_anti")
    return moves.unionByName(begins)


def dwell(events: DataFrame, key: str = "call_id", state: str = "state", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Seconds in each state that has ended."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = lambda w: (micros(F.lead(ts).over(w)) - micros(F.col(ts))) / 1e6
    return windowed(events, [key], [F.col(ts), F.col(seq)], {"seconds": seconds}, after=1).filter("seconds IS NOT NULL")


def requeue(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Calls that failed but may be tried again: (call_id, attempts)."""
    tries = events.groupBy("call_id").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.count_if(F.col("state") == "FAILED_RETRYABLE").alias("attempts"))
    return tries.filter((F.col("state") == "FAILED_RETRYABLE") & (F.col("attempts") < max_attempts)).select("call_id", "attempts")


def pending(requests: DataFrame, runs: DataFrame, key: str = "analysis_key") -> DataFrame:
    """Requests without a run, one a key."""
    return requests.dropDuplicates([key]).join(runs.select(key), key, "left_anti")


def enqueue(calls: DataFrame, runs: DataFrame, queued_at: str) -> DataFrame:
    """State events that queue the calls (with an ``analysis_key``) that have no run yet."""
    return pending(calls, runs).select("call_id", F.lit("ANALYSIS_QUEUED").alias("state"), F.lit(queued_at).cast("timestamp").alias("ts"), F.col("analysis_key").alias("seq"))


def state_gap(df: DataFrame, other: DataFrame, key: str = "call_id") -> DataFrame:
    """Keys of ``df`` that ``other`` lacks."""
    return df.select(key).distinct().join(other.select(key), key, "left_anti")
