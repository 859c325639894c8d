"""One call: metadata, transcript, result; children bounded in size can be nested before joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest_children(df: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def call_detail(results: DataFrame) -> DataFrame:
    """Calls with their transcript's counts and digest and parsed current result; one row a call.

    What grows with the call (turns, objections, evidence) stays in rows of its own, joined by call_id; here are their numbers.
    """
    fields = ["overall_score", "opportunity_quality", "call_status", "confidence", "strengths", "critical_failures", "coaching_actions", "requires_human_review"]
    counts = ["n_segments", "speakers", "n_words", "n_questions", "text_sha256", "n_objections", (F.col("n_objections") + 1).alias("n_evidence")]
    return results.select("call_id", *counts, "model_version", "tokens", "cost", "valid", *(F.col(f"result.{f}").alias(f) for f in fields))
