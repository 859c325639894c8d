"""The persisted flow: calls are analysed once for each set of versions, and all that follows from a run becomes visible with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.keys import analysis_key
from colloquy.functions.validation import needs_review, parse_output
from colloquy.operators import analysis, ingest
from colloquy.sources.commits import Changes, CommitLog, Snapshot, new_keys
from colloquy.sources.store import materialise

VERSIONS = "rubric_version string, prompt_version string, job string"
#: The tables of a run.
TABLES = {
    "runs": f"call_id long, analysis_key string, model_version string, raw_json string, tokens long, cost double, error string, {VERSIONS}",
    "dimensions": f"call_id long, analysis_key string, dimension string, score double, weight double, {VERSIONS}",
    "evidence": f"call_id long, analysis_key string, timestamp int, speaker string, excerpt string, claim string, {VERSIONS}",
    "state_events": f"call_id long, analysis_key string, seq int, state string, ts timestamp, {VERSIONS}",
}


def stored(spark: SparkSession, path: str) -> CommitLog:
    """The log of the flow's tables under ``path``; readers go through it."""
    return CommitLog(spark, path, TABLES)


def follow_up(answers: DataFrame, segments: DataFrame, at: str) -> dict[str, DataFrame]:
    """The rows of all tables that follow from answers: the runs, their dimensions and evidence, and the states they pass."""
    names = ["rubric_version", "prompt_version", "job"]
    parsed = parse_output(answers)
    review = needs_review(F.col("result.requires_human_review"), F.col("result.confidence"))
    last = F.when(~F.col("valid"), "FAILED_RETRYABLE").when(review, "NEEDS_REVIEW").otherwise("ANALYZED")
    steps = F.array(F.lit("ANALYSIS_QUEUED"), F.lit("ANALYZING"), last)
    keys = answers.select(F.col("call_id").alias("__call"), "analysis_key", *names)
    return {
        "runs": answers,
        "dimensions": parsed.select("call_id", "analysis_key", F.inline("result.dimensions"), *names),
        "evidence": analysis.evidence(segments).join(keys, F.col("call_id").eqNullSafe(F.col("__call"))).drop("__call"),
        "state_events": parsed.select("call_id", "analysis_key", F.posexplode(steps).alias("seq", "state"), F.lit(at).cast("timestamp").alias("ts"), *names),
    }


def analyse_new(spark: SparkSession, segments: DataFrame, path: str, rubric: str, prompt: str, job: str, at: str, before_publish: Callable[[], None] | None = None) -> DataFrame:
    """Analyse the calls of ``segments`` that have no run under these versions, and commit what follows in all tables at once.

    ``job`` is a label; it may be used again. Nothing that is stored is ever replaced: a call that has a run under these versions gets no
    other, whoever stored it, also where two jobs run at once. Answers are asked for once, however often the commit is tried. Returns the keys that were added.
    """
    log, made = stored(spark, path), []
    counts = ingest.normalise_transcript(segments)
    key = analysis_key(F.col("call_id"), F.col("text_sha256"), F.lit(rubric), F.lit(prompt), F.lit(analysis.RuleAnalyzer.model_version))
    wanted = counts.withColumn("analysis_key", key)

    def build(now: Snapshot) -> Changes:
        known = log.read("runs", now).select("analysis_key")
        if not made:
            answers = analysis.rule_answers(new_keys(wanted, known, "analysis_key"))
            made.append(materialise(answers.withColumns({"rubric_version": F.lit(rubric), "prompt_version": F.lit(prompt), "job": F.lit(job)}), "answers"))
        new = new_keys(made[0], known, "analysis_key")
        return ({}, []) if new.isEmpty() else (follow_up(new, segments, at), [])

    return log.added("runs", log.commit(build, job, before_publish=before_publish)).select("call_id", "analysis_key")
