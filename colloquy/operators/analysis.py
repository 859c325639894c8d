"""Analysis runs: a provider-neutral analyzer, append-only runs, evidence."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ranges import windowed
from colloquy.operators.ingest import spoken
from colloquy.operators.rubric import CORE_DIMENSIONS


class CallAnalyzer(Protocol):
    """What an analyzer offers: its model's name, and an answer (JSON, tokens, cost) to a transcript."""

    model_version: str

    def analyze(self, transcript: str) -> tuple[str, int, float]: ...


class RuleAnalyzer:
    """A deterministic stand-in that works offline: counts words and question marks. Its scores say nothing about calls.

    Every line with a comma is an objection and its evidence, whole; ``objections`` and ``evidence`` say the
    same of rows. A plain text has no times: ``timestamp`` is the line's number.
    """

    model_version = "rules-2"

    def analyze(self, transcript: str) -> tuple[str, int, float]:
        words, questions = len(transcript.split()), transcript.count("?")
        score = float(min(100, 20 + words % 61 + 5 * questions))
        lines = [x for x in transcript.split("\n") if x]
        claims = [(i, x, claim) for i, x in enumerate(lines) for claim, holds in (("opening", i == 0), ("objection", "," in x)) if holds]
        evidence = [{"timestamp": i, "speaker": x.split(":")[0], "excerpt": x, "claim": claim} for i, x, claim in claims]
        dimensions = [{"dimension": d, "score": (score + 7 * i) % 101, "weight": 1.0} for i, d in enumerate(CORE_DIMENSIONS)]
        answer = {
            "overall_score": score,
            "opportunity_quality": "qualified" if words > 100 else "unclear",
            "call_status": "follow_up" if questions else "lost_by_closer",
            "confidence": round(min(1.0, words / 400), 4),
            "strengths": ["detail"] if words > 200 else [],
            "critical_failures": [] if questions else ["no questions"],
            "objections": [x for x in lines if "," in x],
            "coaching_actions": [] if questions else ["ask open questions"],
            "dimensions": dimensions,
            "evidence": evidence,
            "requires_human_review": words < 30,
        }
        return json.dumps(answer, ensure_ascii=False), words + 50, round(words * 1e-6, 6)


ANALYZERS: dict[str, type] = {"rules": RuleAnalyzer}


def get_analyzer(name: str) -> CallAnalyzer:
    """An adapter by name; providers register theirs in ANALYZERS."""
    if name not in ANALYZERS:
        raise KeyError(f"no analyzer {name!r}; known: {sorted(ANALYZERS)}")
    return ANALYZERS[name]()


def run_analyzer(requests: DataFrame, analyzer: str | CallAnalyzer = "rules") -> DataFrame:
    """(call_id, analysis_key, model_version, raw_json, tokens, cost, error) for ``requests`` (call_id, analysis_key, full_text).

    Store the result before any second use: a recomputed task asks the provider again. An answer that
    fails is a row with an error, never the text of the call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
        for frame in frames:
            rows = []
            for call_id, key, text in zip(frame["call_id"], frame["analysis_key"], frame["full_text"], strict=True):
                try:
                    rows.append((call_id, key, model.model_version, *model.analyze(text or ""), None))
                except Exception as failed:
                    rows.append((call_id, key, model.model_version, None, 0, 0.0, type(failed).__name__))
            yield pd.DataFrame(rows, columns=["call_id", "analysis_key", "model_version", "raw_json", "tokens", "cost", "error"])

    kind = requests.schema["call_id"].dataType.simpleString()
    return requests.select("call_id", "analysis_key", "full_text").mapInPandas(run, f"call_id {kind}, analysis_key string, model_version string, raw_json string, tokens long, cost double, error string")


def rule_answers(counts: DataFrame) -> DataFrame:
    """What RuleAnalyzer answers, from ``counts`` (see ingest.transcript_counts): (call_id, model_version, raw_json, tokens, cost, error).

    The lists of objections and evidence, as long as the call, are empty here: ``rule_items`` has an item a row.
    """
    words, questions = F.col("n_words"), F.col("n_questions")
    score = F.least(F.lit(100), 20 + words % 61 + 5 * questions).cast("double")
    tags = lambda holds, tag: F.when(holds, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    answer = {
        "overall_score": score,
        "opportunity_quality": F.when(words > 100, "qualified").otherwise("unclear"),
        "call_status": F.when(questions > 0, "follow_up").otherwise("lost_by_closer"),
        "confidence": F.round(F.least(F.lit(1.0), words / 400), 4),
        "strengths": tags(words > 200, "detail"),
        "critical_failures": tags(questions == 0, "no questions"),
        "objections": F.array().cast("array<string>"),
        "coaching_actions": tags(questions == 0, "ask open questions"),
        "dimensions": F.array(*(F.struct(F.lit(d).alias("dimension"), ((score + 7 * i) % 101).alias("score"), F.lit(1.0).alias("weight")) for i, d in enumerate(CORE_DIMENSIONS))),
        "evidence": F.array().cast("array<string>"),
        "requires_human_review": words < 30,
    }
    raw = F.to_json(F.struct(*(c.alias(n) for n, c in answer.items())))
    model = F.lit(RuleAnalyzer.model_version).alias("model_version")
    return counts.select("*", model, raw.alias("raw_json"), (words + 50).alias("tokens"), F.round(words * 1e-6, 6).alias("cost"), F.lit(None).cast("string").alias("error"))


def rule_items(segments: DataFrame) -> DataFrame:
    """(call_id, raw_json): each objection and each evidence of a call as an answer that holds it alone."""
    ev = evidence(segments).select("call_id", F.to_json(F.struct(F.array(F.struct("timestamp", "speaker", "excerpt", "claim")).alias("evidence")), {"ignoreNullFields": "false"}).alias("raw_json"))
    return objections(segments).select("call_id", F.to_json(F.struct(F.array("line").alias("objections"))).alias("raw_json")).unionByName(ev)


def append_run(runs: DataFrame, path: str) -> None:
    """Runs are only ever added; what was written before is left as it is."""
    runs.write.mode("append").parquet(path)


def current_runs(runs: DataFrame, keys: list[str], *latest: Column) -> DataFrame:
    """One run a key: the first by ``latest``, which must order runs totally."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))).filter("__n = 1").drop("__n")


def run_history(runs: DataFrame, keys: list[str], order: list[Column], score: str) -> DataFrame:
    """All runs with their number and the change of the score from the run before; ``order`` must be total."""
    out = windowed(runs, keys, order, {"delta": lambda w: F.col(score) - F.lag(score).over(w)}, before=1, number="run_number")
    return out.select(*runs.columns, F.col("run_number").cast("long").alias("run_number"), "delta")


def json_history(runs: DataFrame) -> DataFrame:
    """Every raw answer with the versions it came from."""
    return runs.select("call_id", "analysis_key", "model_version", "raw_json")


def explode_dimensions(results: DataFrame) -> DataFrame:
    return results.select("call_id", F.inline("result.dimensions"))


def explode_evidence(results: DataFrame) -> DataFrame:
    return results.select("call_id", F.inline("result.evidence"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """(call_id, turn, speaker, line): all lines of the transcripts but empty ones, a row each; none is cut or gathered."""
    return segments.select("call_id", "turn", "speaker", F.explode(F.split(spoken(), "\n")).alias("line")).filter("line <> ''")


def objections(segments: DataFrame) -> DataFrame:
    """(call_id, turn, speaker, line) of every line with a comma."""
    return transcript_lines(segments).filter(F.contains(F.col("line"), F.lit(",")))


def evidence(segments: DataFrame) -> DataFrame:
    """(call_id, timestamp, speaker, excerpt, claim): each call's opening and all objections, whole lines. The turn is the time."""
    first = segments.groupBy("call_id").agg(F.min(F.struct("turn", "speaker", F.coalesce("text", F.lit("")).alias("text"))).alias("s")).select("call_id", "s.*")
    opening = first.select("call_id", "turn", "speaker", F.split(spoken(), "\n")[0].alias("line"), F.lit("opening").alias("claim"))
    both = opening.unionByName(objections(segments).withColumn("claim", F.lit("objection")))
    return both.select("call_id", F.col("turn").cast("int").alias("timestamp"), F.coalesce("speaker", F.lit("?")).alias("speaker"), F.col("line").alias("excerpt"), "claim")


def locate_evidence(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Evidence with the segment (call_id, start, end) whose span holds its time; the spans of a call are disjoint.

    Each row takes the last start before it, in one sorted pass over a call, so no pairs are made.
    """
    spans = segments.filter("start < end").select("call_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct("start", "end", "segment").alias("__span"))
    rows = evidence.withColumns({"__at": F.col("timestamp"), "__kind": F.lit(1)}).unionByName(spans, allowMissingColumns=True)
    before = Window.partitionBy("call_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.withColumn("__span", F.last("__span", True).over(before)).filter("__kind = 1")
    inside = F.when(F.col("call_id").isNotNull() & (F.col("timestamp") < F.col("__span.end")), F.col("__span"))
    return last.withColumn("__span", inside).select(*evidence.columns, "__span.start", "__span.end", "__span.segment")


def apply_rules(results: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """A boolean column for each (name, SQL condition); rules come from trusted configuration only."""
    return results.withColumns({name: F.coalesce(F.expr(condition), F.lit(False)) for name, condition in rules})


def audit_trail(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Who did what and when: (call_id, actor, action, ts)."""
    ran = runs.select("call_id", "actor", F.lit("analysed").alias("action"), "ts")
    return ran.unionByName(reviews.select("call_id", "actor", F.lit("reviewed").alias("action"), "ts"))
