"""The analyzer's output: its schema, and validation that loses no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType([T.StructField("timestamp", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("excerpt", T.StringType()), T.StructField("claim", T.StringType())])
DIMENSION = T.StructType([T.StructField("dimension", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType())])
#: The eleven fields of an analysis.
OUTPUT = T.StructType([
    T.StructField("overall_score", T.DoubleType()),
    T.StructField("opportunity_quality", T.StringType()),
    T.StructField("call_status", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("strengths", "critical_failures", "objections", "coaching_actions")),
    T.StructField("dimensions", T.ArrayType(DIMENSION)),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("requires_human_review", T.BooleanType()),
])
QUALITIES, STATUSES = ("qualified", "unqualified", "unclear"), ("won", "lost_by_closer", "lost_by_lead", "follow_up", "no_show")


def problems(result: Column, raw: Column) -> Column:
    """Names of what is wrong with a parsed output: absent fields, unknown values, ranges, unknown fields."""
    absent = [F.when(result[f.name].isNull(), F.concat(F.lit("missing:"), F.lit(f.name))) for f in OUTPUT.fields]
    unknown = [F.when(~result[c].isin(*ok), F.concat(F.lit("unknown:"), F.lit(c))) for c, ok in (("opportunity_quality", QUALITIES), ("call_status", STATUSES))]
    ranges = [F.when((result[c] < 0) | (result[c] > high), F.concat(F.lit("range:"), F.lit(c))) for c, high in (("overall_score", 100.0), ("confidence", 1.0))]
    extra = F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in OUTPUT.fields)))
    corrupt = F.when(result["_corrupt_record"].isNotNull(), F.lit("corrupt"))
    return F.concat(F.array_compact(F.array(corrupt, *absent, *unknown, *ranges)), F.transform(extra, lambda x: F.concat(F.lit("extra:"), x)))


def parse_output(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """``df`` with ``result`` (the parsed output), ``problems`` and ``valid``. Every row stays."""
    schema = T.StructType([*OUTPUT.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.coalesce(F.col(raw), F.lit("null")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = df.withColumn("result", parsed).withColumn("problems", problems(F.col("result"), F.col(raw)))
    return out.withColumn("valid", F.col("result").isNotNull() & (F.size("problems") == 0))


def evidence_gaps(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``df`` with the number of evidence items that lack one of their four parts."""
    lacks = F.size(F.filter(F.coalesce(F.col(evidence), F.array().cast("array<struct<timestamp:int,speaker:string,excerpt:string,claim:string>>")), lambda e: e["timestamp"].isNull() | e["speaker"].isNull() | e["excerpt"].isNull() | e["claim"].isNull()))
    return df.withColumn("evidence_gaps", lacks)


def needs_review(flag: Column, confidence: Column, least: float = 0.6) -> Column:
    """Flagged, or less sure than ``least``, or of unknown confidence."""
    return F.coalesce(flag, F.lit(True)) | F.coalesce(confidence < least, F.lit(True))
