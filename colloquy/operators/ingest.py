"""Ingestion: sources, changes, registration, transcripts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.keys import artifact_key, artifact_version, natural_order
from colloquy.operators.folders import walk_folders  # noqa: F401

PRIORITY = {"transcript": 1, "notes": 2, "recording": 3}


def active_sources(locations: DataFrame) -> DataFrame:
    return locations.filter(F.coalesce(F.col("active"), F.lit(False)))


def changed_since(files: DataFrame, checkpoints: DataFrame, source: str = "source_location_id", modified: str = "modified_time") -> DataFrame:
    """Files of a source after its checkpoint, all of a source without one. Registration decides what is new."""
    marks = checkpoints.select(F.col(source).alias("__source"), F.col("last_synced_at").alias("__mark"))
    out = files.join(marks, F.col(source) == F.col("__source"), "left").filter(F.col("__mark").isNull() | (F.col(modified) > F.col("__mark")))
    return out.drop("__source", "__mark")


def with_keys(files: DataFrame) -> DataFrame:
    return files.withColumn("artifact_key", artifact_key(F.col("provider"), F.col("external_file_id"))).withColumn("version", artifact_version(F.col("checksum"), F.col("modified_time")))


def register_artifacts(new: DataFrame, registry: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` that the registry lacks, one a key (the first by ``order``): a late or repeated file registers once."""
    keys = keys or ["artifact_key", "version"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.col("modified_time"), F.col("uri")])))
    once = new.withColumn("__n", first).filter("__n = 1").drop("__n")
    known = registry.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = here if same is None else same & here
    return once.join(known, same, "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def normalise_metadata(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """Trimmed lower-case texts (empty ones null) and numbers that fail to null."""
    low = {c: F.nullif(F.lower(F.trim(c)), F.lit("")) for c in texts}
    return df.withColumns({**low, **{c: F.col(c).try_cast("double") for c in numbers}})


def pick_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def pick_transcript(artifacts: DataFrame) -> DataFrame:
    """The best text source of each call: transcript, then exportable notes, then a recording to transcribe."""
    rank = F.coalesce(*(F.when(F.col("role") == r, F.lit(p)) for r, p in PRIORITY.items()))
    return pick_first(artifacts.withColumn("priority", rank).filter("priority IS NOT NULL"), ["call_id"], F.col("priority"), F.col("artifact_id"))


def needs_transcription(artifacts: DataFrame) -> DataFrame:
    """Calls that have a recording and no text."""
    texts = artifacts.filter(F.col("role").isin("transcript", "notes")).select("call_id")
    return artifacts.filter(F.col("role") == "recording").select("call_id").distinct().join(texts, "call_id", "left_anti")


def transcription_worklist(artifacts: DataFrame) -> DataFrame:
    """Recordings, by reference, for an external transcriber."""
    return artifacts.filter(F.col("role") == "recording").join(needs_transcription(artifacts), "call_id", "left_semi").select("call_id", "artifact_id", "uri")


def spoken() -> Column:
    """A segment as the transcript has it: speaker and text."""
    return F.concat(F.coalesce("speaker", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))


def transcript_counts(segments: DataFrame, call: str = "call_id") -> DataFrame:
    """One row a call: numbers of segments, words, questions and lines with a comma, and speakers in order of name. No text is gathered."""
    lines = F.size(F.filter(F.split(spoken(), "\n"), lambda x: F.contains(x, F.lit(","))))
    counts = {"n_words": F.regexp_count(spoken(), F.lit(r"(?U)\S+")), "n_questions": F.regexp_count(spoken(), F.lit(r"\?")), "n_objections": lines}
    sums = [F.sum(c).cast("long").alias(n) for n, c in counts.items()]
    return segments.groupBy(call).agg(F.count(F.lit(1)).alias("n_segments"), F.array_sort(F.collect_set("speaker")).alias("speakers"), *sums)


def transcript_headers(segments: DataFrame, call: str = "call_id") -> DataFrame:
    """One row a call: from when to when it was spoken, and the transcript's origin, language and version, as far as segments have them.

    Where segments of a call differ in one of these, that of the last one in order (start, turn, then version as numbers) stands, and ``mixed`` says so.
    Segments without a start or turn come first; a null stands only where no segment has a value.
    """
    there = [c for c in ("origin", "language", "version") if c in segments.columns]
    times = [f.alias(n) for n, f, c in (("starts", F.min("start"), "start"), ("ends", F.max("end"), "end")) if c in segments.columns]
    mixed = reduce(lambda a, b: a | b, (~F.min(c).eqNullSafe(F.max(c)) for c in there), F.lit(False))
    order = [F.col(c) for c in ("start", "turn") if c in segments.columns] + [natural_order(F.col("version"))] * ("version" in there)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c)))).alias(c)
    return segments.groupBy(call).agg(*times, *(last(c) for c in there), mixed.alias("mixed"))


def transcript_digests(segments: DataFrame, call: str = "call_id") -> DataFrame:
    """(call, text_sha256): SHA-256 of each call's transcript, its segments in turn order (then speaker, text) one a line.

    A call's segments stream through one task in order; its text is never one string.
    """
    rows = segments.select(F.col(call).alias("__call"), "turn", "speaker", F.coalesce("text", F.lit("")).alias("text"), spoken().alias("__line"))
    ordered = rows.repartition("__call").sortWithinPartitions("__call", "turn", "speaker", "text").select("__call", "__line")
    kind = rows.schema["__call"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, layout = None, None, None
        for batch in batches:
            layout, done = pa.schema([("__call", batch.schema.field("__call").type), ("text_sha256", pa.string())]), []
            for own, line in zip(batch.column("__call").to_pylist(), batch.column("__line").to_pylist(), strict=True):
                if digest is not None and own == key:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append({"__call": key, "text_sha256": digest.hexdigest()})
                    key, digest = own, hashlib.sha256()
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=layout)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"__call": key, "text_sha256": digest.hexdigest()}], schema=layout)

    return ordered.mapInArrow(run, f"__call {kind}, text_sha256 string").withColumnRenamed("__call", call)


def normalise_transcript(segments: DataFrame, call: str = "call_id") -> DataFrame:
    """One row a call: the counts and speakers of ``transcript_counts`` and the digest of the text. The text stays one row a turn."""
    digests = transcript_digests(segments, call).withColumnRenamed(call, "__call")
    return transcript_counts(segments, call).join(digests, F.col(call).eqNullSafe(F.col("__call"))).drop("__call")


def artifact_reference(df: DataFrame) -> DataFrame:
    """Path, size and time of files; never their bytes."""
    return df.select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))


def export_text(html: Column) -> Column:
    """Text of an exported document: scripts, styles and tags out, white space made single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def resolve_seller(calls: DataFrame, aliases: DataFrame, alias: str = "alias") -> DataFrame:
    """``seller_id`` of the location, else of a known alias that means one seller; ``needs_review`` where neither is."""
    clean = F.lower(F.trim(F.col(alias)))
    known = aliases.groupBy(clean.alias("__alias")).agg(F.min("seller_id").alias("__seller"), F.count_distinct("seller_id").alias("__n")).filter("__n = 1")
    out = calls.join(known, F.lower(F.trim(F.col("seller_name"))) == F.col("__alias"), "left")
    seller = F.coalesce(F.col("location_seller_id"), F.col("__seller"))
    return out.withColumn("seller_id", seller).withColumn("needs_review", seller.isNull()).drop("__alias", "__seller", "__n")
