"""Keys, versions, periods and open metadata, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(*parts: Column) -> Column:
    """A digest of the parts as one JSON object: no delimiter or null can make two different keys meet."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def artifact_key(provider: Column, file_id: Column) -> Column:
    return stable_key(F.lower(F.trim(provider)), file_id)


def artifact_version(checksum: Column, modified: Column) -> Column:
    """The checksum where there is one, else the modification time."""
    return F.coalesce(checksum, modified.cast("string"))


def analysis_key(call_id: Column, transcript: Column, rubric: Column, prompt: Column, model: Column, again: Column | None = None) -> Column:
    """One key for one analysis; an explicit re-analysis adds its number."""
    return stable_key(call_id, transcript, rubric, prompt, model, F.lit(0) if again is None else again)


def natural_order(version: Column) -> Column:
    """What versions sort by when the numbers in them count as numbers: v9 before v10."""
    pieces = F.regexp_extract_all(version.cast("string"), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.ltrim(p, F.lit("0")), 40, "0")).otherwise(p))


def period(ts: Column, unit: str = "month") -> Column:
    return F.date_trunc(unit, ts).cast("date")


def meta(metadata: Column, path: str) -> Column:
    return F.get_json_object(metadata, path)


def artifact_role(mime: Column, name: Column) -> Column:
    """recording, transcript, notes or other, from the type and the name."""
    low_mime, low_name = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low_mime.startswith("audio/") | low_mime.startswith("video/"), "recording")
        .when(low_name.contains("transcri") | (low_mime == "text/vtt"), "transcript")
        .when(low_name.contains("note") | low_mime.contains("document"), "notes")
        .otherwise("other")
    )


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ()-]{7,}\d"


def mask_pii(text: Column) -> Column:
    """E-mail addresses and telephone numbers become placeholders; a mitigation, no proof of absence."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "<email>"), PHONE, "<phone>")


def log_safe_id(value: Column) -> Column:
    """What logs may carry instead of an id."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)
