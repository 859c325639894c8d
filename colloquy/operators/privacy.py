"""Retention, logs, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.keys import log_safe_id

CONTENT = ("text", "full_text", "segments", "raw_json", "excerpt", "html")


def apply_retention(df: DataFrame, cutoff: str, ts: str = "call_date") -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(cutoff).cast("date"))


def log_safe(df: DataFrame, ids: list[str]) -> DataFrame:
    """Without any content column, ids hashed."""
    kept = [c for c in df.columns if c not in CONTENT]
    return df.select(*(log_safe_id(F.col(c)).alias(c) if c in ids else F.col(c) for c in kept))


def visible_to(df: DataFrame, role: str, user=None) -> DataFrame:
    """admin sees all, a manager the team, a seller their own; others nothing. A filter, not an enforcement."""
    if role == "admin":
        return df
    column = {"manager": "team_id", "seller": "seller_id"}.get(role)
    return df.filter(F.col(column) == user) if column else df.filter(F.lit(False))
