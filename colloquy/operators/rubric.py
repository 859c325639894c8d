"""Rubrics: layers, overrides, weights, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.keys import natural_order

#: The global dimensions of a call (fixed values).
CORE_DIMENSIONS = ["opening", "discovery", "qualification", "diagnosis", "value", "offer", "objections", "closing", "next_steps", "process"]


def rubric_layers(**layers: DataFrame) -> DataFrame:
    """All layers' rows with the layer's name."""
    out = None
    for name, df in layers.items():
        own = df.withColumn("layer", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def effective_rubric(core: DataFrame, product: DataFrame) -> DataFrame:
    """(dimension, weight, overridden): product weights replace core ones and add dimensions."""
    p = product.select("dimension", F.col("weight").alias("__weight"))
    both = core.join(p, "dimension", "full")
    return both.select("dimension", F.coalesce("__weight", "weight").alias("weight"), F.col("__weight").isNotNull().alias("overridden"))


def weighted_score(dims: DataFrame, *keys: str) -> DataFrame:
    """Mean of scores by weight; null where all weights are zero."""
    total = F.nullif(F.sum("weight"), F.lit(0.0))
    return dims.groupBy(*keys).agg((F.sum(F.col("score") * F.col("weight")) / total).alias("weighted_score"))


def resolve_versions(calls: DataFrame, versions: DataFrame, what: str = "rubric", key: str = "product_id", pinned: str = "pinned_version") -> DataFrame:
    """Calls with the version of a rubric, or of a prompt, to use (``<what>_version``): a pinned one, else the latest active one of the call's ``key`` (v10 is later than v9)."""
    latest = versions.filter("active").groupBy(F.col(key).alias("__key")).agg(F.max_by("version", natural_order(F.col("version"))).alias("__version"))
    out = calls.join(latest, F.col(key) == F.col("__key"), "left")
    return out.withColumn(f"{what}_version", F.coalesce(pinned, "__version")).drop("__key", "__version")
