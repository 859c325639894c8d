"""The analyzer against people: pairs, agreement, golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_scores(dims: DataFrame, reviews: DataFrame) -> DataFrame:
    """(call_id, dimension, score, human_score) where both sides scored."""
    return dims.join(reviews.select("call_id", "dimension", "human_score"), ["call_id", "dimension"]).filter("score IS NOT NULL AND human_score IS NOT NULL")


def evaluator_quality(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute error, bias and correlation by the given versions or dimensions."""
    error = F.col("score") - F.col("human_score")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(error)), 9).alias("mae"), F.round(F.avg(error), 9).alias("bias"), F.round(F.corr("score", "human_score"), 9).alias("corr"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Two booleans: the confusion counts and Cohen's kappa, in one row."""
    n = df.agg(*(F.count_if((a == x) & (b == y)).alias(f"n{int(x)}{int(y)}") for x in (False, True) for y in (False, True)))
    total = (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).cast("double")
    observed = (F.col("n00") + F.col("n11")) / total
    chance = ((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11"))) / (total * total)
    return n.withColumn("kappa", F.round(F.try_divide(observed - chance, 1 - chance), 9))


def golden_sample(calls: DataFrame, strata: list[str], n: int, key: Column, salt: str = "golden") -> DataFrame:
    """Exactly ``n`` calls (or all there are) of each stratum, by hash, the same on every run."""
    order = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    return calls.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).filter(F.col("__n") <= n).drop("__n")
