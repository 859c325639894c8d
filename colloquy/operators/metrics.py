"""Dashboard measures and windows over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.ranges import windowed


def apply_filters(df: DataFrame, seller=None, product=None, team=None, start=None, end=None) -> DataFrame:
    """Those of the filters that are given; the period is from ``start`` to before ``end``."""
    for column, value in (("seller_id", seller), ("product_id", product), ("team_id", team)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter(F.col("call_date") >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col("call_date") < F.lit(end).cast("date"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def coverage(calls: DataFrame, analysed: DataFrame, *keys: str, call: str = "call_id") -> DataFrame:
    """Discovered and analysed calls, and the share."""
    done = analysed.select(F.col(call).alias("__done")).distinct()
    both = calls.join(done, F.col(call) == F.col("__done"), "left").groupBy(*keys)
    out = both.agg(F.count(F.lit(1)).alias("discovered"), F.count("__done").alias("analysed"))
    return out.withColumn("coverage", F.try_divide(F.col("analysed").cast("double"), F.col("discovered").cast("double")))


def mean_score(df: DataFrame, score: str, *keys: str, digits: int = 9) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(score), digits).alias("mean_score"), F.count(score).alias("n"))


def mix(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and shares of the whole; the window is over one row a group."""
    total = F.sum("n").over(Window.partitionBy())
    return count_by(df, *keys).withColumn("share", F.col("n").cast("double") / total.cast("double"))


def top_reasons(df: DataFrame, reason: str, k: int) -> DataFrame:
    """The ``k`` most frequent elements of an array column."""
    each = df.select(F.explode(reason).alias("reason"))
    return count_by(each, "reason").orderBy(F.desc("n"), "reason").limit(k)


def trend(df: DataFrame, key: str, order: list[Column], score: str, rows: int = 5) -> DataFrame:
    """Rolling mean of the last ``rows`` scores; ``order`` must be total."""
    return windowed(df, [key], order, {"rolling": lambda w: F.avg(score).over(w.rowsBetween(1 - rows, 0))}, before=rows - 1)


def slope(df: DataFrame, key: str, score: str, day: str) -> DataFrame:
    """Least-squares change of the score by day."""
    return df.groupBy(key).agg(F.regr_slope(score, F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")).alias("slope"), F.count(F.lit(1)).alias("n"))


def extremes(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """Rows among the ``k`` best or worst scores of their key."""
    best, worst = (F.dense_rank().over(Window.partitionBy(key).orderBy(o)) for o in (F.desc(score), F.asc(score)))
    return df.withColumns({"best_rank": best.cast("long"), "worst_rank": worst.cast("long")}).filter((F.col("best_rank") <= k) | (F.col("worst_rank") <= k))


def recent(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("recency") <= n)


def recurring(df: DataFrame, key: str, order: list[Column], reasons: str, n: int, least: int) -> DataFrame:
    """Reasons in at least ``least`` of the last ``n`` calls of a key."""
    each = recent(df, key, order, n).select(key, "call_id", F.explode(reasons).alias("reason"))
    return each.groupBy(key, "reason").agg(F.count_distinct("call_id").alias("calls")).filter(F.col("calls") >= least)


def performance_cube(df: DataFrame, score: str, *keys: str) -> DataFrame:
    return df.cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("mean_score"))


def with_dims(calls: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Left joins to dimension tables (table, key of calls, key of table); Spark broadcasts those below its size limit."""
    for table, left, right in dims:
        calls = calls.join(table, F.col(left) == F.col(right), "left")
    return calls


def material_status(calls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Which kinds of artifact each call has."""
    roles = artifacts.groupBy(F.col("call_id").alias("__call")).agg(*(F.max(F.col("role") == r).alias(f"has_{r}") for r in ("transcript", "notes", "recording")))
    out = calls.join(roles, F.col("call_id") == F.col("__call"), "left").drop("__call")
    return out.withColumns({f"has_{r}": F.coalesce(f"has_{r}", F.lit(False)) for r in ("transcript", "notes", "recording")})


def call_grain(df: DataFrame, call: str = "call_id") -> DataFrame:
    """Calls that break the rule of one row a call."""
    return df.groupBy(call).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
