"""Windows by ranges give what plain windows give, and spread a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import ranges
from colloquy.operators import analysis, metrics, state


def events(spark, n, hot=0.6, seed=1):
    draw = random.Random(seed)
    rows = [(k, None if draw.random() < 0.05 else "hot" if draw.random() < hot else f"k{draw.randrange(9)}", draw.randrange(n // 3), draw.choice([None, *range(9)]), draw.choice(["DISCOVERED", "METADATA_READY", "BLOCKED"])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, key string, t long, x long, state string").repartition(5)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [3000, 3, 0])
def test_windows_by_range_equal_plain_ones(spark, n):
    df = events(spark, max(n, 3)).limit(n)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in ([F.col("t"), F.col("id")], [F.desc("t"), F.col("id")]):
            w = Window.partitionBy("key").orderBy(*order)
            columns = {
                "mean": lambda w: F.round(F.avg("x").over(w.rowsBetween(-4, 0)), 9), "last": lambda w: F.lag("x").over(w), "next": lambda w: F.lead("id", 2).over(w), "both": lambda w: F.count("x").over(w.rowsBetween(-3, 2)),
            }
            want = df.withColumns({k: f(w) for k, f in columns.items()} | {"n": F.row_number().over(w), "total": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))})
            out = ranges.window_by_range(df, ["key"], order, columns, before=4, after=2, number="n", running={"total": F.col("x")})
            assert out.columns == want.columns and got(out) == got(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_halo_over_parts_of_single_rows(spark):
    """Frames that reach over several whole parts."""
    df = spark.range(40).select("id", F.lit("one").alias("key"))
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranges.window_by_range(df, ["key"], [F.col("id")], {"s": lambda w: F.sum("id").over(w.rowsBetween(-7, 5))}, before=7, after=5)
        assert {r.id: r.s for r in out.collect()} == {k: sum(range(max(k - 7, 0), min(k + 6, 40))) for k in range(40)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_is_spread(spark):
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("key"), F.xxhash64("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    sizes = sorted(r["count"] for r in ranges.dealt(df, ["key"], [F.col("t")]).groupBy("__part").count().collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_operators_give_the_same_beyond_one_task(spark, monkeypatch):
    df = events(spark, 400).filter("x IS NOT NULL")
    order = [F.col("t"), F.col("id")]

    def all_of():
        dwell = state.dwell(df.withColumn("ts", F.timestamp_seconds("t")), "key", "state", "ts", "id")
        return [got(x) for x in (metrics.trend(df, "key", order, "x"), analysis.run_history(df, ["key"], order, "x"), state.with_previous(df, "key", "state", "t", "id"), dwell)]

    plain = all_of()
    monkeypatch.setattr(ranges, "ONE_TASK", 10)
    assert all_of() == plain and len(plain[0]) == df.count()
