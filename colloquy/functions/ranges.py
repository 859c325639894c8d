"""Windows over one key that spans many tasks.

A plain window sends all rows of a key to one task. Here rows are dealt out by ranges of (key, order), so a key that holds a third of a
table lies in as many parts as its rows need. What a row looks at beyond its part comes along: rows of the neighbouring parts
(the halo, at most ``before`` and ``after`` rows a part), and for numbers and running sums what the parts before add up to. Only keys that begin or end a part can lie in
several, so what is carried is two rows a part at most, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from colloquy.sources.store import materialise

#: Rows of a key up to which one task sorts and reads them.
ONE_TASK = 1 << 20

Columns = dict[str, Callable[[WindowSpec], Column]]


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df``, stored, with the number ``__part`` of its range: ascending along keys and order."""
    return materialise(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id()), "ranges")


def boundary_keys(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that may lie in several parts: the first and last of each, so two a part at most."""
    both = F.struct(*keys)
    ends = parts.groupBy("__part").agg(F.min(both).alias("low"), F.max(both).alias("high"))
    return ends.select(F.explode(F.array("low", "high")).alias("x")).select("x.*").distinct()


def with_small(df: DataFrame, small: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a table of few rows a part by ``names``, where a null equals a null."""
    small = small.withColumnsRenamed({n: f"__small_{n}" for n in names})
    same = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"__small_{n}")) for n in names))
    return df.join(F.broadcast(small), same, how).drop(*(f"__small_{n}" for n in names))


def window_by_range(df: DataFrame, keys: list[str], order: list[Column], columns: Columns | None = None, before: int = 0, after: int = 0, number: str | None = None, running: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with window columns over ``keys`` in ``order``, whose rows of a key are spread over tasks.

    ``columns`` are made on a window whose frames reach at most ``before`` rows back and ``after`` rows ahead; ``number`` is the
    name of a row number from 1; ``running`` are sums from the key's first row to this one. ``order`` must be total. A null key is a key.
    """
    columns, running, names = columns or {}, running or {}, df.columns
    parts = dealt(df, keys, order)
    hot = with_small(parts, boundary_keys(parts, keys), keys, "left_semi")
    sums = {n: f"__sum_{n}" for n in running}
    counts = hot.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__rows"), *(F.sum(c).alias(sums[n]) for n, c in running.items()))
    along = Window.partitionBy(*keys).orderBy("__part")  # a row a part
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    so_far = [F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__ahead"), *(F.sum(s).over(earlier).alias(s) for s in sums.values())]
    carried = materialise(counts.select("__part", *keys, "__rows", F.row_number().over(along).alias("__place"), *so_far), "carried")
    own = Window.partitionBy("__part", *keys).orderBy(*order)
    rows = parts.withColumn("__own", F.lit(1))
    if before or after:
        near = with_small(hot, carried.drop(*sums.values()), ["__part", *keys]).withColumn("__at", F.row_number().over(own))
        targets = carried.select(F.col("__part").alias("__to"), *keys, F.col("__place").alias("__goal"), F.col("__rows").alias("__many"), F.col("__ahead").alias("__start"))
        at = F.col("__ahead") + F.col("__at")  # the row's number in its key
        halo = []
        if before:
            tails = near.filter(F.col("__at") > F.col("__rows") - before).withColumn("__goal", F.explode(F.sequence(F.col("__place") + 1, F.col("__place") + before)))
            halo.append(with_small(tails, targets, [*keys, "__goal"]).filter(F.col("__start") - at < before))
        if after:
            heads = near.filter(F.col("__at") <= after).withColumn("__goal", F.explode(F.sequence(F.col("__place") - after, F.col("__place") - 1)))
            halo.append(with_small(heads, targets, [*keys, "__goal"]).filter(at - F.col("__start") - F.col("__many") <= after))
        for one in halo:
            rows = rows.unionByName(one.select(*names, F.col("__to").alias("__part"), F.lit(0).alias("__own")))
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {n: f(own) for n, f in columns.items()}
    mine = F.col("__own") == 1
    made |= {f"__own_{n}": F.sum(F.when(mine, c)).over(upto) for n, c in running.items()}
    if number:
        made["__number"] = F.sum("__own").over(upto)
    out = rows.withColumns(made).filter(mine)
    if number or running:
        out = with_small(out, carried.select("__part", *keys, "__ahead", *sums.values()), ["__part", *keys], "left")
        if number:
            out = out.withColumn(number, (F.col("__number") + F.coalesce("__ahead", F.lit(0))).cast("int"))
        for n, s in sums.items():
            out = out.withColumn(n, F.coalesce(F.col(f"__own_{n}") + F.col(s), f"__own_{n}", s))
    return out.select(*names, *columns, *([number] if number else []), *running)


def windowed(df: DataFrame, keys: list[str], order: list[Column], columns: Columns | None = None, before: int = 0, after: int = 0, number: str | None = None, one_task: int | None = None) -> DataFrame:
    """The same by a plain window where no key has more rows than one task sorts (``one_task``), by ranges beyond."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > (ONE_TASK if one_task is None else one_task):
        return window_by_range(df, keys, order, columns, before, after, number)
    w = Window.partitionBy(*keys).orderBy(*order)
    made = {n: f(w) for n, f in (columns or {}).items()}
    return df.withColumns(made | ({number: F.row_number().over(w)} if number else {}))
