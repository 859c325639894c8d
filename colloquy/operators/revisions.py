"""Transcripts in several revisions: what of each segment stands once later revisions have covered earlier ones.

At every moment the segment of the latest revision stands (versions by number: v10 after v9); of one revision the one that starts
last, then ends last. Finding the latest among all segments over a moment would pair every moment of a call with all its segments; instead a span
is cut into blocks whose length is a power of two and whose start is a multiple of it, at most two of each length, and a moment
lies in one block of each length. So moments meet segments by equal keys (call, length, block), each with its latest segment
alone, and a call that holds a third of all rows spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.keys import natural_order
from colloquy.functions.ranges import windowed
from colloquy.sources.store import materialise


def ticks(time: str, kind: str) -> Column:
    """A time as a whole number: microseconds of timestamps and of fractions of seconds, whole numbers as they are."""
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(time).cast("timestamp"))
    return F.col(time).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.round(F.col(time) * 1000000).cast("long")


def blocks_of(s: Column, e: Column) -> Column:
    """(k, b) of the blocks of a span [s, e): of each length 2**k the one at each end that no longer one holds."""
    made = []
    for k in range(63):
        low, high = -F.shiftright(-s, k), F.shiftright(e, k)  # the first and the end of the whole blocks of this length
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        made += [F.when((low < high) & odd(x), F.struct(F.lit(k).alias("k"), (x - back).alias("b"))) for x, back in ((low, 0), (high, 1))]
    return F.array_compact(F.array(*made))


def effective_segments(segments: DataFrame, call: str = "call_id", start: str = "start", end: str = "end", version: str = "version") -> DataFrame:
    """The pieces of ``segments`` that stand, each with its segment's columns, the piece's own ``start`` and ``end``, and ``whole``: whether all of it stands.

    A segment that is covered in the middle has two pieces; touching pieces of one segment are one; where nothing was said is a gap. Equal rows
    count once. A segment without a time, or that does not end after its start, covers nothing and stands (as it is, not ``whole``) if no other
    revision of its call is later. A null version is before all others; a null call is a call.
    """
    kinds = dict(segments.dtypes)
    own = F.sha2(F.to_json(F.struct(*segments.columns), {"ignoreNullFields": "false"}), 256)
    order = F.coalesce(natural_order(F.col(version)), F.array().cast("array<string>"))
    rows = materialise(segments.distinct().select("*", F.col(call).alias("c"), ticks(start, kinds[start]).alias("s"), ticks(end, kinds[end]).alias("e"), order.alias("v"), own.alias("seg")), "revisions")
    timed = F.coalesce(F.col("s") < F.col("e"), F.lit(False))
    spans = rows.filter(timed).select("c", "s", "e", "v", "seg")
    blocks = spans.select("c", F.struct("v", "s", "e", "seg").alias("x"), F.explode(blocks_of(F.col("s"), F.col("e"))).alias("y"))
    blocks = materialise(blocks.groupBy("c", F.col("y.k").alias("k"), F.col("y.b").alias("b")).agg(F.max("x").alias("x")), "blocks")
    lengths = sorted(r.k for r in blocks.select("k").distinct().collect())  # 63 at most
    moments = spans.select("c", F.explode(F.array("s", "e")).alias("at")).distinct()
    inside = moments.select("c", "at", F.explode(F.array(*(F.lit(k) for k in lengths)) if lengths else F.array().cast("array<int>")).alias("k")).withColumn("b", F.expr("at >> k"))
    block = blocks.select(F.col("c").alias("__c"), F.col("k").alias("__k"), F.col("b").alias("__b"), "x")
    met = inside.join(block, F.col("c").eqNullSafe(F.col("__c")) & (F.col("k") == F.col("__k")) & (F.col("b") == F.col("__b")), "left")
    stands = materialise(met.groupBy("c", "at").agg(F.max("x").alias("x")).select("c", "at", "x.seg"), "moments")
    marked = windowed(stands, ["c"], [F.col("at")], {"before": lambda w: F.lag("seg").over(w)}, before=1)
    turns = marked.filter(~F.col("seg").eqNullSafe(F.col("before"))).drop("before")
    pieces = windowed(turns, ["c"], [F.col("at")], {"until": lambda w: F.lead("at").over(w)}, after=1).filter("seg IS NOT NULL")
    pieces = pieces.select(F.col("c").alias("__c"), F.col("seg").alias("__seg"), "at", "until")
    back = {n: F.when(whole, F.col(n)).otherwise(_time(tick, kinds[n])) for n, tick, whole in ((start, "at", F.col("at") == F.col("s")), (end, "until", F.col("until") == F.col("e")))}
    shown = rows.join(pieces, (F.col("seg") == F.col("__seg")) & F.col("c").eqNullSafe(F.col("__c"))).withColumn("whole", (F.col("at") == F.col("s")) & (F.col("until") == F.col("e"))).withColumns(back)
    latest = rows.groupBy(F.col("c").alias("__c")).agg(F.max("v").alias("__v"))
    untimed = rows.filter(~timed).join(latest, F.col("c").eqNullSafe(F.col("__c")) & (F.col("v") == F.col("__v"))).withColumn("whole", F.lit(False))
    names = [*segments.columns, "whole"]
    return shown.select(*names).unionByName(untimed.select(*names))


def _time(tick: str, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return F.timestamp_micros(F.col(tick)).cast(kind)
    return F.col(tick).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else (F.col(tick) / 1000000).cast(kind)
