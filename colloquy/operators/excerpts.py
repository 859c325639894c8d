"""Evidence by its excerpt: the segment that holds what an excerpt says, also where its time is absent or wrong and a few letters differ.

An excerpt of m characters may differ from a stretch of a segment by k = m // ``CHARS_AN_ERROR`` edits. Of its disjoint grams of
``GRAM`` characters k edits leave all but k whole, so every such segment holds one of any k + 1 of them: those that are rarest in the call are looked up
in an index of the segments' grams. What they share gives the diagonals on which the excerpt may lie, and the edit distance is
found in the band of k about these alone. No excerpt meets a segment that it shares no rare gram with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.store import materialise

GRAM, CHARS_AN_ERROR = 4, 8


def edits(excerpt: str, text: str) -> tuple[int, int]:
    """(fewest edits between the excerpt and any stretch of the text, where the first such stretch ends), a column of the table as the bits of two numbers."""
    m = len(excerpt)
    if not m:
        return 0, 0
    places: dict[str, int] = {}
    for i, c in enumerate(excerpt):
        places[c] = places.get(c, 0) | (1 << i)
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = whole, 0, m  # where a cell is one more, or one less, than the cell above it
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(diagonal | up), up & diagonal
        if more & top:
            now += 1
        elif less & top:
            now -= 1
        if now < best:
            best, end = now, j
        more, less = more << 1, less << 1  # row 0 is 0 throughout: a stretch begins anywhere
        up, down = (less | ~((eq | down) | more)) & whole, more & (eq | down) & whole
    return best, end


def folded(text: Column) -> Column:
    """What is compared: lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def grams(text: Column, size: Column) -> Column:
    """The grams of a text with their places from 0, none where it is shorter."""
    last = F.char_length(text) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.substr(text, i + 1, size).alias("gram"))))


def locate_excerpts(evidence: DataFrame, segments: DataFrame, id_col: str = "evidence_id", call: str = "call_id", excerpt: str = "excerpt", text: str = "text", order: str = "turn") -> DataFrame:
    """Each row of ``evidence`` with ``segment`` (the ``order`` of the segment that holds its excerpt with the fewest edits, of equal ones the first), and ``edits``.

    Both are null where no segment of the call is near enough, or the excerpt is empty. Letters' case and white space don't count. Ids must be
    unique; a null call meets no segment.
    """
    said = folded(F.col(excerpt))
    asked = evidence.select(F.col(id_col).alias("id"), F.col(call).alias("c"), said.alias("said")).filter("c IS NOT NULL AND said <> ''")
    asked = asked.withColumn("size", F.least(F.lit(GRAM), F.char_length("said"))).withColumn("k", F.floor(F.char_length("said") / CHARS_AN_ERROR).cast("int"))
    asked = materialise(asked, "excerpts")
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # GRAM at most
    own = segments.join(asked.select(F.col("c").alias(call)).distinct(), call, "left_semi").select(F.col(call).alias("c"), F.col(order).alias("o"), folded(F.col(text)).alias("t"))
    own = materialise(own, "excerpt-segments")
    listed = [own.select("c", "o", F.xxhash64("t").alias("h"), F.inline(grams(F.col("t"), F.lit(n)))) for n in sizes]
    probes = asked.select("id", "c", "k", "size", F.inline(grams(F.col("said"), F.col("size")))).filter(F.col("at") % F.col("size") == 0)
    probes = materialise(probes, "probes")
    if not listed:
        return evidence.withColumns({"segment": F.lit(None).cast(segments.schema[order].dataType), "edits": F.lit(None).cast("int")})
    index = listed[0]
    for more in listed[1:]:
        index = index.unionByName(more)
    index = materialise(index.withColumnRenamed("at", "place").join(probes.select("c", "gram").distinct(), ["c", "gram"], "left_semi"), "gram-index")
    counts = index.groupBy("c", "gram").count()
    rare = Window.partitionBy("id").orderBy(F.coalesce("count", F.lit(0)), "at")  # a quarter of an excerpt's characters
    chosen = probes.join(counts, ["c", "gram"], "left").withColumn("n", F.row_number().over(rare)).filter(F.col("n") <= F.col("k") + 1)
    shared = chosen.select("id", "c", "gram", "at").join(index, ["c", "gram"])
    bands = shared.groupBy("id", "c", "o", "h").agg(F.collect_set(F.col("place") - F.col("at")).alias("bands"))  # a text's characters at most
    pairs = bands.join(asked.select("id", "said", "k"), "id").join(own.withColumn("h", F.xxhash64("t")).dropDuplicates(["c", "o", "h"]), ["c", "o", "h"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for said, t, k, bands in zip(frame["said"], frame["t"], frame["k"], frame["bands"], strict=True):
                best, merged = len(said), []
                for low in sorted(bands):
                    first, last = low - k, low + len(said) + k
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = last
                    else:
                        merged.append([first, last])
                for first, last in merged:
                    best = min(best, edits(said, t[max(first, 0) : max(last, 0)])[0])
                found.append(best)
            frame["edits"] = found
            yield frame[frame["edits"] <= frame["k"]][["id", "o", "edits"]]

    kinds = f"id {evidence.schema[id_col].dataType.simpleString()}, o {segments.schema[order].dataType.simpleString()}, edits int"
    near = pairs.select("id", "o", "said", "t", "k", "bands").mapInPandas(compare, kinds)
    best = near.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct("edits", "o")).alias("x")).select("__id", F.col("x.o").alias("segment"), F.col("x.edits").alias("edits"))
    return evidence.join(best, F.col(id_col) == F.col("__id"), "left").drop("__id")


def located_gaps(located: DataFrame) -> DataFrame:
    """Evidence whose excerpt no segment of its call holds."""
    return located.filter("segment IS NULL")
