"""Recurring patterns: failures that come in the same order again and again within one seller's calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.store import materialise


def frequent_patterns(calls: DataFrame, key: str, sequence: str, order: Column, failures: str, least: int, longest: int = 3) -> DataFrame:
    """(key, pattern, support): ordered lists of failures, each in a later call than the one before, that at least ``least`` sequences of a key hold.

    ``sequence`` names the run of calls that a pattern must lie in (say, a month), ``order`` is a call's time, and ``failures`` its array of failures. Patterns grow by one
    failure a round, only from frequent ones: of a pattern each sequence keeps the earliest place where it is complete, and what comes
    after that is its projection. Work is dealt by key, sequence and last failure, so a key with a third of all calls is split by its sequences;
    counts are combined before they are shuffled. Calls at the same time follow in no order; null failures and null sequences are left out; a null key is a key.
    """
    items = calls.select(F.col(key).alias("k"), F.col(sequence).alias("q"), order.alias("t"), F.explode(F.array_distinct(failures)).alias("f")).filter("f IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL")
    items = items.groupBy("k", "q", "f").agg(F.collect_set("t").alias("ts"))  # when a failure occurs in a sequence
    items = materialise(items.withColumn("ts", F.array_sort("ts")), "pattern-items")
    places = items.select("k", "q", F.array("f").alias("p"), F.col("ts")[0].alias("at"))
    found = None
    for length in range(1, longest + 1):
        support = places.groupBy("k", "p").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
        support = materialise(support, "patterns")
        found = support if found is None else found.unionByName(support)
        if length == longest or support.isEmpty():
            break
        often = support.select(F.col("k").alias("__k"), F.col("p").alias("__p"))
        kept = places.join(often, F.col("k").eqNullSafe(F.col("__k")) & (F.col("p") == F.col("__p")), "left_semi")
        single = found.filter(F.size("p") == 1).select(F.col("k").alias("__k"), F.col("p")[0].alias("__f"))
        nexts = items.join(single, F.col("k").eqNullSafe(F.col("__k")) & (F.col("f") == F.col("__f")), "left_semi")  # what is rare alone is rare in a pattern
        nexts = nexts.select(F.col("k").alias("__k"), F.col("q").alias("__q"), F.col("f"), F.col("ts"))
        grown = kept.join(nexts, F.col("k").eqNullSafe(F.col("__k")) & (F.col("q") == F.col("__q")))
        later = F.filter("ts", lambda t: t > F.col("at"))
        grown = grown.withColumn("next", F.get(later, F.lit(0))).filter("next IS NOT NULL")
        places = materialise(grown.select("k", "q", F.array_append("p", F.col("f")).alias("p"), F.col("next").alias("at")), "pattern-places")
    return found.select(F.col("k").alias(key), F.col("p").alias("pattern"), "support")
