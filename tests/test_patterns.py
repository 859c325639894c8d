"""Recurring patterns against an enumeration of all lists of failures."""

import random
from itertools import product

from pyspark.sql import functions as F

from colloquy.operators.patterns import frequent_patterns

KINDS = "seller string, month string, day int, failures array<string>"


def holds(calls, pattern):
    at = -1
    for f in pattern:
        days = [d for d, own in calls if d > at and f in own]
        if not days:
            return False
        at = min(days)
    return True


def plain(rows, least, longest):
    runs = {}
    for seller, month, day, own in rows:
        if month is not None and day is not None:
            runs.setdefault(seller, {}).setdefault(month, []).append((day, [f for f in own or [] if f is not None]))
    out = []
    for seller, months in runs.items():
        items = sorted({f for calls in months.values() for _, own in calls for f in own})
        for n in range(1, longest + 1):
            for p in product(items, repeat=n):
                if (support := sum(holds(calls, p) for calls in months.values())) >= least:
                    out.append((seller, list(p), support))
    return sorted(out, key=str)


def test_patterns_equal_an_enumeration(spark):
    draw, rows = random.Random(6), []
    for k in range(400):
        rows.append((draw.choice(["hot", "hot", "a", "b", None]), f"m{draw.randrange(8)}", draw.randrange(12), draw.sample(["A", "B", "C", "D"], draw.randrange(3)) + draw.choice([[], [None], ["A"]])))
    rows += [("a", None, 1, ["A"]), ("a", "m1", None, ["A"]), ("c", "m1", 1, None), ("c", "m1", 1, [])]
    table = spark.createDataFrame(rows, KINDS).repartition(3)
    for least, longest in ((4, 3), (7, 2), (1, 1), (99, 3)):
        out = frequent_patterns(table, "seller", "month", F.col("day"), "failures", least, longest)
        assert sorted(((r.seller, r.pattern, r.support) for r in out.collect()), key=str) == plain(rows, least, longest)
    assert frequent_patterns(table.limit(0), "seller", "month", F.col("day"), "failures", 1).count() == 0
