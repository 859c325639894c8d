"""Revised transcripts against a walk over every tick, and headers by numeric versions."""

import random
import re

from colloquy.operators import ingest
from colloquy.operators.revisions import effective_segments

KINDS = "call_id long, start int, end int, version string, text string"


def number(v):
    return [] if v is None else [int(x) if x.isdigit() else x for x in re.findall(r"\d+|\D+", v)]


def plain(rows):
    rows, out = set(rows), []
    for call in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == call]
        timed = [r for r in own if r[1] is not None and r[2] is not None and r[1] < r[2]]
        latest = max(number(r[3]) for r in own)
        out += [(*r, False) for r in own if r not in timed and number(r[3]) == latest]
        ticks = [t for r in timed for t in r[1:3]]
        at = {}
        for t in range(min(ticks, default=0), max(ticks, default=0)):
            over = [r for r in timed if r[1] <= t < r[2]]
            at[t] = max(over, key=lambda r: (number(r[3]), r[1], r[2])) if over else None
        first = None
        for t in sorted(at):
            if first is None or at[t] != at[t - 1]:
                first = t
            if at[t] and at.get(t + 1) != at[t]:
                r = at[t]
                out.append((call, first, t + 1, r[3], r[4], (first, t + 1) == r[1:3]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_revisions_by_hand(spark):
    rows = [
        (1, 0, 10, "v9", "nine"), (1, 4, 6, "v10", "ten"), (1, 12, 15, "v9", "after a gap"), (1, 15, 20, "v9", "touching"), (1, 0, 10, "v9", "nine"), (1, None, 3, "v10", "no start"), (1, 3, 3, "v9", "empty"), (1, 2, None, "v9", "old"),
        (2, -7, 5, None, "no version"), (2, 3, 8, "v1", "x"), (None, 1, 2, "v1", "no call"), (3, None, None, None, None), (4, 5, 1, "v2", "backwards"), (4, 0, 9, "v1", "whole"),
    ]
    want = [
        (1, 0, 4, "v9", "nine", False), (1, 4, 6, "v10", "ten", True), (1, 6, 10, "v9", "nine", False), (1, 12, 15, "v9", "after a gap", True), (1, 15, 20, "v9", "touching", True), (1, None, 3, "v10", "no start", False),
        (2, -7, 3, None, "no version", False), (2, 3, 8, "v1", "x", True), (None, 1, 2, "v1", "no call", True), (3, None, None, None, None, False), (4, 5, 1, "v2", "backwards", False), (4, 0, 9, "v1", "whole", True),
    ]
    assert plain(rows) == sorted(want, key=str)
    assert got(effective_segments(spark.createDataFrame(rows, KINDS))) == sorted(want, key=str)
    assert effective_segments(spark.createDataFrame([], KINDS)).count() == 0


def test_revisions_at_random(spark):
    draw, rows = random.Random(7), []
    for k in range(300):
        s = draw.randrange(-40, 300)
        rows.append((draw.choice([1, 1, 1, 2, 3]), s, s + draw.randrange(1, draw.choice([4, 60, 200])), f"v{draw.choice([1, 2, 9, 10, 11, 100])}", f"t{k}"))
    rows = list({r[:4]: r for r in rows}.values())  # ties in all but the text aside
    assert got(effective_segments(spark.createDataFrame(rows, KINDS).repartition(3))) == plain(rows)


def test_times_of_other_kinds(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.5, "1", "a"), (1, 1.25, 2.0, "2", "b")], "call_id long, start double, end double, version string, text string")
    want = [(1, 0.0, 1.25, "1", "a", False), (1, 1.25, 2.0, "2", "b", True), (1, 2.0, 2.5, "1", "a", False)]
    assert got(effective_segments(rows)) == want
    stamps = rows.selectExpr("call_id", "timestamp_millis(cast(start * 1000 AS bigint)) AS start", "timestamp_millis(cast(end * 1000 AS bigint)) AS end", "version", "text")
    assert sorted((r.start.timestamp(), r.end.timestamp(), r.text) for r in effective_segments(stamps).collect()) == [(s, e, t) for _, s, e, _, t, _ in want]


def test_headers_take_the_last_and_compare_versions_as_numbers(spark):
    rows = [(1, 0, 5, "v9", "pt", "drive"), (1, 0, 5, "v10", None, "drive"), (2, 9, 12, "v9", "en", "a"), (2, 0, 5, "v10", "pt", "b"), (3, None, None, None, None, None)]
    out = ingest.transcript_headers(spark.createDataFrame(rows, "call_id long, start int, end int, version string, language string, origin string"))
    assert got(out.select("call_id", "version", "language", "origin", "mixed")) == [(1, "v10", "pt", "drive", True), (2, "v9", "en", "a", True), (3, None, None, None, False)]
