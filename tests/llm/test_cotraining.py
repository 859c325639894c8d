"""Co-training: what the views teach each other, against plain counts, and the score of rows that were not fitted."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import cotraining as C

SF = "/root/testdata/sf0.1"


def auc(good, bad):
    both = np.concatenate([good, bad])
    rank = np.unique(both, return_inverse=True)[1]
    counts = np.bincount(rank)
    mean = np.cumsum(counts) - (counts - 1) / 2
    return (mean[rank[: len(good)]].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))


def test_both_views_teach_both_classes_and_nothing_is_spoiled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.rows_of(docs, "doc_id", "text", ("source", "lang"), "n_chars")
    marks = labels.groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 1).cast("int").alias("good"))
    fold = F.crc32(F.col("__id").cast("string").cast("binary")) % 5
    others = {r["__id"]: r.good for r in marks.filter(fold >= 2).collect()}
    found = {}
    for rounds in (0, C.ROUNDS):
        model = C.fit(rows, marks.filter(fold < 2), rounds)
        got = {r["__id"]: (r.text, r.page) for r in C.raw_scores(rows, model).collect() if r["__id"] in others}
        odds = {i: sum(s * a + b for s, (a, b) in zip(x, model.odds, strict=True)) for i, x in got.items()}
        found[rounds] = [auc(np.array([f[i] for i, g in others.items() if g]), np.array([f[i] for i, g in others.items() if not g])) for f in (odds, {i: x[0] for i, x in got.items()}, {i: x[1] for i, x in got.items()})]
    assert all(min(view) > 20 for one in model.taught for view in one) and len(model.taught) >= 1  # good and bad ones, both ways
    assert found[C.ROUNDS][2] > found[0][2] + 0.01  # the page view has learned from the text view
    assert found[C.ROUNDS][1] >= found[0][1] - 0.001 and found[C.ROUNDS][0] > found[0][0] - 0.01 and found[C.ROUNDS][0] > 0.9


def test_counts_equal_plain_ones(spark):
    """The counts of a round, and what was taught, from the definition; names that clash, ties, long and empty texts."""
    rng, long = np.random.default_rng(3), "ab c" * 20_000
    rows = [(k, (long if k == 7 else "" if k % 11 == 0 else None if k % 13 == 0 else " ".join(rng.choice(["good", "fine", "bad", "poor"], 9))), rng.choice(["s1", "s2", None]), "en", 5, None if k > 60 else int(k % 3 > 0)) for k in range(200)] + [(201, "good fine", "s1", "en", 5, 1)] * 2
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, body string, source string, lang string, n_chars long, __good int, text string, page string").repartition(3)
    known = C.rows_of(table, "doc_id", "body", ("source", "lang"), "n_chars").join(table.select(F.col("doc_id").alias("__id"), "__good").distinct(), "__id")
    model = C.Model(rng.normal(0, 1, C.TRIGRAMS), rng.normal(0, 1, C.PAGE))
    model.sure = model.odds = ((2.0, 0.1), (1.0, -0.2))
    C.set_limits(model, known, 0.6)
    got, taught = C.counted(known, model)
    want, said_of, plain = np.zeros_like(got), [[0, 0], [0, 0]], []
    for r in known.collect():
        raw = (r["__text"] or "").encode()
        h, ends = C.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        scores = (model.text[h].mean() if len(h) else 0.0, model.page[r["__page"]].sum())
        plain.append((r, h, [s * a + b for s, (a, b) in zip(scores, model.sure, strict=True)]))
    bins = [[int(min(max(np.floor((o[k] + 8) * 100), 0), 1599)) for r, _, o in plain if r["__good"] is None] for k in (0, 1)]
    for k in (0, 1):
        n = C.TAUGHT * len(bins[k])
        assert model.good_from[k] == max(b for b in range(1600) if sum(x >= b for x in bins[k]) >= n * 0.6) and model.bad_to[k] == min(b for b in range(1600) if sum(x <= b for x in bins[k]) >= n * (1 - 0.6))
    for r, h, odds in plain:
        said = []
        for k, o in enumerate(odds):
            b = min(max(int(np.floor((o + 8) * 100)), 0), 1599)
            label = 1 if b >= model.good_from[k] and o > 0 else 0 if b <= model.bad_to[k] and o < 0 else None
            weight = int(np.rint(C.LEVELS * abs(2 / (1 + np.exp(-o)) - 1)))
            said.append((label, weight) if label is not None and weight else (None, 0))
            if said[-1][0] is not None and r["__good"] is None:
                said_of[k][1 - label] += 1
        learns = [(r["__good"], C.LEVELS)] * 2 if r["__good"] is not None else said[::-1]
        for k, (label, weight) in enumerate(learns):
            if label is None:
                continue
            want[label, k - 2] += weight
            for f in r["__page"] if k else h:
                want[label, C.TRIGRAMS + f if k else f] += weight if k else int(np.rint(C.UNITS // C.LEVELS * weight / len(h)))
    assert (got == want).all() and [list(t) for t in taught] == said_of and min(min(t) for t in said_of) > 0
