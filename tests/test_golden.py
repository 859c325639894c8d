"""Golden sets that meet every margin, and agreement against plain resampling."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import golden as G


def plain_cover(rows, n):
    """rows: (id, [(margin, value)])."""
    key = lambda i: (hashlib.sha256(f"golden{i}".encode()).hexdigest(), i)
    of = {}
    for i, own in rows:
        for m in own:
            of.setdefault(m, []).append(i)
    need = {m: min(n, len(ids)) for m, ids in of.items()}
    pool = {i for ids in of.values() for i in sorted(ids, key=key)[:n]}
    left, out, gain, number = {i: own for i, own in rows if i in pool}, [], 5, 0
    while gain:
        able = {i: [m for m in own if need[m] > 0] for i, own in left.items()}
        able = {i: own for i, own in able.items() if len(own) >= gain}
        rank = {}
        for i in sorted(able, key=key):
            for m in able[i]:
                rank.setdefault(m, []).append(i)
        now = [i for i, own in able.items() if all(rank[m].index(i) < need[m] for m in own)]
        if not now:
            gain -= 1
            continue
        out += [(i, len(able[i]), number) for i in now]
        number += 1
        for i in now:
            for m in left.pop(i):
                need[m] = max(need[m] - 1, 0)
    return sorted(out)


def test_every_margin_is_met(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice("abcdefgh"), draw.choice(["won", "won", "won", "lost"]), draw.choice(["good", "bad", None]), draw.randrange(12), draw.random() < 0.1) for k in range(300)] + [(300, "rare", "lost", None, 99, None), (None, "no key", "won", "good", 1, True)]
    calls = spark.createDataFrame(rows, "call_id long, seller string, status string, quality string, product int, ambiguous boolean")
    strata = {c: F.col(c) for c in calls.columns[1:]}
    out = G.golden_cover(calls, "call_id", strata, 4)
    own = [(r[0], [(c, str(v).lower() if isinstance(v, bool) else str(v)) for c, v in zip(calls.columns[1:], r[1:], strict=True) if v is not None]) for r in rows if r[0] is not None]
    want = plain_cover(own, 4)
    assert sorted((r.id, r.gain, r.round) for r in out.collect()) == want and len(want) < 80
    assert all(r.met for r in G.margins_met(calls, "call_id", strata, 4, out).collect())
    assert not all(r.met for r in G.margins_met(calls, "call_id", strata, 4, out.filter("round > 0")).collect())
    assert G.golden_cover(calls.limit(0), "call_id", strata, 4).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_calls_are_shuffled_as_few_bytes(spark):
    calls = spark.range(40_000).selectExpr("id AS call_id", "id % 200 AS seller", "id % 3 AS status", "id % 5 AS quality", "id % 7919 AS product", "id % 2 AS clarity")
    strata = {c: F.col(c) for c in calls.columns[1:]}
    before = shuffled(spark)
    out = G.golden_cover(calls, "call_id", strata, 3)
    assert all(r.met for r in G.margins_met(calls, "call_id", strata, 3, out).collect())
    assert shuffled(spark) - before < 40_000 * 500


def test_a_call_of_several_rows_counts_once_a_value(spark):
    rows = [(k % 40, "abc"[k % 3], k % 7) for k in range(100)]
    calls = spark.createDataFrame(rows, "call_id long, seller string, product int").repartition(3)
    strata = {c: F.col(c) for c in calls.columns[1:]}
    own = [(k, sorted({(c, str(v)) for r in rows if r[0] == k for c, v in zip(calls.columns[1:], r[1:], strict=True)})) for k in range(40)]
    out, of = G.golden_cover(calls, "call_id", strata, 2), {}
    for k, values in own:
        for v in values:
            of[v] = of.get(v, 0) + 1
    met = {(r.margin, r.value): (r.available, r.wanted, r.met) for r in G.margins_met(calls, "call_id", strata, 2, out).collect()}
    assert met == {v: (c, min(c, 2), True) for v, c in of.items()} and out.count() == out.select("id").distinct().count()


def plain_alpha(units):
    """By all pairs of scores, units given as (weight, scores)."""
    units = [(w, x) for w, x in units if len(x) >= 2 and w]
    flat = np.array([v for w, x in units for v in x * w])
    n = len(flat)
    if n < 2 or flat.min() == flat.max():
        return None
    inner = sum(w * sum((a - b) ** 2 for a in x for b in x) / (len(x) - 1) for w, x in units) / n
    return 1 - inner / (sum(((a - flat) ** 2).sum() for a in flat) / (n * (n - 1)))


def plain_draw(unit, r):
    u = int(hashlib.md5(f"agreement|{r}|{unit}".encode()).hexdigest()[:8], 16)
    return sum(u >= limit for limit in G.POISSON)


def test_agreement_equals_plain_resampling(spark):
    draw, rows = random.Random(5), []
    for model in ("m1", "m2", "flat"):
        for u in range(60):
            true = draw.randrange(10)
            rows += [(model, u, f"r{k}", None if draw.random() < 0.2 else 5 if model == "flat" else true + draw.choice([-1, 0, 0, 1]) * (2 if model == "m2" else 1)) for k in range(draw.randrange(1, 5))]
    rows.append(("alone", 1, "r", 3))
    out = {r.model: r for r in G.agreement_interval(spark.createDataFrame(rows, "model string, unit int, rater string, score int"), ["unit"], "score", ["model"], replicates=60).collect()}
    assert set(out) == {"m1", "m2", "flat"} and out["flat"].alpha is None
    for model in ("m1", "m2"):
        units = {}
        for m, u, _, s in rows:
            if m == model and s is not None:
                units.setdefault(u, []).append(s)
        assert abs(out[model].alpha - plain_alpha([(1, x) for x in units.values()])) < 1e-9
        many = [plain_alpha([(plain_draw(u, r), x) for u, x in units.items()]) for r in range(1, 61)]
        assert np.allclose((out[model].low, out[model].high), np.percentile(many, [2.5, 97.5])) and out[model].low < out[model].alpha < out[model].high
        assert out[model].units == sum(len(x) > 1 for x in units.values()) and out[model].ratings == sum(len(x) for x in units.values() if len(x) > 1)
    assert out["m1"].alpha > out["m2"].alpha


def test_draws_are_poisson(spark):
    many = spark.range(100_000).select(G.draws(F.col("id").cast("string"), F.lit(1), "x").alias("w")).groupBy("w").count().collect()
    shares = {r.w: r["count"] / 100_000 for r in many}
    assert all(abs(shares[k] - p) < 0.006 for k, p in enumerate([0.3679, 0.3679, 0.1839, 0.0613]))


def test_a_digest_is_made_once_a_draw(spark):
    ratings = spark.range(20).selectExpr("id % 5 AS unit", "id % 3 AS score", "'m' AS model")
    plan = G.agreement_interval(ratings, ["unit"], "score", ["model"], replicates=3)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("md5(") == 1
    edges = [(f"{x:08x}{end}", k + more) for k, limit in enumerate(G.POISSON) for x, end, more in ((limit - 1, "f" * 24, 0), (limit, "0" * 24, 1))]
    rows = spark.createDataFrame(edges, "digest string, want int").withColumn("got", G.times(F.col("digest"))).collect()
    assert all(r.got == r.want for r in rows) and len(rows) == 18
