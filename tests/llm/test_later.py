"""Operators 11 to 13: against plain versions, SQL and planted cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import centroid_clusters as K
from colloquy.llm import fill_middle as M
from colloquy.llm import registry
from colloquy.llm import toxicity as X

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, row string, n long, form string, output string, h1 int, kind int, score double, y int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "f", "o", 1, 1, 0.5, 1, 1) for i, t in rows], NAMES).repartition(3)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(query, *tables, sf=SF):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(query)


# 11
def plain_fill(key, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = [
    None, "", "\n", "\n\n\n", "a", "a\n", "\na", "one\ntwo\nthree", "one\r\ntwo\r\n\x0bthree four\x85", "é\n\U0001f600\nΩ", "a <P> b\nc", "x<S>", "<M>\n", "<\nP>", "< P>\n<S\n>", "ends with <\nS> and <\n", "$1 \\1 $& {2}+\n(?s).*\n\\E\\Q",
    "\n" * 30_000, "x" * 300_000, "line\n" * 20_000 + "last", "\x00\n\x00",
]


def test_fill_middle_equals_the_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "a\nb\nc\nd") for k in range(60)] + [(None, "a\nb\nc"), (7, "again\nhere"), (7, "again\nhere")]
    made = M.with_parts(M.fill_middle(frame(spark, rows)))
    got = sorted(((r.row.doc_id, r.row.text, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in made.collect()), key=str)
    assert got == sorted(((i, t, *plain_fill(i, t)) for i, t in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert all(r.restored == (r.row.text or "") for r in made.select("row", "restored").collect())
    assert made.select("row.*").columns == frame(spark, []).columns
    assert M.fill_middle(frame(spark, [])).count() == 0


def test_fill_middle_of_bytes_that_are_no_text(spark):
    odd = spark.createDataFrame([(1, bytearray(b"ab \xff\n\xfe cd"))], "doc_id long, b binary").select("doc_id", F.expr("cast(b AS string)").alias("text"))
    [r] = M.with_parts(M.fill_middle(odd)).select("n", "output", "restored").collect()
    assert r.n == 2 and r.restored == "ab �\n� cd" and r.output == plain_fill(1, r.restored)[4]


def test_fill_middle_at_other_rates_and_units(spark):
    rows = [(k, "one two  three\nfour ") for k in range(200)]
    words = M.with_parts(M.fill_middle(frame(spark, rows), unit=r"(?:\S++\s*+|\s++)", percent=60, spm_percent=0))
    got = words.select("n", "form", "restored", "prefix").collect()
    assert {r.form for r in got} == {"plain", "psm"} and {r.n for r in got} == {4} and {r.restored for r in got} == {rows[0][1]}
    assert 80 < sum(r.form == "psm" for r in got) < 160 and {"one ", "one two  "} <= {r.prefix for r in got}


def test_fill_middle_matches_sql_and_stays_native(spark):
    out = registry.QUERIES["op11_fill_middle"](spark, SF)
    want = sql(registry.ORACLES["op11_fill_middle"], "documents")
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in out.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 12
def allowed(n):
    return 0 if n < 4 else 1 if n < 8 else 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def spelled(draw, word):
    w = list(word)
    for _ in range(draw.randrange(4)):
        k = draw.randrange(len(w) + 1)
        w[k : k + draw.randrange(2)] = draw.choice([[], ["x"], [draw.choice("aeé0")]])
    return "".join(w) or "q"


def test_automata_equal_edit_distances():
    draw = random.Random(1)
    terms = ["idiot", "idiots", "moron", "pathetic", "path", "worthless", "scum", "achlichbar", "achlichkeit", "réeuxment", "ass", "zz"]
    words = [draw.choice(["and", "apathetic", "idiom", "scumm", "as", "pathological"]) if draw.random() < 0.2 else spelled(draw, draw.choice(terms)) for _ in range(1500)]
    text = " ".join(words).encode()
    read = X.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert read.strings(np.arange(len(read.starts))) == words
    for small in (False, True):
        lexicon = X.Automaton(terms)
        for _ in range(2 if small else 1):  # again with the states that are there
            term, errors = lexicon.match(read)
        for w, t, e in zip(words, term.tolist(), errors.tolist(), strict=True):
            near = min(((d, k) for k, x in enumerate(terms) if (d := distance(w, x)) <= allowed(len(x))), default=(-1, -1))
            assert (e, t) == near, (w, e, t, near)


def test_words_and_contexts():
    texts = ['He said "idiot" to them', "you idiot, you", 'an "idiot\nidiot" on two lines', "the word idiot is a slur", "“some idiot” idiot", "*idiot* 's idi0t's x", "", '"' + "far " * 30 + "idiot " + "far " * 30 + '"', "idiot"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    words = X.words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    assert np.diff(words.first).tolist() == [5, 3, 6, 6, 3, 4, 0, 61, 1]
    scorer = X.Scorer(["idiot"], np.array([3.0]))
    x = np.expm1(scorer.features(words))
    used, mentioned = x[:, 0], x[:, 7]
    assert [(bool(a > 0), bool(b > 0)) for a, b in zip(used, mentioned, strict=True)] == [(False, True), (True, False), (True, False), (False, True), (True, True), (True, False), (False, False), (True, False), (True, False)]
    alone = np.concatenate([X.Scorer(["idiot"], np.array([3.0])).features(X.words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in raw])
    assert np.allclose(np.log1p(x), alone)  # a text's score does not depend on its neighbours


def test_toxic_documents_that_are_held_out_are_found(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    out = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values())
    held = [(r.toxic, out[r.doc_id].predicted) for r in labels.collect() if out[r.doc_id].held_out]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.005 * len(clean)
    share = sum(r.score for r in out.values() if r.held_out) / sum(r.held_out for r in out.values())
    assert abs(share - len(toxic) / len(held)) < 0.02  # scores are probabilities
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in X.toxicity(docs, flipped).collect()} == {i: r.score for i, r in out.items()}  # held-out labels are not read


def test_misspelled_and_quoted_terms(spark):
    insults = ["idiot", "moron", "stupid", "pathetic"]
    draw, filler = random.Random(3), [f"plain{k}" for k in range(50)]
    text = lambda own: " ".join(draw.sample(filler, 12) + own + draw.sample(filler, 6))
    rows = [(k, text(draw.sample(insults, 2) if k % 3 == 0 else [])) for k in range(600)]
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    probes = [(1000, text(["idiot", "moron"])), (1001, text(["idi0t", "morron", "stupd"])), (1002, 'they said "idiot" and "moron" in the report'), (1003, text([])), (1004, None), (1005, ""), (1006, " ".join(filler * 3000) + " idiot moron")]
    docs = frame(spark, rows + probes + [(1003, "you idiot moron stupid"), (None, "idiot moron"), (0, rows[0][1])])
    out = X.toxicity(docs, marks.unionByName(spark.createDataFrame([(None, 1), (5, None), (-4, 1), (7, 9)], "doc_id long, toxic int"))).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.score, r.predicted))
    assert len(out) == 610 and len(by[0]) == 2 and by[0][0] == by[0][1]
    assert [by[i][0][1] for i in (1000, 1001, 1002, 1004, 1005)] == [1, 1, 0, 0, 0] and sorted(p for _, p in by[1003]) == [0, 1] and by[None][0][1] == 1
    assert by[1002][0][0] < 0.5 and by[1004][0] == by[1005][0]


def test_a_worker_does_not_take_another_model(spark):
    """Two corpora with other terms, one after the other in the same workers."""
    for own, other in (("slur", "daft"), ("daft", "slur"), ("slur", "daft")):
        rows = [(k, f"plain{k} words {own if k % 2 else 'nice'} here {other if k % 3 == 0 else 'too'}") for k in range(240)]
        marks = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
        assert {(r.doc_id % 2, r.predicted) for r in X.toxicity(frame(spark, rows), marks).collect()} == {(0, 0), (1, 1)}


def test_toxicity_with_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b"), (2, None), (None, "c")])
    marks = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in X.toxicity(docs, marks()).collect()} == {(0.5, 0)}
    assert {r.score for r in X.toxicity(docs, marks((1, 1), (2, 1))).collect()} <= {0.5, 0.75, 2.5 / 3}
    assert X.toxicity(frame(spark, []), marks((1, 1))).count() == 0


# 13
def plain_clusters(rows, k, rounds, dims=64, scale=256.0, seed=2):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((key(i), np.array(v, "<i4").tobytes()), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, one, strict=True)), n) for n, one in enumerate(c))
    for r in range(rounds + 1):
        own = [near(v) for _, v in kept]
        if r < rounds:
            groups = {}
            for (_, v), (_, n) in zip(kept, own, strict=True):
                groups.setdefault(n, []).append(v)
            c = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else one for n, one in enumerate(c)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, own, strict=True)), key=str), c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, cluster string").repartition(3)


def test_clusters_equal_the_plain_version(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (6, 64))
    rows = [(k, [float(x) for x in np.float32(middles[k % 6] + rng.normal(0, 0.15, 64))]) for k in range(400)]
    one = rows[0][1]
    rows += [(1000 + k, one) for k in range(150)] + [(3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1])]  # copies, ids and a null id
    rows += [(2000, None), (2001, []), (2002, one[:63]), (2003, [*one, 1.0]), (2004, [None, *one[1:]]), (2005, [float("nan"), *one[1:]]), (2006, [float("inf"), *one[1:]]), (2007, [-1000.7, *one[1:]])]
    for k, rounds in ((1, 2), (9, 5), (40, 5)):
        out, fit = K.cluster_vectors(vectors(spark, rows), k=k, rounds=rounds)
        want, c = plain_clusters(rows, k, rounds)
        assert sorted((tuple(r) for r in out.collect()), key=str) == want and fit.centroids == c
        assert fit.scanned[0] == len(want) and sum(fit.inertia.values()) == sum(d for _, _, d in want)
        if k == 9:
            assert min(fit.scanned[2:]) < 0.7 * len(want)  # bounds spare scans
    few, fit = K.cluster_vectors(vectors(spark, rows[:3]), k=40)
    assert few.count() == 3 and len(fit.centroids) == 3
    assert K.cluster_vectors(vectors(spark, []))[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        K.cluster_vectors(vectors(spark, [(1, [3e9] * 64)]))[0].collect()


def test_falls_bound_what_distances_fall_by():
    """No vector of a sphere comes nearer to a moved centroid than its bound says, and the bound is under the full drift."""
    rng = np.random.default_rng(8)
    tighter = 0
    for trial in range(60):
        dims = int(rng.integers(2, 10))
        old = rng.integers(-200, 200, (5, dims))
        new = old + rng.integers(-30, 31, (5, dims)) * rng.integers(0, 2, (5, 1))
        radius = rng.uniform(0, 150, 5)
        fall, drift = K.falls(old, new, radius), np.sqrt(((new - old) ** 2).sum(1))
        for i in range(5):
            way = rng.normal(0, 1, (400, dims))
            x = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (400, 1)) ** (1 / dims)
            for j in range(5):
                if j != i:
                    fell = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                    assert fell.max() <= fall[i] + 1e-6
            others = max(drift[j] for j in range(5) if j != i)
            assert fall[i] <= others * (1 + 1e-8)
            tighter += fall[i] < 0.9 * others
    assert tighter > 60


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-(1 << 26), 1 << 26, (50, 64)), rng.integers(-(1 << 26), 1 << 26, (7, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, one, strict=True)) for one in c] for v in x]
    assert K.squared(x, c).tolist() == want and K.most(64) >= 1 << 26
    assert K.squared(x >> 10, c >> 10).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, one, strict=True)) for one in c >> 10] for v in x >> 10]


def test_clusters_match_sql(spark):
    out = registry.QUERIES["op13_centroid_clusters"](spark, SF)
    want = sql(registry.ORACLES["op13_centroid_clusters"], "embeddings")
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in out.select(*want.columns).collect()) == sorted(want.fetchall())


def test_near_dedup_stores_open_buckets_in_few_rounds(spark, monkeypatch):
    import random

    from colloquy.llm import near_dedup as N

    draw, head = random.Random(4), " ".join(f"h{k}" for k in range(75))
    stock = [" ".join(f"s{k}x{j}" for j in range(5)) for k in range(100)]
    texts = [" ".join([head, *draw.sample(stock, 5)]) for _ in range(600)]
    rounds, plain = [], N.still_open

    def counted(*args):
        out = plain(*args)
        rounds.append(out.count())
        return out

    monkeypatch.setattr(N, "still_open", counted)
    out = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2)
    got = {r["__id"]: r.component_id for r in out.collect()}
    sets, low = [{*zip(w, w[1:], strict=False)} for w in map(str.split, texts)], list(range(600))
    for a in range(600):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 100 >= (len(sets[a]) + len(sets[b]) - both) * 80 and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    assert got == dict(enumerate(low)) and sum(n > 0 for n in rounds) == 2
