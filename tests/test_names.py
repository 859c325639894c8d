"""Known names against a plain walk over words."""

import hashlib
import random
import re

from colloquy.operators import names as N
from colloquy.sources import store

WORD = r"[^\W_]+(?:['’][^\W_]+)*"


def stands(entity):
    return "person-" + hashlib.sha256(f"salt:{entity}".encode()).hexdigest()[:10]


def plain(text, names):
    if text is None:
        return None
    known = {}
    for e, n in names:
        words = tuple(re.findall(WORD, (n or "").lower()))
        if e is not None and words:
            known[words] = min(e, known.get(words, e))
    spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(WORD, text)]
    out, done, k = "", 0, 0
    while k < len(spans):
        size = max((len(w) for w in known if tuple(s[2] for s in spans[k : k + len(w)]) == w), default=0)
        if size:
            out += text[done : spans[k][0]] + stands(known[tuple(s[2] for s in spans[k : k + size])])
            done = spans[k + size - 1][1]
        k += size or 1
    return out + text[done:]


NAMES = [(1, "Ana Souza"), (1, "Ana"), (2, "ana souza lima"), (3, "João D'Ávila"), (4, "Müller"), (5, "ana"), (6, ""), (7, None), (None, "Nobody"), (8, "Souza"), (9, "Lima Souza")]


def test_names_equal_the_plain_walk(spark, monkeypatch):
    draw = random.Random(8)
    bits = ["Ana", "ANA", "souza", "Lima", "João", "D'Ávila", "d'ávila", "Müller", "müllers", "Nobody", "call", "é", "x1"]
    texts = [None, "", "  ", "Ana", "Ana Souza Lima Souza", "anasouza", "Ana-Souza,\n(Lima)", "--Müller's", "«João  D'Ávila» disse", "Ana\tAna Ana"] + ["".join(draw.choice(bits) + draw.choice([" ", ", ", "\n", "-"]) for _ in range(draw.randrange(12))) for _ in range(150)]
    rows = [(k % 140, t, "f") for k, t in enumerate(texts)] + [(1, "Ana", "f"), (1, "Ana", "f")]
    table, people = spark.createDataFrame(rows, "call_id long, text string, found string").repartition(3), spark.createDataFrame(NAMES, "seller_id long, name string")
    want = sorted(((i, plain(t, NAMES), f) for i, t, f in rows), key=str)
    for limit in (store.BROADCAST_BYTES, 0):
        monkeypatch.setattr(N, "broadcast_if_small", lambda df, limit=limit: store.broadcast_if_small(df, limit))
        out = N.mask_names(table, people, salt="salt")
        assert out.columns == table.columns and sorted((tuple(r) for r in out.collect()), key=str) == want
    assert sum("person-" in (t or "") for _, t, _ in want) > 60
    assert N.mask_names(table, people.limit(0)).count() == len(rows) and N.mask_names(table.limit(0), people).count() == 0


def test_a_text_is_cut_into_pieces_once(spark):
    table, people = spark.createDataFrame([(1, "Ana, Lima"), (2, None)], "call_id long, text string"), spark.createDataFrame(NAMES, "seller_id long, name string")
    out = N.mask_names(table, people)
    assert out._jdf.queryExecution().executedPlan().toString().count("(?s)") == 1
