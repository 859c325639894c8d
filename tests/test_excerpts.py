"""Excerpts against a plain edit distance over all segments of a call."""

import random

from colloquy.operators import excerpts as X


def plain_edits(a, b):
    row, best = list(range(len(a) + 1)), (len(a), 0)
    for j, y in enumerate(b, 1):
        before, row = row, [0]
        for i, x in enumerate(a, 1):
            row.append(min(row[-1] + 1, before[i] + 1, before[i - 1] + (x != y)))
        best = min(best, (row[-1], j))
    return best


def test_edits_equal_the_plain_distance():
    draw = random.Random(1)
    for _ in range(400):
        a, b = ("".join(draw.choice("abé ") for _ in range(draw.randrange(n))) for n in (90, 140))
        if draw.random() < 0.5:
            b = b[:20] + a[: len(a) // 2] + draw.choice("xy") + a[len(a) // 2 :] + b[20:]
        assert X.edits(a, b) == plain_edits(a, b)


def test_excerpts_are_found_as_by_comparing_all(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["the", "of", "Ünder", "price"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    segments = [(c, o, text(draw.randrange(1, 60))) for c in range(4) for o in range(12)] + [(0, 40, None), (0, 41, ""), (1, 5, "a second segment with the same number"), (None, 1, "nowhere")]
    evidence = []
    for k in range(160):
        c, _, t = draw.choice(segments[:48])
        a = draw.randrange(len(t))
        own = list(t[a : a + draw.choice([2, 5, 9, 30, 80])])
        for _ in range(draw.randrange(4)):
            i = draw.randrange(len(own) + 1)
            own[i : i + 1] = draw.choice([[], ["x"], ["q", "z"]])
        evidence.append((k, draw.choice([c, c, c, 0]), "".join(own)))
    evidence += [(900, 0, None), (901, 0, "  "), (902, None, "nowhere"), (903, 77, "the price"), (904, 1, "A Second\tSEGMENT  with the same number"), (905, 2, text(4000))]
    clean = lambda t: " ".join((t or "").lower().split())
    want = {}
    for i, c, said in evidence:
        said = clean(said)
        near = [(d, o) for cc, o, t in segments if said and c is not None and cc == c and len(said) < 5000 and (d := plain_edits(said, clean(t))[0]) <= len(said) // X.CHARS_AN_ERROR]
        want[i] = min(near)[::-1] if near else (None, None)
    out = X.locate_excerpts(spark.createDataFrame(evidence, "evidence_id long, call_id long, excerpt string").repartition(3), spark.createDataFrame(segments, "call_id long, turn int, text string"))
    assert {r.evidence_id: (r.segment, r.edits) for r in out.collect()} == want
    assert 60 < sum(s is not None for s, _ in want.values()) < 160 and {e for _, e in want.values()} >= {0, 1, 2}
    assert X.located_gaps(out).count() == sum(s is None for s, _ in want.values())
    assert X.locate_excerpts(spark.createDataFrame([], "evidence_id long, call_id long, excerpt string"), spark.createDataFrame(segments, "call_id long, turn int, text string")).count() == 0
