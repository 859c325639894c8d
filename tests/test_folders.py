"""Folders: simple ways only, shortest trees, interval labels."""

import random

import pytest

from colloquy.operators.folders import folder_tree, walk_folders

KINDS = "folder_id string, parent_id string"


def plain_ways(pairs, root):
    children = {}
    for child, parent in set(pairs):
        if child != root and parent is not None:
            children.setdefault(parent, set()).add(child)
    out, todo = [], [(root,)]
    while todo:
        way = todo.pop()
        out.append((way[-1], len(way) - 1, "/".join(way)))
        todo += [(*way, c) for c in children.get(way[-1], ()) if c not in way]
    return sorted(out)


def plain_tree(pairs, root):
    children, parents = {}, {}
    for child, parent in set(pairs):
        if child != root and parent is not None and child != parent:
            parents.setdefault(child, set()).add(parent)
            children.setdefault(parent, set()).add(child)
    depth, level = {root: 0}, [root]
    while level:
        level = sorted({c for p in level for c in children.get(p, ()) if c not in depth})
        depth |= {c: 1 + min(depth[p] for p in parents[c] if p in depth) for c in level}
    up = {c: min((depth[p], p) for p in parents[c] if p in depth)[1] for c in depth if c != root}
    own = {}
    for c, p in sorted(up.items()):
        own.setdefault(p, []).append(c)
    labels, count = {}, [0]

    def visit(top):
        stack = [(top, False)]
        while stack:
            f, done = stack.pop()
            if done:
                labels[f] = (labels[f][0], count[0] - 1)
                continue
            labels[f] = (count[0], None)
            count[0] += 1
            stack.append((f, True))
            stack += [(c, False) for c in reversed(own.get(f, []))]

    visit(root)
    return sorted((f, up.get(f), depth[f], *labels[f]) for f in depth)


def got(df):
    return sorted(tuple(r) for r in df.collect())


CASES = {
    "circle": [("r", None), ("a", "r"), ("a", "c"), ("b", "a"), ("c", "b")],
    "two ways": [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "d"), ("c", "e"), ("x", "y"), ("y", "x"), ("s", "s"), ("lost", "nowhere"), ("a", "r")],
    "root alone": [("r", None)],
    "no root": [("a", "b")],
    "root below": [("r", "c"), ("a", "r"), ("b", "a"), ("c", "b")],
    "nothing": [],
}


@pytest.mark.parametrize("case", CASES)
def test_folders_by_hand(spark, case):
    pairs = CASES[case]
    table = spark.createDataFrame(pairs, KINDS)
    there = any("r" in p for p in pairs)
    assert got(walk_folders(table, "r")) == (plain_ways(pairs, "r") if there else [])
    assert got(folder_tree(table, "r")) == (plain_tree(pairs, "r") if there else [])


def test_folders_at_random(spark):
    draw = random.Random(4)
    pairs = [("r", None), *((f"f{k}", draw.choice(["r", *(f"f{j}" for j in range(k))])) for k in range(60)), *((f"f{draw.randrange(60)}", f"f{draw.randrange(60)}") for _ in range(5))]
    table = spark.createDataFrame(pairs, KINDS)
    assert got(walk_folders(table, "r")) == plain_ways(pairs, "r")
    assert got(folder_tree(table, "r")) == plain_tree(pairs, "r")


def test_deep_folders(spark):
    """Twenty chains of a thousand, one of them in a circle: rounds go with the logarithm of the depth."""
    pairs = [("r", None), *((f"c{c:02}-{k:04}", f"c{c:02}-{k - 1:04}" if k else "r") for c in range(20) for k in range(1000)), ("c00-0000", "c00-0999")]
    out = {r.folder_id: (r.depth, r.pre, r["last"]) for r in folder_tree(spark.createDataFrame(pairs, KINDS), "r").collect()}
    assert len(out) == 20_001 and out["r"] == (0, 0, 20_000) and out["c19-0999"] == (1000, 20_000, 20_000) and out["c01-0000"] == (1, 1001, 2000)
