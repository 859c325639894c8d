"""Folder trees of any depth, with several parents and circles.

A folder with one parent is reached by one way only, so runs of such folders are walked by doubling: each holds the nearest folder above
it that is the root or has several parents (a branch) and how far that is, in a number of rounds in the logarithm of the depth. Between branches
the way is searched from the root, a frontier at a time, so the rounds are the branches on a way and not the folders. Folders that hang
from a circle without a way from the root are never reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.ranges import windowed
from colloquy.sources.store import materialise


def edges_of(folders: DataFrame, root: str) -> DataFrame:
    """(id, parent) pairs below the root, each once, without folders that are their own parent."""
    pairs = folders.select(F.col("folder_id").alias("id"), F.col("parent_id").alias("parent"))
    return pairs.filter((F.col("id") != root) & (F.col("id") != F.col("parent"))).distinct()


def chains(edges: DataFrame, root: str, paths: bool) -> tuple[DataFrame, DataFrame]:
    """(inner, ways): folders of one parent as (id, head, dist, seg), and of each branch the ways to it from others, (id, head, dist, seg, parent).

    ``head`` is the nearest branch above (or the root), ``dist`` the steps from there; ``seg``, where asked for, the folders on the
    way after the head.
    """
    text = lambda c: c.cast("string") if paths else F.lit(None).cast("string")
    many = materialise(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")), "folder-parents")
    single = many.filter("n = 1").select("id", F.col("parent").alias("up"), F.lit(1).alias("dist"), text(F.col("id")).alias("seg"))
    heads = many.filter("n > 1").select(F.col("id").alias("head"))
    heads = materialise(heads.unionByName(edges.sparkSession.createDataFrame([(root,)], "head string").select(F.col("head").cast(heads.schema["head"].dataType).alias("head"))), "folder-heads")
    done = lambda df: df.join(heads, F.col("up") == F.col("head"), "left_semi")
    open_, parts = materialise(single.join(heads, F.col("up") == F.col("head"), "left_anti"), "folder-open"), [materialise(done(single), "folder-done")]
    for _ in range(max(many.count(), 1).bit_length() + 1):
        if open_.isEmpty():
            break
        known = parts[-1] if len(parts) == 1 else materialise(_union(parts), "folder-done")
        parts = [known]
        above = known.unionByName(open_).select(F.col("id").alias("at"), F.col("up").alias("to"), F.col("dist").alias("more"), F.col("seg").alias("before"))
        longer = open_.join(above, F.col("up") == F.col("at")).select("id", F.col("to").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.concat("before", F.lit("/"), "seg").alias("seg"))
        longer = materialise(longer.filter("up <> id"), "folder-longer")  # back at itself: a circle
        parts.append(materialise(done(longer), "folder-done"))
        open_ = longer.join(heads, F.col("up") == F.col("head"), "left_anti")
    inner = _union(parts).select("id", F.col("up").alias("head"), "dist", "seg")
    branch = edges.join(many.filter("n > 1").select("id"), "id", "left_semi")
    direct = branch.join(heads, F.col("parent") == F.col("head")).select("id", "head", F.lit(1).alias("dist"), F.lit(None).cast("string").alias("seg"), "parent")
    through = branch.join(inner.select(F.col("id").alias("parent"), "head", "dist", "seg"), "parent").select("id", "head", (F.col("dist") + 1).alias("dist"), "seg", "parent")
    return inner, materialise(direct.unionByName(through), "folder-ways")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def joined(*pieces: Column) -> Column:
    """Pieces of a path, without null ones."""
    return F.concat_ws("/", *pieces)


def walk_folders(folders: DataFrame, root: str) -> DataFrame:
    """(folder_id, depth, path) of ``root`` and all below it, over (folder_id, parent_id): a row for each way that passes no folder twice.

    A folder with several parents has a row for each way, which may be many; ``folder_tree`` has one row a folder. A way passes a
    folder twice only if it passes a branch twice, so branches are what is remembered.
    """
    inner, ways = chains(edges_of(folders, root), root, True)
    kind = folders.schema["folder_id"].dataType
    there = folders.filter((F.col("folder_id") == root) | (F.col("parent_id") == root)).limit(1)  # no folders, no root
    start = there.select(F.lit(root).cast(kind).alias("head"), F.lit(0).alias("depth"), F.lit(root).cast("string").alias("path"), F.array(F.lit(root).cast(kind)).alias("seen"))
    parts = [materialise(start, "folder-frontier")]
    while not parts[-1].isEmpty():
        steps = ways.withColumnRenamed("head", "from")
        after = parts[-1].join(steps, F.col("head") == F.col("from")).filter(~F.array_contains("seen", F.col("id")))
        parts.append(materialise(after.select(F.col("id").alias("head"), (F.col("depth") + F.col("dist")).alias("depth"), joined("path", "seg", F.col("id").cast("string")).alias("path"), F.array_append("seen", F.col("id")).alias("seen")), "folder-frontier"))
    reached = _union(parts)
    below = inner.join(reached.withColumnRenamed("head", "__head"), F.col("head") == F.col("__head"))
    below = below.select(F.col("id").alias("folder_id"), (F.col("depth") + F.col("dist")).alias("depth"), joined("path", "seg").alias("path"))
    return reached.select(F.col("head").alias("folder_id"), "depth", "path").unionByName(below)


def shortest(folders: DataFrame, root: str) -> DataFrame:
    """(id, parent, depth) of every folder that has a way from the root, over a shortest one; of equal ones that by the smallest parent."""
    inner, ways = chains(edges_of(folders, root), root, False)
    kind = folders.schema["folder_id"].dataType
    there = folders.filter((F.col("folder_id") == root) | (F.col("parent_id") == root)).limit(1)
    found = materialise(there.select(F.lit(root).cast(kind).alias("id"), F.lit(0).alias("depth")), "folder-found")
    frontier = found
    while not frontier.isEmpty():
        steps = ways.join(frontier.select(F.col("id").alias("head"), "depth"), "head").groupBy("id").agg(F.min(F.col("depth") + F.col("dist")).alias("new"))
        better = materialise(steps.join(found, "id", "left").filter(F.col("depth").isNull() | (F.col("new") < F.col("depth"))).select("id", F.col("new").alias("depth")), "folder-better")
        found = materialise(found.join(better, "id", "left_anti").unionByName(better), "folder-found")
        frontier = better
    at = found.select(F.col("id").alias("head"), "depth")
    branch = ways.join(at, "head").groupBy("id").agg(F.min(F.struct((F.col("depth") + F.col("dist")).alias("depth"), "parent")).alias("x")).select("id", "x.parent", "x.depth")
    own = edges_of(folders, root)
    below = inner.join(at, "head").select("id", (F.col("depth") + F.col("dist")).alias("depth")).join(own, "id").select("id", "parent", "depth")
    top = there.select(F.lit(root).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"))
    return materialise(top.unionByName(branch).unionByName(below), "folder-tree")


def folder_tree(folders: DataFrame, root: str) -> DataFrame:
    """(folder_id, parent_id, depth, pre, last): the tree of shortest ways, with interval labels.

    Folders are numbered from 0 as they are met going down first, children in order of their id; a folder's subtree is what has a ``pre`` from its
    own to its ``last``, so ``is_below`` needs no walk. Numbers come from the tour that enters and leaves every folder: each step knows the next one, and the
    steps left to the end are added up by doubling, in a number of rounds in the logarithm of the tour.
    """
    tree = shortest(folders, root)
    siblings = materialise(windowed(tree.filter("parent IS NOT NULL").select("id", "parent"), ["parent"], [F.col("id")], {"next": lambda w: F.lead("id").over(w)}, after=1), "folder-siblings")
    first = siblings.groupBy("parent").agg(F.min("id").alias("child")).withColumnRenamed("parent", "of")
    step = lambda kind, c: F.struct(F.lit(kind).alias("k"), F.col(c).alias("id"))
    enter, leave = 0, 1
    into = tree.join(first, F.col("id") == F.col("of"), "left").select(step(enter, "id").alias("at"), F.when(F.col("child").isNull(), step(leave, "id")).otherwise(step(enter, "child")).alias("to"), F.lit(1).cast("long").alias("left"))
    out_of = tree.select("id").join(siblings, "id", "left").select(step(leave, "id").alias("at"), F.when(F.col("next").isNotNull(), step(enter, "next")).when(F.col("parent").isNotNull(), step(leave, "parent")).alias("to"), F.lit(0).cast("long").alias("left"))
    tour = materialise(into.unionByName(out_of), "folder-tour")
    while not (open_ := tour.filter("to IS NOT NULL")).isEmpty():
        ahead = tour.select(F.col("at").alias("__at"), F.col("to").alias("__to"), F.col("left").alias("__left"))
        longer = open_.join(ahead, F.col("to") == F.col("__at")).select("at", F.col("__to").alias("to"), (F.col("left") + F.col("__left")).alias("left"))
        tour = materialise(tour.filter("to IS NULL").unionByName(longer), "folder-tour")
    steps = tour.groupBy(F.col("at.id").alias("folder")).agg(F.max(F.when(F.col("at.k") == enter, F.col("left"))).alias("entered"), F.max(F.when(F.col("at.k") == leave, F.col("left"))).alias("left"))
    n = tree.count()
    rows = tree.join(steps, F.col("id") == F.col("folder"))
    pre = n - F.col("entered")
    return rows.select(F.col("id").alias("folder_id"), F.col("parent").alias("parent_id"), "depth", pre.alias("pre"), (pre + F.col("entered") - F.col("left") - 1).alias("last"))


def is_below(pre: Column, top_pre: Column, top_last: Column) -> Column:
    """Whether a folder lies in the subtree of another (itself included), by their labels."""
    return pre.between(top_pre, top_last)
