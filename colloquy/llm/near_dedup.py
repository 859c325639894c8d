"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures. A document's set of word shingles is hashed by one permutation; a second permutation, with
its argument shifted circularly by k, gives coordinate k: min over the set of pi((sigma(v) + k) mod 2**32).
Two permutations thus make all coordinates. Bands of ``rows`` coordinates are the buckets; with 42 bands
of 6, a pair at similarity 0.8 shares no bucket with probability 3e-6.

Classes. Documents with equal sets (a 128-bit sum over the set, and its size) are one class, stood for by
its smallest id; only classes go on, so copies never meet in pairs.

Links. Round 0 tests each class against that of its buckets' smallest classes which it shares most buckets
with: one pair a class. What is linked becomes components. Then, while a bucket still holds classes of different components that
were not tested against each other, 4, 1024, 262144, ... further classes of each such bucket are tested against
those of other components. A bucket is left when all untested pairs in it lie within one component, so
no link that a bucket shows is lost, and a group of near copies costs a few pairs for each member
instead of all pairs. Links are confirmed on the full sets. There is no cap on a bucket's size.

Texts on the fringe of a large group stay untied to it, and share buckets with all of it. So after round 0
what two sets can have in common is bounded before sets are compared: by the shingles that no other class
tied by open buckets has, and by the shingles common in such a cluster that either class lacks (``bounds``).
The bound is never below the true size, so it leaves out no link.

Components spread by smallest label with pointer jumping; each round is stored in the shared folder, so
lineage stays short and lost executors cost one round. Nothing that grows is sent to the driver but counts.

Defined cases: a text without words has an empty set and is linked with nothing; with fewer words than a
shingle, the whole sequence is the only one; a null id is linked with nothing and stays; rows that share
an id are one document, for which the row with the largest set stands; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import GOLDEN, MIX_A, blocks, broadcast_if_small, discard, materialise, mix64, prepare, sized_semi_join, texts_of
from colloquy.llm.memo import WordHashes, held

BANDS, ROWS = 42, 6
#: Rows of a bucket that are numbered in one task.
PART = 1 << 16
#: Odd multipliers of the second permutation (fixed values).
PI_A, PI_B = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
#: How many times more classes of a bucket each round tests than the one before: what stays open is read and stored anew each round.
STEP = 256
#: Shingles that are permuted at once, so that the work stays in a core's cache.
CACHED = 1 << 13
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes of each text, one after another; where each text's begin and the end)."""
    known = held("shingles", WordHashes)
    split = [t.split() for t in texts_of(FOLD[raw], at)]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
    words = known.of([w for own in split for w in own])
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled = mix64(rolled * GOLDEN + words[j : j + n])
    sets, counts = [], np.zeros(len(at), np.int64)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            own = np.unique(rolled[a : b - size + 1])
        elif b > a:
            own = np.zeros(1, np.uint64)
            for w in words[a:b]:
                own = mix64(own * GOLDEN + w)
        else:
            continue
        sets.append(own)
        counts[k + 1] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(counts)


def signatures(values: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash of each set (none empty): ``length`` coordinates."""
    sigma = (mix64(values * GOLDEN) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, length), np.uint32)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CACHED, "right")) - 1)
        own, begins = sigma[at[first] : at[last]], at[first:last] - at[first]
        x, y = np.empty_like(own), np.empty_like(own)
        for k in range(length):
            np.add(own, np.uint32(k), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, PI_A, out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, PI_B, out=x)
            out[first:last, k] = np.minimum.reduceat(x, begins)
        first = last
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), 0)
    cells = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = mix64(keys * GOLDEN + cells[:, :, j])
    return keys


def signed(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, n, f, g, bands): set size, fingerprint and band keys (none for an empty set) of each row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in blocks(batches, "__text"):
            values, ends = shingle_sets(raw, at, size)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            f, g = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            begins = ends[:-1][full]
            if len(full):
                f[full] = np.add.reduceat(mix64(values), begins)
                g[full] = np.add.reduceat(mix64(values ^ MIX_A), begins)
                keys = band_keys(signatures(values, np.append(begins, ends[-1]), bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64) if len(full) else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(n, pa.int64()), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), lists], ["__id", "n", "f", "g", "bands"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, n long, f long, g long, bands array<long>")


def full_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, f, g, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in blocks(batches, "__text"):
            values, ends = shingle_sets(raw, at, size)
            full = np.flatnonzero(np.diff(ends))
            f, g = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
            if len(full):
                f[full] = np.add.reduceat(mix64(values), ends[:-1][full])
                g[full] = np.add.reduceat(mix64(values ^ MIX_A), ends[:-1][full])
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), lists], ["__id", "f", "g", "shingles"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, f long, g long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb and more) whose sets have 100 * intersection >= percent * union, without na and nb."""
    one = sets.select(F.col("__id").alias("a"), F.col("shingles").alias("__sa"))
    two = sets.select(F.col("__id").alias("b"), F.col("shingles").alias("__sb"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = F.size(F.array_intersect("__sa", "__sb")).cast("long")
    joined = pairs.filter(near).drop("na", "nb").join(one, "a").join(two, "b").withColumn("__both", both)
    return joined.filter(F.col("__both") * 100 >= (F.size("__sa") + F.size("__sb") - F.col("__both")) * percent).drop("__sa", "__sb", "__both")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for nodes that have any."""
    ways = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-ways")
    step = materialise(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name)
    while True:
        labels = step.select("node", "label")
        seen = ways.join(labels, ways["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("__at"), F.col("label").alias("__to"))
        after = materialise(lower.join(jump, lower["label"] == jump["__at"]).select("node", "old", F.least("label", "__to").alias("label")), name)
        discard(step)
        step = after
        if step.filter("label <> old").isEmpty():
            discard(ways)
            return step.select("node", "label")


def joined_components(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """``labels`` after links between components, ``ends`` (a, b: their labels; of a node without one, itself)."""
    roots = components(ends, "joined")
    moved = labels.join(roots.select(F.col("node").alias("__at"), F.col("label").alias("__to")), F.col("label") == F.col("__at"), "left")
    fresh = roots.join(labels.select(F.col("node").alias("__known")), F.col("node") == F.col("__known"), "left_anti")
    out = materialise(moved.select("node", F.coalesce("__to", "label").alias("label")).unionByName(fresh), "labels")
    discard(roots)
    return out


def clusters(ties: DataFrame) -> DataFrame:
    """(node, label) over ``ties`` (a, b), of which a node has many: components of one tie a node first, then of what joins these."""
    labels = components(ties.groupBy("a").agg(F.min("b").alias("b")), "clusters")
    known = [labels.select(F.col("node").alias(f"__{c}"), F.col("label").alias(f"__l{c}")) for c in "ab"]
    ends = ties.join(known[0], F.col("a") == F.col("__a"), "left").join(known[1], F.col("b") == F.col("__b"), "left")
    ends = ends.select(F.coalesce("__la", "a").alias("a"), F.coalesce("__lb", "b").alias("b")).filter("a <> b").distinct()
    ends = materialise(ends, "cluster-ends")
    return labels if ends.isEmpty() else joined_components(labels, ends)


def ranked(buckets: DataFrame) -> DataFrame:
    """``buckets`` (rep, n, key, low, many) with a number ``rank`` from 1 for each row of a key.

    A large bucket is numbered in parts of about ``PART`` rows, dealt by hash, and each part begins where the one before ends.
    """
    parts = F.ceil(F.col("many") / PART)
    dealt = buckets.withColumn("part", F.when(F.col("many") <= PART, 0).otherwise(F.pmod(F.xxhash64("rep"), parts)).cast("int"))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("rep"))
    large = dealt.filter(F.col("many") > PART).groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = large.select("key", "part", before.alias("before"))  # one row a part
    return dealt.withColumn("own", own).join(starts, ["key", "part"], "left").select("rep", "n", "key", "low", (F.col("own") + F.coalesce("before", F.lit(0))).alias("rank"))


def still_open(rows: DataFrame, labels: DataFrame, low: int) -> DataFrame:
    """The bucket rows from rank ``low`` on, with their component, of buckets that hold more than one component there."""
    rows = rows.filter(F.col("rank") >= low).join(labels, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "rep")).drop("node", "label")
    keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    keys = materialise(keys, "open-keys")
    out = materialise(rows.join(broadcast_if_small(keys), "key", "left_semi"), "open")
    discard(keys)
    return out


def bounds(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(__id, shared, rest, core, m0..m3) of the classes in ``rows``, for a bound on what two sets have in common.

    Classes tied by chains of shared buckets are a cluster. shared: shingles of the class that another of its
    cluster has too. core: the number of shingles that at least half of the cluster has; m0..m3: the core's
    shingles that the class lacks, each as one of 256 bits; rest: shared ones outside the core.
    """
    least = broadcast_if_small(materialise(rows.groupBy("key").agg(F.min("rep").alias("b")), "least"))
    ties = materialise(rows.join(least, "key").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct(), "ties")
    labels = clusters(ties)
    some = materialise(sets.join(labels.select(F.col("node").alias("__id"), "label"), "__id").select("__id", "label", "shingles"), "tied")
    per_shingle = materialise(some.select("__id", "label", F.explode("shingles").alias("s")).groupBy("label", "s").agg(F.count(F.lit(1)).alias("many"), F.min("__id").alias("__id")), "tied-shingles")
    own = per_shingle.filter("many = 1").groupBy("__id").agg(F.count(F.lit(1)).alias("own"))
    sizes = some.groupBy("label").agg(F.count(F.lit(1)).alias("of"))
    core = per_shingle.filter("many > 1").join(sizes, "label").filter("2 * many >= of").groupBy("label").agg(F.collect_list("s").alias("__core"))  # twice the mean set size at most
    core = broadcast_if_small(materialise(core, "cores"))  # one row a cluster; joined on its own, a large cluster's rows can be split
    out = some.join(own, "__id", "left").join(core, "label", "left").withColumn("__core", F.coalesce("__core", F.array().cast("array<long>")))
    out = out.withColumn("lacks", F.array_except("__core", "shingles")).withColumn("shared", F.size("shingles") - F.coalesce("own", F.lit(0)))
    bits = [F.expr(f"aggregate(lacks, 0L, (a, s) -> CASE WHEN (shiftright(s, 6) & 3) = {j} THEN a | shiftleft(1L, CAST(s & 63 AS INT)) ELSE a END)").alias(f"m{j}") for j in range(4)]
    return out.select("__id", "shared", (F.col("shared") - F.size("__core") + F.size("lacks")).alias("rest"), F.size("__core").alias("core"), *bits)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: __id, n_shingles, component_id, kept."""
    docs = docs.select(id_col, text_col)
    all_rows = materialise(signed(docs, size, bands, rows, id_col, text_col), "signed")
    known = all_rows.filter("__id IS NOT NULL AND n > 0")
    repeated = not known.groupBy("__id").count().filter("count > 1").isEmpty()
    if repeated:
        known = materialise(known.groupBy("__id").agg(F.max(F.struct("n", "f", "g", "bands")).alias("x")).select("__id", "x.*"), "one-row")
    classes = materialise(known.groupBy("f", "g", "n").agg(F.min("__id").alias("rep"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    per_key = materialise(buckets.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "keys")
    shared = materialise(buckets.join(broadcast_if_small(per_key), "key"), "shared")
    buckets = materialise(ranked(shared), "buckets")
    wanted = buckets.select(F.col("rep").alias(id_col)).distinct()
    sets = full_sets(sized_semi_join(docs, wanted, id_col), size, id_col, text_col)
    stands = classes.select(F.col("rep").alias("__id"), "f", "g")
    sets = materialise(sets.join(stands, ["__id", "f", "g"], "left_semi").dropDuplicates(["__id"]) if repeated else sets, "sets")

    lower = buckets.filter("low < rep").repartition("rep")  # a class has ``bands`` rows at most; both aggregates keep this partitioning
    nearest = lower.groupBy("rep", "low").agg(F.count(F.lit(1)).alias("shares"), F.min("n").alias("na")).groupBy("rep").agg(F.max(F.struct("shares", "low", "na")).alias("x"))
    nearest = nearest.select(F.col("rep").alias("a"), F.col("x.low").alias("b"), "x.na")
    nearest = nearest.join(classes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    links = materialise(similar(nearest, sets, percent), "links")
    labels = components(links)
    now = still_open(buckets.drop("low"), labels, 1)
    lacked = sum((F.bit_count(f"m{j}") for j in range(4)), F.lit(0))
    alone = F.least("shared", F.col("core") - lacked + F.col("rest")) * 100 < F.col("n") * percent  # too little for any link
    done = [per_key, shared, sets, now]
    now = materialise(now.join(bounds(sets, now), F.col("rep") == F.col("__id")).drop("__id").filter(~alone), "open")
    sketch = ["n", "shared", "rest", "m0", "m1", "m2", "m3"]
    low, width = 1, 4
    while not now.isEmpty():
        pivots = now.filter(F.col("rank") < low + width).select("key", F.col("rep").alias("b"), F.col("rank").alias("__p"), F.col("comp").alias("__c"), *[F.col(c).alias(f"b_{c}") for c in sketch])
        lacked = sum((F.bit_count(F.col(f"m{j}").bitwiseOR(F.col(f"b_m{j}"))) for j in range(4)), F.lit(0))
        most = F.least("shared", "b_shared", F.col("core") - lacked + F.least("rest", "b_rest"))
        may = most * 100 >= (F.col("n") + F.col("b_n") - most) * percent
        pairs = now.join(pivots, (now["key"] == pivots["key"]) & (now["rank"] > pivots["__p"]) & (now["comp"] != pivots["__c"]) & may)
        pairs = pairs.select(F.col("rep").alias("a"), F.col("n").alias("na"), "b", F.col("b_n").alias("nb"), F.col("comp").alias("ca"), F.col("__c").alias("cb")).distinct()
        more = materialise(similar(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        done.append(more)
        if not more.isEmpty():
            done.append(labels)
            labels = joined_components(labels, more)
        low, width = low + width, width * STEP
        done.append(now)
        now = still_open(now.drop("comp"), labels, low)
    for table in [*done, now, buckets, links]:
        discard(table)
    reps = classes.join(labels, classes["rep"] == labels["node"], "left").select("f", "g", "n", F.coalesce("label", "rep").alias("__component"))
    if repeated:
        own = known.join(reps, ["f", "g", "n"]).select("__id", "n", "__component")
        out = all_rows.select("__id").join(own, "__id", "left")
    else:
        out = all_rows.select("__id", "n", "f", "g").join(reps, ["f", "g", "n"], "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("__component", "__id"))
    return out.select("__id", F.coalesce("n", F.lit(0)).alias("n_shingles"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; two-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2).withColumnRenamed("__id", "doc_id")
