"""Centroid clustering in exact integers, with lower bounds that drift by planar geometry.

Each round assigns all vectors to the nearest of k centroids and moves the centroids. Centroids (k of them, so of a fixed
size) are all that passes the driver; vectors stay in one table a round in the shared folder, written by one pass that
also leaves each task's sums beside its rows, so the next centroids come from those few rows alone.

Bounds. A vector keeps a lower bound on its distance to all centroids but its own. When centroids have moved, the
vectors of a cluster all lie in the sphere about its old centroid m that reaches its farthest vector (radius r). For a centroid that went from c to
d, the distance of a vector x falls by |x-c| - |x-d| = 2 (x-h).(d-c) / (|x-c| + |x-d|), h halfway between. Both factors are bounded over the sphere
in the plane of m, c and d: (x-h).(d-c) is at most |d-c| (p + r), p the place of m along d-c from h, and the sum of distances is
at least |m-c| + |m-d| - 2r, 2(|m-h| - r) and |d-c|. So the fall is never more than the drift |d-c|, and nothing where the sphere lies
behind the halfway plane. The bound of a cluster's vectors is loosened by the largest such fall. A vector whose exact distance to its own moved centroid is
under its bound, or under half the distance of that centroid to its nearest other, keeps its cluster; all others are ambiguous
and are held against all centroids exactly. Bounds are rounded down, comparisons are strict, so ties are always scanned.

Defined cases: vectors with another number of components, or a null or non-finite one, are left out; equal vectors and ids are
each a row; of the rows that share a start's hash (a null id hashes as an empty one) the smaller vector comes first; with fewer vectors than ``k`` each is a centroid;
an empty table gives no rows; other columns are ignored. Components whose squared distances would pass 64 bits (floor(256 x) of 2**26 or more at 64
components) are an error, as the result could not be stated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialise, prepare

#: Relative slack of a bound against the rounding of 64-bit floats.
SLACK = 1e-9
#: Vectors that are scanned at once.
CHUNK = 1 << 12
STATE = ["v binary", "cluster int", "distance long", "lower double", "many long", "scanned long", "far long", "sums array<long>"]


@dataclass
class Fit:
    """Centroids (as lists of integers), how many vectors each pass held against all centroids, and by cluster the vectors, summed distances."""

    centroids: list[list[int]]
    scanned: list[int] = field(default_factory=list)
    inertia: dict[int, int] = field(default_factory=dict)


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as integers) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls are NaN
    fine = np.isfinite(x).all(1)
    made = np.floor(x[fine] * scale)
    if made.size and np.abs(made).max() >= most(dims):
        raise ValueError(f"a component of {np.abs(made).max():.4g} is too large for squared distances in 64 bits")
    return rows[fine], made.astype(np.int64)


def most(dims: int) -> int:
    """What components stay under in size, so that squared distances fit in 63 bits."""
    return int((2**62 / dims) ** 0.5 / 2)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if reach * reach * x.shape[1] < 1 << 50:  # every sum below is a whole number that a float holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``."""
    step = x - c
    return np.einsum("ij,ij->i", step, step)


def falls(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, what the distance of any of its vectors to another centroid can have fallen by: never less than the true fall."""
    before, after = old.astype(np.float64), new.astype(np.float64)
    step = after - before
    drift = np.sqrt((step * step).sum(1))
    half = (before + after) / 2
    r = radius[:, None]
    from_half = before[:, None, :] - half[None, :, :]  # of sphere i's middle, from halfway of centroid j
    along = np.einsum("ijd,jd->ij", from_half, step) / np.where(drift > 0, drift, 1.0)
    to = lambda c: np.sqrt(((before[:, None, :] - c[None, :, :]) ** 2).sum(2))
    least = np.maximum(np.maximum(to(before) + to(after) - 2 * r, 2 * (to(half) - r)), drift)
    reach = np.maximum(along + r * (1 + SLACK) + SLACK * (1 + np.abs(along)), 0.0)
    fall = np.where(drift > 0, np.minimum(2 * drift * reach / np.where(least > 0, least * (1 - SLACK), 1.0), drift), 0.0)
    np.fill_diagonal(fall, 0.0)
    return fall.max(1, initial=0.0) * (1 + SLACK)


def halves(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other, rounded down."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    apart = squared(c, c).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    return np.sqrt(apart.min(1)) / 2 * (1 - SLACK)


def assign(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, c: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bound, ambiguous) of the rows of ``x``, whose cluster is -1 where there is none yet."""
    known = cluster >= 0
    distance = np.zeros(len(x), np.int64)
    distance[known] = own_squared(x[known], c[cluster[known]])
    near = np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
    open_ = ~known | (near >= np.maximum(lower, half[np.maximum(cluster, 0)]))
    at = np.flatnonzero(open_)
    for first in range(0, len(at), CHUNK):
        rows = at[first : first + CHUNK]
        d = squared(x[rows], c)
        best = d.argmin(1)  # the first of equal ones
        cluster[rows], distance[rows] = best, d[np.arange(len(rows)), best]
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.inf
    return cluster, distance, lower, open_


def assigned(state: DataFrame, centroids: list[list[int]], fall: np.ndarray | None) -> DataFrame:
    """``state`` with every vector in its nearest cluster, and a row of sums for each cluster of each task's vectors."""
    c = np.array(centroids, np.int64)
    half, (k, dims) = halves(c), c.shape
    kind = next(f"{n} {t}" for n, t in state.dtypes if n == "vec_id")
    names = [s.split(" ")[0] for s in STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, far, scanned, ids = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), None
        inertia = np.zeros(k, np.int64)
        for batch in batches:
            ids = batch.schema.field("vec_id").type
            n = len(batch)
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            cluster, lower = (np.array(batch.column(name).to_numpy(zero_copy_only=False)) for name in ("cluster", "lower"))
            if fall is not None:
                lower = (lower - fall[cluster]) * (1 - SLACK)
            cluster, distance, lower, open_ = assign(x, cluster, lower, c, half)
            order = np.argsort(cluster, kind="stable")
            there, at = np.unique(cluster[order], return_index=True)
            total[there] += np.add.reduceat(x[order], at)
            counts[there] += np.diff(np.append(at, n))
            inertia[there] += np.add.reduceat(distance[order], at)
            far[there] = np.maximum(far[there], np.maximum.reduceat(distance[order], at))
            scanned += np.bincount(cluster[open_], minlength=k)
            none = [pa.nulls(n, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(lower), *none, pa.nulls(n, pa.list_(pa.int64()))], ["vec_id", *names])
        there = np.flatnonzero(counts)
        if len(there):
            m = len(there)
            sums = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * dims, pa.array(total[there].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.nulls(m, ids), pa.nulls(m, pa.binary()), pa.array(there, pa.int32()), pa.array(inertia[there]), pa.nulls(m, pa.float64()), pa.array(counts[there]), pa.array(scanned[there]), pa.array(far[there]), sums], ["vec_id", *names])

    return state.filter("v IS NOT NULL").select("vec_id", "v", "cluster", "lower").mapInArrow(run, ", ".join([kind, *STATE]))


def summed(state: DataFrame) -> list:
    """By cluster: vectors, summed distance, vectors scanned, farthest squared distance, and the sum of each component."""
    wide = "decimal(38,0)"
    parts = state.filter("many IS NOT NULL")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast(wide)).alias("part"))
    each = each.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("sums"))  # ``dims`` items
    own = parts.groupBy("cluster").agg(F.sum("many").alias("many"), F.sum(F.col("distance").cast(wide)).alias("inertia"), F.sum("scanned").alias("scanned"), F.max("far").alias("far"))
    return own.join(each, "cluster").select("cluster", "many", "inertia", "scanned", "far", F.col("sums.part").alias("sums")).collect()  # k rows at most


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Fit]:
    """((vec_id, cluster, distance) of every kept vector after ``rounds`` rounds and a last assignment, the fit)."""
    prepare(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = integers(batch.column("__vector"), dims, scale)
            raw = made.astype("<i4").tobytes()
            step = 4 * dims
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array([raw[i * step : (i + 1) * step] for i in range(len(rows))], pa.binary()), pa.array(np.full(len(rows), -1, np.int32)), pa.array(np.zeros(len(rows)))], ["vec_id", "v", "cluster", "lower"])

    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("__vector"))
    state = materialise(picked.mapInArrow(start, f"vec_id {kind}, v binary, cluster int, lower double"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    firsts = state.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    fit = Fit([np.frombuffer(r.v, "<i4").tolist() for r in firsts])
    if not firsts:
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), fit
    fall, far = None, None
    for number in range(rounds + 1):
        after = materialise(assigned(state, fit.centroids, fall), f"round-{number}")
        discard(state)
        state = after
        found = summed(state)
        fit.scanned.append(sum(r.scanned for r in found))
        fit.inertia = {r.cluster: int(r.inertia) for r in found}
        if number == rounds:
            break
        moved, far = [list(c) for c in fit.centroids], np.zeros(len(fit.centroids))
        for r in found:
            moved[r.cluster] = [int(s) // r.many for s in r.sums]
            far[r.cluster] = float(r.far) ** 0.5 * (1 + SLACK)
        fall = falls(np.array(fit.centroids), np.array(moved), far)
        fit.centroids = moved
    return state.filter("many IS NULL").select("vec_id", "cluster", "distance"), fit


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, fit = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    total = sum(fit.inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in fit.centroids]
    table = [(k, fit.inertia.get(k, 0), total, digest) for k, digest in enumerate(digests)]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL: k pairs a vector in each round, so for small tables only."""
    parts = [f"""e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) AS INTEGER) - 1 AS cluster, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e) ORDER BY h, v LIMIT {k})"""]
    pairs = "CAST(list_inner_product(CAST(e.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) - 2 * list_inner_product(CAST(e.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) + list_inner_product(CAST(c.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT)"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, s.cluster, s.distance FROM (SELECT e.vec_id, e.v, min({{'distance': {pairs}, 'cluster': c.cluster}}) AS s FROM e, c{r} c GROUP BY e.vec_id, e.v))""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM a{r}) GROUP BY cluster, pos),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM m{r} GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE = _oracle()
