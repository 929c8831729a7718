"""Centroid clustering (Lloyd's rounds, exact in integers) with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to the
few centroids that were next nearest, and one bound below all the others. Centroids move, so the
bounds give way by as much; a vector whose upper bound stays under all its lower ones keeps
its centroid without a look at any. Otherwise the stored centroids whose bounds it crosses are compared exactly,
and all centroids only where the remainder bound is crossed. How many bounds are stored follows the need of the
round before.

Bounds are doubles that are rounded away from certainty; every decision that they cannot certify is made on
exact integers, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialise, slices

SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Largest component allowed, so that a squared distance over some thousand dimensions fits a long.
MOST = 1 << 25
#: Rounding allowed for in bounds, relative.
_SLACK = 1e-9
_STATE = "vec_id long, x binary, cluster int, upper double, near array<int>, lower array<double>, rest double, distance long, kind string, part binary, used int"


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """vec_id, v (doubles): vectors of the right length without null or non-finite components."""
    v = table[vector_col].cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(table[id_col].cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dimensions) & ~bad.eqNullSafe(F.lit(True)))


def first_hash(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dimensions).astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) squared distances, exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def _stage(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "v", 4 << 20, 1 << 14):
                v = batch.column("v")
                x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(scale)).reshape(len(v), -1)
                if x.size and np.abs(x).max() > MOST:
                    raise ValueError(f"components beyond {MOST} after scaling: their distances do not fit a long")
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], names=["vec_id", "x"])

    return run


class Bounds:
    """One block of vectors: their assignment and bounds as arrays."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.lower, self.rest = cluster, upper, near, lower, rest

    @classmethod
    def scanned(cls, x: np.ndarray, centroids: np.ndarray, stored: int) -> Bounds:
        """From all distances: the nearest (of ties the smaller number), the next `stored`, and one below the others."""
        d = distances(x, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        rest = root[:, stored + 1] * (1 - _SLACK) if len(centroids) > stored + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int32), root[:, 0] * (1 + _SLACK), order[:, 1 : stored + 1].astype(np.int32), root[:, 1 : stored + 1] * (1 - _SLACK), rest)

    def move(self, moved: np.ndarray, stored: int) -> None:
        """Centroids moved by `moved`; of the stored bounds only the least `stored` stay, the others join the remainder."""
        self.upper = (self.upper + moved[self.cluster]) * (1 + _SLACK)
        self.lower = np.maximum(0, self.lower - moved[self.near]) * (1 - _SLACK)
        self.rest = np.maximum(0, self.rest - moved.max(initial=0)) * (1 - _SLACK)
        if self.near.shape[1] > stored:
            order = np.argsort(self.lower, axis=1, kind="stable")
            self.near, self.lower = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.lower, order, 1)
            self.rest = np.minimum(self.rest, self.lower[:, stored:].min(axis=1))
            self.near, self.lower = self.near[:, :stored].copy(), self.lower[:, :stored].copy()

    def settle(self, x: np.ndarray, centroids: np.ndarray, stored: int) -> int:
        """Make every assignment exact; returns the most stored bounds that a vector needed."""
        least = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        doubt = np.flatnonzero(self.upper >= least)
        if not len(doubt):
            return 0
        # A tight upper bound may be enough.
        d = x[doubt] - centroids[self.cluster[doubt]]
        own = np.einsum("ij,ij->i", d, d)
        self.upper[doubt] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        still = self.upper[doubt] >= least[doubt]
        doubt, own = doubt[still], own[still]
        wide = self.upper[doubt] >= self.rest[doubt]
        used = 0
        few, own = doubt[~wide], own[~wide]
        if len(few):
            crossed = self.upper[few, None] >= self.lower[few]
            used = int(crossed.sum(axis=1).max())
            best, best_d = self.cluster[few].copy(), own.copy()
            exact = self.lower[few].copy()
            found = np.full(crossed.shape, -1, np.int64)
            for j in range(crossed.shape[1]):
                rows = np.flatnonzero(crossed[:, j])
                if not len(rows):
                    continue
                c = self.near[few[rows], j]
                d = x[few[rows]] - centroids[c]
                sq = np.einsum("ij,ij->i", d, d)
                found[rows, j] = sq
                exact[rows, j] = np.sqrt(sq.astype(np.float64)) * (1 - _SLACK)
                nearer = (sq < best_d[rows]) | ((sq == best_d[rows]) & (c < best[rows]))
                best[rows[nearer]], best_d[rows[nearer]] = c[nearer], sq[nearer]
            changed = np.flatnonzero(best != self.cluster[few])
            near = self.near[few]
            if len(changed):  # the centroid left behind takes the winner's place among the stored
                place = (near[changed] == best[changed, None]).argmax(axis=1)
                near[changed, place] = self.cluster[few[changed]]
                exact[changed, place] = np.sqrt(own[changed].astype(np.float64)) * (1 - _SLACK)
            self.near[few], self.lower[few], self.cluster[few] = near, exact, best
            self.upper[few] = np.sqrt(best_d.astype(np.float64)) * (1 + _SLACK)
        rows = doubt[wide]
        if len(rows):
            new = Bounds.scanned(x[rows], centroids, stored)
            self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows], self.rest[rows] = new.cluster, new.upper, new.near, new.lower, new.rest
            used = stored
        return used


def _round(centroids: np.ndarray, moved: np.ndarray | None, stored: int, last: bool) -> Callable:
    """Vectors with bounds after one assignment, and one row a partition with sums for each cluster."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of a partition: at most 2**37 vectors of components up to MOST fit 64 bits.
        sums, counts, inertia, used = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), [0] * k, 0
        names = [f.split()[0] for f in _STATE.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.string(), pa.binary(), pa.int32()]
        for batch in slices(batches, "x", 4 << 20, 1 << 14):
            x = matrix(batch.column("x"), dimensions)
            n = len(x)
            if moved is None:
                state = Bounds.scanned(x, centroids, stored)
                used = stored
            else:
                wide = lambda c, t: np.array(batch.column(c).flatten(), t).reshape(n, -1)  # noqa: B023, E731
                state = Bounds(np.array(batch.column("cluster"), np.int32), np.array(batch.column("upper"), np.float64), wide("near", np.int32), wide("lower", np.float64), np.array(batch.column("rest"), np.float64))
                state.move(moved, stored)
                used = max(used, state.settle(x, centroids, stored))
            d = x - centroids[state.cluster]
            far = np.einsum("ij,ij->i", d, d) if last else None
            for j in np.unique(state.cluster).tolist():
                mine = state.cluster == j
                counts[j] += int(mine.sum())
                if last:
                    inertia[j] += sum(far[mine].tolist())
                else:
                    sums[j] += x[mine].sum(axis=0)
            ragged = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), t))  # noqa: B023, E731
            empty = pa.nulls(n, pa.binary())
            columns = [batch.column("vec_id"), empty if last else batch.column("x"), pa.array(state.cluster), pa.array(state.upper), ragged(state.near, pa.int32()), ragged(state.lower, pa.float64()), pa.array(state.rest), pa.nulls(n, pa.int64()) if far is None else pa.array(far), pa.array(["vector"] * n), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if counts.any():
            total = [(j, int(counts[j]), inertia[j], sums[j].astype("<i8").tobytes()) for j in range(k) if counts[j]]
            m = len(total)
            columns = [pa.array([t[1] for t in total], pa.int64()), pa.nulls(m, pa.binary()), pa.array([t[0] for t in total], pa.int32()), *[pa.nulls(m, t) for t in kinds[3:7]], pa.array([t[2] for t in total], pa.int64()), pa.array(["sums"] * m), pa.array([t[3] for t in total], pa.binary()), pa.array([used] * m, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _unpacked(dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(p, "<i8").tolist() for p in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("vec_id"), batch.column("used"), pa.array(rows, pa.list_(pa.int64()))], names=["cluster", "n", "used", "sums"])

    return run


def _moved_to(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(centroids after the round, most bounds used): sums of partitions meet in Spark, one row a cluster and place comes back."""
    parts = state.where("kind = 'sums'").select("cluster", "vec_id", "used", "part").mapInArrow(_unpacked(centroids.shape[1]), "cluster int, n long, used int, sums array<long>")
    counts = {r["cluster"]: (int(r["n"]), r["used"]) for r in parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.max("used").alias("used")).collect()}  # a row a cluster
    places = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters times dimensions
    out = centroids.copy()
    for r in places:
        out[r["cluster"], r["at"]] = int(r["s"]) // counts[r["cluster"]][0]
    return out, max((u for _, u in counts.values()), default=0)


def cluster_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, stored: int | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Vectors of another length, null ones and those with a null or non-finite component are left out. Components
    become floor(scale * x). The first centroids are the vectors whose ids hash least (a null id hashes as empty; of equal
    hashes the lesser vector comes first), fewer than `clusters` if there are fewer vectors. Repeated rows count, and are
    returned, as often as they occur; centroids that coincide are tied and the smaller number wins. A component beyond
    MOST after scaling is an error. Other columns are not read. An empty table gives no rows.
    `stored`: lower bounds kept at first for each vector; by default a quarter of the centroids, at least three.
    """
    spark = table.sparkSession
    x = materialise(kept_vectors(table, id_col, vector_col, dimensions).mapInArrow(_stage(scale), "vec_id long, x binary"), "vectors")
    head = x.select("vec_id", "x", first_hash(F.col("vec_id"), seed).alias("h")).orderBy("h", "x").limit(clusters).collect()  # `clusters` rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not head:
        return spark.createDataFrame([], out)
    centroids = np.stack([np.frombuffer(r["x"], "<i4").astype(np.int64) for r in head])
    k = len(centroids)
    stored = min(k - 1, max(3, k // 4) if stored is None else stored)
    least = min(stored, max(1, k // 8))
    state, moved = x, None
    for i in range(rounds + 1):
        columns = ["vec_id", "x"] if moved is None else ["vec_id", "x", "cluster", "upper", "near", "lower", "rest"]
        source = state if moved is None else state.where("kind = 'vector'")
        after = materialise(source.select(*columns).mapInArrow(frugal(_round(centroids, moved, stored, i == rounds)), _STATE), "bounds", by="kind")
        discard(state)
        state = after
        if i < rounds:
            then, used = _moved_to(state, centroids)
            moved = np.sqrt(((then - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
            centroids = then
            if i:  # the first round stores for all, needed or not
                stored = max(least, min(stored, used))
    per = state.where("kind = 'sums'").groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    total = sum(r["cluster_inertia"] for r in per)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, sha[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    vectors = state.where("kind = 'vector'").select("vec_id", "cluster", "distance")
    return vectors.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # `clusters` rows
