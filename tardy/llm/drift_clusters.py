"""Centroid clustering with geometric drift tightening, exact to the last tie.

Lloyd rounds over integer vectors. A vector keeps an upper bound on the distance
to its own centroid and one lower bound on the distance to every other centroid.
When centroids move, the upper bound grows by its centroid's drift. The lower
bound of a cluster's vectors shrinks by less than the largest drift: all of them
lie in a sphere (old centroid, largest upper bound; 16 shells of it are taken
apart), and for each other centroid ``drift_bound`` bounds by plane geometry how
much nearer it can have come to any point of that sphere. A vector whose upper bound stays under its lower bound (or
under half the way to the nearest other centroid) keeps its cluster; the others
are ambiguous, and all centroids are scanned exactly for them.

Each round is one pass over the vectors in Arrow batches, written as a table that
holds the bounds too; the table before it is removed once it is read for the last
time. Centroid sums are kept as exact integers and changed by the vectors that
changed cluster. To the driver come ``k`` rows of sums and radii a round; ``k``
centroids go out with the tasks. No vectors meet in one task: batches are
independent, so equal vectors and clusters of any size do no harm.

Defined results: rows whose vector is null, of another length, or holds a null or
non-finite component are left out; a repeated row counts each time; a null
``vec_id`` counts as an empty number in the start order, whose ties go by the
components; fewer kept vectors than ``k`` are all start centroids; equal distances
go to the smaller number; an empty table gives no rows. A scaled component beyond
2**27 fails the job, as its squared distances need not fit a long. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_scratch, remove_scratch, write_scratch

#: Largest scaled component: 64 squared differences of this size fit a long.
LARGEST = 1 << 27
#: Levels of a cluster's radius for which the bounds are taken apart.
SHELLS = 16
#: Bounds are compared with this relative margin, far over rounding errors.
MARGIN = 1e-9
STATE = "vec_id bigint, x array<int>, cluster int, before int, upper double, lower double, scanned boolean"


def scaled_vectors(table: DataFrame, vector: str, vec_id: str, dim: int, scale: int) -> DataFrame:
    """``vec_id`` and ``x``, the integers floor(scale * component), of the rows
    that hold exactly ``dim`` finite components."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        s = F.floor(c * F.lit(float(scale)))
        far = F.raise_error(F.lit("a scaled component exceeds 2**27"))
        return F.when(F.abs(c) * float(scale) <= LARGEST - 1, s).otherwise(far).cast("int")

    return table.where((F.size(vector) == dim) & finite).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(v, whole).alias("x"))


def start_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def drift_bound(near: np.ndarray, radius: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each of several radii: no point of the sphere (``near``, radius) that
    is at least as near to ``near`` as to ``old`` is nearer to ``new`` than to
    ``old`` by more than this.

    By symmetry about the line of the move, sphere and bisector are a disk and a
    line in a half plane whose origin is ``old`` and whose axis is the move. Seen
    from ``old``, the points of the cut disk are at least ``phi - beta`` off the
    axis: phi is the angle of ``near``, and beta the half width, that of the
    tangent (arcsin radius/away) or, where the bisector cuts nearer, that of the
    corner at which both distances are the radius (arccos away/2radius). Along
    the move a point's distance falls at the rate of the cosine of its angle,
    which only falls further on, so it falls by at most drift * cos(phi - beta):
    less than the drift, and below zero if the move leads away from the whole
    disk."""
    move = (new - old).astype(float)
    drift = float(np.sqrt(move @ move))
    to = (near - old).astype(float)
    away = float(np.sqrt(to @ to))
    if drift == 0.0 or away == 0.0:
        return np.full(len(radius), drift)
    phi = float(np.arccos(np.clip((to @ move) / (away * drift), -1.0, 1.0)))
    wide = away < np.sqrt(2.0) * radius
    with np.errstate(divide="ignore"):
        beta = np.where(wide, np.arccos(np.minimum(away / (2.0 * radius), 1.0)), np.arcsin(np.minimum(radius / away, 1.0)))
    by_angle = drift * np.cos(np.clip(phi - beta, 0.0, np.pi))
    # (|x-old|^2 - |x-new|^2) / (|x-old| + |x-new|) over the disk.
    along = float(to @ move) / drift + radius
    other = near.astype(float) - new
    widths = away + float(np.sqrt(other @ other)) - 2.0 * radius
    by_ratio = drift * np.maximum(2.0 * along - drift, 0.0) / np.maximum(drift, widths)
    return np.minimum(np.minimum(by_angle, by_ratio), drift)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[cluster, shell]: by how much the distance to any other centroid can have
    shrunk for the cluster's vectors whose upper bound is in the shell."""
    k = len(old)
    levels = radius[:, None] * (np.arange(SHELLS) + 1.0) / SHELLS
    loose = np.zeros((k, SHELLS))
    for i in range(k):
        bounds = [drift_bound(old[i], levels[i], old[j], new[j]) for j in range(k) if j != i]
        if bounds:
            loose[i] = np.max(bounds, axis=0)
    return loose + MARGIN * (np.abs(loose) + 1.0)


def shells(upper: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The number of the shell whose level is the next at or above ``upper``."""
    return np.clip(np.ceil(upper / radius * SHELLS * (1.0 + MARGIN)).astype(np.int64) - 1, 0, SHELLS - 1)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    c = centroids.astype(float)
    d = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1) / 2.0


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to all centroids."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest * largest * max(x.shape[1], 1) * 4 < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    return d.astype(np.int64)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its cluster."""
    d = x.astype(np.int64) - centroids[cluster]
    return (d * d).sum(axis=1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _assigner(dim: int, centroids: np.ndarray, drift: np.ndarray | None, loose: np.ndarray | None, cover: np.ndarray | None, exact: bool):
    """A pass over Arrow batches. ``drift``, ``loose`` and ``cover`` (the clusters'
    radii) are None in the first round, when every vector is scanned. ``exact``: ``upper`` gets the squared
    distance itself (the last pass)."""
    half = gaps(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.int64)
            if drift is None:
                cluster, before = np.zeros(n, dtype=np.int32), None
                upper, lower = np.zeros(n), np.zeros(n)
                unsure = np.arange(n)
            else:
                cluster = _column(batch, "cluster").astype(np.int32)
                before = cluster.copy()
                upper = _column(batch, "upper")
                lower = _column(batch, "lower") - loose[cluster, shells(upper, cover[cluster])]
                upper = upper + drift[cluster]
                bound = np.maximum(lower, half[cluster])
                unsure = np.flatnonzero(~(upper + MARGIN * (upper + bound + 1.0) < bound))
                if len(unsure):  # the distance itself may still settle it
                    upper[unsure] = np.sqrt(own_distances(x[unsure], centroids, cluster[unsure]))
                    u, b = upper[unsure], bound[unsure]
                    unsure = unsure[~(u + MARGIN * (u + b + 1.0) < b)]
            if len(unsure):
                d = squared_distances(x[unsure], centroids)
                best = d.argmin(axis=1)  # the first of equal ones
                rows = np.arange(len(unsure))
                cluster[unsure] = best
                upper[unsure] = np.sqrt(d[rows, best])
                if d.shape[1] > 1:
                    d[rows, best] = np.iinfo(np.int64).max
                    lower[unsure] = np.sqrt(d.min(axis=1))
                else:
                    lower[unsure] = np.inf
            scanned = np.zeros(n, dtype=bool)
            scanned[unsure] = True
            columns = [batch.column("vec_id")]
            if exact:
                columns += [pa.array(cluster), pa.array(own_distances(x, centroids, cluster)), pa.array(scanned)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "scanned"])
            else:
                was = pa.nulls(n, pa.int32()) if before is None else pa.array(before)
                columns += [batch.column("x"), pa.array(cluster), was, pa.array(upper), pa.array(lower), pa.array(scanned)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "before", "upper", "lower", "scanned"])

    return run


def _changes(k: int, dim: int):
    """Per task and cluster: its largest ``upper`` and, as one array, by how much
    its vectors' number and componentwise sums have changed, and how many of its
    vectors were scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, radius = np.zeros((k, dim + 2), dtype=np.int64), np.full(k, -1.0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.int64)
            cluster = _column(batch, "cluster").astype(np.int64)
            before = batch.column("before").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            np.maximum.at(radius, cluster, _column(batch, "upper"))
            change[:, dim + 1] += np.bincount(cluster, weights=_column(batch, "scanned"), minlength=k).astype(np.int64)
            moved = np.flatnonzero(cluster != before)
            left = moved[before[moved] >= 0]
            for rows, at, sign in ((moved, cluster, 1), (left, before, -1)):
                change[:, dim] += sign * np.bincount(at[rows], minlength=k)
                np.add.at(change[:, :dim], at[rows], sign * x[rows])
        if (radius >= 0).any():
            columns = [pa.array(np.arange(k, dtype=np.int32)), pa.array(radius), pa.array(list(change), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "radius", "change"])

    return run


def _round_changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' changes and radii put together: k rows of dim + 2 numbers."""
    parts = state.mapInArrow(_changes(k, dim), "cluster int, radius double, change array<bigint>")
    each = parts.select("cluster", "radius", F.posexplode("change").alias("p", "v")).groupBy("cluster", "p")
    change, radius = np.zeros((k, dim + 2), dtype=np.int64), np.zeros(k)
    for r in each.agg(F.max("radius").alias("r"), F.sum("v").alias("v")).collect():
        change[r["cluster"], r["p"]] = r["v"]
        radius[r["cluster"]] = max(r["r"], 0.0)
    return change, radius


def cluster_vectors(
    table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``vec_id``, ``cluster``, ``distance`` (squared) and ``scanned`` of every
    kept vector after ``rounds`` rounds and a last assignment, as a written table;
    the final centroids; and how many vectors each round scanned in full."""
    spark = table.sparkSession
    vectors_at = write_scratch(scaled_vectors(table, vector, vec_id, dim, scale), "cluster_vectors")
    vectors = read_scratch(spark, vectors_at)
    centroids = start_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, scanned boolean"), np.zeros((0, dim), dtype=np.int64), []
    count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    state, state_at, drift, loose, cover, scans = vectors, vectors_at, None, None, None, []
    for _ in range(rounds):
        at = write_scratch(state.mapInArrow(_assigner(dim, centroids, drift, loose, cover, False), STATE), "cluster_state")
        remove_scratch(spark, state_at)
        state, state_at = read_scratch(spark, at), at
        change, radius = _round_changes(state, k, dim)
        count += change[:, dim]
        total += change[:, :dim]
        scans.append(int(change[:, dim + 1].sum()))
        radius = radius * (1.0 + MARGIN) + MARGIN
        moved = centroids.copy()
        filled = count > 0
        moved[filled] = total[filled] // count[filled, None]  # floor, also below zero
        way = (moved - centroids).astype(float)
        drift = np.sqrt((way * way).sum(axis=1)) * (1.0 + MARGIN)
        loose = loosening(centroids, moved, radius)
        cover = radius
        centroids = moved
    last = state.mapInArrow(_assigner(dim, centroids, drift, loose, cover, True), "vec_id bigint, cluster int, distance bigint, scanned boolean")
    done = read_scratch(spark, write_scratch(last, "clusters"))
    remove_scratch(spark, state_at)
    return done, centroids, scans


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``. The joined
    table has a row per cluster: ``k`` bounds what is broadcast."""
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r["s"]) for r in per)
    rows = [(r["cluster"], int(r["s"]), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
