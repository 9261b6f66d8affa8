"""Centroid clustering in integers, with Hamerly's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import cut, discard, literal_table

#: Scaled components are below this, so that 64 squares of their differences fit into a long.
LIMIT = 1 << 27
#: Bounds are sums of rounded roots; they must be apart by this share of their size to be trusted.
MARGIN = 1e-9
STATE = "v array<long>, cluster int, was int, upper double, lower double"


def scaled(rows: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    """rows whose vector has exactly size components, none null or not finite, with v: each component times scale, rounded down. Components beyond LIMIT would overflow the distances and raise an error."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    fine = F.coalesce((F.size(vector) == size) & ~F.exists(vector, lambda c: F.isnull(c) | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))
    small = F.when(F.forall(vector, lambda c: F.abs(c.cast("double")) * scale < LIMIT), x).otherwise(F.raise_error(F.lit("a component is too large to be squared in a long")).cast("array<long>"))
    return rows.filter(fine).withColumn("v", small)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid, in 64-bit integers."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> int:
    """Brings cluster, upper (at least the distance to the own centroid) and lower (at most that to any other) up to date, in place, after centroids moved by drift; the number of full scans.

    A vector whose upper bound stays below its lower one, or below half the way from its centroid to the next, is
    where it was. Otherwise its own distance is computed, and only if that does not settle it, all of them.
    """
    k = len(centroids)
    if k > 1:
        far = np.array([np.delete(drift, c).max() for c in range(k)])
        between = np.sqrt(distances(centroids, centroids).astype(float))
        half = np.array([np.delete(between[c], c).min() / 2 for c in range(k)])
        upper += drift[cluster]
        lower -= far[cluster]
        bound = np.maximum(lower, half[cluster])
    else:
        bound = np.full(len(v), np.inf)
    unsure = np.flatnonzero(~(upper * (1 + MARGIN) < bound * (1 - MARGIN)))
    if len(unsure):
        off = v[unsure] - centroids[cluster[unsure]]
        upper[unsure] = np.sqrt((off * off).sum(1).astype(float))
        unsure = unsure[~(upper[unsure] * (1 + MARGIN) < bound[unsure] * (1 - MARGIN))]
    if len(unsure):
        d = distances(v[unsure], centroids)
        best = d.argmin(1)  # the first of equal ones
        upper[unsure] = np.sqrt(d[np.arange(len(d)), best].astype(float))
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        lower[unsure] = np.sqrt(d.min(1).astype(float)) if k > 1 else np.inf
        cluster[unsure] = best
    return len(unsure)


def _pass(rows: DataFrame, keep: list[str], centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """rows with their bounds and clusters brought up to date."""

    def run(batches):
        for b in batches:
            v, cluster = _matrix(b.column("v")), b.column("cluster").to_numpy().copy()
            upper, lower = (b.column(c).to_numpy().copy() for c in ("upper", "lower"))
            was = cluster.copy()
            if b.num_rows:
                assign(v, cluster, upper, lower, centroids, drift)
            first = np.isinf(b.column("upper").to_numpy())  # of no cluster so far
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("v"), pa.array(cluster, pa.int32()), pa.array(np.where(first, -1, was), pa.int32()), pa.array(upper), pa.array(lower)], [*keep, "v", "cluster", "was", "upper", "lower"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), STATE]))


def _moved(rows: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much each cluster's sum and count changed: only vectors that changed their cluster are added up, first within tasks. k * (size + 1) numbers come to the driver."""

    def run(batches):
        s, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = _matrix(b.column("v")) if b.num_rows else np.zeros((0, size), np.int64)
            for c, sign in (("cluster", 1), ("was", -1)):
                own = b.column(c).to_numpy()
                for x in np.unique(own[own >= 0]):
                    s[x] += sign * v[own == x].sum(0)
                    n[x] += sign * int((own == x).sum())
        both = np.column_stack([s, n])
        a, d = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(both[a, d])], ["c", "d", "x"])

    got = rows.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "c int, d int, x long").groupBy("c", "d").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((k, size + 1), np.int64)
    for r in got:
        out[r["c"], r["d"]] = r["x"]
    return out[:, :-1], out[:, -1]


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """rows that scaled() keeps, without vector, with cluster, distance, cluster_inertia, inertia and centroid_sha256; columns of these names are replaced.

    Lloyd's rounds from the k vectors of the smallest hashes (equal ones by their components), exact in integers. Each
    vector's bounds are written with it after every round, so that a lost executor costs a reread, and the round before
    is deleted then; sums change by the vectors that moved alone. An empty cluster keeps its centroid. Fewer than k
    vectors give fewer clusters, none an empty table. A null key is hashed as an empty one; repeated rows count singly.
    """
    spark = rows.sparkSession
    own = rows.drop(*(c for c, _ in _COLUMNS if c != vector.lower()))
    others = [c for c in own.columns if c.lower() != vector.lower()]
    keep = [f"_{n}" for n in range(len(others))]  # no clash with the names used within
    by = keep[[c.lower() for c in others].index(key.lower())]
    fitting = scaled(own.select(*(F.col(c).alias(n) for c, n in zip(others, keep, strict=True)), F.col(vector).alias("_x")), "_x", size, scale).select(*keep, "v")
    state = cut(fitting.withColumns({"cluster": F.lit(0), "was": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}))
    seeds = state.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(by).cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    if not seeds:
        return own.filter("false").select(*others, *(F.lit(None).cast(t).alias(c) for c, t in _COLUMNS))
    centroids = np.array([r["v"] for r in seeds], np.int64)
    drift, sums, counts = np.zeros(len(centroids)), np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        before, state = state, cut(_pass(state, keep, centroids, drift))
        discard(before)
        s, n = _moved(state, len(centroids), size)
        sums, counts = sums + s, counts + n
        now = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        drift, centroids = np.sqrt(((now - centroids) ** 2).sum(1).astype(float)) * (1 + MARGIN), now
    last = cut(_pass(state, keep, centroids, drift))
    discard(state)
    final = F.array(*[F.array(*[F.lit(int(x)) for x in c]).cast("array<long>") for c in centroids])
    apart = F.aggregate(F.zip_with("v", F.get(final, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, x: a + x)
    told = last.select(*keep, "cluster", apart.alias("distance"))
    inertia = {r[0]: r[1] for r in told.groupBy("cluster").agg(F.sum("distance")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = literal_table(spark, [(c, inertia.get(c, 0), sum(inertia.values()), digest(x)) for c, x in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(of), "cluster").select(*keep, *(c for c, _ in _COLUMNS)).toDF(*others, *(c for c, _ in _COLUMNS))


_COLUMNS = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))
