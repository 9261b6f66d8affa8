"""Centroids against Lloyd's rounds in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandspark.llm import kmeans


def lloyd(rows, k, rounds, size):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)}
    cs = [v[i] for i in sorted(v, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        of = {i: min(range(len(cs)), key=lambda c: (far(x, cs[c]), c)) for i, x in v.items()}
        if n < rounds:
            cs = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v[i] for i in v if of[i] == c]) else old for c, old in enumerate(cs)]
    return {i: (of[i], far(x, cs[of[i]]), hashlib.sha256(",".join(map(str, cs[of[i]])).encode()).hexdigest()) for i, x in v.items()}


@pytest.mark.parametrize(("k", "spread"), [(8, 0.1), (3, 0.9), (1, 0.2), (8, 0.0)])
def test_clusters_are_those_of_plain_rounds(spark, k, spread):
    r = random.Random(k)
    heads = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + r.uniform(-spread, spread) for x in heads[i % 6]]) for i in range(240)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(60)] + [(2000, None), (2001, [0.1]), (2002, [0.0, None, 0.0, 0.0]), (2003, [math.inf, 0.0, 0.0, 0.0]), (2004, [math.nan] * 4), (2005, []), (2006, [0.0] * 4)]
    table = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id long, embedding array<double>, v int, cluster string").repartition(5)
    got = {x["vec_id"]: x for x in kmeans.cluster(table, k=k, rounds=6, size=4).collect()}
    want = lloyd(rows, k, 6, 4)
    assert {i: (x["cluster"], x["distance"], x["centroid_sha256"]) for i, x in got.items()} == want
    for c in {w[0] for w in want.values()}:
        assert {x["cluster_inertia"] for x in got.values() if x["cluster"] == c} == {sum(w[1] for w in want.values() if w[0] == c)}
    assert {x["inertia"] for x in got.values()} == {sum(w[1] for w in want.values())}
    assert {x["v"] for x in got.values()} == {7}


def test_bounds_save_scans_and_stay_right():
    rng = np.random.default_rng(1)
    heads = rng.integers(-900, 900, (8, 16))
    v = (heads[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int64)
    cs, drift = v[:8].copy(), np.zeros(8)
    cluster, upper, lower, scans = np.zeros(4000, np.int32), np.full(4000, np.inf), np.zeros(4000), []
    for _ in range(10):
        scans.append(kmeans.assign(v, cluster, upper, lower, cs, drift))
        d = kmeans.distances(v, cs)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(len(d)), cluster])
        d[np.arange(len(d)), cluster] = 1 << 60
        assert (upper >= own * (1 - 1e-12)).all()
        assert (lower <= np.sqrt(d.min(1)) * (1 + 1e-12)).all()
        now = np.array([v[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else cs[c] for c in range(8)])
        drift, cs = np.sqrt(((now - cs) ** 2).sum(1).astype(float)) * (1 + kmeans.MARGIN), now
    assert scans[0] > 3900  # a vector on its own centroid needs none
    assert sum(scans[1:]) < 9 * 4000 / 4


def test_empty_and_few(spark):
    table = spark.createDataFrame([(None, [0.5, 0.5], "a"), (None, [0.5, 0.5], "a"), (2, [0.0, -0.5], "b")], "vec_id long, embedding array<float>, note string")
    got = kmeans.cluster(table, size=2, rounds=2)
    assert sorted((r["vec_id"] or 0, r["distance"], r["note"]) for r in got.collect()) == [(0, 0, "a"), (0, 0, "a"), (2, 0, "b")]
    assert kmeans.cluster(table.filter("false"), size=2).columns == got.columns
    assert kmeans.cluster(table, size=64).count() == 0
    with pytest.raises(Exception, match="too large"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), size=2).count()
