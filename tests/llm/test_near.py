"""Near copies against all pairs, and in the pipeline's stage."""

import random

import numpy as np
import xxhash

import corpus_pipeline
from strandspark.llm import near


def test_stage_drops_edited_copies(spark):
    r = random.Random(4)
    rows, root = [], {}
    for k in range(0, 300, 10):
        ws = [f"w{r.randrange(5000)}" for _ in range(200)]
        for j in range(10):
            own = list(ws)
            for at in r.sample(range(200), r.choice((0, 1, 2, 4, 9, 30))):
                own[at] = f"x{r.randrange(5000)}"
            rows.append((k + j, " ".join(own)))
            root[k + j] = k + j
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (None, "one two"), (904, "one two three")]
    root |= {900: 900, 901: 900, 902: 902, 903: 902, 904: 904}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(k, near.shingles(t)) for k, t in rows if k is not None and k < 900]
    for a, x in own:
        for b, y in own:
            if a < b and near.jaccard(x, y) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted({find(x) for x in root})
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_no_pair_of_a_family_is_lost(spark):
    r = random.Random(6)
    template = list(range(800))
    rows, planted = [], []
    for k in range(1500):
        base = template + [10_000 + 1000 * k + j for j in range(170)]  # Jaccard about 0.70 with other pairs
        a, b = ([x for x in base if r.random() > 0.03] + [5_000_000 + 100 * (2 * k + s) + j for j in range(30)] for s in (0, 1))
        for s, own in enumerate((a, b)):
            hashes = np.unique(np.array([xxhash.xxh64_intdigest(str(x), 42) for x in own], np.uint64))
            rows.append((2 * k + s, len(hashes), near.bands(hashes).tolist(), bytearray(np.sort(hashes.astype("<u4")).tobytes())))
        planted.append((2 * k, 2 * k + 1))
    assert min(near.jaccard(*(np.unique(np.frombuffer(bytes(rows[x][3]), "<u4")) for x in p)) for p in planted) >= 0.8
    of = spark.createDataFrame(rows, "fp long, n long, bands array<long>, shingles binary").repartition(8)
    edges = near.links(of).collect()
    top = {x["fp"]: x["root"] for x in near._roots(of, 0.8, spark.createDataFrame([(4, 9)], "u long, v long")).collect()}
    assert all(top[a] == top[b] for a, b in [*planted, (4, 9)])
    root = {x[0]: x[0] for x in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in edges:
        root[find(e["u"])] = find(e["v"])
    assert all(find(a) == find(b) for a, b in planted)
    assert len(edges) < 10 * len(rows)
