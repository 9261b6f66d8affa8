"""FTRL-proximal against its update rule written out letter by letter, and scores of odd texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import toxicity


def plain(rows, alpha, beta, l1, l2, bias):
    """Weights by the rule: one number at a time."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == bias:
            return -zi / ((beta + math.sqrt(ni)) / alpha)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    for xs, y in rows:
        own = [*xs, bias]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            ni = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * w[i]
            n[i] = ni + g * g
    return {i: weight(i) for i in z}


def test_weights_are_those_of_the_rule():
    r = random.Random(5)
    rows = [(sorted(r.sample(range(40), r.randrange(0, 12))), float(r.random() < 0.4)) for _ in range(300)]
    model = toxicity.Ftrl(bits=6, alpha=0.7, l1=0.8)
    for xs, y in rows:
        model.learn(np.array(xs, np.int64), y)
    at, w = model.weights()
    got, want = dict(zip(at.tolist(), w.tolist(), strict=True)), plain(rows, 0.7, 1.0, 0.8, 0.1, 64)
    assert {i for i, x in want.items() if x} == set(got)
    assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_rows_are_learned_whatever_their_order_and_columns(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["sun", "tree", "road"]) for _ in range(15)) + (" scum" * 3 if k % 3 == 0 else "")) for k in range(300)] + [(400, None), (401, ""), (None, "scum"), (402, "tree " * 200_000), (5, "sun")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "x", "y", "k", "_score")})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int").withColumn("text", F.lit("own"))
    a, b = (sorted((str(x["doc_id"]), x["held_out"], x["score"], x["predicted"]) for x in toxicity.predict(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert a == b
    assert len(a) == len(rows)
    assert {x[3] for x in a if x[0] in ("400", "401", "402")} == {0}
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} >= {k for k in range(300) if k % 3} | {400, 401, 402}
