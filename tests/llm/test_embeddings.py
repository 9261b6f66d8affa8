"""Embeddings with null and repeated keys, ties and clashing columns, and what a kept row is."""

import numpy as np
from pyspark.sql import functions as F

from strandspark.llm import embeddings


def test_odd_keys_and_columns(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(3, 4))
    rows = [(k, [float(x) for x in base[k % 3] + r.normal(size=4) * 0.02]) for k in range(12)]
    rows += [(None, rows[0][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (20, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("k", "v", "a", "b", "n", "rep", "n_links", "kept", "_kept")})
    got = embeddings.near_duplicates(table).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["vec_id"], []).append(x)
    assert {x["component_id"] for k in (0, 3, 6, 9) for x in by[k]} == {0}
    assert {x["n_links"] for x in by[3]} == {5}  # three others and two rows of its own
    assert {(x["n_links"], x["component_id"], x["kept"]) for x in by[20]} == {(0, 20, True)}
    assert {(x["n_links"], x["component_id"], x["kept"]) for x in by[None]} == {(0, None, False)}
    kept = embeddings.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((x["vec_id"] for x in kept.collect()), key=lambda k: (k is None, k)) == [0, 1, 2, 20, None, None]
    assert embeddings.keep_one(table.filter("false")).count() == 0


def test_equal_vectors_cost_what_one_does(spark):
    table = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding"))
    got = embeddings.near_duplicates(table).groupBy("n_links", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1499, 0, False, 1499), (1499, 0, True, 1), (1499, 1, False, 1499), (1499, 1, True, 1)]
