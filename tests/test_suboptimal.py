"""Structures near the least energy, and samples that share cells."""

import math
import random

from pyspark.sql import functions as F

from strandspark.operators import fold, traceback
from strandspark.queries import plain
from strandspark.sources.params import KT, packaged

MOLECULES = [("hairpin", "GCGAAAGCAUGC"), ("two strands", "CGAAACG+CGUAAACG"), ("letter", "A"), ("two", "GC"), ("none", ""), (None, "GGGAAACCC"), ("hairpin again", "GCGAAAGCAUGC")]


def test_within_a_bound_are_the_enumerated_structures_of_that_energy(spark):
    p = plain()
    mols = fold.linear(spark.createDataFrame(MOLECULES, "mol_id string, sequence string"))
    filled = fold.fill(mols, p, full=True)
    log_z = {r["mol_id"]: r["log_z"] for r in filled.select("mol_id", "log_z").collect()}
    every: dict = {}
    for r in traceback.enumerate_structures(filled, p, full=True).collect():
        every.setdefault(r["mol_id"], {})[r["structure"]] = -KT * (math.log(r["p"]) + log_z[r["mol_id"]])
    for kcal in (0.0, 3.0, 50.0):
        got: dict = {}
        for r in traceback.within(mols, p, kcal).collect():
            got.setdefault(r["mol_id"], {})[r["structure"]] = r["dg"]
        assert got.pop("none") == {"": 0.0}
        assert got.keys() == every.keys()
        for name, own in every.items():
            want = {s: g for s, g in own.items() if g <= min(own.values()) + kcal + 1e-9}
            assert got[name].keys() == want.keys()
            assert all(abs(got[name][s] - want[s]) < 1e-9 for s in want)


def test_within_a_bound_of_a_natural_length(spark):
    p = packaged("v0.31").without_coax()
    letters = random.Random(4)
    mols = fold.linear(spark.createDataFrame([("x", "".join(letters.choice("ACGU") for _ in range(60)))], "mol_id string, sequence string"))
    least = traceback.best(mols, p, simple=True).first()
    near, far = ({r["structure"]: r["dg"] for r in traceback.within(mols, p, kcal, simple=True).collect()} for kcal in (0.3, 0.8))
    assert near[least["structure"]] == min(far.values()) and abs(min(near.values()) - least["dg"]) < 1e-9
    assert near == {s: g for s, g in far.items() if g <= least["dg"] + 0.3} and len(far) > len(near)


def test_samples_share_cells_and_keep_their_shares(spark):
    p = plain()
    mols = fold.linear(spark.createDataFrame(MOLECULES, "mol_id string, sequence string"))
    filled = fold.fill(mols, p, full=True).select("mol_id", "n", "lig", "nicks", "forced", "types", "motifs", "par", "cells", "log_z").cache()
    count = 2000
    drawn = traceback.samples(filled, p, count, seed=5, full=True)
    rows = drawn.groupBy("mol_id", "structure").agg(F.count("*").alias("c")).collect()
    shares = {(r["mol_id"], r["structure"]): r["p"] for r in traceback.enumerate_structures(filled, p, full=True).collect()} | {("none", ""): 1.0}
    seen = {(r["mol_id"], r["structure"]): r["c"] / count for r in rows}
    assert seen.keys() <= shares.keys()
    assert all(abs(seen.get(k, 0.0) - v) < 5 * math.sqrt(v * (1 - v) / count) + 1e-9 for k, v in shares.items())
    assert {r["c"] for r in drawn.groupBy("mol_id").agg(F.countDistinct("sample").alias("c")).collect()} == {count}
    # A sample does not hang on how many others are drawn.
    few = {(r["mol_id"], r["sample"], r["structure"]) for r in traceback.samples(filled, p, 40, seed=5, full=True).collect()}
    assert few == {(r["mol_id"], r["sample"], r["structure"]) for r in drawn.filter("sample < 40").collect()}
