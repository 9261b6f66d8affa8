"""Molecules beyond the range of doubles, structures of least energy, and many parameter sets in one plan."""

import math
import random

import pytest

from strandspark.operators import fold, observables, scoring, traceback, training
from strandspark.sources.params import packaged, resolve

DDL = "mol_id string, strands array<string>, circle boolean"


def test_energies_beyond_the_range_of_doubles(spark):
    r = random.Random(8)
    arms = "G" * 136 + "AAAA" + "C" * 136
    rows = [("hairpin", [arms], False), ("random", ["".join(r.choice("ACGU") for _ in range(300))], False), ("with_tail", [arms + "A" * 24], False)]
    got = {x["mol_id"]: x for x in fold.partition(spark.createDataFrame(rows, DDL).repartition(3, "mol_id"), packaged("v0.31"), simple=True).collect()}
    assert all(math.isfinite(x["dg"]) and math.isfinite(x["log_z"]) for x in got.values())
    assert got["hairpin"]["log_z"] > 709
    assert got["hairpin"]["z"] == math.inf
    assert got["with_tail"]["log_z"] >= got["hairpin"]["log_z"]  # the tail can stay unpaired


def test_probabilities_slopes_and_structures_of_a_long_hairpin(spark):
    p = packaged("minimal").without_coax()
    n = 62
    filled = fold.fill(spark.createDataFrame([("a", ["C" * n + "N" + "G" * n], False)], DDL), p, full=True).cache()
    x = filled.select("log_z", "dg").first()
    assert x["log_z"] > 709
    assert math.isfinite(x["dg"])
    probabilities = observables.bpp(filled, p).collect()
    assert max(y["p"] for y in probabilities) <= 1 + 1e-9
    assert sum(y["p"] for y in probabilities if y["i"] + y["j"] == 2 * n) > 0.99 * n
    slopes = {y["tag"]: y["dlogz_dlogp"] for y in observables.log_derivatives(filled, p, ["Kd_CG", "C_eff_stacked_pair"]).collect()}
    assert slopes["Kd_CG"] == pytest.approx(-n, rel=1e-2)
    assert slopes["C_eff_stacked_pair"] == pytest.approx(n - 1, rel=1e-2)
    assert traceback.mfe(filled, p, full=True).first()["structure"] == "(" * n + "." + ")" * n
    filled.unpersist()


def test_structures_of_least_energy_are_the_best_of_all(spark):
    r = random.Random(3)
    rows = [(f"m{k}", ["".join(r.choice("ACGU") for _ in range(n))], False) for k, n in enumerate([1, 2, 5, 8, 10, 12, 13, 13, 14, 14])]
    rows += [("two", ["GGCAG", "CGAACC"], False), ("three", ["GGCA", "UGCAG", "CUCC"], False), ("none", [], False), ("apart", ["AAA", "AAA"], False)]
    mols = spark.createDataFrame(rows, DDL)
    plain = resolve([("min_loop_length", "3"), ("Kd_CG", "0.002"), ("Kd_AU", "0.02"), ("Kd_GU", "0.2"), ("C_init", "1.5"), ("l", "0.5"), ("l_BP", "0.2"), ("C_eff_stacked_pair", "10"), ("C_eff_motif_NN_NNN", "0.7"), ("C_eff_motif_NNNNN", "0.05"), ("C_eff_motif_NGNAN", "0.9")])
    for p in (plain, packaged("v0.31")):
        filled = fold.fill(mols, p).cache()
        every: dict[str, dict[str, float]] = {}
        for x in traceback.enumerate_structures(filled, p).join(filled.select("mol_id", "log_z"), "mol_id").collect():
            every.setdefault(x["mol_id"], {})[x["structure"]] = math.log(x["p"]) + x["log_z"]
        got = {x["mol_id"]: x for x in traceback.best(mols, p).collect()}
        assert "apart" not in got  # no complex of the two is possible
        for name, own in every.items():
            top = max(own.values())
            if name in got and own:
                assert got[name]["dg"] == pytest.approx(-fold.KT * top, abs=1e-9), name
                assert own[got[name]["structure"]] == pytest.approx(top, abs=1e-9), name
        assert set(every) - {"none"} <= set(got)
        filled.unpersist()
    with pytest.raises(Exception, match="circle"):
        traceback.best(spark.createDataFrame([("c", ["CNNNGNN"], True)], DDL), packaged("minimal")).collect()


def test_parameter_sets_as_rows(spark):
    p = packaged("v0.31")
    r = random.Random(1)
    mols = spark.createDataFrame([(f"m{k}", ["".join(r.choice("ACGU") for _ in range(16))], False) for k in range(6)] + [("none", [], False)], DDL)
    sets = [p, p.updated({"l": 0.3}), p.updated({"Kd_CG": 10.0, "C_eff_motif_NNNNN": 5.0})]
    got = {(x["mol_id"], x["set"]): x["log_z"] for x in fold.partition(mols, p, sets=sets).collect()}
    assert len(got) == 21
    for k, own in enumerate(sets):
        assert {x["mol_id"]: pytest.approx(x["log_z"], abs=1e-12) for x in fold.partition(mols, own).collect()} == {m: v for (m, s), v in got.items() if s == k}
    with pytest.raises(ValueError, match="shapes"):
        fold.partition(mols, p, sets=[p, packaged("minimal")])


def test_all_slopes_of_a_set_are_one_plan(spark):
    p = packaged("v0.31")
    ex = spark.createDataFrame([("a", ["GGGAAAAUCC"], False, "((......))"), ("b", ["GGCGAAAGCC"], False, "(((....)))")], "mol_id string, strands array<string>, circle boolean, structure string")
    tags = [t for t in p.values if not t.startswith("C_eff_stack_")]  # a stack that is given twice, mirrored, is worth its last value
    many = training.losses(ex, p, training.shifted(p, tags, 1e-5))
    one = training.losses(ex, p, [p])
    size = lambda df: df._jdf.queryExecution().optimizedPlan().treeString().count("Generate")
    assert size(many) == size(one)
    got = training.slope_check(ex, p, tags).collect()
    assert {x["tag"] for x in got} >= {"l", "l_BP", "C_init", "Kd_CG"}
    assert all(x["slope"] == pytest.approx(x["numeric"], abs=1e-4) for x in got)


def test_training_goes_on_where_it_was_stopped(spark, tmp_path):
    p = packaged("v0.18").without_coax()
    ex = spark.createDataFrame([("a", ["GGGAAAUCC"], False, "((.....))", 2), ("b", ["GGCGAAAGCC"], False, "(((....)))", 1)], "mol_id string, strands array<string>, circle boolean, structure string, copies int")
    tags = ["C_init", "l"]
    whole, trace = training.train(ex, p, tags, steps=2)
    path = str(tmp_path / "trace")
    training.train(ex, p, tags, steps=1, path=path)
    again, resumed = training.train(ex, p, tags, steps=2, path=path)
    assert {t: again.values[t] for t in tags} == pytest.approx({t: whole.values[t] for t in tags}, rel=1e-9)
    assert [y for y, *_ in resumed] == pytest.approx([y for y, *_ in trace])
    rows = spark.read.parquet(path).filter("accepted")
    assert rows.count() == rows.select("run", "step", "tag").distinct().count() == 2 * len(trace)
    assert spark.read.parquet(path).filter("not accepted").count() > 0
    assert training.recorded(spark, path, "other", tags) == []
    with pytest.raises(ValueError, match="other tags"):
        training.recorded(spark, path, "run", ["l"])
    weighted = training.losses(ex, p, [p], "copies").first()
    assert weighted["examples"] == 3
    each = {x["mol_id"]: x["dg_gap"] for x in training.gaps(ex.drop("copies"), p).collect()}
    assert weighted["loss"] == pytest.approx(2 * each["a"] + each["b"])
    assert scoring.score(ex.drop("copies"), p, sets=[p, p]).count() == 4
