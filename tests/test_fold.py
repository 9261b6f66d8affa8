"""Partition functions with closed forms, and what follows from them."""

import math

import pytest
from pyspark.sql import functions as F

from strandspark.operators import candidates, defects, fold, observables, scoring, traceback, training
from strandspark.sources.params import MINIMAL, check_stacks, packaged, resolve

#: The minimal set's numbers and the closed forms of its partition functions.
C, L, B, K, S, X, Y = 1.0, 0.5, 0.2, 0.0002, 10000.0, 100.0, 200.0
H = C * L**2 * B / K
CASES = {
    "lin3": (["CNG"], False, None, False, 1 + H),
    "lin5a": (["CNGGC"], False, None, False, 1 + H * (2 + L)),
    "lin5b": (["CNGGC"], False, "(..).", False, H * L),
    "lin5c": (["CGNCG"], False, None, False, 1 + C * L**2 * B / K + C * L**4 * B / K + C**2 * B**3 * L**4 / K**2 + C * B * L**2 * S / K**2),
    "tie": (["CNGNC"], False, None, False, 1 + 2 * H),
    "enum": (["CNGCNG"], False, None, False, (1 + H) ** 2 + C * L**5 * B / K + H**2 * X),
    "reg": (["NyNyxNx"], False, None, False, (1 + H) ** 2 + H**2 * X),
    "circ1": (["CNNNGNN"], True, None, False, C * L**7 * (1 + C * B**2 / K)),
    "circ2": (["CNNNGNN"], True, "(...)..", False, C * L**7 * C * B**2 / K),
    "bi1": (["C", "G"], False, None, False, 1 / K),
    "bi2": (["GC", "GC"], False, None, False, (1 / K) * (2 + L**2 * B**2 * C / K + S / K)),
    "force": (["GC", "GC"], False, "(..)", False, 1 / K),
    "force_extra": (["GC", "GC"], False, "(..)", True, (1 / K) * (1 + L**2 * B**2 * C / K + S / K)),
    "tri": (["xy", "yz", "zx"], False, None, False, 3 * (1 / K) ** 2 * (1 + X) + (1 / K) ** 2 * (C / K) * L**3 * B**3),
}
DDL = "mol_id string, strands array<string>, circle boolean, structure string, allow_extra boolean"


@pytest.fixture(scope="module")
def filled(spark):
    mols = spark.createDataFrame([(k, *v[:4]) for k, v in CASES.items()], DDL)
    return fold.fill(mols, packaged("minimal"), full=True, finals=True).cache()


def test_closed_forms_and_every_start(filled):
    for r in filled.select("mol_id", "z", "z_final").collect():
        assert r["z"] == pytest.approx(CASES[r["mol_id"]][4], rel=1e-9), r["mol_id"]
        assert all(v == pytest.approx(r["z"], rel=1e-9) for v in r["z_final"])


def test_cells_that_do_not_wrap_are_enough_for_strands(spark):
    own = {k: v for k, v in CASES.items() if not v[1]}
    got = fold.partition(spark.createDataFrame([(k, *v[:4]) for k, v in own.items()], DDL), packaged("minimal")).collect()
    assert {r["mol_id"]: pytest.approx(r["z"], rel=1e-9) for r in got} == {k: v[4] for k, v in own.items()}


def test_nulls_and_molecules_without_letters(spark):
    got = fold.partition(spark.createDataFrame([("a", [], None, None, None), ("b", None, False, None, None), ("c", ["", "A"], None, None, None)], DDL), packaged("minimal")).collect()
    assert {r["mol_id"]: r["z"] for r in got} == {"a": 1.0, "b": 1.0, "c": 1.0}


@pytest.mark.parametrize(
    ("strands", "motif", "z"),
    [
        (["CG", "CAG"], "CG_CAG", (1 / K) * (2 + L**3 * B**2 * C / K + 10 / K)),
        (["CAG", "CAG"], "NNN_NNN", (1 / K) * (2 + L**4 * B**2 * C / K + 10 / K)),
        (["CAAAAG"], "CAAAAG", 1 + (C / K) * L**5 * B + 10 / K),
    ],
)
def test_motifs(spark, strands, motif, z):
    p = resolve([tuple(x.split()) for x in (MINIMAL + f"K_coax 0\nC_eff_motif_{motif} 10\n").splitlines() if x])
    mols = spark.createDataFrame([("a", strands, False, None, False)], DDL)
    full = fold.fill(mols, p, full=True, finals=True).cache()
    r = full.select("z", "z_final").first()
    assert r["z"] == pytest.approx(z, rel=1e-9)
    assert all(v == pytest.approx(z, rel=1e-9) for v in r["z_final"])
    tag = f"C_eff_motif_{motif}"
    share = 10 / K * (1 / K if len(strands) > 1 else 1) / z
    assert observables.log_derivatives(full, p, [tag]).first()["dlogz_dlogp"] == pytest.approx(share, rel=1e-6)


def test_pair_probabilities(filled):
    got = {(r["mol_id"], r["i"], r["j"]): r["p"] for r in observables.bpp(filled, packaged("minimal")).collect()}
    assert got["lin3", 0, 2] == pytest.approx(H / (1 + H))
    assert got["circ2", 0, 4] == pytest.approx(1.0)
    assert got["force", 0, 3] == pytest.approx(1.0)
    assert ("force", 1, 2) not in got


def test_derivatives_are_slopes(spark):
    p = packaged("minimal")
    mols = spark.createDataFrame([("a", ["CNGCNGC"], False, None, False), ("b", ["GCAGC", "GCC"], False, None, False), ("c", ["CNGCNG"], True, None, False)], DDL)
    tags = ["Kd_CG", "l", "l_BP", "C_init", "C_eff_stacked_pair", "K_coax", "l_coax"]
    got = {(r["mol_id"], r["tag"]): r["dlogz_dlogp"] for r in observables.log_derivatives(fold.fill(mols, p, full=True).cache(), p, tags).collect()}
    for r in observables.numeric_log_derivatives(mols, p, tags, 1e-5, full=True).collect():
        assert got[r["mol_id"], r["tag"]] == pytest.approx(r["numeric"], abs=1e-5)


def test_structures(filled):
    p = packaged("minimal")
    own = filled.filter("mol_id in ('enum', 'lin3', 'circ1', 'bi2')")
    got = traceback.enumerate_structures(own, p, full=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["mol_id"], {})[r["structure"]] = r["p"]
    assert set(by["enum"]) == {"......", "(.)...", "...(.)", "(.)(.)", "(....)"}
    assert all(sum(v.values()) == pytest.approx(1) for v in by.values())
    assert {r["mol_id"]: r["structure"] for r in traceback.mfe(own, p, full=True).collect()} == {"enum": "(.)(.)", "lin3": "(.)", "circ1": "(...)..", "bi2": "(())"}
    drawn = traceback.samples(own, p, 20, seed=3, full=True)
    assert all(r["structure"] in by[r["mol_id"]] for r in drawn.collect())
    assert sorted(drawn.collect()) == sorted(traceback.samples(own, p, 20, seed=3, full=True).collect())


def test_loops_and_score(spark):
    mols = spark.createDataFrame([("a", ["GGGAACGAAAGAACCC"], False, "(((..(....)..)))", False), ("b", ["GGGAAAC", "GAAAGCCC"], False, "(((...()....)))", False), ("c", ["AAGGGAAAACCCAA"], True, "..(((....)))..", False), ("d", ["ACGUA"], True, ".....", False), ("e", ["ACGUA"], False, ".....", False), ("f", ["AC", "GUA"], True, ".....", False)], DDL)
    p = packaged("v0.31")
    own = {r["mol_id"]: r["z"] for r in scoring.score(mols, p).collect()}
    for r in fold.fill(mols, p, full=True).select("mol_id", "z").collect():
        assert own[r["mol_id"]] == pytest.approx(r["z"], rel=1e-9)
    tags = ["l", "l_BP", "C_init", "Kd_CG", "Kd_AU"]
    slopes = {(r["mol_id"], r["tag"]): r["dlogz_dlogp"] for r in scoring.score(mols, p, tags)[1].collect()}
    for r in observables.log_derivatives(fold.fill(mols, p, full=True), p, tags).collect():
        assert slopes.get((r["mol_id"], r["tag"]), 0.0) == pytest.approx(r["dlogz_dlogp"], abs=1e-9), r
    one = spark.createDataFrame([("x", ["C" * 12], False, ".(((.)(.))).", False)], DDL)
    assert sorted(r["residues"] for r in scoring.loops(one).collect()) == sorted([[[1, 2], [9, 10]], [[2, 3], [5, 6], [8, 9]], [[3, 4, 5]], [[6, 7, 8]], [[10, 11, 0, 1]]])


def test_candidates_agree_with_the_fold(spark):
    p = packaged("v0.31")
    mols = spark.createDataFrame([("a", ["GGGCAAAAGCCACC"], False, None, False), ("b", ["GGCAG", "CGAACC"], False, None, False), ("c", ["GGCGAAAGCCA"], True, None, False)], DDL)
    inside = fold.candidates(fold.prepare(mols), p, True)
    count = lambda c: inside.select(F.aggregate(F.flatten(c), F.lit(0), lambda n, x: n + F.size(x)).alias("n")).agg(F.sum("n")).first()[0]
    assert candidates.pairs(mols, p).count() == count("types")
    assert candidates.motif_matches(mols, p).count() == count("motifs")


def test_parameters(tmp_path, spark):
    p = packaged("v0.31")
    assert [t.tag for t in p.types] == ["CG", "GC", "AU", "UA", "GU", "UG"]
    assert check_stacks(p)
    assert len(packaged("minimal").types) == 3
    (tmp_path / "own.params").write_text("# c\nname own\n\nKd_AA 5.0 # x\nl 0.5\n")
    from strandspark.sources import params

    q = params.load(spark, str(tmp_path / "own.params"))
    assert (q.name, q.types[0].flip, q.scalars["l"]) == ("own", 0, 0.5)
    with pytest.raises(ValueError, match="unknown"):
        resolve([("nonsense", "1")])
    params.write(spark, p, str(tmp_path / "out"))
    rows = params.read(spark, str(tmp_path / "out/*.txt")).orderBy("ord").collect()
    assert resolve([(r["tag"], r["val"]) for r in rows]).values == p.values


def test_defects(spark):
    mols = spark.createDataFrame([("a", ["GAAAC"], False, "(...)", False)], DDL)
    d = defects.defects(mols, spark.createDataFrame([("a", 0, 4, 0.75)], "mol_id string, i int, j int, p double")).first()
    assert d["bpp_defect"] == 0.25
    assert d["ensemble_defect"] == pytest.approx(2 * 0.25 / 5)


def test_training_step_lowers_the_loss(spark):
    p = packaged("minimal").without_coax()
    ex = spark.createDataFrame([("a", ["CNGGC"], False, "(.)..")], "mol_id string, strands array<string>, circle boolean, structure string")
    before = training.loss(ex, p, spark).first()["loss"]
    slope = {r["tag"]: r["slope"] for r in training.slope(ex, p, ["l"]).collect()}
    e = 1e-5
    near = [training.loss(ex, p.updated({"l": 0.5 * math.exp(s * e)}).without_coax(), spark).first()["loss"] for s in (1, -1)]
    assert slope["l"] == pytest.approx((near[0] - near[1]) / (2 * e), abs=1e-4)
    assert before > 0


def test_minimize_finds_a_minimum():
    import numpy as np

    x, y, trace = training.minimize(lambda vs: [float(((v - 3) ** 2).sum()) for v in vs], lambda v: 2 * (v - 3), np.zeros(3), 30)
    assert np.allclose(x, 3, atol=1e-3)
    assert y == trace[-1][0]


def test_training_lowers_the_loss_step_by_step(spark):
    p = packaged("v0.18").without_coax()
    ex = spark.createDataFrame([("a", ["GGGAAAUCC"], False, "((.....))"), ("b", ["GGCGAAAGCC"], False, "(((....)))"), ("c", ["AAAAAAA"], False, "(.....)")], "mol_id string, strands array<string>, circle boolean, structure string")
    tags = ["C_init"]
    best, trace = training.train(ex, p, tags, steps=1)
    assert trace[-1][0] < trace[0][0]
    assert best.values["C_init"] != p.values["C_init"]
    rows = training.trace_table(spark, trace, tags).collect()
    assert len(rows) == len(trace)
    assert rows[0]["loss"] == pytest.approx(trace[0][0])
    got = training.slope_check(ex, p, tags).collect()
    assert {r["tag"] for r in got} == set(tags)
    assert all(r["slope"] == pytest.approx(r["numeric"], abs=1e-4) for r in got)


def test_start_values_and_tags():
    p = packaged("v0.18")
    assert "K_coax" not in training.train_tags(p, no_coax=True)
    assert training.train_tags(p, include=["l"]) == ["l"]
    with pytest.raises(ValueError, match="no such"):
        training.train_tags(p, exclude=["Kd_XX"])
    assert training.start(p, ["l", "K_coax"])[1] == -math.inf
    assert training.start(p, ["K_coax"], use_bounds=True)[0] == pytest.approx(math.log(0.1) - 1)
    with pytest.raises(ValueError, match="values"):
        training.start(p, ["l"], values=[1.0, 2.0])


def test_greedy_structures_from_every_start(spark, filled):
    got = traceback.mfe_starts(filled.filter("mol_id in ('enum', 'lin3', 'circ1')"), packaged("minimal")).collect()
    first = {r["mol_id"]: r["structure"] for r in got if r["start"] == 0}
    assert first == {"enum": "(.)(.)", "lin3": "(.)", "circ1": "(...).."}
    assert {r["mol_id"]: sum(x["mol_id"] == r["mol_id"] for x in got) for r in got} == {"enum": 6, "lin3": 3, "circ1": 7}
    assert all(r["agrees"] == (r["structure"] == first[r["mol_id"]]) for r in got)


def test_one_row_a_result(spark):
    p = packaged("minimal")
    mols = spark.createDataFrame([("lin5a", ["CNGGC"], False, "(..)."), ("lin3", ["CNG"], False, None), ("none", ["CNG"], False, "(.)")], "mol_id string, strands array<string>, circle boolean, structure string")
    got = {r["mol_id"]: r for r in observables.results(mols, p, ["l", "Kd_CG"]).collect()}
    assert got["lin5a"]["z"] == pytest.approx(1 + H * (2 + L))
    assert got["lin5a"]["dg_gap"] == pytest.approx(-0.61633135471 * (math.log(H * L) - math.log(1 + H * (2 + L))))
    assert got["lin3"]["dg_gap"] is None
    assert got["lin3"]["structure"] == "(.)"
    assert got["lin3"]["log_derivatives"]["l"] == pytest.approx(2 * H / (1 + H))
    assert got["lin3"]["log_derivatives"]["Kd_CG"] == pytest.approx(-H / (1 + H))


def test_strained_three_way_junctions_and_their_derivatives(spark):
    from dataclasses import replace

    p = replace(packaged("minimal"), strained=True)
    mols = spark.createDataFrame([("a", ["xy", "yz", "zx"], False, None, False)], DDL)
    full = fold.fill(mols, p, full=True).cache()
    a, b, c = 3 * (1 / K) ** 2 * (1 + X), (1 / K) ** 2 * (C / K) * L**3 * B**3, 3 * (1 / K) ** 2 * (C / K) * X * Y * L**2 * B
    assert full.select("z").first()[0] == pytest.approx(a + b + c)
    got = {r["tag"]: r["dlogz_dlogp"] for r in observables.log_derivatives(full, p, ["l", "K_coax", "l_coax"]).collect()}
    assert got["l"] == pytest.approx((3 * b + 2 * c) / (a + b + c))
    assert got["K_coax"] == pytest.approx((3 * (1 / K) ** 2 * X + c) / (a + b + c))
    assert got["l_coax"] == pytest.approx(c / (a + b + c))


@pytest.mark.parametrize(("name", "sequence"), [("v0.18", "GCUCAGUGAGAGC"), ("v0.20", "GCGACGUUG"), ("v0.31", "GCUCAGUGAGAGC")])
def test_derivatives_of_named_sets_are_slopes(spark, name, sequence):
    p = packaged(name)
    mols = spark.createDataFrame([("a", [sequence], False, None, False)], DDL)
    tags = ["Kd_CG", "C_init", "l", *[t for t in p.values if t.startswith("C_eff")][:2]]
    got = {r["tag"]: r["dlogz_dlogp"] for r in observables.log_derivatives(fold.fill(mols, p, full=True), p, tags).collect()}
    for r in observables.numeric_log_derivatives(mols, p, tags, 1e-5).collect():
        assert got[r["tag"]] == pytest.approx(r["numeric"], abs=1e-5)


def test_energy_of_a_molecule_twice_in_a_row(spark):
    from strandspark.sources import known

    one = known.molecules(spark, "tRNA").select("mol_id", "strands", "circle", "structure")
    two = one.select(F.lit("two").alias("mol_id"), F.array(F.concat(F.col("strands")[0], F.col("strands")[0])).alias("strands"), "circle", F.concat("structure", "structure").alias("structure"))
    got = {r["mol_id"]: r["dg"] for r in scoring.score(one.unionByName(two), packaged("v0.31")).collect()}
    assert got["two"] == pytest.approx(2 * got["tRNA"], rel=1e-9)


def test_names_of_parameter_sets(tmp_path, spark):
    from strandspark.sources import params

    assert [params.packaged(n).version for n in ("v0.1", "v0.15", "v0.16", "v0.17", "v0.171", "v0.18", "v0.20", "v0.30", "v0.31")] == ["0.1", "0.15", "0.16", "0.17", "0.171", "0.18", "0.20", "0.30", "0.31"]
    (tmp_path / "mine.params").write_text("name mine\nversion 7\nKd_CG 5.0\n")
    assert params.load(spark, str(tmp_path / "mine")).version == params.load(spark, str(tmp_path / "mine.params")).version == "7"
    assert params.load(spark, "v0.18").version == "0.18"
    assert params.load(spark).version == "0.31"
    with pytest.raises(ValueError, match=r"there are minimal, v0\.1"):
        params.load(spark, "v9")


def test_molecules_are_cut_from_whole_texts(spark, tmp_path):
    from strandspark import queries

    texts = [(1, "A long text: Guacamole, cumin and sugar. " * 50), (2, None), (3, "xyz"), (4, "u"), (5, "A long text: Guacamole, cumin and sugar. " * 50)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for _, t in texts:
        own = "".join(c for c in (t or "").upper() if c in "ACGU")
        for k in range(0, len(own), queries.N):
            want[own[k : k + queries.N]] = want.get(own[k : k + queries.N], 0) + 1
    assert {r["mol_id"]: r["copies"] for r in queries.sequences(spark, str(tmp_path)).collect()} == want


def test_samples_are_drawn_by_weight(filled):
    p = packaged("minimal")
    own = filled.filter("mol_id in ('lin5a', 'circ1')")
    drawn = traceback.samples(own, p, 400, seed=1, full=True)
    shares = {(r["mol_id"], r["structure"]): r["n"] / 400 for r in drawn.groupBy("mol_id", "structure").agg(F.count("*").alias("n")).collect()}
    for r in traceback.enumerate_structures(own, p, full=True).collect():
        assert abs(shares.get((r["mol_id"], r["structure"]), 0.0) - r["p"]) < 5 * math.sqrt(max(r["p"] * (1 - r["p"]), 0.002) / 400)


def test_text_of_matrices_and_structures(spark, filled):
    from strandspark.functions import with_spaces

    lines = observables.bpp_matrix_lines(filled.filter("mol_id = 'lin3'"), packaged("minimal")).orderBy("i").collect()
    dense = [[float(r["line"][25 * k : 25 * k + 25]) for k in range(3)] for r in lines]
    want = H / (1 + H)
    assert dense == [[0, 0, pytest.approx(want)], [0, 0, 0], [pytest.approx(want), 0, 0]]
    rows = spark.createDataFrame([("((...))", ["GC", "AAA", "GC"], False), ("..", ["A", "C"], True)], "s string, strands array<string>, circle boolean")
    assert [r[0] for r in rows.select(with_spaces(F.col("s"), F.col("strands"), F.col("circle"))).collect()] == ["(( ... ))", ". .*"]


def test_table_of_defects(spark):
    rows = [("p", "a", 10, 2, 0.1, 0.5), ("p", "b", 30, 0, 0.3, None), ("q", "a", 10, 2, 0.2, 0.25), ("q", "b", 30, 0, 0.4, None)]
    got = {r["name"]: (r["p"], r["q"]) for r in defects.table(spark.createDataFrame(rows, "package string, name string, n int, n_bp int, ensemble_defect double, bpp_defect double")).collect()}
    assert got == {"a": (0.1, 0.2), "b": (0.3, 0.4), "OVERALL": (pytest.approx(0.25), pytest.approx(0.35))}
