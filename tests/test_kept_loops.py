"""Loop energies that are kept from one run to the next."""

import pytest
from pyspark.sql import functions as F

from strandspark.operators import scoring
from strandspark.sources.params import packaged

DDL = "mol_id string, strands array<string>, circle boolean, structure string"
FIRST = [("a", ["GGGAACGAAAGAACCC"], False, "(((..(....)..)))"), ("e", ["ACGUA"], False, "....."), ("n", None, False, None)]
SECOND = [*FIRST, ("again", ["GGGAACGAAAGAACCC"], False, "(((..(....)..)))"), ("b", ["GGGAAAC", "GAAAGCCC"], False, "(((...()....)))"), ("c", ["AAGGGAAAACCCAA"], True, "..(((....))).."), ("d", ["ACGUA"], True, ".....")]


def test_loops_are_folded_once(spark, tmp_path):
    path, p = str(tmp_path / "loops"), packaged("v0.31")
    names = lambda df: {("+".join(r["strands"]), r["structure"], r["log_z"], r["param_set"]) for r in df.collect()}
    rows = lambda: spark.read.schema(scoring.KEPT_DDL).parquet(path)
    want = {r["mol_id"]: r["dg"] for r in scoring.score(spark.createDataFrame(SECOND, DDL), p).collect()}

    def same(given, own):
        got = {r["mol_id"]: r["dg"] for r in scoring.score_kept(spark.createDataFrame(given, DDL), own, path).collect()}
        assert got == {r[0]: pytest.approx(want[r[0]], rel=1e-9) for r in given}

    same(FIRST, p)
    few = rows().count()
    assert few == scoring.loops(spark.createDataFrame(FIRST, DDL)).select(*scoring.KEY).distinct().count()
    before = names(rows())
    same(SECOND, p)
    after = rows().collect()
    assert before < names(rows())
    assert len(after) == scoring.loops(spark.createDataFrame(SECOND, DDL)).select(*scoring.KEY).distinct().count()
    files = set(rows().inputFiles())
    scoring.keep_loops(spark.createDataFrame(SECOND, DDL), p, path)
    assert rows().count() == len(after)
    assert files <= set(rows().inputFiles())


def test_sets_repeats_and_rare_loops(spark, tmp_path, monkeypatch):
    path, p = str(tmp_path / "loops"), packaged("v0.31")
    q = p.updated({"l": 0.3})
    assert scoring.set_key(p) == scoring.set_key(packaged("v0.31"))
    assert len({scoring.set_key(x) for x in (p, q, p.without_motifs(), packaged("minimal"), packaged("minimal").without_coax())}) == 5
    mols = spark.createDataFrame(SECOND, DDL)
    scoring.keep_loops(mols, p, path)
    twice = spark.read.schema(scoring.KEPT_DDL).parquet(path)
    spark.createDataFrame(twice.collect(), twice.schema).write.mode("append").partitionBy("param_set").parquet(path)  # as two runs at once would
    monkeypatch.setattr(scoring, "COMMON", 1)
    for own in (p, q):
        got = {r["mol_id"]: r["dg"] for r in scoring.score_kept(mols, own, path).collect()}
        assert got == {r["mol_id"]: pytest.approx(r["dg"], rel=1e-9) for r in scoring.score(mols, own).collect()}
    none = scoring.score_kept(mols.filter(F.lit(False)), p, path)
    assert none.count() == 0
    assert scoring.kept_loops(spark, p, str(tmp_path / "nothing")).count() == 0
