"""Values that lie exactly on a half of the last digit given, which a fold's logarithms miss by 1e-15 or so."""

import pytest

from strandspark import queries


@pytest.fixture
def texts(spark, tmp_path):
    """Writes documents of the given molecules and gives their folder."""

    def write(*molecules):
        spark.createDataFrame([(k, m) for k, m in enumerate(molecules)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def test_pair_probabilities_on_a_half_go_up(spark, texts):
    got = {(r["mol_id"], r["i"], r["j"]): r["p"] for r in queries.q_bpp(spark, texts("UGAAUGGU", "GUGACCAU", "UUCUAAGG")).collect()}
    assert got["UGAAUGGU", 0, 6] == got["UGAAUGGU", 1, 7] == 0.004688  # 3 / 640 = 0.0046875
    assert got["GUGACCAU", 1, 6] == 0.354688  # 227 / 640 = 0.3546875
    assert got["UUCUAAGG", 1, 7] == 0.828598  # 0.82859849998..., the nearest below a half of all molecules


def test_structures_on_a_half_go_up(spark, texts):
    got = {(r["mol_id"], r["structure"]): r["p"] for r in queries.q_enumerate(spark, texts("UGAAUGGU", "UAGACGCG")).collect()}
    assert got["UGAAUGGU", "(.....)."] == got["UGAAUGGU", ".(.....)"] == 0.004688  # 3 / 640 = 0.0046875
    assert got["UAGACGCG", "(....).."] == 0.000299  # 0.00029850003...


def test_defects_on_a_half_go_up(spark, texts):
    got = {r["mol_id"]: (r["ensemble_defect"], r["bpp_defect"]) for r in queries.q_defects(spark, texts("UAUCCCUG", "GAAAAAUC", "AAAA")).collect()}
    assert got["UAUCCCUG"] == (0.37278, 0.60063)  # 961 / 1600 = 0.600625
    assert got["GAAAAAUC"] == (0.12862, 0.17182)  # 0.1286150004...
    assert got["AAAA"] == (0.0, None)
