"""Text formats."""

import pytest

from strandspark.sources import readers


def pairs(df):
    return sorted((r["i"], r["j"], round(r["p"], 6)) for r in df.collect())


def test_examples_and_sets(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\nGGAACC\n((..))\n\nb\nGC GC\n(( ))\n(. .)\n")
    (tmp_path / "s.txt").write_text("both\nb a\n\nnone\nmissing\n")
    known, sets = readers.examples(spark, str(tmp_path / "e.txt")), readers.example_sets(spark, str(tmp_path / "s.txt"))
    assert [(r["name"], r["force_base_pairs"]) for r in known.orderBy("name").collect()] == [("a", None), ("b", "(. .)")]
    assert [r["name"] for r in readers.of_set(sets, known, "both").orderBy("ord").collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="no set"):
        readers.of_set(sets, known, "other")


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("x_bpp.txt", "0 0.5 0\n0.5 0 0\n0 0 0\n", [(0, 1, 0.5)]),
        ("x_posteriors.txt", "1 G 3:0.25\n2 A\n3 C\n", [(0, 2, 0.25)]),
        ("x.ppairs", "% c\n3\n1 3 0.25\n1 4 0.75\n2 4 1.0\n3 4 0.75\n", [(0, 2, 0.25)]),
        ("x_dp.ps", "%!PS\n/ubox {\n1 3 0.5 ubox\n1 3 0.9 lbox\n", [(0, 2, 0.25)]),
        ("x_plot.txt", "3\ni j v\n1 3 1.0\n", [(0, 2, 0.1)]),
        ("x_simfold.txt", "h\nh\nh\nh\nh\n0 2 0.25\n", [(0, 2, 0.25)]),
    ],
)
def test_probabilities(spark, tmp_path, name, text, expected):
    (tmp_path / name).write_text(text)
    assert pairs(readers.read_bpp(spark, str(tmp_path / name))) == expected


def test_fasta(spark):
    assert readers.fasta(spark.createDataFrame([("a", "GC")], "name string, sequence string")).first()[0] == ">a\nGC"


def test_inputs_of_other_packages(spark):
    table = spark.createDataFrame([("a", "GC")], "name string, sequence string")
    assert readers.plain_input(table).first()[0] == "GC"
    assert readers.seq_input(table).first()[0] == ";\na\n\nGC1"


def test_known_molecules(spark):
    from strandspark.sources import known

    every = known.examples(spark).collect()
    assert len(every) == 12
    assert all(len(r["sequence"]) == len(r["structure"]) for r in every)
    assert [r["name"] for r in known.examples(spark, "tRNA").collect()] == ["tRNA"]
    assert len(known.examples(spark, "favorites").collect()) == 9
    assert next(r for r in every if r["name"] == "P4P6_outerjunction")["force_base_pairs"].count("(") == 2
    with pytest.raises(ValueError, match="no set"):
        known.examples(spark, "other")
