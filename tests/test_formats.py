"""Data sources: ranges, round trips, and what a failed write leaves."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from strandspark.sources import formats, readers

ROWS = [(f"m{k} of many", "ACGU" * (k % 7 + 1)) for k in range(200)]


@pytest.fixture(scope="module")
def registered(spark):
    formats.register(spark)
    return spark


@pytest.mark.parametrize("kind", ["fasta", "in", "seq"])
def test_sequences_round_trip_whatever_the_ranges(registered, tmp_path, kind):
    path = str(tmp_path / kind)
    df = registered.createDataFrame(ROWS, "name string, sequence string").repartition(3)
    df.write.format("sequences").option("kind", kind).mode("append").save(path)
    assert {n.split("-")[0] for n in os.listdir(path)} == {"part"}
    want = sorted(ROWS if kind != "in" else [(None, s) for _, s in ROWS], key=str)
    for split in (97, 1000, 1 << 20):
        got = registered.read.format("sequences").options(kind=kind, split_bytes=str(split)).load(path)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_records_of_several_lines_and_comments(registered, tmp_path):
    (tmp_path / "a.seq").write_text("".join(f"; one\n;two {k}\n{'' if k % 3 == 0 else f'm{k}'}\n\nACG\nU{'A' * k}1\n" for k in range(20)))
    (tmp_path / "b.fa").write_text("".join(f">m{k}\nACG\n\nU{'A' * k}\n" for k in range(20)))
    for name, kind in (("a.seq", "seq"), ("b.fa", "fasta")):
        want = sorted(("" if kind == "seq" and k % 3 == 0 else f"m{k}", "ACGU" + "A" * k) for k in range(20))
        for split in (3, 11, 64, 1 << 20):
            reader = formats._Records(str(tmp_path / name), kind, split)
            assert sorted(r for piece in reader.partitions() for batch in reader.read(piece) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)) == want


def test_overwriting_replaces_and_appending_adds(registered, tmp_path):
    path = str(tmp_path / "out")
    one, two = (registered.createDataFrame(ROWS[a:b], "name string, sequence string") for a, b in ((0, 5), (5, 8)))
    read = lambda: sorted(map(tuple, registered.read.format("sequences").load(path).collect()))
    for df, mode, want in ((one, "append", ROWS[:5]), (two, "append", ROWS[:8]), (two, "overwrite", ROWS[5:8])):
        df.write.format("sequences").mode(mode).save(path)
        assert read() == sorted(want)
    nulls = registered.createDataFrame([(None, "A"), ("x", None)], "name string, sequence string")
    nulls.write.format("sequences").mode("overwrite").save(path)
    assert read() == [("", "A"), ("x", "")]
    nulls.limit(0).write.format("sequences").mode("overwrite").save(path)
    assert read() == []


def test_a_failed_task_leaves_no_file(registered, tmp_path):
    path = str(tmp_path / "out")
    df = registered.createDataFrame(ROWS, "name string, sequence string").repartition(4)
    df.limit(3).write.format("sequences").mode("append").save(path)
    before = sorted(os.listdir(path))
    broken = df.withColumn("sequence", F.when(F.col("name") == "m7 of many", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("sequences").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == before


def test_wrong_kinds_columns_and_paths_raise_errors(registered, tmp_path):
    with pytest.raises(Exception, match="no kind"):
        registered.read.format("sequences").option("kind", "other").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no column sequence"):
        registered.createDataFrame([(1,)], "a int").write.format("sequences").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="absent"):
        registered.read.format("numbered_lines").load(str(tmp_path / "absent")).collect()


def test_numbered_lines_of_plain_and_compressed_files(registered, tmp_path):
    text = "\n".join(f"line {k}" for k in range(10000)) + "\r\n\nlast"
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    (tmp_path / "_no.txt").write_text("no data")
    got = registered.read.format("numbered_lines").load(str(tmp_path))
    rows = {(r["file"], r["k"]): r["line"] for r in got.collect()}
    assert [rows["a.txt", k] for k in (0, 4095, 4096, 9999, 10000, 10001)] == ["line 0", "line 4095", "line 4096", "line 9999", "", "last"]
    assert {k: v for k, v in rows.items() if k[0] != "a.txt"} == {("b.txt.gz", 0): "one", ("b.txt.gz", 1): "two"}
    some = registered.read.format("numbered_lines").load(str(tmp_path / "b*"))
    assert some.count() == 2 and got.rdd.getNumPartitions() == 2


def test_a_matrix_is_read_line_by_line(registered, tmp_path):
    n = 300
    (tmp_path / "x.bpp.txt").write_text("\n".join(" ".join("0.25" if i + j == n - 1 else "0" for j in range(n)) for i in range(n)) + "\n")
    got = readers.read_bpp(registered, str(tmp_path / "x.bpp.txt")).collect()
    assert {(r["file"], r["i"], r["j"], r["p"]) for r in got} == {("x.bpp.txt", i, n - 1 - i, 0.25) for i in range(n // 2)}
