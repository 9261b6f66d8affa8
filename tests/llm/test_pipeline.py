"""The pipeline's stages on a small corpus, each against a plainer version."""

import corpus_pipeline
from strandspark.llm import decontam


def test_stages(spark, tmp_path):
    text = lambda k: " ".join(f"word{k}a{i}" for i in range(30))
    leak = "this passage of the benchmark has more than ten words in it for sure"
    rows = [(k, text(k), "en", f"s{k % 2}", 1) for k in range(60)] + [(100, text(3), "en", "s1", 1), (101, text(4) + " " + leak, "en", "s0", 1)] + [(200 + k, text(200 + k) + " scum", "en", "s0", 1) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, int(k >= 200)) for k, *_ in rows if k != 100], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    every = {r[0] for r in rows}
    assert seen[0] == {k for k in every if k < 200}
    assert seen[1] == seen[0] - {100}
    assert seen[2] == seen[1] - {101}
    assert seen[3] <= seen[2]
    assert seen[4] == seen[3]
    assert decontam.words(leak)[:10]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_odd_rows_and_columns(spark, tmp_path):
    long = " ".join(f"w{k % 991}x{k % 37}" for k in range(150_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "a text without a key", "en", "a"), (3, long, "en", None), (4, long + " and a word", "en", "a"), (5, "one two three four five six", "fr", "b"), (5, "one two three four five six", "fr", "b"), (None, None, None, None)]
    names = ["size", "target", "copies", "fp", "root", "score", "ranges", "k", "_n", "file", "start"]
    columns = ["doc_id", "text", "lang", "source", *names]
    every = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", None), (None, "one two"), ("c", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs, kept = spark.read.parquet(sf + "/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        kept.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda k: (k is None, k)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert kept[1] == [1, 3, 5, None]  # null and empty texts are one group, 4 is a near copy of 3, of the equal rows one stays
    assert kept[2] == [1, 3, None]  # "one two" is a benchmark item
    assert kept[4] == kept[3]
    assert set(kept[3]) <= set(kept[2])
    nothing = spark.read.parquet(sf + "/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name


def test_stage_names_are_distinct():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
