"""Text files of examples, sets and base-pair probabilities as tables, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.sources import formats


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, line, fields): the lines of each file by number, split at white space. A file is one task, read line by line."""
    formats.register(spark)
    rows = spark.read.format("numbered_lines").load(path)
    return rows.withColumn("fields", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, part): blocks of lines that are parted by empty ones."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"[ \t\r]*\n", "\n"), r"\n{2,}")).alias("k", "block"))
    return blocks.select("file", "k", F.filter(F.split("block", "\n"), lambda x: x != "").alias("part")).filter("size(part) > 0")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, structure, force_base_pairs) of records of three lines or four."""
    part = F.col("part")
    return _records(spark, path).select(F.trim(part[0]).alias("name"), part[1].alias("sequence"), part[2].alias("structure"), F.get(part, 3).alias("force_base_pairs"))


def example_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, ord, example_name) of records of a name and a line of members."""
    return _records(spark, path).select(F.trim(F.col("part")[0]).alias("set_name"), F.posexplode(F.filter(F.split(F.coalesce(F.get("part", 1), F.lit("")), r"\s+"), lambda x: x != "")).alias("ord", "example_name"))


def of_set(sets: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The examples of a set in its order; a set that is not there, or a member that is not known, raises an error."""
    own = sets.filter(F.col("set_name") == name)
    if not own.head(1):
        raise ValueError(f"no set {name!r}; there are {sorted(r[0] for r in sets.select('set_name').distinct().limit(1000).collect())}")
    found = own.join(known, own["example_name"] == known["name"], "left")
    return found.select("ord", F.coalesce("name", F.raise_error(F.concat(F.lit("no example "), "example_name"))).alias("name"), "sequence", "structure", "force_base_pairs")


def _upper(df: DataFrame, i: Column, j: Column, p: Column) -> DataFrame:
    """(file, i, j, p), i < j, from either order; a pair that is given twice counts once."""
    rows = df.select("file", i.cast("int").alias("a"), j.cast("int").alias("b"), p.cast("double").alias("p"))
    return rows.filter("a <> b and p > 0").groupBy("file", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("p").alias("p"))


def dense(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of numbers, a row a line, plain or compressed."""
    cells = lines(spark, path).filter("size(fields) > 0").select("file", "k", F.posexplode("fields").alias("j", "p"))
    return _upper(cells, F.col("k"), F.col("j"), F.col("p"))


def posteriors(spark: SparkSession, path: str) -> DataFrame:
    """Lines "i letter j:p j:p ...", counted from 1."""
    cells = lines(spark, path).filter("size(fields) > 2").select("file", F.get("fields", F.lit(0)).cast("int").alias("i"), F.explode(F.slice("fields", 3, F.size("fields") - 2)).alias("x"))
    x = F.split("x", ":")
    return _upper(cells, F.col("i") - 1, x[0].cast("int") - 1, x[1])


def ppairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines "i j p", counted from 1, after a line with the number of letters n; j = n + 1 is the unpaired share, and a letter's shares sum to 1 within 0.001."""
    rows = lines(spark, path).filter("line not like '%\\%%' and size(fields) > 0")
    n = rows.filter("size(fields) = 1").select("file", F.get("fields", F.lit(0)).cast("int").alias("n"))
    cells = rows.filter("size(fields) = 3").select("file", *[F.get("fields", F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate((("i", "int"), ("j", "int"), ("p", "double")))]).join(F.broadcast(n), "file")
    both = cells.select("file", F.explode(F.when(F.col("j") > F.col("n"), F.array("i")).otherwise(F.array("i", "j"))).alias("i"), "p")
    wrong = both.groupBy("file", "i").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 0.001").head(1)
    if wrong:
        raise ValueError(f"shares of letter {wrong[0]['i']} of {wrong[0]['file']} sum to {wrong[0]['s']}")
    return _upper(cells.filter("j <= n"), F.col("i") - 1, F.col("j") - 1, F.col("p"))


def dot_plot(spark: SparkSession, path: str) -> DataFrame:
    """PostScript lines "i j root ubox", counted from 1, with p the square of root."""
    rows = lines(spark, path).filter("size(fields) = 4 and get(fields, 3) = 'ubox' and get(fields, 0) rlike '^[0-9]+$'")
    return _upper(rows, F.get("fields", F.lit(0)).cast("int") - 1, F.get("fields", F.lit(1)).cast("int") - 1, F.pow(F.get("fields", F.lit(2)).cast("double"), 2))


def log_plot(spark: SparkSession, path: str) -> DataFrame:
    """Lines "i j v" after two headers, counted from 1, with p = 10 ** -v."""
    return _upper(lines(spark, path).filter("k >= 2 and size(fields) = 3"), F.get("fields", F.lit(0)).cast("int") - 1, F.get("fields", F.lit(1)).cast("int") - 1, F.pow(F.lit(10.0), -F.get("fields", F.lit(2)).cast("double")))


def headed(spark: SparkSession, path: str, headers: int = 5) -> DataFrame:
    """Lines "i j p" after headers, counted from 0."""
    return _upper(lines(spark, path).filter((F.col("k") >= headers) & (F.size("fields") == 3)), F.get("fields", F.lit(0)), F.get("fields", F.lit(1)), F.get("fields", F.lit(2)))


#: By the end of a file's name.
READERS = {"bpp.txt": dense, "bpp.txt.gz": dense, "posteriors.txt": posteriors, ".ppairs": ppairs, "dp.ps": dot_plot, "plot.txt": log_plot, "simfold.txt": headed}


def read_bpp(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the path's end asks for; the longest end counts."""
    fit = [e for e in READERS if path.endswith(e)]
    if not fit:
        raise ValueError(f"no reader for {path}")
    return READERS[max(fit, key=len)](spark, path)


def fasta(table: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """(value) two lines a row, to be written as text."""
    return table.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence)).alias("value"))


def plain_input(table: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(value) one line a row: the sequence alone, as .in files have it."""
    return table.select(F.col(sequence).alias("value"))


def seq_input(table: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """(value) a record a row as .seq files have it: a comment mark, the name, an empty line, and the sequence with a 1 that ends it."""
    return table.select(F.concat(F.lit(";\n"), F.col(name).cast("string"), F.lit("\n\n"), F.col(sequence), F.lit("1")).alias("value"))


def shown_pairs(bpp: DataFrame, least: float = 0.2) -> DataFrame:
    """The pairs that a plot of probabilities shows."""
    return bpp.filter(F.col("p") > least)
