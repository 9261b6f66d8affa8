"""Functions that are called from SQL."""

import pytest
from pyspark.sql import functions as F

from strandspark.functions import pairs_of, partners, sql

STRUCTURES = ["((.))", "..", "", "(.)+(())", "((.)(..))", "()"]


def test_pairs_are_those_of_the_column_function(spark):
    sql.register(spark)
    df = spark.createDataFrame([(s,) for s in STRUCTURES] + [(None,)], "s string")
    want = sorted((r["s"], r["x"]["i"], r["x"]["j"]) for r in df.filter("s is not null").select("s", F.explode(pairs_of(partners(F.col("s")))).alias("x")).collect())
    assert sorted(map(tuple, spark.sql("SELECT m.s, p.i, p.j FROM {df} m, LATERAL pairs_of(m.s) p", df=df).collect())) == want
    arrays = spark.sql("SELECT s, base_pairs(s) AS p FROM {df}", df=df).collect()
    assert sorted((r["s"], x["i"], x["j"]) for r in arrays for x in r["p"]) == want


@pytest.mark.parametrize("text", ["(", "())", ")("])
def test_brackets_that_do_not_match_raise_an_error(spark, text):
    sql.register(spark)
    with pytest.raises(Exception, match="brackets do not match"):
        spark.sql(f"SELECT * FROM pairs_of('{text}')").collect()


def test_strands_and_molecules(spark):
    sql.register(spark)
    assert spark.sql("SELECT strands_of('AC+G U,'), strands_of(NULL), nucleotides('acgx u'), nucleotides(NULL)").first()[:] == (["AC", "G", "U"], [], "ACGU", "")
    got = spark.sql("SELECT m.s, p.k, p.sequence FROM VALUES ('aaccgguu x'), (''), (NULL) AS m(s), LATERAL molecules_of(m.s, 3) p").collect()
    assert [r[1:] for r in sorted(got, key=lambda r: r["k"])] == [(0, "AAC"), (1, "CGG"), (2, "UU")]
