"""How far predicted pair probabilities are from known structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators.candidates import structure_pairs


def defects(molecules: DataFrame, bpp: DataFrame) -> DataFrame:
    """(mol_id, n, n_bp, ensemble_defect, bpp_defect) of molecules with a structure, from bpp (mol_id, i, j, p), i < j.

    bpp_defect is the mean of 1 - p over the structure's pairs, null without any; ensemble_defect the expected share of
    letters that are not paired, or unpaired, as in the structure.
    """
    pairs = structure_pairs(molecules)
    size = molecules.select("mol_id", F.aggregate("strands", F.lit(0), lambda n, s: n + F.length(s)).alias("n"))
    miss = pairs.join(bpp, ["mol_id", "i", "j"], "left").groupBy("mol_id").agg(F.sum(1 - F.coalesce("p", F.lit(0.0))).alias("miss"), F.count("*").cast("int").alias("n_bp"))
    bound = pairs.select("mol_id", F.explode(F.array("i", "j")).alias("k"))
    each = bpp.select("mol_id", F.explode(F.array("i", "j")).alias("k"), "p")
    stray = each.join(bound, ["mol_id", "k"], "left_anti").groupBy("mol_id").agg(F.sum("p").alias("stray"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = size.join(miss, "mol_id", "left").join(stray, "mol_id", "left").withColumn("n_bp", F.coalesce("n_bp", F.lit(0)))
    return out.select("mol_id", "n", "n_bp", ((2 * zero("miss") + zero("stray")) / F.when(F.col("n") > 0, F.col("n"))).alias("ensemble_defect"), F.when(F.col("n_bp") > 0, F.col("miss") / F.col("n_bp")).alias("bpp_defect"))


def overall(measured: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by with the defects of all molecules: ensemble defects weighted by letters, pair defects by pairs. weight: a column that counts a molecule so many times."""
    times = F.col(weight) if weight else F.lit(1)
    share = lambda x, size: F.sum(F.col(x) * F.col(size) * times) / F.sum(F.when(F.col(size) > 0, F.col(size) * times))
    return measured.groupBy(*by).agg(share("ensemble_defect", "n").alias("ensemble_defect"), share("bpp_defect", "n_bp").alias("bpp_defect"))


def table(measured: DataFrame, which: str = "ensemble_defect", name: str = "name") -> DataFrame:
    """One row a molecule and one named OVERALL, one column a package (measured: package, name, n, n_bp and the defects)."""
    rows = measured.select(name, "package", which).unionByName(overall(measured, ["package"]).select(F.lit("OVERALL").alias(name), "package", which))
    return rows.groupBy(name).pivot("package").agg(F.first(which))
