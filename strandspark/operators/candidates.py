"""Which pairs and motifs a molecule can form: each molecule is a row, and what it can form is listed within it, with no join and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions import pairs_of, span
from strandspark.operators.fold import candidates, joined, prepare, strand_pattern
from strandspark.sources.params import Params


def stack_table(molecules: DataFrame, p: Params) -> DataFrame:
    """(bpt1, bpt2, c_eff) of all stacks, 0 where none is given."""
    size = range(len(p.types))
    return F.broadcast(molecules.sparkSession.createDataFrame([(p.types[a].tag, p.types[b].tag, p.stack.get((a, b), 0.0)) for a in size for b in size], "bpt1 string, bpt2 string, c_eff double"))


def _tags(p: Params) -> Column:
    return F.array(*[F.lit(t.tag) for t in p.types]) if p.types else F.array().cast("array<string>")


def _cells(of: Column, use) -> Column:
    """use(i, d, what stands there) for all offsets and starts of an array of rows of arrays, flattened."""
    return F.flatten(F.flatten(F.transform(of, lambda row, d: F.transform(row, lambda here, i: use(i, d, here)))))


def pairs(molecules: DataFrame, p: Params) -> DataFrame:
    """(mol_id, i, j, tag): every ordered pair of letters of a type, neither too close on an unbroken strand nor barred by a forced structure."""
    m = candidates(prepare(molecules), p.without_motifs(), True)
    at = lambda i, d, here: F.transform(here, lambda t: F.struct(i.alias("i"), F.pmod(i + d, F.col("n")).alias("j"), F.get(_tags(p), t).alias("tag")))
    return m.select("mol_id", F.explode(_cells(F.col("types"), at)).alias("x")).select("mol_id", "x.*")


def _starts(strand: str, n: Column, of: Column) -> Column:
    k = len(strand)
    free = lambda i: F.isnull(of) | ~F.exists(span(1, k - 2), lambda x: F.get(of, F.pmod(i + x, n)) >= 0)
    fits = lambda i: (n >= k) & F.substring(F.col("_text"), i + 1, F.lit(k)).rlike(f"^{strand_pattern(strand)}$") & joined(F.col("nicks"), n, i, F.lit(k - 1)) & free(i)
    return F.transform(F.filter(span(0, n - 1), fits), lambda i: F.struct(F.lit(strand).alias("strand"), i.alias("i")))


def strand_matches(molecules: DataFrame, p: Params) -> DataFrame:
    """(mol_id, strand, i): where the strands of the set's motifs can start: on matching letters, with no nick and no forced letter within."""
    n, of = F.col("n"), F.col("of")
    text = F.array_join(F.concat("seq", "seq"), "")
    found = [_starts(s, n, of) for s in sorted({s for x in p.motifs for s in x.strands})]
    every = F.concat(*found) if found else F.array().cast("array<struct<strand:string,i:int>>")
    m = prepare(molecules).filter("n > 0").withColumn("_text", text)
    return m.select("mol_id", F.explode(every).alias("x")).select("mol_id", "x.*")


def motif_matches(molecules: DataFrame, p: Params) -> DataFrame:
    """(mol_id, motif, i, j, tag, i_next, j_next, tag_next): where a motif is closed by the pair (i, j), with the pair at its other end, null for hairpins."""
    m = candidates(prepare(molecules), p, True)
    n, types, names = F.col("n"), F.col("types"), F.array(*[F.lit(x.tag) for x in p.motifs]) if p.motifs else F.array().cast("array<string>")
    tag = lambda i, d, k: F.get(_tags(p), F.get(F.get(F.get(types, d), i), k))

    def at(i, d, here):
        def one(x):
            loop = x["d"] >= 0
            return F.struct(
                F.get(names, x["m"]).alias("motif"), i.alias("i"), F.pmod(i + d, n).alias("j"), tag(i, d, x["t"]).alias("tag"),
                F.when(loop, x["i"]).alias("i_next"), F.when(loop, F.pmod(x["i"] + x["d"], n)).alias("j_next"), F.when(loop, tag(x["i"], x["d"], x["u"])).alias("tag_next"),
            )

        return F.transform(here, one)

    return m.select("mol_id", F.explode(_cells(F.col("motifs"), at)).alias("x")).select("mol_id", "x.*")


def structure_pairs(molecules: DataFrame) -> DataFrame:
    """(mol_id, i, j): the pairs of the molecules' structures."""
    return prepare(molecules).filter("of is not null").select("mol_id", F.explode(pairs_of(F.col("of"))).alias("x")).select("mol_id", "x.*")
