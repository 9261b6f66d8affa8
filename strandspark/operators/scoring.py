"""Energies of given structures, loop by loop: every distinct loop is folded once, whichever molecules it is in."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import built, connections, let, span
from strandspark.operators.fold import fill, free_energy, nothing, partition, prepare, sets_column, shape, weights
from strandspark.operators.observables import log_derivatives
from strandspark.sources.params import Params

MINI = "struct<strands:array<string>,structure:string,ends:array<string>,residues:array<array<int>>>"


def _loop(seq: Column, lig: Column, of: Column, n: Column, within: Column, a: Column) -> Column:
    """The loop that the pair at a closes, or the one outside all pairs if a is -1, as a molecule of its own: strands cut at nicks, structure, the letters of its pairs, and the positions of its strands."""
    bonds = F.filter(span(0, n - 1), lambda k: F.get(within, k) == a)
    first = F.coalesce(F.get(F.filter(bonds, lambda k: F.get(within, F.pmod(k - 1, n)) != a), F.lit(0)), F.lit(0))
    first = F.when(a >= 0, a).otherwise(first)
    turned = let(first, lambda f: F.array_sort(F.transform(bonds, lambda k: F.struct(F.pmod(k - f, n).alias("o"), k.alias("k")))))

    def walk(state, x):
        k, to = x["k"], F.pmod(x["k"] + 1, n)
        goes_on = F.try_element_at(F.try_element_at(state, F.lit(-1)), F.lit(-1)) == k
        last = F.try_element_at(state, F.lit(-1))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.concat(last, F.array(to))))).otherwise(F.concat(state, F.array(F.array(k, to)))).cast("array<array<int>>")

    runs = F.aggregate(turned, F.array().cast("array<array<int>>"), walk)

    def build(runs):
        count = F.size(runs)
        paired = lambda k: F.get(of, k) >= 0
        ahead = lambda r, x, h: F.when(~paired(x), ".").when((h == F.size(r) - 1) & (r != F.get(runs, count - 1)), "(").when((h == 0) & (r == F.get(runs, F.lit(0))), "(").otherwise(")")
        marks = F.array_join(F.flatten(F.transform(runs, lambda r: F.transform(r, lambda x, h: ahead(r, x, h)))), "")
        text = F.array_join(F.transform(runs, lambda r: F.array_join(F.transform(r, lambda x, h: F.concat(F.get(seq, x), F.when((h < F.size(r) - 1) & ~F.get(lig, x), "+").otherwise(""))), "")), "+")
        ends = F.transform(runs, lambda r, h: F.concat(F.get(seq, F.try_element_at(r, F.lit(-1))), F.get(seq, F.get(F.get(runs, F.pmod(h + 1, count)), F.lit(0)))))
        return F.struct(F.split(text, r"\+").alias("strands"), marks.alias("structure"), ends.alias("ends"), runs.alias("residues")).cast(MINI)

    return let(runs, build)


def _decomposed(m: DataFrame) -> Column:
    """All loops of a prepared molecule with pairs."""
    n, of = F.col("n"), F.col("of")
    outer = lambda k: F.coalesce(F.array_max(F.filter(span(0, k), lambda a: F.get(of, a) > k)), F.lit(-1))
    within = F.transform(F.col("seq"), lambda _, k: F.when(k == n - 1, F.lit(-1)).otherwise(outer(k)))  # the loop that the bond from k to k + 1 is in
    return let(within, lambda w: F.transform(F.concat(F.array(F.lit(-1)), F.filter(span(0, n - 1), lambda a: F.get(of, a) > a)), lambda a: _loop(F.col("seq"), F.col("lig"), of, n, w, a)))


def loops(molecules: DataFrame) -> DataFrame:
    """(mol_id, residues, strands, structure, ends): the loops of each molecule with a structure that has pairs."""
    m = prepare(molecules).filter("array_max(of) >= 0 and size(lig) >= 0 and size(seq) >= 0")
    return m.select("mol_id", F.explode(built(("loops",), lambda: _decomposed(m))).alias("x")).select("mol_id", "x.residues", "x.strands", "x.structure", "x.ends")


def _ring() -> Column:
    """Without a nick: a circle."""
    return (F.col("n") > 0) & (F.col("nicks") == 0)


def _joints(molecules: DataFrame) -> DataFrame:
    """(mol_id, n, nicks, c, has): letters, nicks and joints of each molecule, and whether its structure has pairs."""
    return prepare(molecules).select("mol_id", "n", F.size("nicks").alias("nicks"), connections(F.col("strands"), F.col("circle")).alias("c"), (F.coalesce(F.array_max("of"), F.lit(-1)) >= 0).alias("has"))


def _together(molecules: DataFrame, of_loop: DataFrame, p: Params, sets: list[Params] | None = None) -> DataFrame:
    """(mol_id, log_z, z, dg) of molecules whose loops' log_z are known: of_loop has a row for each loop of each molecule, with par."""
    place = {t.tag: k for k, t in enumerate(p.types) if not t.lower}
    lower = next((k for k, t in enumerate(p.types) if t.lower), 0)
    known = F.create_map(*[F.lit(x) for pair in place.items() for x in pair]) if place else None
    kd = F.col("par.kd")
    end = lambda e: F.get(kd, F.coalesce(F.try_element_at(known, e), F.lit(lower)) if place else F.lit(lower)) - F.get(kd, F.lit(0))
    fix = F.aggregate("ends", F.lit(0.0), lambda s, e: s + 0.5 * end(e)) + (F.size("strands") - 1) * F.get(kd, F.lit(0))
    logs = of_loop.groupBy("mol_id", F.col("par.set").alias("set")).agg(F.sum(fix + F.col("log_z")).alias("s"), F.first(F.get(kd, F.lit(0))).alias("kd0"))
    joined = _joints(molecules)
    # Without pairs a circle is one loop, what has one end is as it is, and more strands are not one molecule.
    bare = joined.filter("not has").withColumn("par", F.explode(sets_column(sets or [p])))
    unpaired = bare.select("mol_id", "par.set", F.when(_ring(), F.col("par.C_init") + F.col("n") * F.col("par.l")).when(F.col("nicks") <= 1, 0.0).otherwise(nothing()).alias("log_z"))
    with_pairs = joined.filter("has").join(logs, "mol_id").select("mol_id", "set", (F.col("s") - F.col("c") * F.col("kd0")).alias("log_z"))
    by = ["set"] if sets else []
    return with_pairs.unionByName(unpaired).select("mol_id", *by, "log_z", F.exp("log_z").alias("z"), free_energy(F.col("log_z")).alias("dg"))


def score(molecules: DataFrame, p: Params, tags: list[str] | None = None, sets: list[Params] | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(mol_id, log_z, z, dg) of molecules with a structure: the product of their loops, each a fold that is forced to its pairs.

    Each end of a pair takes half of what sets its type apart from the first type, so that it is counted once over the
    two loops that share it; joining strands costs as much within a loop as for the whole molecule. With sets (of p's
    shape), one row a set, with set, its place; all are folded by one plan. With tags, which go with one set alone, also
    (mol_id, tag, dlogz_dlogp), without a row where that is 0 as nothing counts.
    """
    if sets and tags is not None:
        raise ValueError("derivatives are of one set")
    own = loops(molecules)
    key = ["strands", "structure"]
    mini = own.select(*key).distinct().withColumn("mol_id", F.xxhash64(F.concat_ws("+", "strands"), F.col("structure"))).withColumn("circle", F.lit(False))
    folded = fill(mini, p, full=tags is not None, sets=sets)
    of_loop = own.withColumn("mini", F.xxhash64(F.concat_ws("+", "strands"), F.col("structure")))
    joined = _joints(molecules)
    out = _together(molecules, of_loop.join(folded.select(F.col("mol_id").alias("mini"), "par", "log_z"), "mini"), p, sets)
    if tags is None:
        return out
    deriv = log_derivatives(folded, p, tags).select(F.col("mol_id").alias("mini"), "tag", "dlogz_dlogp")
    each = of_loop.select("mol_id", "mini").join(deriv, "mini").select("mol_id", "tag", "dlogz_dlogp")
    # Joining strands and the halves of the ends: the first type's Kd comes in by both, the others' by their own ends.
    names = [(t, k) for t in tags if t.startswith("Kd_") for k in {x for a in p.of_tag(t[3:]) for x in (p.types[a].tag, p.types[p.types[a].flip].tag)}]
    first = [t for t in tags if t.startswith("Kd_") and (t[3:] == p.types[0].tag or p.of_tag(t[3:]) == [p.types[0].flip])]
    spark = molecules.sparkSession
    ends = of_loop.select("mol_id", F.explode("ends").alias("e")).withColumn("k", F.when(F.col("e").rlike("^[a-z]{2}$"), "matchlowercase").otherwise(F.col("e")))
    fixes = ends.join(F.broadcast(spark.createDataFrame(names or [("", "")], "tag string, k string")), "k").select("mol_id", "tag", F.lit(0.5).alias("dlogz_dlogp"))
    every = each.unionByName(fixes)
    for t in first:
        every = every.unionByName(ends.select("mol_id", F.lit(t).alias("tag"), F.lit(-0.5).alias("dlogz_dlogp")))
        every = every.unionByName(of_loop.select("mol_id", F.lit(t).alias("tag"), (F.size("strands") - 1).cast("double").alias("dlogz_dlogp")))
        every = every.unionByName(joined.filter("has").select("mol_id", F.lit(t).alias("tag"), (-F.col("c")).cast("double").alias("dlogz_dlogp")))
    for t, count in (("l", F.col("n").cast("double")), ("C_init", F.lit(1.0))):
        if t in tags:
            every = every.unionByName(joined.filter(~F.col("has") & _ring()).select("mol_id", F.lit(t).alias("tag"), count.alias("dlogz_dlogp")))
    return out, every.groupBy("mol_id", "tag").agg(F.sum("dlogz_dlogp").alias("dlogz_dlogp"))


KEY = ["strands", "structure"]
KEPT_DDL = "strands array<string>, structure string, log_z double, param_set string"
#: The loops that occur most often are looked up without a shuffle, so that no other loop is more than a thousandth of all.
COMMON = 1000


def set_key(p: Params) -> str:
    """A name that two sets share only if they give every loop the same energy: a hash of shape and numbers at full precision."""
    return "set-" + hashlib.sha256(json.dumps([shape(p), weights(p)]).encode()).hexdigest()[:32]


def kept_loops(spark: SparkSession, p: Params, path: str) -> DataFrame:
    """(strands, structure, log_z): the loops folded by p that are kept at path, each once; none if nothing is kept there."""
    try:
        rows = spark.read.schema(KEPT_DDL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], KEPT_DDL)
    return rows.filter(F.col("param_set") == set_key(p)).groupBy(*KEY).agg(F.max("log_z").alias("log_z"))


def keep_loops(molecules: DataFrame, p: Params, path: str) -> None:
    """Folds those loops of molecules that are not kept at path, and appends them.

    Rows are worth something each on its own: files of an append that was cut short are whole loops, and the rest is folded
    by the next call. Two calls at once may keep a loop twice, with the same energy; kept_loops() takes it once.
    """
    spark = molecules.sparkSession
    unseen = loops(molecules).select(*KEY).distinct().join(kept_loops(spark, p, path).select(*KEY), KEY, "left_anti")
    folded = partition(unseen.withColumns({"mol_id": F.struct(*KEY), "circle": F.lit(False)}), p)
    folded.select("mol_id.*", "log_z", F.lit(set_key(p)).alias("param_set")).write.mode("append").partitionBy("param_set").parquet(path)


def score_kept(molecules: DataFrame, p: Params, path: str) -> DataFrame:
    """score() of one set, with loop energies kept at path from one call to the next: only loops that no call has met are folded, whichever molecules they are in. Sets of other numbers or shape have rows of their own."""
    keep_loops(molecules, p, path)
    own, table = loops(molecules), kept_loops(molecules.sparkSession, p, path)
    common = own.groupBy(*KEY).count().orderBy(F.desc("count"), *KEY).limit(COMMON).select(*KEY).join(table, KEY)
    tried = own.join(F.broadcast(common), KEY, "left")
    rare = tried.filter("log_z is null").drop("log_z").join(table, KEY)
    found = tried.filter("log_z is not null").unionByName(rare)
    return _together(molecules, found.withColumn("par", F.get(sets_column([p]), 0)), p)
