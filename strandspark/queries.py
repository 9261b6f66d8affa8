"""A query for each operator over molecules that are derived from documents, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.functions import connections, pairs_of, partners, sql, strands_of, structure_of
from strandspark.operators import candidates, defects, fold, observables, scoring, traceback, training
from strandspark.sources import known
from strandspark.sources.params import KT, Params, packaged, resolve

#: The set of the queries that SQL enumerates: stacks, a bulge motif and a hairpin motif, no coaxial stacking.
PLAIN = [
    ("name", "plain"), ("version", "1"), ("min_loop_length", "3"), ("allow_strained_3WJ", "False"), ("Kd_CG", "0.002"), ("Kd_AU", "0.02"), ("Kd_GU", "0.2"),
    ("C_init", "1.5"), ("l", "0.5"), ("l_BP", "0.2"), ("C_eff_stacked_pair", "10.0"), ("C_eff_motif_NN_NNN", "0.7"), ("C_eff_motif_NNNNN", "0.05"),
]
#: Letters a molecule. There are at most 4 ** 8 + 4 ** 7 + ... + 4 different ones, so that SQL can enumerate their structures.
N = 8


def plain() -> Params:
    return resolve(PLAIN)


def sequences(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """(mol_id, sequence, copies): the nucleotide letters of each whole text, cut into consecutive molecules of n letters (the last may be shorter). Each different molecule is one row, named by its sequence, with the number of times that it occurs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = docs.select(F.explode(F.regexp_extract_all(F.regexp_replace(F.upper("text"), "[^ACGU]", ""), F.lit(f"(.{{1,{n}}})"))).alias("sequence"))
    return each.groupBy("sequence").agg(F.count("*").alias("copies")).select(F.col("sequence").alias("mol_id"), "sequence", "copies")


def molecules(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """Repartitioned, as a fold takes far longer than it takes to read a molecule."""
    return fold.linear(sequences(spark, sf_dir, n)).repartition(spark.sparkContext.defaultParallelism * 4)


def _hairpin(n):
    """A structure for n letters: as many nested pairs as fit around three letters or more, at most 3, from the first letter on."""
    k = F.greatest(F.least(F.floor((n - 3) / 2).cast("int"), F.lit(3)), F.lit(0))
    return F.concat(F.repeat(F.lit("("), k), F.repeat(F.lit("."), n - 2 * k), F.repeat(F.lit(")"), k))


def with_structure(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    m = molecules(spark, sf_dir)
    return m.withColumns({"structure": _hairpin(F.length(F.get("strands", 0))), "allow_extra": F.lit(extra)})


def q_strand_parse(spark, sf_dir):
    s = sequences(spark, sf_dir).select("mol_id", "copies", strands_of(F.concat(F.substring("sequence", 1, 5), F.lit("+"), F.substring("sequence", 6, N))).alias("strands"), F.lit(False).alias("circle"))
    return fold.prepare(s).select("mol_id", "copies", F.size("strands").alias("n_strands"), "n", connections(F.col("strands"), F.col("circle")).alias("joints"), F.array_join(F.transform("nicks", lambda k: k.cast("string")), ",").alias("nicks"))


def q_pair_candidates(spark, sf_dir):
    return candidates.pairs(molecules(spark, sf_dir), plain())


def q_pair_constraint_mask(spark, sf_dir):
    return candidates.pairs(with_structure(spark, sf_dir, extra=True), plain())


def q_strand_match(spark, sf_dir):
    got = candidates.strand_matches(molecules(spark, sf_dir), packaged("v0.31"))
    return got.groupBy("mol_id", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i.cast("string")), ",").alias("starts"))


def q_motif_match(spark, sf_dir):
    got = candidates.motif_matches(molecules(spark, sf_dir), plain())
    return got.select("mol_id", "motif", "i", "j", "tag", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("i_next", "j_next")], F.coalesce("tag_next", F.lit("-")).alias("tag_next"))


def q_dotparen_pairs(spark, sf_dir):
    m = with_structure(spark, sf_dir)
    return m.select("mol_id", F.explode(pairs_of(partners(F.col("structure")))).alias("x")).select("mol_id", "x.i", "x.j")


def q_pairs_dotparen(spark, sf_dir):
    m = with_structure(spark, sf_dir)
    return m.select("mol_id", structure_of(pairs_of(partners(F.col("structure"))), F.length("structure")).alias("structure"))


def q_sql_pairs(spark, sf_dir):
    """How often a pair joins two letters in the texts' molecules, in SQL alone: molecules and pairs come from lateral joins with the functions of functions.sql."""
    sql.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(
        """
        WITH m AS (SELECT t.sequence, count(*) AS copies FROM {docs} d, LATERAL molecules_of(d.text, {n}) t GROUP BY t.sequence),
        h AS (SELECT *, CAST(least(greatest(floor((length(sequence) - 3) / 2), 0), 3) AS INT) AS k FROM m),
        st AS (SELECT sequence, copies, concat(repeat('(', k), repeat('.', length(sequence) - 2 * k), repeat(')', k)) AS structure FROM h)
        SELECT substring(st.sequence, p.i + 1, 1) AS nt1, substring(st.sequence, p.j + 1, 1) AS nt2, p.j - p.i AS apart, sum(st.copies) AS times
        FROM st, LATERAL pairs_of(st.structure) p GROUP BY 1, 2, 3
        """,
        docs=docs, n=N,
    )


def q_stack_resolve(spark, sf_dir):
    """The stacks of a set, and how often the texts' molecules hold each of a stack's two strands."""
    seq = F.col("sequence")
    twos = F.transform(F.when(F.length(seq) > 1, F.sequence(F.lit(1), F.length(seq) - 1)), lambda k: F.substring(seq, k, F.lit(2)))
    seen = sequences(spark, sf_dir).select(F.explode(twos).alias("two"), "copies").groupBy("two").agg(F.sum("copies").alias("times"))
    out = candidates.stack_table(spark.range(1), packaged("v0.31"))
    for name, two in (("first_strand", F.concat(F.left("bpt1", F.lit(1)), F.left("bpt2", F.lit(1)))), ("second_strand", F.concat(F.right("bpt2", F.lit(1)), F.right("bpt1", F.lit(1))))):
        out = out.withColumn("two", two).join(seen, "two", "left").select(*out.columns, F.coalesce("times", F.lit(0)).alias(name))
    return out


def q_partition_z(spark, sf_dir):
    got = fold.partition(molecules(spark, sf_dir), plain(), simple=True)
    return got.select("mol_id", "n", F.round("log_z", 6).alias("log_z"), F.round("dg", 6).alias("dg"))


def _rounded(c, digits):
    """c to so many digits, halves up. A fold's logarithms hold a share to some 1e-15, so that an exact half can come out just below itself: c is taken to 12 digits first. No other value of a molecule of N letters by plain() lies within 1e-11 of a half."""
    return F.round(F.round(c, 12), digits)


def _full(spark, sf_dir):
    return fold.fill(molecules(spark, sf_dir), plain(), full=True)


def q_bpp(spark, sf_dir):
    return observables.bpp(_full(spark, sf_dir), plain()).select("mol_id", "i", "j", _rounded("p", 6).alias("p"))


def q_enumerate(spark, sf_dir):
    p = plain()
    got = traceback.enumerate_structures(fold.fill(molecules(spark, sf_dir), p, simple=True), p)
    return got.select("mol_id", "structure", _rounded("p", 6).alias("p"))


def q_logderiv(spark, sf_dir):
    tags = ["Kd_CG", "Kd_AU", "Kd_GU", "C_init", "l", "l_BP", "C_eff_stacked_pair", "C_eff_motif_NNNNN", "C_eff_motif_NN_NNN"]
    got = observables.log_derivatives(_full(spark, sf_dir), plain(), tags)
    return got.select("mol_id", "tag", F.round("dlogz_dlogp", 5).alias("d"))


def q_final_spread(spark, sf_dir):
    filled = fold.fill(molecules(spark, sf_dir), plain(), full=True, finals=True)
    return filled.select("mol_id", F.round(F.log(F.array_min("z_final")), 6).alias("least"), F.round(F.log(F.array_max("z_final")), 6).alias("most"))


def q_energy_gap(spark, sf_dir):
    got = observables.energy_gap(with_structure(spark, sf_dir), plain(), simple=True)
    return got.filter("dg_structure is not null").select("mol_id", F.round("dg_structure", 5).alias("dg_structure"), F.round("dg_gap", 5).alias("dg_gap"))


def q_score_structure(spark, sf_dir):
    return scoring.score(with_structure(spark, sf_dir), plain()).filter("dg is not null").select("mol_id", F.round("dg", 5).alias("dg"))


def _shared_dir(spark):
    """A new path in the folder that all executors share; a temporary one where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/strands-{uuid.uuid4().hex}"


def _all_structures(spark, sf_dir):
    """Every structure of every molecule as a molecule of its own: bare hairpins, stacks, bulges, inner loops and what has no pair. Written once, as all that reads it would enumerate anew."""
    p, path = plain(), _shared_dir(spark)
    found = traceback.enumerate_structures(fold.fill(molecules(spark, sf_dir), p, simple=True), p)
    found.select(F.concat_ws(" ", "mol_id", "structure").alias("mol_id"), F.array("mol_id").alias("strands"), F.lit(False).alias("circle"), "structure").write.parquet(path)
    return spark.read.parquet(path)


def q_score_all(spark, sf_dir):
    """Energies of all structures, each beside its derivatives, loop by loop."""
    tags = ["Kd_CG", "C_init", "l", "l_BP", "C_eff_stacked_pair"]
    energies, slopes = scoring.score(_all_structures(spark, sf_dir), plain(), tags)
    wide = slopes.groupBy("mol_id").pivot("tag", tags).agg(F.first("dlogz_dlogp"))
    return energies.join(wide, "mol_id", "left").select("mol_id", F.round("dg", 5).alias("dg"), *[F.round(F.coalesce(t, F.lit(0.0)), 5).alias(f"d_{t}") for t in tags])


def q_score_kept(spark, sf_dir):
    """Energies of all structures by a table of loops: the hairpins' loops are kept there first, so that only the others are folded then."""
    path = _shared_dir(spark)
    scoring.keep_loops(with_structure(spark, sf_dir), plain(), path)
    return scoring.score_kept(_all_structures(spark, sf_dir), plain(), path).select("mol_id", F.round("dg", 5).alias("dg"))


def q_mfe(spark, sf_dir):
    p = plain()
    return traceback.mfe(fold.fill(molecules(spark, sf_dir), p, simple=True), p)


def q_stochastic(spark, sf_dir):
    p = plain()
    return traceback.samples(fold.fill(molecules(spark, sf_dir), p, simple=True), p, 3)


def _ring(a, b):
    return F.concat(F.lit("C"), F.repeat(F.lit("N"), a), F.lit("G"), F.repeat(F.lit("N"), b))


def _spacers(spark, sf_dir):
    """(mol_id, a, b, documents): spacers of 1 to 12 letters, from how often a whole text holds the letters a and e."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[(F.pmod(F.regexp_count(text, F.lit(c)), F.lit(12)) + 1).cast("int").alias(k) for k, c in (("a", "[aA]"), ("b", "[eE]"))])
    return docs.groupBy("a", "b").agg(F.count("*").alias("documents")).select(F.concat_ws("-", "a", "b").alias("mol_id"), "a", "b", "documents")


def q_circular_z(spark, sf_dir):
    m = _spacers(spark, sf_dir).select("mol_id", "documents", F.array(_ring(F.col("a"), F.col("b"))).alias("strands"), F.lit(True).alias("circle"))
    return fold.fill(m, packaged("minimal"), full=True).select("mol_id", "documents", F.round("log_z", 6).alias("log_z"))


def _pair_of_hairpins(spark, sf_dir):
    return _spacers(spark, sf_dir).select("mol_id", "documents", F.array(F.concat(_ring(F.col("a"), F.lit(0)), _ring(F.col("b"), F.lit(0)))).alias("strands"), F.lit(False).alias("circle"))


def q_coax_z(spark, sf_dir):
    return fold.fill(_pair_of_hairpins(spark, sf_dir), packaged("minimal")).select("mol_id", "documents", F.round("log_z", 6).alias("log_z"))


def q_logderiv_coax(spark, sf_dir):
    got = observables.log_derivatives(fold.fill(_pair_of_hairpins(spark, sf_dir), packaged("minimal"), full=True), packaged("minimal"), ["K_coax", "l_coax", "l", "l_BP", "C_init", "Kd_CG"])
    return got.select("mol_id", "tag", F.round("dlogz_dlogp", 5).alias("d"))


def q_multistrand_z(spark, sf_dir):
    """Two strands whose spacers face each other within a loop of two pairs, C N^a C and G N^b G."""
    strand = lambda x, k: F.concat(F.lit(x), F.repeat(F.lit("N"), k), F.lit(x))
    m = _spacers(spark, sf_dir).select("mol_id", "documents", F.array(strand("C", F.col("a")), strand("G", F.col("b"))).alias("strands"), F.lit(False).alias("circle"))
    return fold.fill(m, packaged("minimal").without_coax()).select("mol_id", "documents", F.round("log_z", 6).alias("log_z"))


def _measured(spark, sf_dir):
    return defects.defects(with_structure(spark, sf_dir), observables.bpp(_full(spark, sf_dir), plain()))


def q_defects(spark, sf_dir):
    return _measured(spark, sf_dir).select("mol_id", "n", "n_bp", _rounded("ensemble_defect", 5).alias("ensemble_defect"), _rounded("bpp_defect", 5).alias("bpp_defect"))


def q_defect_overall(spark, sf_dir):
    """Over all molecules of the texts, each as often as it occurs."""
    copies = sequences(spark, sf_dir).select("mol_id", "copies")
    return defects.overall(_measured(spark, sf_dir).join(copies, "mol_id").withColumn("package", F.lit("own")), ["package"], "copies").select("package", F.round("ensemble_defect", 4).alias("ensemble_defect"), F.round("bpp_defect", 4).alias("bpp_defect"))


def _examples(spark, sf_dir):
    return with_structure(spark, sf_dir).select("mol_id", "strands", "circle", "structure").join(sequences(spark, sf_dir).select("mol_id", "copies"), "mol_id")


def q_loss(spark, sf_dir):
    """Over all molecules of the texts, each as often as it occurs."""
    return training.loss(_examples(spark, sf_dir), plain(), spark, "copies").select("examples", F.round("loss", 3).alias("loss"))


def _stepped(spark, sf_dir):
    tags = ["Kd_CG", "Kd_AU", "Kd_GU", "C_init", "l", "l_BP", "C_eff_stacked_pair", "C_eff_motif_NNNNN"]
    return training.step(_examples(spark, sf_dir), plain(), tags, 1e-6, "copies")


def q_train_step(spark, sf_dir):
    return _stepped(spark, sf_dir).select("tag", F.round("x", 6).alias("x"), F.round("slope", 2).alias("slope"), F.round("x_next", 5).alias("x_next"))


def q_bounds(spark, sf_dir):
    """Bounds and priors of the default set, and of the plain set after a training step over the texts."""
    rows = training.bounds_table(spark, packaged("v0.31")).withColumn("param_set", F.lit("v0.31"))
    after = training.bounded(_stepped(spark, sf_dir).select("tag", F.col("x_next").alias("x"))).withColumn("param_set", F.lit("plain, a step on"))
    return rows.unionByName(after).select("param_set", "tag", *[F.round(c, 4).alias(c) for c in ("lo", "hi", "prior", "prior_slope")])


#: By what the sets of q_param_scan multiply Kd_CG, Kd_AU and Kd_GU.
SCAN = [(a, b, c) for a in (0.25, 1.0, 4.0) for b in (0.5, 2.0) for c in (1.0, 3.0)]


def q_param_scan(spark, sf_dir):
    """Energies of all molecules by each of several parameter sets, in one plan."""
    p = plain()
    sets = [p.updated({f"Kd_{t}": p.values[f"Kd_{t}"] * x for t, x in zip(("CG", "AU", "GU"), row, strict=True)}) for row in SCAN]
    return fold.partition(molecules(spark, sf_dir), p, simple=True, sets=sets).select("mol_id", F.col("set").alias("param_set"), F.round("log_z", 6).alias("log_z"))


def q_mfe_exact(spark, sf_dir):
    """The least energy of each molecule's structures, and the energy of the structure traced back, scored on its own."""
    p = plain()
    found = traceback.best(molecules(spark, sf_dir), p, simple=True)
    own = found.select("mol_id", F.array("mol_id").alias("strands"), F.lit(False).alias("circle"), "structure")
    return found.join(scoring.score(own, p).select("mol_id", F.col("dg").alias("dg_structure")), "mol_id").select("mol_id", F.round("dg", 5).alias("dg"), F.round("dg_structure", 5).alias("dg_structure"))


#: How far above the least energy q_suboptimal goes, in kcal/mol.
ABOVE = 2.5


def q_suboptimal(spark, sf_dir):
    """All structures near each molecule's least energy, without those beyond."""
    return traceback.within(molecules(spark, sf_dir), plain(), ABOVE, simple=True).select("mol_id", "structure", F.round("dg", 5).alias("dg"))


def q_threeway_coax(spark, sf_dir):
    """A pair around two hairpins that touch, a N^p b N b c N c N^t a: three-way loops with and without a stack of the two."""
    p, gap = packaged("minimal"), lambda k: F.repeat(F.lit("N"), k)
    m = _spacers(spark, sf_dir).select("mol_id", "documents", F.array(F.concat(F.lit("a"), gap(F.col("a")), F.lit("bNbcNc"), gap(F.col("b")), F.lit("a"))).alias("strands"), F.lit(False).alias("circle"))
    filled = fold.fill(m, p, full=True)
    slopes = observables.log_derivatives(filled, p, ["l_coax", "K_coax", "l_BP"]).groupBy("mol_id").pivot("tag", ["l_coax", "K_coax", "l_BP"]).agg(F.first("dlogz_dlogp"))
    return filled.select("mol_id", "documents", "log_z").join(slopes, "mol_id").select("mol_id", "documents", F.round("log_z", 6).alias("log_z"), *[F.round(c, 5).alias(f"d_{c}") for c in ("l_coax", "K_coax", "l_BP")])


def q_favorites(spark, sf_dir):
    """Defects of the known natural structures, molecule by molecule and over all, and how many of the texts' molecules are a piece of each."""
    p = packaged("v0.18")
    m = known.molecules(spark, "favorites").drop("force").repartition(9, "mol_id")
    measured = defects.defects(m, observables.bpp(fold.fill(m.drop("structure"), p, full=True), p)).withColumns({"package": F.lit("v0.18"), "name": F.col("mol_id")})
    rows = measured.select("package", "name", "ensemble_defect", "bpp_defect").unionByName(defects.overall(measured, ["package"]).select("package", F.lit("OVERALL").alias("name"), "ensemble_defect", "bpp_defect"))
    text = F.array_join("strands", "")
    windows = F.transform(F.sequence(F.lit(1), F.length(text) - N + 1), lambda k: F.substring(text, k, F.lit(N)))
    pieces = m.select(F.col("mol_id").alias("name"), F.explode(windows).alias("sequence"))
    pieces = pieces.unionByName(pieces.withColumn("name", F.lit("OVERALL"))).distinct()
    seen = pieces.join(sequences(spark, sf_dir), "sequence").groupBy("name").agg(F.sum("copies").alias("pieces"))
    return rows.join(seen, "name", "left").select("package", "name", F.round("ensemble_defect", 4).alias("ensemble_defect"), F.round("bpp_defect", 4).alias("bpp_defect"), F.coalesce("pieces", F.lit(0)).alias("pieces"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_SEQ = f"SELECT unnest(regexp_extract_all(regexp_replace(upper(text), '[^ACGU]', '', 'g'), '.{{1,{N}}}')) AS s FROM documents"
_MOLS = f"m AS MATERIALIZED (SELECT s AS mol_id, s, length(s)::INT AS n, count(*) AS copies FROM ({_SEQ}) GROUP BY s)"
_TYPES = "t(tag, nt1, nt2, kd) AS (VALUES ('CG','C','G',0.002),('GC','G','C',0.002),('AU','A','U',0.02),('UA','U','A',0.02),('GU','G','U',0.2),('UG','U','G',0.2))"
_POS = "pos AS (SELECT mol_id, n, k::INT AS k, s[k + 1] AS nt FROM (SELECT mol_id, s, n, unnest(range(0, n)) AS k FROM m))"
_CAN = "can AS (SELECT a.mol_id, a.n, a.k AS i, b.k AS j, t.tag FROM pos a JOIN t ON a.nt = t.nt1 JOIN pos b ON a.mol_id = b.mol_id AND b.nt = t.nt2 WHERE abs(a.k - b.k) - 1 >= 3)"
_PAIRS = "least(greatest(((n - 3) // 2), 0), 3)"
_STRUCT = f"st AS (SELECT mol_id, n, repeat('(', {_PAIRS}::INT) || repeat('.', (n - 2 * {_PAIRS})::INT) || repeat(')', {_PAIRS}::INT) AS structure FROM m)"
#: All structures of each molecule, letter by letter, with weight, and the expected numbers behind its derivatives.
_ENUM = f"""
{_MOLS}, {_TYPES},
grown AS (
  SELECT mol_id, s, n, 0 AS k, '' AS structure, 1.0::DOUBLE AS w, []::STRUCT(i INT, u INT, b INT, t VARCHAR)[] AS open, 0.0::DOUBLE AS xl, 0.0::DOUBLE AS xb, 0.0::DOUBLE AS xc, 0.0::DOUBLE AS xs, 0.0::DOUBLE AS xh, 0.0::DOUBLE AS xm, 0 AS cg, 0 AS au, 0 AS gu FROM m
  UNION ALL
  SELECT g.mol_id, g.s, g.n, g.k + 1, g.structure || c.c,
    CASE WHEN c.c = ')' THEN g.w / t.kd * (c.a + c.st + c.hp + c.bu) ELSE g.w END,
    CASE WHEN c.c = '(' THEN list_append(c.held, {{'i': g.k, 'u': 0, 'b': 0, 't': ''}}) WHEN c.c = '.' AND len(g.open) > 0 THEN list_append(c.rest, {{'i': c.top.i, 'u': c.top.u + 1, 'b': c.top.b, 't': c.top.t}})
      WHEN c.c = ')' AND len(c.rest) > 0 THEN list_append(c.rest[1:len(c.rest) - 1], {{'i': c.rest[len(c.rest)].i, 'u': c.rest[len(c.rest)].u, 'b': c.rest[len(c.rest)].b + 1, 't': ''}}) WHEN c.c = ')' THEN c.rest ELSE g.open END,
    g.xl + CASE WHEN c.c = ')' THEN (c.top.u + c.top.b + 1) * c.a / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.xb + CASE WHEN c.c = ')' THEN (c.top.b + 1) * c.a / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.xc + CASE WHEN c.c = ')' THEN c.a / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.xs + CASE WHEN c.c = ')' THEN c.st / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.xh + CASE WHEN c.c = ')' THEN c.hp / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.xm + CASE WHEN c.c = ')' THEN c.bu / (c.a + c.st + c.hp + c.bu) ELSE 0 END,
    g.cg + CASE WHEN c.c = ')' AND t.tag IN ('CG','GC') THEN 1 ELSE 0 END, g.au + CASE WHEN c.c = ')' AND t.tag IN ('AU','UA') THEN 1 ELSE 0 END, g.gu + CASE WHEN c.c = ')' AND t.tag IN ('GU','UG') THEN 1 ELSE 0 END
  FROM grown g,
  LATERAL (SELECT x.c, g.open AS held, g.open[len(g.open)] AS top, g.open[1:len(g.open) - 1] AS rest,
    1.5 * pow(0.5, g.open[len(g.open)].u + g.open[len(g.open)].b + 1) * pow(0.2, g.open[len(g.open)].b + 1) AS a,
    CASE WHEN g.open[len(g.open)].u = 0 AND g.open[len(g.open)].b = 1 THEN 10.0 ELSE 0.0 END AS st,
    CASE WHEN g.open[len(g.open)].u = 3 AND g.open[len(g.open)].b = 0 THEN 0.05 ELSE 0.0 END AS hp,
    CASE WHEN g.open[len(g.open)].u = 1 AND g.open[len(g.open)].b = 1 THEN 0.7 ELSE 0.0 END AS bu
    FROM (VALUES ('.'), ('('), (')')) AS x(c)) AS c
  LEFT JOIN t ON c.c = ')' AND t.nt1 = g.s[c.top.i + 1] AND t.nt2 = g.s[g.k + 1]
  WHERE g.k < g.n AND (c.c <> ')' OR (len(g.open) > 0 AND t.tag IS NOT NULL AND g.k - c.top.i - 1 >= 3)) AND (c.c <> '(' OR len(g.open) + 1 < g.n - g.k)
),
e AS MATERIALIZED (SELECT * FROM grown WHERE k = n AND len(open) = 0),
z AS (SELECT mol_id, n, sum(w) AS z FROM e GROUP BY mol_id, n)
"""
_LEVEL = "sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY mol_id, structure ORDER BY k)"
_SPLIT = "SELECT DISTINCT mol_id, structure, k::INT AS k, structure[k + 1] AS c FROM (SELECT mol_id, structure, unnest(range(0, length(structure))) AS k FROM {src})"
_MATCH = "SELECT mol_id, structure, min(k)::INT AS i, max(k)::INT AS j FROM (SELECT mol_id, structure, k, lv, ((row_number() OVER (PARTITION BY mol_id, structure, lv ORDER BY k)) - 1) // 2 AS r FROM (SELECT mol_id, structure, k, lev + (c = ')')::INT AS lv FROM (SELECT *, {level} AS lev FROM ({split})) WHERE c <> '.')) GROUP BY mol_id, structure, lv, r"


def _matched(src: str) -> str:
    return _MATCH.format(level=_LEVEL, split=_SPLIT.format(src=src))


_BPP = f"{_ENUM}, bp AS (SELECT x.mol_id, x.i, x.j, sum(e.w / z.z) AS p FROM ({_matched('e')}) x JOIN e USING (mol_id, structure) JOIN z USING (mol_id) GROUP BY x.mol_id, x.i, x.j)"
_DEF = f"""{_BPP}, {_STRUCT}, tp AS (SELECT mol_id, i, j FROM ({_matched('st')})),
per AS (SELECT st.mol_id, st.n::INT AS n, (SELECT count(*) FROM tp WHERE tp.mol_id = st.mol_id)::INT AS n_bp,
  (SELECT coalesce(sum(1 - coalesce(bp.p, 0)), 0) FROM tp LEFT JOIN bp ON tp.mol_id = bp.mol_id AND tp.i = bp.i AND tp.j = bp.j WHERE tp.mol_id = st.mol_id) AS miss,
  (SELECT coalesce(sum(bp.p * ((NOT EXISTS (SELECT 1 FROM tp WHERE tp.mol_id = bp.mol_id AND bp.i IN (tp.i, tp.j)))::INT + (NOT EXISTS (SELECT 1 FROM tp WHERE tp.mol_id = bp.mol_id AND bp.j IN (tp.i, tp.j)))::INT)), 0) FROM bp WHERE bp.mol_id = st.mol_id) AS stray FROM st)"""
_H = """a AS (SELECT a || '-' || b AS mol_id, a, b, count(*) AS documents FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '[aA]')) % 12 + 1 AS a, len(regexp_extract_all(coalesce(text, ''), '[eE]')) % 12 + 1 AS b FROM documents) GROUP BY a, b),
h AS (SELECT *, pow(0.5, a + 1) * 0.2 / 0.0002 AS x, pow(0.5, b + 1) * 0.2 / 0.0002 AS y, pow(0.5, a + b + 3) * 0.2 / 0.0002 AS w FROM a)"""
_DG = f"(-{KT!r})"
_TARGET = f"(e.structure = (SELECT structure FROM st WHERE st.mol_id = e.mol_id))"

_STACKS = ", ".join(f"('{t[12:14]}','{t[15:]}',{v!r})" for t, v in packaged("v0.31").values.items() if t.startswith("C_eff_stack_"))
_TAGS = ", ".join(f"('{t}',{v!r}::DOUBLE)" for t, v in packaged("v0.31").values.items())
_SHAPES = ", ".join(f"('{s}','^{fold.strand_pattern(s)}$')" for s in sorted({s for m in packaged("v0.31").motifs for s in m.strands}))
#: Slopes of the loss by enumeration.
_STEP = f"""WITH RECURSIVE {_ENUM}, {_STRUCT}, tags(tag, x) AS (VALUES {", ".join(f"('{t}', ln({v}))" for t, v in PLAIN[4:] if t != "C_eff_motif_NN_NNN")}),
c AS (SELECT e.mol_id, w / z AS share, {_TARGET} AS own, UNNEST([-cg, -au, -gu, xc, xl, xb, xs, xh]) AS v, UNNEST(['Kd_CG', 'Kd_AU', 'Kd_GU', 'C_init', 'l', 'l_BP', 'C_eff_stacked_pair', 'C_eff_motif_NNNNN']) AS tag FROM e JOIN z USING (mol_id)),
d AS (SELECT tag, {KT!r} * sum(copies * v * (share - own::INT)) AS slope FROM c JOIN m USING (mol_id) WHERE mol_id IN (SELECT mol_id FROM e WHERE {_TARGET}) GROUP BY tag)"""
SQL: dict[str, str] = {
    "q_strand_parse": f"WITH {_MOLS} SELECT mol_id, copies, CASE WHEN n > 5 THEN 2 ELSE 1 END AS n_strands, n, CASE WHEN n > 5 THEN 1 ELSE 0 END AS joints, CASE WHEN n > 5 THEN '4,' || (n - 1) ELSE '' || (n - 1) END AS nicks FROM m",
    "q_pair_candidates": f"WITH {_MOLS}, {_TYPES}, {_POS}, {_CAN} SELECT mol_id, i, j, tag FROM can",
    "q_pair_constraint_mask": f"WITH {_MOLS}, {_TYPES}, {_POS}, {_CAN}, x AS (SELECT *, {_PAIRS} AS h FROM can) SELECT mol_id, i, j, tag FROM x WHERE (i + j = n - 1 AND least(i, j) < h) OR (least(i, j) >= h AND greatest(i, j) < n - h)",
    "q_strand_match": f"WITH {_MOLS}, v(strand, re) AS (VALUES {_SHAPES}) SELECT mol_id, strand, string_agg(k, ',' ORDER BY k) AS starts FROM (SELECT mol_id, s, unnest(range(0, n)) AS k FROM m) JOIN v ON regexp_matches(substr(s, (k + 1)::INT, length(strand)::INT), re) GROUP BY mol_id, strand",
    "q_motif_match": f"""WITH {_MOLS}, {_TYPES}, {_POS}, {_CAN}
SELECT mol_id, 'NNNNN' AS motif, i, j, tag, -1 AS i_next, -1 AS j_next, '-' AS tag_next FROM can WHERE j = i + 4
UNION ALL SELECT a.mol_id, v.motif, a.i, a.j, a.tag, b.i, b.j, b.tag FROM can a JOIN can b ON a.mol_id = b.mol_id JOIN (VALUES ('NN_NNN', 1, 2), ('NNN_NN', 2, 1)) v(motif, p, q)
  ON b.i = (a.i + v.p) % a.n AND b.j = (a.j - v.q + a.n) % a.n AND (a.j - a.i + a.n) % a.n >= 4 AND (CASE WHEN a.i < a.j THEN true ELSE a.i + v.p < a.n AND a.j - v.q >= 0 END)""",
    "q_dotparen_pairs": f"WITH {_MOLS}, {_STRUCT} SELECT mol_id, i, j FROM ({_matched('st')})",
    "q_pairs_dotparen": f"WITH {_MOLS}, {_STRUCT} SELECT mol_id, structure FROM st",
    "q_sql_pairs": f"WITH {_MOLS}, {_STRUCT} SELECT s[i + 1] AS nt1, s[j + 1] AS nt2, j - i AS apart, sum(copies)::BIGINT AS times FROM ({_matched('st')}) JOIN m USING (mol_id) GROUP BY 1, 2, 3",
    "q_stack_resolve": f"""WITH {_MOLS}, g(b1, b2, c, o) AS (SELECT *, row_number() OVER () FROM (VALUES {_STACKS})), u AS (SELECT b1 AS bpt1, b2 AS bpt2, c, o FROM g UNION ALL SELECT reverse(b2), reverse(b1), c, o + 0.5 FROM g),
r AS (SELECT bpt1, bpt2, arg_max(c, o)::DOUBLE AS c_eff FROM u GROUP BY bpt1, bpt2), two AS (SELECT substr(s, k::INT, 2) AS two, sum(copies)::BIGINT AS times FROM (SELECT s, copies, unnest(range(1, n)) AS k FROM m) GROUP BY 1)
SELECT bpt1, bpt2, c_eff, coalesce((SELECT times FROM two WHERE two.two = bpt1[1] || bpt2[1]), 0) AS first_strand, coalesce((SELECT times FROM two WHERE two.two = bpt2[2] || bpt1[2]), 0) AS second_strand FROM r""",
    "q_partition_z": f"WITH RECURSIVE {_ENUM} SELECT mol_id, n, round(ln(z), 6) AS log_z, round({_DG} * ln(z), 6) AS dg FROM z",
    "q_bpp": f"WITH RECURSIVE {_BPP} SELECT mol_id, i, j, round(p, 6) AS p FROM bp",
    "q_enumerate": f"WITH RECURSIVE {_ENUM} SELECT e.mol_id, e.structure, round(e.w / z.z, 6) AS p FROM e JOIN z USING (mol_id)",
    "q_logderiv": f"""WITH RECURSIVE {_ENUM}, d AS (SELECT e.mol_id, sum(-w / z * cg) AS "Kd_CG", sum(-w / z * au) AS "Kd_AU", sum(-w / z * gu) AS "Kd_GU", sum(w / z * xc) AS "C_init", sum(w / z * xl) AS "l", sum(w / z * xb) AS "l_BP", sum(w / z * xs) AS "C_eff_stacked_pair", sum(w / z * xh) AS "C_eff_motif_NNNNN", sum(w / z * xm) AS "C_eff_motif_NN_NNN" FROM e JOIN z USING (mol_id) GROUP BY e.mol_id)
SELECT mol_id, tag, round(v, 5) AS d FROM (UNPIVOT d ON COLUMNS(* EXCLUDE mol_id) INTO NAME tag VALUE v)""",
    "q_final_spread": f"WITH RECURSIVE {_ENUM} SELECT mol_id, round(ln(z), 6) AS least, round(ln(z), 6) AS most FROM z",
    "q_energy_gap": f"WITH RECURSIVE {_ENUM}, {_STRUCT} SELECT e.mol_id, round({_DG} * ln(e.w), 5) AS dg_structure, round({_DG} * ln(e.w) - {_DG} * ln(z.z), 5) AS dg_gap FROM e JOIN z USING (mol_id) WHERE {_TARGET}",
    "q_score_structure": f"WITH RECURSIVE {_ENUM}, {_STRUCT} SELECT e.mol_id, round({_DG} * ln(e.w), 5) AS dg FROM e WHERE {_TARGET}",
    "q_score_all": f"""WITH RECURSIVE {_ENUM} SELECT mol_id || ' ' || structure AS mol_id, round({_DG} * ln(w), 5) AS dg, round((-cg)::DOUBLE, 5) AS "d_Kd_CG", round(xc, 5) AS "d_C_init", round(xl, 5) AS "d_l", round(xb, 5) AS "d_l_BP", round(xs, 5) AS "d_C_eff_stacked_pair" FROM e""",
    "q_score_kept": f"WITH RECURSIVE {_ENUM} SELECT mol_id || ' ' || structure AS mol_id, round({_DG} * ln(w), 5) AS dg FROM e",
    "q_circular_z": f"WITH {_H} SELECT mol_id, documents, round(ln(pow(0.5, a + b + 2) * (1 + 0.2 * 0.2 / 0.0002)), 6) AS log_z FROM a",
    "q_coax_z": f"WITH {_H} SELECT mol_id, documents, round(ln((1 + x) * (1 + y) + w + x * y * 100), 6) AS log_z FROM h",
    "q_logderiv_coax": f"""WITH {_H}, z AS (SELECT *, (1 + x) * (1 + y) + w + x * y * 100 AS z, x + y + 2 * x * y + w + 200 * x * y AS pairs FROM h),
d AS (SELECT mol_id, x * y * 100 / z AS "K_coax", 0.0::DOUBLE AS "l_coax", ((a + 1) * x * (1 + y) + (b + 1) * y * (1 + x) + (a + b + 3) * w + (a + b + 2) * x * y * 100) / z AS "l", pairs / z AS "l_BP", pairs / z AS "C_init", -pairs / z AS "Kd_CG" FROM z)
SELECT mol_id, tag, round(v, 5) AS d FROM (UNPIVOT d ON COLUMNS(* EXCLUDE mol_id) INTO NAME tag VALUE v)""",
    "q_multistrand_z": f"WITH {_H} SELECT mol_id, documents, round(ln(1 / 0.0002 * (4 + pow(0.5, a + b + 2) * 0.2 * 0.2 / 0.0002)), 6) AS log_z FROM a",
    "q_defects": f"WITH RECURSIVE {_DEF} SELECT mol_id, n, n_bp, round((2 * miss + stray) / n, 5) AS ensemble_defect, round(CASE WHEN n_bp > 0 THEN miss / n_bp END, 5) AS bpp_defect FROM per",
    "q_defect_overall": f"WITH RECURSIVE {_DEF} SELECT 'own' AS package, round(sum((2 * miss + stray) * copies) / sum(per.n * copies), 4) AS ensemble_defect, round(sum(miss * copies) / sum(n_bp * copies), 4) AS bpp_defect FROM per JOIN m USING (mol_id)",
    "q_loss": f"WITH RECURSIVE {_ENUM}, {_STRUCT} SELECT sum(copies)::BIGINT AS examples, round(sum(copies * ({_DG} * ln(e.w) - {_DG} * ln(z.z))), 3) AS loss FROM e JOIN z USING (mol_id) JOIN m USING (mol_id) WHERE {_TARGET}",
    "q_train_step": f"""{_STEP}
SELECT tag, round(x, 6) AS x, round(slope, 2) AS slope, round(x - 1e-6 * slope, 5) AS x_next FROM tags JOIN d USING (tag)""",
    "q_bounds": f"""{_STEP}, v(param_set, tag, x) AS (SELECT 'v0.31', tag, ln(val) FROM (VALUES {_TAGS}) AS w(tag, val) UNION ALL SELECT 'plain, a step on', tag, x - 1e-6 * slope FROM tags JOIN d USING (tag)),
b AS (SELECT param_set, tag, x, CASE WHEN tag LIKE 'Kd%' THEN ln(100.0) ELSE ln(0.1) END AS lo, CASE WHEN tag LIKE 'Kd%' OR tag LIKE 'C_eff%' THEN ln(100000.0) WHEN tag IN ('C_init', 'K_coax') THEN ln(100.0) ELSE ln(10.0) END AS hi FROM v)
SELECT param_set, tag, round(lo, 4) AS lo, round(hi, 4) AS hi, round(CASE WHEN x < lo THEN (x - lo) * (x - lo) WHEN x > hi THEN (x - hi) * (x - hi) ELSE 0 END, 4) AS prior, round(CASE WHEN x < lo THEN 2 * (x - lo) WHEN x > hi THEN 2 * (x - hi) ELSE 0 END, 4) AS prior_slope FROM b""",
    "q_param_scan": f"""WITH RECURSIVE {_ENUM}, v(param_set, fcg, fau, fgu) AS (VALUES {", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in enumerate(SCAN))})
SELECT mol_id, param_set, round(ln(sum(w * pow(fcg, -cg) * pow(fau, -au) * pow(fgu, -gu))), 6) AS log_z FROM e, v GROUP BY mol_id, param_set""",
    "q_mfe_exact": f"WITH RECURSIVE {_ENUM} SELECT mol_id, round({_DG} * ln(max(w)), 5) AS dg, round({_DG} * ln(max(w)), 5) AS dg_structure FROM e GROUP BY mol_id",
    "q_suboptimal": f"WITH RECURSIVE {_ENUM}, least AS (SELECT mol_id, max(w) AS top FROM e GROUP BY mol_id) SELECT mol_id, structure, round({_DG} * ln(w), 5) AS dg FROM e JOIN least USING (mol_id) WHERE w >= top * exp(-{ABOVE} / {KT!r} - 1e-9)",
    "q_threeway_coax": f"""WITH {_H}, x AS (SELECT mol_id, documents, a, b, pow(0.5::DOUBLE, 2) * 0.2 / 0.0002 AS x, pow(0.5::DOUBLE, a + b + 7) * 0.2 / 0.0002 AS w0, pow(0.5::DOUBLE, a + b + 5) * 0.2 * 0.2 / 0.0002 AS w1, pow(0.5::DOUBLE, a + b + 3) * pow(0.2::DOUBLE, 3) / 0.0002 AS w2, pow(0.5::DOUBLE, a + b + 2) * 0.2 * 200 * 100 / 0.0002 AS w3 FROM a),
y AS (SELECT *, x * x * 100 AS outer_coax, x * x * w3 AS inner_coax, 1 + 2 * x + x * x * 101 + w0 + 2 * w1 * x + x * x * (w2 + w3) AS z FROM x)
SELECT mol_id, documents, round(ln(z), 6) AS log_z, round(inner_coax / z, 5) AS "d_l_coax", round((inner_coax + outer_coax) / z, 5) AS "d_K_coax", round((2 * x + 2 * x * x * 101 + w0 + 2 * w1 * x * 3 + x * x * (w2 * 5 + w3 * 3)) / z, 5) AS "d_l_BP" FROM y""",
}
