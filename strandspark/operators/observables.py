"""What filled molecules tell: base-pair probabilities, derivatives, energy gaps and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions import built, span, total
from strandspark.operators.fold import BP, C, COAX, CUT, NB, NC, Molecule, fill, molecule, nothing, possible, shape
from strandspark.sources.params import Params, stack_of_motif


def _grid(n: Column, least: int, use) -> Column:
    """use(i, d) for all cells of offset least and more, flattened."""
    return F.flatten(F.transform(span(least, n - 1), lambda d: F.flatten(F.transform(span(0, n - 1), lambda i: use(i, d)))))


def _opposite(mol: Molecule, i, d, t):
    """Logarithm of the weight of the same pair seen from outside: the flipped type at (i + d, n - d)."""
    flip = F.get(F.array(*[F.lit(x.flip) for x in mol.p.types]), t)
    j, e = i + d, mol.n - d
    return F.coalesce(F.get(mol.cell(j, e)["q"], F.array_position(mol.possible(j, e), flip).cast("int") - 1), nothing())


def _pairs(mol: Molecule, z: Column) -> Column:
    kd = mol.par["kd"]

    def at(i, d):
        weigh = lambda t, k: F.struct(i.alias("i"), F.pmod(i + d, mol.n).alias("j"), t.alias("t"), F.exp(F.get(mol.cell(i, d)["q"], k) + _opposite(mol, i, d, t) + F.get(kd, t) - z).alias("p"))
        return F.transform(mol.possible(i, d), weigh)

    return _grid(mol.n, 1, at)


def typed_pairs(filled: DataFrame, p: Params) -> DataFrame:
    """(mol_id, i, j, t, p) of fully filled molecules: the probability that i and j pair as type t, for both orders of i and j."""
    mol = molecule(p, True, F.col("cells"))
    return possible(filled).select("mol_id", F.explode(F.when(F.col("n") > 0, built(("pairs", shape(p)), lambda: _pairs(mol, F.col("log_z"))))).alias("x")).select("mol_id", "x.*")


def bpp(filled: DataFrame, p: Params) -> DataFrame:
    """(mol_id, i, j, p), i < j: base-pair probabilities above 0."""
    return typed_pairs(filled, p).filter("i < j").groupBy("mol_id", "i", "j").agg(F.sum("p").alias("p")).filter("p > 0")


def bpp_matrix_lines(filled: DataFrame, p: Params) -> DataFrame:
    """(mol_id, i, line): rows of the dense symmetric matrix as text, 25 characters a number."""
    both = bpp(filled, p)
    both = both.union(both.select("mol_id", F.col("j"), F.col("i"), "p"))
    cells = filled.select("mol_id", F.explode(span(0, F.col("n") - 1)).alias("i"), "n").select("mol_id", "i", F.explode(span(0, F.col("n") - 1)).alias("j"))
    dense = cells.join(both, ["mol_id", "i", "j"], "left").select("mol_id", "i", "j", F.format_string("%25.12f", F.coalesce("p", F.lit(0.0))).alias("t"))
    return dense.groupBy("mol_id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda x: x["t"]), "").alias("line"))


def _scalars(mol: Molecule, z: Column) -> dict[str, Column]:
    """Expected numbers of the loop parameters, each at every molecule. z: its logarithm. Every term is a share of the whole."""
    s, n, g = mol.par, mol.n, mol.get
    join, close = (C, C) if mol.p.strained else (NB, NC)
    bonded = lambda i, d: mol.bond(i) & mol.bond(i + d - 1)
    share = lambda cond, x: F.when(cond, F.exp(x - z)).otherwise(F.lit(0.0))
    cells = lambda least, term: total(span(least, n - 1), lambda d: total(span(0, n - 1), lambda i: term(i, d)))
    once = s["l"] * 2 + s["l_BP"]
    looped = lambda i, d: g(close, i + 1, d - 2) + g(BP, i + d, n - d) + once
    around = F.when(mol.bond(n - 1), F.coalesce(F.exp(g(NC, F.lit(0), n - 1) + s["l"] - z), F.lit(0.0))).otherwise(F.lit(0.0))
    out = {
        "l": total(F.filter(span(0, n - 1), mol.bond), lambda i: F.exp(g(NC, i + 1, n - 1) + s["l"] - z)),
        "l_BP": cells(2, lambda i, d: share(bonded(i, d), looped(i, d))),
        "C_init": cells(2, lambda i, d: share((i + d < n) & bonded(i, d), looped(i, d))) + around,
    }
    if mol.p.scalars["K_coax"] > 0:
        closed, two = s["l"] * 2 + s["l_coax"] + s["K_coax"], s["l"] * 2 + s["l_coax"]
        stacks = lambda i, d, x: total(span(2, d - 2), lambda m: share(mol.bond(i + m), g(BP, i + 1, m - 1) + g(join, i + m + 1, d - m - 2) + x) + share(mol.bond(i + m - 1), g(join, i + 1, m - 2) + g(BP, i + m, d - 1 - m) + x))
        within = cells(2, lambda i, d: F.when((i + d < n) & bonded(i, d), stacks(i, d, g(BP, i + d, n - d) + closed)).otherwise(F.lit(0.0)))
        joint = total(span(1, n - 2), lambda m: total(span(m + 2, n - 2), lambda k: share(mol.bond(m) & mol.bond(k - 1), g(BP, F.lit(0), m) + g(join, m + 1, k - m - 2) + g(BP, k, n - 1 - k) + closed)))
        out["C_init"] = out["C_init"] + within + F.when(mol.bond(n - 1), joint).otherwise(F.lit(0.0))
        coaxed = cells(1, lambda i, d: share((n - d >= 2) & mol.bond(i - 1) & mol.bond(i + d), g(COAX, i, d) + g(join, i + d + 1, n - d - 2) + two))
        opened = cells(1, lambda i, d: F.exp(g(COAX, i, d) + g(CUT, i + d, n - d) - z))
        out |= {"l_coax": coaxed, "K_coax": coaxed + opened}
    return out


def _stack_counts(mol: Molecule, z: Column) -> Column:
    size = len(mol.p.types)

    def at(i, d):
        def both(a, _k):
            weigh = lambda b, u: F.struct(a.alias("a"), b.alias("b"), F.exp(F.get(mol.par["stack"], a * size + b) + _opposite(mol, i, d, a) + F.get(mol.cell(i + 1, d - 2)["q"], u) - z).alias("x"))
            return F.transform(mol.possible(i + 1, d - 2), weigh)

        return F.when(mol.bond(i) & mol.bond(i + d - 1), F.flatten(F.transform(mol.possible(i, d), both))).otherwise(F.array().cast("array<struct<a:int,b:int,x:double>>"))

    return _grid(mol.n, 3, at)


def _motif_counts(mol: Molecule, z: Column) -> Column:
    def at(i, d):
        inner = lambda x: F.when(x["d"] < 0, F.lit(0.0)).otherwise(F.get(mol.cell(x["i"], x["d"])["q"], x["u"]))
        return F.transform(mol.loops(i, d), lambda x: F.struct(x["m"].alias("m"), F.exp(F.get(mol.par["motif"], x["m"]) + inner(x) + _opposite(mol, i, d, F.get(mol.possible(i, d), x["t"])) - z).alias("x")))

    return _grid(mol.n, 1, at)


def log_derivatives(filled: DataFrame, p: Params, tags: list[str] | None = None) -> DataFrame:
    """(mol_id, tag, dlogz_dlogp) of fully filled molecules for the given tags, all of the set if none are given.

    Each derivative is an expected count: of loops, linkages, pairs, stacks, motifs. A molecule lists all its counts in
    one pass over its cells. An unknown tag raises an error.
    """
    tags = list(p.values) if tags is None else tags
    if unknown := [t for t in tags if t not in p.values and t != "Kd"]:
        raise ValueError(f"no such parameters: {unknown}")
    mol, z = molecule(p, True, F.col("cells")), F.col("log_z")
    # (kind, key) of each count, and with what factor it belongs to a tag
    factors: list[tuple[str, str, float, str]] = [("none", t, 0.0, t) for t in tags]
    count = lambda kind, key, x: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), x.cast("double").alias("x"))
    parts: list[Column] = []
    if scalar := [t for t in tags if t in p.scalars]:
        own = {t: built(("scalar", t, shape(p)), lambda t=t: _scalars(mol, z).get(t, F.lit(0.0))) for t in scalar}
        parts.append(F.array(*[count("scalar", F.lit(t), own.get(t, F.lit(0.0))) for t in scalar]))
        factors += [("scalar", t, 1.0, t) for t in scalar]
    if pairs := [t for t in tags if t.startswith("Kd")]:
        parts.append(F.transform(F.filter(built(("pairs", shape(p)), lambda: _pairs(mol, z)), lambda x: x["i"] < x["j"]), lambda x: count("pair", x["t"], x["p"])))
        for tag in pairs:
            own = set(range(len(p.types))) if tag == "Kd" else {k for a in p.of_tag(tag[3:]) for k in (a, p.types[a].flip)}
            factors += [("pair", str(k), -1.0, tag) for k in own]
    stacks: dict[str, list[tuple[int, int]]] = {}
    motifs: list[str] = []
    for tag in tags:
        if tag == "C_eff_stacked_pair":
            stacks[tag] = [(a, b) for a in range(len(p.types)) for b in range(len(p.types))]
        elif tag.startswith(("C_eff_stack_", "C_eff_motif_")):
            pair = tag[12:] if tag.startswith("C_eff_stack_") else stack_of_motif(tag[12:])
            if pair:
                first, second = (p.of_tag(x) for x in pair.split("_"))
                stacks[tag] = [(a, b) for a in first for b in second]
            else:
                motifs.append(tag)
    if stacks:
        parts.append(F.transform(built(("stacks", shape(p)), lambda: _stack_counts(mol, z)), lambda x: count("stack", F.concat_ws("_", x["a"], x["b"]), x["x"])))
        for tag, cells in stacks.items():
            mirrored: set[tuple[int, int]] = set()
            for a, b in cells:
                if (a, b) not in mirrored:
                    mirror = (p.types[b].flip, p.types[a].flip)
                    mirrored |= {(a, b), mirror}
                    factors.append(("stack", f"{a}_{b}", 0.5 if mirror == (a, b) else 1.0, tag))
    if motifs:
        parts.append(F.transform(built(("motif_counts", shape(p)), lambda: _motif_counts(mol, z)), lambda x: count("motif", x["m"], x["x"])))
        for tag in motifs:
            own = [k for k, m in enumerate(p.motifs) if m.given == m.tag == tag[12:]]
            turned = [m for m in p.motifs if m.given == tag[12:]]
            half = len(turned[0].strands) == 2 and len(turned) == 1  # turned round it is the same: both sides count it
            factors += [("motif", str(k), 0.5 if half else 1.0, tag) for k in own]
    none = F.array(*[count("none", F.lit(t), F.lit(0.0)) for t in tags])
    every = F.when(F.col("n") > 0, F.concat(none, *parts)).otherwise(none)
    of = F.broadcast(filled.sparkSession.createDataFrame(factors, "kind string, key string, f double, tag string"))  # a row for each parameter and type
    counts = possible(filled).select("mol_id", F.explode(every).alias("r")).select("mol_id", "r.*")
    return counts.join(of, ["kind", "key"]).groupBy("mol_id", "tag").agg(F.coalesce(F.sum(F.col("x") * F.col("f")), F.lit(0.0)).alias("dlogz_dlogp"))


def derivatives(filled: DataFrame, p: Params, tags: list[str] | None = None) -> DataFrame:
    """log_derivatives() with dz_dp, the derivative of z by the parameter itself; null where that is 0."""
    spark = filled.sparkSession
    values = F.broadcast(spark.createDataFrame([(t, v) for t, v in p.values.items()], "tag string, val double"))
    return log_derivatives(filled, p, tags).join(values, "tag", "left").join(filled.select("mol_id", "z"), "mol_id").select("mol_id", "tag", "dlogz_dlogp", F.when(F.col("val") != 0, F.col("dlogz_dlogp") * F.col("z") / F.col("val")).alias("dz_dp"))


def numeric_log_derivatives(molecules: DataFrame, p: Params, tags: list[str], step: float = 1e-6, **how) -> DataFrame:
    """(mol_id, tag, numeric): derivatives by central differences. All shifted sets are folded by one plan, whatever their number."""
    sets = [p.updated({t: p.values[t] * f}) for t in tags for f in (1 + step, 1 - step)]
    each = fill(molecules, p, sets=sets, **how).select("mol_id", F.col("par.set").alias("set"), "log_z")
    sign = F.when(F.col("set") % 2 == 0, F.col("log_z")).otherwise(-F.col("log_z"))
    tag = F.get(F.array(*[F.lit(t) for t in tags]), F.floor(F.col("set") / 2).cast("int"))
    return possible(each).groupBy("mol_id", tag.alias("tag")).agg((F.sum(sign) / (2 * step)).alias("numeric"))


def final_spread(filled: DataFrame) -> DataFrame:
    """(mol_id, spread): largest relative difference between the partition functions from different starts; needs z_final."""
    return filled.select("mol_id", ((F.array_max("z_final") - F.array_min("z_final")) / F.col("z")).alias("spread"))


def energy_gap(molecules: DataFrame, p: Params, **how) -> DataFrame:
    """(mol_id, dg, dg_structure, dg_gap) of molecules with a structure: its energy less that of all structures."""
    free = fill(molecules.drop("structure", "allow_extra"), p, **how).select("mol_id", "dg")
    bound = fill(molecules, p, **how).select("mol_id", F.col("dg").alias("dg_structure"))
    return free.join(bound, "mol_id").select("mol_id", "dg", "dg_structure", (F.col("dg_structure") - F.col("dg")).alias("dg_gap"))


def results(molecules: DataFrame, p: Params, tags: list[str] | None = None) -> DataFrame:
    """One row a molecule: n, z, dg, dg_structure and dg_gap (null without a structure), structure (the greedy one), p (its probability) and log_derivatives, a map by tag (all of the set if none are given).

    The ensemble is that of all structures; a molecule's own structure counts for the gap only. Null where nothing is possible.
    """
    from strandspark.operators.traceback import mfe

    given = "structure" in {c.lower() for c in molecules.columns}
    bare = molecules.drop("structure", "allow_extra")
    filled = fill(bare, p, full=True)
    slopes = log_derivatives(filled, p, tags).groupBy("mol_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "dlogz_dlogp")))).alias("log_derivatives"))
    out = filled.select("mol_id", "n", "z", "dg").join(mfe(filled, p, full=True), "mol_id", "left").join(slopes, "mol_id", "left")
    own = fill(molecules.filter("structure is not null"), p).select("mol_id", F.col("dg").alias("dg_structure")) if given else None
    out = out.join(own, "mol_id", "left") if given else out.withColumn("dg_structure", F.lit(None).cast("double"))
    return out.select("mol_id", "n", "z", "dg", "dg_structure", (F.col("dg_structure") - F.col("dg")).alias("dg_gap"), "structure", "p", "log_derivatives")
