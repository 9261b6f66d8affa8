"""Structures of molecules: that of least energy, those near it, the likeliest by greedy choice, samples by weight, or all of them.

A traceback keeps the cells that are still to be told apart on a stack. Each step takes the last one, lists the
contributions it was made of and goes on with one of them, or with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.functions import built, let, settle, span, structure_of
from strandspark.operators.fold import BASIC, BP, C, COAX, CUT, LIN, NB, NC, PAIR, Family, Molecule, _z_final, families, fill, log_sum, molecule, nothing, possible, shape
from strandspark.sources.params import KT, Params

FINAL = -1
NODE = "struct<k:int,i:int,d:int>"
ALTS = f"array<struct<w:double,kids:array<{NODE}>>>"
STATE = f"struct<todo:array<{NODE}>,pairs:array<struct<i:int,j:int>>,p:double>"


def _listed(fams: list[Family]) -> Column:
    """All contributions above 0, as logarithms, with the cells of at least two letters that they are made of."""

    def one(f: Family, x) -> Column:
        kids = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(c) for c, v in zip("kid", kid, strict=True)]) for kid in f.kids(x)]
        own = F.filter(F.array(*kids).cast(f"array<{NODE}>"), lambda y: y["d"] >= 1) if kids else F.array().cast(f"array<{NODE}>")
        return F.struct(F.coalesce(f.weight(x), nothing()).alias("w"), own.alias("kids"))

    def of(f: Family) -> Column:
        return F.array(one(f, None)).cast(ALTS) if f.over is None else F.transform(f.over, lambda x: one(f, x)).cast(ALTS)

    none = F.array().cast(ALTS)
    parts = [F.when(f.when, of(f)).otherwise(none) for f in fams]
    return F.filter(F.concat(*parts) if parts else none, lambda a: a["w"] > nothing())


def alternatives(mol: Molecule, node: Column) -> Column:
    kind, i, d = node["k"], node["i"], node["d"]
    out = F.when(kind == FINAL, _listed(_z_final(mol, i)))
    for k in (LIN, CUT, BP, COAX, BASIC, NB, NC, C):
        fams = families(mol, k, i, d)
        if fams:
            out = out.when(kind == k, _listed(fams))
    t = kind - PAIR
    pair = let(F.get(mol.possible(i, d), t), lambda q: _listed(families(mol, PAIR, i, d, t, q)), ALTS)
    return out.when(kind >= PAIR, pair).otherwise(F.array().cast(ALTS))


def best(molecules: DataFrame, p: Params, simple: bool | None = None) -> DataFrame:
    """(mol_id, structure, dg): the structure of least energy of each molecule that is not a circle, and its energy; circles raise an error.

    Cells are filled with the largest weight, and the traceback goes on with a contribution that has it: the first of
    equal ones, in the order in which a cell's contributions are listed. Where a stack or a motif and an open loop make
    the same structure, its weight is their sum. With coaxial stacking a structure has as many weights as ways to stack
    its helices; then the likeliest structure with its stacking is given, and dg is that way's.
    """
    open_ = F.when(F.coalesce("circle", F.lit(False)), F.raise_error(F.lit("a circle has no cells that do not wrap")).cast("boolean")).otherwise(F.col("circle"))
    filled = fill(molecules.withColumn("circle", open_), p, simple=simple, best=True)
    mol = molecule(p, False, F.col("cells"), True)
    done = possible(filled).select("mol_id", "n", "dg", F.when(F.col("n") > 0, built(("best", shape(p)), lambda: _one_path(mol, _largest, linear=True))).alias("s"))
    return done.select("mol_id", structure_of(F.col("s.pairs"), F.col("n")).alias("structure"), "dg")


def _start(i: Column | None = None, whole: Column | None = None) -> Column:
    """What is to be told apart first: everything from a start on, or only the cell of the whole molecule (whole: its offset)."""
    return F.struct(F.array(F.struct(F.lit(FINAL if whole is None else LIN).alias("k"), (F.lit(0) if i is None else i).alias("i"), (F.lit(0) if whole is None else whole).alias("d"))).alias("todo"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"), F.lit(1.0).alias("p")).cast(STATE)


def _bare() -> Column:
    """Nothing to be told apart and no pairs."""
    return F.struct(F.array().cast(f"array<{NODE}>").alias("todo"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"), F.lit(1.0).alias("p")).cast(STATE)


def _grown(mol: Molecule, state: Column, alt: Column, number: Column) -> Column:
    """state gone on with alt, with a number of its own."""
    node = F.get(state["todo"], F.size(state["todo"]) - 1)
    j = F.pmod(node["i"] + node["d"], mol.n)
    pairs = F.when(node["k"] >= PAIR, F.concat(state["pairs"], F.array(F.struct(F.least(F.pmod(node["i"], mol.n), j).alias("i"), F.greatest(F.pmod(node["i"], mol.n), j).alias("j"))))).otherwise(state["pairs"])
    return F.struct(F.concat(F.slice(state["todo"], 1, F.size(state["todo"]) - 1), alt["kids"]).alias("todo"), pairs.alias("pairs"), number.alias("p")).cast(STATE)


def _next(mol: Molecule, state: Column, alt: Column, share: Column) -> Column:
    return _grown(mol, state, alt, state["p"] * share)


def _total(alts: Column) -> Column:
    return log_sum(F.transform(alts, lambda a: a["w"]))


def _one_path(mol: Molecule, choose, start: Column | None = None, linear: bool = False) -> Column:
    """The final state when choose(alternatives, step) gives the place of the one to follow; start: where the molecule is cut open; linear: it is not closed."""

    def step(state, k):
        node = F.get(state["todo"], F.size(state["todo"]) - 1)

        def follow(alts):
            return let(_total(alts), lambda all_w: let(F.get(alts, choose(alts, all_w, k)), lambda a: F.when(F.isnull(a["w"]), F.struct(F.array().cast(f"array<{NODE}>").alias("todo"), state["pairs"].alias("pairs"), F.lit(0.0).alias("p")).cast(STATE)).otherwise(_next(mol, state, a, F.exp(a["w"] - all_w)))))

        return F.when(F.size(state["todo"]) == 0, state).otherwise(let(alternatives(mol, node), follow)).cast(STATE)

    first = F.when(mol.n > 1, _start(whole=mol.n - 1)).otherwise(_bare()) if linear else _start(start)
    return F.aggregate(span(0, mol.n * 8), first, step)


def _largest(alts: Column, _all: Column, _k: Column) -> Column:
    weights = F.transform(alts, lambda a: a["w"])
    return F.array_position(weights, F.array_max(weights)).cast("int") - 1


def mfe(filled: DataFrame, p: Params, full: bool = False) -> DataFrame:
    """(mol_id, structure, p): the structure that is reached by always going on with the largest contribution, the first of equal ones. It need not be the one of least energy. full: as the cells were filled."""
    mol = molecule(p, full, F.col("cells"))
    done = possible(filled).select("mol_id", "n", F.when(F.col("n") > 0, built(("greedy", shape(p), full), lambda: _one_path(mol, _largest))).alias("s"))
    return done.select("mol_id", structure_of(F.col("s.pairs"), F.col("n")).alias("structure"), F.col("s.p").alias("p"))


def mfe_starts(filled: DataFrame, p: Params) -> DataFrame:
    """(mol_id, start, structure, p, agrees) of fully filled molecules: the greedy structure from each place where the molecule can be cut open, and whether it is that from the first. They can differ, as greedy choices are not the structure of least energy."""
    mol = molecule(p, True, F.col("cells"))
    rows = possible(filled).filter("n > 0").withColumn("start", F.explode(span(0, F.col("n") - 1)))
    done = rows.select("mol_id", "start", "n", _one_path(mol, _largest, F.col("start")).alias("s")).select("mol_id", "start", structure_of(F.col("s.pairs"), F.col("n")).alias("structure"), F.col("s.p").alias("p"))
    first = F.first("structure").over(Window.partitionBy("mol_id").orderBy("start"))  # as many rows as letters
    return done.withColumn("agrees", F.col("structure") == first)


#: Places of a traceback's levels within an offset: a cell is made of cells of shorter offsets, or of cells of the same offset in a later level.
_LEVELS = {FINAL: 0, CUT: 7, BP: 5, COAX: 4, BASIC: 3, NB: 2, NC: 2, C: 2, LIN: 1, PAIR: 6}
_ENTRY = "struct<k:int,i:int,d:int,id:int>"
_DRAWN = f"struct<todo:array<{_ENTRY}>,pairs:array<struct<id:int,i:int,j:int>>>"
#: Samples whose pairs are told apart together.
_BLOCK = 32


def _draws(mol: Molecule, count: int, seed: int) -> Column:
    """Pairs (id, i, j) of count samples. All samples go down together, offset by offset: a cell's alternatives are listed once for all the samples that reach it, and each of these takes its own."""
    order = F.array(*[F.lit(_LEVELS[k]) for k in range(FINAL, PAIR + 1)])
    level = lambda e: F.get(order, F.least(e["k"], F.lit(PAIR)) - FINAL)

    def spread(node, here):
        """The cells that the samples here (all at node) go on to."""

        def chosen(alts):
            most = F.array_max(F.transform(alts, lambda a: a["w"]))
            shares = let(most, lambda top: F.transform(alts, lambda a: F.exp(a["w"] - top)), "array<double>")
            sums = let(shares, lambda w: F.aggregate(w, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.try_element_at(s, F.lit(-1)) + x))), "array<double>")

            def take(e, run):
                u = F.pmod(F.xxhash64(F.col("mol_id"), e["id"], e["k"], e["i"], e["d"], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.try_element_at(run, F.lit(-1))
                at = let(u, lambda v: F.least(F.size(F.filter(run, lambda x: x <= v)), F.size(alts)) - 1, "int")  # the sums begin with 0
                return F.transform(F.get(alts, at)["kids"], lambda c: F.struct(c["k"].alias("k"), c["i"].alias("i"), c["d"].alias("d"), e["id"].alias("id")))

            return F.when(F.size(alts) > 0, let(sums, lambda run: F.flatten(F.transform(here, lambda e: take(e, run))).cast(f"array<{_ENTRY}>"), f"array<{_ENTRY}>")).otherwise(F.array().cast(f"array<{_ENTRY}>"))

        return let(alternatives(mol, node), chosen, f"array<{_ENTRY}>")

    def step(state, x):
        mine = lambda e: (e["d"] == x["d"]) & (level(e) == x["r"])

        def go(own):
            nodes = F.array_distinct(F.transform(own, lambda e: F.struct(e["k"].alias("k"), e["i"].alias("i"), e["d"].alias("d"))))
            on = F.flatten(F.transform(nodes, lambda node: spread(node, F.filter(own, lambda e: (e["k"] == node["k"]) & (e["i"] == node["i"])))))
            ends = lambda e: (F.pmod(e["i"], mol.n), F.pmod(e["i"] + e["d"], mol.n))
            pair = lambda e: F.struct(e["id"].alias("id"), F.least(*ends(e)).alias("i"), F.greatest(*ends(e)).alias("j"))
            pairs = F.when(x["r"] == _LEVELS[PAIR], F.concat(state["pairs"], F.transform(own, pair))).otherwise(state["pairs"])
            return F.when(F.size(own) == 0, state).otherwise(F.struct(F.concat(F.filter(state["todo"], lambda e: ~mine(e)), on).alias("todo"), pairs.alias("pairs"))).cast(_DRAWN)

        return let(F.filter(state["todo"], mine), go, _DRAWN)

    row = lambda k, i, d, e: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(c) for c, v in zip("kid", (k, i, d), strict=True)], e.alias("id"))
    first = F.struct(F.transform(span(0, count - 1), lambda e: row(FINAL, 0, mol.n, e)).alias("todo"), F.array().cast("array<struct<id:int,i:int,j:int>>").alias("pairs")).cast(_DRAWN)
    at = lambda d, r: F.struct(d.alias("d"), r.alias("r"))
    levels = F.flatten(F.transform(F.reverse(span(1, mol.n - 1)), lambda d: F.transform(span(1, max(_LEVELS.values())), lambda r: at(d, r))))
    return F.aggregate(F.concat(F.array(at(mol.n, F.lit(0))), levels), first, step, lambda s: s["pairs"])


def samples(filled: DataFrame, p: Params, count: int, seed: int = 0, full: bool = False) -> DataFrame:
    """(mol_id, sample, structure): count structures a molecule, each as likely as its weight. The same seed gives the same structures. All samples of a molecule are drawn in its row, sharing the cells that they pass."""
    mol = molecule(p, full, F.col("cells"))
    drawn = settle(possible(filled).select("mol_id", "n", *[c for c in filled.columns if c not in ("mol_id", "n")]), pairs=F.when(F.col("n") > 0, _draws(mol, count, seed))).select("mol_id", "n", "pairs")
    blocks = F.transform(span(0, (count - 1) // _BLOCK), lambda b: F.filter("pairs", lambda x: F.floor(x["id"] / _BLOCK) == b))
    of_block = lambda own, b: F.transform(span(b * _BLOCK, F.least(b * _BLOCK + _BLOCK, F.lit(count)) - 1), lambda e: let(F.filter(own, lambda x: x["id"] == e), lambda mine: structure_of(mine, F.col("n")), "string"))
    made = F.when(F.col("n") > 0, F.flatten(F.transform(blocks, of_block))).otherwise(F.array_repeat(F.lit(""), count))
    return drawn.select("mol_id", F.posexplode(made).alias("sample", "structure"))


def within(molecules: DataFrame, p: Params, kcal: float, simple: bool | None = None) -> DataFrame:
    """(mol_id, structure, dg): the structures of each molecule that is not a circle whose energy is at most kcal above the least; circles raise an error.

    Cells are filled with the largest weight, so that the best way to finish a partial derivation is known before it is
    gone: what can't end within the bound is dropped at once, and only derivations of results are followed. Energies are
    those of best(), with the same word on coaxial stacking. A molecule's results are made in its row, so kcal bounds
    what a task holds.
    """
    open_ = F.when(F.coalesce("circle", F.lit(False)), F.raise_error(F.lit("a circle has no cells that do not wrap")).cast("boolean")).otherwise(F.col("circle"))
    filled = possible(fill(molecules.withColumn("circle", open_), p, simple=simple, best=True))
    mol = molecule(p, False, F.col("cells"), True)
    least = F.col("log_z") - kcal / KT - 1e-9

    def step(states, _k):
        def expand(s):
            node = F.get(s["todo"], F.size(s["todo"]) - 1)

            def every(alts):
                top = F.array_max(F.transform(alts, lambda a: a["w"]))
                return let(s["p"] - top, lambda by: F.transform(F.filter(alts, lambda a: a["w"] + by >= least), lambda a: _grown(mol, s, a, a["w"] + by)), f"array<{STATE}>")

            return F.when(F.size(s["todo"]) == 0, F.array(s)).otherwise(let(alternatives(mol, node), every, f"array<{STATE}>")).cast(f"array<{STATE}>")

        return F.when(F.exists(states, lambda s: F.size(s["todo"]) > 0), F.flatten(F.transform(states, expand))).otherwise(states).cast(f"array<{STATE}>")

    start = F.when(mol.n > 1, _start(whole=mol.n - 1)).otherwise(_bare())
    first = F.array(F.struct(start["todo"].alias("todo"), start["pairs"].alias("pairs"), F.col("log_z").alias("p")).cast(STATE))
    rows = filled.select("mol_id", "n", F.explode(F.aggregate(span(0, mol.n * 8), first, step)).alias("s"))
    return rows.select("mol_id", structure_of(F.col("s.pairs"), F.col("n")).alias("structure"), F.col("s.p").alias("w")).groupBy("mol_id", "structure").agg((F.max("w") * -KT).alias("dg"))


def enumerate_structures(filled: DataFrame, p: Params, full: bool = False) -> DataFrame:
    """(mol_id, structure, p, ways): every structure with its probability, and in how many ways it is derived. For short molecules: there are exponentially many."""
    mol = molecule(p, full, F.col("cells"))

    def step(states, _k):
        def expand(s):
            node = F.get(s["todo"], F.size(s["todo"]) - 1)

            def every(alts):
                return let(_total(alts), lambda all_w: F.transform(alts, lambda a: _next(mol, s, a, F.exp(a["w"] - all_w))))

            return F.when(F.size(s["todo"]) == 0, F.array(s)).otherwise(let(alternatives(mol, node), every)).cast(f"array<{STATE}>")

        return F.when(F.exists(states, lambda s: F.size(s["todo"]) > 0), F.flatten(F.transform(states, expand))).otherwise(states).cast(f"array<{STATE}>")

    grown = F.aggregate(span(0, mol.n * 8), F.array(_start()).cast(f"array<{STATE}>"), step)
    rows = possible(filled).select("mol_id", "n", F.explode(F.when(F.col("n") > 0, grown)).alias("s"))
    return rows.select("mol_id", structure_of(F.col("s.pairs"), F.col("n")).alias("structure"), F.col("s.p").alias("p")).groupBy("mol_id", "structure").agg(F.sum("p").alias("p"), F.count("*").alias("ways"))
