"""Partition functions of many molecules as one column expression each.

A molecule is a row. Its cells (start i, offset d; all indices run around the molecule) are filled by one aggregate over
d whose state is the list of filled diagonals, so that a fold needs no shuffle, no driver loop and no Python, and
molecules spread over a cluster as rows do. Each recurrence is written once, as families of contributions: filling
sums their weights, and tracing back lists them with the cells they are made of.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions import built, dotparen, let, letters, partners, settle, span, strands_of
from strandspark.sources.params import KT, Params

#: What a cell holds, beside its pair weights by type: q. Kinds of cells are numbered by their place here; PAIR + t is the pair of the t-th type possible.
CELL = ("cut", "bp", "coax", "basic", "nb", "nc", "c", "lin")
CUT, BP, COAX, BASIC, NB, NC, C, LIN, PAIR = range(9)
CELL_DDL = "struct<" + ",".join(f"{c}:double" for c in CELL) + ",q:array<double>>"
#: Nucleotides that a motif's letters stand for; any other letter matches nothing.
WILD = {"N": "ACGU", "A": "A", "C": "C", "G": "G", "U": "U", "R": "AG", "Y": "CU"}


def nothing() -> Column:
    """The logarithm of 0."""
    return F.lit(float("-inf"))


def log_sum(logs: Column) -> Column:
    """The logarithm of the sum of numbers given by an array of their logarithms; that of 0 for an empty one."""

    def scaled(a):
        grown = lambda top: F.when(top == nothing(), top).otherwise(top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))
        return let(F.coalesce(F.array_max(a), nothing()), grown, "double")

    return let(logs, scaled, "double")


@dataclass
class Family:
    """Contributions to a cell: one, if over is None, or one for each item of over. weight: its logarithm; kids: the cells it is made of, as (kind, i, d). dot: where all of over together are a row of cells against a column of them, these (Molecule.dot) and the logarithm of a factor."""

    when: Column | bool
    weight: Callable[[Column | None], Column]
    kids: Callable[[Column | None], list[tuple]]
    over: Column | None = None
    pair: bool = False
    dot: tuple | None = None


PAR_DDL = "struct<set:int,l:double,l_BP:double,C_init:double,l_coax:double,K_coax:double,kd:array<double>,stack:array<double>,motif:array<double>>"


def weights(p: Params, number: int = 0) -> dict:
    """The numbers of a set as logarithms, as a row of PAR_DDL. What else a set says (pair types, patterns, the shortest loop) is its shape."""
    log = lambda x: math.log(x) if x > 0 else -math.inf
    size = range(len(p.types))
    return {"set": number, **{k: log(v) for k, v in p.scalars.items()}, "kd": [log(t.kd) for t in p.types], "stack": [log(p.stack.get((a, b), 0.0)) for a in size for b in size], "motif": [log(m.c_eff) for m in p.motifs]}


def shape(p: Params) -> tuple:
    """What sets must share to be folded by one plan."""
    return p.min_loop_length, p.strained, p.scalars["K_coax"] > 0, tuple((t.tag, t.flip, t.lower) for t in p.types), tuple((m.tag, m.strands, m.pairs) for m in p.motifs)


def sets_column(sets: list[Params]) -> Column:
    """An array of the sets' numbers."""
    if len({shape(p) for p in sets}) > 1:
        raise ValueError("parameter sets of different shapes can't be folded by one plan")
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else None if v == -math.inf else v  # noqa: E731 - JSON has no infinity
    rows = F.from_json(F.lit(json.dumps([{k: plain(v) for k, v in weights(p, n).items()} for n, p in enumerate(sets)])), f"array<{PAR_DDL}>")
    back = lambda x: F.coalesce(x, nothing())

    def row(r):
        lists = [F.transform(r[k], back).alias(k) for k in ("kd", "stack", "motif")]
        return F.struct(r["set"].alias("set"), *[back(r[k]).alias(k) for k in ("l", "l_BP", "C_init", "l_coax", "K_coax")], *lists).cast(PAR_DDL)

    return F.transform(rows, row)


@dataclass
class Molecule:
    """Columns of a prepared molecule and, once filled, its cells (logarithms). par: the numbers of its parameter set. best: weights are compared, not added up."""

    p: Params
    n: Column
    lig: Column
    nicks: Column
    forced: Column
    types: Column
    motifs: Column
    wrap: bool
    cells: Column | None = None
    rows: Column | None = None
    cols: Column | None = None
    par: Column | None = None
    best: bool = False

    def at(self, i):
        return F.pmod(i, self.n) if self.wrap else i

    def bond(self, i):
        """Whether i is bonded to i + 1."""
        return F.get(self.lig, F.pmod(i, self.n))

    def cell(self, i, d):
        return F.get(F.get(self.cells, d), self.at(i))

    def get(self, kind: int, i, d):
        return self.cell(i, d)[CELL[kind]]

    def possible(self, i, d):
        """Numbers of the pair types possible at a cell."""
        return F.get(F.get(self.types, d), self.at(i))

    def loops(self, i, d):
        return F.get(F.get(self.motifs, d), self.at(i))

    def dot(self, row: str, a, x, col: str, b, y, count) -> Column:
        """row(a, x) + col(b - y, y), row(a, x + 1) + col(b - y + 1, y - 1), ...: count sums of logarithms."""
        count = F.greatest(count, F.lit(0))
        left = F.slice(F.get(self.rows, self.at(a))[row], x + 1, count)
        right = F.reverse(F.slice(F.get(self.cols, self.at(b))[col], F.greatest(y - count + 2, F.lit(1)), count))
        return F.zip_with(left, right, lambda u, v: u + v)

    def gather(self, logs: Column) -> Column:
        """The sum, or the largest, of an array of logarithms."""
        return F.coalesce(F.array_max(logs), nothing()) if self.best else log_sum(logs)


def prepare(molecules: DataFrame) -> DataFrame:
    """molecules (mol_id, strands, circle and, if there, structure and allow_extra) with seq (letters), n, lig, nicks, of (forced partners or -1), within (the forced pair that encloses a position).

    A null circle is false, a null structure forces nothing. Molecules of no letter have n 0.
    """
    have = {c.lower() for c in molecules.columns}
    structure = F.col("structure") if "structure" in have else F.lit(None).cast("string")
    extra = F.coalesce(F.col("allow_extra"), F.lit(False)) if "allow_extra" in have else F.lit(False)
    strands = F.filter(F.coalesce("strands", F.array().cast("array<string>")), lambda s: s != "")
    m = molecules.withColumns({"strands": strands, "circle": F.coalesce("circle", F.lit(False)), "structure": dotparen(structure), "allow_extra": extra})
    m = m.withColumns({"seq": letters(F.array_join("strands", "")), "_ends": F.aggregate("strands", F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(s))))})
    m = m.withColumn("n", F.size("seq"))
    m = m.withColumn("lig", F.transform("seq", lambda c, k: ~F.array_contains(F.col("_ends"), k + 1) | ((k == F.col("n") - 1) & F.col("circle"))))
    m = m.withColumn("nicks", F.filter(span(0, F.col("n") - 1), lambda k: ~F.get(F.col("lig"), k)))
    m = m.withColumn("of", F.when(F.isnotnull("structure"), partners(F.col("structure"))))
    m = m.withColumn("of", F.when(F.size("of") == F.col("n"), F.col("of")).when(F.isnull("of"), F.lit(None)).otherwise(F.raise_error(F.lit("a structure's length is not its molecule's")).cast("array<int>")))
    inner = lambda k: F.array_max(F.filter(span(0, k - 1), lambda a: F.get(F.col("of"), a) > k))
    m = m.withColumn("within", F.when(F.isnotnull("of"), F.transform(F.col("of"), lambda j, k: F.coalesce(inner(k), F.lit(-1)))))
    return settle(m.drop("_ends"), **{c: F.col(c) for c in ("n", "seq", "lig", "nicks", "of", "within")})


def _match(p: Params, a: Column, b: Column) -> Column:
    """Numbers of the types that pair letter a with letter b."""
    own = [F.when(F.lit(t.lower) & (a == b) & a.rlike("^[a-z]$") if t.lower else (a == t.ends[0]) & (b == t.ends[1]), F.lit(k)) for k, t in enumerate(p.types)]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<int>")


def joined(nicks: Column, n: Column, i, d) -> Column:
    """No nick from i on over d bonds."""
    return ~F.exists(nicks, lambda x: F.pmod(x - i, n) < d)


def _joined(mol: Molecule, i, d):
    return joined(mol.nicks, mol.n, i, d)


def _candidates(p: Params, full: bool, bare: Molecule) -> Column:
    """types: for each offset and start the pair types that sequence, loop length and forced pairs allow."""
    n, seq, of, within, extra = bare.n, F.col("seq"), F.col("of"), F.col("within"), F.col("allow_extra")

    def allowed(i, j):
        x, y = F.get(of, i), F.get(of, j)
        return F.isnull(of) | (x == j) | (extra & (x == -1) & (y == -1) & (F.get(within, i) == F.get(within, j)))

    def possible(i, d):
        j = F.pmod(i + d, n)
        short = ((d - 1 < p.min_loop_length) & _joined(bare, i, d)) | ((n - d - 1 < p.min_loop_length) & _joined(bare, j, n - d))
        return F.when(allowed(i, j) & ~short, _match(p, F.get(seq, i), F.get(seq, j))).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    return F.transform(span(0, n - 1), lambda d: F.transform(span(0, n - 1 if full else n - 1 - d), lambda i: F.when(d == 0, none).otherwise(possible(i, d))))


def strand_pattern(strand: str) -> str:
    return "".join(f"[{WILD[c]}]" if c in WILD else "[^\\s\\S]" for c in strand)


LOOP_DDL = "array<struct<t:int,m:int,i:int,d:int,u:int,span:int>>"


def _loops(p: Params, full: bool, bare: Molecule) -> Column:
    """motifs: for each offset and start the motifs that close there: t closing and u inner type (places among those possible), m the motif, i and d the inner cell (d -1 for a hairpin), span letters of the last strand."""
    n = bare.n
    hot = [m for m in p.motifs if len(m.strands) <= 2]
    if not hot:
        return F.transform(span(0, n - 1), lambda d: F.transform(span(0, n - 1), lambda i: F.array().cast(LOOP_DDL)))
    strands = sorted({s for m in hot for s in m.strands})
    table = [
        {"m": p.motifs.index(m), "first": strands.index(m.strands[0]), "second": strands.index(m.strands[-1]), "a": len(m.strands[0]), "b": len(m.strands[1]) if len(m.strands) > 1 else 0,
         "closing": [k for k in range(len(p.types)) if p.types[k].flip in m.pairs[-1]], "inner": list(m.pairs[0])}
        for m in hot
    ]
    rows = F.from_json(F.lit(json.dumps(table)), "array<struct<m:int,first:int,second:int,a:int,b:int,closing:array<int>,inner:array<int>>>")
    shapes = F.from_json(F.lit(json.dumps([{"re": f"^{strand_pattern(s)}$", "k": len(s)} for s in strands])), "array<struct<re:string,k:int>>")
    text = F.array_join(F.concat(F.col("seq"), F.col("seq")), "")  # goes around once
    bound, types = F.col("of"), F.col("types")

    def fits(s: Column) -> Column:
        """Where the strand can start: its letters match, no nick is within, and no letter but its ends is forced to pair."""
        free = lambda i: F.isnull(bound) | ~F.exists(span(1, s["k"] - 2), lambda x: F.get(bound, F.pmod(i + x, n)) >= 0)
        return F.transform(span(0, n - 1), lambda i: (n >= s["k"]) & F.rlike(F.substring(text, i + 1, s["k"]), s["re"]) & _joined(bare, i, s["k"] - 1) & free(i))

    def at(found, i, d):
        here = F.get(F.get(types, d), i)
        strand = lambda m, which, k: F.get(F.get(found, m[which]), F.pmod(k, n))
        fit = F.filter(rows, lambda m: strand(m, "first", i) & F.when(m["b"] == 0, d == m["a"] - 1).otherwise((d >= m["a"] + m["b"] - 1) & strand(m, "second", i + d - m["b"] + 1)))

        def make(t, m, i2, d2, u):
            return F.struct(t.alias("t"), m["m"].alias("m"), i2.alias("i"), d2.alias("d"), u.alias("u"), F.when(m["b"] == 0, m["a"]).otherwise(m["b"]).alias("span"))

        def closed(m, k):
            i2, d2 = F.pmod(i + m["a"] - 1, n), d - m["a"] - m["b"] + 2
            inner = F.filter(F.transform(F.get(F.get(types, d2), i2), lambda t, u: F.struct(t.alias("t"), u.alias("u"))), lambda x: F.array_contains(m["inner"], x["t"]))
            none = F.lit(-1)
            return F.when(m["b"] == 0, F.array(make(k, m, none, none, none)).cast(LOOP_DDL)).otherwise(F.transform(inner, lambda x: make(k, m, i2, d2, x["u"])).cast(LOOP_DDL))

        own = lambda m: F.flatten(F.transform(here, lambda t, k: F.when(F.array_contains(m["closing"], t), closed(m, k)).otherwise(F.array().cast(LOOP_DDL))))
        return F.when(F.size(here) > 0, F.flatten(F.transform(fit, own))).otherwise(F.array().cast(LOOP_DDL))

    return let(F.transform(shapes, fits), lambda found: F.transform(span(0, n - 1), lambda d: F.transform(span(0, n - 1 if full else n - 1 - d), lambda i: at(found, i, d))).cast(f"array<array<{LOOP_DDL}>>"), f"array<array<{LOOP_DDL}>>")


def families(mol: Molecule, kind: int, i, d, t=None, q=None) -> list[Family]:
    """What makes up a cell of a kind at (i, d). For PAIR, t is the place of the type among those possible there and q its number."""
    p, s = mol.p, mol.par
    coax = p.scalars["K_coax"] > 0
    left, right = mol.bond(i), mol.bond(i + d - 1)
    both = left & right
    g = mol.get
    join, close = (C, C) if p.strained else (NB, NC)  # what may stand within a pair's loop: beside a coaxial stack, alone
    if kind == CUT:
        inside = F.filter(F.transform(mol.nicks, lambda x: F.pmod(x - i, mol.n)), lambda m: (m >= 1) & (m <= d - 2))
        return [
            Family((d == 1) & ~left, lambda _: F.lit(0.0), lambda _: []),
            Family((d > 1) & ~left & right, lambda _: g(LIN, i + 1, d - 2), lambda _: [(LIN, i + 1, d - 2)]),
            Family((d > 1) & left & ~right, lambda _: g(LIN, i + 1, d - 2), lambda _: [(LIN, i + 1, d - 2)]),
            Family((d > 1) & both, lambda m: g(LIN, i + 1, m - 1) + g(LIN, i + m + 1, d - 2 - m), lambda m: [(LIN, i + 1, m - 1), (LIN, i + m + 1, d - 2 - m)], inside),
        ]
    if kind == PAIR:
        kd = -F.get(s["kd"], q)
        size = len(p.types)
        inner = F.transform(mol.possible(i + 1, d - 2), lambda u, k: F.struct(F.get(s["stack"], q * size + u).alias("w"), k.alias("k")))
        loops = F.filter(mol.loops(i, d), lambda x: x["t"] == t)
        # One structure of a stack or motif is made by an open loop too: where structures are compared, its ways are added up.
        whole = mol.best and not coax
        open_loop = lambda d2: s["C_init"] + s["l_BP"] + F.when(d2 < 0, d * s["l"]).otherwise((d - d2) * s["l"] + s["l_BP"])
        stack = lambda x: log_sum(F.array(x["w"], open_loop(d - 2))) if whole else x["w"]
        out = [
            Family(both & (d >= 2), lambda _: g(close, i + 1, d - 2) + (s["l"] * 2 + s["l_BP"] + kd), lambda _: [(close, i + 1, d - 2)], pair=True),
            Family(both & (d >= 3), lambda x: stack(x) + F.get(mol.cell(i + 1, d - 2)["q"], x["k"]) + kd, lambda x: [(PAIR + x["k"], i + 1, d - 2)], inner, True),
            Family(F.lit(True), lambda _: g(CUT, i, d) + kd, lambda _: [(CUT, i, d)], pair=True),
        ]
        if p.motifs:
            same = lambda x, y: (x["i"] == y["i"]) & (x["d"] == y["d"]) & (x["u"] == y["u"])
            motif = lambda x: log_sum(F.concat(F.transform(F.filter(loops, lambda y: same(x, y)), lambda y: F.get(s["motif"], y["m"])), F.array(open_loop(x["d"])))) if whole else F.get(s["motif"], x["m"])
            w = lambda x: motif(x) + F.when(x["d"] < 0, F.lit(0.0)).otherwise(F.get(mol.cell(x["i"], x["d"])["q"], x["u"])) + kd
            out.append(Family(F.lit(True), w, lambda x: [(PAIR + x["u"], x["i"], x["d"])], loops, True))
        if coax:
            closed, open_ = s["l"] * 2 + s["l_coax"] + s["K_coax"] + kd, s["K_coax"] + kd
            out += [
                Family(both, lambda m: g(BP, i + 1, m - 1) + g(join, i + m + 1, d - m - 2) + closed, lambda m: [(BP, i + 1, m - 1), (join, i + m + 1, d - m - 2)], F.filter(span(2, d - 2), lambda m: mol.bond(i + m)), True, ("bonded", i + 1, F.lit(1), "join", i + d - 1, d - 4, d - 3, closed)),
                Family(both, lambda m: g(join, i + 1, m - 2) + g(BP, i + m, d - 1 - m) + closed, lambda m: [(join, i + 1, m - 2), (BP, i + m, d - 1 - m)], F.filter(span(2, d - 2), lambda m: mol.bond(i + m - 1)), True, ("join", i + 1, F.lit(0), "bp", i + d - 1, d - 3, d - 3, closed)),
                Family(left, lambda m: g(BP, i + 1, m - 1) + g(CUT, i + m, d - m) + open_, lambda m: [(BP, i + 1, m - 1), (CUT, i + m, d - m)], span(2, d - 1), True, ("bp", i + 1, F.lit(1), "cut", i + d, d - 2, d - 2, open_)),
                Family(right, lambda m: g(CUT, i, m) + g(BP, i + m, d - 1 - m) + open_, lambda m: [(CUT, i, m), (BP, i + m, d - 1 - m)], span(0, d - 2), True, ("cut", i, F.lit(0), "bp", i + d - 1, d - 1, d - 1, open_)),
            ]
        return out
    if kind == BP:
        return [Family(F.lit(True), lambda k: F.get(mol.cell(i, d)["q"], k), lambda k: [(PAIR + k, i, d)], F.transform(mol.possible(i, d), lambda _, k: k))]
    if kind == COAX:
        if not coax:
            return []
        closed_ring = (d == mol.n - 1) & mol.bond(i + d)
        return [Family(~closed_ring, lambda m: g(BP, i, m) + g(BP, i + m + 1, d - m - 1) + s["K_coax"], lambda m: [(BP, i, m), (BP, i + m + 1, d - m - 1)], F.filter(span(1, d - 2), lambda m: mol.bond(i + m)), dot=("bonded", i, F.lit(1), "bp", i + d, d - 2, d - 2, s["K_coax"]))]
    free = right & (F.get(mol.forced, F.pmod(i + d, mol.n)) < 0)
    if kind == BASIC:
        def grow(x, y, row=None):
            inside = F.filter(span(1, d - 1), lambda m: mol.bond(i + m - 1))
            one, two = s["l"] + s["l_BP"], s["l"] + s["l_coax"]
            own = lambda col, by: (row, i, F.lit(0), col, i + d, d - 1, d - 1, by) if row else None
            out = [lambda cond: Family(cond, lambda m: g(x, i, m - 1) + g(BP, i + m, d - m) + one, lambda m: [(x, i, m - 1), (BP, i + m, d - m)], inside, dot=own("bp", one))]
            if coax:
                out.append(lambda cond: Family(cond, lambda m: g(y, i, m - 1) + g(COAX, i + m, d - m) + two, lambda m: [(y, i, m - 1), (COAX, i + m, d - m)], inside, dot=own("coax", two)))
            return out

        first = [Family(free, lambda _: g(C, i, d - 1) + s["l"], lambda _: [(C, i, d - 1)])]
        if p.strained:
            return first + [f(F.lit(True)) for f in grow(C, C, "c")]
        ring = (d == mol.n - 1) & mol.bond(i + d)
        return first + [f(~ring if mol.wrap else F.lit(True)) for f in grow(C, C, "c")] + ([f(ring) for f in grow(NC, NB)] if mol.wrap else [])
    if kind in (NB, NC, C):
        lone = Family(F.lit(True), lambda _: g(BP, i, d) + (s["C_init"] + s["l_BP"]), lambda _: [(BP, i, d)])
        pair = Family(F.lit(True), lambda _: g(COAX, i, d) + (s["C_init"] + s["l_coax"]), lambda _: [(COAX, i, d)])
        base = Family(F.lit(True), lambda _: g(BASIC, i, d), lambda _: [(BASIC, i, d)])
        if kind == NB:
            return [base, pair] if coax else []
        return [base, lone] + ([pair] if coax and kind == C else [])
    if kind == LIN:
        inside = F.filter(span(1, d - 1), lambda m: mol.bond(i + m - 1))
        own = lambda col: ("lin", i, F.lit(0), col, i + d, d - 1, d - 1, None)
        out = [
            Family(free, lambda _: g(LIN, i, d - 1), lambda _: [(LIN, i, d - 1)]),
            Family(F.lit(True), lambda _: g(BP, i, d), lambda _: [(BP, i, d)]),
            Family(F.lit(True), lambda m: g(LIN, i, m - 1) + g(BP, i + m, d - m), lambda m: [(LIN, i, m - 1), (BP, i + m, d - m)], inside, dot=own("bp")),
        ]
        if coax:
            out += [
                Family(F.lit(True), lambda _: g(COAX, i, d), lambda _: [(COAX, i, d)]),
                Family(F.lit(True), lambda m: g(LIN, i, m - 1) + g(COAX, i + m, d - m), lambda m: [(LIN, i, m - 1), (COAX, i + m, d - m)], inside, dot=own("coax")),
            ]
        return out
    raise ValueError(kind)


def sum_of(mol: Molecule, fams: list[Family]) -> Column:
    """The logarithm of all contributions together, or of the largest."""
    if not fams:
        return nothing()

    def part(f: Family) -> Column:
        known = lambda x: F.coalesce(x, nothing())
        if f.over is None:
            out = known(f.weight(None))
        elif f.dot and mol.rows is not None:
            *what, by = f.dot
            out = mol.gather(mol.dot(*what)) if by is None else mol.gather(mol.dot(*what)) + by
        else:
            out = mol.gather(F.transform(f.over, lambda x: known(f.weight(x))))
        return F.when(f.when, out).otherwise(nothing())

    parts = [part(f) for f in fams]
    return parts[0] if len(parts) == 1 else F.greatest(*parts) if mol.best else log_sum(F.array(*parts))


class _Cell(Molecule):
    """A molecule whose cell at (i, d) is being filled: parts that are known already are read from there."""

    def __init__(self, mol: Molecule, i, d, known: dict[int, Column]):
        self.__dict__.update(mol.__dict__)
        self.own = (i, d)
        self.known = known

    def get(self, kind, i, d):
        if i is self.own[0] and d is self.own[1]:
            return self.known[kind]
        return super().get(kind, i, d)


def _fill_cell(mol: Molecule, i, d, simple: bool) -> Column:
    """simple: no nick lies within any cell that is filled."""
    known: dict[int, Column] = {}

    def build(step: int) -> Column:
        order = [CUT, "q", BP, COAX, BASIC, NB, NC, C, LIN]
        if step == len(order):
            names = [known[k].alias(c) for k, c in enumerate(CELL)]
            return F.struct(*names, known["q"].alias("q")).cast(CELL_DDL)
        kind = order[step]
        here = _Cell(mol, i, d, known)
        if kind == "q":
            value = F.transform(mol.possible(i, d), lambda q, t: sum_of(here, families(here, PAIR, i, d, t, q)))
        elif kind == BP:
            value = F.when(F.size(known["q"]) == 1, F.get(known["q"], F.lit(0))).otherwise(mol.gather(known["q"]))
        elif kind == CUT and simple:
            value = nothing()
        else:
            value = sum_of(here, families(here, kind, i, d))
        if kind == CUT and simple or kind == COAX and not families(here, kind, i, d) or kind == NB and mol.p.scalars["K_coax"] <= 0:
            known[kind] = value
            return build(step + 1)

        def bound(x):
            known[kind] = x
            return build(step + 1)

        return let(value, bound, CELL_DDL)

    return build(0)


def _diagonal(mol: Molecule, full: bool) -> Column:
    """Cells of offset 0: one letter each. A letter that is forced to pair can't stay alone."""
    one = lambda k: F.when(F.get(mol.forced, k) < 0, F.lit(0.0)).otherwise(nothing())
    zero = nothing()

    def cell(k):
        c = one(k) + mol.par["C_init"]
        return F.struct(*[x.alias(name) for x, name in zip((zero, zero, zero, c, c, c, c, one(k)), CELL, strict=True)], F.array().cast("array<double>").alias("q")).cast(CELL_DDL)

    return F.transform(span(0, mol.n - 1), cell)


#: Cells by their start, in the order of offsets, and by their end; what is named after the bond behind them is 0 without it.
def _sides(p: Params) -> tuple[dict[str, tuple[int, bool]], dict[str, int]]:
    """(rows, columns) of cells that sums over splits read: name to kind, and for rows whether the bond behind the cell must hold."""
    rows, cols = {"lin": (LIN, True), "c": (C, True)}, {"bp": BP}
    if p.scalars["K_coax"] > 0:
        join = C if p.strained else NB
        rows |= {"bonded": (BP, True), "join": (join, True), "bp": (BP, False), "cut": (CUT, False)}
        cols |= {"coax": COAX, "join": join, "cut": CUT}
    return rows, cols


def _state_ddl(p: Params) -> str:
    side = lambda names: "array<struct<" + ",".join(f"{c}:array<double>" for c in names) + ">>"
    rows, cols = _sides(p)
    return f"struct<cells:array<array<{CELL_DDL}>>,rows:{side(rows)},cols:{side(cols)}>"


def _put(mol: Molecule, state: Column | None, new: Column, d, simple: bool) -> Column:
    """The state with one more diagonal, new."""
    rows, cols = _sides(mol.p)

    def longer(old, x):
        return F.array(x) if old is None else F.concat(old, F.array(x))

    def of_row(i, r=None):
        cell = lambda kind: F.coalesce(F.get(new, i)[CELL[kind]], nothing())
        bonded = lambda x, held: F.when(mol.bond(i + d), x).otherwise(nothing()) if held and not simple else x
        return F.struct(*[longer(None if r is None else r[c], bonded(cell(kind), held)).alias(c) for c, (kind, held) in rows.items()])

    def of_col(j, r=None):
        at = F.pmod(j - d, mol.n) if mol.wrap else j - d
        return F.struct(*[longer(None if r is None else r[c], F.coalesce(F.get(new, at)[CELL[kind]], nothing())).alias(c) for c, kind in cols.items()])

    ks = span(0, mol.n - 1)
    if state is None:
        made = (F.array(new), F.transform(ks, lambda i: of_row(i)), F.transform(ks, lambda j: of_col(j)))
    else:
        # Rows and columns of which no later cell is made are let go.
        live = (lambda x, keep: x) if mol.wrap else (lambda x, keep: F.when(keep, x))
        made = (F.concat(state["cells"], F.array(new)), F.transform(state["rows"], lambda r, i: live(of_row(i, r), i < mol.n - d)), F.transform(state["cols"], lambda r, j: live(of_col(j, r), j >= d)))
    return F.struct(*[x.alias(c) for x, c in zip(made, ("cells", "rows", "cols"), strict=True)])


def _z_final(mol: Molecule, i) -> list[Family]:
    """Everything that closes the molecule between i - 1 and i."""
    p, s, n, g = mol.p, mol.par, mol.n, mol.get
    nick, bond = ~mol.bond(i - 1), mol.bond(i - 1)
    size = len(p.types)
    out = [
        Family(nick, lambda _: g(LIN, i, n - 1), lambda _: [(LIN, i, n - 1)]),
        Family(bond, lambda _: g(NC, i, n - 1) + s["l"], lambda _: [(NC, i, n - 1)]),
        Family(bond, lambda m: g(LIN, i, m) + g(LIN, i + m + 1, n - 2 - m), lambda m: [(LIN, i, m), (LIN, i + m + 1, n - 2 - m)], F.filter(F.transform(mol.nicks, lambda x: F.pmod(x - i, n)), lambda m: m <= n - 2)),
    ]
    flip = F.array(*[F.lit(t.flip) for t in p.types])

    def stacked(m):
        return F.flatten(F.transform(mol.possible(i, m), lambda a, k: F.transform(mol.possible(i + m + 1, n - 2 - m), lambda b, h: F.struct(m.alias("m"), k.alias("k"), h.alias("h"), F.get(s["stack"], F.get(flip, b) * size + a).alias("w")))))

    both = F.flatten(F.transform(F.filter(span(1, n - 2), lambda m: mol.bond(i + m)), stacked))
    weight = lambda x: x["w"] + F.get(mol.cell(i, x["m"])["q"], x["k"]) + F.get(mol.cell(i + x["m"] + 1, n - 2 - x["m"])["q"], x["h"])
    out.append(Family(bond, weight, lambda x: [(PAIR + x["k"], i, x["m"]), (PAIR + x["h"], i + x["m"] + 1, n - 2 - x["m"])], both))
    if p.motifs:
        # The pair (j, k) that closes a motif whose last strand runs over the joint; seen from outside it is the pair (k, j).
        every = F.flatten(F.flatten(F.transform(mol.motifs, lambda row, d: F.transform(row, lambda ls, j: F.transform(ls, lambda x: F.struct(j.alias("j"), d.alias("e"), F.get(mol.possible(j, d), x["t"]).alias("q"), x.alias("x")))))))
        out_of = lambda y: F.array_position(mol.possible(y["j"] + y["e"], n - y["e"]), F.get(flip, y["q"])).cast("int") - 1
        over = F.filter(every, lambda y: (F.pmod(y["j"] + y["e"] - i, n) + 1 < y["x"]["span"]) & (F.pmod(y["j"] - i, n) >= 1))
        w = lambda y: F.get(s["motif"], y["x"]["m"]) + F.when(y["x"]["d"] < 0, F.lit(0.0)).otherwise(F.get(mol.cell(y["x"]["i"], y["x"]["d"])["q"], y["x"]["u"])) + F.get(mol.cell(y["j"] + y["e"], n - y["e"])["q"], out_of(y))
        out.append(Family(bond, w, lambda y: [(PAIR + y["x"]["u"], y["x"]["i"], y["x"]["d"]), (PAIR + out_of(y), y["j"] + y["e"], n - y["e"])], over))
    if p.scalars["K_coax"] > 0:
        join = C if p.strained else NB
        two = lambda least: F.flatten(F.transform(span(1, n - 2), lambda m: F.transform(span(m + least, n - 2), lambda k: F.struct(m.alias("m"), k.alias("k")))))
        out += [
            Family(bond, lambda x: g(BP, i, x["m"]) + g(join, i + x["m"] + 1, x["k"] - x["m"] - 2) + g(BP, i + x["k"], n - 1 - x["k"]) + (s["l"] * 2 + s["l_coax"] + s["K_coax"]), lambda x: [(BP, i, x["m"]), (join, i + x["m"] + 1, x["k"] - x["m"] - 2), (BP, i + x["k"], n - 1 - x["k"])], F.filter(two(2), lambda x: mol.bond(i + x["m"]) & mol.bond(i + x["k"] - 1))),
            Family(bond, lambda x: g(BP, i, x["m"]) + g(CUT, i + x["m"], x["k"] - x["m"]) + g(BP, i + x["k"], n - 1 - x["k"]) + s["K_coax"], lambda x: [(BP, i, x["m"]), (CUT, i + x["m"], x["k"] - x["m"]), (BP, i + x["k"], n - 1 - x["k"])], F.filter(two(1), lambda x: ~((x["k"] - x["m"] == 1) & mol.bond(i + x["m"])))),
        ]
    return out


def molecule(p: Params, full: bool, cells: Column | None = None, best: bool = False) -> Molecule:
    """The columns of prepare(), candidates() and fill() as a molecule."""
    return Molecule(p, F.col("n"), F.col("lig"), F.col("nicks"), F.col("forced"), F.col("types"), F.col("motifs"), full, cells, par=F.col("par"), best=best)


def candidates(prepared: DataFrame, p: Params, full: bool) -> DataFrame:
    """prepared with types and motifs, the pairs and motifs possible at each cell."""
    none = F.lit(None)
    bare = Molecule(p, F.col("n"), F.col("lig"), F.col("nicks"), none, none, none, full)
    types, motifs = (built((name, shape(p), full), lambda f=f: f(p, full, bare)) for name, f in (("types", _candidates), ("motifs", _loops)))
    return settle(settle(prepared, types=types), motifs=motifs)


def fill(molecules: DataFrame, p: Params, full: bool = False, strands: bool = True, simple: bool | None = None, finals: bool = False, sets: list[Params] | None = None, best: bool = False) -> DataFrame:
    """molecules with cells (by offset, then start; all weights as logarithms), log_z, z and dg; with finals, z_final of every start.

    full fills all cells around the molecule, which circles, probabilities and derivatives need; otherwise cells that
    do not wrap. simple: the caller knows that every molecule is one linear strand. Molecules of no letter have z 1.
    sets: parameter sets of p's shape; each molecule is then one row a set (par.set is its place), candidates are listed
    once for all, and the plan is the same for any number of sets. best: cells hold the largest weight instead of the sum.
    """
    m = candidates(prepare(molecules), p, full)
    m = settle(m, forced=F.coalesce(F.col("of"), F.transform(F.col("seq"), lambda _: F.lit(-1)))).withColumn("par", F.explode(sets_column(sets or [p])))
    mol = molecule(p, full, best=best)
    simple = bool(simple) and not full

    def cells():
        def step(state, d):
            here = replace(mol, cells=state["cells"], rows=state["rows"], cols=state["cols"])
            row = F.transform(span(0, mol.n - 1 if full else mol.n - 1 - d), lambda i: _fill_cell(here, i, d, simple))
            # Not let(): what a lambda of transform() returns is copied, here the whole state at every offset.
            return F.aggregate(F.array(row.cast(f"array<{CELL_DDL}>")), state, lambda now, new: _put(mol, now, new, d, simple))

        first = let(_diagonal(mol, full), lambda new: _put(mol, None, new, F.lit(0), simple).cast(_state_ddl(p)), _state_ddl(p))
        return F.when(F.col("n") > 0, F.aggregate(span(1, mol.n - 1), first, step, lambda s: s["cells"]))

    key = (shape(p), full, simple, best)
    m = settle(m, cells=built(("cells", *key), cells))
    done = molecule(p, full, F.col("cells"), best)

    def log_z():
        whole = sum_of(done, _z_final(done, F.lit(0))) if full else done.get(LIN, F.lit(0), F.col("n") - 1)
        return F.when(F.col("n") == 0, F.lit(0.0)).otherwise(whole)

    m = settle(m, log_z=built(("log_z", *key), log_z)).withColumns({"z": F.exp("log_z"), "dg": free_energy(F.col("log_z"))})
    if finals:
        m = m.withColumn("z_final", built(("z_final", *key), lambda: F.transform(span(0, F.col("n") - 1), lambda i: F.exp(sum_of(done, _z_final(done, i))))))
    return m


def free_energy(log_z: Column) -> Column:
    """In kcal/mol; null where nothing is possible."""
    return F.when(log_z > nothing(), -KT * log_z)


def possible(filled: DataFrame) -> DataFrame:
    """The molecules for which some structure is possible."""
    return filled.filter(F.col("log_z") > nothing())


def partition(molecules: DataFrame, p: Params, **how) -> DataFrame:
    """(mol_id, n, log_z, z, dg) of molecules (mol_id, strands, circle, and if there structure, allow_extra), and with sets, set. dg is in kcal/mol and null where no structure is possible; z is infinite beyond the range of doubles, where log_z and dg still hold. Circles are filled around."""
    by = [F.col("par.set").alias("set")] if how.get("sets") else []
    return fill(molecules, p, **how).select("mol_id", *by, "n", "log_z", "z", "dg")


def linear(sequences: DataFrame, sequence: str = "sequence", key: str = "mol_id") -> DataFrame:
    """Molecules of sequences whose strands are parted by blanks, "+" or ","; a "*" at the end makes a circle."""
    s = F.col(sequence)
    return sequences.select(F.col(key).alias("mol_id"), strands_of(F.regexp_replace(s, r"\*$", "")).alias("strands"), F.coalesce(s.endswith("*"), F.lit(False)).alias("circle"))
