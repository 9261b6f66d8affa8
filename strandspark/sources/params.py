"""Energy parameters: text files of tag and value, resolved in their order to what a fold needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.sources.sets import SETS

#: kcal/mol at 37 degrees C, and the standard state in M.
KT = 0.61633135471
C_STD = 1.0

#: The small parameter set whose partition functions have closed forms.
MINIMAL = """
name minimal
version 0.1
min_loop_length 1
allow_strained_3WJ False
Kd_matchlowercase 0.0002
Kd_CG 0.0002
C_init 1.0
l 0.5
l_BP 0.2
C_eff_stacked_pair 10000
K_coax 100
l_coax 200
"""

#: The default parameter set, trained on known structures, with nearest-neighbour stacks.
DEFAULT = """
name default
version 0.31
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071798
Kd_AU 7372.206287
Kd_GU 17378.420597
C_init 10.001552
l 0.791198
l_BP 1.706068
C_eff_motif_NN_NNN 353.977155
C_eff_motif_NN_NNNN 58.427771
C_eff_motif_NN_NNNNN 2.555806
C_eff_motif_NNN_NNN 1126.455162
C_eff_motif_NNN_NNNN 144.398010
C_eff_motif_NNN_NNNNN 66.473753
C_eff_motif_NNNN_NNNN 672.525066
C_eff_motif_NNNN_NNNNN 0.116215
C_eff_motif_NNNNN_NNNNN 0.099984
C_eff_motif_NNNNN 0.098858
C_eff_motif_NNNNNN 18.253115
C_eff_motif_NNNNNNN 7.872164
C_eff_motif_NNNNNNNN 4.391261
C_eff_motif_NNNNNNNNN 20.715110
C_eff_motif_NNNNNNNNNN 2.572485
C_eff_motif_NNNNNNNNNNN 6.978898
C_eff_motif_NNNNNNNNNNNN 43.956759
C_eff_motif_NGNAAN 74.249746
C_eff_motif_NGNGAN 61.854167
C_eff_motif_NUNCGN 2689.870489
C_eff_stack_AU_UA 43924.456658788986
C_eff_stack_AU_GC 71540.18770718151
C_eff_stack_AU_CG 84142.32777698337
C_eff_stack_AU_UG 22977.297378860443
C_eff_stack_AU_GU 6274.561315155421
C_eff_stack_AU_AU 31752.46921656331
C_eff_stack_CG_UA 71540.18770718151
C_eff_stack_CG_GC 37423.34663936005
C_eff_stack_CG_CG 161184.26640372947
C_eff_stack_CG_UG 23001.13573189372
C_eff_stack_CG_GU 7387.511169616369
C_eff_stack_CG_AU 71540.18770718151
C_eff_stack_GC_UA 84142.32777698337
C_eff_stack_GC_GC 161184.26640372947
C_eff_stack_GC_CG 189577.6319702579
C_eff_stack_GC_UG 44015.64491736168
C_eff_stack_GC_GU 8688.855959314003
C_eff_stack_GC_AU 116397.43682301695
C_eff_stack_GU_UA 22977.297378860443
C_eff_stack_GU_GC 23001.13573189372
C_eff_stack_GU_CG 44015.64491736168
C_eff_stack_GU_UG 92.46089151486113
C_eff_stack_GU_GU 1715.2132616356942
C_eff_stack_GU_AU 19535.948326082056
C_eff_stack_UA_UA 31752.46921656331
C_eff_stack_UA_GC 71540.18770718151
C_eff_stack_UA_CG 116397.43682301695
C_eff_stack_UA_UG 19535.948326082056
C_eff_stack_UA_GU 12007.183735590115
C_eff_stack_UA_AU 60762.452192643985
C_eff_stack_UG_UA 6274.561315155421
C_eff_stack_UG_GC 7387.511169616369
C_eff_stack_UG_CG 8688.855959314003
C_eff_stack_UG_UG 1715.2132616356942
C_eff_stack_UG_GU 468.38453632072145
C_eff_stack_UG_AU 12007.183735590115
"""

PACKAGED = {"minimal": MINIMAL, **SETS, "v0.31": DEFAULT}
STRICT = ("CG", "GC", "AU", "UA")
SCALARS = ("C_init", "l", "l_BP", "l_coax", "K_coax")


@dataclass(frozen=True)
class PairType:
    """One orientation of a base pair; lower: any two equal lower-case letters."""

    tag: str
    kd: float
    flip: int
    lower: bool = False

    @property
    def ends(self) -> tuple[str, str]:
        return ("", "") if self.lower else (self.tag[0], self.tag[1])


@dataclass(frozen=True)
class Motif:
    """strands around a loop, pairs[k]: types that may join strand k to the next one; tag as it was given and as it is turned."""

    given: str
    tag: str
    strands: tuple[str, ...]
    pairs: tuple[tuple[int, ...], ...]
    c_eff: float


@dataclass(frozen=True)
class Params:
    """A resolved set. It is small, at most some hundred numbers, and goes into plans as literals."""

    name: str = ""
    version: str = ""
    min_loop_length: int = 1
    strained: bool = False
    scalars: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SCALARS, 0.0))
    types: tuple[PairType, ...] = ()
    stack: dict[tuple[int, int], float] = field(default_factory=dict)
    motifs: tuple[Motif, ...] = ()
    values: dict[str, float] = field(default_factory=dict)

    def of_tag(self, tag: str) -> list[int]:
        """Types that a tag names: WC the strict ones, NN all, another its own; none if there is no such type."""
        return [k for k, t in enumerate(self.types) if tag == "NN" or (t.tag in STRICT if tag == "WC" else t.tag == tag)]

    def without_coax(self) -> Params:
        return replace(self, scalars=self.scalars | {"K_coax": 0.0})

    def without_motifs(self) -> Params:
        return replace(self, motifs=())

    def updated(self, values: dict[str, float]) -> Params:
        """The same set with other values of some tags, resolved anew in the same order."""
        if missing := set(values) - set(self.values):
            raise ValueError(f"no such parameters: {sorted(missing)}")
        head = [("name", self.name), ("version", self.version), ("min_loop_length", str(self.min_loop_length)), ("allow_strained_3WJ", str(self.strained))]
        return resolve([*head, *((t, repr(float(values.get(t, v)))) for t, v in self.values.items())])

    def rows(self) -> list[tuple[int, str, str]]:
        """(ord, tag, value), from which it can be resolved again without loss."""
        head = [("name", self.name), ("version", self.version), ("min_loop_length", str(self.min_loop_length)), ("allow_strained_3WJ", str(self.strained))]
        return [(k, t, v) for k, (t, v) in enumerate([*head, *((t, repr(v)) for t, v in self.values.items())])]


def motif_parts(tag: str) -> tuple[list[str], list[str | None]]:
    """Strands, and for each the tag of the pair after it, if one is given."""
    strands: list[str] = []
    pairs: list[str | None] = []
    for part in tag.split("_"):
        if part == "WC":
            pairs[-1] = part
        else:
            strands.append(part)
            pairs.append(None)
    return strands, pairs


def stack_of_motif(tag: str) -> str | None:
    """The stack that a motif of two strands of two letters is, as PAIR_PAIR."""
    strands, pairs = motif_parts(tag)
    if [len(s) for s in strands] != [2, 2]:
        return None
    return f"{pairs[1] or strands[0][0] + strands[1][1]}_{pairs[0] or strands[0][1] + strands[1][0]}"


def resolve(fields: list[tuple[str, str]]) -> Params:
    """Tags and values, in order, to a set. Order matters: a stacked-pair value counts for the pairs known so far, later values replace earlier ones, and every stack is mirrored."""
    p = Params()
    stack: dict[tuple[int, int], float] = {}
    motifs: list[Motif] = []
    types: list[PairType] = []
    values: dict[str, float] = {}
    scalars = dict.fromkeys(SCALARS, 0.0)

    def find(tag):
        return replace(p, types=tuple(types)).of_tag(tag)

    def put(pair_pair, x):
        first, second = (find(t) for t in pair_pair.split("_"))
        for a in first:
            for b in second:
                stack[a, b] = stack[types[b].flip, types[a].flip] = x

    for tag, text in fields:
        if tag in ("name", "version"):
            p = replace(p, **{tag: text})
        elif tag == "min_loop_length":
            p = replace(p, min_loop_length=int(text))
        elif tag == "allow_strained_3WJ":
            p = replace(p, strained=text == "True")
        else:
            x = values[tag] = float(text)
            if tag in SCALARS:
                scalars[tag] = x
            elif tag.startswith("Kd_"):
                own = tag[3:]
                if at := find(own):
                    for k in {at[0], types[at[0]].flip}:
                        types[k] = replace(types[k], kd=x)
                elif own == "matchlowercase" or own[0] == own[1]:
                    types.append(PairType(own, x, len(types), own == "matchlowercase"))
                else:
                    types += [PairType(own, x, len(types) + 1), PairType(own[::-1], x, len(types))]
            elif tag == "C_eff_stacked_pair":
                stack.update(dict.fromkeys([(a, b) for a in range(len(types)) for b in range(len(types))], x))
            elif tag.startswith("C_eff_stack_"):
                put(tag[12:], x)
            elif tag.startswith("C_eff_motif_"):
                given = tag[12:]
                if same := stack_of_motif(given):
                    put(same, x)
                    continue
                strands, pairs = motif_parts(given)
                turns = {}
                for k in range(len(strands)):
                    s, b = strands[k:] + strands[:k], pairs[k:] + pairs[:k]
                    name = "_".join(x if y is None else f"{x}_{y}" for x, y in zip(s, b, strict=True))
                    joins = tuple(tuple(find(y or x[-1] + z[0])) for x, y, z in zip(s, b, s[1:] + s[:1], strict=True))
                    turns.setdefault(name, Motif(given, name, tuple(s), joins, x))
                motifs = [m for m in motifs if m.given != given] + list(turns.values())
            else:
                raise ValueError(f"unknown parameter tag {tag!r}")
    # An NN junction means all types, those that were registered after the motif too.
    every = tuple(range(len(types)))
    motifs = [replace(m, pairs=tuple(every if _wild(m, k) else own for k, own in enumerate(m.pairs))) for m in motifs]
    return replace(p, scalars=scalars, types=tuple(types), stack=stack, motifs=tuple(motifs), values=values)


def _wild(m: Motif, k: int) -> bool:
    parts, pairs = motif_parts(m.tag)
    return pairs[k] is None and parts[k][-1] + parts[(k + 1) % len(parts)][0] == "NN"


def check_stacks(p: Params) -> bool:
    """Whether every stack equals its mirror image."""
    return all(x == p.stack.get((p.types[b].flip, p.types[a].flip), 0.0) for (a, b), x in p.stack.items())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(param_set, ord, tag, val) of one parameter file or of all that path matches; comments and empty lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.params)?$", 1).alias("param_set"), F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    return lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != "")).select("param_set", "ord", fields[0].alias("tag"), fields[1].alias("val"))


def available(spark: SparkSession, path: str) -> list[str]:
    """Names of the sets in a folder, in the order of strings."""
    return sorted(r[0] for r in read(spark, path).select("param_set").distinct().collect())


def latest(spark: SparkSession, path: str) -> str | None:
    """The last name in the order of strings."""
    return max(available(spark, path), default=None)


def load(spark: SparkSession, which: str | Params | None = None) -> Params:
    """A resolved set as it is; the default set if nothing is given; else a file by its path, a file by its path without .params, or a packaged set by its name, in this order. Nothing found: an error that lists the packaged names."""
    if isinstance(which, Params):
        return which
    if not which:
        return packaged("v0.31")
    for path in (which, f"{which}.params"):
        try:
            rows = read(spark, path).orderBy("ord").limit(10_000).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if not rows:
            raise ValueError(f"no parameters in {path}")
        if len({r["param_set"] for r in rows}) > 1:
            raise ValueError(f"{path} holds several parameter sets")
        return resolve([(r["tag"], r["val"]) for r in rows])
    return packaged(which)


def packaged(name: str) -> Params:
    if name not in PACKAGED:
        raise ValueError(f"no parameters {name!r}; there are {', '.join(PACKAGED)}")
    return resolve([tuple(line.split()[:2]) for line in PACKAGED[name].splitlines() if line.strip()])


def write(spark: SparkSession, p: Params, path: str) -> None:
    """One text file of tags and values at full precision."""
    spark.createDataFrame(p.rows(), "ord int, tag string, val string").coalesce(1).sortWithinPartitions("ord").select(F.concat_ws(" ", "tag", "val")).write.text(path)
