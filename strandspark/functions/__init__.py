"""Column functions: sequences, structures and expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BUILT: dict[tuple, Column] = {}


def built(key: tuple, make: Callable[[], Column]) -> Column:
    """make(), kept for the next call with the same key in this Spark application: a fold's expression is large, and building it takes longer than planning it. It reads columns by their names, so it fits any table that has them."""
    app = SparkContext.getOrCreate().applicationId
    if (app, *key) not in _BUILT:
        if len(_BUILT) >= 256:
            _BUILT.clear()
        _BUILT[app, *key] = make()
    return _BUILT[app, *key]


def let(value: Column, use: Callable[[Column], Column], kind: str | None = None) -> Column:
    """use(value) with value computed once, within an expression. kind: the type of the result, if it is known; Spark then need not derive it anew at every evaluation, nor copy the result."""
    if kind:
        return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: use(x))
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. The optimizer would copy an expression into whatever reads it once, even where that runs for every element of an array; it does not move one through a generator."""
    out = df.drop(*columns)
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    made = df.select(*[F.col(c) for c in out.columns], F.explode(F.array(row)).alias("_settled"))
    return made.select(*out.columns, *[F.col(f"_settled.{k}").alias(k) for k in columns])


def span(lo: Column | int, hi: Column | int) -> Column:
    """lo to hi, both included; empty if hi < lo."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def total(items: Column, weight: Callable[[Column], Column]) -> Column:
    """Sum of weight over an array; 0.0 if it is empty."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.coalesce(weight(x), F.lit(0.0)))


def strands_of(sequence: Column) -> Column:
    """Strands of a sequence: parted by blanks, "+" or ","; empty ones are left out."""
    return F.filter(F.split(sequence, "[+ ,]"), lambda s: s != "")


def dotparen(structure: Column) -> Column:
    """A structure without what parts its strands."""
    return F.translate(structure, " +,", "")


def letters(sequence: Column) -> Column:
    """One string for each character."""
    return F.filter(F.split(sequence, ""), lambda s: s != "")


def partners(structure: Column) -> Column:
    """For each position of a dot-paren string its partner's position, or -1. Raises an error if brackets do not match."""
    chars = letters(dotparen(structure))
    empty = F.struct(F.array().cast("array<int>").alias("open"), F.transform(chars, lambda c: F.lit(-1)).alias("of"), F.lit(True).alias("sound"))
    n = F.size(chars)

    def step(state, x):
        i, c = x["i"], x["c"]
        opened, of = state["open"], state["of"]
        last = F.try_element_at(opened, F.lit(-1))
        put = F.transform(of, lambda v, k: F.when(k == i, last).when(k == last, i).otherwise(v))
        make = lambda o, p, ok: F.struct(o.alias("open"), p.alias("of"), ok.alias("sound"))
        return (
            F.when(c == "(", make(F.concat(opened, F.array(i)), of, state["sound"]))
            .when((c == ")") & (F.size(opened) > 0), make(F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0))), put, state["sound"]))
            .when(c == ")", make(opened, of, F.lit(False)))
            .otherwise(state)
        )

    kind = "struct<open:array<int>,of:array<int>,sound:boolean>"
    items = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    done = F.aggregate(items, empty.cast(kind), lambda s, x: step(s, x).cast(kind))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        let(done, lambda d: F.when(d["sound"] & (F.size(d["open"]) == 0), d["of"]).otherwise(F.raise_error(F.concat(F.lit("brackets do not match: "), structure)).cast("array<int>")))
    )


def pairs_of(of: Column) -> Column:
    """Base pairs (i < j), by i, from partners()."""
    return F.filter(F.transform(of, lambda j, i: F.struct(i.alias("i"), j.alias("j"))), lambda p: p["j"] > p["i"])


def structure_of(pairs: Column, n: Column) -> Column:
    """The dot-paren string of n positions with the given pairs."""
    mark = lambda k: F.when(F.exists(pairs, lambda p: p["i"] == k), "(").when(F.exists(pairs, lambda p: p["j"] == k), ")").otherwise(".")
    return F.array_join(F.transform(span(0, n - 1), mark), "")


def with_spaces(text: Column, strands: Column, circle: Column) -> Column:
    """A string of all positions parted as the strands are, with "*" at the end of a circle."""
    ends = lambda k: F.aggregate(F.slice(strands, 1, k), F.lit(0), lambda n, s: n + F.length(s))
    parts = F.transform(strands, lambda s, k: F.substring(text, ends(k) + 1, F.length(s)))
    return F.concat(F.array_join(parts, " "), F.when(circle, "*").otherwise(""))


def connections(strands: Column, circle: Column) -> Column:
    """Joints that make one complex of the strands: their number less one, and less one for a circle."""
    return F.size(strands) - 1 - circle.cast("int")
