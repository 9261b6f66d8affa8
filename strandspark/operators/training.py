"""Fitting parameters so that known structures come close to their ensembles in energy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import fold, observables, scoring
from strandspark.sources.params import KT, Params

#: How far beyond its bounds a parameter's logarithm may start.
DELTA = 1.0


def bounds(tag: str) -> tuple[float, float]:
    """Logarithms of the values that a parameter should keep to."""
    if tag.startswith("Kd"):
        lo, hi = 100.0, 100000.0
    elif tag.startswith("C_eff"):
        lo, hi = 0.1, 100000.0
    elif tag in ("C_init", "K_coax"):
        lo, hi = 0.1, 100.0
    elif tag.startswith("l"):
        lo, hi = 0.1, 10.0
    else:
        raise ValueError(f"no bounds for {tag!r}")
    return math.log(lo), math.log(hi)


def priors(x: np.ndarray, tags: list[str]) -> tuple[float, np.ndarray]:
    """A penalty that is 0 within the bounds and rises as the square of the distance from them, and its slope."""
    lo, hi = np.array([bounds(t) for t in tags]).T
    off = np.minimum(x - lo, 0) + np.maximum(x - hi, 0)
    return float(((off / DELTA) ** 2).sum()), 2 * off / DELTA**2


def bounded(values: DataFrame) -> DataFrame:
    """(tag, x, lo, hi, prior, prior_slope) of rows (tag, x: a parameter's logarithm), as expressions."""
    tag = F.col("tag")
    hi = F.when(tag.startswith("Kd") | tag.startswith("C_eff"), 100000.0).when(tag.isin("C_init", "K_coax"), 100.0).otherwise(10.0)
    t = values.withColumns({"lo": F.log(F.when(tag.startswith("Kd"), 100.0).otherwise(0.1)), "hi": F.log(hi)})
    off = F.least(F.col("x") - F.col("lo"), F.lit(0.0)) + F.greatest(F.col("x") - F.col("hi"), F.lit(0.0))
    return t.select("tag", "x", "lo", "hi", (off * off / DELTA**2).alias("prior"), (2 * off / DELTA**2).alias("prior_slope"))


def bounds_table(spark: SparkSession, p: Params) -> DataFrame:
    """(tag, x, lo, hi, prior, prior_slope) of each parameter of a set."""
    return bounded(spark.createDataFrame([(k, v) for k, v in p.values.items()], "tag string, val double").select("tag", F.log("val").alias("x")))


def train_tags(p: Params, include: list[str] | None = None, exclude: list[str] | None = None, no_coax: bool = False) -> list[str]:
    if include is not None:
        return include
    out = {*(exclude or ()), *(("K_coax", "l_coax") if no_coax else ())}
    if unknown := out - set(p.values):
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    return [t for t in p.values if t not in out]


def start(p: Params, tags: list[str], values: list[float] | None = None, logs: list[float] | None = None, use_bounds: bool = False) -> np.ndarray:
    """Logarithms to start from: as given, or the set's; -inf for 0. With use_bounds they are moved to within DELTA of their bounds."""
    given = logs if logs is not None else values
    if given is not None and len(given) != len(tags):
        raise ValueError(f"{len(given)} values for {len(tags)} parameters")
    with np.errstate(divide="ignore"):
        x = np.array(logs, float) if logs is not None else np.log(np.array(values if values is not None else [p.values[t] for t in tags], float))
    if use_bounds:
        lo, hi = np.array([bounds(t) for t in tags]).T
        x = np.clip(x, lo - DELTA, hi + DELTA)
    return x


def _held(examples: DataFrame) -> DataFrame:
    """The examples as their ensembles are: free, or held to the pairs in force."""
    held = examples.drop("structure", "allow_extra")
    return held.withColumnRenamed("force", "structure").withColumn("allow_extra", F.lit(True)) if "force" in examples.columns else held


def gaps(examples: DataFrame, p: Params, sets: list[Params] | None = None) -> DataFrame:
    """(mol_id, dg_gap) of examples (molecules with structure, and if there force: pairs that the ensemble is held to); with sets (of p's shape) one row a set, with set, its place."""
    by = ["mol_id", "set"] if sets else ["mol_id"]
    bound = scoring.score(examples.drop("force", "allow_extra"), p, sets=sets).select(*by, F.col("dg").alias("own"))
    free = fold.fill(_held(examples), p, sets=sets).select("mol_id", F.col("par.set").alias("set"), "dg")
    return free.join(bound, by).select(*by, (F.col("own") - F.col("dg")).alias("dg_gap"))


def losses(examples: DataFrame, p: Params, sets: list[Params], weight: str | None = None) -> DataFrame:
    """(set, examples, loss) of each parameter set, by its place in sets, over the examples whose structure is possible. One plan folds all examples by all sets. weight: a column that counts an example so many times."""
    each = gaps(examples, p, sets).filter("dg_gap is not null")
    each = each.join(examples.select("mol_id", F.col(weight).alias("_w")), "mol_id") if weight else each.withColumn("_w", F.lit(1).cast("long"))
    return each.groupBy("set").agg(F.sum("_w").alias("examples"), F.sum(F.col("dg_gap") * F.col("_w")).alias("loss"))


def loss(examples: DataFrame, p: Params, spark: SparkSession, weight: str | None = None) -> DataFrame:
    """One row: (examples, loss), over the examples whose structure is possible."""
    return losses(examples, p, [p], weight).agg(F.coalesce(F.sum("examples"), F.lit(0)).alias("examples"), F.sum("loss").alias("loss"))


def slope(examples: DataFrame, p: Params, tags: list[str], weight: str | None = None) -> DataFrame:
    """(tag, slope): derivatives of the loss by the parameters' logarithms, summed over the examples whose structure is possible."""
    scored, bound = scoring.score(examples.drop("force", "allow_extra"), p, tags)
    possible = scored.filter("dg is not null").select("mol_id")
    held = _held(examples.join(possible, "mol_id", "left_semi"))
    free = observables.log_derivatives(fold.fill(held, p, full=True), p, tags)
    bound = bound.join(possible, "mol_id", "left_semi")
    both = free.select("mol_id", "tag", F.col("dlogz_dlogp").alias("d")).unionByName(bound.select("mol_id", "tag", (-F.col("dlogz_dlogp")).alias("d")))
    if weight:
        both = both.join(examples.select("mol_id", F.col(weight).alias("_w")), "mol_id").withColumn("d", F.col("d") * F.col("_w"))
    return both.groupBy("tag").agg((KT * F.sum("d")).alias("slope"))


def step(examples: DataFrame, p: Params, tags: list[str], rate: float, weight: str | None = None) -> DataFrame:
    """(tag, x, slope, x_next): one step of rate down the loss's slope from the set's logarithms."""
    now = examples.sparkSession.createDataFrame([(t, math.log(p.values[t])) for t in tags], "tag string, x double")
    return now.join(slope(examples, p, tags, weight), "tag", "left").select("tag", "x", F.coalesce("slope", F.lit(0.0)).alias("slope")).withColumn("x_next", F.col("x") - rate * F.col("slope"))


def shifted(p: Params, tags: list[str], h: float) -> list[Params]:
    """For each tag the set with its logarithm h higher, then h lower."""
    return [p.updated({t: p.values[t] * math.exp(x)}) for t in tags for x in (h, -h)]


def slope_check(examples: DataFrame, p: Params, tags: list[str], h: float = 1e-5) -> DataFrame:
    """(tag, slope, numeric): the loss's slopes beside its differences. The losses of all shifted sets are one plan, whatever the number of tags."""
    tag = F.get(F.array(*[F.lit(t) for t in tags]), F.floor(F.col("set") / 2).cast("int"))
    sign = F.when(F.col("set") % 2 == 0, F.col("loss")).otherwise(-F.col("loss"))
    numeric = losses(examples, p, shifted(p, tags, h)).groupBy(tag.alias("tag")).agg((F.sum(sign) / (2 * h)).alias("numeric"))
    return slope(examples, p, tags).join(numeric, "tag")


#: Step lengths that are tried at once, each half of the one before.
TRIES = 4


def minimize(f, grad, x: np.ndarray, steps: int = 20, tol: float = 1e-5, seen: list[tuple] | None = None, record=None) -> tuple[np.ndarray, float, list[tuple]]:
    """Quasi-Newton descent with backtracking. f gives the values of several points at once, and TRIES step lengths are asked for together.

    The trace has (value, point, slope) of each accepted point. seen, the trace of an earlier run, is gone through
    again without asking f or grad, so that a descent goes on as if it had not been stopped; record(step, tries,
    accepted) is told of each step: tries are (value, point), accepted one of the trace.
    """
    trace = [tuple(t) for t in seen or []]
    if not trace:
        trace = [(f([x])[0], x.copy(), grad(x))]
        if record:
            record(0, [trace[0][:2]], trace[0])
    h = np.eye(len(x))

    def direction(h, g):
        d = -h @ g
        return (np.eye(len(g)), -g) if d @ g >= 0 else (h, d)

    def learned(h, s, k):
        if (r := s @ k) <= 1e-12:
            return h
        a = np.eye(len(s)) - np.outer(s, k) / r
        return a @ h @ a.T + np.outer(s, s) / r

    for (_, x0, g0), (_, x1, g1) in zip(trace, trace[1:], strict=False):
        h = learned(direction(h, g0)[0], x1 - x0, g1 - g0)
    while len(trace) <= steps:
        y, x, g = trace[-1]
        if np.abs(g).max() < tol:
            break
        h, d = direction(h, g)
        t, tries, found = min(1.0, 1.0 / max(np.abs(d).max(), 1e-12)), [], None
        while t > 1e-6 and found is None:
            lengths = [t / 2**k for k in range(TRIES)]
            values = f([x + k * d for k in lengths])
            tries += [(v, x + k * d) for k, v in zip(lengths, values, strict=True)]
            found = next(((v, x + k * d) for k, v in zip(lengths, values, strict=True) if v <= y + 1e-4 * k * (d @ g)), None)
            t /= 2**TRIES
        if found is None:
            break
        new = grad(found[1])
        h = learned(h, found[1] - x, new - g)
        trace.append((*found, new))
        if record:
            record(len(trace) - 1, tries, trace[-1])
    return trace[-1][1], trace[-1][0], trace


TRACE_DDL = "number int, accepted boolean, loss double, tag string, x double, slope double"


def _record(spark: SparkSession, path: str, run: str, tags: list[str]):
    """Writes a step's tries, and the accepted point with its slopes, as one folder of path. A step that is written again replaces itself."""

    def write(step, tries, accepted):
        rows = [(k, False, float(v), t, float(a), None) for k, (v, x) in enumerate(tries) for t, a in zip(tags, x, strict=True)]
        rows += [(None, True, float(accepted[0]), t, float(a), float(s)) for t, a, s in zip(tags, accepted[1], accepted[2], strict=True)]
        spark.createDataFrame(rows, TRACE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/step={step}")

    return write


def recorded(spark: SparkSession, path: str, run: str, tags: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The accepted points of a run that was recorded at path, in order; none if there is no such run. Other tags than the run's raise an error."""
    try:
        rows = spark.read.parquet(f"{path}/run={run}").filter("accepted").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    out = []
    for k in range(max(r["step"] for r in rows) + 1):
        own = {r["tag"]: r for r in rows if r["step"] == k}
        if set(own) != set(tags):
            raise ValueError(f"step {k} of {run!r} is of other tags: {sorted(own)}")
        out.append((own[tags[0]]["loss"], np.array([own[t]["x"] for t in tags]), np.array([own[t]["slope"] for t in tags])))
    return out


def train(examples: DataFrame, p: Params, tags: list[str], x: np.ndarray | None = None, steps: int = 5, use_priors: bool = False, path: str | None = None, run: str = "run") -> tuple[Params, list[tuple[float, np.ndarray, np.ndarray]]]:
    """The set with tags fitted to the examples, and the trace: (loss, logarithms, slopes) of each accepted step.

    A step is two Spark jobs: the losses of several step lengths at once, and the slopes. Only these sums come to the
    driver. With path, every step is written there with its tries, and a run of the same name goes on from the last one
    written.
    """
    spark = examples.sparkSession
    at = lambda v: p.updated(dict(zip(tags, np.exp(v).tolist(), strict=True)))

    def f(points):
        got = {r["set"]: r["loss"] for r in losses(examples, p, [at(v) for v in points]).collect()}
        return [got.get(k, 0.0) + (priors(v, tags)[0] if use_priors else 0.0) for k, v in enumerate(points)]

    def grad(v):
        got = {r["tag"]: r["slope"] for r in slope(examples, at(v), tags).collect()}
        return np.array([got.get(t, 0.0) for t in tags]) + (priors(v, tags)[1] if use_priors else 0.0)

    seen = recorded(spark, path, run, tags) if path else []
    best, _, trace = minimize(f, grad, start(p, tags) if x is None else x, steps, seen=seen, record=_record(spark, path, run, tags) if path else None)
    return at(best), trace


def trace_table(spark: SparkSession, trace: list[tuple], tags: list[str]) -> DataFrame:
    """(step, loss, tag, x, slope): a training's accepted steps, to be kept as a table."""
    return spark.createDataFrame([(k, float(y), t, float(v), float(g)) for k, (y, x, gs) in enumerate(trace) for t, v, g in zip(tags, x, gs, strict=True)], "step int, loss double, tag string, x double, slope double")
