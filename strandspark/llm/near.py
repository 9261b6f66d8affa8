"""Near copies for the pipeline: what SimHash balls link, and what has a Jaccard measure of 0.8 or more.

Texts of Jaccard 0.8 differ in about ten of 64 fingerprint bits, beyond any ball that can be emitted, so SimHash alone
loses them. MinHash bands find these candidates, whole shingle sets verify them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import cut, slices
from strandspark.llm.components import components
from strandspark.llm.simhash import classes, fingerprint, keep_least, marks

#: 16 bands of 4 hashes: two texts of Jaccard 0.8 share a band with probability 0.9998.
BANDS, ROWS = 16, 4
ODD = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (A-Z lower-cased); a shorter text is one shingle, one without words has none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), 42) for s in zip(*(ws[k:] for k in range(width)), strict=False)] if len(ws) >= width else [digest(b" ".join(ws), 42)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band's least hashes."""
    least = np.full(len(ODD), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 1 << 13):
            x = hashes[k : k + (1 << 13), None] * ODD
            least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * ODD[::-1]).min(0))
        out = np.zeros(BANDS, np.uint64)
        for x in least.reshape(BANDS, ROWS).T:
            out = (out ^ x) * ODD[0]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes."""
    both = np.concatenate([a, b])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(both) - n) if len(both) else 1.0


def sets(docs: DataFrame, keep: list[str], text: str, width: int = 5) -> DataFrame:
    """keep with fp (equal for equal sets), n, bands and the set itself of each text, and sim, its SimHash fingerprint."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            own = [shingles(t, width) for t in texts]
            sim = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            fp = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in own], pa.int64())
            cells = pa.array([bands(x).tolist() for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp, pa.array([len(x) for x in own], pa.int64()), cells, pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()), pa.array(sim)], [*keep, "fp", "n", "bands", "shingles", "sim"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long, n long, bands array<long>, shingles binary, sim long"]))


def _verified(pairs: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """Those of pairs (u, v) whose sets have a Jaccard of least or more."""

    def run(batches):
        for b in slices(batches):
            near = [jaccard(np.unique(np.frombuffer(x, "<u4")), np.unique(np.frombuffer(y, "<u4"))) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(of.select(F.col("fp").alias("u"), F.col("shingles").alias("x")), "u").join(of.select(F.col("fp").alias("v"), F.col("shingles").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


#: Up to so many sets of a bucket are all compared with one another in some band.
FEW = 4


def _crowded(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root) of the sets in buckets of more than FEW that do not hang together yet; roots: (node, root) of those that hang together with others."""
    told = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = told.groupBy("band", "cell").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter((F.col("c") > FEW) & (F.col("lo") != F.col("hi"))).select("band", "cell")
    return told.join(apart, ["band", "cell"], "left_semi").select("fp", "root").distinct()


def _by_rare(crowd: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of sets of different roots that can have a Jaccard of least or more: all of them, by prefix filtering.

    Shingles are ordered by how many of the crowd's sets hold them. Two sets of n <= m shingles with that Jaccard share
    least / (1 + least) * (n + m) of them, so that the first they share is among the rarest n - 2 * least / (1 + least)
    * n + 1 of the smaller and m - least * m + 1 of the larger one. What a family's sets all hold stands behind those.
    """

    def taken_apart(batches):
        for b in slices(batches):
            own = [np.unique(np.frombuffer(x, "<u4")).astype(np.int64) for x in b.column("shingles").to_pylist()]
            size = np.array([len(x) for x in own])
            at = pa.array(np.repeat(np.arange(len(own)), size))
            yield pa.RecordBatch.from_arrays([b.column("fp").take(at), b.column("root").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *own]))], ["fp", "root", "token"])

    rows = cut(crowd.mapInArrow(taken_apart, "fp long, root long, token long"))
    held = rows.groupBy("token").agg(F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("between"))
    front = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    ordered = rows.join(held, "token").groupBy("fp", "root").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token", "between"))).alias("ts"))
    first = ordered.select("fp", "root", "n", F.posexplode(F.slice("ts", 1, front(least).cast("int"))).alias("at", "t")).filter("t.between")
    both = 2 * least / (1 + least)
    first = cut(first.select("fp", "root", "n", "at", "t.token", (F.col("at") < front(both)).alias("small")))
    a, b = (first.select("token", *[F.col(c).alias(k + c) for c in ("fp", "root", "n", "at")], F.col("small").alias(k + "small")) for k in "ab")
    smaller = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("afp") < F.col("bfp")))
    share = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))  # at most, with this shingle the first
    met = a.filter("asmall").join(b, "token").filter((F.col("aroot") != F.col("broot")) & smaller & (F.col("an") >= F.lit(least) * F.col("bn") - 1e-9) & (share >= F.lit(both / 2) * (F.col("an") + F.col("bn")) - 1e-9))
    return met.select(F.least("afp", "bfp").alias("u"), F.greatest("afp", "bfp").alias("v")).distinct()


def _grown(of: DataFrame, least: float, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, roots, extra): verified edges with same (u, v), what hangs together by them (node, root), and the edges between those groups that they lack, if any set was left to look at."""
    met = cut(of.filter("n > 0").select("fp", "n", F.posexplode("bands").alias("band", "cell")))
    w = Window.partitionBy("band", "cell").orderBy(F.xxhash64("fp", "band"), "fp")
    one = F.struct("fp", "n")
    near = met.withColumn("others", F.array(F.first(one).over(w), F.lag(one, 1).over(w), F.lag(one, 2).over(w))).select("fp", "n", F.explode("others").alias("other"))
    near = near.filter("fp <> other.fp").filter(F.least("n", "other.n") >= F.lit(least) * F.greatest("n", "other.n"))
    pairs = cut(near.select(F.least("fp", "other.fp").alias("u"), F.greatest("fp", "other.fp").alias("v")).distinct())
    found = _verified(pairs, of, least)
    edges = cut(found if same is None else found.union(same))
    roots = cut(components(edges))
    crowd = cut(_crowded(met, roots))
    if not crowd.head(1):
        return edges, roots, None
    return edges, roots, cut(_verified(cut(_by_rare(of.select("fp", "shingles").join(crowd, "fp"), least)), of, least))


def links(of: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges (u, v) between sets of Jaccard least or more; of: distinct fp with n, bands and shingles.

    In each bucket of a band, sets are linked to the first and to the two before them, in an order that differs by
    band: all pairs of up to four sets that share a bucket, and for more a number that grows with the sets, not with
    their square. That joins most of a large group. Sets of a larger bucket that do not hang together by then are
    compared by their rare shingles (_by_rare), which finds every pair between groups that is left. Every edge is
    verified.
    """
    edges, _, extra = _grown(of, least)
    return edges if extra is None else edges.union(extra)


def _roots(of: DataFrame, least: float, same: DataFrame) -> DataFrame:
    """(fp, root) of all sets, by links() and same (u, v)."""
    _, roots, extra = _grown(of, least, same)
    told = of.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    if extra is None or not extra.head(1):
        return told
    of_end = lambda e, k: e.join(roots.select(F.col("node").alias(k), F.col("root").alias(k + "r")), k, "left").withColumn(k, F.coalesce(k + "r", k)).drop(k + "r")
    higher = components(of_end(of_end(extra, "u"), "v")).select(F.col("node").alias("root"), F.col("root").alias("top"))  # edges between groups, few
    return told.join(higher, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """Of each group of texts the row with the smallest key (nulls last; then the smallest text hash), as it is.

    A group hangs together by SimHash fingerprints within radius bits (simhash.links) and by verified Jaccard measures
    of least or more over shingles of width words (links). Of rows with the same key and text one stays. A null text is
    like an empty one; texts without words are one group. An empty table stays empty.
    """
    own = marks(key, text)
    rows = cut(sets(docs.select(F.col(text).alias("t"), *[c.alias(k) for k, c in own.items()]), [*own], "t", width))
    of = cut(rows.dropDuplicates(["fp"]).select("fp", "n", "bands", "shingles"))
    alike = cut(rows.select("fp", "sim").distinct())
    balls = cut(alike.join(classes(alike, "sim", radius).withColumnsRenamed({"fp": "sim"}), "sim").select("fp", "root").distinct())
    same = balls.join(balls.groupBy("root").agg(F.min("fp").alias("v")), "root").select(F.col("fp").alias("u"), "v").filter("u <> v")
    return keep_least(docs, own, rows, cut(_roots(of, least, same)))
