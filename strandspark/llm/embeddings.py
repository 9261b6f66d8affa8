"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors with a cosine of at least t are within the chord sqrt(2 - 2 t). The tree has two parts. Its upper levels,
nested nodes with halving radii, are built from a bounded sample and broadcast; every vector goes down from the root,
at each node to the nearest child, and every node's covering radius is measured over all vectors below it. Vectors
then go down once more, to every node whose ball they may have links in: a node, and all below it, is left out if the
vector's distance from its centre less its covering radius is beyond the chord, and so is a lowest node if the
distance of its centre from that of the vector's own less both covering radii is. Each pair of lowest nodes that is
left, large ones parted into blocks, is a task's group; the task builds the lower levels of both and goes down both at
once, pruning by the same bounds. Nodes that lie within the chord altogether are linked without comparing their
vectors; all others are compared in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh, slices
from strandspark.llm.components import components

#: What rounding may add to a distance of unit vectors.
EPS = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * (a @ b.T), 0, None))


def net(points: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, bool]:
    """Numbers of points over radius apart that cover all points within radius; False if most of them did not suffice."""
    centres, open_ = [], np.arange(len(points))
    while len(open_) and len(centres) < most:
        c = open_[0]
        centres.append(c)
        open_ = open_[distances(points[open_], points[c : c + 1])[:, 0] > radius]
        open_ = open_[open_ != c]
    return np.array(centres, np.int64), not len(open_)


class Node:
    """Points of a block below one centre: covering radius, and children with half the nominal radius, unless halving gains nothing."""

    def __init__(self, points: np.ndarray, at: np.ndarray, radius: float, leaf: int = 64, gain: int = 16, floor: float = 1 / 64):
        self.at, self.kids = at, []
        self.centre = points[at].mean(0, keepdims=True)
        norm = np.linalg.norm(self.centre)
        self.centre = self.centre / norm if norm > 1e-6 else points[at[:1]]
        self.radius = float(distances(points[at], self.centre).max()) + EPS
        if len(at) <= leaf:
            return
        while radius > floor:
            radius /= 2
            if radius >= self.radius:
                continue
            centres, whole = net(points[at], radius, max(2, len(at) // gain))
            if not whole:  # hardly two points share a child at this level or below
                return
            if len(centres) > 1:
                nearest = np.argmin(distances(points[at], points[at[centres]]), 1)
                self.kids = [Node(points, at[nearest == k], radius, leaf, gain, floor) for k in range(len(centres))]
                return


def traverse(a: Node, b: Node, p: np.ndarray, q: np.ndarray, chord: float, same: bool, meet) -> None:
    """Calls meet(rows of p, rows of q, sure) for all node pairs that may hold links; sure: that every pair of theirs is one."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        d = float(distances(x.centre, y.centre)[0, 0])
        if d - x.radius - y.radius > chord + EPS:
            continue
        if d + x.radius + y.radius < chord - EPS and not (same and x is y):
            meet(x.at, y.at, True)
        elif not x.kids and not y.kids:
            meet(x.at, y.at, False)
        elif same and x is y:
            stack.extend((x.kids[i], x.kids[j]) for i in range(len(x.kids)) for j in range(i, len(x.kids)))
        elif not y.kids or x.kids and x.radius >= y.radius:
            stack.extend((k, y) for k in x.kids)
        else:
            stack.extend((x, k) for k in y.kids)


def join(p: np.ndarray, q: np.ndarray, n_p: np.ndarray, n_q: np.ndarray, at_least: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of p and q, rows counted by n_p and n_q, and edges (row of p, row of q) that join what links join. same: q is p."""
    chord = float(np.sqrt(2 - 2 * at_least))
    got_p, got_q = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
    root = np.arange(len(p) + (0 if same else len(q)))
    shift = 0 if same else len(p)
    edges: list[tuple[int, int]] = []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tie(i, j):
        x, y = find(i), find(j + shift)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((int(i), int(j)))

    def meet(i, j, sure):
        diagonal = same and len(i) == len(j) and i is j
        if sure:
            got_p[i] += n_q[j].sum()
            (got_p if same else got_q)[j] += n_p[i].sum()
            for y in j:
                tie(i[0], y)
            for x in i[1:]:
                tie(x, j[0])
            return
        for k in range(0, len(i), 1024):
            part = i[k : k + 1024]
            hit = p[part] @ q[j].T >= at_least
            if diagonal:
                hit[np.arange(len(part)), k + np.arange(len(part))] = False
            rows = np.flatnonzero(hit.any(1))
            if not len(rows):
                continue
            got_p[part] += hit @ n_q[j]
            if not diagonal:
                (got_p if same else got_q)[j] += n_p[part] @ hit
            for r in rows:  # of a row's links one for each component is enough
                cols = j[np.flatnonzero(hit[r])]
                own = root[cols + shift]
                _, first = np.unique(own, return_index=True)
                for c in cols[first]:
                    tie(part[r], c)

    top_p = Node(p, np.arange(len(p)), 2.0)
    traverse(top_p, top_p if same else Node(q, np.arange(len(q)), 2.0), p, q, chord, same, meet)
    return got_p, got_q, edges


def upper(points: np.ndarray, want: int, fan: int = 32) -> tuple[np.ndarray, list[list[int]]]:
    """Centres and children of nested nodes, parents before children, until want nodes are lowest ones or the radius is 1/64. A node has fan children at most; what lies beyond their radius goes to the nearest."""
    centres, kids = [points[0]], [[]]
    level, radius, lowest = [(0, np.arange(len(points)))], 2.0, 1
    while lowest < want and radius > 1 / 64:
        radius /= 2
        below = []
        for node, at in level:
            c, _ = net(points[at], radius, min(fan, want - lowest + 1)) if lowest < want else (np.empty(0, np.int64), True)
            if len(c) < 2:
                below.append((node, at))
                continue
            nearest = np.argmin(distances(points[at], points[at[c]]), 1)
            for k in range(len(c)):
                below.append((len(centres), at[nearest == k]))
                kids[node].append(len(centres))
                centres.append(points[at[c[k]]])
                kids.append([])
            lowest += len(c) - 1
        level = below
    return np.array(centres), kids


def _unit(column) -> np.ndarray:
    return unit(np.stack(column.to_numpy(zero_copy_only=False)))


def _assign(keep: list[str], vec: str, tree):
    """keep with the lowest node of each vector, and the nodes on its way with its distances from their centres."""

    def run(batches):
        centres, kids = tree.value
        for b in slices(batches, 1024):
            v = _unit(b.column(vec))
            below = {0: np.arange(len(v))}
            leaf = np.zeros(len(v), np.int32)
            who, node, d = [below[0]], [leaf.copy()], [distances(v, centres[:1])[:, 0]]
            for k, own in enumerate(kids):
                rows = below.pop(k, ())
                if not own or not len(rows):
                    continue
                apart = distances(v[rows], centres[own])
                nearest = apart.argmin(1)
                leaf[rows] = np.array(own, np.int32)[nearest]
                below |= {x: rows[nearest == i] for i, x in enumerate(own)}
                who, node, d = [*who, rows], [*node, leaf[rows]], [*d, apart[np.arange(len(rows)), nearest]]
            who, node, d = np.concatenate(who), np.concatenate(node), np.concatenate(d)
            order = np.argsort(who, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(v)))]).astype(np.int32))
            way = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (node, d)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(leaf), *way], [*keep, "leaf", "nodes", "d"])

    return run


def _send(tree, radii: list[float], blocks: list[int], chord: float):
    """Each vector once for every group of two blocks that it may have links in."""

    def run(batches):
        (c, kids), r, nb = tree.value, np.array(radii), np.array(blocks)
        base = np.concatenate([[0], np.cumsum(nb)])
        lowest = np.array([k for k, own in enumerate(kids) if not own])
        near = np.zeros((len(kids), len(kids)), bool)
        near[np.ix_(lowest, lowest)] = distances(c[lowest], c[lowest]) - r[lowest][:, None] - r[lowest][None] <= chord + EPS
        for b in slices(batches, 256):
            v = _unit(b.column("v"))
            leaf, h = b.column("leaf").to_numpy(), b.column("h").to_numpy()
            below, who, to = {0: np.arange(len(v))}, [], []
            for k, own in enumerate(kids):
                rows = below.pop(k, np.empty(0, np.int64))
                if not own:
                    rows = rows[near[leaf[rows], k] | (leaf[rows] == k)]
                    who.append(rows)
                    to.append(np.full(len(rows), k))
                elif len(rows):
                    may = (distances(v[rows], c[own]) - r[own][None] <= chord + EPS).T
                    below |= {x: rows[m] for x, m in zip(own, may, strict=True)}
            who, to = np.concatenate(who), np.concatenate(to)
            order = np.lexsort((to, who))
            who, to = who[order], to[order]
            n = nb[to]
            block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            who, to = np.repeat(who, n), np.repeat(to, n)
            own = base[leaf[who]] + h[who] % nb[leaf[who]]
            other = base[to] + block
            picked = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own > other), picked.column("rep"), picked.column("n"), picked.column("v")], ["lo", "hi", "side", "rep", "n", "v"]
            )

    return run


LINKS = "u long, v long, n long"


def _group(at_least: float):
    def run(key, table):
        side = table.column("side").to_numpy()
        same = key[0].as_py() == key[1].as_py()
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((rep, side))
        left, right = order[~side[order]], order[side[order]]
        empty = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(left) or not same and not len(right):
            return empty
        v = _unit(table.column("v").combine_chunks())
        p, q = (left, left) if same else (left, right)
        got_p, got_q, edges = join(v[p], v[q], n[p], n[q], at_least, same)
        u, w, c = [rep[p][got_p > 0]], [rep[p][got_p > 0]], [got_p[got_p > 0]]
        if not same:
            u, w, c = [*u, rep[q][got_q > 0]], [*w, rep[q][got_q > 0]], [*c, got_q[got_q > 0]]
        e = np.array(edges, np.int64).reshape(-1, 2)
        u, w, c = [*u, rep[p[e[:, 0]]]], [*w, rep[q[e[:, 1]]]], [*c, np.zeros(len(e), np.int64)]
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(w), "n": np.concatenate(c)})

    return run


def links(reps: DataFrame, at_least: float = 0.9, leaf: int = 2048, most_leaves: int = 1024, sample: int = 4096) -> DataFrame:
    """Rows (u, u, n): rep u has n links, and (u, v, 0): u and v are linked, which join all that links join.

    reps: distinct vectors (rep, n, v), v finite and not zero, all of one length, n the number of their copies. sample
    vectors and most_leaves nodes, both bounds whatever the data, pass through the driver.
    """
    spark = reps.sparkSession
    total = reps.count()
    if not total:
        return spark.createDataFrame([], LINKS)
    drawn = reps.select("rep", "v", F.xxhash64("rep", F.lit(5)).alias("h")).orderBy("h", "rep").limit(sample).toArrow()
    centres, kids = upper(_unit(drawn.column("v").combine_chunks()), min(most_leaves, -(-total // leaf)))
    sent = spark.sparkContext.broadcast((centres, kids))  # at most sample vectors
    kind = reps.schema["v"].dataType.simpleString()
    keep = ["rep", "n", "v", "h"]
    rows = cut(reps.withColumn("h", F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(1 << 31))).mapInArrow(_assign(keep, "v", sent), f"rep long, n long, v {kind}, h long, leaf int, nodes array<int>, d array<double>"))
    sizes, radii = [0] * len(kids), [-np.inf] * len(kids)
    for r in rows.select(F.explode(F.arrays_zip("nodes", "d")).alias("x")).groupBy("x.nodes").agg(F.count("*").alias("n"), F.max("x.d").alias("d")).collect():
        sizes[r["nodes"]], radii[r["nodes"]] = r["n"], r["d"] + EPS
    blocks = [0 if own else max(1, -(-n // leaf)) for own, n in zip(kids, sizes, strict=True)]
    dealt = rows.select(*keep, "leaf").mapInArrow(_send(sent, radii, blocks, float(np.sqrt(2 - 2 * at_least))), f"lo long, hi long, side boolean, rep long, n long, v {kind}")
    return dealt.groupBy("lo", "hi").applyInArrow(_group(at_least), LINKS)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", at_least: float = 0.9, leaf: int = 2048, **how) -> DataFrame:
    """(key, n_links, component_id, kept) of each row: other rows linked to it, the smallest key reachable, and whether that is its own.

    Vectors that are null or zero, or have null or non-finite components, link with nothing. Vectors of another length
    link within their own length only. Equal vectors are reduced to one before any link is sought, so
    thousands of copies cost what one does. A null key has no name to reach: such a row is in no component and gets a null. Rows that repeat count as
    others of the same key. An empty table stays empty. Keys are integers. Other columns are ignored.
    """
    v = F.col("v")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    marked = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).withColumn("ok", F.coalesce(sound, F.lit(False)))
    same = [F.xxhash64("v"), F.xxhash64("v", F.lit(3))]  # 128 bits stand for a vector
    marked = marked.withColumn("v", F.when(F.col("ok"), v)).withColumns({"a": F.when(F.col("ok"), same[0]), "b": F.when(F.col("ok"), same[1])})
    good = marked.filter("ok and k is not null")
    reps = cut(good.groupBy("a", "b").agg(F.min("k").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    lengths = reps.groupBy(F.size("v").alias("d")).count()
    few = lengths.filter(F.col("count") <= leaf).select("d")  # all vectors of such a length are one task's group, whatever the number of lengths
    found = reps.join(few, F.size("v") == F.col("d"), "left_semi").select(F.size("v").cast("long").alias("lo"), F.size("v").cast("long").alias("hi"), F.lit(False).alias("side"), "rep", "n", "v").groupBy("lo", "hi").applyInArrow(_group(at_least), LINKS)
    for r in lengths.filter(F.col("count") > leaf).orderBy("d").collect():  # at most one for each leaf vectors; embeddings of a table have one length, or a few
        found = found.unionByName(links(reps.filter(F.size("v") == r["d"]).select("rep", "n", "v"), at_least, leaf, **how))
    found = cut(found)
    n = found.filter("n > 0").groupBy("u").agg(F.sum("n").alias("others")).withColumnRenamed("u", "rep")
    roots = components(found.filter("n = 0").select("u", "v")).withColumnsRenamed({"node": "rep", "root": "component_id"})
    told = cut(reps.select("a", "b", "rep", "n").join(n, "rep", "left").join(roots, "rep", "left").select("a", "b", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    out = marked.select("k", F.when(F.isnotnull("k"), F.col("a")).alias("a"), "b").join(told, ["a", "b"], "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(False)).alias("kept"))


def keep_one(rows: DataFrame, key: str = "vec_id", **how) -> DataFrame:
    """The rows that are kept, as they are; rows with a null key stay."""
    [name] = fresh(rows, "_kept")
    kept = near_duplicates(rows, key, **how).filter("kept").select(F.col(key).alias(name)).distinct()
    return rows.join(kept, rows[key] == kept[name], "left").filter(F.isnotnull(name) | F.isnull(key)).select(*[rows[c] for c in rows.columns])
