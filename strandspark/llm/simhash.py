"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh, slices
from strandspark.llm.components import components


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set if it is in over half of the hashes of the text's shingles (A-Z lower-cased, repeats included); no words: 0."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    h = [digest(b" ".join(s), 42) for s in zip(*(ws[k:] for k in range(width)), strict=False)] if len(ws) >= width else [digest(b" ".join(ws), 42)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a very long text is counted in pieces
        part = np.array(h[k : k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], name: str, text: str = "text") -> DataFrame:
    """keep with the texts' fingerprints as signed 64-bit numbers."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` long"]))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join all fingerprints within radius differing bits of each other; fps: distinct fp.

    Each fingerprint emits all variants within half the radius: two that differ in at most radius bits share one.
    Those that share a variant are within the radius of each other by way of it, so linking each to the smallest of
    them joins the same classes as all pairs would, with no more edges than variants. Every edge is verified.
    """
    if radius != 2:
        raise ValueError("the half-radius ball is that of one bit: radius 2")
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(64)])
    balls = fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    met = balls.withColumn("v", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> v")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius).select(F.col("fp").alias("u"), "v").distinct()


def classes(rows: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """(fp, root) for each distinct fingerprint of rows; root: one of its class."""
    fps = cut(rows.select(F.col(fp).alias("fp")).distinct())
    roots = components(links(fps, radius)).withColumnsRenamed({"node": "fp"})
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): component_id is the smallest key that can be reached by links, itself included.

    Texts are reduced to distinct fingerprints before any link is sought, so thousands of copies cost what one costs.
    A null or empty text has fingerprint 0 and is linked like any other. Null keys are ignored among the smallest;
    where a class has no other, its component_id is null. Repeated rows each get a row. An empty table stays empty.
    """
    rows = cut(fingerprints(docs.select(key, text), [key], "fp", text))
    of = cut(classes(rows, radius=radius))
    least = rows.groupBy("fp").agg(F.min(key).alias("least")).join(of, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(of.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def marks(key: str, text: str) -> dict[str, Column]:
    """What tells rows apart and orders them: the key, nulls last, then a hash of the text."""
    return {"_null": F.isnull(key), "_key": F.coalesce(F.col(key), F.lit(0)), "_text": F.xxhash64(text)}


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest key (nulls last; then the smallest text hash), as it is. Of rows with the same key and text one stays."""
    own = marks(key, text)
    rows = cut(fingerprints(docs.select(F.col(text).alias("t"), *[c.alias(k) for k, c in own.items()]), [*own], "fp", "t"))
    return keep_least(docs, own, rows, cut(classes(rows, radius=radius)))


def keep_least(docs: DataFrame, marks: dict[str, Column], rows: DataFrame, of: DataFrame) -> DataFrame:
    """Of each root of (fp, root) the row of docs with the least marks, once; rows: marks and fp."""
    first = rows.groupBy("fp").agg(F.min(F.struct(*marks)).alias("best")).join(of, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.*")
    names = fresh(docs, *marks)
    [n] = fresh(docs, "_n")
    own = docs.withColumns(dict(zip(names, marks.values(), strict=True))).join(first.toDF(*names), names)
    return own.withColumn(n, F.row_number().over(Window.partitionBy(*names).orderBy(names[-1]))).filter(F.col(n) == 1).select(*docs.columns)
