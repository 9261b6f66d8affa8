"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """per_source (source, source_size) with target: shares of the sum of all sizes by weight, none above cap times its source's size, the excess reshared by weight.

    Sources are ordered by code point, null last, and weigh as weights says, over and over. The level at which
    shares stop is found in one pass over the sources ordered by cap * size / weight: below the level a source is full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    t = per_source.select("source", "source_size", weight.alias("w")).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("full") / F.col("w"), "source")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("full") / F.col("w"), F.col("level"))).over(every)
    return t.withColumn("level", level).select("source", "source_size", F.least("full", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column, weights=(1, 2, 3), cap: float = 3.0, key: str = "doc_id", source: str = "source", cell_rows: int = 4_000_000, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row); a column of docs with such a name is replaced.

    Within a source every row expects target / source_size copies. The running sum of that expectation, shifted by one
    random offset of the source, passes whole numbers; a row is taken once for each one passed within it. Rows run in
    order of about their size, so that the taken sizes follow the target too: the sum is off by about one row.

    The running sum is dealt by (source, size class, hash cell), with a cell for every cell_rows rows of the table: a
    cell's start is the number of rows in the cells before it, so no window holds a whole source, and a source with a
    third of all rows fills as many cells as others do. Cells come from the hash of all columns, so that rows with a
    null key or the same key are dealt too.

    Nulls: a null source is a source of its own, a null size counts 0, null keys are keys. An empty table stays empty.
    Equal rows are counted singly. Sources whose sizes are all 0 have target 0 and are not taken.
    """
    cells = max(32, -(-docs.count() // cell_rows))
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "copies") if c not in (key, source)])
    sk, sn, cls, cell, at, off, h = fresh(docs, "_s", "_null", "_class", "_cell", "_at", "_off", "_h")
    dealt = [sk, sn, cls, cell]
    rows = docs.withColumn("size", F.coalesce(size, F.lit(0)).cast("long")).withColumns({
        sk: F.coalesce(F.col(source), F.lit("")), sn: F.isnull(source), cls: F.floor(8 * F.log2(F.col("size") + 1)).cast("int"), h: F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind], F.lit(seed)),
    }).withColumn(cell, F.pmod(F.col(h), F.lit(cells)).cast("int"))
    stats = cut(rows.groupBy(*dealt).agg(F.count("*").alias(at), F.sum("size").alias("size")))
    goal = targets(stats.groupBy(F.when(~F.col(sn), F.col(sk)).alias("source")).agg(F.sum("size").alias("source_size")), weights, cap)
    goal = goal.select(F.coalesce("source", F.lit("")).alias(sk), F.isnull("source").alias(sn), "source_size", "target")
    starts = stats.select(*dealt, F.coalesce(F.sum(at).over(Window.partitionBy(sk, sn).orderBy(cls, cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off))
    starts = starts.join(goal, [sk, sn])
    k = F.col(off) + F.row_number().over(Window.partitionBy(*dealt).orderBy("size", h, key))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = F.pmod(F.xxhash64(F.col(sk), F.col(sn), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    taken = rows.join(starts, dealt).withColumn(at, k)
    copies = F.floor(F.col(at) * rate + u) - F.floor((F.col(at) - 1) * rate + u)
    return taken.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1)))).cast("long")).select(*docs.columns, "size", "source_size", "target", "copies")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of mix() as often as it is taken."""
    [n] = fresh(mixed, "_n")
    return mixed.filter("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
