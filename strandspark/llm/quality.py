"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters: texts of any language, with words that no one has seen, are made of n-grams that were
seen, and what a task reads has few distinct ones. Counts, continuation counts, discounts and interpolated
probabilities are DataFrames, sharded by n-gram. Documents are scored by joins with them: every task asks for the
n-grams of its piece of the corpus once, the answers go back to the piece, and so a document's n-grams are never
shuffled one by one. A document whose perplexity is above its language's quantile among trusted documents is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import bounded, by_bytes, cut

START, END = "\x02", "\x03"
SPACES, DIGITS = re.compile(r"[\s\x02\x03\x00]+"), re.compile(r"[1-9]")
#: Bytes of text that are compressed together.
BLOCK = 4 << 20
#: Characters read at once, so that a very long text takes no more memory than this.
PIECE = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, white space as one blank, digits as 0."""
    return DIGITS.sub("0", SPACES.sub(" ", text or "").strip().lower())


def windows(text: str, n: int) -> list[np.ndarray]:
    """Code points of the n characters up to each character and to the text's end, in pieces; the start is padded. Empty for a text without characters."""
    if not text:
        return []
    points = np.frombuffer((START * (n - 1) + text + END).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.lib.stride_tricks.sliding_window_view(points, n)
    return [rows[k : k + PIECE] for k in range(0, len(rows), PIECE)]


def hashed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of code points."""
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Seen:
    """Distinct n-grams with how often trusted texts hold them, as a task meets them."""

    def __init__(self, n: int):
        self.n = n
        self.keys, self.rows, self.counts = np.empty(0, np.int64), np.empty((0, n), np.uint32), np.empty(0, np.int64)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, rows: np.ndarray, weight: int) -> None:
        h, first, c = np.unique(hashed(rows), return_index=True, return_counts=True)
        self.held.append((h, rows[first], c * weight))
        self.size += len(h)
        if self.size > PIECE:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.rows, self.counts), *self.held]
        h = np.concatenate([p[0] for p in parts])
        c = np.concatenate([p[2] for p in parts])
        self.keys, first, where = np.unique(h, return_index=True, return_inverse=True)
        self.rows = np.concatenate([p[1] for p in parts])[first]
        self.counts = np.bincount(where, c, len(self.keys)).astype(np.int64)
        self.held, self.size = [], 0

    def grams(self) -> list[str]:
        flat = np.ascontiguousarray(self.rows, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [flat[k : k + self.n] for k in range(0, len(flat), self.n)]


READ = "piece long, row long, packed binary, gram string, c long"


def _read(keep: list[str], n: int, piece_chars: int):
    """Rows of three kinds: documents with their numbers; a piece's texts, some hundred in one compressed block with the number of the first; and the piece's n-grams with their counts in trusted texts."""

    def run(batches):
        from pyspark import TaskContext

        base, piece, chars, at, seen = TaskContext.get().partitionId() << 32, 0, 0, 0, Seen(n)
        fields, shrink = None, zstandard.ZstdCompressor(level=9)

        def rows(k, own=None, **cols):
            kinds = {"piece": pa.int64(), "row": pa.int64(), "packed": pa.binary(), "gram": pa.string(), "c": pa.int64()}
            kept = own or [pa.nulls(k, f) for f in fields]
            cols |= {"piece": np.full(k, base + piece)}
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(cols[c], f) if c in cols else pa.nulls(k, f) for c, f in kinds.items())], [*keep, *kinds])

        def grams():
            seen.merge()
            return rows(len(seen.keys), gram=seen.grams(), c=seen.counts)

        for b in by_bytes(batches, "_text", BLOCK):
            fields = [b.schema.field(c).type for c in keep]
            texts = [normal(t) for t in b.column("_text").to_pylist()]
            for text, trusted in zip(texts, b.column("_trusted").to_pylist(), strict=True):
                for part in windows(text, n):
                    seen.add(part, int(trusted))
                chars += len(text)
            yield rows(b.num_rows, [b.column(c) for c in keep], row=base + at + np.arange(b.num_rows))
            yield rows(1, row=[base + at], packed=[shrink.compress("\x00".join(texts).encode("utf-8", "surrogatepass"))])
            at += b.num_rows
            if chars >= piece_chars:
                yield grams()
                piece, chars, seen = piece + 1, 0, Seen(n)
        if chars:
            yield grams()

    return run


def model(counts: DataFrame, n: int) -> tuple[list[DataFrame], float]:
    """For each order 1 to n (gram, p: interpolated probability of the last character, after the others) and, where the order is below n, (ctx, back: weight of what is below the order after the gram); and the probability of a character that was never seen.

    counts: (gram of n characters, c) of trusted text. Lower orders count in how many ways a gram is continued to
    the left; the discounts of counts 1, 2 and more come from the numbers of grams with counts 1 to 4, and are 0.1 at least, so that no
    probability is 0.
    """
    order: dict[int, DataFrame] = {n: counts}
    for k in range(n - 1, 0, -1):
        ways = order[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("ways"), F.sum("c").alias("c"))
        order[k] = ways.select("gram", F.when(F.col("gram").startswith(START), F.col("c")).otherwise(F.col("ways")).alias("c"))  # nothing stands left of a start
    letters = order[1].count()
    unseen = 1.0 / (letters + 1)
    probs: list[DataFrame] = []
    for k in range(1, n + 1):
        now = cut(order[k])
        of = {r["c"]: r["n"] for r in now.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.1), float(i)) if a and b else min(0.5 * i, 1.0) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        ctx = F.expr(f"substring(gram, 1, {k - 1})")
        sums = now.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("all"), (F.sum(less) / F.sum("c")).alias("back"))
        if k == 1:
            one = sums.first()
            probs.append(cut(now.select("gram", (F.greatest(F.col("c") - less, F.lit(0.0)) / one["all"] + one["back"] * unseen).alias("p"))))
            least = one["back"] * unseen
            continue
        below = probs[-1].select(F.col("gram").alias("rest"), F.col("p").alias("lower"))
        own = now.withColumns({"ctx": ctx, "rest": F.expr(f"substring(gram, 2, {k - 1})")}).join(sums, "ctx").join(below, "rest")
        probs.append(cut(own.select("gram", "ctx", (F.greatest(F.col("c") - less, F.lit(0.0)) / F.col("all") + F.col("back") * F.col("lower")).alias("p"), "back")))
    return probs, least


def answers(grams: DataFrame, probs: list[DataFrame], least: float, n: int) -> DataFrame:
    """(gram, s: logarithm of the last character's probability) of distinct grams: the highest order that was seen, times the weights of the contexts above it that were."""
    found = grams.withColumns({"p": F.lit(None).cast("double"), "w": F.lit(1.0)})
    for k in range(n, 0, -1):
        own = probs[k - 1].select(F.col("gram").alias("_g"), F.col("p").alias("_p"))
        found = found.withColumn("_g", F.expr(f"substring(gram, {n - k + 1}, {k})")).join(own, "_g", "left").drop("_g")
        found = found.withColumn("p", F.coalesce("p", F.col("_p") * F.col("w"))).drop("_p")
        if k > 1:
            back = probs[k - 1].groupBy(F.col("ctx").alias("_c")).agg(F.max("back").alias("_b"))
            found = found.withColumn("_c", F.expr(f"substring(gram, {n - k + 1}, {k - 1})")).join(back, "_c", "left").drop("_c")
            found = found.withColumn("w", F.when(F.isnotnull("p"), F.col("w")).otherwise(F.col("w") * F.coalesce("_b", F.lit(1.0)))).drop("_b")
    return found.select("gram", F.log(F.coalesce("p", F.col("w") * F.lit(least))).alias("s"))


def _score(n: int):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        letters = "".join(told.column("gram").to_pylist()).encode("utf-32-le")
        h, s = hashed(np.frombuffer(letters, "<u4").reshape(-1, n)), told.column("s").to_numpy()
        order = np.argsort(h)
        h, s = h[order], s[order]
        row, size, total = [], [], []
        for first, packed in zip(texts.column("row").to_pylist(), texts.column("packed"), strict=True):
            block = zstandard.ZstdDecompressor().decompress(packed.as_buffer()).decode("utf-8", "surrogatepass")
            for k, text in enumerate(block.split("\x00")):
                m, t = 0, 0.0
                for rows in windows(text, n):
                    t += float(s[np.searchsorted(h, hashed(rows))].sum())
                    m += len(rows)
                row.append(first + k)
                size.append(m)
                total.append(t)
        return pa.table([pa.array(row, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.float64())], names=["row", "m", "t"])

    return run


def perplexities(docs: DataFrame, trusted: Column, keep: list[str], text: str = "text", n: int = 4, piece_chars: int = 64_000_000) -> DataFrame:
    """keep with trusted (boolean) and perplexity (null for texts without characters) of each row, by a model of all trusted rows' texts.

    A piece of piece_chars characters bounds what a task holds: its texts, compressed, and its distinct n-grams.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [f"k{i}" for i in range(len(keep))] + ["_trusted"]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=False)], F.coalesce(trusted, F.lit(False)).alias("_trusted"), F.col(text).alias("_text"))
    ddl = ", ".join([*(f"`{a}` {kinds[c]}" for c, a in zip(keep, names, strict=False)), "_trusted boolean"])
    read = cut(rows.mapInArrow(_read(names, n, piece_chars), f"{ddl}, {READ}"))
    asked = read.filter("gram is not null").select("piece", "gram", "c")
    every = cut(asked.groupBy("gram").agg(F.sum("c").alias("c")))
    seen = every.filter("c > 0")
    own = read.filter("_trusted is not null").select(*names, "row")
    if seen.head(1):
        probs, least = model(seen.select("gram", "c"), n)
        said = answers(every.select("gram"), probs, least, n)  # as many rows as distinct n-grams, very many for a whole web: always joined by a shuffle
        told = asked.select("piece", "gram").join(said, "gram").select(F.col("piece").alias("of"), "gram", "s")
        texts = read.filter("packed is not null").select("piece", "row", "packed")
        scored = texts.groupBy("piece").cogroup(told.groupBy("of")).applyInArrow(_score(n), "row long, m long, t double")
        own = own.join(scored, "row").withColumn("perplexity", F.when(F.col("m") > 0, F.exp(-F.col("t") / F.col("m"))))
    else:
        own = own.withColumn("perplexity", F.lit(None).cast("double"))
    return own.select(*[F.col(a).alias(c) for a, c in zip(names, keep, strict=False)], F.col("_trusted").alias("trusted"), "perplexity")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05, n: int = 4, lang: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of each row.

    Trusted are rows whose key has a label of quality 1 and none of another. Four fifths of them, by their keys' hash,
    make the model; thresholds come from the others, which it has not seen. A language's threshold is slack times the quantile of its
    trusted documents' perplexities; a language without any takes that of all trusted documents. Without trusted text
    there are no perplexities and everything is kept.

    Null keys are not trusted, a null language is one of its own, null and empty texts are rejected where there is a threshold, as
    they hold nothing to keep. Repeated rows get a row each. An empty table stays empty. Other columns are ignored.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg((F.min(F.coalesce(F.col("quality"), F.lit(0))) > 0).alias("_good")).filter("_good").select(F.col("doc_id").alias("_id"))
    marked = docs.select("doc_id", F.col(lang).alias("lang"), "text")
    few = bounded(cut(good.select("_id")), 16)
    tagged = marked.join(few, F.col("doc_id") == F.col("_id"), "left").withColumn("_good", F.isnotnull("_id"))
    learned = F.col("_good") & (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(5)) > 0)
    scored = cut(perplexities(tagged, learned, ["doc_id", "lang", "_good"], n=n))
    known = scored.filter("_good and not trusted and perplexity is not null")
    known = known if known.head(1) else scored.filter("_good and perplexity is not null")
    by_lang = known.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("own"))
    over = known.agg(F.percentile_approx("perplexity", quantile, 10_000) * slack).first()[0]
    told = by_lang.select(F.col("lang").alias("_l"), "own")
    out = scored.join(F.broadcast(told), F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn("threshold", F.coalesce("own", F.lit(over).cast("double")))
    kept = F.when(F.isnull("threshold"), True).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))

