"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import fresh, slices

#: Bytes as they are read: A-Z lower-cased, other ASCII than letters and digits to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BITS = 20
STEM = 5


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashes of the whole text's words, their first letters (STEM bytes), pairs of words and pairs with one word between; each once."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not ws:
        return np.empty(0, np.int64)
    crc = zlib.crc32
    w = np.array([crc(x) for x in ws], np.uint64)
    stems = np.array([crc(x[:STEM], 1) for x in ws], np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    pair = lambda a, b, salt: (a * np.uint64(0xC2B2AE3D27D4EB4F) + b + np.uint64(salt)) * odd
    with np.errstate(over="ignore"):
        h = np.concatenate([w * odd, stems * odd, pair(w[:-1], w[1:], 1), pair(w[:-2], w[2:], 2)])
    return np.unique(h >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate rates and L1 sparsity; the last coordinate is the bias, which is not shrunk. alpha and l1 had the least logarithmic loss of some twenty settings on a fifth of the rows to learn from, the held-out fold aside."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _w(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _bias(self) -> float:
        return -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)

    def learn(self, x: np.ndarray, y: float) -> None:
        w, bias = self._w(self.z[x], self.n[x]), self._bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[x] += g * g
        self.z[-1] += g - (np.sqrt(self.n[-1] + g * g) - np.sqrt(self.n[-1])) / self.alpha * bias
        self.n[-1] += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates with a weight, and their weights; the bias is the last."""
        w = np.append(self._w(self.z[:-1], self.n[:-1]), self._bias())
        at = np.flatnonzero(w)
        return at, w[at]


def score(text: str | None, dense: np.ndarray) -> float:
    s = dense[features(text)].sum(dtype=np.float64) + dense[-1]
    return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def learnable(labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, y) of the labelled keys outside the held-out fold; a key with several labels counts as toxic if one of them says so."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), folds, held))
    return known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0)).alias("y"))


def held_out(key: Column, folds: int = 5, held: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000, epochs: int = 3, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights, learned from a bounded sample of the labelled rows outside the held-out fold.

    fit_rows bounds the sample, which is drawn by the keys' hash; all are taken where there are no more. The drawn keys
    are broadcast, so that no text is shuffled. Features are made on the executors; fit_rows lists of hashes come to
    the driver, which learns from them row by row, each epoch in another order. L1 leaves at most the coordinates that
    occur in the sample, 2 ** bits however large the corpus is. Rows with the same key and text count once.
    Without rows every score is 0.5; with labels of one kind only the bias says which.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    drawn = learnable(labels).orderBy(h, "doc_id").limit(fit_rows)

    def run(batches):
        for b in slices(batches):
            xs = [features(t, bits).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), b.column("y"), b.column("doc_id")], ["x", "y", "k"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y").mapInArrow(run, f"x binary, y double, k {kind}")
    got = rows.groupBy("k", "y", F.xxhash64("x").alias("h")).agg(F.first("x").alias("x")).orderBy(F.xxhash64("k", F.lit(seed)), "k", "h").limit(fit_rows).select("x", "y", "k").toArrow()
    if not got.num_rows:
        return np.array([1 << bits]), np.array([0.0])
    order = pc.sort_indices(got.select(["k", "y", "x"]), sort_keys=[("k", "ascending"), ("y", "ascending"), ("x", "ascending")]).to_numpy()
    xs, ys = got.column("x").combine_chunks(), got.column("y").to_numpy()
    starts, flat = np.frombuffer(xs.buffers()[1], "<i4")[xs.offset : xs.offset + len(xs) + 1] // 4, np.frombuffer(xs.buffers()[2] or b"", "<u4")
    model, rng = Ftrl(bits), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order[rng.permutation(len(order))]:
            model.learn(flat[starts[k] : starts[k + 1]], ys[k])
    return model.weights()


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], name: str = "score", text: str = "text", bits: int = BITS) -> DataFrame:
    """keep with each whole text's score, 0 to 1; a null or empty text has the bias' score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits + 1 weights

    def run(batches):
        dense = np.zeros((1 << bits) + 1)
        at, w = sent.value
        dense[at] = w
        for b in slices(batches):
            s = [score(t, dense) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))


def predict(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from its whole text alone.

    Null or empty texts get the bias' score, repeated rows a row each, null keys are never learned from. An empty
    table stays empty; without labels every score is 0.5 and predicted 1, as the rule for ties says.
    """
    got = scores(docs, fit(docs, labels, **how), ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not rejected, as they are; without a label nothing is."""
    if not labels.filter("toxic > 0").head(1):
        return docs
    [s] = fresh(docs, "_score")
    return scores(docs, fit(docs, labels, **how), docs.columns, s).filter(F.col(s) < 0.5).select(*docs.columns)
