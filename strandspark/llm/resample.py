"""Target-distribution importance resampling over hashed word runs.

A run of words is never built as a string. Each distinct word of a piece has its CRC-32 computed once; the CRC of a
longer run follows from the algebra of the checksum: appending n bytes multiplies the register by the n-th power of a
matrix over GF(2), so crc(a + b) = shift(crc(a), len(b)) ^ crc(b). One matrix for each length of a word serves all runs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import by_bytes, cut, fresh, literal_table

#: Text that is taken apart at once, in bytes. A longer text is read in pieces that share their last words.
PIECE = 1 << 20
#: Word bytes as they are, A-Z as a-z, all others as blanks.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product over GF(2) of a matrix, as its 32 columns, with each register."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _byte_matrix() -> np.ndarray:
    """What one zero byte does to each bit of a register."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


@lru_cache(1 << 12)
def shift_tables(n: int) -> np.ndarray:
    """The n-th power of the byte matrix by squaring, as four tables of 256 registers, one for each byte."""
    power, out = _byte_matrix(), np.uint32(1) << np.arange(32, dtype=np.uint32)
    while n:
        if n & 1:
            out = _apply(power, out)
        power, n = _apply(power, power), n >> 1
    return np.stack([_apply(out, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register moved on by its own number of bytes."""
    if not len(crc):
        return crc
    known, which = np.unique(lengths, return_inverse=True)
    t = np.stack([shift_tables(int(n)) for n in known])
    return t[which, 0, crc & 255] ^ t[which, 1, crc >> 8 & 255] ^ t[which, 2, crc >> 16 & 255] ^ t[which, 3, crc >> 24]


SPACE = zlib.crc32(b" ")


def run_crcs(words: list[bytes], first: np.ndarray, most: int) -> list[np.ndarray]:
    """For each k below most, the CRC of the k + 1 words that end at each place, joined by blanks. Where that run would begin before its text (first: where each word's text begins) the number means nothing."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    crc, size = (np.array([f(w) for w in kinds], t)[at] if kinds else np.empty(0, t) for f, t in ((zlib.crc32, np.uint32), (len, np.int64)))
    out = [crc]
    for _ in range(1, most):
        ahead = np.concatenate([out[-1][:1], out[-1][:-1]])
        out.append(shift(shift(ahead, np.ones(len(ahead), np.int64)) ^ np.uint32(SPACE), size) ^ crc)
    return out


def _pieces(text: bytes, most: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in pieces, each with how many of its first words belong to the piece before."""
    data, k, before = text.translate(TO_WORDS), 0, []
    while k < len(data):
        to = len(data)
        if to - k > PIECE and (to := data.rfind(b" ", k, k + PIECE)) <= k:  # within a very long word
            to = data.find(b" ", k + PIECE)
            to = len(data) if to < 0 else to
        words = data[k:to].split()
        yield before + words, len(before)
        before = (before + words)[1 - most :] if most > 1 else []
        k = to


def features(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, CRC) of all runs of 1 to most words of all texts, in pieces of bounded size."""
    words, text, counted, first, size = [], [], [], [], 0

    def flush():
        t, c, f = np.repeat(*np.array(text or [(0, 0)]).T), np.concatenate([np.arange(n) >= b for n, b in counted] or [np.empty(0, bool)]), np.repeat(*np.array(first or [(0, 0)]).T)
        place = np.arange(len(words))
        for k, crc in enumerate(run_crcs(words, f, most)):
            own = c & (place - k >= f)
            yield t[own], crc[own]

    for n, b in enumerate(texts):
        for ws, before in _pieces(b, most):
            if not ws:
                continue
            text.append((n, len(ws)))
            first.append((len(words), len(ws)))
            counted.append((len(ws), before))
            words += ws
            size += len(b) if len(b) < PIECE else PIECE
            if size >= PIECE:
                yield from flush()
                words, text, counted, first, size = [], [], [], [], 0
    if words:
        yield from flush()


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", most: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many runs of 1 to most words of all texts fall into each bucket, 0 not listed. Each task adds up its own counts first, so that buckets rows a task are shuffled at most."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in (x for y in batches for x in by_bytes([y], "t", PIECE)):
            for _, crc in features(_texts(b, "t"), most):
                n += np.bincount(crc % buckets, minlength=buckets)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own])], ["bucket", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """1000 times the log ratio of the target's to the source's smoothed share of each bucket, rounded down. The driver holds two numbers a bucket, whatever the data."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = 2) -> DataFrame:
    """docs with n_words, n_features and weight (the mean gain of a text's runs rounded down, 0 without any) in place of text; columns of these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "n_words", "n_features", "weight")]
    (t,) = fresh(docs, "_text")

    def run(batches):
        for b in (x for y in batches for x in by_bytes([y], t, PIECE)):
            total, n, words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k, (at, crc) in enumerate(features(_texts(b, t), most)):
                np.add.at(total, at, gain[crc % len(gain)])
                own = np.bincount(at, minlength=b.num_rows)
                n += own
                if k % most == 0:
                    words += own
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], [*keep, "n_words", "n_features", "weight"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, F.col(text).alias(t)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, n_features long, weight long"]))


def noise(key: Column, seed: int) -> Column:
    """1000 times a Gumbel variate of the key's hash, rounded down. A null key is hashed as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int, key: str = "doc_id", seed: int = 7, least_words: int = 20) -> DataFrame:
    """weighed with score and rank: 1, 2, 3, ... for the percent of rows with least_words words or more that score highest, null for the others.

    Weight plus Gumbel noise, highest first, is sampling without replacement by exp(weight / 1000). Rows are sorted by
    ranges of (score, key), and a row's rank is its place in its range plus the sizes of those before: no window, no
    row is counted in one task, and repeated keys are parted by the number of their row. Ties go to smaller keys,
    nulls last.
    """
    spark = weighed.sparkSession
    weighed = weighed.drop("score", "rank")
    columns = weighed.columns
    row, part, place, before = fresh(weighed, "_row", "_part", "_place", "_before")
    rows = cut(weighed.withColumns({"score": F.col("weight") + noise(F.col(key), seed), row: F.monotonically_increasing_id()}))
    held = rows.filter(F.col("n_words") >= least_words)
    count = held.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc(row)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition's number, then the row's place in it
    ranged = cut(held.select(key, "score", row).repartitionByRange(n, *order).sortWithinPartitions(*order).select(row, F.shiftright(at, 33).alias(part), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).agg(F.count("*")).collect())  # one row a range
    starts = [(p, sum(s for q, s in sizes if q < p)) for p, _ in sizes]
    ranks = ranged.join(F.broadcast(literal_table(spark, starts, f"{part} long, {before} long")), part).select(row, (F.col(before) + F.col(place) + 1).alias("rank")).filter(F.col("rank") <= count)
    return rows.join(ranks, row, "left").select(*columns, "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, key: str = "doc_id", text: str = "text", most: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20) -> DataFrame:
    """docs without text, with n_words, n_features, weight, score and rank: which documents to take so that their runs of words are spread as those of target's texts.

    A null or empty text has no words, weighs 0 and is never drawn, and neither is one of fewer than least_words. Rows
    with the same key have the same noise and are ranked one after another. An empty target or an empty docs leaves
    the smoothed shares alone; no rows give none. Other columns stay, whatever their names.
    """
    own = docs.drop("n_words", "n_features", "weight", "score", "rank")
    gain = gains(bucket_counts(own, text, most, buckets), bucket_counts(target, "text", most, buckets), buckets)
    return draw(weigh(own, gain, text, most), percent, key, seed, least_words)
