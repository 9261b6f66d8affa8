"""Language identification by language-bitmask n-gram filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import bounded, cut, slices

#: Letters read at once, so that a very long text takes no more memory than this.
PIECE = 1 << 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def letters() -> np.ndarray:
    """For each code point up to 0x2FFFF its lower case, if it is a letter; otherwise a blank."""
    return np.array([ord(c.lower()[0]) if (c := chr(k)).isalpha() else 32 for k in range(0x30000)], np.uint32)


class Grams:
    """Hashes of the n-grams of a text's letters; what stands between words is one blank, and n-grams run over no more than one."""

    def __init__(self, n: int = 4):
        self.n, self.fold = n, letters()

    def of(self, text: str) -> np.ndarray:
        """All n-grams, repeats included, as 32-bit hashes; empty for a text without letters. A long text is read in pieces, each with the last letters of the one before."""
        out = []
        c = np.full(self.n - 1, 32, np.uint64)
        for k in range(0, len(text), PIECE):
            c = np.concatenate([c, self._letters(text[k : k + PIECE])])
            c = c[np.concatenate([np.ones(self.n - 1, bool), (c[self.n - 1 :] != 32) | (c[self.n - 2 : -1] != 32)])]
            out.append(self._hashes(c))
            c = c[len(c) - self.n + 1 :]
        if c[-1] != 32:
            out.append(self._hashes(np.append(c, np.uint64(32))))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        folded = self.fold[np.minimum(points, len(self.fold) - 1)]
        for j in np.flatnonzero(points >= len(self.fold)):  # rare letters beyond the table
            folded[j] = points[j] if chr(points[j]).isalpha() else 32
        return folded.astype(np.uint64)

    def _hashes(self, c: np.ndarray) -> np.ndarray:
        """Of the n-grams that lie within c: none has a blank between letters, and a word of one letter, too short for that, is one n-gram."""
        if len(c) < self.n:
            return np.empty(0, np.uint32)
        size = len(c) - self.n + 1
        h = np.zeros(size, np.uint64)
        inner = np.ones(size, bool)
        with np.errstate(over="ignore"):
            for j in range(self.n):
                h = (h + c[j : j + size]) * ODD[0]
                h ^= h >> np.uint64(29)
                if 0 < j < self.n - 1:
                    inner &= c[j : j + size] != 32
            if self.n > 3:
                at = self.n - 2
                alone = (c[at : at + size] != 32) & (c[at - 1 : at - 1 + size] == 32) & (c[at + 1 : at + 1 + size] == 32)
                inner |= alone
                h = np.where(alone, c[at : at + size] * ODD[1], h)
        return (h[inner] >> np.uint64(32)).astype(np.uint32)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: table[slot] has a bit for each language, and the bits that all of an n-gram's slots share are the languages that contain it."""

    langs: list[str]
    table: np.ndarray
    hashes: int
    rates: np.ndarray  # of each language: how often an n-gram that it does not contain seems to be in it
    n: int

    def slots(self, grams: np.ndarray):
        for k in range(self.hashes):
            with np.errstate(over="ignore"):
                yield ((grams.astype(np.uint64) + np.uint64(k)) * ODD[k] >> np.uint64(64 - int(self.table.shape[0]).bit_length() + 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Languages of each n-gram, as words of 64 bits."""
        out = None
        for at in self.slots(grams):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Of each language the n-grams in it, less those expected by chance."""
        masks, total = self.masks(grams), np.zeros(len(self.langs))
        for k in range(len(self.langs)):
            total[k] = np.count_nonzero(masks[:, k // 64] & np.uint64(1 << k % 64))
        return np.clip((total - len(grams) * self.rates) / (1 - self.rates), 0, None)


def learnable(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(text, lang) of the rows to learn from; rows without a key are not."""
    return docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), folds, held)).select("text", "lang")


def held_out(key: Column, folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == held, F.lit(False))


def counts(rows: DataFrame, n: int = 4) -> DataFrame:
    """(lang, gram, n) over all rows. Each task sums up what it reads before anything is shuffled."""

    def run(batches):
        grams, held, size = Grams(n), {}, 0
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge():
            for lang, parts in held.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                if lang in total:
                    g0, c0 = total[lang]
                    g, where = np.unique(np.concatenate([g0, g]), return_inverse=True)
                    c = np.bincount(where, np.concatenate([c0, c])).astype(np.int64)
                total[lang] = g, c
            held.clear()

        for b in slices(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                g = grams.of(text)
                held.setdefault(lang, []).append(g)
                size += len(g)
            if size > 4 * PIECE:
                merge()
                size = 0
        merge()
        for lang, (g, c) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, n: int = 4, rate: float = 1e-4, slots: int = 1 << 20, hashes: int = 3) -> Filters | None:
    """Filters of the languages of rows (text, lang); None without any n-gram.

    A language contains the n-grams that make up at least rate of its own, whatever other languages do, so there are at
    most 1 / rate a language however large the corpus is, and what its texts quote from others is too rare to count. The
    counts behind it are over all rows.
    """
    c = cut(counts(rows, n))
    totals = c.groupBy("lang").agg(F.sum("n").alias("all"))
    got = c.join(bounded(totals, 64), "lang").filter(F.col("n") >= F.lit(rate) * F.col("all")).select("gram", "lang").toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got.column("lang").to_pylist()))
    out = Filters(langs, np.zeros((slots, -(-len(langs) // 64)), np.uint64), hashes, np.zeros(len(langs)), n)
    gram = got.column("gram").to_numpy().astype(np.uint32)
    of = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    for k in range(len(langs)):
        for at in out.slots(gram[of == k]):
            out.table[at, k // 64] |= np.uint64(1 << k % 64)
        out.rates[k] = np.mean(out.table[:, k // 64] & np.uint64(1 << k % 64) != 0) ** hashes
    return out


ADDED = "lang_pred string, score double, n_grams long"


def predict(docs: DataFrame, filters: Filters | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep with lang_pred, score and n_grams of each whole text.

    The language with most n-grams, corrected for false positives, is predicted, the first by name among equals; score
    is its share in the two best. A text that is null or has no letter is "und" with score 0, as is every text
    when nothing was learned; one without any n-gram of a language gets the first language and score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # slots words for every 64 languages

    def run(batches):
        f = sent.value
        grams = Grams(f.n if f else 4)
        for b in slices(batches):
            lang, score, size = [], [], []
            for t in b.column(text).to_pylist():
                g = grams.of(t or "")
                size.append(len(g))
                if f is None or not len(g):
                    lang.append("und")
                    score.append(0.0)
                    continue
                hits = f.hits(g)
                best = int(np.argmax(hits))
                rest = np.delete(hits, best).max(initial=0.0)
                lang.append(f.langs[best])
                score.append(float(hits[best] / (hits[best] + rest)) if hits[best] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], [*keep, "lang_pred", "score", "n_grams"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), ADDED]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_grams) of every row. Null keys are never learned from, repeated rows get a row each, an empty table stays empty."""
    got = predict(docs, fit(learnable(docs)), ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_grams")
