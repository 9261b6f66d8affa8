"""Benchmark decontamination by Aho-Corasick automata over windows of normalised benchmark words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh, slices

#: Bytes as they are compared: A-Z lower-cased, other ASCII than letters and digits to blanks, the rest (all of it within non-ASCII letters) kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(ws: list[bytes], width: int) -> list[list[bytes]]:
    """All runs of width words; fewer words, but not none, are one window."""
    return [ws[k : k + width] for k in range(max(1, len(ws) - width + 1))] if ws else []


def automaton(items: list[tuple[int, str]], width: int):
    """Of the windows of all items, each with the numbers of its items and its word count. One byte of text is one letter (latin-1)."""
    import ahocorasick

    found: dict[str, tuple[set[int], int]] = {}
    for n, text in items:
        for w in windows(words(text), width):
            found.setdefault(" " + b" ".join(w).decode("latin-1") + " ", (set(), len(w)))[0].add(n)
    out = ahocorasick.Automaton()
    for k, (ids, n) in found.items():
        out.add_word(k, (tuple(ids), n))
    out.make_automaton()
    return out if found else None


def scan(auto, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges (from, to) within windows, merged, and the numbers of the items they are of."""
    if auto is None or not ws:
        return [], set()
    line = b" " + b" ".join(ws) + b" "
    hits = list(auto.iter(line.decode("latin-1")))
    if not hits:
        return [], set()
    ranges, items, at, word = [], set(), 0, 0
    for end, (ids, n) in hits:  # ends ascend: the blanks passed so far number the words
        word += line.count(b" ", at, end + 1)
        at = end + 1
        items.update(ids)
        ranges.append((word - 1 - n, word - 1))
    return _merge(ranges), items


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as ranges of the original text's characters."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


ADDED = "n_words long, ranges array<struct<a:int,b:int>>, items array<string>, spans array<struct<start:int,end:int>>"
_TYPES = {
    "n_words": pa.int64(), "ranges": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
    "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _step(sent, text: str, width: int, keep: list[str], first: bool):
    def run(batches):
        ids = [i for i, _ in sent.value]
        auto = automaton([(n, t) for n, (_, t) in enumerate(sent.value)], width)
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            had = [([], [])] * b.num_rows if first else [([(x["a"], x["b"]) for x in r], i) for r, i in zip(b.column("ranges").to_pylist(), b.column("items").to_pylist(), strict=True)]
            n_words, ranges, items, at = [], [], [], []
            for t, (r0, i0) in zip(texts, had, strict=True):
                ws = words(t)
                r, i = scan(auto, ws)
                r = _merge([*r0, *r]) if r0 else r
                n_words.append(len(ws))
                ranges.append([{"a": x, "b": y} for x, y in r])
                items.append(sorted({*i0, *(ids[k] for k in i if ids[k] is not None)}))
                at.append([{"start": x, "end": y} for x, y in spans(t, r)] if r else [])
            new = {"n_words": n_words, "ranges": ranges, "items": items, "spans": at}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], _TYPES[c]) if c in new else b.column(c) for c in keep], keep)

    return run


def find(docs: DataFrame, bench: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 10, part_chars: int = 4_000_000) -> DataFrame:
    """keep (all columns of docs, if not given) with n_words, ranges (merged word ranges that are hit), spans (the same in the text's characters) and items (ids).

    bench has item_id and text. It is dealt into parts of about part_chars characters; each part is one automaton in
    each task, and the documents run through one map step after another, with no shuffle. Between parts they are
    written, so that a task holds one automaton at a time: part_chars bounds what the driver sends and a task holds,
    however large the benchmark is.

    A null text, document's or item's, has no words. A null item id marks words, but is not among the items. Items
    with the same id are one item. An empty benchmark hits nothing. A column of docs of an added name is replaced.
    """
    docs = docs.drop(*_TYPES)
    keep = [c for c in (keep or docs.columns) if c not in _TYPES]
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("t")).filter("t <> ''").distinct()
    total = rows.select(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    of = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + ADDED
    out, rest = docs.select(*dict.fromkeys([*keep, text])), list(dict.fromkeys([*keep, text]))
    for p in range(parts):
        part = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).sort("item_id", "t").collect()]
        names = keep if p == parts - 1 else rest
        out = out.mapInArrow(_step(docs.sparkSession.sparkContext.broadcast(part), text, width, [*names, *_TYPES], not p), of(names))
        out = out if names is keep else cut(out)
    return out


def n_hit(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])


def clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of docs that no window hits, as they are."""
    clash = [c for c in docs.columns if c in _TYPES]
    named = docs.withColumnsRenamed(dict(zip(clash, fresh(docs, *[f"_{c}" for c in clash]), strict=True)))
    found = find(named, bench, **how).filter(F.size("ranges") == 0).drop(*_TYPES)
    return found.withColumnsRenamed({v: k for k, v in zip(docs.columns, found.columns, strict=True)}).select(*docs.columns)
