"""Importance resampling against strings that are built and hashed one by one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandspark.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, most=2):
    ws = WORD.findall((text or "").encode().lower())
    return ws, [b" ".join(ws[k : k + n]) for n in range(1, most + 1) for k in range(len(ws) - n + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_composed_checksums_are_those_of_the_strings(monkeypatch, most):
    monkeypatch.setattr(resample, "PIECE", 40)
    r = random.Random(most)
    texts = [" ".join("".join(r.choice("abÉ日Z9") for _ in range(r.choice((1, 2, 3, 9)))) for _ in range(r.choice((0, 1, 2, 30)))) for _ in range(40)] + ["", "x" * 500 + " y " + "z" * 90, "a-b_c\x00d", "A  a"]
    got: dict[int, Counter] = {}
    for at, crc in resample.features([t.encode() for t in texts], most):
        for a, c in zip(at.tolist(), crc.tolist(), strict=True):
            got.setdefault(a, Counter())[c] += 1
    for k, t in enumerate(texts):
        assert got.get(k, Counter()) == Counter(zlib.crc32(f) for f in plain(t, most)[1])


def test_resample_matches_plain_loop(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["ÀB", "日本"]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((3, 19, 20, 80))))) for k in range(200)] + [(500, None), (501, ""), (502, "Aa " * 20_000)]
    items = ["w1 w2 w3 w4", None, "", "w7 w8"]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, score int, _row string")
    got = {x["doc_id"]: x for x in resample.resample(docs, spark.createDataFrame([(i,) for i in items], "text string"), buckets=50).collect()}
    s, t = (Counter(zlib.crc32(f) % 50 for x in texts for f in plain(x)[1]) for texts in ([b for _, b in rows], items))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 50) / ((s[b] + 1) * (sum(t.values()) + 50)))) for b in range(50)]
    score = {}
    for k, text in rows:
        ws, fs = plain(text)
        weight = sum(gain[zlib.crc32(f) % 50] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        score[k] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        assert (got[k]["n_features"], got[k]["weight"], got[k]["score"], got[k]["_row"]) == (len(fs), weight, score[k], "x")
    order = sorted((k for k, text in rows if len(plain(text)[0]) >= 20), key=lambda k: (-score[k], k))
    drawn = order[: 25 * len(order) // 100]
    assert {k: x["rank"] for k, x in got.items()} == {k: drawn.index(k) + 1 if k in drawn else None for k in got}


def test_repeated_rows_null_keys_and_empty_tables(spark, docs, empty):
    many = docs.unionByName(docs.filter("doc_id = 5").select(*[F.col(c) for c in docs.columns]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n"))
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    ranks = sorted(x["rank"] for x in resample.resample(many, target).collect() if x["rank"])
    assert ranks == list(range(1, 52 * 25 // 100 + 1)) or ranks == list(range(1, 53 * 25 // 100 + 1))
    assert resample.resample(empty, target).count() == 0
    assert resample.resample(docs, target.filter("false")).count() == docs.count()
    assert resample.resample(many, target).count() == many.count()
