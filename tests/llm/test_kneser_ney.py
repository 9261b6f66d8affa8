"""The n-gram model against plain dictionaries, and perplexities over long texts, several pieces and clashing columns."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from strandspark.llm import quality


class Plain:
    """Interpolated modified Kneser-Ney by its definition, over whole texts in memory."""

    def __init__(self, texts, n):
        self.n, self.c = n, {}
        top = collections.Counter()
        for t in texts:
            own = quality.START * (n - 1) + t + quality.END
            top.update(own[k : k + n] for k in range(len(own) - n + 1)) if t else None
        self.c[n] = top
        occurs = top
        for k in range(n - 1, 0, -1):
            left, occurs_k = collections.defaultdict(set), collections.Counter()
            for g, c in occurs.items():
                occurs_k[g[1:]] += c
            for g in self.c[k + 1]:
                left[g[1:]].add(g[0])
            self.c[k] = {g: occurs_k[g] if g.startswith(quality.START) else len(left[g]) for g in left}
            occurs = occurs_k
        self.d, self.ctx = {}, {}
        for k, counts in self.c.items():
            n1, n2, n3, n4 = (sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
            self.d[k] = [min(max(i - (i + 1) * y * b / a, 0.1), float(i)) if a and b else min(0.5 * i, 1.0) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            sums = collections.defaultdict(lambda: [0, 0.0])
            for g, c in counts.items():
                sums[g[:-1]][0] += c
                sums[g[:-1]][1] += self.less(k, c)
            self.ctx[k] = sums
        self.unseen = 1.0 / (len(self.c[1]) + 1)

    def less(self, k, c):
        return self.d[k][min(c, 3) - 1] if c else 0.0

    def p(self, g):
        """Of the last letter after the others."""
        k = len(g)
        if k == 0:
            return self.unseen
        lower = self.p(g[1:]) if k > 1 else self.unseen
        if g[:-1] not in self.ctx[k]:
            return lower
        total, spare = self.ctx[k][g[:-1]]
        c = self.c[k].get(g, 0)
        return max(c - self.less(k, c), 0.0) / total + spare / total * lower

    def perplexity(self, text):
        own = quality.START * (self.n - 1) + text + quality.END
        logs = [math.log(self.p(own[k : k + self.n])) for k in range(len(own) - self.n + 1)]
        return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_perplexities_are_those_of_plain_dictionaries(spark, n):
    r = random.Random(n)
    make = lambda k: " ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 5))) for _ in range(k))
    rows = [(k, make(r.randrange(1, 30)), k % 3 > 0) for k in range(60)] + [(100, "zzz qqq", False), (101, "", True), (102, None, True), (103, make(3000), False), (104, "Ab  1\t2", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").withColumns({c: F.lit(1) for c in ("gram", "piece", "row", "c")})
    model = Plain([quality.normal(t) for _, t, good in rows if good], n)
    for chars in (200, 64_000_000):
        got = {x["doc_id"]: x["perplexity"] for x in quality.perplexities(docs, F.col("good"), ["doc_id", "gram", "piece"], n=n, piece_chars=chars).collect()}
        assert len(got) == len(rows)
        assert got[101] is None
        assert got[102] is None
        for k, t, _ in rows:
            if t:
                assert got[k] == pytest.approx(model.perplexity(quality.normal(t)), rel=1e-9)
