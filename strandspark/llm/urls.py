"""URL filters: listed rules, and association rules between a URL's tokens and a verdict that FP-growth mines."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import cut, fresh

VERDICTS = ("allow", "block")
#: Tokens that are mined together: a URL of more is several transactions, which overlap by half.
WINDOW = 12


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of the listed rules (host, path, verdict) that fits, or null: its host or a subdomain of it, and a path that starts with its path. Of equally long ones the longer host wins. The list is a parameter, one expression a rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the last one asks first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a whole URL, sorted: labels of its host, segments of its path with each number as 0, names of its query."""
    some = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(some("h:", F.split(host_of(url), r"\.")), some("p:", segments), some("q:", names))))


class Index:
    """Sets of tokens by their rarest token, so that a URL is held against those alone that one of its tokens leads to."""

    def __init__(self, sets: list[frozenset[str]], often: dict[str, int]):
        self.sets, self.lead = sets, {}
        for k, s in enumerate(sets):
            self.lead.setdefault(min(s, key=lambda x: (often.get(x, 0), x)), []).append(k)

    def within(self, tokens: list[str]) -> list[int]:
        """Numbers of the sets that tokens hold."""
        own = set(tokens)
        return [k for t in own for k in self.lead.get(t, ()) if self.sets[k] <= own]


def _counted(labelled: DataFrame, index: Index) -> DataFrame:
    """(k, verdict, n): how many labelled rows (tokens, verdict) hold each set, exactly, whatever the windows. Each task adds up its own counts first."""

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for own, v in zip(b.column("tokens").to_pylist(), b.column("verdict").to_pylist(), strict=True):
                n.update((k, v) for k in index.within(own))
        rows = [(k, v, c) for (k, v), c in n.items()]
        yield pa.RecordBatch.from_pydict({c: [r[x] for r in rows] for x, c in enumerate(("k", "verdict", "n"))}, pa.schema([("k", pa.int32()), ("verdict", pa.string()), ("n", pa.int64())]))

    return labelled.select("tokens", "verdict").mapInArrow(run, "k int, verdict string, n long").groupBy("k", "verdict").agg(F.sum("n").alias("n"))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> tuple[list[tuple[frozenset[str], str, float, int]], dict[str, int]]:
    """Rules (tokens, verdict, confidence, support) from labelled rows (tokens, verdict), and how often each token of them occurs.

    FP-growth lists the frequent sets of tokens with a verdict. An URL of more than WINDOW tokens is several
    transactions, so that a long URL that is frequent does not make all subsets of its tokens frequent; support and
    confidence are counted anew over whole URLs. A set that occurs with a verdict in min_support of the rows at least,
    and has it in min_confidence of those that hold it, is a rule, unless a subset with the same verdict is as sure.
    At most 2 ** WINDOW / min_support sets can be frequent, whatever the data; these come to the driver.
    """
    labelled = cut(labelled.filter(F.col("verdict").isin(*VERDICTS) & (F.size("tokens") > 0)).select("tokens", "verdict"))
    rows = labelled.count()
    if not rows:
        return [], {}
    least = max(1, math.ceil(min_support * rows))
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(WINDOW // 2)), lambda k: (k == 0) | (k + WINDOW // 2 < F.size("tokens")))
    windows = cut(labelled.select(F.explode(F.transform(starts, lambda k: F.concat(F.slice("tokens", k + 1, WINDOW), F.array(F.concat(F.lit("="), "verdict"))))).alias("items")))
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / windows.count(), minConfidence=1.0, numPartitions=n).fit(windows).freqItemsets.collect()
    often = {r["items"][0]: r["freq"] for r in frequent if len(r["items"]) == 1}
    sets = sorted({frozenset(own) for r in frequent if (own := [x for x in r["items"] if x[0] != "="]) and len(own) < len(r["items"])}, key=lambda s: (len(s), sorted(s)))
    found: dict[frozenset[str], dict[str, int]] = {s: dict.fromkeys(VERDICTS, 0) for s in sets}
    for r in _counted(labelled, Index(sets, often)).collect():
        found[sets[r["k"]]][r["verdict"]] = r["n"]
    sure = {(s, v): (c[v] / sum(c.values()), c[v]) for s, c in found.items() for v in VERDICTS if c[v] >= least}
    rules = []
    for (s, v), (confidence, support) in sure.items():
        if confidence >= min_confidence and not any(sure.get((s - {x}, v), (0.0,))[0] >= confidence for x in s):
            rules.append((s, v, confidence, support))
    return rules, often


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url", min_support: float = 0.01, min_confidence: float = 0.8, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict and confidence; columns of these names are replaced.

    A listed rule (host, path, verdict) decides what it fits. What none fits is judged by the mined rules: of those
    whose tokens the URL holds the one of the highest confidence, then support, then "block" decides; without any,
    otherwise. labelled (url, verdict) is what is mined, by default the pages that a listed rule decides. A null URL,
    or one without "://", has an empty host and path; repeated URLs get the same verdict. No pages give none.
    """
    own = pages.drop("host", "path", "rule", "verdict", "confidence")
    (u,) = fresh(own, "_url")
    parsed = own.withColumn(u, F.col(url)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    hit = listed(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": hit["rule"], "verdict": hit["verdict"]})
    known = parsed.filter("verdict is not null").select(F.col(u).alias("url"), "verdict") if labelled is None else labelled
    mined, often = mine(known.select(tokens(F.col("url")).alias("tokens"), "verdict"), min_support, min_confidence)
    index = Index([s for s, *_ in mined], often)
    worth = [(c, n, v == "block") for _, v, c, n in mined]
    keep = [*own.columns, "host", "path", "rule"]

    def run(batches):
        for b in batches:
            verdicts, sure = [], []
            for v, ts in zip(b.column("verdict").to_pylist(), b.column(u).to_pylist(), strict=True):
                best = max((worth[k] for k in index.within(ts)), default=None) if v is None else None
                verdicts.append(v or (otherwise if best is None else VERDICTS[best[2]]))
                sure.append(None if best is None else best[0])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(verdicts, pa.string()), pa.array(sure, pa.float64())], [*keep, "verdict", "confidence"])

    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema}
    asked = parsed.withColumn(u, F.when(F.isnull("verdict"), tokens(F.col(u))))
    return asked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "verdict string, confidence double"]))
