"""URL filters against every subset of tokens."""

import random
from itertools import combinations

from strandspark.llm import urls
from strandspark.llm.queries import URL_RULES


def test_host_path_and_listed_rules(spark):
    cases = [
        ("https://WWW.Example.com/en/a?x=/fr/#y", "www.example.com", "/en/a", "www.example.com/en/"), ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/"), ("http://badexample.com/en/1", "badexample.com", "/en/1", "com/"),
        ("ftp://a.net/es/", "a.net", "/es/", "net/es/"), ("http://net/fr/x", "net", "/fr/x", "net/fr/"), ("http://a.com?x", "a.com", "", None), ("http://a.com#/x", "a.com", "", None), ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None),
        ("x://y://z.com/", "y:", "//z.com/", None), ("http://internet/es/", "internet", "/es/", None), ("http://É.com/Ü", "É.com", "/Ü", "com/"),
    ]
    pages = spark.createDataFrame([(k, u, "mine") for k, (u, *_) in enumerate(cases)], "page_id long, url string, _url string")
    got = {r["page_id"]: r for r in urls.judge(pages, URL_RULES).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(cases))] == [c[1:] for c in cases]
    assert got[0]["_url"] == "mine"
    assert [got[k]["verdict"] for k in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert urls.judge(pages.filter("false"), URL_RULES).count() == 0


def test_tokens(spark):
    u = "https://www.A.org/en/a12/34.html?ref=x&page=2&&=3&ref=4#p=1"
    got = spark.createDataFrame([(u,), (None,), ("http://",)], "u string").select(urls.tokens(urls.F.col("u")).alias("t")).collect()
    assert [r["t"] for r in got] == [["h:a", "h:org", "h:www", "p:0.html", "p:a0", "p:en", "q:page", "q:ref"], [], []]


def every_rule(rows, min_support, min_confidence):
    """Of all subsets of tokens."""
    held: dict[frozenset, dict[str, int]] = {}
    for ts, v in rows:
        for n in range(1, len(ts) + 1):
            for s in combinations(sorted(ts), n):
                held.setdefault(frozenset(s), {"allow": 0, "block": 0})[v] += 1
    least = max(1, -(-min_support * len(rows) // 1))
    return {(s, v): (c[v] / sum(c.values()), c[v]) for s, c in held.items() for v in c if c[v] >= least and c[v] / sum(c.values()) >= min_confidence}


def test_mined_rules_decide_as_every_subset_does(spark):
    r = random.Random(5)
    labelled = [([f"p:{x}" for x in sorted(r.sample("abcdefgh", r.choice((1, 2, 3, 5))))], r.choice(("allow", "block"))) for _ in range(300)]
    labelled = [(ts, "block" if {"p:a", "p:b"} <= set(ts) or ts == ["p:c"] else v if r.random() < 0.3 else "allow") for ts, v in labelled]
    rules, _ = urls.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.02, 0.8)
    all_rules = every_rule(labelled, 0.02, 0.8)
    assert all(all_rules[s, v] == (c, n) for s, v, c, n in rules)
    for ts in [list(s) for n in (1, 2, 3) for s in combinations([f"p:{x}" for x in "abcdefgh"], n)]:
        best = lambda found: max(((c, n, v) for s, v, c, n in found if s <= set(ts)), default=None)  # noqa: E731, B023
        assert best(rules) == best([(s, v, c, n) for (s, v), (c, n) in all_rules.items()])


def test_long_urls_repeated_do_not_explode(spark):
    long = "http://x.com/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    pages = spark.createDataFrame([(k, long if k % 2 else f"http://y.net/es/{k}", None) for k in range(200)] + [(900, "http://y.org/es/1", None), (901, long.replace("x.com", "x.org"), None)], "page_id long, url string, note string")
    got = {r["page_id"]: r for r in urls.judge(pages, URL_RULES).collect()}
    assert (got[900]["verdict"], got[901]["verdict"]) == ("block", "allow")
    assert got[900]["confidence"] == 1.0
    known = spark.createDataFrame([("http://spam.org/", "block"), (None, "allow"), ("http://z.org/q", None)], "url string, verdict string")
    own = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://spam.org/9"), (2, "http://ham.edu/9")], "page_id long, url string"), [], known).collect()}
    assert own == {1: "block", 2: "allow"}
