"""Main text of pages whose neighbours lie in other tasks, of marked pages with lines outside their article, and by attributes of real sites."""

import hashlib
import os
import random

import pytest

from strandspark.llm import pages


def test_pairs_decide_marked_pages_too():
    page = "<div>Site</div><article><p>{0}</p><p>quoted</p></article><p>note {0}</p><div>Foot</div>"
    a, b = pages.lines(page.format("mine")), pages.hashes(pages.lines(page.format("other")))
    assert pages.choose(a, b, pages.hashes(a)) == "mine\nquoted\nnote mine"
    assert pages.choose(a, None, pages.hashes(a)) == "mine\nquoted"


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_neighbours_in_other_tasks(spark, parts):
    page = "<div>Site</div><p>text {}</p><div>Foot</div>"
    rows = [(k, f"http://h.com/{k:03}", page.format(k)) for k in range(40)] + [(100 + k, f"http://g.com/{k}", page.format(k)) for k in range(2)] + [(200, "http://solo.com/", page.format(0)), (201, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 3, 50):
        parts(n)
        got = {r["page_id"]: r["text"] for r in pages.digests(table.repartition(5)).collect()}
        assert got == {k: f"text {k % 100}" for k in got if k < 200} | {200: "Site\ntext 0\nFoot", 201: ""}
        assert len(got) == 44


def test_copies_get_one_text(spark, parts):
    page = "<div>Site</div><p>text {}</p><div>Foot</div>"
    rows = [(k, f"http://h.com/{k:04}", page.format(0)) for k in range(600)] + [(600, "http://h.com/zz", page.format(1))]
    parts(5)
    got = pages.digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 601
    assert {(r["page_id"] == 600, r["text"]) for r in got} == {(False, "text 0"), (True, "text 1")}


@pytest.mark.parametrize(
    "tag", ['article class="card overflow-hidden"', 'article class="has-sidebar"', 'article class="post category-social"', 'article class="related"', 'article data-id="menu" data-id=\'nav\'', 'article data-title="the hidden valley"', 'main data-x="a class=hidden"']
)
def test_attributes_of_an_article(tag):
    assert (pages.KEEP, "text") in pages.lines(f"<nav>x</nav><div class='no-comments'><{tag}><p>text</p></{tag.split()[0]}></div>")


def test_surroundings_of_an_article():
    kept = lambda page: [t for kind, t in pages.lines(page) if kind == pages.KEEP]
    assert kept("<form><div class=sidebar>x<article>text</article></div>y</form>") == ["text"]
    assert kept("<article>text</article><div class='comments'><article>reply</article></div>") == ["text"]
    assert kept("<article>card</article><div id=search><main>text</main></div>") == ["card", "text"]
    for gone in ("hidden", "aria-hidden=true", "style='color:red; display : none'"):
        assert kept(f"<div {gone}><article>text</article></div><p>x</p>") == kept(f"<article {gone}>text</article><p>x</p>") == []
    assert pages.lines("<div class='main-menu'>x</div><div class='ad'>y</div><div class='post-text'>z</div><p data-role=main>u") == [(1, "x"), (1, "y"), (2, "z"), (2, "u")]


def test_texts_are_those_of_a_plain_loop(spark, parts):
    """Pages of several hosts, with copies, against each page's nearest neighbour found by a loop. Lines keep one order on a host, so that what two pages have in common is their longest common subsequence."""
    r = random.Random(9)
    rows = []
    for k in range(160):
        host = r.choice(["a.com", "b.org", "c.net"])
        path = "/" + "/".join(r.choice("xyz") * r.randrange(1, 4) for _ in range(r.randrange(1, 4)))
        own = sorted([f"{j:02} line of {host}" for j in r.sample(range(12), r.randrange(2, 9))] + [f"{r.randrange(12):02} own {r.randrange(60)}"])
        rows.append((k, f"https://{host}{path}?q={k}", own))
    rows += [(200 + k, url, own) for k, url, own in rows[:30]]
    distinct = {}
    for _, url, own in rows:
        host, path = url.split("//")[1].split("?")[0].split("/", 1)
        key = host, tuple(own)
        distinct[key] = min(distinct.get(key, "~"), "/" + path)
    sig = lambda own: hashlib.blake2b(pages.hashes([(2, x) for x in own]).tobytes(), digest_size=16).digest()
    order = sorted((host, path, sig(own), own) for (host, own), path in distinct.items())
    want = {}
    for at, (host, path, _, own) in enumerate(order):
        sides = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == host]
        nearest = max(sides, key=lambda s: len(os.path.commonprefix([s[1], path])))
        want[host, own] = "\n".join(x for x in own if x not in nearest[3])
    table = spark.createDataFrame([(k, url, "<body>" + "".join(f"<p>{x}</p>" for x in own) + "</body>", "h", "p") for k, url, own in rows], "page_id long, url string, html string, _host string, _html string")
    for n in (1, 4, 8, 61):
        parts(n)
        got = {x["page_id"]: x for x in pages.extract(table).collect()}
        assert {k: got[k]["text"] for k in got} == {k: want[url.split("//")[1].split("/")[0], tuple(own)] for k, url, own in rows}
        assert (got[0]["_host"], got[0]["_html"]) == ("h", "p")
