"""Main text of web pages by nearest-URL page differencing.

Pages are put in the order of their URL paths within each host, each page is paired with the nearer of its two
neighbours there, and the pair's text lines are aligned by their longest common subsequence: what both have is the
site's, not the page's. Structure comes first and last: lines within menus, headers, footers, forms and the like go
whatever the neighbour has, and lines that a page marks as its article stay, so that text which two pages quote is kept.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import cut, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*>", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Their content is no text at all.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title"}
#: Their text is never the article's.
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
ARTICLE = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Names in class, id or role by which sites mark what surrounds an article, each the whole of a name between blanks.
NAMED = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|primary|secondary|left|right|post|entry|article|user|wp)[_-])?(?:ads?|advert|advertisement|advertising|adverts|adsense|banner|sponsor|sponsored|sponsors|promo|promos|promotion|nav|navbar|navigation|menu|menus|menubar|"
    r"breadcrumbs?|pagination|pager|sidebar|side[_-]bar|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|signup|login|search|comments?|disqus|replies|respond|"
    r"share|sharing|social|related|recommended|copyright|alert)(?:[_-](?:banner|bar|block|box|buttons?|container|form|icons?|inner|items?|links?|list|notice|posts?|area|section|slot|unit|widget|wrapper|wrap|thread|top|bottom|left|right|\d+))?"
    r"|site[_-]header|page[_-]header|aside|complementary|contentinfo|skip-link|sr-only|hidden",
    re.I,
)
KEEP, DROP, ASK = 0, 1, 2
SPACES = re.compile(r"\s+")


def _attrs(text: str) -> dict[str, str]:
    """Values by whole lower-case names; of repeated names the first, as browsers have it."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _unseen(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or "display:none" in SPACES.sub("", attrs.get("style", "")).lower()


def _named(attrs: dict[str, str]) -> bool:
    return any(NAMED.fullmatch(x) for k in ("class", "id", "role") for x in attrs.get(k, "").split())


def lines(page: str | None) -> list[tuple[int, str]]:
    """(KEEP, DROP or ASK, text) of each block of the page in its order: in an article, in what surrounds one, or neither.

    An article goes if it or what it is in is not shown. In an element that only its tag or name makes surroundings (a
    form, class="comments") it stays if it is the page's main element, or if the page marks no other article.
    """
    out, lost = _lines(page or "", False)
    return _lines(page or "", True)[0] if "main" in lost or lost and all(kind != KEEP for kind, _ in out) else out


def _lines(page: str, rescue: bool) -> tuple[list[tuple[int, str]], set[str]]:
    """Lines, and which kinds of article, "main" or "article", are within surroundings that are shown. rescue: these are kept."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements that matter, with what they make of text and whether it is shown
    state, shown, at = ASK, True, 0
    lost: set[str] = set()

    def flush():
        text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((state, text))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["cdata"] is not None and not tag:
            held.append(m["cdata"])
        if not tag:
            continue
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if any(t == tag for t, *_ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
                state, shown = stack[-1][1:] if stack else (ASK, True)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag in RAW and not m["attrs"].endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            continue
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
            continue
        new, seen = state, shown
        attrs = _attrs(m["attrs"]) if len(m["attrs"]) > 1 and tag not in ("html", "body") else {}
        main = tag == "main" or attrs.get("role", "").strip().lower() == "main"
        article = main or tag in ARTICLE or attrs.get("itemprop", "").strip().lower() == "articlebody"
        if shown and _unseen(attrs):
            new, seen = DROP, False
        elif article:
            if shown and state == DROP:
                lost.add("main" if main else "article")
            if shown and (state != DROP or rescue):
                new = KEEP
        elif state != DROP and (tag in CHROME and not (tag == "header" and state == KEEP) or _named(attrs)):
            new = DROP
        if new != state or seen != shown or any(t == tag for t, *_ in stack):  # elements of the same name are counted, so that the right end tag closes
            if new != state:
                flush()
            stack.append((tag, new, seen))
            state, shown = new, seen
    held.append(page[at:])
    flush()
    return out, lost


def _lengths(a: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[int, list[int]]:
    """The last, and if keep all, bit-vectors of the longest common subsequence, one for each line of a: bit j is 0 where b[: j + 1] has one more line in common than b[:j]."""
    places: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b.tolist()):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a.tolist():
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return v, rows


def common(a: np.ndarray, b: np.ndarray, most_bits: int = 1 << 28) -> np.ndarray:
    """Marks the lines of a that are in a longest common subsequence of a and b.

    Equal ends are taken off; the rest is found by bit-vectors and traced back. Where these would take over most_bits,
    a is halved and b parted where the halves have most in common, so that memory is bounded for pages of any length.
    """
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    k = n if same.all() else int(np.argmin(same))
    out[:k] = True
    a, b, rest = a[k:], b[k:], out[k:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    k = n if same.all() else int(np.argmin(same))
    if k:
        rest[len(a) - k :] = True
        a, b, rest = a[:-k], b[:-k], rest[: len(a) - k]
    if not len(a) or not len(b):
        return out
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        ones = lambda v, n: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n].astype(np.int64))])
        before, after = ones(_lengths(a[:half], b, False)[0], len(b)), ones(_lengths(a[half:][::-1], b[::-1], False)[0], len(b))
        at = int(np.argmax(before + after[::-1]))
        rest[:half], rest[half:] = common(a[:half], b[:at], most_bits), common(a[half:], b[at:], most_bits)
        return out
    _, rows = _lengths(a, b)
    j = len(b)
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        if j <= 0:
            break
        zeros = lambda v: j - (v & ((1 << j) - 1)).bit_count()  # noqa: B023, E731
        above = rows[i - 1] if i else full
        if zeros(rows[i]) > zeros(above):  # line i takes part: at the last place that adds to the count
            rest[i] = True
            j = (~rows[i] & ((1 << j) - 1)).bit_length() - 1
    return out


def hashes(ls: list[tuple[int, str]]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(t.encode("utf-8", "surrogatepass")[::-1]) for _, t in ls], np.uint64)


def near(a: str, b: str) -> int:
    """How many leading characters two paths share."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def choose(ls: list[tuple[int, str]], other: np.ndarray | None, own: np.ndarray) -> str:
    """The page's text: its lines less those of the surroundings and those that the neighbour has too, but for its article's, which may be quoted. Without a neighbour's lines, its article's lines, if it marks any."""
    return "\n".join(t for (_, t), x in zip(ls, taken([kind for kind, _ in ls], common(own, other) if other is not None and len(other) else None), strict=True) if x)


def taken(kinds: list[int], shared: np.ndarray | None) -> list[bool]:
    """Which lines are the page's text; shared: those that a neighbour has too, None without a neighbour."""
    if shared is None:
        marked = KEEP in kinds
        return [kind == (KEEP if marked else ASK) for kind in kinds]
    return [kind == KEEP or kind == ASK and not s for kind, s in zip(kinds, shared.tolist(), strict=True)]


def _parse(keep: list[str], text: bool):
    """Host, path and a digest of all lines of each page; with text, keep and the lines outside surroundings, otherwise the hashes of all lines."""

    def run(batches):
        for b in slices(batches, 128):
            parsed = [lines(x) for x in b.column("_html").to_pylist()]
            own = [hashes(ls).tobytes() for ls in parsed]
            sigs = pa.array([blake2b(x, digest_size=16).digest() for x in own], pa.binary())
            if text:
                kinds = pa.array([bytes(kind for kind, _ in ls) for ls in parsed], pa.binary())
                bare = pa.array(["\n".join(t for kind, t in ls if kind != DROP) for ls in parsed], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("_host"), sigs, kinds, bare], [*keep, "_host", "_sig", "_kinds", "_text"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_path"), sigs, pa.array(own, pa.binary())], ["_host", "_path", "_sig", "_own"])

    return run


def _align(batches):
    """Which lines of each page the nearer of its neighbours has too, as bits; null without a neighbour on the host."""
    for b in slices(batches, 128):
        out = []
        for host, path, own, *sides in zip(*(b.column(c).to_pylist() for c in ("_host", "_path", "_own", "_before", "_after")), strict=True):
            nearest = max([x for x in sides if x and x["_host"] == host], key=lambda x: near(x["_path"], path), default=None)
            out.append(nearest and np.packbits(common(np.frombuffer(own, np.uint64), np.frombuffer(nearest["_own"], np.uint64))).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_sig"), pa.array(out, pa.binary())], ["_host", "_sig", "_shared"])


def shared_lines(parsed: DataFrame, parts: int) -> DataFrame:
    """(_host, _sig, _shared) of each distinct page, that is, of all pages of a host with the same lines; pages without lines are left out.

    Distinct pages are put in the order of their least paths, dealt by ranges. The ranges are written with their
    numbers, and the first and last page of each are handed to the ranges before and after it.
    """
    pages = parsed.filter("length(_own) > 0").groupBy("_host", "_sig").agg(F.min(F.struct("_path", "_own")).alias("x")).select("_host", "x._path", "_sig", "x._own")
    order = ["_host", "_path", "_sig"]
    dealt = cut(pages.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    page = F.struct(*order, "_own")
    ends = dealt.groupBy("_range").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    by_range, within = Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order)  # as many rows as ranges
    ends = cut(ends.select("_range", F.lag("last").over(by_range).alias("ahead"), F.lead("first").over(by_range).alias("behind")))
    sides = dealt.join(ends, "_range").withColumns({"_before": F.coalesce(F.lag(page).over(within), "ahead"), "_after": F.coalesce(F.lead(page).over(within), "behind")})
    return cut(sides.select("_host", "_path", "_sig", "_own", "_before", "_after").mapInArrow(_align, "_host string, _sig binary, _shared binary"))


def _told(keep: list[str]):
    def run(batches):
        for b in slices(batches, 128):
            out = []
            for kinds, text, shared in zip(*(b.column(c).to_pylist() for c in ("_kinds", "_text", "_shared")), strict=True):
                bits = None if shared is None else np.unpackbits(np.frombuffer(shared, np.uint8), count=len(kinds)).astype(bool)
                own = (x for kind, x in zip(kinds, taken(list(kinds), bits), strict=True) if kind != DROP)
                out.append("\n".join(t for t, x in zip(text.split("\n"), own, strict=True) if x) if text else "")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return run


def extract(pages: DataFrame, keep: list[str] | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """keep (all columns but html, if not given) with text: the main text of each page, "" if there is none.

    Which lines are shared is decided once for each distinct page of a host, over all of its distinct pages in the
    order of their paths, and joined back to the copies: the text depends neither on how rows are dealt nor on how many
    copies there are. Pages are read twice, so that only hashes of lines are sorted and only their text is shuffled.
    A page that is the only one of its host with lines is told by structure alone.

    A null or empty html has no text. A null url is a host of its own. Repeated rows get a row each. Unclosed and
    stray tags, cut character references and pages cut short are read as far as they go. An empty table stays empty.
    """
    keep = [c for c in (keep or [c for c in pages.columns if c != html]) if c != "text"]
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    names = [f"k{i}" for i in range(len(keep))]  # no clash with the names here
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], F.lower(F.regexp_extract(bare, r"^[^/]*", 0)).alias("_host"), F.regexp_extract(bare, r"^[^/]*(.*)$", 1).alias("_path"), F.col(html).alias("_html"))
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = shared_lines(rows.select("_host", "_path", "_html").mapInArrow(_parse([], False), "_host string, _path string, _sig binary, _own binary"), parts)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    own = [f"{k} {kinds[k]}" for k in names]
    texts = rows.drop("_path").mapInArrow(_parse(names, True), ", ".join([*own, "_host string, _sig binary, _kinds binary, _text string"]))
    joined = texts.join(shared, ["_host", "_sig"], "left").select(*names, "_kinds", "_text", "_shared")
    return joined.mapInArrow(_told(names), ", ".join([*own, "text string"])).toDF(*keep, "text")


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return extract(pages, ["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
