"""Languages against plain sets of n-grams, texts longer than a piece, and clashing columns."""

import collections
import random
import zlib

from pyspark.sql import functions as F

from strandspark.llm import langid


def test_pieces_do_not_cut_words(monkeypatch):
    r, grams = random.Random(1), langid.Grams()
    for _ in range(300):
        text = "".join(r.choice(["a", "B", "é", " ", " ", "1", "\U00030000"]) for _ in range(r.randrange(40)))
        whole = grams.of(text).tolist()
        for piece in (1, 3, 7):
            monkeypatch.setattr(langid, "PIECE", piece)
            assert grams.of(text).tolist() == whole
        monkeypatch.setattr(langid, "PIECE", 1 << 20)


def plain(rows, n=4):
    """The languages with most hits: a language has the n-grams that are at least a ten-thousandth of its own. Which of several wins hangs on the filters' rates."""
    grams = langid.Grams(n)
    count = collections.defaultdict(collections.Counter)
    for key, text, lang in rows:
        if lang and text and key is not None and zlib.crc32(str(key).encode()) % 4 != 2:
            count[lang].update(grams.of(text).tolist())
    has = {lang: {g for g, k in c.items() if k >= 1e-4 * c.total()} for lang, c in sorted(count.items()) if c}
    out = {}
    for key, text, _ in rows:
        own = grams.of(text or "").tolist()
        hits = {lang: sum(g in s for g in own) for lang, s in has.items()}
        out[key] = {lang for lang in hits if hits[lang] == max(hits.values())} if own and has else {"und"}
    return out


def test_languages_are_those_of_plain_sets(spark):
    r = random.Random(3)
    words = {lang: ["".join(r.choice("abcdefghij" if lang < "c" else "ghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(80)] for lang in "abcd"}
    rows = [(k, " ".join(r.choice(words[r.choice("abcd") if r.random() < 0.2 else "abcd"[k % 4]]) for _ in range(r.randrange(1, 60))), "abcd"[k % 4]) for k in range(400)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "12 !?", "c"), (903, " ".join(words["c"]) * 9, None), (904, "x y", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("own"), "gram": F.lit(1), "n": F.lit(2)})
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(docs).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k] in want[k] for k in got)
    assert sum(len(x) == 1 for x in want.values()) > 300
