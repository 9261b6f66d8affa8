"""Operators against brute force, on rows with nulls, copies, empty and long texts, and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import components, decontam, embeddings, langid, mix, pages, quality, shard, simhash, tokens, toxicity


def test_mix(docs, empty):
    got = mix.mix(docs, mix.words(F.col("text"))).collect()
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["size"] for r in got) == sum(size(r["text"]) for r in docs.collect())
    total, by = sum(r["size"] for r in got), {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in by.values()) == pytest.approx(min(total, sum(3 * s for s, _ in by.values())))
    assert all(t <= 3 * s + 1e-9 for s, t in by.values())
    assert all(0 <= r["copies"] <= 3 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(docs, mix.words(F.col("text"))).collect()))
    assert mix.mix(empty, mix.words(F.col("text"))).count() == 0


def test_mix_takes_near_the_target(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 50 + 1).alias("n"))
    for r in mix.mix(rows, F.col("n")).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]


def test_targets_reshare_what_stops(spark):
    t = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mix.targets(t).collect()}
    assert got["b"] == 30
    assert got["c"] == 30
    assert sum(got.values()) == pytest.approx(1120)
    assert (got["a"], got[None]) == (760, 300)


def test_shards(docs, empty):
    rows = docs.withColumn("size", shard.text_size(F.col("text")))
    got = shard.shard(rows, "size", shards=3).collect()
    assert len(got) == docs.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard.shard(empty, "size").count() == 0


def test_shards_are_balanced_and_hardly_move(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 37 + 1).alias("size"))
    load = shard.shard(rows, "size").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r["n"] for r in load]
    assert len(n) == 8
    assert max(n) <= 1.003 * sum(n) / 8 + 38
    a = shard.shard(rows, "size").select("doc_id", F.col("shard").alias("a"))
    b = shard.shard(rows.filter("doc_id % 100 <> 0"), "size").select("doc_id", F.col("shard").alias("b"))
    assert a.join(b, "doc_id").filter("a = b").count() > 0.9 * b.count()


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([("q1", "the QUICK brown fox, jumps over the lazy dog and runs far"), ("q2", "One"), (None, "petit chat noir"), ("q3", None), ("q4", "")], "item_id string, text string")
    items = [(i, decontam.words(t)) for i, t in bench.collect()]
    for r in decontam.find(docs, bench).collect():
        ws = decontam.words(r["text"])
        hit, found = set(), set()
        for i, ib in items:
            for w in decontam.windows(ib, 10):
                for k in range(len(ws) - len(w) + 1):
                    if ws[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(i)
        assert r["n_words"] == len(ws)
        assert {k for x in r["ranges"] for k in range(x["a"], x["b"])} == hit
        assert r["items"] == sorted(i for i in found if i)
        for x, s in zip(r["ranges"], r["spans"], strict=True):
            assert decontam.words(r["text"][s["start"] : s["end"]]) == ws[x["a"] : x["b"]]
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.clean(docs, bench).filter("doc_id in (1, 2, 6, 8)").count() == 0
    assert decontam.find(empty, bench).count() == 0
    assert decontam.find(docs, bench.filter("false")).filter("size(ranges) > 0").count() == 0
    small = {str(r["doc_id"]): r["ranges"] for r in decontam.find(docs, bench, part_chars=20).collect()}
    assert small == {str(r["doc_id"]): r["ranges"] for r in decontam.find(docs, bench).collect()}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fp = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got if r["doc_id"]}
    assert fp[3][0] == fp[4][0] == fp[7][0] == 0
    ids = list(fp)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fp[a][0] ^ fp[b][0]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: fp[i][1] for i in ids} == root
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted(set(root.values()))
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_links_find_all_near_fingerprints(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(6)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = dict(simhash.classes(spark.createDataFrame([(x,) for x in signed], "fp long")).collect())
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    classes = {}
    for x, s in zip(fps, signed, strict=True):
        classes.setdefault(find(x), set()).add(got[s])
    assert all(len(v) == 1 for v in classes.values())
    assert len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 50)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in range(1, 50)} == {1}


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 16, 17, 32):
        ids = r.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        for first, n in ((0, 1000), (7, 100), (999, 1), (5, 0)):
            assert (tokens.unpack(tokens.pack(ids, bits), bits, first, n) == ids[first : first + n]).all()


def test_tokens_are_the_tokenizers(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    got = [r for r in tokens.digests(docs.filter("doc_id is not null")).collect()]
    rows = sorted(docs.filter("doc_id is not null").collect(), key=lambda r: r["doc_id"])
    at, want = 0, []
    for r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])][0] == 0
    assert sum(r["n_tokens"] for r in got) == at
    assert tokens.digests(empty).count() == 0


def test_encoder_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    tok, encode, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(3)
    alphabet = ["a", "The", " ", " ", "\n", "\t", "é", "1", ".", "'s", "日本", " ", "<|endoftext|>", "\r", "\x00", " ", "\x85"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(5000)]
    assert [x.tolist() for k in range(0, 5000, 1000) for x in encode(pa.array(texts[k : k + 1000]))] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_languages(spark, docs, empty):
    words = {"en": ["the", "house", "with", "thing"], "fr": ["le", "maison", "avec", "chose"], "de": ["das", "haus", "mit", "ding"]}
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words[w]) for _ in range(30)), w) for k, w in enumerate(["en", "fr", "de"] * 40)] + [(1000, None, "en"), (1001, "123 !", "fr"), (1002, "the house", None), (None, "le", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(table).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:120])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und"
    assert got[1002]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert {k: x["held_out"] for k, x in got.items() if k} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in got if k}
    assert langid.identify(docs).count() == docs.count()
    assert langid.identify(empty).count() == 0
    assert langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_bloom_masks_have_no_false_negatives():
    f = langid.Filters(["a", "b"], np.zeros((1 << 12, 1), np.uint64), 3, np.zeros(2), 4)
    g = np.random.default_rng(1).integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)
    for at in f.slots(g):
        f.table[at, 0] |= np.uint64(2)
    assert (f.masks(g)[:, 0] & np.uint64(2)).all()
    assert f.hits(g)[1] == 200


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["sun", "tree", "road", "lake"]) for _ in range(20)) + (" scum" if k % 4 == 0 else "")) for k in range(400)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.predict(table, labels).collect()
    assert all(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in got if x["held_out"])
    assert sum(x["held_out"] for x in got) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(400))
    assert toxicity.clean(table, labels).count() == 300
    assert {x["score"] for x in toxicity.predict(docs, labels.filter("false")).collect()} == {0.5}
    assert toxicity.predict(empty, labels).count() == toxicity.clean(empty, labels).count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_common_lines_are_longest():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for bits in (1 << 28, 4):
            mark = pages.common(np.array(a, np.uint64), np.array(b, np.uint64), bits)
            rest = iter(b)
            assert mark.sum() == best[-1][-1]
            assert all(x in rest for x, m in zip(a, mark, strict=True) if m)


def test_pages(spark):
    site = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div>Our site</div><div class='ad'>Buy</div>{}<div>All rights</div><footer>F</footer></body>"
    rows = [
        (1, "http://h.com/a/1", site.format("<article><h1>A &amp; B</h1><p>x  \n y<br>z<p>Our site</article>")), (2, "http://h.com/a/2", site.format("<p>plain &eacute;&#233;</p>")), (3, None, None), (4, "http://h.com/b", ""),
        (5, "http://solo.org/", "<p>one<script>x<y</script><p>two <b>bold</b> &am"), (2, "http://h.com/a/2", site.format("<p>plain &eacute;&#233;</p>")),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.digests(table.coalesce(1)).collect()}
    assert got[1][0] == "A & B\nx y z\nOur site"
    assert got[2][0].split("\n")[-1] == "All rights" or "plain éé" in got[2][0]
    assert got[3] == got[4] == ("", 0)
    assert got[5][0] == "one\ntwo bold &am"
    assert pages.digests(table).count() == 6
    assert pages.digests(table.filter("false")).count() == 0


def test_lines_that_a_neighbour_shares_go():
    a = pages.lines("<div>Site</div><p>mine</p><div>Foot</div>")
    b = pages.hashes(pages.lines("<div>Site</div><p>other</p><div>Foot</div>"))
    assert pages.choose(a, b, pages.hashes(a)) == "mine"


def brute(rows):
    ok = [(k, np.array(v, float)) for k, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}
    for _ in ok:
        for a, x in ok:
            for b, y in ok:
                if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    root[a] = root[b] = min(root[a], root[b])
    for a, x in ok:
        links[a] = sum(a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9 for b, y in ok)
    return links, root


def test_embeddings(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(6, 5))
    rows = [(k, [float(x) for x in base[k % 6] + r.normal(size=5) * 0.25]) for k in range(40)]
    rows += [(40, rows[0][1]), (41, [2 * x for x in rows[0][1]]), (42, None), (43, [0.0] * 5), (44, [1.0, None, 0.0, 0.0, 0.0]), (45, [float("nan")] * 5), (46, []), (47, [1.0, 0.0]), (48, [1.0, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links, root = brute(rows)
    for how in ({}, {"leaf": 4}):
        for x in embeddings.near_duplicates(table, **how).collect():
            assert (x["n_links"], x["component_id"], x["kept"]) == (links[x["vec_id"]], root[x["vec_id"]], root[x["vec_id"]] == x["vec_id"])
    assert embeddings.near_duplicates(table.filter("false")).count() == 0


def test_tree_join_is_exact():
    r = np.random.default_rng(7)
    p = embeddings.unit(np.concatenate([r.normal(size=(1, 4)) + r.normal(size=(n, 4)) * s for n, s in ((300, 0.02), (200, 0.3), (100, 2.0))]))
    n = np.ones(len(p), np.int64)
    got, _, edges = embeddings.join(p, p, n, n, 0.9, True)
    hit = p @ p.T >= 0.9
    np.fill_diagonal(hit, False)
    assert (got == hit.sum(1)).all()
    assert all(hit[i, j] for i, j in edges)


def test_quality(spark, docs, empty):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["sun", "tree", "road", "lake", "house"]) for _ in range(30)), "en") for k in range(200)]
    rows += [(1000 + k, "".join(chr(33 + r.randrange(90)) for _ in range(150)), "en") for k in range(20)] + [(2000, None, "en"), (2001, "", None)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, 1) for k in range(150)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.classify(table, labels).collect()}
    assert sum(got[k]["kept"] for k in range(200)) >= 190
    assert not any(got[1000 + k]["kept"] for k in range(20))
    assert got[2000]["perplexity"] is None
    assert not got[2000]["kept"]
    assert all(x["kept"] for x in quality.classify(docs, labels.filter("false")).collect())
    assert quality.classify(empty, labels).count() == 0


def test_kneser_ney_sums_to_one_and_matches_brute_force(spark):
    texts = ["abracadabra", "abba", "cab"]
    n, counts = 3, {}
    for t in texts:
        for w in quality.windows(t, n):
            for g in w:
                s = "".join(map(chr, g))
                counts[s] = counts.get(s, 0) + 1
    table = spark.createDataFrame(list(counts.items()), "gram string, c long")
    probs, least = quality.model(table, n)
    letters = sorted({g[-1] for g in counts})
    for ctx in ("ab", "ra", "zz", "\x02\x02"):
        asked = spark.createDataFrame([(ctx + x,) for x in letters], "gram string")
        total = sum(np.exp(r["s"]) for r in quality.answers(asked, probs, least, n).collect())
        assert total + least_share(probs, ctx, least, n) == pytest.approx(1, abs=1e-6)


def least_share(probs, ctx, least, n):
    """What is left for one character that was never seen."""
    w = 1.0
    for k in range(n, 1, -1):
        back = probs[k - 1].filter(F.col("ctx") == ctx[len(ctx) - k + 1 :]).agg(F.max("back")).first()[0]
        w *= back if back is not None else 1.0
    return w * least
