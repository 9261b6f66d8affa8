"""Token files: blocks, long texts, null and repeated keys, against the tokenizer itself."""

import io
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandspark.llm import tokens


def plain(rows):
    """(key, start, n_tokens, ids_crc32) by the tokenizer alone, keys ascending, nulls first."""
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_every_start_and_long_texts(spark):
    r = random.Random(1)
    words = [f"word{k}" for k in range(3000)] + ["<|endoftext|>", "\t", "  ", "日本"]
    long = " ".join(r.choice(words) for _ in range(400_000))
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(300)))) for k in range(0, 400, 2)]
    rows += [(None, "no key"), (1, long), (3, "x" * 600_000), (5, None), (7, ""), (9, " " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit("own"), "start": F.lit("x"), "k": F.lit(1)})
    got = tokens.digests(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0])) == plain(rows)


def test_many_files_and_repeated_rows(spark):
    rows = [(k // 2 if k % 5 else None, f"text {k // 2}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = tokens.shared_dir(spark)
    manifest = tokens.write(docs, folder, file_chars=50)
    assert manifest.select("file").distinct().count() > 4
    back = tokens.read(manifest, folder, docs=3)
    assert back.count() == 60
    got = tokens.digests(docs).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((n, c) for _, _, n, c in plain(rows))
    assert sorted(r["start"] for r in got) == [a for _, a, _, _ in plain(rows)][:1] + list(np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k))


def test_random_access_reads_blocks_alone():
    class Counted:
        def __init__(self, data):
            self.data, self.got = data, 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.got += n
            return self.data[at : at + n]

    class Kept(io.BytesIO):
        def close(self):
            pass

    r = np.random.default_rng(2)
    texts = [r.integers(0, 50257, n, dtype=np.uint32) for n in (5, 0, 200_000, 1, 70_000, 3)]
    for bits in (16, 17):
        out = Kept()
        writer = tokens.Writer(out, bits)
        for x in texts:
            writer.add(x)
        writer.close()
        data = out.getvalue()
        reader = tokens.Reader(data)
        assert all((reader.doc(k) == x).all() and len(reader.doc(k)) == len(x) for k, x in enumerate(texts))
        _, sizes, crc = tokens.Reader(data).checks(1, 5)
        assert sizes.tolist() == [len(x) for x in texts[1:]]
        assert crc == [zlib.crc32(x.astype("<u4").tobytes()) for x in texts[1:]]
        source = Counted(data)
        assert (tokens.Reader(source).doc(5) == texts[5]).all()
        assert source.got < 200_000 < len(data)


def test_files_are_ordered_by_number(spark):
    files = spark.range(99_990, 100_010).select(F.format_string("part-%05d.tok", "id").alias("file"), F.lit(10).cast("long").alias("n"), "id")
    got = tokens.before(files).join(files, "file").collect()
    assert {x["id"]: x["_before"] for x in got} == {99_990 + k: 10 * k for k in range(20)}
    many = spark.range(100_500).select(F.format_string("part-%05d.tok", "id").alias("file"), F.lit(1).cast("long").alias("n"), "id")
    assert tokens.before(many).join(many, "file").filter("id <> _before").count() == 0
