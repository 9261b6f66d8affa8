"""Token ids in bit-packed binary files with random access.

A file (*.tok), all integers little-endian:

    header   8 bytes  b"TOKPACK1"
    ids      each in bits bits, lowest bit first, in blocks of BLOCK ids; each block starts at a byte
    footer   doc ends   one unsigned 64-bit integer a document: ids of the file up to its end
             blocks     one unsigned 64-bit integer a block: its first byte in the file
    tail     40 bytes   unsigned 64-bit: bits, ids a block, ids, documents, blocks
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import bounded, by_bytes, cut, shared_dir

MAGIC, BLOCK = b"TOKPACK1", 1 << 16
#: White space beside white space, at an end, or other than blanks and line feeds: there a text is not cut.
ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Bytes of text that are split into pieces together; a longer text goes alone.
TOGETHER = 4 << 20
#: Characters that the tokenizer is given at once: what it returns takes some hundred bytes a token.
AT_ONCE = 1 << 18
#: Between ASCII letters or digits a blank always begins a piece, whatever else is in the text.
SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
#: Pieces of up to LONG bytes are kept for later batches, CACHE of them at most.
CACHE, LONG = 300_000, 9


def width(vocabulary: int) -> int:
    """Bits that the largest id takes."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, lowest bit first."""
    ids = np.asarray(ids, dtype="<u8")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype="<u8")) & np.uint64(1), axis=None, bitorder="little").tobytes() if len(ids) else b""


def unpack(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """n ids from the first-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, hi - lo, lo), bitorder="little")[first * bits - 8 * lo :][: n * bits]
    return (flat.reshape(n, bits).astype("<u4") << np.arange(bits, dtype="<u4")).sum(1, dtype="<u4")


class Writer:
    """Streams documents to one file."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at, self.n = out, bits, len(MAGIC), 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.ends: list[int] = []
        self.blocks: list[int] = []
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.ends.append(self.n)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            data = pack(ids[k : min(k + BLOCK, full)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.array(self.ends, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.out.write(struct.pack("<5Q", self.bits, BLOCK, self.n, len(self.ends), len(self.blocks)))
        self.out.close()


class Reader:
    """One file: documents in order, or any of them. source: a stream that can seek, or the file's bytes. Only the parts of the footer and the blocks that are asked for are read; one block is held."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.source.size()
        if size < len(MAGIC) + 40 or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n, self.docs, self.blocks = struct.unpack("<5Q", self._at(size - 40, 40))
        self.footer = size - 40 - 8 * (self.docs + self.blocks)
        self.held, self.data = -1, b""

    def _at(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at)

    def _numbers(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(self.footer + 8 * first, 8 * n), "<u8").astype(np.int64)

    def ends(self, first: int, n: int) -> np.ndarray:
        """Ids of the file up to the end of each of n documents from the first-th on."""
        return self._numbers(first, n)

    def parts(self, first: int, n: int):
        """n ids from the first-th of the file on, block by block."""
        while n > 0:
            b, k = divmod(first, self.block)
            if b != self.held:
                at = int(self._numbers(self.docs + b, 1)[0])
                self.held, self.data = b, self._at(at, min(-(-self.block * self.bits // 8), self.footer - at))
            m = min(n, self.block - k)
            yield unpack(self.data, self.bits, k, m)
            first, n = first + m, n - m

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the first-th of the file on."""
        got = list(self.parts(first, n))
        return np.concatenate(got) if got else np.empty(0, "<u4")

    def doc(self, k: int) -> np.ndarray:
        start, end = (0, *self.ends(0, 1)) if k == 0 else self.ends(k - 1, 2)
        return self.ids(int(start), int(end - start))

    def checks(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of n documents from the first-th on: where they begin, their ids and the crc32 of these as little-endian 32-bit numbers. A long document is never held whole."""
        ends = self.ends(first, n)
        starts = np.concatenate([self.ends(first - 1, 1) if first else [0], ends[:-1]]).astype(np.int64)
        crc = []
        for a, size in zip(starts.tolist(), (ends - starts).tolist(), strict=True):
            c = 0
            for part in self.parts(a, size):
                c = zlib.crc32(part, c)
            crc.append(c)
        return starts, ends - starts, crc


def _parts(text: str) -> list[str]:
    """A long text cut at blanks where its tokens are cut too; a stretch without such a blank stays whole."""
    out, at = [], 0
    while len(text) - at > AT_ONCE:
        cut_at = SAFE.search(text, at + AT_ONCE // 2)
        if not cut_at:
            break
        out.append(text[at : cut_at.start()])
        at = cut_at.start()
    return [*out, text[at:]]


class Encoder:
    """Whole texts to ids as the tokenizer gives them.

    A byte-level BPE never joins a character that is no white space with a blank after it, so texts are cut before each
    blank, and each distinct piece of a batch is encoded once. Distinct pieces are encoded as one text and told apart
    by the tokens that begin with a blank. Texts with special tokens, with white space other than single blanks and
    line feeds, or with white space at an end go whole, as such cuts could change their tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kept, self.ids, self.begin, self.size = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.marks = np.array([str(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.tok.get_vocab_size())])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        parts = [(k, x) for k, t in enumerate(texts) for x in _parts(t)]
        ends = np.cumsum([len(x) for _, x in parts])
        ids, sizes, at = [np.empty(0, "<u4")], np.zeros(len(texts), np.int64), 0
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - len(parts[at][1]) + AT_ONCE, "right")))
            got = [e.ids for e in self.tok.encode_batch_fast([x for _, x in parts[at:to]], add_special_tokens=False)]
            ids.append(np.fromiter(itertools.chain.from_iterable(got), "<u4"))
            np.add.at(sizes, [k for k, _ in parts[at:to]], [len(x) for x in got])
            at = to
        return np.concatenate(ids), sizes

    def _after_blanks(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ids, _ = self._each([" " + " ".join(pieces[k : k + 256]) for k in range(0, len(pieces), 256)])
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(pieces) or at[0]:  # a vocabulary that marks blanks otherwise
            return self._each([" " + p for p in pieces])
        return ids, np.diff(np.append(at, len(ids)))

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each distinct piece where its own begin and how many they are. Short pieces, which come again, are kept."""
        place = pc.fill_null(pc.index_in(words, value_set=self.kept), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        fresh = words.take(pa.array(new))
        ids, n = self._after_blanks(fresh.to_pylist())
        old = len(self.kept)
        begin, size = np.concatenate([self.begin, len(self.ids) + np.cumsum(n) - n]), np.concatenate([self.size, n])
        place[new] = old + np.arange(len(new))
        every = np.concatenate([self.ids, ids])
        short = np.flatnonzero(pc.less_equal(pc.binary_length(fresh), LONG).to_numpy(zero_copy_only=False))[: max(0, CACHE - old)]
        if len(short):
            own = np.repeat((begin[old:] - len(self.ids))[short] - np.cumsum(n[short]) + n[short], n[short]) + np.arange(int(n[short].sum()))
            self.kept = pa.concat_arrays([self.kept, fresh.take(pa.array(short))])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(n[short]) - n[short]])
            self.ids, self.size = np.concatenate([self.ids, ids[own]]), np.concatenate([self.size, n[short]])
        return every, begin[place], size[place]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """texts: strings without nulls."""
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, ODD))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        out: list = [None] * len(texts)
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        ids, n = self._each(texts.take(pa.array(at)).to_pylist())
        for k, x in zip(at, np.split(ids, np.cumsum(n)[:-1]) if len(at) else (), strict=True):
            out[k] = x
        rest = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if not len(rest):
            return out
        parts = pc.split_pattern(texts.take(pa.array(rest)), " ")
        pieces, start = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        known = pieces.dictionary_encode()
        first = pieces.take(pa.array(start)).dictionary_encode()
        a, begin, n = self._known(known.dictionary)
        b, n_b = self._each(first.dictionary.to_pylist())
        code = known.indices.to_numpy().astype(np.int64)
        code[start] = first.indices.to_numpy().astype(np.int64) + len(n)
        ids, begin, n = np.concatenate([a, b]), np.concatenate([begin, len(a) + np.cumsum(n_b) - n_b]), np.concatenate([n, n_b])
        size = n[code]
        ends = np.cumsum(size)
        flat = ids[np.repeat(begin[code] - ends + size, size) + np.arange(int(ends[-1]))]
        for k, x in zip(rest, np.split(flat, (ends - size)[start[1:]]), strict=True):
            out[k] = x
        return out


def tokenizer_path(name: str) -> str:
    """A file of the installed tokenizers by its name, or a path as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _open(uri: str):
    """A stream to a temporary name beside uri, and what gives it its name: a file appears whole or not at all."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{os.urandom(8).hex()}"
    return store.open_output_stream(temporary), lambda: store.move(temporary, path)


def _input(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, key: str = "doc_id", text: str = "text", file_chars: int = 64 << 20) -> DataFrame:
    """Writes the ids of docs to files in folder, ascending by key (nulls first), and returns their manifest: file, row, key.

    Each range of keys is one task and one file, part-00000.tok and on, of about file_chars characters; a task that
    is run again writes the same file. Equal keys are ordered by their texts' hash.
    """
    total = docs.select(F.sum(F.length(text))).first()[0] or 0
    files = int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // file_chars)))
    h = F.xxhash64(text)
    dealt = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), h.alias("h")).repartitionByRange(files, "k", "h").sortWithinPartitions("k", "h").drop("h")

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.tok"
        encode = Encoder(tokenizer_path(tokenizer))
        writer, n = None, 0
        end = np.array([end_id], "<u4")
        keys = []
        for b in by_bytes(batches, "t", TOGETHER):
            if writer is None:
                out, done = _open(f"{folder}/{name}")
                writer = Writer(out, width(encode.tok.get_vocab_size()))
            for ids in encode(pc.fill_null(b.column("t"), "")):
                writer.add(np.concatenate([ids, end]))
            n += b.num_rows
            keys.append(b.column("k"))
        if writer:
            writer.close()
            done()
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.concat_arrays(keys)], ["file", "row", key])

    kind = docs.schema[key].dataType.simpleString()
    return cut(dealt.mapInArrow(run, f"file string, row long, `{key}` {kind}"))


def read(manifest: DataFrame, folder: str, docs: int = 8192) -> DataFrame:
    """(file, row, first, n_tokens, ids_crc32) of each document of the manifest's files in folder, from their bytes; first: ids of the same file before it.

    A task reads runs of docs documents, block by block, so that neither a file nor a document is ever held whole.
    """

    def run(batches):
        for b in batches:
            for name, first, n in zip(*(b.column(c).to_pylist() for c in ("file", "first", "n")), strict=True):
                with _input(f"{folder}/{name}") as source:
                    starts, sizes, crc = Reader(source).checks(first, n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first, first + n)), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], ["file", "row", "first", "n_tokens", "ids_crc32"])

    runs = manifest.groupBy("file", F.floor(F.col("row") / docs).alias("_run")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    return runs.select("file", "first", "n").mapInArrow(run, "file string, row long, first long, n_tokens long, ids_crc32 long")


def before(files: DataFrame) -> DataFrame:
    """(file, _before) of files (file, n): ids of all files before each, in the order of their numbers, however many digits those have. One row a file, of many MB each, so that one task can order them."""
    earlier = Window.orderBy(F.regexp_extract("file", "([0-9]+)", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))


def digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes docs to token files, reads them back and returns for each document key, start (ids of all documents before it), n_tokens and ids_crc32.

    A null text is empty and has the end id alone; an empty table writes no file and returns no row. Rows with equal
    keys or that repeat are all written. Other columns are ignored.
    """
    folder = folder or shared_dir(docs.sparkSession)
    manifest = write(docs, folder, tokenizer, end_id, key, text)
    if not manifest.head(1):
        return manifest.select(key, *[F.col("row").alias(c) for c in ("start", "n_tokens", "ids_crc32")])
    rows = cut(read(manifest, folder))
    files = before(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")))
    rows = rows.join(bounded(files, 64), "file")  # one row a file of many MB
    return manifest.join(rows, ["file", "row"]).select(key, (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
