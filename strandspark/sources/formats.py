"""Data sources: numbered lines of text files, and files of sequences to read and to write.

spark.read.format("numbered_lines").load(path), spark.read.format("sequences").option("kind", "fasta").load(path) and
df.write.format("sequences").option("kind", "fasta").mode("append").save(path), after register(spark). A path is a
file, a folder or a pattern in its last part, local or of any file system that pyarrow knows by its scheme. Names that
begin with "_" or "." are no data.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of a file of sequences that one task reads, unless the option split_bytes says otherwise.
SPLIT = 64 << 20
#: A batch is sent on when it has so many rows or letters.
BATCH, LETTERS = 4096, 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), posixpath.abspath(path))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path names, by name; none raises an error."""
    store, own = _open(path)
    scheme = path[: path.index(own)] if ":/" in path and own in path else ""
    info = store.get_file_info(own)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        folder, pattern = (own, "*") if info.type == pafs.FileType.Directory else posixpath.split(own)
        listed = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = [x for x in listed if x.type == pafs.FileType.File and x.base_name[0] not in "_." and fnmatch.fnmatchcase(x.base_name, pattern)]
    if not found and info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    return sorted((scheme + x.path, x.size) for x in found)


@dataclass
class Piece(InputPartition):
    """Bytes start to end of a file."""

    path: str
    start: int
    end: int


class _Lines(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        return [Piece(p, 0, size) for p, size in files(self.path)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        store, own = _open(piece.path)
        with store.open_input_stream(own) as raw:  # by its name's end, compressed files are read as what they hold
            lines = (line.rstrip("\n").removesuffix("\r") for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"))
            first = 0
            for rows in _batches((line,) for line in lines):
                yield _batch(["file", "k", "line"], [posixpath.basename(own)] * len(rows), range(first, first + len(rows)), [r[0] for r in rows])
                first += len(rows)


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """rows, some at once: few where they are long."""
    out, letters = [], 0
    for row in rows:
        out.append(row)
        letters += len(row[-1])
        if len(out) >= BATCH or letters >= LETTERS:
            yield out
            out, letters = [], 0
    if out:
        yield out


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    kinds = {"k": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)


class NumberedLines(DataSource):
    """(file, k, line): the lines of each file, counted from 0, without what ends them. A file is one task, read line by line, so that a task holds some lines of it whatever its size."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, k int, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Lines(self.options["path"])


def _fasta(name: str | None, sequence: str) -> str:
    return f">{name or ''}\n{sequence}\n"


def _plain(_name: str | None, sequence: str) -> str:
    return f"{sequence}\n"


def _seq(name: str | None, sequence: str) -> str:
    return f";\n{name or ''}\n\n{sequence}1\n"


def _record(kind: str, lines: list[str]) -> tuple[str | None, str]:
    """(name, sequence) of a record's lines."""
    if kind == "in":
        return None, lines[0]
    if kind == "fasta":
        return lines[0][1:].strip(), "".join(x.strip() for x in lines[1:])
    return lines[0].strip(), "".join(x.strip() for x in lines[1:]).removesuffix("1")


#: By kind: what begins a record's first line (None: every line that is not empty is a record) and how one is written.
KINDS = {"fasta": (">", _fasta), "in": (None, _plain), "seq": (";", _seq)}


def _kind(options) -> str:
    kind = options.get("kind", "fasta")
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}; there are {', '.join(KINDS)}")
    return kind


class _Records(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split

    def partitions(self) -> list[Piece]:
        return [Piece(p, at, min(at + self.split, size)) for p, size in files(self.path) for at in range(0, size, self.split)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece is None:
            return
        for rows in _batches(_record(self.kind, own) for own in self._own(piece)):
            yield _batch(["name", "sequence"], *zip(*rows, strict=True))

    def _own(self, piece: Piece) -> Iterator[list[str]]:
        """The records whose first line begins within the piece; the last one may end beyond it."""
        store, path = _open(piece.path)
        mark = KINDS[self.kind][0]
        with store.open_input_file(path) as raw:
            at = piece.start
            raw.seek(max(at - 1, 0))
            buffered = io.BufferedReader(raw, 1 << 20)
            if at:
                at += len(buffered.readline()) - 1  # a line that began before the piece, or the end of the line before it
            record: list[str] | None = None
            comment = None  # where the comment just before this line begins
            for line in buffered:
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if mark == ";":  # the last comment before other lines begins a record
                    remark, begins, began = text.startswith(mark), comment is not None and not text.startswith(mark), comment
                else:
                    remark, begins, began = False, bool(text) if mark is None else text.startswith(mark), at
                if begins:
                    if record is not None:
                        yield record
                    if began >= piece.end:
                        return
                    record = [text]
                elif record is not None and not remark:
                    record.append(text)
                elif record is None and not remark and at >= piece.end:
                    return
                comment, at = at if remark else None, at + len(line)
            if record is not None:
                yield record


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the job's own folder, or None for a task without rows."""

    path: str | None


class _Writer(DataSourceWriter):
    """Every attempt of a task writes a file of its own into a folder of the job. Only when all tasks are done are the files of those that count moved to where readers look; a job whose tasks fail leaves none. A driver that is lost while files are moved leaves those moved by then."""

    def __init__(self, path: str, kind: str, columns: list[str], overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.job = uuid.uuid4().hex
        lower = [c.lower() for c in columns]
        if "sequence" not in lower:
            raise ValueError(f"no column sequence among {columns}")
        self.at = (lower.index("name") if "name" in lower else None, lower.index("sequence"))
        # Made here and not by tasks, so that a task that outlives its failed job has nowhere to write.
        _open(path)[0].create_dir(self.folder)

    @property
    def folder(self) -> str:
        return posixpath.join(_open(self.path)[1], f"_writing-{self.job}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, _ = _open(self.path)
        name, sequence = self.at
        put = KINDS[self.kind][1]
        first = next(rows, None)
        if first is None:
            return Written(None)
        path = posixpath.join(self.folder, f"part-{uuid.uuid4().hex}.txt")
        with store.open_output_stream(path) as raw, io.BufferedWriter(raw, 1 << 20) as out:
            for row in _chain(first, rows):
                out.write(put(None if name is None else row[name], row[sequence] or "").encode())
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        store, own = _open(self.path)
        old = [x.path for x in store.get_file_info(pafs.FileSelector(own)) if x.type == pafs.FileType.File and x.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, posixpath.join(own, posixpath.basename(m.path)))
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        if store.get_file_info(self.folder).type == pafs.FileType.Directory:
            store.delete_dir(self.folder)


def _chain(first, rest):
    yield first
    yield from rest


class Sequences(DataSource):
    """(name, sequence) of files of kind fasta, in (a sequence a line, no name) or seq. Files are read by ranges of split_bytes, each record by the task in whose range it begins.

    A null sequence is written as an empty one, a null name too. Rows keep no order across tasks. Of lines without text
    none is a record, so that empty sequences of kind in are not read back.
    """

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "name string, sequence string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Records(self.options["path"], _kind(self.options), int(self.options.get("split_bytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], _kind(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    for source in (NumberedLines, Sequences):
        spark.dataSource.register(source)
