"""Block-compressed text (BGZF, the gz of VCF and annotation files) as a source that splits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

HEAD = b"\x1f\x8b\x08\x04"  # gzip with an extra field
SPLIT = 32 << 20  # compressed bytes of one task
ROWS = 20_000  # lines of one Arrow batch


def open_input(path: str):
    """A random-access file of a local path or of any file system that Arrow reaches by its URI."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(urlparse(path).path)
    where, at = fs.FileSystem.from_uri(path)
    return where.open_input_file(at)


def block_size(head: bytes) -> int | None:
    """The whole size of the block whose first bytes these are; None if they begin no block."""
    if len(head) < 18 or head[:4] != HEAD:
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        tag, n = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if tag == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + n
    return None


def is_blocks(path: str) -> bool:
    """Whether the file is there, can be reached and begins with a block."""
    try:
        with open_input(path) as f:
            return block_size(f.read(64)) is not None
    except (OSError, ValueError, NotImplementedError):
        return False


def first_block(f, at: int, size: int) -> int:
    """Where the first block at or after `at` begins: a header whose size leads to another header, or to the end."""
    while at < size:
        f.seek(at)
        chunk = f.read(1 << 17)
        found = chunk.find(HEAD)
        while found >= 0:
            n = block_size(chunk[found : found + 64])
            if n and at + found + n <= size:
                f.seek(at + found + n)
                if at + found + n == size or block_size(f.read(64)):
                    return at + found
            found = chunk.find(HEAD, found + 1)
        at += max(len(chunk) - 64, 1)
    return size


def lines_between(path: str, start: int, stop: int) -> Iterator[bytes]:
    """Lines whose first byte lies in a block that begins in [start, stop), or right behind such a block.

    The text before the first line end belongs to the split before, which reads on to its end; so every line comes once.
    """
    with open_input(path) as f:
        size = f.size()
        at = first_block(f, start, size) if start else 0
        skip, tail, over = start > 0, b"", False
        while at < size:
            over = at >= stop
            if over and skip:  # no line begins in this split
                return
            f.seek(at)
            n = block_size(f.read(64))
            if n is None:
                raise ValueError(f"{path}: no block at byte {at}")
            f.seek(at)
            raw = f.read(n)
            extra = struct.unpack("<H", raw[10:12])[0]
            text = zlib.decompress(raw[12 + extra : -8], -15)
            if zlib.crc32(text) != struct.unpack("<I", raw[-8:-4])[0]:
                raise ValueError(f"{path}: the block at byte {at} is damaged")
            at += n
            *whole, tail = (tail + text).split(b"\n")
            if whole and skip:
                whole, skip = whole[1:], False
            elif skip:
                tail = b""
            if over:
                if whole:
                    yield whole[0]  # the line that began before `stop`
                    return
                continue
            yield from whole
        if tail and not skip:
            yield tail


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BlockReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.header = schema, options["path"], options.get("header", "false") == "true"
        self.wanted = [c for c in options.get("columns", "").split("\t") if c]
        self.split, self.filters = int(options.get("split", SPLIT)), []

    def partitions(self):
        with open_input(self.path) as f:
            size = f.size()
        return [Piece(self.path, at, min(at + self.split, size)) for at in range(0, max(size, 1), self.split)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not self.header:
            held: list[bytes] = []
            for line in lines_between(piece.path, piece.start, piece.stop):
                held.append(line.removesuffix(b"\r"))
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], names=["value"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], names=["value"])
            return
        names = header_of(piece.path)
        place = [names.index(c) for c in self.wanted]
        tests = [(names.index(c), {v.encode() for v in values if v is not None}) for c, values in self.filters]
        columns: list[list] = [[] for _ in place]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) for c in columns], names=self.wanted)

        first = piece.start == 0
        for line in lines_between(piece.path, piece.start, piece.stop):
            if first:
                first = False
                continue
            fields = line.removesuffix(b"\r").split(b"\t")
            if line == b"":
                continue
            if len(fields) != len(names):
                raise ValueError(f"{piece.path}: a row of {len(fields)} fields under a header of {len(names)}: {line[:200]!r}")
            if all(fields[k] in values for k, values in tests):
                for c, k in zip(columns, place):
                    c.append(fields[k] or None)
                if len(columns[0]) == ROWS:
                    yield batch()
                    columns = [[] for _ in place]
        yield batch()


class FilteringReader(BlockReader):
    def pushFilters(self, filters):
        """Equality of a text column is decided on the split line, before any other column is taken."""
        for f in filters:
            if self.header and isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            yield f  # Spark tests it again


def header_of(path: str) -> list[str]:
    return next(lines_between(path, 0, 1), b"").decode().removesuffix("\r").removeprefix("#").split("\t")


class Blocks(DataSource):
    """Format `bgzf`: options path, split (compressed bytes a task), and for tables header and columns (tab-separated names)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        columns = [c for c in self.options.get("columns", "").split("\t") if c]
        return ", ".join(f"`{c}` string" for c in columns) if columns else "value string"

    def reader(self, schema) -> BlockReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else BlockReader)(schema, self.options)  # Spark refuses the former where it does not push


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The lines of a block-compressed text as `value`, a task for every `split` compressed bytes."""
    spark.dataSource.register(Blocks)
    return spark.read.format("bgzf").option("split", split).load(path)


def read_columns(spark: SparkSession, path: str, columns: list[str], split: int = SPLIT) -> DataFrame:
    """Named columns of a block-compressed tab-separated table with a header (a leading # is not part of it), as strings.

    Other columns are never built; equality filters reach the parse where spark.sql.python.filterPushdown.enabled is
    set. A row that is not as long as the header fails the read; empty fields are null.
    """
    spark.dataSource.register(Blocks)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("bgzf").option("split", split).option("header", "true").option("pushdown", pushed).option("columns", "\t".join(columns)).load(path)
