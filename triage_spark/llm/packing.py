"""Token sequences of near equal length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from triage_spark.llm.common import trim

UNSAFE = re.compile(r"\s \s|\s \Z")  # white space that a cut before each space would split differently
CACHE = 100_000  # words
FLUSH = 1 << 19  # ids that one batch brings out of Python
CHUNK = 2048  # pieces that one differencing takes together
SHARE = 32_768  # pieces, as estimated, of one partition
_ENCODERS: dict[tuple, "Encoder"] = {}


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file (JSON) with their ids: strings that stand for one id wherever they occur."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder(dict):
    """Text to ids as little-endian uint32 bytes; keeps the ids of words that follow a space.

    Cutting before a space never changes the ids, but in runs of white space; those texts go whole. The words
    that a text adds are encoded together: a token that begins with a space begins the next word. Added tokens
    are found first, and what stands between them is encoded on its own.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        self.added = {t: np.asarray([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.bpe = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self.ordinary(part) for part in self.split.split(text) if part)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.whole(text)
        head, *words = text.split(" ")
        found = list(map(self.get, words))
        if None in found:
            new = [w for w, v in zip(words, found) if v is None]
            made = iter(self.add(new))
            found = [next(made) if v is None else v for v in found]
        return b"".join([self.whole(head), *found])

    def add(self, new: list[str]) -> list[bytes]:
        text = " " + " ".join(new)
        if not UNSAFE.search(text):
            ids = np.asarray(self.bpe.encode_ordinary(text), dtype="<u4")
            data, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
            made = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
        else:
            made = [self.whole(" " + w) for w in new]
        if len(self) + len(new) > CACHE:
            self.clear()
        self.update(zip(new, made) if len(text) < 40 * len(new) else ((w, v) for w, v in zip(new, made) if len(w) <= 40))
        return made


def encoder(ranks_path: str, pattern: str, added: dict[str, int]) -> Encoder:
    which = ranks_path, pattern, tuple(added.items())
    if which not in _ENCODERS:
        _ENCODERS[which] = Encoder(ranks_path, pattern, added)
    return _ENCODERS[which]


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows first, what remains in pieces of at most `piece`."""
    full = n // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def differencing(sizes: list[int], m: int) -> tuple[np.ndarray, int]:
    """Bin of each size among m bins, and the largest bin, by Karmarkar-Karp.

    Every size begins as a partition of its own. The two partial partitions of largest spread are merged,
    the fullest bin of one with the emptiest of the other, until one partition is left; the merges are
    then undone from the top to name each size's bin.
    """
    heap, nodes = [], []
    for k, size in enumerate(sizes):
        nodes.append(None)
        heap.append((-size, k, np.array([size], dtype=np.int64)))
    heapq.heapify(heap)

    def wide(v: np.ndarray) -> np.ndarray:  # descending loads of all bins, stored without the empty tail
        return v if len(v) == m else np.concatenate([v, np.zeros(m - len(v), dtype=np.int64)])

    while len(heap) > 1:
        (_, a, va), (_, b, vb) = heapq.heappop(heap), heapq.heappop(heap)
        if len(va) + len(vb) <= m:  # the fullest of each meets an empty bin of the other
            v = np.concatenate([va, vb])
        else:
            v = wide(va) + wide(vb)[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        nodes.append((a, b, len(va), len(vb), order))
        heapq.heappush(heap, (-int(v[0] - (v[-1] if len(v) == m else 0)), len(nodes) - 1, v))
    bins = np.zeros(len(sizes), dtype=np.int64)
    stack = [(heap[0][1], np.arange(m))]
    while stack:
        k, names = stack.pop()  # names: the bin of each place of this node's loads
        if nodes[k] is None:
            bins[k] = names[0]
            continue
        a, b, la, lb, order = nodes[k]
        place = np.empty(m, dtype=np.int64)
        place[order] = names[: len(order)]
        if len(order) < m:
            place[len(order) :] = names[len(order) :]
        if la + lb <= m:
            rest = place[la + lb :]
            stack += [(a, np.concatenate([place[:la], place[la : la + lb], rest])), (b, np.concatenate([place[la : la + lb], place[:la], rest]))]
        else:
            stack += [(a, place), (b, place[::-1])]
    return bins, int(heap[0][2][0])


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each size: as few near-equal windows as fit; one more whenever the fullest is too full."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        bins, most = differencing(sizes, m)
        if most <= capacity:
            return bins
        m += 1


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    piece: int = 256,
    end_id: int = 0,
    with_ids: bool = False,
    added: dict[str, int] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenise whole texts (null: empty) and pack their ids, each followed by end_id, into sequences.

    `added` holds strings that are one id (see added_tokens); without it their text is ordinary text.
    Texts are cut into full windows and, for what remains, pieces; only piece lengths and checksums are
    shuffled (ids too with with_ids). Pieces are dealt evenly by hash, and each partition packs runs of CHUNK
    pieces by differencing. Rows repeat freely and each is packed, null keys are kept, an empty table gives
    no rows; equal pieces are interchangeable. A very long text becomes many pieces and is held by one task while it is
    encoded. Only key and text are read, so other columns may have any name.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id (unique, not dense), offset[, ids: little-endian uint32].
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(ranks_path, pattern, added or {}), np.asarray([end_id], dtype="<u4").tobytes()
        out: list[list] = [[] for _ in fields]
        held = 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(t.as_py() or "") + end
                n = len(ids) // 4
                for s, length in cuts(n, capacity, piece):
                    part = ids[4 * s : 4 * (s + length)]
                    for c, v in zip(out, (k, s, length, zlib.crc32(part), n, part)):
                        c.append(v)
                    held += length
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, arrow)], names=names)
                        out, held = [[] for _ in fields], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, arrow)], names=names)
        out.clear(), enc.clear()
        trim()

    names = [f.name for f in fields]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    pieces = docs.select(key, text).mapInArrow(encode, T.StructType(fields))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    parts = max(1, -(-(rows + (size or 0) // capacity) // SHARE))
    dealt = pieces.repartition(parts, F.xxhash64(key, "start", "ids_crc32")).sortWithinPartitions(key, "start", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, held, waiting = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            t = pa.Table.from_batches(held).combine_chunks()
            length = t["length"].to_numpy()
            full = length == capacity
            seq = np.empty(len(length), dtype=np.int64)
            seq[full] = next_id + np.arange(full.sum())
            next_id += int(full.sum())
            if (~full).any():
                bins = windows(length[~full].tolist(), capacity)
                used, dense = np.unique(bins, return_inverse=True)
                seq[~full] = next_id + dense
                next_id += len(used)
            order = np.argsort(seq, kind="stable")
            run = np.cumsum(length[order]) - length[order]
            first = np.r_[True, seq[order][1:] != seq[order][:-1]]
            offset = np.empty_like(seq)
            offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
            t = t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
            return t.select(out_names).combine_chunks().to_batches()[0]

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                held.append(part)
                waiting += part.num_rows
                if waiting >= CHUNK:
                    yield flush()
                    held, waiting = [], 0
        if waiting:
            yield flush()

    at = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*fields[:5], *at, *fields[5:]])
    out_names = [f.name for f in schema]
    return dealt.mapInArrow(place, schema)
