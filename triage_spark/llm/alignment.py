"""Token ids of two tokenizers that stand over the same bytes, in Arrow tables; counts of id pairs merged by Spark."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from triage_spark.llm.common import stored

PART = 1 << 18  # bytes of text whose documents are aligned, stored and looked up together
BATCH_ROWS = 512  # documents that reach Python at a time
LINKS = 1 << 21  # links that are laid out at a time
WIDTH = 32  # bits of the second id in a pair
_MODELS: dict[tuple, tuple] = {}


def models(ranks_path: str, pattern: str, piece_path: str) -> tuple:
    """Both tokenizers, and the bytes of each id as an Arrow array."""
    which = ranks_path, pattern, piece_path
    if which not in _MODELS:
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            first_bytes[i] = token
        second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        second_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]
        _MODELS[which] = first, second, pa.array(first_bytes, pa.binary()), pa.array(second_bytes, pa.binary())
    return _MODELS[which]


def lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def segmented_ends(tokens: pa.ListArray, byte_of: pa.Array) -> tuple[pa.Table, pa.BinaryArray]:
    """A row for each token: its document, id and the end of its bytes there; and the bytes of all tokens."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    own = pc.take(byte_of, ids)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(own), pa.int64()))
    starts = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])[tokens.offsets.to_numpy()[:-1]]  # bytes before each document
    end = pc.subtract(total, pc.take(pa.array(starts), doc))
    return pa.table({"doc": pc.cast(doc, pa.int64()), "id": ids, "end": end, "row": pa.array(np.arange(len(ids)))}), own


def agrees(tokens: pa.ListArray, own: pa.BinaryArray, texts: list[bytes]) -> list[bool]:
    """Whether each document's token bytes, joined, are its text."""
    buffers = own.buffers()
    at = np.frombuffer(buffers[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
    data = memoryview(buffers[2]) if len(own) and buffers[2] is not None else memoryview(b"")
    cut = at[tokens.offsets.to_numpy()].tolist()
    return [bytes(data[a:z]) == t for a, z, t in zip(cut, cut[1:], texts)]


def joined(ids: pa.Array, starts: np.ndarray, separator: str) -> pa.StringArray:
    """The items between each start and the next, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), ids), separator)


def bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def align(texts: list[str | None], model: tuple) -> dict:
    """Groups, links and pairs of a few documents: arrays by document, and the distinct pairs of the whole part.

    pairs: distinct id pairs (first id << WIDTH | second id) with the number of documents that hold them; of: for each
    document, by pair, where its pairs are among those and how many links they have.
    """
    first, second, first_bytes, second_bytes = model
    n = len(texts)
    whole = [b" " + t.encode() if t else b"" for t in texts]
    some = [t or "" for t in texts]
    a_ids = [first.encode_ordinary(" " + t) if t else [] for t in some]
    b_ids = second.encode(some, num_threads=1)
    a_lists, b_lists = lists(a_ids), lists(b_ids)
    (a, a_own), (b, b_own) = segmented_ends(a_lists, first_bytes), segmented_ends(b_lists, second_bytes)
    fit = [x and y for x, y in zip(agrees(a_lists, a_own, whole), agrees(b_lists, b_own, whole))]
    if not all(fit):  # documents whose bytes differ have no tokens
        keep = [[] if not f else i for f, i in zip(fit, a_ids)], [[] if not f else i for f, i in zip(fit, b_ids)]
        a_lists, b_lists = map(lists, keep)
        (a, _), (b, _) = segmented_ends(a_lists, first_bytes), segmented_ends(b_lists, second_bytes)
    met = a.select(["doc", "end", "row"]).join(b.select(["doc", "end", "row"]), ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    group, start = [], []
    for tokens, rows in ((a, met["row"]), (b, met["row_b"])):
        ends = np.zeros(tokens.num_rows + 1, np.int64)  # 1 behind each token that ends a group
        ends[rows.to_numpy() + 1] = 1
        group.append(np.cumsum(ends[:-1]))
        start.append(np.concatenate([[0], np.sort(rows.to_numpy()) + 1]))
    groups = met.num_rows
    group_doc = a["doc"].to_numpy()[start[0][:-1]] if groups else np.zeros(0, np.int64)
    sizes = [np.diff(s) for s in start]
    of_doc = bounds(group_doc, n)
    texts_of = [joined(pc.cast(t["id"].combine_chunks(), pa.string()), s, ",") for t, s in ((a, start[0]), (b, start[1]))]
    by_group = pc.binary_join_element_wise(*texts_of, "|")
    written = joined(by_group, of_doc, ";")
    pair, doc, times = pairs_of(a, b, group[0], start[1], sizes)
    names, where = np.unique(pair, return_inverse=True)
    held = np.bincount(where, minlength=len(names))
    order = np.lexsort((where, doc))
    doc, where, times = doc[order], where[order].astype(np.int32), times[order].astype(np.int32)
    cut = bounds(doc, n).tolist()
    step = np.diff(where, prepend=0).astype(np.int32)  # small numbers, which compress well
    links = np.concatenate([[0], np.cumsum(sizes[0] * sizes[1])])[of_doc]
    return {
        "n_a": np.diff(a_lists.offsets.to_numpy()), "n_b": np.diff(b_lists.offsets.to_numpy()), "n_groups": np.diff(of_doc), "n_links": np.diff(links),
        "groups_sha256": [hashlib.sha256(w.as_buffer()).hexdigest() if w.as_buffer().size else "" for w in written],
        "steps": [step[x:z].tobytes() for x, z in zip(cut, cut[1:])], "begin": [int(where[x]) if z > x else 0 for x, z in zip(cut, cut[1:])], "times": [times[x:z].tobytes() for x, z in zip(cut, cut[1:])],
        "pairs": names, "held": held,
    }


def pairs_of(a: pa.Table, b: pa.Table, group: np.ndarray, b_start: np.ndarray, sizes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct (pair, document) with the number of links, from all pairs of tokens in a group, LINKS at a time."""
    a_id, a_doc, b_id = a["id"].to_numpy(), a["doc"].to_numpy(), b["id"].to_numpy()
    many = sizes[1][group] if len(group) else np.zeros(0, np.int64)  # partners of each first token
    total = np.concatenate([[0], np.cumsum(many)])
    found, at = [], 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, total[at] + LINKS, "right")) - 1)
        row = np.repeat(np.arange(at, to), many[at:to])
        partner = b_start[group[row]] + np.arange(total[at], total[to]) - total[row]
        table = pa.table({"pair": a_id[row].astype(np.int64) << WIDTH | b_id[partner], "doc": a_doc[row]})
        found.append(table.group_by(["pair", "doc"], use_threads=False).aggregate([([], "count_all")]))
        at = to
    if not found:
        return (np.zeros(0, np.int64),) * 3
    every = pa.concat_tables(found)
    if len(found) > 1:
        every = every.group_by(["pair", "doc"], use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["pair", "doc", "count_all"])
    return tuple(every[c].to_numpy() for c in ("pair", "doc", "count_all"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, ranks_path: str, pattern: str, piece_path: str, key: str, text: str) -> DataFrame:
    """Stored rows of two kinds: one for each document, and one for each part with its pairs (`pairs`, `held`)."""
    kind = docs.schema[key].dataType
    fields = [("part", pa.int64()), ("key", to_arrow_type(kind)), *((c, pa.int64()) for c in NUMBERS), ("groups_sha256", pa.string()), ("begin", pa.int32()), ("steps", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
    out_schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = models(ranks_path, pattern, piece_path), TaskContext.get().partitionId() << 32

        def flush(keys: pa.Array, texts: list) -> pa.RecordBatch:
            d = align(texts, model)
            n = len(texts)
            last = [None] * n
            columns = [
                pa.array([part] * (n + 1), pa.int64()), pa.concat_arrays([keys.cast(fields[1][1]), pa.nulls(1, fields[1][1])]), *(pa.array([*d[c].tolist(), None], pa.int64()) for c in NUMBERS),
                pa.array([*d["groups_sha256"], None], pa.string()), pa.array([*d["begin"], None], pa.int32()), pa.array([*d["steps"], None], pa.binary()), pa.array([*d["times"], None], pa.binary()),
                pa.array([*last, d["pairs"]], pa.list_(pa.int64())), pa.array([*last, d["held"]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=out_schema)

        for b in batches:
            at = size = 0
            lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for k, length in enumerate(lengths):
                size += length
                if size >= PART or k == b.num_rows - 1:
                    yield flush(b.column(0)[at : k + 1], b.column(1)[at : k + 1].to_pylist())
                    pa.default_memory_pool().release_unused()
                    at, size, part = k + 1, 0, part + 1

    types = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType(), pa.list_(pa.int64()): T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField(n, kind if n == "key" else types[t]) for n, t in fields])
    return stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), batch_rows=BATCH_ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b and count: in how many documents the two ids are linked; best: whether no other b has more documents for this a."""
    found = rows.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counts = stored(found.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count")))
    counts = counts.withColumn("a", F.shiftright("pair", WIDTH)).withColumn("b", F.col("pair").bitwiseAND((1 << WIDTH) - 1))
    most = stored(counts.groupBy("a").agg(F.max("count").alias("most")))
    return counts.join(most, "a").select("a", "b", "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, ranks_path: str, pattern: str, piece_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the corpus-wide counts of id pairs.

    The first tokenizer encodes a space and the text, the second adds that space itself. Ends of tokens that both
    share cut a document into groups; all pairs of tokens in a group are links. Documents are taken in
    parts of PART bytes of text (a longer text is a part): tokens become Arrow lists, flattened with their parents, ends are segmented
    sums, shared ends a hash join on (document, end), pairs are counted by group_by, and each part hands Spark its distinct pairs with a
    partial count. The merged counts go back to the parts that asked for them, at most one row a pair and part, so
    nothing is broadcast and a very common pair is a row a part.

    The documents: key, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their first id, ties too), count_sum
    (over links), groups_sha256. The counts: a, b, pair, count, best. Null and empty texts, and those whose token bytes are not their text,
    have no tokens: zeros and ''. Rows stay one by one, with null or repeated keys too; repeated rows are
    documents of their own; very long texts are whole; other columns are not read; an empty table gives no rows.
    """
    rows = aligned(docs, ranks_path, pattern, piece_path, key, text)
    counts = stored(pair_counts(rows))
    asked = rows.filter("pairs IS NOT NULL").select(F.col("part").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts.select("pair", "count", "best"), "pair").select("asker", "at", "count", "best")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in (*NUMBERS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        sums: list[list[int]] = [[], []]
        for begin, steps, times in zip(left["begin"].to_pylist(), left["steps"], left["times"]):
            where = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32))
            if len(where):
                where += begin - where[0]
            n = np.frombuffer(times.as_buffer(), np.int32).astype(np.int64)
            sums[0].append(int((n * best[where]).sum()))
            sums[1].append(int((n * count[where]).sum()))
        return pa.table([left["key"], *(left[c] for c in NUMBERS), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), left["groups_sha256"]], names=[key, *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    held = rows.filter("pairs IS NULL").drop("pairs", "held")
    return held.groupBy("part").cogroup(answers.groupBy("asker")).applyInArrow(look_up, schema), counts
