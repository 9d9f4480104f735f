"""Alignment of two tokenizers beside a plain loop over tokens, with the JSON tokenizer file and the piece model."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from triage_spark.llm import alignment, queries

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def byte_level():
    """The characters by which a byte-level vocabulary writes its bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(docs):
    """What the contract asks for, document by document."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    letters = byte_level()
    counts, parts = Counter(), {}
    for k, text in docs:
        a = [] if not text else [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [] if not text else [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []

        def ends(tokens):
            out, at = [], 0
            for i, x in tokens:
                at += len(x)
                out.append((at, i))
            return out

        ea, eb = ends(a), ends(b)
        cuts = sorted({e for e, _ in ea} & {e for e, _ in eb})
        groups, before = [], 0
        for c in cuts:
            groups.append(([i for e, i in ea if before < e <= c], [i for e, i in eb if before < e <= c]))
            before = c
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(set(links))
        parts[k] = (len(a), len(b), groups, links)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = {}
    for k, (na, nb, groups, links) in parts.items():
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        rows[k] = (na, nb, len(groups), links.total(), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if na else "")
    return rows, counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op12(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 8000]
    whole = {r["doc_id"]: r for r in queries.op12_alignment(spark, SF).collect()}
    assert len(whole) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(r["n_a"] > 0 for r in whole.values())
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows, counts = alignment.align_tokenizers(df, *PATHS)
    want, want_counts = plain(docs)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows.collect()} == want
    assert {(r["a"], r["b"]): r["count"] for r in counts.collect()} == dict(want_counts)
    for k in want:  # what does not depend on the other documents
        assert tuple(whole[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == want[k][:4] + want[k][6:]


@pytest.mark.parametrize("part", [1 << 20, 60])
def test_op12_odd_input(spark, monkeypatch, part):
    """Nulls, blanks, special tokens and control pieces as text, other scripts, odd white space, long texts; also in tiny parts."""
    monkeypatch.setattr(alignment, "PART", part)
    texts = [None, "", " ", "  two  spaces ", "a\tb\nc", "<|endoftext|> and <s> </s> <unk>", "▁x ▁", "naïve 中文 \U0001f600\U0001f44d\U0001f3fd", " 　x", "éＡ", "same words same words", "same words same words", "<0x41>", "\x00\x07"]
    texts.append(" ".join(f"word{k % 97}x{k}" for k in range(4000)))
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_a long")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(df, *PATHS)[0].collect()}
    assert got == plain(list(enumerate(texts)))[0]
    if part == 60:
        assert alignment.align_tokenizers(df.limit(0), *PATHS)[0].count() == 0
        odd = spark.createDataFrame([(None, "hello there"), (None, None), ("k", "hello there"), ("k", "hello there")], "text2 string, text string")
        rows = alignment.align_tokenizers(odd, *PATHS, key="text2")[0].collect()
        assert sorted((r["text2"] or "", r["n_a"], r["count_sum"]) for r in rows) == [("", 0, 0), ("", 2, 9), ("k", 2, 9), ("k", 2, 9)]  # three links, each in three documents


def test_links_laid_out_in_slices(monkeypatch):
    model = alignment.models(*PATHS)
    texts = ["one two three 中文 four", "four three " * 30]
    want = alignment.align(texts, model)
    monkeypatch.setattr(alignment, "LINKS", 3)
    got = alignment.align(texts, model)
    assert all(str(got[k]) == str(want[k]) for k in want)
