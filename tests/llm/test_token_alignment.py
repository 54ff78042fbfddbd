import hashlib
import random

from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nitraflow.llm import queries
from nitraflow.llm import token_alignment as ta

SETTINGS = ta.AlignSettings(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = [" ", " ", "\n", "\t", "a", "B", "é", ".", ",", "'s", "1", "\xa0", "　", "中", "<|endoftext|>", "<s>", "<0x41>", "\r", "\x1c", "\x85", "the", "word", "▁", "😀", "\0", "--", "of "]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """The tokens of a whole text by the libraries alone: (ids, ids), or None where bytes differ."""
    a = Tokenizer.from_file(SETTINGS.a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SETTINGS.b_path)
    byte_of = ta.byte_level_bytes()
    a_bytes = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        xs, ys = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        return (x, y, xs, ys) if b"".join(xs) == f" {text}".encode() == b"".join(ys) else None

    return tokens


def brute(tokens):
    """(links as pairs of positions, groups as pairs of lists of positions)"""
    if tokens is None:
        return [], []
    x, y, xs, ys = tokens
    ends = [np.cumsum([len(t) for t in side]).tolist() for side in (xs, ys)]
    begins = [[0, *e[:-1]] for e in ends]
    links = [(i, j) for i in range(len(x)) for j in range(len(y)) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]]
    groups, lo = [], 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        groups.append(([i for i, v in enumerate(ends[0]) if lo < v <= e], [j for j, v in enumerate(ends[1]) if lo < v <= e]))
        lo = e
    return links, groups


def expected(texts, plain):
    found = []
    for t in texts:
        tokens = plain(t)
        found.append((tokens, *brute(tokens)))
    counts = Counter(p for tokens, links, _ in found for p in {(tokens[0][i], tokens[1][j]) for i, j in links})
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for tokens, links, groups in found:
        ids = [(tokens[0][i], tokens[1][j]) for i, j in links]
        told = ";".join(",".join(str(tokens[0][i]) for i in g) + "|" + ",".join(str(tokens[1][j]) for j in h) for g, h in groups)
        yield (
            len(tokens[0]) if tokens else 0, len(tokens[1]) if tokens else 0, len(groups), len(links), sum(len(g) * len(h) for g, h in groups),
            sum(counts[p] == best[p[0]] for p in ids), sum(counts[p] for p in ids), hashlib.sha256(told.encode()).hexdigest() if tokens else "",
        )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
def test_blocks_are_those_of_the_whole_text(plain, text):
    held = ta.blocks(SETTINGS)
    index, first, valid = held.rows([text])
    tokens = plain(text)
    assert valid[0] == (tokens is not None)
    links, groups = brute(tokens)
    told = b";".join(held.text[i] for i in index.tolist()).decode()
    assert told == (";".join(",".join(str(tokens[0][i]) for i in g) + "|" + ",".join(str(tokens[1][j]) for j in h) for g, h in groups) if tokens else "")
    assert held.sizes[index].sum(0).tolist()[3:] == [len(links), sum(len(g) * len(h) for g, h in groups)]


def test_product_equals_dense_matrices():
    rnd = np.random.default_rng(4)
    for n, k, m in ((1, 1, 1), (5, 7, 3), (30, 40, 20), (4, 6, 0), (0, 3, 2)):
        x, y = rnd.random((n, k)) < 0.2, rnd.random((k, m)) < 0.2
        csr = lambda d: ta.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]).astype(np.int64), np.nonzero(d)[1], d.shape[1])
        got = ta.product(csr(x), csr(y))
        dense = np.zeros((n, m), int)
        dense[got.row_of(), got.column] = got.value
        assert (dense == x.astype(int) @ y.astype(int)).all() and (got.value > 0).all()
        back = csr(x).transposed()
        turned = np.zeros((k, n), bool)
        turned[back.row_of(), back.column] = True
        assert (turned == x.T).all()


@pytest.mark.parametrize("heavy", [400_000, 300, 0])
def test_scores_equal_brute_force(spark, docs_of, sample_docs, plain, heavy):
    """With all counts broadcast, some of them and none."""
    rnd = random.Random(8)
    texts = [r["text"] for r in sample_docs.orderBy("doc_id").limit(25).collect() if len(r["text"]) < 3000] + ["".join(rnd.choices(ALPHABET, k=12)) for _ in range(30)]
    texts += [t for t in AWKWARD if not t or len(t) < 1000] + ["x" * 3000, "ab " * 300]
    df = docs_of(texts).withColumns({c: F.lit("own") for c in ("row", "alignment", "more", "n_docs", "a_id", "rest", "link", "best")})
    rows = ta.alignment_scores(df.repartition(4), replace(SETTINGS, heavy=heavy, piece_chars=2000, held_chunks=50)).collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(rows) == len(texts) and all(r["row"] == r["best"] == "own" for r in rows) and "text" not in rows[0].asDict()
    assert [got[i] for i in range(len(texts))] == list(expected(texts, plain))


def test_align_texts(spark, docs_of, plain):
    texts = ["Hello, world.  It's 12 o'clock\nnow", "", None, "▁", "naïve 中文 😀", "word " * 500, " lead and trail "]
    rows = ta.align_texts(docs_of(texts).repartition(2), replace(SETTINGS, piece_chars=100)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = plain(r["text"])
        links, groups = brute(tokens)
        x = r["alignment"]
        assert (x["a_ids"], x["b_ids"]) == (tokens[:2] if tokens else ([], []))
        assert [(p["a_token"], p["b_token"]) for p in x["links"]] == links
        assert [(g["a_end"], g["b_end"]) for g in x["groups"]] == [(a[-1] + 1, b[-1] + 1) for a, b in groups]
        if tokens:
            assert sum(p["n_bytes"] for p in x["links"]) == len(f" {r['text']}".encode())
    assert ta.align_texts(docs_of(texts).limit(0), SETTINGS).count() == 0


def test_long_and_repeated_rows_and_empty_tables(spark, docs_of):
    long = "so many words " * 20_000
    df = docs_of([(1, long, "s"), (1, long, "s"), (None, "x" * 100_000, None), (3, None, "s")])
    rows = ta.alignment_scores(df, SETTINGS).collect()
    assert len(rows) == 4 and len({tuple(r[c] for c in COLUMNS) for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["count_sum"] >= 2 * r["n_links"] > 0 for r in rows if r["doc_id"] == 1)
    assert ta.alignment_scores(df.limit(0), SETTINGS).count() == 0


def test_query_equals_brute_force(spark, sample_docs, plain):
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = sample_docs.select("doc_id", "text").collect()
    small = [d for d in docs if len(d["text"] or "") < 2500]
    for d in small:
        tokens = plain(d["text"])
        links, groups = brute(tokens)
        assert rows[d["doc_id"]][:4] == (len(tokens[0]), len(tokens[1]), len(groups), len(links)) if tokens else (0, 0, 0, 0)
    assert len(rows) == len(docs) and len(small) > 100
