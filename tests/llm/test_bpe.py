import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nitraflow.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = [" ", " ", "\n", "\t", "a", "B", "é", "'s", "'ll", "1", "\xa0", "　", "中", "\x1c", "\x85", "\r", "the", ".", "_", "!!", "aaa", "😀", "\0"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(bpe.codec(PATH, PATTERN).encode(text), "<u4").tolist()


def plain_merge(ranks, piece):
    """The textbook loop: merge the leftmost pair of lowest rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_equals_the_library(library, text):
    assert ids_of(text) == library.encode_ordinary(text)


def test_every_code_point(library):
    for form in ("a{}b", " {} {}1", "{}\n {}  {}x"):
        for lo in range(0, 0x30000, 256):
            text = "|".join(form.format(*[chr(i)] * 3) for i in range(lo, lo + 256) if not 0xD800 <= i < 0xE000)
            assert ids_of(text) == library.encode_ordinary(text), (form, hex(lo))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=2, max_size=6), st.integers(256, 300), max_size=20), st.text("abc", max_size=40))
def test_any_ranks_equal_the_textbook_loop(tmp_path_factory, extra, text):
    """Ranks in any order, also of tokens whose parts rank higher than they do."""
    ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, (t, _) in enumerate(sorted(extra.items(), key=lambda x: x[::-1]))}
    path = tmp_path_factory.mktemp("ranks") / "r"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    assert bpe.BytePairCodec(str(path), PATTERN).merge(text.encode()) == (plain_merge(ranks, text.encode()) if text else [])


def test_queue_orders_by_rank_then_position():
    queue, rnd, held = bpe.RankQueue(50_000), random.Random(5), []
    for _ in range(20_000):
        if held and rnd.random() < 0.45:
            assert queue.pop() == held.pop(held.index(min(held)))
        elif len(held) < 60:
            held.append((rnd.choice([0, 3, 255, 256, 49_999, rnd.randrange(50_000)]), rnd.randrange(10**6)))
            queue.push(*held[-1])
    assert [queue.pop() for _ in range(len(held) + 1)] == [*sorted(held), None]


def test_long_pre_tokens_take_little_more_than_linear_time(library):
    texts = ["".join(random.Random(n).choices("abcdefgh", k=n)) for n in (20_000, 200_000)] + ["ab" * 100_000, "a" * 200_001]
    took = []
    for t in texts:
        began = time.process_time()
        ids = ids_of(t)
        took.append(time.process_time() - began)
        assert ids == library.encode_ordinary(t)
    assert took[1] < 40 * took[0] and max(took) < 20


def test_memory_is_bounded_and_forgets_nothing_in_use():
    calls = []
    held = bpe._Generations(lambda k: calls.append(k) or k.encode(), 10)
    for i in range(200):
        assert held["often"] == b"often" and held[f"w{i}"] == f"w{i}".encode() and len(held) + len(held.old) <= 20
    assert calls.count("often") == 1 and held["x" * 300] == b"x" * 300 and "x" * 300 not in held


def test_operator(spark, docs_of, sample_docs, library):
    df = docs_of(AWKWARD).withColumns({"tokens": F.lit("own"), "decoded": F.lit(1)})
    rows = bpe.encode_texts(df, PATH, PATTERN).select("text", "decoded", "tokens.*").collect()
    assert len(rows) == len(AWKWARD) and all(r["ids"] == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["decoded"] == 1 for r in rows)
    assert bpe.encode_texts(df.limit(0), PATH, PATTERN).count() == 0
    lists = spark.createDataFrame([([1, 2],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode_ids(lists, PATH, PATTERN).collect()] == [library.decode_bytes([1, 2]), b"", b""]
    assert [bytes(r["packed"]) for r in bpe.packed_ids(lists).collect()] == [b"\1\0\0\0\2\0\0\0", b"", b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_ids(spark.createDataFrame([([1, 999_999],)], "ids array<int>"), PATH, PATTERN).collect()


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
