import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st

from nitraflow.llm import token_files
from nitraflow.llm.wordhash import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", " ", "\n", "\t", "a", "B", "é", "×", ".", ",", "'s", "'ll", "1", "\xa0", " ", "　", "—", "“", "中", "<|endoftext|>", "\r", "\x1c", "\x85", "?", "the", "​", "😀"]


def whole(text):
    return [*token_files.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join), max_size=4))
def test_chunks_encode_like_the_whole_text(texts):
    ids, first = token_files.encoder(PATH).encode(*utf8(pa.array(texts, pa.string())), 2)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [whole(t) for t in texts]


def test_cache_is_bounded():
    small = token_files.ChunkEncoder(PATH, held=50, fresh=10)
    for i in range(20):
        ids, _ = small.encode(*utf8(pa.array([" ".join(f"w{i}x{j}" for j in range(30))])), 2)
        assert len(small.at) <= 90
        assert ids.tolist() == whole(" ".join(f"w{i}x{j}" for j in range(30)))


def round_trip(spark, df, path):
    token_files.write_token_files(df, path, PATH)
    rows = token_files.read_tokens(spark, path)
    at = 0
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(whole(r["text"]))
    found = sorted(rows.collect(), key=lambda r: r["start"])
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        texts[r["doc_id"]].remove(list(r["ids"]))
        at += r["n_tokens"]
    assert not any(texts.values()) and [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in found)
    sums = {(r["start"], r["ids_crc32"]) for r in token_files.with_checksum(rows).collect()}
    assert sums == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in found}


def test_round_trip(spark, sample_docs, docs_of, tmp_path):
    round_trip(spark, sample_docs, str(tmp_path / "a"))
    round_trip(spark, docs_of([(i // 2, t, "s") for i, t in enumerate(AWKWARD)]), str(tmp_path / "b"))


def test_other_tokenizers_encode_whole_texts():
    other = token_files.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello, world.  It's 12 o'clock\nnow", "", None, " a  b "]
    ids, first = other.encode(*utf8(pa.array(texts, pa.string())), 2)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [[*other.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_selective_reads_and_encodings(spark, sample_docs, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(sample_docs, path, PATH)
    some = token_files.read_tokens(spark, path, 10, 20)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(10, 21))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().toString()
    assert "ids" not in token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    part = pq.ParquetFile(next((tmp_path / "t/tokens").glob("*.parquet"))).metadata.row_group(0)
    columns = {part.column(i).path_in_schema: part.column(i) for i in range(part.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)


def test_empty_table(spark, sample_docs, tmp_path):
    token_files.write_token_files(sample_docs.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.with_checksum(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0
