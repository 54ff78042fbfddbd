import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nitraflow.llm import wordhash as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="aAbB é中\t\n\x0b .", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    hashes, starts, ends, first = W.words(data, offsets)
    raw = data.tobytes()
    found = [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
    assert found == [WORD.findall(t or "") for t in texts]
    lowered = [w.translate({c: c + 32 for c in range(65, 91)}) for t in found for w in t]
    assert len(set(hashes.tolist())) == len(set(lowered))


def test_spans_longer_than_a_piece_hash_like_themselves():
    text = "ab" * 900_000
    data, offsets = W.utf8(pa.array([text, "x", text, text[:-1] + "c"]))
    h, *_ = W.words(data, offsets)
    assert h[0] == h[2] and h[0] != h[3]


def test_windows_and_repeats():
    data, offsets = W.utf8(pa.array(["a b c a b", "a b", ""]))
    h, _, _, first = W.words(data, offsets)
    at, rows, w = W.windows(h, first, 2)
    assert at.tolist() == [0, 1, 2, 3, 5] and rows.tolist() == [0, 0, 0, 0, 1]
    assert W.repeated(W.in_row(rows, w)).tolist() == [True, False, False, True, False]


def test_row_ranges_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101])
    assert list(W.row_ranges(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]
