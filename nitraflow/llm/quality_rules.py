"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths are compared within each document. For every length the
share of the word characters that stand inside a window found twice or more is measured, and for
lines the share inside a line equal to an earlier one. A document whose share exceeds the limit of
that length is rejected, and so is one that carries markup symbols on most of its words.

One pass over the documents without a shuffle; memory follows the Arrow batch, not the partition.
Null and empty texts have no words and fail the base rule; repeated rows are measured one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import struct_array, with_struct
from .wordhash import RAW, in_row, repeated, row_ranges, row_sums, runs, span_hashes, utf8, windows, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest allowed share of word characters inside repeated n-grams, by n-gram length."""

    ngram_limits: tuple[tuple[int, float], ...] = ((3, 0.60), (5, 0.45), (7, 0.40), (10, 0.35))
    line_limit: float = 0.30
    symbols_per_word: float = 0.25
    window: int = 8
    min_words: int = 20
    window_percent: int = 30


FIELDS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("ngram_shares", T.ArrayType(T.DoubleType())), T.StructField("line_share", T.DoubleType())]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
)


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for the words inside any of the windows that start at `at`."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    hashes, starts, ends, first = words(data, offsets, RAW)
    n_words = np.diff(first)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = row_sums(chars, first)

    def share(n: int) -> tuple[np.ndarray, np.ndarray]:
        at, rows, h = windows(hashes, first, n)
        inside = _covered(at[repeated(in_row(rows, h))], n, len(hashes))
        return row_sums(inside, first), row_sums(np.where(inside, chars, 0), first) / np.maximum(word_chars, 1)

    a, b = runs(data != 10, offsets)
    line_of = np.searchsorted(offsets, a, "right") - 1
    held = np.searchsorted(starts, b) - np.searchsorted(starts, a)
    a, b, line_of = a[held > 0], b[held > 0], line_of[held > 0]
    keys = in_row(line_of, span_hashes(data, a, b, RAW))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    line_at = np.searchsorted(line_of, np.arange(len(offsets)))
    before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = before[np.searchsorted(starts, b)] - before[np.searchsorted(starts, a)]

    n_repeat, _ = share(rules.window)
    shares = np.stack([share(n)[1] for n, _ in rules.ngram_limits], 1)
    line_share = row_sums(np.where(again, line_chars, 0), line_at) / np.maximum(word_chars, 1)
    n_symbols = row_sums(SYMBOL[data], offsets)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.window_percent * n_words)
    bad = (shares > np.array([x for _, x in rules.ngram_limits])).any(1) | (line_share > rules.line_limit)
    bad |= n_symbols > rules.symbols_per_word * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": row_sums(again, line_at),
        "n_repeat_words": n_repeat, "ngram_shares": shares, "line_share": line_share, "base_failed": base_failed, "kept": ~(base_failed | bad),
    }


def repetition_coverage(df: DataFrame, text: str = "text", out: str = "quality", rules: RepetitionRules | None = None) -> DataFrame:
    """df with a struct column of the measures and the verdict `kept` for each text."""
    rules = rules or RepetitionRules()
    n = len(rules.ngram_limits)

    def measured(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        parts = [measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rules) for lo, hi in row_ranges(offsets)]
        if not parts:
            parts = [measure(data, offsets, rules)]
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        rows = len(x["n_words"])
        lists = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * n, x.pop("ngram_shares").ravel())
        return struct_array(rows, {f.name: lists if f.name == "ngram_shares" else x[f.name] for f in FIELDS})

    return with_struct(df, text, out, FIELDS, measured)


def keep_by_rules(df: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows that pass, with the columns of df."""
    name = "_verdict"
    while name in df.columns:
        name += "_"
    return repetition_coverage(df, text, name, rules).where(F.col(name)["kept"]).drop(name)
