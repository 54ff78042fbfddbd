"""Secret scans: fixed patterns for common credentials, and guess-cost scoring of values that stand
where a credential would.

The guess cost of a value is the smallest log10 number of guesses over all ways to cut it into
dictionary words, dates, repeats, keyboard walks, runs of consecutive characters and brute-force
spans (dynamic programming over positions). Letters of a brute-force span cost what they do after the letter
before them in the dictionary, if that is less: a word that isn't in it is spelled out cheaply, random letters aren't.
Words are ranked by frequency: the common password words below, then, with `vocabulary`, the whole words of
a public byte-level tokenizer's vocabulary file, whose order follows how often they occur.

A value next to a credential keyword is reported as a span of kind `guess` by its cost and by its cost for each
character, as a sum alone can't tell surprise from length: see `GuessRules`. Ordinary words, phrases of
them, dates and short numbers stay below. Shares measured in `tests/llm/test_secret_scan.py`: of random
values of 8 to 16 characters of letters and digits, of hex digits, of mixed-case letters and of printable characters at least 0.9 of each kind are
reported; of phrases of one to four words of the vocabulary and of the corpus none or nearly none.

One pass without a shuffle. Null texts count as empty. Spans are code points, end exclusive.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import with_struct
from .wordhash import runs, utf8

#: The base patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|client|auth|secret)[_-]?key|credential|bearer|auth)["']?[\x20\t]*(?:=>|[:=]{1,2}|\x20is\x20)[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""",
    re.I | re.A,
)
#: Texts without any of these can't match ASSIGN or CONTEXT.
CUES = ("passw", "passp", "passc", "pwd", "secret", "token", "key", "credential", "bearer", "auth")

#: Frequent password words, most frequent first.
COMMON = """password the you this that love with have your from qwerty iloveyou welcome admin login princess
dragon monkey letmein football baseball master sunshine shadow superman michael hello freedom whatever secret
test user root guest default example changeme token value string true false none null required optional empty
summer winter spring autumn monday friday january july august december flower purple orange silver golden black
white green yellow blue house horse tiger lion eagle hunter ranger soccer hockey killer pepper ginger cookie
computer internet server system access account private public company office manager service server client
correct battery staple please enter should must will when where which about after before their there""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5@7", "aeolssat")
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?\d{1,2}[-/.]?\d{1,2})?|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2}))")


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            out[key] = {ROWS[y][x] for y in (r - 1, r, r + 1) if 0 <= y < 4 for x in (c - 1, c, c + 1) if 0 <= x < len(ROWS[y])} - {key}
    return out


NEAR = _neighbours()


def _char_cost(c: str, mixed: bool) -> float:
    """Brute force by kind of character; separators of words are few. `mixed`: capitals stand anywhere in the value."""
    if c in " _-.":
        return math.log10(4)
    return math.log10(10 if c.isdigit() else (52 if mixed else 26) if c.isalpha() else 33 if c.isascii() else 100)


@dataclass(frozen=True)
class GuessRules:
    """A value is reported that costs min_log10_guesses, or letters_log10_guesses if it is letters of one case (a leading
    capital aside) and separators, or digits_log10_guesses if it is digits and separators; and for each character
    the share that belongs to its kind."""

    min_log10_guesses: float = 7.6
    letters_log10_guesses: float = 9.0
    digits_log10_guesses: float = 12.0
    min_per_char: float = 0.98
    letters_per_char: float = 1.12
    digits_per_char: float = 0.8
    min_length: int = 8
    segment_cost: float = 0.3
    words: tuple[str, ...] = tuple(COMMON)
    vocabulary: str | None = None


_SEPARATORS = re.compile(r"[ _.-]")


def _mixed(value: str) -> bool:
    """Whether capitals and small letters stand in an order that isn't that of words, each with a leading capital at most, or all capitals."""
    return any(not (w.islower() or w.isupper() or w[1:].islower()) for w in re.findall(r"[^\W\d_]+", value) if len(w) > 1)


def decomposition(c: str) -> str:
    """The character without its accents."""
    return unicodedata.normalize("NFD", c)


@lru_cache(maxsize=4)
def vocabulary_words(path: str) -> tuple[str, ...]:
    """The words of three letters or more in a byte-level vocabulary file (each marked as opening a word), in its order."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    found = [t[1:].lower() for t in sorted(ids, key=ids.get) if t[0] == "Ġ" and len(t) > 3 and t.isalpha() and t[1:].isascii()]
    return tuple(dict.fromkeys(found))


class GuessCost:
    def __init__(self, rules: GuessRules) -> None:
        self.rules = rules
        words = dict.fromkeys((*rules.words, *(vocabulary_words(rules.vocabulary) if rules.vocabulary else ())))
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        self.longest = max(map(len, self.rank), default=0)
        self.after = self._letters(words)

    @staticmethod
    def _letters(words) -> dict[str, float]:
        """The cost of a letter after another (or, first in a word, after a space): -log10 of its share in the words."""
        pairs, single = Counter(), Counter()
        for w in words:
            for a, b in pairwise(f" {w}"):
                pairs[a + b] += 1
                single[a] += 1
        return {p: -math.log10(n / (single[p[0]] + 1)) for p, n in pairs.items()}

    def secret(self, value: str) -> float | None:
        """The cost of a value that is to be reported, None for another."""
        if len(value) < self.rules.min_length:
            return None
        r, plain = self.rules, _SEPARATORS.sub("", value)
        if plain.isdigit():
            least, share = r.digits_log10_guesses, r.digits_per_char
        elif plain.isalpha() and not _mixed(value):
            least, share = r.letters_log10_guesses, r.letters_per_char
        else:
            least, share = r.min_log10_guesses, r.min_per_char
        cost = self(value)
        return cost if cost >= max(least, share * len(value)) else None

    def __call__(self, value: str) -> float:
        """log10 guesses of the cheapest segmentation; linear in the length of the value."""
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain, mixed = low.translate(LEET), _mixed(value)
        letters = "".join(decomposition(c)[0] if not c.isascii() else c for c in low)
        best = [0.0] + [math.inf] * n
        walk = _run_lengths(low, lambda a, b: b in NEAR.get(a, ()))
        same = _run_lengths(value, lambda a, b: a == b)
        step = {d: _run_lengths(value, lambda a, b, d=d: ord(b) - ord(a) == d and a.isalnum()) for d in (1, -1)}
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if value[i].isdigit() and (m := DATE.match(value, i)):
                dates.setdefault(m.end(), []).append(i)
        extra = self.rules.segment_cost
        for i in range(1, n + 1):
            own = _char_cost(value[i - 1], mixed)
            if not mixed and value[i - 1].isalpha():
                before = letters[i - 2] if i > 1 and value[i - 2].isalpha() else " "
                own = min(own, self.after.get(before + letters[i - 1], own))
            cost = best[i - 1] + own
            for j in range(max(0, i - self.longest), i - 2):
                rank = self.rank.get(low[j:i])
                leet = 0.0
                if rank is None:
                    rank, leet = self.rank.get(plain[j:i]), 0.6
                if rank is not None:
                    case = 0.0 if value[j:i].islower() or not value[j:i].isalpha() else 0.6
                    cost = min(cost, best[j] + math.log10(rank) + leet + case + extra)
            for lengths, base in ((walk, math.log10(47 * 4)), (same, math.log10(95)), (step[1], math.log10(62)), (step[-1], math.log10(62))):
                k = lengths[i - 1]
                if k >= 3:
                    cost = min(cost, best[i - k] + base + math.log10(k) + extra)
            for j in dates.get(i, ()):
                cost = min(cost, best[j] + (math.log10(150) if i - j == 4 else math.log10(150 * 366)) + extra)
            best[i] = cost
        return best[n]


@lru_cache(maxsize=4)
def guess_cost(rules: GuessRules) -> GuessCost:
    """One per Python worker."""
    return GuessCost(rules)


def _run_lengths(s: str, follows) -> list[int]:
    """For each position, the length of the run ending there in which each character follows the one before."""
    out = [1] * len(s)
    for i in range(1, len(s)):
        if follows(s[i - 1], s[i]):
            out[i] = out[i - 1] + 1
    return out


def find_spans(text: str, maybe_hex: bool, cost: GuessCost) -> list[tuple[int, int, int, float]]:
    """(start, kind index, end, log10 guesses or nan) in order."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end(), math.nan) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        for m in CONTEXT.finditer(text):
            k = next(k for k in (1, 2, 3) if m[k] is not None)
            if (g := cost.secret(m[k])) is not None:
                found.append((m.start(k), 3, m.end(k), g))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), math.nan) for m in ACCESS.finditer(text)]
    if maybe_hex:
        found += [(m.start(), 2, m.end(), math.nan) for m in HEX.finditer(text)]
    return sorted(found)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log10_guesses", T.DoubleType())])
FIELDS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("spans", T.ArrayType(SPAN))])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[list(b"0123456789abcdef")] = True


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets", rules: GuessRules | None = None) -> DataFrame:
    """df with a struct column: the number of spans by kind, and the spans in order."""
    rules = rules or GuessRules()

    def scanned(column: pa.Array) -> pa.Array:
        cost = guess_cost(rules)
        data, offsets = utf8(column)
        a, b = runs(_HEXDIGIT[data], offsets)
        hexed = np.zeros(len(column), bool)
        hexed[np.searchsorted(offsets, a[b - a >= 32], "right") - 1] = True
        spans = [find_spans(s, h, cost) if s else [] for s, h in zip(column.to_pylist(), hexed.tolist(), strict=True)]
        counts = [pa.array([sum(x[1] == k for x in row) for row in spans], pa.int64()) for k in range(len(KINDS))]
        lists = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": None if g != g else g} for s, k, e, g in row] for row in spans], _SPANS)
        return pa.StructArray.from_arrays([*counts, lists], names=[f.name for f in FIELDS])

    return with_struct(df, text, out, FIELDS, scanned)
