import re
from collections import Counter

from conftest import AWKWARD  # tests/llm/conftest.py

from nitraflow.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed)


def measured(df):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return [(r["doc_id"], r["text"], *[r["quality"][n] for n in names]) for r in quality_rules.repetition_coverage(df).collect()]


def test_base_measures_equal_brute_force(sample_docs, docs_of):
    for df in (sample_docs, docs_of(AWKWARD)):
        for _, text, *found in measured(df):
            assert tuple(found[:-1]) == brute(text)


def test_verdict(docs_of):
    clean = " ".join(f"word{i}" for i in range(60))
    texts = [clean, "a b c d e f g h " * 10, "short text", " ".join(f"w{i}|" for i in range(60)), (clean[:200] + "\n") * 3, " ".join(f"{w} {w} {w} {w} {w}" for w in "abcdefgh")]
    assert [r[-1] for r in sorted(measured(docs_of(texts)))] == [True, False, False, False, False, False]


def test_clashing_and_extra_columns(docs_of):
    df = docs_of(["a b"]).selectExpr("*", "1 as quality", "2 as _verdict", "array(1) as extra")
    assert quality_rules.repetition_coverage(df).columns == [*[c for c in df.columns if c != "quality"], "quality"]
    assert quality_rules.keep_by_rules(df).columns == df.columns


def test_empty_table(docs_of):
    assert quality_rules.repetition_coverage(docs_of(["a"]).limit(0)).count() == 0
