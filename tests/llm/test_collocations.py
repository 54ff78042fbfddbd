import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from nitraflow.llm import collocations as co
from nitraflow.llm import oracles, queries
from nitraflow.llm.collocations import PhraseRules

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, rules):
    """The result by its definition, from (lang, text)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for size in range(1, rules.max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        held = {p: n for p, n in c.items() if len(p) > 1 and n >= rules.support}
        covered = {q for p, n in held.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * n >= rules.cover_percent * held[q := p[i : i + k]]}
        found = []
        for p, a in held.items():
            if p not in covered:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[: rules.keep], 1)]
    return sorted(out)


def made(seed, n_rows, words):
    rnd = random.Random(seed)
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ; ", "!?"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randrange(60)))
    return [(rnd.choice(["en", "en", "en", "fr", None, "und"]), rnd.choice([None, "", " . "]) if rnd.random() < 0.1 else text()) for _ in range(n_rows)]


def table(spark, rows, n):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("own") for c in ("phrase", "n", "size", "most", "rank", "part")}).repartition(n)


@pytest.mark.parametrize(("seed", "support", "shard_bytes", "partitions", "filter_bits"), [(1, 5, 500, 3, 1 << 20), (2, 30, 1 << 20, 1, 1 << 20), (3, 8, 4000, 2, 64), (4, 2, 1, 8, 1 << 12), (5, 20, 20_000, 1, 1 << 20)])
def test_equals_brute_force(spark, seed, support, shard_bytes, partitions, filter_bits):
    """With local supports of one and of more, and with a bit table that is nearly full."""
    rows = made(seed, 250, ["a", "A", "b", "Bé", "c", "中", "of", "the", "x1", "rare%d" % seed, "'s"])
    rules = PhraseRules(support=support, shard_bytes=shard_bytes, filter_bits=filter_bits, keep=40)
    got = sorted(tuple(r[c] for c in NAMES) for r in co.collocations(table(spark, rows, partitions), rules).collect())
    assert got == brute(rows, rules) and len(got) > 20


def test_lowered_supports_are_used_and_lose_nothing(spark):
    """One shard holds most of a language: its local support is above one, and a phrase spread thinly over all is still found."""
    rows = [("en", "common words here " * 40)] * 30 + [("en", "thin spread phrase")] * 30
    rules = PhraseRules(support=30, shard_bytes=3000)
    counts, totals = co.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").coalesce(1), rules)
    found = {r["phrase"]: r["n"] for r in counts.collect()}
    assert found["thin spread phrase"] == 30 and found["common words here common"] == 30 * 39 and {r["n"] for r in totals.collect()} == {30 * 123}


def test_awkward_rows_long_texts_and_empty_tables(spark, docs_of):
    df = docs_of(AWKWARD)
    rules = PhraseRules(support=2)
    got = sorted(tuple(r[c] for c in NAMES) for r in co.collocations(df, rules).collect())
    assert got == brute([("en", t) for t in AWKWARD], rules) and ("en", "a b c a") in {(r[0], r[2]) for r in got}
    assert co.collocations(df.limit(0), rules).count() == 0
    doubled = co.collocations(df.unionByName(df), rules).collect()
    assert {r["phrase"]: r["a"] for r in doubled}["a b c a"] == 2 * 19_999


def test_counts_beyond_64_bits(spark):
    """The score's product is taken in decimals."""
    big = spark.createDataFrame([(9 * 10**15, 9 * 10**15, 10**16)], "a long, l long, r long")
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    assert big.select(score).first()[0] == 2_000_000 * 9 * 10**15 // (19 * 10**15)


def test_query_equals_sql_and_brute_force(spark, sample_docs):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(oracles.oracle_sql()["op12_collocations"])
    theirs = sorted(tuple(r[sql.columns.index(c)] for c in NAMES) for r in sql.fetchall())
    ours = sorted(tuple(r[c] for c in NAMES) for r in queries.op12_collocations(spark, "/root/testdata/sf0.001").collect())
    assert ours == theirs == brute([(r["lang"], r["text"]) for r in sample_docs.collect()], PhraseRules())
