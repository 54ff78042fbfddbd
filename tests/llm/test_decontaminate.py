import re

import duckdb
import pytest
from conftest import AWKWARD

from nitraflow.llm import decontaminate as D
from nitraflow.llm import oracles

ITEM = "If Anna buys 12 apples for 30 dollars and then Anna gives 5 apples to her brother Paul how many apples are left"
PLAIN = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old oak tree nearby"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, PLAIN), (3, "one two three"), (4, None), (5, "six words make a short item")], "item_id long, text string")


def found(df, items):
    return sorted((r["doc_id"], r["item_id"], r["n_slots"] > 0, r["changed_slots"]) for r in D.contaminated(df, items).collect())


def test_exact_and_reparameterised_items_are_caught(docs_of, items):
    other = ITEM.replace("Anna", "Maria").replace("12", "47").replace("30", "99").replace(" 5 ", " 8 ").replace("Paul", "Henry")
    mixed = other.replace("then Maria", "then Julia")
    texts = ["before. " + ITEM + " after", "x " + other + ".", mixed, "So: " + PLAIN.upper() + "!", "the quick brown fox jumps over a wall", "Six words; make a (short) item", ITEM[:40]]
    assert found(docs_of(texts), items) == [(0, 1, True, 0), (1, 1, True, 6), (3, 2, False, 0), (5, 5, False, 0)]


def test_awkward_texts_and_tables(docs_of, items, spark):
    assert found(docs_of(AWKWARD), items) == []
    assert D.without_benchmark(docs_of(AWKWARD), items).count() == len(AWKWARD)
    assert D.contaminated(docs_of([PLAIN]), items.limit(0)).count() == 0
    assert D.contaminated(docs_of([PLAIN]).limit(0), items).count() == 0
    assert found(docs_of([PLAIN, PLAIN]), items) == [(0, 2, False, 0), (1, 2, False, 0)]


def changed(text, k):
    """The item with other names and numbers, one for one."""
    given = sorted({w for w in re.findall(r"[^\W\d_]+", text) if w[0].isupper() and w[1:2].islower()})
    other = {w: f"Nam{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, w in enumerate(given)}
    return re.sub(r"[^\W\d_]+|\d+", lambda m: other.get(m[0], str(int(m[0]) + 7) if m[0].isdigit() else m[0]), text)


def test_planted_items_are_caught_and_all_equals_sql(sample_docs, spark, tmp_path):
    """Verbatim, lower-cased, re-parameterised and half items planted in real documents, against the SQL over word tuples."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(1000 + i, f"In {1990 + i} Anna rode {i + 3} km to Paul and paid {i} dollars for {i * 7 + 2} apples that Paul gave to Maria and {i + 40} more which nobody wanted") for i in range(5)]
    rows = [r.asDict() for r in sample_docs.orderBy("doc_id").limit(120).collect()]
    clean = {r["doc_id"]: r["text"] for r in rows}
    want = set()
    for k, (item_id, text) in enumerate(items):
        r = rows[2 * k % 110]
        planted = (text, text.lower(), changed(text, k % 26), " ".join(text.split()[: len(text.split()) * 2 // 3]))[k % 4]
        words = (r["text"] or "").split()
        r["text"] = " ".join([*words[: len(words) // 2], planted, *words[len(words) // 2 :]])
        want.add((r["doc_id"], item_id))
    schema = sample_docs.schema
    df, bench = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema), spark.createDataFrame(items, "item_id long, text string")
    df.write.parquet(f"{tmp_path}/documents"), bench.write.parquet(f"{tmp_path}/benchmark")
    ours = D.contaminated(df, bench)
    got = {(r["doc_id"], r["item_id"]): r for r in ours.collect()}
    assert want <= set(got)
    before = D.contaminated(spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string"), bench).collect()
    made = {d for d, i in want if i >= 1000}  # these items are each other's changed copies
    assert {x for x in set(got) - want if not (x[0] in made and x[1] >= 1000)} <= {(r["doc_id"], r["item_id"]) for r in before}
    assert sum(r["changed_slots"] > 0 for r in got.values()) >= len(items) // 8
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    theirs = con.sql(oracles.decontaminate_sql(D.TemplateSettings())).to_arrow_table().select(ours.columns).to_pylist()
    plain = lambda rs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs)
    assert plain(map(tuple, got.values())) == plain(r.values() for r in theirs)


def test_both_join_ways_agree(sample_docs, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    shuffled = D.contaminated(sample_docs, items, settings=D.TemplateSettings(broadcast_rows=0))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, D.contaminated(sample_docs, items).collect()))


def test_main_path_is_native(sample_docs, items):
    plan = D.without_benchmark(sample_docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))


def test_items_of_mostly_slots_are_caught(docs_of, spark):
    sums, table = "Compute 12 + 7 - 3 * 4 + 9", "Values 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 of a long row of measured and rounded levels"
    items = spark.createDataFrame([(1, sums), (2, table)], "item_id long, text string")
    other = table.replace(" 3 ", " 33 ").replace(" 14 ", " 44 ")
    assert [x[:2] for x in found(docs_of(["so: " + sums, table, other, "Compute 1 + 2 - 3 * 4 + 5"]), items)] == [(0, 1), (1, 2), (2, 2)]


def test_names_that_open_sentences_are_slots(docs_of, spark):
    text = "Tom has 3 cats. Tom buys 4 dogs. Tom sells 2 birds. How many pets does Tom own now?"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    other = text.replace("Tom", "Jim").replace("3", "7")
    texts = [other, '"' + other, text.lower(), other.replace("Jim sells", "Ann sells")]
    assert [x[:2] for x in found(docs_of(texts), items)] == [(0, 1), (1, 1), (2, 1)]


def test_one_word_edits_and_excerpts_are_caught(docs_of, spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59))
    short = PLAIN.split()[:12]
    items = spark.createDataFrame([(1, PLAIN), (2, long), (3, " ".join(w + "s" for w in short))], "item_id long, text string")
    edits = [" ".join([*PLAIN.split()[:i], "changed", *PLAIN.split()[i + 1 :]]) for i in range(20)]
    shorts = [" ".join("changed" if i == j else w + "s" for j, w in enumerate(short)) for i in range(12)]
    texts = [*edits, *shorts, " ".join(long.split()[20:33]), " ".join(long.split()[20:32])]
    assert [x[:2] for x in found(docs_of(texts), items)] == [*[(i, 1) for i in range(20)], *[(20 + i, 3) for i in range(12)], (32, 2)]
