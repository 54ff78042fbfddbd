import re
from collections import Counter

from conftest import AWKWARD
from pyspark.sql import functions as F

from nitraflow.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """The shares by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, fixed = {}, {s for s in names if sizes[s] == 0}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        total = sum(weight[s] for s in names if s not in fixed)
        out = {s: 3.0 * sizes[s] if s in fixed else rest * weight[s] / total for s in names}
        above = {s for s in names if s not in fixed and out[s] > 3 * sizes[s]}
        if not above:
            return out
        fixed |= above


def check(df, settings):
    rows = M.mix_counts(df, settings=settings).collect()
    given = df.collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], size(r["text"])) for r in given)
    sizes = Counter()
    for r in given:
        sizes[r["source"]] += size(r["text"])
    want, taken = targets(sizes), Counter()
    source = {r["doc_id"]: r["source"] for r in given}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * settings.block_words, (s, taken[s], t)
    return rows


def test_counts_meet_the_targets_and_reruns_agree(sample_docs, docs_of):
    settings = M.MixSettings(block_words=32, shard_slots=16, bucket_rows=8)
    rows = check(sample_docs, settings)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_counts(sample_docs.repartition(3), settings=settings).collect()))
    texts = [(i, " ".join(["w"] * (i * 7 % 50)), s) for i, s in enumerate(["b", "é", None, "", "Z"] * 20)]
    check(docs_of([*texts, (100, "one", "tiny")]), settings)


def test_text_of_the_mix_is_what_the_counts_say(sample_docs):
    settings = M.MixSettings(block_words=64, shard_slots=16)
    taken = {r["doc_id"]: r["taken"] for r in M.mix_counts(sample_docs, settings=settings).collect()}
    mixed = M.mix_documents(sample_docs, settings=settings).collect()
    words = Counter()
    texts = {r["doc_id"]: r["text"] for r in sample_docs.collect()}
    for r in mixed:
        assert r["text"] in texts[r["doc_id"]]
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {d: n for d, n in taken.items() if n} == dict(words)
    per = Counter((r["shard"], r["slot"]) for r in mixed)
    assert len({s for _, s in per}) == max(s for _, s in per) + 1  # every slot is filled once


def test_copies_for_many_takers_and_short_stretches_change_nothing(docs_of):
    texts = [(i % 3, "a b c d e f g", "s") for i in range(30)] + [(i, f"x{i} y z", "t") for i in range(20)]
    df = docs_of(texts).withColumn("slot", F.lit("gives way")).withColumn("row", F.lit(1)).withColumn("sid", F.lit("kept")).withColumn("_ref", F.lit("kept too"))
    mixes = [sorted(map(tuple, M.mix_documents(df, settings=M.MixSettings(block_words=4, shard_slots=8, bucket_rows=2, **more)).collect())) for more in ({}, {"copies_a_task": 1}, {"stretch": 1})]
    assert mixes[0] == mixes[1] == mixes[2] and mixes[0]
    assert M.mix_documents(df).columns == [*[c for c in df.columns if c != "slot"], "shard", "slot"]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        p = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), [F.lit(3), F.lit(0)], M.MixSettings()).alias("p"))
        assert sorted(r["p"] for r in p.collect()) == list(range(n))


def test_awkward_texts_and_tables(docs_of):
    check(docs_of(AWKWARD), M.MixSettings(block_words=100))
    assert M.mix_documents(docs_of([None, ""])).count() == 0
    assert M.mix_counts(docs_of(["a"]).limit(0)).count() == 0
    repeated = docs_of([(1, "a b c", "s"), (1, "a b c", "s")])
    assert [r["taken"] for r in M.mix_counts(repeated, settings=M.MixSettings(block_words=1)).collect()] == [3, 3]
    assert M.mix_documents(repeated, settings=M.MixSettings(block_words=3)).count() == 2


def test_main_path_is_native(sample_docs):
    plan = M.mix_documents(sample_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct"))
