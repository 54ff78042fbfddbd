import corpus_pipeline
import duckdb
from test_jaccard_join import brute as components
from test_token_files import whole

from nitraflow.llm import oracles

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, sample_docs):
    docs, kept = sample_docs, {r["doc_id"]: r["text"] for r in sample_docs.collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = oracles.oracle_sql()
    wanted = [{r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op10_quality_rules']}) WHERE kept").fetchall()}]
    wanted.append({i for i, _, c in components([(i, kept[i]) for i in sorted(wanted[0])], 5, 80) if i == c})
    wanted.append(wanted[1] - {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql['op4_decontaminate']})").fetchall()})
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], wanted, strict=False):
        docs = stage(spark, docs, SF)
        assert docs.columns == sample_docs.columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == sample_docs.columns
    rows = mixed.collect()
    assert {r["doc_id"] for r in rows} <= wanted[2] and all(r["text"] in kept[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in rows)
    out = corpus_pipeline.tokens(spark, mixed, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((r["doc_id"], len(whole(r["text"]))) for r in rows)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
