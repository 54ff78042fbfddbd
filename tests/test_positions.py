import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitraflow.operators import positions
from nitraflow.sources import files, sinks

SCHEMA = "a long, b string"


@pytest.fixture
def small_splits(spark):
    """Splits of 20 kB, so that files are read in many pieces by tasks that hold several."""
    names = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_files(folder, sizes, start=0):
    folder.mkdir()
    n = start
    for i, k in enumerate(sizes):
        (folder / f"f{i}.csv").write_text("a,b\n" + "".join(f"{n + j},x{(n + j) % 7}\n" for j in range(k)))
        n += k


def scan(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).csv(str(path))


def test_numbers_equal_a_read_in_one_process(spark, tmp_path, small_splits):
    csv_files(tmp_path / "d", [5000, 1, 0, 12000, 300])
    df = scan(spark, tmp_path / "d")
    assert df.rdd.getNumPartitions() > 4
    plain = pd.concat([pd.read_csv(tmp_path / "d" / f"f{i}.csv") for i in range(5)], ignore_index=True)
    got = sorted((r["row_no"], r["a"], r["b"]) for r in positions.line_numbers(df).collect())
    assert got == list(zip(plain.index, plain.a, plain.b, strict=True))


def test_order_of_a_manifest_and_files_it_lacks(spark, tmp_path, small_splits):
    csv_files(tmp_path / "d", [3000, 10, 4000])
    order = spark.createDataFrame([("f2.csv", 0), ("f0.csv", 1)], "filename string, ord int")
    rows = sorted(positions.line_numbers(scan(spark, tmp_path / "d"), order).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in rows] == list(range(7000)) and [r["a"] for r in rows] == [*range(3010, 7010), *range(3000)]


def test_many_splits_are_joined_by_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    csv_files(tmp_path / "d", [4000, 4000])
    monkeypatch.setattr(positions, "MOST_SPLITS", 2)
    assert all(r["a"] == r["row_no"] for r in positions.line_numbers(scan(spark, tmp_path / "d")).collect())


def test_no_row_moves(spark, tmp_path):
    csv_files(tmp_path / "d", [50])
    plan = positions.line_numbers(scan(spark, tmp_path / "d"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_numbered_by_columns(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b"), (1, "z"), (1, "a")], SCHEMA).repartition(3)
    rows = sorted(positions.numbered(df, ["a"]).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in rows] == list(range(6)) and [r["a"] for r in rows] == [None, 1, 1, 1, 2, 3]
    assert positions.numbered(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize(("rows", "size"), [(10_000, 3000), (9000, 3000), (1, 5), (0, 5)])
def test_chunks_are_full_and_in_order(spark, tmp_path, small_splits, rows, size):
    csv_files(tmp_path / "d", [rows // 3, rows - rows // 3])
    df = scan(spark, tmp_path / "d")
    told = sinks.write_chunks(df, str(tmp_path / "out"), "d.csv", size, scan=True).first()
    written = sorted((tmp_path / "out/chunks").glob("*.csv"))
    n_files = max(1, -(-rows // size))
    assert len(written) == n_files and told["total_rows"] == rows
    lengths = [len(pd.read_csv(f)) if f.stat().st_size else 0 for f in written]
    assert lengths == [size] * (n_files - 1) + [rows - size * (n_files - 1)]
    if rows:
        whole = pd.concat([pd.read_csv(f) for f in written], ignore_index=True)
        assert whole.a.tolist() == list(range(rows)) and told["num_chunks"] == n_files
        manifest = files.read_manifest(spark, f"{tmp_path}/out/manifest")
        back = sorted(files.read_chunks(spark, f"{tmp_path}/out/chunks", manifest, df.schema).collect(), key=lambda r: r["row_no"])
        assert [(r["row_no"], r["a"], r["ord"]) for r in back] == [(i, i, i // size) for i in range(rows)]


def test_chunks_of_any_frame_in_the_order_of_columns(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), F.lit("t").alias("b")).repartition(5)
    for label, frame, by in (("by", df, ["a"]), ("ordered", df.orderBy("a"), [])):
        sinks.write_chunks(frame, str(tmp_path / label), "d.csv", 300, by)
        parts = [pd.read_csv(f).a.tolist() for f in sorted((tmp_path / label / "chunks").glob("*.csv"))]
        assert [len(p) for p in parts] == [300, 300, 300, 100] and sum(parts, []) == list(range(1000))


def test_two_files_compared_without_a_key(spark, tmp_path, small_splits):
    csv_files(tmp_path / "a", [5000, 200])
    csv_files(tmp_path / "b", [1000, 4100])
    changed = (tmp_path / "b/f1.csv").read_text().replace("2500,x1", "2500,y").replace("2501,x2", "-1,x2")
    (tmp_path / "b/f1.csv").write_text(changed)
    a, b = scan(spark, tmp_path / "a"), scan(spark, tmp_path / "b")
    bad = {r["row_no"]: (r["side"], r["columns"]) for r in positions.diff_by_position(a, b).collect()}
    assert bad == {2500: ("both", ["b"]), 2501: ("both", ["a"])} | {i: ("left_only", []) for i in range(5100, 5200)}
    report = {r["batch"]: r for r in positions.diff_batches(positions.line_numbers(a), positions.line_numbers(b), 1000).collect()}
    assert [report[i]["n_bad"] for i in range(6)] == [0, 0, 2, 0, 0, 100] and report[5]["rows_b"] == 100 and report[5]["rows_a"] == 200
    assert report[2]["contiguous"] and report[2]["first_bad"] == 2500 and report[0]["contiguous"] is None
