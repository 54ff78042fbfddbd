from pyspark.sql import functions as F

from nitraflow.operators import profiles, quality


def test_merged_states_equal_one_pass(spark, tmp_path):
    """Whatever the files are; and only new and changed files are read."""
    df = spark.range(30_000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 500)).alias("b"), (F.col("id") % 7).cast("double").alias("c"), F.lit(None).cast("string").alias("none"))
    df.repartition(5).write.option("header", True).csv(str(tmp_path / "d"))
    seen = []

    def read(paths):
        seen.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
        return spark.read.schema(df.schema).option("header", True).csv(paths)

    listed = spark.createDataFrame([(f.name, f.stat().st_size, i) for i, f in enumerate(sorted((tmp_path / "d").glob("*.csv")))], "filename string, size_bytes long, ord int")
    nothing = spark.createDataFrame([], profiles.STATE)
    first = profiles.refreshed_state(nothing, listed.where("ord < 3"), str(tmp_path / "d"), read)
    state = profiles.refreshed_state(first, listed, str(tmp_path / "d"), read)
    names = [r.filename for r in listed.orderBy("ord").collect()]
    assert seen == [names[:3], names[3:]]
    merged = {r["column"]: r for r in profiles.merged_profile(state).collect()}
    plain = {r["column"]: r for r in quality.profile(df).join(quality.distinct_counts(df), "column").collect()}
    assert set(merged) == set(plain)
    for c, r in plain.items():
        m = merged[c]
        assert (m.type, m.n_files, m.n_rows, m.n_values) == (r.type, 5, r.n_rows, r.n_values)
        assert abs(m.n_distinct - r.n_distinct) <= 0.05 * r.n_distinct
    assert profiles.refreshed_state(state, listed.where("ord > 0"), str(tmp_path / "d"), read).select("filename").distinct().count() == 4 and len(seen) == 2
    changed = listed.withColumn("size_bytes", F.col("size_bytes") + (F.col("ord") == 2).cast("long"))
    profiles.refreshed_state(state, changed, str(tmp_path / "d"), read)
    assert seen[2:] == [[names[2]]]
    assert profiles.merged_profile(nothing).count() == 0
