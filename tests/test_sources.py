import json

from pyspark.sql import functions as F

from nitraflow.operators import catalog, quality
from nitraflow.sources import files, responses, schemas, sinks

HEADER = ",".join(["site_uid", "datetime", *schemas.MEASURES])


def test_readings(spark, tmp_path):
    row = lambda site, t, v: f"{site},{t},{v}" + "," * (len(schemas.MEASURES) - 1)
    (tmp_path / "r.csv").write_text("\n".join([HEADER, row("05482300", "2017-08-09 12:29:00-05", 0.25), row('"9903   "', "2017-12-09 00:00:00-06", ""), row("WQS1", "2018-01-01 00:00:00-06", "NaN")]) + "\n")
    df = files.read_readings(spark, str(tmp_path / "r.csv"))
    found = [(r.site_uid, str(r.t), r.nitrate_con) for r in df.select("site_uid", F.col("datetime").cast("string").alias("t"), "nitrate_con").orderBy("site_uid").collect()]
    assert found == [("05482300", "2017-08-09 17:29:00", 0.25), ("9903", "2017-12-09 06:00:00", None), ("WQS1", "2018-01-01 06:00:00", None)]
    sinks.write_by_site(df, str(tmp_path / "by_site"), salts=2)
    one = files.read_site(spark, str(tmp_path / "by_site"), "9903 ")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(site_uid" in one._jdf.queryExecution().executedPlan().toString()


def test_tolerant_sites(spark, tmp_path):
    (tmp_path / "s.csv").write_text("uid,latitude,longitude\na,1.5,2.5\nb,x,3\nc,4,5,6\n")
    good, bad = files.read_sites(spark, str(tmp_path / "s.csv"))
    assert [r.uid for r in good.collect()] == ["a"] and bad.first().n_bad == 2


def test_chunks_and_manifest(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 2).cast("string").alias("x")).coalesce(1)
    manifest = sinks.write_chunks(df, str(tmp_path / "out"), "all.csv", 300)
    first = manifest.first()
    assert (first.total_rows, first.num_chunks, first.chunk_size) == (1000, 4, 300)
    chunks = files.read_manifest(spark, str(tmp_path / "out/manifest"))
    again = files.read_chunks(spark, str(tmp_path / "out/chunks"), chunks, df.schema)
    assert quality.table_diff(df, again.drop("ord"), ["id"]).count() == 0
    audit = quality.chunk_audit(spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "out/chunks")), chunks)
    assert [r.ok for r in audit.collect()] == [True] * 4


def test_sheet_and_rasters(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Title\nmore,title\n"FIPS",Name,Value\n"01001","A, b",5\n"01003",C,\n')
    rows = files.read_sheet(spark, str(tmp_path / "t.csv"), 2, schemas.both(schemas.strings("FIPS", "Name"), schemas.doubles("Value"))).collect()
    assert [tuple(r) for r in rows] == [("01001", "A, b", 5.0), ("01003", "C", None)]
    (tmp_path / "q.csv").write_text('A title\n\nFIPS,Name,Value\r\n01,"A\nB, ""so"" called",1.5\r\n\r\n02,plain,2\n03,"ends\n\nlate",')
    rows = files.read_sheet(spark, str(tmp_path / "q.csv"), 2, schemas.both(schemas.strings("FIPS", "Name"), schemas.doubles("Value"))).collect()
    assert [tuple(r) for r in rows] == [("01", 'A\nB, "so" called', 1.5), ("02", "plain", 2.0), ("03", "ends\n\nlate", None)]
    wide = "x," * 3000 + '"y\nz"'
    (tmp_path / "w.csv").write_text("a\n" + "".join(f'{i},"{"word " * 5000}{chr(10)}b"\n' for i in range(20)) + wide + "\n")
    assert files.read_sheet(spark, str(tmp_path / "w.csv"), 0, schemas.strings("a", "b")).count() == 21
    spark.createDataFrame([(0, 0, 1.0, 2.0, -99.0), (0, 1, 2.0, 2.0, 7.0)], schemas.PIXELS).write.parquet(str(tmp_path / "Surplus_N_2017.parquet"))
    found = files.read_yearly_rasters(spark, str(tmp_path / "Surplus_N_*.parquet"), nodata=-99.0).orderBy("col").collect()
    assert [(r.year, r.value) for r in found] == [(2017, None), (2017, 7.0)]
    for stem in ("crop_2002", "no_year"):
        spark.createDataFrame([(0, 0, 1.0, 2.0, 5.0)], schemas.PIXELS).write.parquet(str(tmp_path / f"{stem}.parquet"))
        assert [r.year for r in files.read_yearly_rasters(spark, str(tmp_path / f"{stem}.parquet")).collect()] == [2002 if stem == "crop_2002" else None]
    (tmp_path / "u.csv").write_text("Title, with, commas\nFIPS,Name,Value\n01001\n01003,C,2\n")
    rows = files.read_sheet(spark, str(tmp_path / "u.csv"), 1, schemas.both(schemas.strings("FIPS", "Name"), schemas.doubles("Value"))).collect()
    assert [tuple(r) for r in rows] == [("01001", None, None), ("01003", "C", 2.0)]


def test_responses(spark):
    df = lambda *docs: spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "point long, json string")
    table = responses.table_from_rows(df({"Table": [["mukey", "x"], ["1", None], ["2", "b"]]}, {"Table": [["mukey", "x"]]}, {}), ["mukey", "x", "absent"])
    assert sorted(map(tuple, table.collect())) == [("1", None, None), ("2", "b", None)]
    days = responses.weather_from_json(df({"properties": {"parameter": {"T2M": {"20240101": 1.5, "20240102": 2.0}, "RH2M": {"20240101": 50.0}}}}))
    assert sorted((str(r.date), r.T2M, r.RH2M, r.WS2M) for r in days.collect()) == [("2024-01-01", 1.5, 50.0, None), ("2024-01-02", 2.0, None, None)]
    crops = responses.crop_stats_from_json(df({"data": [{"county_name": "X", "Value": "(D)"}, {"Value": "1,234", "unit_desc": "BU"}]}, {"error": 1}))
    assert sorted((r.county_name, r.Value, r.unit_desc) for r in crops.collect()) == [("N/A", "1,234", "BU"), ("X", "(D)", "")]
    articles = responses.catalog_from_json(df([{"title": "t", "id": 5}]))
    assert [tuple(r) for r in articles.collect()] == [("t", 5, "", "")]


def test_sites_of_interest(spark, tmp_path):
    sites = spark.createDataFrame([("a ", 1.0, 2.0), ("b", 3.0, 4.0)], schemas.SITES)
    readings = spark.createDataFrame([(" a",)], "site_uid string")
    assert [r.uid for r in catalog.sites_with_data(sites, readings).collect()] == ["a"]
    sinks.write_sites_of_interest(sites, readings, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_only_the_folder_of_a_site_is_listed(spark, tmp_path):
    names, root = ["05482300", "9903", "a/b c", "x=%1", "[q]*?{z}", 'it\'s "#"'], str(tmp_path / "by_site")
    sinks.write_by_site(spark.createDataFrame([(n, float(i)) for i, n in enumerate(names)], "site_uid string, v double"), root)
    assert files.read_site(spark, root, "absent").count() == 0 and files.read_site(spark, root, "").count() == 0
    # a folder beside the sites that no listing of the whole root gets through
    spark.createDataFrame([(1.0,)], "v double").write.parquet(f"{root}/other=1")
    for i, n in enumerate(names):
        assert [(r.site_uid, r.v) for r in files.read_site(spark, root, f"{n} ").collect()] == [(n, float(i))]
