"""Round trips of the file sources and sinks."""

from pyspark.sql.types import IntegerType, StringType, StructType

from cardamom.sources import io


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": "y"}\n{"a": 1, "c": 2}\n{"a": \n{"a": null}\n')
    good, bad = io.read_jsonl_strict(spark, str(tmp_path), StructType().add("a", IntegerType()).add("b", StringType()))
    assert sorted((r.a or 0, r.b or "") for r in good.collect()) == [(0, ""), (1, "x")]
    assert sorted(r.reason for r in bad.collect()) == ["BAD_JSON", "UNKNOWN_KEY", "WRONG_TYPE"]


def test_tagged_round_trip(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string"), spark.createDataFrame([(5.5,)], "v double")
    io.export_tagged({"a": a, "b": b}, str(tmp_path / "out"))
    tables, unknown = io.import_tagged(spark, str(tmp_path / "out"), {"a": a.schema, "b": b.schema})
    assert sorted(tables["a"].collect()) == sorted(a.collect()) and tables["b"].collect() == b.collect() and unknown.count() == 0
    assert io.import_tagged(spark, str(tmp_path / "out"), {"a": a.schema})[1].count() == 1


def test_release_export_verifies(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "k int, t string")
    io.export_release({"w": df}, {"w": ["k"]}, str(tmp_path / "r1"))
    io.export_release({"w": df.orderBy("t")}, {"w": ["k"]}, str(tmp_path / "r2"))
    one, two = (io.file_manifest(spark, str(tmp_path / r)) for r in ("r1", "r2"))
    assert sorted(r.sha256 for r in one.collect()) == sorted(r.sha256 for r in two.collect())
    assert {r.status for r in io.verify_manifest(one, one).collect()} == {"ok"}
    declared = one.limit(1).selectExpr("path", "bytes + 1 AS bytes", "sha256").unionByName(spark.createDataFrame([("x/y.json", 1, "0")], "path string, bytes long, sha256 string"))
    assert {"size", "missing"} <= {r.status for r in io.verify_manifest(declared, one).collect()}
    assert io.list_objects(spark, str(tmp_path / "r1"), "*.json").count() == one.count()


def test_page_lines(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("one\n\n two\n")
    assert [(r.page, r.line, r.text) for r in io.read_page_lines(spark, str(tmp_path / "*.txt")).orderBy("line").collect()] == [("p1.txt", 1, "one"), ("p1.txt", 3, " two")]


def test_release_scan_prunes(spark, tmp_path):
    spark.range(10).selectExpr("id", "concat('r', id % 2) AS release_id").write.partitionBy("release_id").parquet(str(tmp_path / "word"))
    df = io.read_content(spark, str(tmp_path), "word", "r1")
    assert df.count() == 5 and df.select("release_id").distinct().count() == 1
