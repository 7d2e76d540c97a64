"""Sources and sinks: strict JSON lines, tagged backups, hashed exports, object listings, page lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_content(spark: SparkSession, root: str, table: str, release_id: str | None = None) -> DataFrame:
    """A release-scoped table, partitioned by release_id on disk; one release prunes to its folder."""
    df = spark.read.parquet(f"{root}/{table}")
    return df if release_id is None else df.where(F.col("release_id") == release_id)


def read_user_state(spark: SparkSession, root: str, table: str, user_id: int | None = None) -> DataFrame:
    """A user-state table; one user is pushed down to the scan."""
    df = spark.read.parquet(f"{root}/{table}")
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with a reason): bad JSON, values of a wrong type and unknown keys are bad."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    return parse_strict(lines, "line", schema)


def parse_strict(df: DataFrame, column: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The strict JSON rule on a text column."""
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    known = F.json_object_keys(column)
    # A value that doesn't fit its type parses to null although its key is there with another value than null.
    loose = StructType().fromJson({"type": "struct", "fields": [{"name": f.name, "type": "string", "nullable": True, "metadata": {}} for f in schema.fields]})
    parsed = df.withColumn("_row", F.from_json(column, schema)).withColumn("_text", F.from_json(column, loose)).withColumn("_keys", known)
    wrong = reduce(lambda a, b: a | b, [F.col(f"_row.{f.name}").isNull() & F.col(f"_text.{f.name}").isNotNull() for f in schema.fields])
    reason = F.when(F.col("_keys").isNull(), "BAD_JSON").when(F.size(F.array_except("_keys", names)) > 0, "UNKNOWN_KEY").when(wrong, "WRONG_TYPE")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("_row.*"), judged.where("reason IS NOT NULL").select(column, "reason")


def tagged_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line a row, with its table's name: {"table": .., "row": ..}."""
    parts = [df.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*df.columns).alias("row"))).alias("value")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def export_tagged(tables: dict[str, DataFrame], path: str) -> None:
    tagged_rows(tables).write.text(path, compression="gzip")


def untag(lines: DataFrame, schemas: dict[str, StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(table -> rows, lines with an unknown table)."""
    tag = F.get_json_object("value", "$.table")
    tables = {}
    for name, schema in schemas.items():
        row = F.from_json("value", StructType().add("row", schema))
        tables[name] = lines.where(tag == name).select(row.alias("_x")).select("_x.row.*")
    return tables, lines.where(tag.isNull() | ~tag.isin(*schemas))


def import_tagged(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    return untag(spark.read.text(path), schemas)


def export_release(tables: dict[str, DataFrame], order: dict[str, list[str]], path: str) -> None:
    """Each table as JSON files of its range of keys, rows in order, so equal rows give equal files."""
    for name, df in tables.items():
        df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]).write.json(f"{path}/{name}")


def file_manifest(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, status of every declared or found file: ok, missing, size, hash or undeclared."""
    both = manifest.alias("m").join(found.alias("f"), "path", "full")
    status = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "undeclared").when(
        F.col("m.bytes") != F.col("f.bytes"), "size").when(F.col("m.sha256") != F.col("f.sha256"), "hash").otherwise("ok")
    return both.select("path", status.alias("status"))


def list_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, uploaded, bytes of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("uploaded"), F.col("length").alias("bytes"))


def plan_uploads(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Declared objects with what to do: skip those that are there with the same hash, upload new ones, conflict for others."""
    there = existing.select("object_key", F.col("sha256").alias("_there"))
    action = F.when(F.col("_there").isNull(), "upload").when(F.col("_there") == F.col("sha256"), "skip").otherwise("conflict")
    return manifest.join(there, "object_key", "left").withColumn("action", action).drop("_there")


def read_page_lines(spark: SparkSession, glob: str) -> DataFrame:
    """page, line, text of text files, blank lines left out; a page is a file."""
    pages = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.posexplode(F.split("value", "\n")).alias("_at", "text"))
    return pages.where(F.trim("text") != "").select("page", (F.col("_at") + 1).alias("line"), "text")
