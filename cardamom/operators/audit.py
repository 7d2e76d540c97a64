"""Audits and assembly over content, lines and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(blocks: DataFrame, wide: float = 0.6) -> DataFrame:
    """Blocks with their place on the page: lines that span the page cut it into bands; in a band the left column comes before the right one.

    A spanning line opens the band below it.
    """
    down = Window.partitionBy("page").orderBy("y0", "x0", "block")
    spans = (F.col("x1") - F.col("x0")) >= wide
    column = F.when(spans, -1).when((F.col("x0") + F.col("x1")) / 2 < 0.5, 0).otherwise(1)
    rows = blocks.withColumn("_column", column).withColumn("_band", F.sum(spans.cast("int")).over(down))
    order = Window.partitionBy("page").orderBy("_band", "_column", "y0", "x0", "block")
    return rows.withColumn("place", F.row_number().over(order)).drop("_column", "_band")


def apply_patches(patches: DataFrame, members: DataFrame) -> DataFrame:
    """Patches (session_id, event_id, word_key, seq) with a code: the first of each (session, event) counts, and only for words of the session's group."""
    first = F.row_number().over(Window.partitionBy("session_id", "event_id").orderBy("seq"))
    own = members.select("session_id", "word_key").distinct().withColumn("_member", F.lit(True))
    rows = patches.withColumn("_n", first).join(own, ["session_id", "word_key"], "left")
    code = F.when(F.col("_n") > 1, "REPLAY").when(F.col("_member").isNull(), "NOT_IN_GROUP").otherwise("APPLIED")
    return rows.withColumn("code", code).drop("_n", "_member")


def maintain_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Search documents after changes (entity_type, entity_key, op insert, update or delete, text, seq): the latest change of an entity wins."""
    keys = ["entity_type", "entity_key"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", "text"), "seq").alias("_c"))
    kept = documents.join(last, keys, "left_anti").select(*keys, "text")
    return kept.unionByName(last.where("_c.op <> 'delete'").select(*keys, F.col("_c.text").alias("text")))


def progress_for(requests: DataFrame, canonical: DataFrame, progress: DataFrame) -> DataFrame:
    """Each requested (user_id, place, word_key) with the stage stored under its canonical key, null if there is none."""
    roots = canonical.select(F.col("key").alias("word_key"), "root")
    keyed = requests.join(roots, "word_key", "left").withColumn("_key", F.coalesce("root", "word_key")).drop("root")
    stages = progress.select("user_id", F.col("word_key").alias("_key"), "stage")
    return keyed.join(stages, ["user_id", "_key"], "left").drop("_key")


def page_spans(tables: list[DataFrame], unit_first: DataFrame) -> DataFrame:
    """unit_key, first_page (of the unit's own row), last_page (of all rows)."""
    pages = reduce(DataFrame.unionByName, [t.select("unit_key", "page") for t in [*tables, unit_first]])
    return pages.groupBy("unit_key").agg(F.max("page").alias("last_page")).join(unit_first.groupBy("unit_key").agg(F.min("page").alias("first_page")), "unit_key")


def checks(parts: dict[str, DataFrame]) -> DataFrame:
    """check, failures, passed from one table of failing rows a check."""
    rows = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("failures") == 0)


def unit_verdicts(units: DataFrame, findings: DataFrame) -> DataFrame:
    """unit_key, status (PASSED or BLOCKED), codes: the distinct finding codes of every unit."""
    found = findings.groupBy("unit_key").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return units.select("unit_key").join(found, "unit_key", "left").select(
        "unit_key", F.when(F.col("codes").isNull(), "PASSED").otherwise("BLOCKED").alias("status"), F.coalesce("codes", F.lit("")).alias("codes"))


def assess_units(units: DataFrame, results: DataFrame, round_limit: int = 3) -> DataFrame:
    """unit_key, state by the unit's latest result (round, role, verdict): awaiting_generation, awaiting_review, awaiting_repair, passed or blocked."""
    last = results.groupBy("unit_key").agg(F.max_by(F.struct("round", "role", "verdict"), F.struct("round", "seq")).alias("_r"))
    r = F.col("_r")
    state = (
        F.when(r.isNull(), "awaiting_generation").when(r["verdict"] == "block", "blocked").when((r["role"] == "review") & (r["verdict"] == "pass"), "passed")
        .when((r["role"] == "review") & (r["round"] >= round_limit), "blocked").when(r["role"] == "review", "awaiting_repair").otherwise("awaiting_review")
    )
    return units.select("unit_key").join(last, "unit_key", "left").select("unit_key", state.alias("state"))


def work_packets(workloads: DataFrame, role: str, number: int) -> DataFrame:
    """One packet a unit: its payload as JSON with sorted names, and the payload's hash."""
    payload = F.to_json(F.struct("examples", "phrases", "senses", "unit_key", "words"))
    return workloads.select("unit_key", F.lit(role).alias("role"), F.lit(number).alias("round"), payload.alias("payload")).withColumn("packet_hash", F.sha2("payload", 256))


def duration_band(chars: Column, per_char: float = 0.07, low: float = 0.3, high: float = 12.0) -> Column:
    """struct<min_seconds, max_seconds>: half and twice the expected length of speech, clamped."""
    clamp = lambda x: F.round(F.least(F.greatest(x, F.lit(low)), F.lit(high)), 2)
    return F.struct(clamp(chars * (per_char / 2)).alias("min_seconds"), clamp(chars * (per_char * 2)).alias("max_seconds"))


def redact(record: Column, secret: str = "(?i)token|password|secret|cookie", longest: int = 256) -> Column:
    """A map with the values of sensitive keys masked and long values cut."""
    return F.transform_values(record, lambda k, v: F.when(k.rlike(secret), F.lit("[redacted]")).when(F.length(v) > longest, F.concat(F.substring(v, 1, longest), F.lit("…"))).otherwise(v))
