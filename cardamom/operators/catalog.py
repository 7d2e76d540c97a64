"""Catalogue projections and small rules on content rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_form

# How well a word is known, as users say it and as it is stored.
FAMILIARITY = {"VERY_UNFAMILIAR": "UNKNOWN", "SOMEWHAT_FAMILIAR": "RECOGNIZABLE", "FAMILIAR": "KNOWN"}


def bootstrap(releases: DataFrame, units: DataFrame, release: str) -> DataFrame:
    """Units of one release with its status, in unit order; a release that is not listed counts as ACTIVE and never activated."""
    one = releases.where(F.col("release_id") == release).select(F.col("status").alias("_status"), F.col("activated_at").alias("_activated"))
    # One row at most, so this is no product.
    rows = units.withColumn("_release", F.lit(release)).join(one.withColumn("_release", F.lit(release)), "_release", "left")
    return rows.select(F.lit(release).alias("release_id"), F.coalesce("_status", F.lit("ACTIVE")).alias("status"), F.col("_activated").alias("activated_at"),
                       "unit_key", "unit_order", "title").orderBy("unit_order", "unit_key")


def map_familiarity(said: Column) -> Column:
    """What is stored for what a user says; null for anything else."""
    return F.element_at(F.create_map(*[F.lit(x) for p in FAMILIARITY.items() for x in p]), said)


def said_familiarity(stored: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for a, b in FAMILIARITY.items() for x in (b, a)]), stored)


def textbook_order(words: DataFrame, units: DataFrame) -> DataFrame:
    """Words with their unit's order; words of a unit that is missing come last, with a null order."""
    return words.join(units.select("unit_key", "unit_order"), "unit_key", "left")


def normalize_speech_text(text: Column) -> Column:
    """NFC, blanks as single spaces, trimmed."""
    return F.trim(F.regexp_replace(normal_form("NFC")(text), r"(?U)\s+", " "))


def join_overlap(left: Column, right: Column) -> Column:
    """Two pieces of a line as one: what ends the left and begins the right stands once; else a space keeps words apart."""
    a, b = F.rtrim(left), F.ltrim(right)
    sizes = F.sequence(F.least(F.length(a), F.length(b)), F.lit(0), F.lit(-1))
    most = F.element_at(F.filter(sizes, lambda n: (n == 0) | (F.right(a, n) == F.left(b, n))), 1)
    joint = F.when(F.right(a, F.lit(1)).rlike(r"^[\p{L}\p{N}]$") & F.left(b, F.lit(1)).rlike(r"^[\p{L}\p{N}]$"), " ").otherwise("")
    return F.when(most > 0, F.concat(a, F.substr(b, most + 1))).otherwise(F.concat(a, joint, b))


def append_once(ids: Column, new: Column) -> Column:
    """The ids with a new one at the end, unless it is there already."""
    had = F.coalesce(ids, F.array().cast("array<string>"))
    return F.when(F.array_contains(had, new), had).otherwise(F.array_append(had, new))


def encode_state(state: Column) -> Column:
    return F.to_json(state)


def decode_state(text: Column, kind: str) -> Column:
    """The struct of a JSON text; null where it is not of that kind."""
    return F.from_json(text, kind, {"mode": "PERMISSIVE"})


def manifest_consistency(manifest: DataFrame, units: DataFrame, targets: DataFrame) -> DataFrame:
    """(release_id, problem): totals that differ from what the units add up to, targets named twice, and targets that are not exactly the units.

    manifest: release_id, units, units_passed, units_blocked, words, cards; units: release_id, unit_key, status, words, cards;
    targets: release_id, unit_key.
    """
    sums = units.groupBy("release_id").agg(
        F.count("*").alias("units"), F.count_if(F.col("status") == "PASSED").alias("units_passed"), F.count_if(F.col("status") == "BLOCKED").alias("units_blocked"),
        F.sum("words").alias("words"), F.sum("cards").alias("cards"))
    names = ["units", "units_passed", "units_blocked", "words", "cards"]
    both = manifest.select("release_id", *[F.col(n).alias(f"said_{n}") for n in names]).join(sums, "release_id", "left")
    totals = both.select("release_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"said_{n}") != F.coalesce(n, F.lit(0)), F.lit(f"totals.{n}")) for n in names]))).alias("problem"))
    counted = targets.groupBy("release_id", "unit_key").agg(F.count("*").alias("_n"))
    twice = counted.where("_n > 1").select("release_id", F.lit("target_units.duplicate").alias("problem")).distinct()
    sides = counted.select("release_id", "unit_key", "_n").join(units.select("release_id", "unit_key", F.lit(1).alias("_unit")), ["release_id", "unit_key"], "full")
    scope = sides.where("_n IS NULL OR _unit IS NULL OR _n > 1").select("release_id", F.lit("target_units.scope").alias("problem")).distinct()
    return totals.unionByName(twice).unionByName(scope)
