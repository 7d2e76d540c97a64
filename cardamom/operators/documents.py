"""Positioned text blocks and page lines: furniture, duplicates, quality flags, page signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes x0, y0, x1, y1; 0 if both are empty."""
    width = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    height = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    inner = width * height
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def _box(suffix: str = "") -> dict[str, Column]:
    return {c: F.col(c + suffix) for c in ("x0", "y0", "x1", "y1")}


def iou_pairs(blocks: DataFrame, threshold: float, bands: int = 100) -> DataFrame:
    """page, block, block2, iou of overlapping boxes of a page.

    Boxes meet in the horizontal bands of the page that they cover, so only boxes that are near each other are compared.
    """
    band = F.explode(F.sequence(F.floor(F.col("y0") * bands), F.floor(F.col("y1") * bands)))
    left = blocks.select("page", "block", "x0", "y0", "x1", "y1").withColumn("_band", band)
    right = left.select("page", "_band", F.col("block").alias("block2"), *[F.col(c).alias(c + "2") for c in ("x0", "y0", "x1", "y1")])
    first = F.floor(F.greatest("y0", "y02") * bands) == F.col("_band")
    near = left.join(right, ["page", "_band"]).where((F.col("block") < F.col("block2")) & first)
    return near.withColumn("iou", iou(_box(), _box("2"))).where(F.col("iou") >= threshold).select("page", "block", "block2", "iou")


def lines_in_regions(lines: DataFrame, regions: DataFrame, slack: float = 0.005) -> DataFrame:
    """Line boxes that lie inside a region of their page, up to slack. A page has few regions."""
    r = regions.select("page", *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")])
    inside = (
        (lines["page"] == r["page"]) & (lines["x0"] >= r["_x0"] - slack) & (lines["x1"] <= r["_x1"] + slack)
        & (lines["y0"] >= r["_y0"] - slack) & (lines["y1"] <= r["_y1"] + slack)
    )
    return lines.join(r, inside, "left_semi")


def header_repeats(lines: DataFrame) -> DataFrame:
    """text, pages: on how many pages each raw line stands."""
    return lines.groupBy("text").agg(F.count_distinct("doc_id").alias("pages"))


def partition_furniture(lines: DataFrame, min_pages: int = 3) -> DataFrame:
    """Lines with a flag for furniture: blank ones, and those that stand on min_pages pages or more."""
    repeated = header_repeats(lines).where(F.col("pages") >= min_pages).select("text", F.lit(True).alias("_repeated"))
    blank = F.trim("text") == ""
    return lines.join(repeated, "text", "left").select("doc_id", "line", "text", (blank | F.coalesce("_repeated", F.lit(False))).alias("furniture"))


def quality_flags(lines: DataFrame) -> DataFrame:
    """doc_id, line and the flags that apply: digits, brackets, long_run (13 letters or more), symbols."""
    flags = F.array_compact(F.array(
        F.when(F.col("text").rlike("[0-9]"), "digit"),
        F.when(F.col("text").rlike(r"[\[\](){}]"), "bracket"),
        F.when(F.col("text").rlike("[A-Za-z]{13,}"), "long_run"),
        F.when(F.col("text").rlike("[#$%&*|]"), "symbol"),
    ))
    return lines.select("doc_id", "line", flags.alias("_f")).where(F.size("_f") > 0).select("doc_id", "line", F.array_join("_f", ",").alias("flags"))


def confidence_gate(blocks: DataFrame, review_below: float = 0.9, drop_below: float = 0.5) -> DataFrame:
    """Blocks with a verdict by confidence: dropped, review or kept."""
    verdict = F.when(F.col("confidence") < drop_below, "dropped").when(F.col("confidence") < review_below, "review").otherwise("kept")
    return blocks.withColumn("verdict", verdict)


def page_signals(lines: DataFrame, every: int = 20) -> DataFrame:
    """book, page, signal: pages of ``every`` documents make a book; a page's signal is the unit number in its first line's length, if any."""
    first = lines.where("line = 1").select(
        F.floor(F.col("doc_id") / every).alias("book"), F.col("doc_id").alias("page"), F.length("text").alias("_n"))
    return first.select("book", "page", F.when(F.col("_n") % 3 != 0, F.floor(F.col("_n") / 50)).alias("signal"))


def signal_runs(signals: DataFrame) -> DataFrame:
    """Runs of equal signals on consecutive pages of a book: book, run, signal, first_page, last_page, pages. Pages without a signal are passed over."""
    order = Window.partitionBy("book").orderBy("page")
    some = signals.where("signal IS NOT NULL")
    starts = some.withColumn("_new", (~F.col("signal").eqNullSafe(F.lag("signal").over(order))).cast("int"))
    numbered = starts.withColumn("run", F.sum("_new").over(order))
    return numbered.groupBy("book", "run", "signal").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


def smooth_runs(runs: DataFrame) -> DataFrame:
    """A run of one page between two runs of one other signal takes that signal."""
    order = Window.partitionBy("book").orderBy("run")
    before, after = F.lag("signal").over(order), F.lead("signal").over(order)
    lone = (F.col("pages") == 1) & before.isNotNull() & (before == after)
    return runs.withColumn("smoothed", F.when(lone, before).otherwise(F.col("signal")))


def chapter_fill(signals: DataFrame) -> DataFrame:
    """Each page with the last signal at or before it; null before the first."""
    order = Window.partitionBy("book").orderBy("page")
    return signals.withColumn("chapter", F.last("signal", ignorenulls=True).over(order))


def nearest_signal(signals: DataFrame) -> DataFrame:
    """Each page with the signal of the nearest page that has one; of two as near, the earlier."""
    order = Window.partitionBy("book").orderBy("page")
    place = F.when(F.col("signal").isNotNull(), F.struct("page", "signal"))
    before = F.last(place, ignorenulls=True).over(order)
    after = F.first(place, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = signals.withColumns({"_b": before, "_a": after})
    first = F.col("_a").isNull() | (F.col("page") - F.col("_b.page") <= F.col("_a.page") - F.col("page"))
    return rows.withColumn("nearest", F.when(F.col("_b").isNotNull() & first, F.col("_b.signal")).otherwise(F.col("_a.signal"))).drop("_b", "_a")


def attach_lines(lines: DataFrame, is_header: Column) -> DataFrame:
    """Lines with the number of the last header line at or above them on their page; null above the first."""
    order = Window.partitionBy("doc_id").orderBy("line")
    return lines.withColumn("header_line", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(order))


def contiguity_errors(openers: DataFrame) -> DataFrame:
    """Openers (group, place, number) whose number is not one more than the one before, 1 at first."""
    order = Window.partitionBy("group").orderBy("place")
    return openers.withColumn("expected", F.coalesce(F.lag("number").over(order), F.lit(0)) + 1).where("number <> expected")


def duplicate_boxes(blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Blocks that an overlapping block with the same text and higher confidence (or smaller number) makes superfluous."""
    facts = blocks.select("page", "block", "text", "confidence")
    pairs = iou_pairs(blocks, threshold).join(facts, ["page", "block"]).join(
        facts.select("page", F.col("block").alias("block2"), F.col("text").alias("_t2"), F.col("confidence").alias("_c2")), ["page", "block2"])
    loser = F.when(F.col("confidence") >= F.col("_c2"), F.col("block2")).otherwise(F.col("block"))
    return pairs.where("text = _t2").select("page", loser.alias("block")).distinct()


def replace_pages(old: DataFrame, new: DataFrame, page: str = "page") -> DataFrame:
    """Old rows of pages that were not run again, and all new rows."""
    return old.join(new.select(page).distinct(), page, "left_anti").unionByName(new)
