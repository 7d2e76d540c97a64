"""Model readings, corrections, work packets and session audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def consensus(readings: DataFrame, threshold: float = 0.82) -> DataFrame:
    """packet, agreement (THREE, TWO, CONFLICT or MISMATCH) and candidate of three models' readings.

    Readings (packet, model a, b or c, source, reading) of one packet must name one source. Two readings agree if their similarity
    reaches the threshold; the candidate is the reading of the first agreeing model.
    """
    wide = readings.groupBy("packet").agg(
        F.count_distinct("source").alias("_sources"),
        *[F.max(F.when(F.col("model") == m, F.col("reading"))).alias(m) for m in ("a", "b", "c")])

    def alike(x: str, y: str) -> Column:
        equal = F.col(x) == F.col(y)
        return F.coalesce(F.when(equal, True).otherwise(text.similar(F.col(x), F.col(y), threshold)), F.lit(False))

    pairs = wide.withColumns({"_ab": alike("a", "b"), "_ac": alike("a", "c"), "_bc": alike("b", "c")})
    n = F.col("_ab").cast("int") + F.col("_ac").cast("int") + F.col("_bc").cast("int")
    agreement = F.when(F.col("_sources") > 1, "MISMATCH").when(n == 3, "THREE").when(n >= 1, "TWO").otherwise("CONFLICT")
    candidate = F.when(F.col("_sources") > 1, None).when(F.col("_ab") | F.col("_ac"), F.col("a")).when(F.col("_bc"), F.col("b"))
    return pairs.select("packet", agreement.alias("agreement"), candidate.alias("candidate"))


def latest_results(results: DataFrame) -> DataFrame:
    """The last result of each packet, with the number of its revisions."""
    by = Window.partitionBy("packet")
    last = F.row_number().over(by.orderBy(F.desc("seq")))
    return results.withColumn("revisions", F.count("*").over(by)).withColumn("_n", last).where("_n = 1").drop("_n")


def queue_status(packets: DataFrame, results: DataFrame) -> DataFrame:
    """role, total, resolved, pending by role and, with role null, over all."""
    done = results.select("packet").distinct().withColumn("_done", F.lit(1))
    rows = packets.join(done, "packet", "left")
    counts = rows.rollup("role").agg(F.count("*").alias("total"), F.count("_done").alias("resolved"))
    return counts.withColumn("pending", F.col("total") - F.col("resolved"))


def queue_violations(packets: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the first rule that they break: UNKNOWN_PACKET, HASH_MISMATCH, NOT_FIRST, SHARED_RUN."""
    known = packets.select("packet", F.col("packet_hash").alias("_hash"))
    first = F.row_number().over(Window.partitionBy("packet").orderBy("seq"))
    runs = F.count("*").over(Window.partitionBy("run_id"))
    rows = results.withColumns({"_first": first, "_runs": runs}).join(known, "packet", "left")
    code = F.when(F.col("_hash").isNull(), "UNKNOWN_PACKET").when(F.col("_hash") != F.col("packet_hash"), "HASH_MISMATCH").when(
        F.col("_first") > 1, "NOT_FIRST").when(F.col("_runs") > 1, "SHARED_RUN")
    return rows.withColumn("code", code).where("code IS NOT NULL").select("packet", "seq", "code")


def refresh_packets(stored: DataFrame, results: DataFrame, declared: DataFrame) -> DataFrame:
    """Stored packets that have a result stay as they are; all others are replaced by the declared ones."""
    kept = stored.join(results.select("packet").distinct(), "packet", "left_semi")
    return kept.unionByName(declared.join(kept.select("packet"), "packet", "left_anti"))


def multiset_diff(flagged: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows whose numbers differ between two multisets, by side."""
    return flagged.exceptAll(mapped).withColumn("side", F.lit("unmapped")).unionByName(mapped.exceptAll(flagged).withColumn("side", F.lit("unflagged")))


def fold_repairs(fields: DataFrame, repairs: DataFrame, flagged: DataFrame, round_limit: int = 3) -> DataFrame:
    """Fields with the last repair up to the round limit, for flagged (entity, field) pairs only."""
    good = repairs.where(F.col("round") <= round_limit).join(flagged.select("entity", "field").distinct(), ["entity", "field"], "left_semi")
    last = good.groupBy("entity", "field").agg(F.max_by("value", F.struct("round", "seq")).alias("_new"))
    rows = fields.join(last, ["entity", "field"], "left")
    return rows.select("entity", "field", F.coalesce("_new", "value").alias("value"), F.col("_new").isNotNull().alias("repaired"))


def apply_corrections(rows: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with corrected text, violations): a correction names one row (page, block), its old text and the new text.

    Violations: MISSING_ROW, DUPLICATE, STALE (the old text is another), NOT_ADDITIVE (more than spaces is changed).
    """
    place = ["page", "block"]
    n = F.count("*").over(Window.partitionBy(*place))
    judged = corrections.withColumn("_n", n).join(rows.select(*place, F.col("text").alias("_now")), place, "left")
    code = F.when(F.col("_now").isNull(), "MISSING_ROW").when(F.col("_n") > 1, "DUPLICATE").when(F.col("_now") != F.col("old_text"), "STALE").when(
        ~text.is_additive_space(F.col("old_text"), F.col("new_text")), "NOT_ADDITIVE")
    judged = judged.withColumn("code", code)
    good = judged.where("code IS NULL").select(*place, F.col("new_text").alias("_new"))
    fixed = rows.join(good, place, "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    return fixed, judged.where("code IS NOT NULL").select(*place, "code")


def spacing_candidates(first: DataFrame, second: DataFrame | None = None, least: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """(candidates, mismatches) of lines whose readings split words that the line runs together.

    Readings are (page, block, source, old_text, review_text, review_score), one a line. A candidate has the line's characters and own blanks, at least one
    space more, and a score, the lower of two, of ``least`` or more; it stays UNREVIEWED. With a second reading both must show a split, and lines that only one
    model read (MISSING_FIRST, MISSING_SECOND) or whose source or text differ (SOURCE_DIFFERS) are mismatches and give no candidate.
    """
    place = ["page", "block"]
    # What can't give a candidate goes before the join, which takes one of the two old texts; mismatches need no texts.
    may = (F.col("review_score") >= least) & (F.col("old_text") != F.col("review_text"))
    rows = first.where(may).select(*place, "source", "old_text", "review_text", F.col("review_score").alias("score"))
    if second is None:
        merged = text.merge_spaces(F.col("old_text"), F.col("review_text"))
        bad = first.where(F.lit(False)).select(*place, F.lit(None).cast("string").alias("code"))
    else:
        digest = F.sha2("old_text", 256)
        other = second.select(*place, F.col("source").alias("_source"), digest.alias("_digest"))
        two = second.where(may).select(*place, F.col("source").alias("_source"), digest.alias("_digest"), F.col("review_text").alias("_review_text"), F.col("review_score").alias("_score"))
        rows = rows.join(two, place).where(F.col("source").eqNullSafe(F.col("_source")) & (digest == F.col("_digest"))).withColumn("score", F.least("score", "_score"))
        merged = text.merge_spaces(F.col("old_text"), F.col("review_text"), F.col("_review_text"))
        both = first.select(*place, "source", digest.alias("digest"), F.lit(True).alias("_one")).join(other.withColumn("_two", F.lit(True)), place, "full")
        same = F.col("source").eqNullSafe(F.col("_source")) & F.col("digest").eqNullSafe(F.col("_digest"))
        code = F.when(F.col("_one").isNull(), "MISSING_FIRST").when(F.col("_two").isNull(), "MISSING_SECOND").when(~same, "SOURCE_DIFFERS")
        bad = both.select(*place, code.alias("code")).where("code IS NOT NULL")
    changed = F.explode(F.filter(F.array(merged), lambda c: c != F.col("old_text")))  # a generator, so that no filter makes the candidate a second time
    return rows.select(*place, "source", "old_text", changed.alias("candidate"), "score", F.lit("UNREVIEWED").alias("verdict")), bad


def classify_sessions(sessions: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """session_id, status: the first rule that fails of INVALID, REVOKED, EXPIRED, DISABLED, VERSION_MISMATCH, else OK."""
    known = users.select(F.col("user_id").alias("_user"), "status", F.col("session_version").alias("_version"))
    rows = sessions.join(known, sessions["user_id"] == known["_user"], "left")
    code = F.when(F.col("_user").isNull(), "INVALID").when(F.col("revoked_at").isNotNull(), "REVOKED").when(F.col("expires_at") <= now_ms, "EXPIRED").when(
        F.col("status") != "ACTIVE", "DISABLED").when(F.col("session_version") != F.col("_version"), "VERSION_MISMATCH").otherwise("OK")
    return rows.select("session_id", code.alias("code"))


def failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with the names of the row rules that don't hold, null counting as not holding."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("failed_rules", failed)


def reconcile_pages(blocks: DataFrame, pages: DataFrame, config: str) -> DataFrame:
    """page, status of all expected pages: missing (no rows), stale (a row of another configuration or without a hash), complete."""
    seen = blocks.groupBy("page").agg(F.bool_and((F.col("config") == config) & F.col("image_hash").isNotNull()).alias("_ok"))
    return pages.join(seen, "page", "left").select("page", F.when(F.col("_ok").isNull(), "missing").when(~F.col("_ok"), "stale").otherwise("complete").alias("status"))


def confirm_regions(evidence: DataFrame, fraction: float) -> DataFrame:
    """region, share, confirmed: regions with ink on enough of their pages."""
    shares = evidence.groupBy("region").agg(F.avg(F.col("has_ink").cast("int")).alias("share"))
    return shares.withColumn("confirmed", F.coalesce(F.col("share") >= fraction, F.lit(False)))


def range_sample(df: DataFrame, key: str, parts: int = 8) -> DataFrame:
    """The smallest key in each of ``parts`` equal ranges of its hash."""
    digest = F.sha2(F.col(key), 256)
    part = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") * parts / 65536).cast("int")
    return df.groupBy(part.alias("part")).agg(F.min_by(key, digest).alias(key))


#: Headwords and texts meet by so many characters first.
START = 4


def reassign_texts(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """entity_key, word_key, owner: the word of the same unit whose headword stands in the text, longest first; the present owner if its own does.

    Case doesn't count, and a headword may stand within a word. Texts without their own are looked up, equal ones of a unit once: from each place of the text its
    first characters meet the starts of the unit's headwords, and what goes on there meets whole ones, of which equal ones are one row. So work grows with the texts.
    """
    words = heads.where("headword IS NOT NULL").select("unit_key", "word_key", F.lower("headword").alias("_h"), F.length("headword").alias("_n"))
    rank = lambda first: F.struct(F.lit(first).alias("f"), (-F.col("_n")).alias("n"), F.col("word_key").alias("w")).alias("_c")
    own = texts.join(words, ["unit_key", "word_key"]).where(F.contains(F.lower("text"), F.col("_h"))).select("entity_key", rank(0))
    open_ = texts.join(own.select("entity_key"), "entity_key", "left_anti").select("entity_key", "unit_key", F.lower("text").alias("_x"))

    words = words.groupBy("unit_key", "_h").agg(F.min(rank(1)).alias("_c"))
    starts = words.groupBy("unit_key", F.left("_h", F.lit(START)).alias("_start")).agg(F.collect_set(F.length("_h")).alias("_lengths"))
    sizes = words.select(F.least(F.length("_h"), F.lit(START)).alias("_k")).distinct()  # only a headword of fewer characters has a shorter start
    at = F.explode(F.when(F.col("_k") > 0, F.sequence(F.lit(1), F.length("_x") - F.col("_k") + 1)).otherwise(F.array(F.lit(1))))
    places = open_.select("unit_key", "_x").distinct().join(F.broadcast(sizes), F.length("_x") >= F.col("_k")).select("*", at.alias("_at"))
    near = places.withColumn("_start", F.substr("_x", F.col("_at"), F.col("_k"))).join(starts, ["unit_key", "_start"]).select("unit_key", "_x", "_at", F.explode("_lengths").alias("_l"))
    found = near.select("unit_key", "_x", F.substr("_x", F.col("_at"), F.col("_l")).alias("_h")).join(words, ["unit_key", "_h"]).groupBy("unit_key", "_x").agg(F.min("_c").alias("_c"))
    best = own.unionByName(open_.join(found, ["unit_key", "_x"]).select("entity_key", "_c")).groupBy("entity_key").agg(F.min("_c").alias("_c"))
    return texts.join(best, "entity_key", "left").select("entity_key", "word_key", F.col("_c.w").alias("owner"))


def replay_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """packet, value, outcome after up to three rounds: accepted (a pass), repaired, blocked, or needs_review."""
    order = F.array_sort(F.collect_list(F.struct("round", "verdict", "value")))
    rounds = corrections.where("round <= 3").groupBy("packet").agg(order.alias("_c"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit("needs_review").alias("outcome"))

    def step(s: Column, c: Column) -> Column:
        done = s["outcome"].isin("accepted", "blocked")
        outcome = F.when(done, s["outcome"]).when(c["verdict"] == "pass", F.when(s["value"].isNull(), "accepted").otherwise("repaired")).when(
            c["verdict"] == "block", "blocked").otherwise("needs_review")
        value = F.when(done, s["value"]).when(c["verdict"] == "repair", c["value"]).otherwise(s["value"])
        return F.struct(value.alias("value"), outcome.alias("outcome"))

    folded = rounds.select("packet", F.aggregate("_c", start, step).alias("_s"))
    rows = fields.join(folded, "packet", "left")
    return rows.select("packet", F.coalesce("_s.value", "value").alias("value"), F.coalesce("_s.outcome", F.lit("needs_review")).alias("outcome"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
