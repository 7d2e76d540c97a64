"""Learning statistics of all users at once, from the review log and the card states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fsrs

LOOKBACK_DAYS, FORECAST_DAYS, DIFFICULT, DIFFICULT_FROM = 366, 30, 10, 8.0


def _today(now_ms: int) -> Column:
    return dates.local_date(F.lit(now_ms), F.col("timezone"))


def review_counts(log: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """user_id, reviews_total, reviews_today (since local midnight), undone reviews left out; 0 for users without any."""
    start = dates.start_of_local_day_ms(_today(now_ms), F.col("timezone"))
    # Users are as many as the log's: a shuffled join on the key that the aggregate needs anyway.
    rows = users.select("user_id", start.alias("_start")).join(log.where("undone_at IS NULL").select("user_id", "reviewed_at"), "user_id", "left")
    return rows.groupBy("user_id").agg(
        F.count("reviewed_at").alias("reviews_total"), F.count_if(F.col("reviewed_at") >= F.col("_start")).alias("reviews_today"))


def streaks(log: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """user_id, streak_days: local study days in a row that end today or yesterday, back to 366 days before today."""
    days = (
        log.where("undone_at IS NULL").join(users, "user_id")
        .select("user_id", dates.local_date(F.col("reviewed_at"), F.col("timezone")).alias("day"), _today(now_ms).alias("_today"))
        .where(F.col("day") >= F.date_sub("_today", LOOKBACK_DAYS)).distinct()
    )
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("_island", island).groupBy("user_id", "_island").agg(
        F.max("day").alias("_last"), F.count("*").alias("streak_days"), F.first("_today").alias("_today"))
    live = runs.where((F.col("_last") == F.col("_today")) | (F.col("_last") == F.date_sub("_today", 1)))
    return users.select("user_id").join(live.groupBy("user_id").agg(F.max_by("streak_days", "_last").alias("streak_days")), "user_id", "left").fillna(0, ["streak_days"])


def due_forecast(states: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """user_id, day, cards for the 30 days from today on; overdue cards count today, later ones nowhere."""
    local = users.select("user_id", "timezone", _today(now_ms).alias("_today"))
    bucket = F.greatest(F.datediff(dates.local_date(F.col("due_at"), F.col("timezone")), F.col("_today")), F.lit(0))
    due = states.select("user_id", "due_at").join(local, "user_id").withColumn("_k", bucket).where(F.col("_k") < FORECAST_DAYS)
    counted = due.groupBy("user_id", "_k").count()
    calendar = local.select("user_id", "_today", F.explode(F.sequence(F.lit(0), F.lit(FORECAST_DAYS - 1))).alias("_k"))
    return calendar.join(counted, ["user_id", "_k"], "left").select(
        "user_id", F.date_add("_today", F.col("_k")).alias("day"), F.coalesce("count", F.lit(0)).alias("cards"))


def learned_counts(progress: DataFrame, states: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, learned_words (stage INTRODUCED), learned_cards (graded)."""
    words = progress.groupBy("user_id").agg(F.count_if(F.col("stage") == "INTRODUCED").alias("learned_words"))
    cards = states.groupBy("user_id").agg(F.count("*").alias("learned_cards"))
    return users.select("user_id").join(words, "user_id", "left").join(cards, "user_id", "left").fillna(0)


def retention(states: DataFrame, now_ms: int) -> DataFrame:
    """user_id, estimated_retention: mean recall of the user's graded cards."""
    r = fsrs.retrievability(F.struct("stability", "last_review_at"), F.lit(now_ms))
    return states.groupBy("user_id").agg(F.avg(r).alias("estimated_retention"))


def word_difficulty(states: DataFrame, cards: DataFrame) -> DataFrame:
    """user_id, word_key, lapses, max_difficulty, cards. A card that several releases define counts for its smallest word."""
    words = cards.groupBy("content_card_key").agg(F.min("word_key").alias("word_key"))
    return states.join(words, "content_card_key").groupBy("user_id", "word_key").agg(
        F.sum("lapses").alias("lapses"), F.max("difficulty").alias("max_difficulty"), F.count("*").alias("cards"))


def difficult_words(aggregated: DataFrame, k: int = DIFFICULT) -> DataFrame:
    """The k hardest words of each user, with their place."""
    hard = aggregated.where((F.col("lapses") > 0) | (F.col("max_difficulty") >= DIFFICULT_FROM))
    order = Window.partitionBy("user_id").orderBy(F.desc("lapses"), F.desc("max_difficulty"), "word_key")
    return hard.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def unit_mastery(units: DataFrame, cards: DataFrame, states: DataFrame, users: DataFrame, canonical: DataFrame, now_ms: int) -> DataFrame:
    """user_id, unit_key, total_cards, studied_cards, coverage, estimated_retention of the active cards; presented keys resolve to canonical ones.

    Only studied (user, unit) pairs and each user's units without any are made: the unit catalogue of a release is small.
    """
    active = cards.where("status = 'ACTIVE'").join(canonical.select(F.col("key").alias("content_card_key"), "root"), "content_card_key", "left")
    active = active.select("unit_key", F.coalesce("root", "content_card_key").alias("content_card_key"))
    totals = units.select("unit_key").join(active.groupBy("unit_key").agg(F.count("*").alias("total_cards")), "unit_key", "left").fillna(0, ["total_cards"])
    r = fsrs.retrievability(F.struct("stability", "last_review_at"), F.lit(now_ms))
    studied = states.select("user_id", "content_card_key", r.alias("_r")).join(active, "content_card_key").groupBy("user_id", "unit_key").agg(
        F.count("*").alias("studied_cards"), F.avg("_r").alias("estimated_retention"))
    catalogue = totals.agg(F.collect_list(F.struct("unit_key", "total_cards")).alias("_units"))
    pairs = users.select("user_id").join(F.broadcast(catalogue)).select("user_id", F.explode("_units").alias("_u")).select("user_id", "_u.*")
    return pairs.join(studied, ["user_id", "unit_key"], "left").select(
        "user_id", "unit_key", "total_cards", F.coalesce("studied_cards", F.lit(0)).alias("studied_cards"),
        F.when(F.col("total_cards") == 0, 0.0).otherwise(F.coalesce("studied_cards", F.lit(0)) / F.col("total_cards")).alias("coverage"),
        "estimated_retention")


def latest_event(log: DataFrame) -> DataFrame:
    """Each user's latest review that is not undone, by time and then arrival."""
    order = Window.partitionBy("user_id").orderBy(F.desc("reviewed_at"), F.desc("ingest_seq"))
    return log.where("undone_at IS NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def recent(log: DataFrame, n: int, before_ms: int | None = None) -> DataFrame:
    """The newest n reviews of each user, up to a time if one is given."""
    rows = log if before_ms is None else log.where(F.col("reviewed_at") <= before_ms)
    order = Window.partitionBy("user_id").orderBy(F.desc("reviewed_at"), F.desc("ingest_seq"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(n, 0))


def stats_overview(log: DataFrame, states: DataFrame, progress: DataFrame, cards: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """One row a user: learned counts, retention, review counts, streak, cards due today and in 30 days, hardest words."""
    due = due_forecast(states, users, now_ms).groupBy("user_id").agg(
        F.sum("cards").alias("due_30_days"), F.min_by("cards", "day").alias("due_today"))
    hard = difficult_words(word_difficulty(states, cards)).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word_key"))), lambda x: x["word_key"]), ",").alias("difficult_words"))
    return (
        learned_counts(progress, states, users)
        .join(retention(states, now_ms), "user_id", "left")
        .join(review_counts(log, users, now_ms), "user_id", "left")
        .join(streaks(log, users, now_ms), "user_id", "left")
        .join(due, "user_id", "left").join(hard, "user_id", "left").fillna("", ["difficult_words"])
    )
