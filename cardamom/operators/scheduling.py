"""Spaced-repetition state as folds over the review log: idempotent ingest, replay, undo, stages and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fsrs


def dedupe_events(attempts: DataFrame) -> DataFrame:
    """The first attempt of each event id counts; replays are dropped. Ids that another user owns are thereby rejected."""
    order = Window.partitionBy("event_id").orderBy("ingest_seq")
    return attempts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fold_reviews(log: DataFrame) -> DataFrame:
    """The state of every (user, card) after its reviews in order of arrival. Undone reviews must have been taken out before.

    One array a (user, card) is folded: a card's own history, whose length a person's reviews bound.
    """
    history = log.groupBy("user_id", "content_card_key").agg(
        F.array_sort(F.collect_list(F.struct("reviewed_at", "ingest_seq", "rating"))).alias("_h"))
    folded = F.aggregate("_h", F.lit(None).cast(fsrs.STATE), lambda s, e: fsrs.next_state(s, e["rating"], e["reviewed_at"]))
    return history.withColumn("_s", folded).select("user_id", "content_card_key", "_s.*")


def state_chain(log: DataFrame) -> DataFrame:
    """The log with ``reps`` and the stability after each review."""
    history = log.groupBy("user_id", "content_card_key").agg(
        F.array_sort(F.collect_list(F.struct("reviewed_at", "ingest_seq", "rating", "event_id"))).alias("_h"))
    start = F.array().cast(f"array<{fsrs.STATE}>")
    chain = F.aggregate("_h", start, lambda s, e: F.concat(s, F.array(fsrs.next_state(F.get(s, F.size(s) - 1), e["rating"], e["reviewed_at"]))))
    return history.select("user_id", "content_card_key", F.explode(F.arrays_zip("_h", chain.alias("_c"))).alias("_x")).select(
        "user_id", "content_card_key", "_x._h.event_id", "_x._h.ingest_seq", "_x._c.reps", "_x._c.stability", "_x._c.state")


def chain_breaks(chain: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Reviews whose state before differs from the state after the card's previous review."""
    order = Window.partitionBy("user_id", "content_card_key").orderBy("ingest_seq")
    return chain.withColumn("expected", F.lag(after).over(order)).where(~F.col(before).eqNullSafe(F.col("expected")))


def undo_latest(log: DataFrame, undos: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The log with ``undone_at`` filled: each undo takes back its user's latest review so far that still stands.

    A user's reviews and undos are replayed in order as brackets: the number of open reviews after each event says
    which review an undo closes, so no stack is kept. Undos without an open review do nothing,
    and neither do undos whose review belongs to no session of ``sessions`` (session_id, expires_at) or to one that has expired;
    log then has the session's id. A user's later sessions must not expire before earlier ones.
    """
    events = log.select("user_id", F.col("reviewed_at").alias("at"), F.lit(0).alias("kind"), "event_id").unionByName(
        undos.select("user_id", F.col("undo_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("event_id")))
    order = Window.partitionBy("user_id").orderBy("at", "kind", "event_id")
    depth = F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    floor = F.least(F.min("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = events.withColumn("_raw", depth).withColumn("_depth", F.col("_raw") - floor).withColumn("_place", F.row_number().over(order))
    # A review is at depth d; the undo that closes it is the first later event that leaves depth d - 1.
    slot = F.when(F.col("kind") == 0, F.col("_depth")).otherwise(F.col("_depth") + 1)
    near = Window.partitionBy("user_id", "_slot").orderBy("_place")
    paired = rows.withColumn("_slot", slot).withColumn("_next_kind", F.lead("kind").over(near)).withColumn("_next_at", F.lead("at").over(near))
    closed = paired.where("kind = 0").select("event_id", F.when(F.col("_next_kind") == 1, F.col("_next_at")).alias("undone_at"))
    undone = log.drop("undone_at").join(closed, "event_id")
    if sessions is None:
        return undone
    ends = sessions.select("session_id", F.col("expires_at").alias("_ends"))
    in_time = F.when(F.col("undone_at") < F.col("_ends"), F.col("undone_at"))
    return undone.join(ends, "session_id", "left").withColumn("undone_at", in_time).drop("_ends")


def word_stages(log: DataFrame, cards: DataFrame) -> DataFrame:
    """user_id, word_key, stage: INTRODUCED if all active cards of the word are graded, else IN_PROGRESS."""
    active = cards.where("status = 'ACTIVE'").select("content_card_key", "word_key").distinct()
    sizes = active.groupBy("word_key").agg(F.count("*").alias("_cards"))
    seen = log.select("user_id", "content_card_key").distinct().join(active, "content_card_key").groupBy("user_id", "word_key").agg(F.count("*").alias("graded_cards"))
    return seen.join(sizes, "word_key").select(
        "user_id", "word_key", "graded_cards", F.when(F.col("graded_cards") == F.col("_cards"), "INTRODUCED").otherwise("IN_PROGRESS").alias("stage"))


def validate_positions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session events with their queue position and whether each names the card that is due there.

    Positions are the number of grades before in the session; a session past its end or its expiry accepts none.
    """
    order = Window.partitionBy("session_id").orderBy("reviewed_at", "event_id")
    rows = events.withColumn("position", F.row_number().over(order) - 1).join(sessions.select("session_id", "cards", "expires_at"), "session_id")
    wanted = F.get("cards", F.col("position"))
    code = F.when(F.col("reviewed_at") >= F.col("expires_at"), "SESSION_EXPIRED").when(wanted.isNull(), "QUEUE_EXHAUSTED").when(
        wanted != F.col("content_card_key"), "CARD_MISMATCH").otherwise("OK")
    return rows.withColumn("code", code).drop("cards", "expires_at")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Insert or overwrite by key with the latest change; null columns of a change leave what is there."""
    values = [c for c in current.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), order_by).alias("_new"))
    joined = current.withColumn("_old", F.struct(*values)).select(*keys, "_old").join(latest, keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in values])


def active_sessions(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Sessions that have not expired."""
    return sessions.where(F.col("expires_at") > now_ms)
