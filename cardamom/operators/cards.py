"""Cards and study queues: generation, order, new words, supplements, due reviews and session snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import card_key

# Card types in teaching order.
CARD_TYPE_RANK = {"WORD_MEANING": 0, "CONTEXT_MEANING": 1, "PHRASE": 2, "SENSE_DISCRIMINATION": 3}
REVIEW_LIMIT = 100


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    """Rank of a value in a constant map; null if it is not there."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), value)


def queue_order(cards: DataFrame, words: DataFrame) -> DataFrame:
    """Active cards with their place in the binding order: type, word order in the book, target, card key."""
    order = Window.partitionBy("unit_key").orderBy(rank_of(F.col("card_type"), CARD_TYPE_RANK), "source_order", "target_entity_key", "content_card_key")
    rows = cards.where("status = 'ACTIVE'").join(words.select("word_key", "source_order"), "word_key")
    return rows.withColumn("place", F.row_number().over(order))


def generate_cards(words: DataFrame, senses: DataFrame, phrases: DataFrame, examples: DataFrame, book: str) -> DataFrame:
    """One card a sense, example and phrase, with the stable key of its book, unit, word's place, type and target."""
    parts = [
        senses.select("unit_key", "word_key", F.lit("WORD_MEANING").alias("card_type"), F.col("sense_key").alias("target_entity_key")),
        examples.select("unit_key", "word_key", F.lit("CONTEXT_MEANING").alias("card_type"), F.col("example_key").alias("target_entity_key")),
        phrases.select("unit_key", "word_key", F.lit("PHRASE").alias("card_type"), F.col("phrase_key").alias("target_entity_key")),
    ]
    cards = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(words.select("word_key", "source_order"), "word_key")
    key = card_key(F.lit(book), F.col("unit_key"), F.col("source_order"), F.col("card_type"), F.col("target_entity_key"))
    return cards.withColumn("content_card_key", key).drop("source_order")


def cardless_words(words: DataFrame, cards: DataFrame) -> DataFrame:
    """Words that no card is for."""
    return words.join(cards, "word_key", "left_anti")


def next_new_words(words: DataFrame, progress: DataFrame, users: DataFrame, sizes: str = "new_words_per_group") -> DataFrame:
    """Each user's next words in teaching order (unit, place), as many as the user's group size, without words already begun.

    A user has begun few words, and needs no more than the first ``begun + group size`` of the book: only those are paired.
    """
    # Place in the book: place in the unit after the sizes of the units before (the units of a book are few).
    inside = F.row_number().over(Window.partitionBy("unit_key").orderBy("source_order", "word_key"))
    units = words.groupBy("unit_key", "unit_order").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("unit_order", "unit_key")) - F.col("_size")
    book = words.withColumn("_in", inside).join(units.select("unit_key", before.alias("_before")), "unit_key").withColumn("place", (F.col("_in") + F.col("_before")).cast("int"))
    begun = progress.groupBy("user_id").agg(F.count("*").alias("_begun"))
    wanted = users.join(begun, "user_id", "left").fillna(0, ["_begun"])
    slots = wanted.select("user_id", sizes, F.explode(F.sequence(F.lit(1), (F.col("_begun") + F.col(sizes)).cast("int"))).alias("place"))
    offered = slots.join(book.select("place", "word_key"), "place").join(progress.select("user_id", "word_key"), ["user_id", "word_key"], "left_anti")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    return offered.withColumn("number", number).where(F.col("number") <= F.col(sizes)).select("user_id", "word_key", "number")


def cards_without_state(progress: DataFrame, cards: DataFrame, states: DataFrame) -> DataFrame:
    """Active cards of each user's begun words that the user has not graded."""
    active = cards.where("status = 'ACTIVE'").select("word_key", "content_card_key", "card_type")
    return progress.select("user_id", "word_key").join(active, "word_key").join(states, ["user_id", "content_card_key"], "left_anti")


def review_queue(states: DataFrame, cards: DataFrame, now_ms: int, limit: int = REVIEW_LIMIT, limit_first: bool = False) -> DataFrame:
    """Each user's due cards that the release presents, oldest first, ``limit`` at most; limit_first cuts before the presentable ones are picked."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("due_at", "content_card_key"))
    due = states.where(F.col("due_at") <= now_ms).select("user_id", "content_card_key", "due_at")
    shown = cards.where("status = 'ACTIVE'").select("content_card_key").distinct()
    if limit_first:
        due = due.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")
    due = due.join(shown, "content_card_key", "left_semi")
    return due.withColumn("place", place).where(F.col("place") <= limit)


def build_sessions(queue: DataFrame, now_ms: int, ttl_ms: int = 86_400_000) -> DataFrame:
    """One session a user: the queue's cards in order, and its expiry. A queue has REVIEW_LIMIT cards at most."""
    cards = F.transform(F.array_sort(F.collect_list(F.struct("place", "content_card_key"))), lambda x: x["content_card_key"])
    return queue.groupBy("user_id").agg(cards.alias("cards")).select(
        "user_id", F.size("cards").alias("n_cards"), F.array_join("cards", ",").alias("cards"), F.lit(now_ms).alias("created_at"), F.lit(now_ms + ttl_ms).alias("expires_at"))


def session_groups(sessions: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct units and words of each session's cards."""
    one = sessions.select("session_id", F.explode("cards").alias("content_card_key")).join(cards, "content_card_key")
    return one.groupBy("session_id").agg(F.count_distinct("unit_key").alias("n_units"), F.array_join(F.array_sort(F.collect_set("word_key")), ",").alias("words"))
