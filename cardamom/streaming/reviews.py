"""Review events as a stream; each job gives what its batch twin gives on the same events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scheduling


def dedupe_events_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once by event_id; replays are recognised within the watermark's delay."""
    timed = stream.withColumn("event_time", F.timestamp_millis("reviewed_at"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Reviews by user and UTC day; late events count up to the delay."""
    return dedupe_events_stream(stream, delay).groupBy(F.window("event_time", "1 day"), "user_id").agg(F.count("*").alias("reviews")).select(
        F.col("window.start").alias("day"), "user_id", "reviews")


def fold_into_table(read_log: Callable[[], DataFrame | None], write_log: Callable[[DataFrame], None], write_states: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new events join the kept log once by id, and the states of the users of the batch are folded anew.

    The log is the permanent guard against replays, however late they come.
    """
    def step(batch: DataFrame, _: int) -> None:
        new = scheduling.dedupe_events(batch)
        log = read_log()
        if log is not None:
            new = new.join(log.select("event_id"), "event_id", "left_anti")
            whole = log.join(new.select("user_id").distinct(), "user_id", "left_semi").unionByName(new)
        else:
            whole = new
        write_states(scheduling.fold_reviews(whole))
        write_log(new)

    return step
