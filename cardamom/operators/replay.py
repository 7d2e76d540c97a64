"""Reviews and undos of each user replayed in order, with the states that they leave.

Events are rows (user_id, event_id, seq, at, kind, card, rating, expires_at, target): a ``grade`` of a card in a session that expires,
or an ``undo`` of the event ``target``. They take effect by ``at``, then ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fsrs_rows

EVENT = "user_id long, event_id long, seq long, at long, kind string, card string, rating int, expires_at long, target long"
#: What comes out of a replay: an event's outcome (``card_deleted`` null), or the state that a card is left with.
CHANGE = ("user_id long, event_id long, code string, undone_at long, card string, card_deleted boolean, state string, stability double, difficulty double, "
          "due_at long, last_review_at long, reps int, lapses int, scheduled_days long, learning_steps int")
NO_STATE = (None,) * len(fsrs_rows.State._fields)

# Outcomes of undos that are refused.
NOT_FOUND, UNDONE, NOT_LATEST, EXPIRED = "REVIEW_EVENT_NOT_FOUND", "REVIEW_EVENT_UNDONE", "REVIEW_UNDO_NOT_LATEST", "STUDY_SESSION_EXPIRED"
TAKEN, REPLAYED, OK = "REVIEW_EVENT_ID_TAKEN", "REPLAYED", "OK"


class Event(NamedTuple):
    user_id: int
    event_id: int
    seq: int
    at: int
    kind: str
    card: str | None
    rating: int | None
    expires_at: int | None
    target: int | None

    @property
    def order(self) -> tuple[int, int, int]:
        return self.at, self.seq, self.event_id


class Memory:
    """What a replay keeps of one user; here in dictionaries, in a stream in Spark's state store."""

    def __init__(self):
        self._cards, self._open, self._events = {}, [], {}

    def card(self, card: str) -> fsrs_rows.State | None:
        return self._cards.get(card)

    def set_card(self, card: str, state: fsrs_rows.State | None) -> None:
        if state is None:
            self._cards.pop(card, None)
        else:
            self._cards[card] = state

    def push(self, event_id: int, card: str, before: fsrs_rows.State | None, expires_at: int | None) -> None:
        self._open.append((event_id, card, before, expires_at))

    def top(self) -> tuple | None:
        """(event_id, card, state before, expires_at) of the latest grade that stands."""
        return self._open[-1] if self._open else None

    def pop(self) -> None:
        self._open.pop()

    def code(self, event_id: int) -> str | None:
        """The outcome of an event that was met, UNDONE for a grade that was taken back."""
        return self._events.get(event_id)

    def set_code(self, event: Event, code: str) -> None:
        self._events[event.event_id] = code


def apply(memory: Memory, e: Event) -> tuple[str, str | None]:
    """(outcome, card whose state changed) of one event.

    A grade puts the card's state before on a stack. An undo takes back its target only if that is the latest grade that stands and its session has
    not expired: the state before comes back, or the card has none again if it was its first grade.
    """
    known = memory.code(e.event_id)
    if known is not None:
        return REPLAYED, None
    if e.kind == "grade":
        before = memory.card(e.card)
        memory.push(e.event_id, e.card, before, e.expires_at)
        memory.set_card(e.card, fsrs_rows.next_state(before, e.rating, e.at))
        memory.set_code(e, "GRADED")
        return OK, e.card
    code, card, top, status = OK, None, memory.top(), memory.code(e.target) if e.target is not None else None
    if status not in ("GRADED", UNDONE):
        code = NOT_FOUND
    elif status == UNDONE:
        code = UNDONE
    elif top is None or top[0] != e.target:
        code = NOT_LATEST
    elif top[3] is None or e.at >= top[3]:
        code = EXPIRED
    else:
        card = top[1]
        memory.pop()
        memory.set_card(card, top[2])
        memory.set_code(Event(e.user_id, e.target, 0, 0, "grade", card, None, None, None), UNDONE)
    memory.set_code(e, code)
    return code, card


def claim_events(events: DataFrame) -> DataFrame:
    """Add ``claim``: OK for the first row (by seq) of an event id, REPLAYED for its owner's later ones and REVIEW_EVENT_ID_TAKEN for other users'."""
    order = Window.partitionBy("event_id").orderBy("seq", "at", "user_id")
    mine = F.col("user_id").eqNullSafe(F.first("user_id").over(order))
    return events.withColumn("claim", F.when(F.row_number().over(order) == 1, OK).when(mine, REPLAYED).otherwise(TAKEN))


def replay_users(events: DataFrame) -> DataFrame:
    """Outcomes of all events and states of all cards, as rows of CHANGE: one an event (``undone_at`` of grades is null here), one a card that has a state.

    Users are sorted together and folded one after another, so a task holds one user's cards, open grades and event ids at a time, never their rows.
    Event ids count once, whoever uses them again. Rows without a user or an event id are left out; a table without rows gives none.
    """
    names = [f.split()[0] for f in EVENT.split(", ")]
    claimed = claim_events(events.select(*names).where("user_id IS NOT NULL AND event_id IS NOT NULL"))
    first = claimed.where(F.col("claim") == OK).select(*names).repartition("user_id").sortWithinPartitions("user_id", "at", "seq", "event_id")
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (f.split() for f in CHANGE.split(", "))])

    def left(user: int, memory: Memory) -> Iterator[tuple]:
        for card, state in memory._cards.items():
            yield (user, None, None, None, card, False, *state)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, memory, out = None, Memory(), []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                e = Event(*values)
                if e.user_id != user:
                    out += left(user, memory)
                    user, memory = e.user_id, Memory()
                code, card = apply(memory, e)
                out.append((user, e.event_id, code, e.at if e.kind == "undo" and code == OK else None, card, None, *NO_STATE))
            yield _rows(out, schema)
            out = []
        yield _rows([*left(user, memory)], schema)

    return first.mapInArrow(folded, CHANGE).unionByName(
        claimed.where(F.col("claim") != OK).select("user_id", "event_id", F.col("claim").alias("code")), allowMissingColumns=True)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
