"""Reviews and undos as a stream with keyed state: what ``replay.replay_users`` gives for the same events.

Two stateful operators follow each other. The first is keyed by event id and remembers its owner for good, so a replay counts once however
late it comes, and an id that another user sends again is refused. The second is keyed by user and keeps, in the state store, the states of
the cards, the stack of grades that can be undone, and the events themselves. Events that come in order change the state at once; if one
comes after later ones were applied, its user's events are applied anew from the first. So batches, their order and restarts don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fsrs_rows import State
from ..operators import replay
from ..operators.replay import CHANGE, EVENT, NO_STATE, Event

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "state string, stability double, difficulty double, due_at long, last_review_at long, reps int, lapses int, scheduled_days long, learning_steps int"
_NAMES = [f.split()[0] for f in EVENT.split(", ")]
_CHANGE = Row(*[f.split()[0] for f in CHANGE.split(", ")])


class _Claims(StatefulProcessor):
    """The owner of each event id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "user_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r.seq, r.at, r.user_id)):
            owner = self.owner.get()[0] if self.owner.exists() else None
            if owner is None:
                self.owner.update((row.user_id,))
            claim = replay.OK if owner is None else replay.REPLAYED if owner == row.user_id else replay.TAKEN
            yield Row(*_NAMES, "claim")(*[row[n] for n in _NAMES], claim)

    def close(self) -> None:
        pass


class _Stored(replay.Memory):
    """A user's memory in the state store. The stack is a map by depth, so that pushing and popping touch one entry."""

    def __init__(self, cards, stack, events, place):
        self.cards, self.stack, self.events, self.place = cards, stack, events, place
        self.depth, self.last = 0, None
        if place.exists():
            depth, *last = place.get()
            self.depth, self.last = depth, tuple(last)

    def save(self) -> None:
        self.place.update((self.depth, *self.last))

    def reset(self) -> None:
        self.cards.clear()
        self.stack.clear()
        self.depth = 0

    def card(self, card: str) -> State | None:
        return State(*self.cards.getValue((card,))) if self.cards.containsKey((card,)) else None

    def set_card(self, card: str, state: State | None) -> None:
        if state is None:
            self.cards.removeKey((card,))
        else:
            self.cards.updateValue((card,), tuple(state))

    def push(self, event_id, card, before, expires_at) -> None:
        self.depth += 1
        self.stack.updateValue((self.depth,), (event_id, card, expires_at, *(before or NO_STATE)))

    def top(self) -> tuple | None:
        if not self.depth:
            return None
        event_id, card, expires_at, *before = self.stack.getValue((self.depth,))
        return event_id, card, State(*before) if before[0] is not None else None, expires_at

    def pop(self) -> None:
        self.stack.removeKey((self.depth,))
        self.depth -= 1

    def code(self, event_id: int) -> str | None:
        return self.events.getValue((event_id,))[-1] if self.events.containsKey((event_id,)) else None

    def set_code(self, event: Event, code: str) -> None:
        if code == replay.UNDONE and event.kind == "grade":  # the grade itself stays in the store
            event = Event(*self.events.getValue((event.event_id,))[:-1])
        self.events.updateValue((event.event_id,), (*event, code))


class _Users(StatefulProcessor):
    """Cards, stack and events of each user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cards = handle.getMapState("cards", "card string", _STATE)
        self.stack = handle.getMapState("stack", "depth int", f"event_id long, card string, expires_at long, {_STATE}")
        self.events = handle.getMapState("events", "event_id long", f"{EVENT}, code string".replace("event_id long", "id long"))
        self.place = handle.getValueState("place", "depth int, at long, seq long, event_id long")

    def _memory(self) -> _Stored:
        return _Stored(self.cards, self.stack, self.events, self.place)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        memory = self._memory()
        new = sorted((Event(*[r[n] for n in _NAMES]) for r in rows), key=lambda e: e.order)
        new = [e for e in new if memory.code(e.event_id) is None]
        if not new:
            return
        had: set[str] = set()
        if memory.last and new[0].order < memory.last:
            had = {k[0] for k in memory.cards.keys()}
            new = sorted([*new, *(Event(*v[:-1]) for v in memory.events.values())], key=lambda e: e.order)
            memory.reset()
            memory.events.clear()
        touched = set(had)
        for e in new:
            code, card = replay.apply(memory, e)
            yield _CHANGE(e.user_id, e.event_id, code, e.at if e.kind == "undo" and code == replay.OK else None, card, None, *NO_STATE)
            if card is not None:
                touched.add(card)
        memory.last = max(filter(None, [memory.last, new[-1].order]))
        memory.save()
        for card in sorted(touched):
            state = memory.card(card)
            yield _CHANGE(key[0], None, None, None, card, state is None, *(state or NO_STATE))

    def close(self) -> None:
        pass


def claim_events_stream(stream: DataFrame) -> DataFrame:
    """Add ``claim`` as ``replay.claim_events`` does, for all batches together; the first row to come is the first."""
    rows = stream.select(*_NAMES).where("user_id IS NOT NULL AND event_id IS NOT NULL")
    return rows.groupBy("event_id").transformWithState(_Claims(), f"{EVENT}, claim string", "Append", "None")


def replay_users_stream(stream: DataFrame) -> DataFrame:
    """Changes as rows of CHANGE: outcomes of events, and the states of the cards that they changed (``card_deleted`` if there is none any more).

    For a sink that keeps the latest row by event and by (user, card). The stream has claimed events, as ``claim_events_stream`` gives them; others
    are left out. The session must use the RocksDB state store (STATE_STORE). An event that comes late makes a task read its user's events, all others
    touch their own entries only. Nothing is forgotten, so that late events and undos get the outcome that they have in batch.
    """
    rows = stream.where(F.col("claim") == replay.OK).select(*_NAMES)
    return rows.groupBy("user_id").transformWithState(_Users(), CHANGE, "Update", "None")
