"""The memory model of ``fsrs`` for one review at a time, for tasks that keep states themselves."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from .fsrs import DAY, DECAY, FACTOR, MAX_DAYS, MINUTE, W

_EIGHT = Decimal("1e-8")


class State(NamedTuple):
    """The fields of ``fsrs.STATE``."""

    state: str
    stability: float
    difficulty: float
    due_at: int
    last_review_at: int
    reps: int
    lapses: int
    scheduled_days: int
    learning_steps: int


def _round8(x: float) -> float:
    return float(Decimal(repr(x)).quantize(_EIGHT, ROUND_HALF_UP))


def _days_of(stability: float) -> int:
    return int(min(max(math.floor(stability + 0.5), 1), MAX_DAYS))


def _first_difficulty(rating: int) -> float:
    return W[4] + 1 - math.exp((rating - 1) * W[5])


def _stability(s: State, rating: int, days: int) -> float:
    if days == 0:
        grown = math.exp(W[17] * (rating - 3 + W[18])) * s.stability ** -W[19]
        new = s.stability * (max(grown, 1.0) if rating >= 2 else grown)
    else:
        r = _round8((1.0 + FACTOR * days / s.stability) ** DECAY)
        if rating == 1:
            new = min(W[11] * s.difficulty ** -W[12] * ((s.stability + 1) ** W[13] - 1) * math.exp((1.0 - r) * W[14]), s.stability / math.exp(W[17] * W[18]))
        else:
            bonus = {2: W[15], 3: 1.0, 4: W[16]}[rating]
            new = s.stability * (math.exp(W[8]) * (11.0 - s.difficulty) * s.stability ** -W[9] * (math.exp((1.0 - r) * W[10]) - 1) * bonus + 1)
    return _round8(min(max(new, 0.001), float(MAX_DAYS)))


def next_state(s: State | None, rating: int, at: int) -> State:
    """The state after a review; s is None for a new card."""
    if s is None:
        difficulty = _round8(min(max(_first_difficulty(rating), 1.0), 10.0))
        days = _days_of(W[rating - 1]) if rating == 4 else 0
        wait = days * DAY if rating == 4 else (MINUTE, 6 * MINUTE, 10 * MINUTE)[rating - 1]
        return State("Review" if rating == 4 else "Learning", W[rating - 1], difficulty, at + wait, at, 1, 0, days, int(rating == 3))
    elapsed = max(at // DAY - s.last_review_at // DAY, 0)
    moved = s.difficulty + _round8((rating - 3) * (10.0 - s.difficulty) * (-W[6] / 9))
    difficulty = _round8(min(max(_first_difficulty(4) * W[7] + moved * (1 - W[7]), 1.0), 10.0))
    stability, reviewing = _stability(s, rating, elapsed), s.state == "Review"
    graduates = rating == 4 or (rating == 3 and (s.state == "Relearning" or s.learning_steps >= 1)) or (reviewing and rating >= 2)
    if graduates:
        hard, good = (_days_of(_stability(s, k, elapsed)) for k in (2, 3))
        hard = min(hard, good)
        good = max(good, hard + 1) if reviewing else good
        days = (0, hard, good, max(_days_of(_stability(s, 4, elapsed)), good + 1))[rating - 1]
        wait, step, name = days * DAY, 0, "Review"
    else:
        again = reviewing or s.state == "Relearning"
        stay = 15 * MINUTE if again else (10 if s.learning_steps >= 1 else 6) * MINUTE
        wait = (10 * MINUTE if again else MINUTE, stay, 10 * MINUTE)[rating - 1]
        days, step, name = 0, (0, s.learning_steps, 1)[rating - 1], "Relearning" if reviewing else s.state
    return State(name, stability, difficulty, at + wait, at, s.reps + 1, s.lapses + int(reviewing and rating == 1), days, step)
