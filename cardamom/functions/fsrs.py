"""The FSRS-6 memory model as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published default weights w0 to w20.
W = [0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629,
     1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542]
DECAY = -W[20]
FACTOR = 0.9 ** (1 / DECAY) - 1
MINUTE, DAY = 60_000, 86_400_000
MAX_DAYS = 36_500
STATE = "struct<state:string,stability:double,difficulty:double,due_at:bigint,last_review_at:bigint,reps:int,lapses:int,scheduled_days:bigint,learning_steps:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def round8(x: Column) -> Column:
    return F.round(x, 8)


def recall(days: Column, stability: Column) -> Column:
    """Probability of recall after so many days."""
    return round8(F.pow(F.lit(1.0) + F.lit(FACTOR) * days / stability, F.lit(DECAY)))


def retrievability(state: Column, now_ms: Column) -> Column:
    """Recall now, by whole days since the last review; 0 if never reviewed."""
    days = F.floor((now_ms - state["last_review_at"]) / DAY)
    return F.when(state["last_review_at"].isNull(), 0.0).otherwise(recall(F.greatest(days, F.lit(0)), state["stability"]))


def elapsed_days_utc(before_ms: Column, now_ms: Column) -> Column:
    """Difference of UTC calendar days, 0 at least."""
    return F.greatest(F.floor(now_ms / DAY) - F.floor(before_ms / DAY), F.lit(0))


def _first_difficulty(rating: Column) -> Column:
    return F.lit(W[4] + 1) - F.exp((rating - 1) * W[5])


def _next_difficulty(difficulty: Column, rating: Column) -> Column:
    moved = difficulty + round8((rating - 3) * (F.lit(10.0) - difficulty) * (-W[6] / 9))
    return round8(F.least(F.greatest(_first_difficulty(F.lit(4)) * W[7] + moved * (1 - W[7]), F.lit(1.0)), F.lit(10.0)))


def _bounded(stability: Column) -> Column:
    return round8(F.least(F.greatest(stability, F.lit(0.001)), F.lit(float(MAX_DAYS))))


def _next_stability(s: Column, rating: int, days: Column) -> Column:
    """Stability after a rating: short-term within a UTC day, else recall or forgetting."""
    stability, difficulty = s["stability"], s["difficulty"]
    grown = F.exp(F.lit(W[17] * (rating - 3 + W[18]))) * F.pow(stability, F.lit(-W[19]))
    short = stability * (F.greatest(grown, F.lit(1.0)) if rating >= 2 else grown)
    r = recall(days, stability)
    if rating == 1:
        long = F.least(
            F.lit(W[11]) * F.pow(difficulty, F.lit(-W[12])) * (F.pow(stability + 1, F.lit(W[13])) - 1) * F.exp((F.lit(1.0) - r) * W[14]),
            stability / F.exp(F.lit(W[17] * W[18])),
        )
    else:
        bonus = {2: W[15], 3: 1.0, 4: W[16]}[rating]
        gain = F.exp(F.lit(W[8])) * (F.lit(11.0) - difficulty) * F.pow(stability, F.lit(-W[9])) * (F.exp((F.lit(1.0) - r) * W[10]) - 1) * bonus
        long = stability * (gain + 1)
    return _bounded(F.when(days == 0, short).otherwise(long))


def _days_of(stability: Column) -> Column:
    """Interval for a recall of 0.9, which is the stability itself."""
    return F.least(F.greatest(F.round(stability), F.lit(1.0)), F.lit(float(MAX_DAYS))).cast("bigint")


def _state(name: Column | str, stability: Column, difficulty: Column, at: Column, wait: Column, reps: Column, lapses: Column, days: Column, step: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(
        name.alias("state"), stability.alias("stability"), difficulty.alias("difficulty"), (at + wait).cast("bigint").alias("due_at"),
        at.cast("bigint").alias("last_review_at"), reps.cast("int").alias("reps"), lapses.cast("int").alias("lapses"),
        days.cast("bigint").alias("scheduled_days"), step.cast("int").alias("learning_steps"),
    ).cast(STATE)


def _pick(rating: Column, values: list) -> Column:
    out = F.lit(values[3]) if not isinstance(values[3], Column) else values[3]
    for k in (2, 1, 0):
        out = F.when(rating == k + 1, values[k]).otherwise(out)
    return out


def first_state(rating: Column, at: Column) -> Column:
    """State after the first grade of a new card: learning steps of 1 and 10 minutes, 6 for Hard; Easy goes to Review."""
    stability = _pick(rating, W[:4])
    difficulty = round8(F.least(F.greatest(_first_difficulty(rating), F.lit(1.0)), F.lit(10.0)))
    days = F.when(rating == 4, _days_of(stability)).otherwise(0)
    wait = F.when(rating == 4, days * DAY).otherwise(_pick(rating, [MINUTE, 6 * MINUTE, 10 * MINUTE, 0]))
    return _state(F.when(rating == 4, "Review").otherwise("Learning"), stability, difficulty, at, wait, F.lit(1), F.lit(0), days, F.when(rating == 3, 1).otherwise(0))


def next_state(before: Column, rating: Column, at: Column) -> Column:
    """State after a grade; ``before`` is null for a new card. Ratings 1 to 4: Again, Hard, Good, Easy."""
    return F.when(before.isNull(), first_state(rating, at)).otherwise(
        let(F.struct(before.alias("b"), elapsed_days_utc(before["last_review_at"], at).alias("days")), lambda x: _graded(x["b"], x["days"], rating, at)))


def _graded(b: Column, days: Column, rating: Column, at: Column) -> Column:
    values = F.struct(*[_next_stability(b, k, days).alias(f"s{k}") for k in (1, 2, 3, 4)], _next_difficulty(b["difficulty"], rating).alias("d"))

    def choose(v: Column) -> Column:
        reviewing = b["state"] == "Review"
        stability = _pick(rating, [v["s1"], v["s2"], v["s3"], v["s4"]])
        good = F.when(reviewing, F.greatest(_days_of(v["s3"]), F.least(_days_of(v["s2"]), _days_of(v["s3"])) + 1)).otherwise(_days_of(v["s3"]))
        hard = F.least(_days_of(v["s2"]), _days_of(v["s3"]))
        easy = F.greatest(_days_of(v["s4"]), good + 1)
        relearning = (b["state"] == "Relearning") | reviewing
        graduates = (rating == 4) | ((rating == 3) & ((b["state"] == "Relearning") | (b["learning_steps"] >= 1))) | (reviewing & (rating >= 2))
        interval = F.when(~graduates, 0).otherwise(_pick(rating, [F.lit(0), hard, good, easy]))
        # Steps: learning 1 and 10 minutes (Hard on the first: 6), relearning 10 minutes (Hard: 15).
        again = F.when(relearning, 10 * MINUTE).otherwise(MINUTE)
        stay = F.when(relearning, 15 * MINUTE).when(b["learning_steps"] >= 1, 10 * MINUTE).otherwise(6 * MINUTE)
        wait = F.when(graduates, interval * DAY).otherwise(_pick(rating, [again, stay, F.lit(10 * MINUTE), F.lit(0)]))
        step = F.when(graduates | (rating == 1), 0).when(rating == 2, b["learning_steps"]).otherwise(1)
        name = F.when(graduates, "Review").when(reviewing, "Relearning").otherwise(b["state"])
        return _state(name, stability, v["d"], at, wait, b["reps"] + 1, b["lapses"] + F.when(reviewing & (rating == 1), 1).otherwise(0), interval, step)

    return let(values, choose)
