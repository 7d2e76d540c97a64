"""Fixed vectors of the memory model."""

import pytest
from pyspark.sql import functions as F

from cardamom.functions import fsrs
from cardamom.operators import scheduling

DAY, MINUTE = 86_400_000, 60_000
T1 = 1_768_435_200_000  # 2026-01-15T00:00Z
JAN16 = T1 + DAY
MAR7 = 1_772_884_800_000  # 2026-03-07T12:00Z

# Reviews (rating, time) of one card, and its last state
# (state, stability, difficulty, due_at, reps, lapses, scheduled_days, learning_steps).
VECTORS = {
    "again": ([(1, T1)], ("Learning", 0.212, 6.4133, T1 + MINUTE, 1, 0, 0, 0)),
    "hard": ([(2, T1)], ("Learning", 1.2931, 5.11217071, T1 + 6 * MINUTE, 1, 0, 0, 0)),
    "good": ([(3, T1)], ("Learning", 2.3065, 2.11810397, T1 + 10 * MINUTE, 1, 0, 0, 1)),
    "easy": ([(4, T1)], ("Review", 8.2956, 1.0, T1 + 8 * DAY, 1, 0, 8, 0)),
    "good good": ([(3, T1), (3, T1 + MINUTE)], ("Review", 2.3065, 2.11121424, T1 + MINUTE + 2 * DAY, 2, 0, 2, 0)),
    "three goods": ([(3, T1), (3, T1 + MINUTE), (3, T1 + 2 * MINUTE)], ("Review", 2.3065, 2.1043314, T1 + 2 * MINUTE + 3 * DAY, 3, 0, 3, 0)),
    "then hard": ([(3, T1), (3, T1 + MINUTE), (3, T1 + 2 * MINUTE), (2, JAN16)], ("Review", 5.3234637, 4.74371562, JAN16 + 5 * DAY, 4, 0, 5, 0)),
    "lapse": ([(4, T1), (1, T1 + DAY)], ("Relearning", 1.21617837, 7.02698957, T1 + DAY + 10 * MINUTE, 2, 1, 0, 0)),
    "recovery": ([(4, T1), (1, T1 + DAY), (3, T1 + DAY + 10 * MINUTE)], ("Review", 1.26151265, 7.01519095, T1 + 2 * DAY + 10 * MINUTE, 3, 1, 1, 0)),
    "over midnight": ([(3, MAR7), (3, MAR7 + 10 * MINUTE), (4, MAR7 + 2 * DAY + 10 * MINUTE)], ("Review", 18.53433169, 1.0, 1_774_699_800_000, 3, 0, 19, 0)),
}


def test_vectors(spark):
    rows = [(name, "c", at, k, rating) for name, (reviews, _) in VECTORS.items() for k, (rating, at) in enumerate(reviews)]
    log = spark.createDataFrame(rows, "user_id string, content_card_key string, reviewed_at long, ingest_seq long, rating int")
    found = {r.user_id: r for r in scheduling.fold_reviews(log).collect()}
    for name, (_, want) in VECTORS.items():
        r = found[name]
        got = (r.state, r.stability, r.difficulty, r.due_at, r.reps, r.lapses, r.scheduled_days, r.learning_steps)
        assert got[0] == want[0] and got[3:] == want[3:], (name, got)
        assert got[1:3] == pytest.approx(want[1:3], abs=2e-8), (name, got)


def test_recall_of_cards(spark):
    df = spark.createDataFrame([(4.0, T1), (10.0, None)], "stability double, last_review_at long")
    r = [x[0] for x in df.select(fsrs.retrievability(F.struct("stability", "last_review_at"), F.lit(T1 + DAY + 5))).collect()]
    assert r[0] == pytest.approx((1 + fsrs.FACTOR / 4) ** fsrs.DECAY, abs=1e-7) and r[1] == 0.0


def test_undo_takes_back_the_latest_standing_review(spark):
    log = spark.createDataFrame([(k, "u", "c", 3, 10 * k) for k in (1, 2, 3)] + [(4, "v", "c", 3, 5)], "event_id long, user_id string, content_card_key string, rating int, reviewed_at long")
    undos = spark.createDataFrame([("u", 25), ("u", 26), ("u", 27), ("u", 35)], "user_id string, undo_at long")
    found = {r.event_id: r.undone_at for r in scheduling.undo_latest(log, undos).collect()}
    assert found == {1: 26, 2: 25, 3: 35, 4: None}
