"""Reviews and undos replayed by user: in batch against a plain replay, in streams against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from cardamom.functions import fsrs, fsrs_rows
from cardamom.operators import replay
from cardamom.streaming import study

DAY, T0 = 86_400_000, 1_768_435_200_000


def events(n=400, users=5, seed=1):
    """Grades, undos of the latest, of earlier, unknown and expired ones, ties, replays and ids of other users."""
    rng, rows, at = random.Random(seed), [], T0
    graded = {u: [] for u in range(users)}
    for k in range(n):
        u = rng.randrange(users)
        at += rng.choice([0, 1, 60_000, 3_600_000, DAY // 2])
        if rng.random() < 0.3 and graded[u]:
            target = rng.choice([graded[u][-1], graded[u][-1], rng.choice(graded[u]), 10**6, None])
            rows.append((u, 1000 + k, k, at, "undo", None, None, None, target))
            if target == graded[u][-1] and rng.random() < 0.8:
                graded[u].pop()
        else:
            rows.append((u, k, k, at, "grade", f"c{rng.randrange(4)}", rng.randrange(1, 5), at + rng.choice([1, DAY]), None))
            graded[u].append(k)
    again = [(r[0], r[1], n + i, r[3] + 5, *r[4:]) for i, r in enumerate(rng.sample(rows, 20))]
    taken = [((r[0] + 1) % users, r[1], 2 * n + i, r[3] + 5, *r[4:]) for i, r in enumerate(rng.sample(rows, 5))]
    return rows, again + taken


def plain(rows):
    """(outcomes by event, (state, stability) by user and card), by walking all events with a list a user."""
    out, cards, stacks, seen = {}, {}, {}, {}
    for u, i, _, at, kind, card, rating, ends, target in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        stack = stacks.setdefault(u, [])
        if kind == "grade":
            history = cards.setdefault((u, card), [])
            history.append(fsrs_rows.next_state(history[-1] if history else None, rating, at))
            stack.append((i, card, ends))
            out[i], seen[u, i] = replay.OK, True
        elif (u, target) not in seen:
            out[i] = replay.NOT_FOUND
        elif not seen[u, target]:
            out[i] = replay.UNDONE
        elif stack[-1][0] != target:
            out[i] = replay.NOT_LATEST
        elif at >= stack[-1][2]:
            out[i] = replay.EXPIRED
        else:
            cards[u, stack.pop()[1]].pop()
            out[i], seen[u, target] = replay.OK, False
    return out, {k: tuple(v[-1]) for k, v in cards.items() if v}


def read(rows):
    codes = {r.event_id: r.code for r in rows if r.event_id is not None and r.code not in (replay.REPLAYED, replay.TAKEN)}
    cards = {(r.user_id, r.card): tuple(r[f] for f in fsrs_rows.State._fields) for r in rows if r.event_id is None and not r.card_deleted}
    return codes, cards


def test_rows_follow_the_columns(spark):
    rng = random.Random(3)
    histories = [[(rng.randrange(1, 5), T0 + d) for d in sorted(rng.choice([1, 60_000, DAY, 9 * DAY]) * rng.randrange(1, 40) for _ in range(12))] for _ in range(60)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(histories)], "k int, h array<struct<rating:int,at:bigint>>")
    found = df.select("k", F.aggregate("h", F.lit(None).cast(fsrs.STATE), lambda s, e: fsrs.next_state(s, e["rating"], e["at"])).alias("s")).collect()
    for r in found:
        state = None
        for rating, at in histories[r.k]:
            state = fsrs_rows.next_state(state, rating, at)
        assert tuple(r.s)[3:] == state[3:] and r.s.state == state.state and tuple(r.s)[1:3] == pytest.approx(state[1:3], abs=1e-6)


def test_batch_replay(spark):
    rows, extra = events()
    df = spark.createDataFrame(rows + extra + [(None, 1, 1, 1, "grade", "c", 1, 1, None), (1, None, 1, 1, "grade", "c", 1, 1, None)], replay.EVENT)
    out = replay.replay_users(df.withColumn("code", F.lit("x"))).collect()
    want = plain(rows)
    assert read(out) == want
    assert {replay.OK, replay.NOT_FOUND, replay.UNDONE, replay.NOT_LATEST, replay.EXPIRED} == set(want[0].values())
    assert sum(r.code == replay.REPLAYED for r in out) == 20 and sum(r.code == replay.TAKEN for r in out) == 5
    assert replay.replay_users(df.limit(0)).count() == 0


def test_undo_restores_and_deletes(spark):
    rows = [(1, 1, 1, T0, "grade", "a", 3, T0 + DAY, None), (1, 2, 2, T0 + 1, "grade", "a", 4, T0 + DAY, None), (1, 3, 3, T0 + 2, "undo", None, None, None, 2)]
    state = lambda r: {(x.user_id, x.card): x.reps for x in replay.replay_users(spark.createDataFrame(r, replay.EVENT)).collect() if x.event_id is None}
    assert state(rows[:2]) == {(1, "a"): 2} and state(rows) == {(1, "a"): 1}
    assert state([*rows, (1, 4, 4, T0 + 3, "undo", None, None, None, 1)]) == {}


def run_stream(spark, batches, folder):
    """All changes of a stream over the batches, with a restart after each; the sink keeps the latest by key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", study.STATE_STORE)
    kept = {}

    def sink(df, _):
        for r in df.collect():
            kept[(r.event_id,) if r.event_id is not None else (r.user_id, r.card)] = r

    for rows in batches:
        spark.createDataFrame(rows, replay.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        claimed = study.claim_events_stream(spark.readStream.schema(replay.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        claimed.writeStream.option("checkpointLocation", f"{folder}/cp1").trigger(availableNow=True).start(f"{folder}/claimed").awaitTermination()
        stream = spark.readStream.schema(f"{replay.EVENT}, claim string").parquet(f"{folder}/claimed")
        query = study.replay_users_stream(stream).writeStream.outputMode("update").foreachBatch(sink)
        query.option("checkpointLocation", f"{folder}/cp2").trigger(availableNow=True).start().awaitTermination()
    return read(kept.values())


def test_stream_agrees_with_the_batch(spark, tmp_path):
    rows, extra = events(150, 3, seed=2)
    want = read(replay.replay_users(spark.createDataFrame(rows, replay.EVENT)).collect())
    assert want == plain(rows)
    known = {r[1] for r in rows[:61]}
    early = [r for r in extra if r[1] in known]  # a replay comes after the event
    in_order = [rows[:60], rows[60:61], [*rows[61:110], *early], [*rows[110:], *(r for r in extra if r not in early)]]
    assert run_stream(spark, in_order, tmp_path / "in order") == want  # every batch is a restart from the checkpoint
    mixed = list(rows)
    random.Random(5).shuffle(mixed)
    late = [mixed[:50], mixed[50:120], mixed[120:] + rows[:10]]
    assert run_stream(spark, late, tmp_path / "late") == want

