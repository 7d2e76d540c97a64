"""Queries over the study log, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fsrs
from ..operators import replay, scheduling, stats
from ..sources import standins as s
from ..sources.standins import NOW_MS, with_views

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query
    return keep


def _live(spark: SparkSession, d: str) -> DataFrame:
    return s.review_log(spark, d).where("undone_at IS NULL")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return scheduling.fold_reviews(_live(spark, d))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the log belong to the words of the same number."""
    return s.card_definition(spark, d)


_DAY_START = f"epoch_ms(timezone(us.timezone, date_trunc('day', timezone(us.timezone, to_timestamp({NOW_MS} / 1000.0)))))"
_LOCAL = "CAST(timezone(us.timezone, to_timestamp({} / 1000.0)) AS DATE)"


@_add("A02_review_counts", f"""
SELECT us.user_id, count(l.reviewed_at) AS reviews_total, count(*) FILTER (l.reviewed_at >= {_DAY_START}) AS reviews_today
FROM user_settings us LEFT JOIN (SELECT * FROM review_log WHERE undone_at IS NULL) l ON l.user_id = us.user_id GROUP BY us.user_id""")
def review_counts(spark, d):
    return stats.review_counts(s.review_log(spark, d), s.user_settings(spark, d), NOW_MS)


_STREAK = f"""days AS (SELECT DISTINCT l.user_id, {_LOCAL.format('l.reviewed_at')} AS day, {_LOCAL.format(NOW_MS)} AS today
  FROM review_log l JOIN user_settings us ON us.user_id = l.user_id WHERE l.undone_at IS NULL),
islands AS (SELECT user_id, day, today, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM days WHERE day >= today - 366),
runs AS (SELECT user_id, max(day) AS last_day, count(*) AS n, any_value(today) AS today FROM islands GROUP BY user_id, g),
streak AS (SELECT us.user_id, coalesce(max(r.n), 0) AS streak_days FROM user_settings us LEFT JOIN runs r ON r.user_id = us.user_id AND r.last_day >= r.today - 1 GROUP BY us.user_id)"""


@_add("WN05_streaks", f"WITH {_STREAK} SELECT * FROM streak")
def streaks(spark, d):
    return stats.streaks(s.review_log(spark, d), s.user_settings(spark, d), NOW_MS)


# The memory model in SQL, one step of a recursive query at a time. Written from the published formulas.
_w = fsrs.W
_R = f"round(pow(1 + {fsrs.FACTOR!r} * days / p.stability, {fsrs.DECAY!r}), 8)"
_SHORT = f"p.stability * exp({_w[17]} * ({{g}} - 3 + {_w[18]})) * pow(p.stability, -{_w[19]})"
_GAIN = f"exp({_w[8]}) * (11 - p.difficulty) * pow(p.stability, -{_w[9]}) * (exp((1 - {_R}) * {_w[10]}) - 1)"


def _s(g: int) -> str:
    short = _SHORT.format(g=g) if g < 2 else f"greatest({_SHORT.format(g=g)}, p.stability)"
    if g == 1:
        long = f"least({_w[11]} * pow(p.difficulty, -{_w[12]}) * (pow(p.stability + 1, {_w[13]}) - 1) * exp((1 - {_R}) * {_w[14]}), p.stability / exp({_w[17]} * {_w[18]}))"
    else:
        long = f"p.stability * (1 + {_GAIN} * {({2: _w[15], 3: 1, 4: _w[16]})[g]})"
    return f"round(least(greatest(CASE WHEN days = 0 THEN {short} ELSE {long} END, 0.001), 36500.0), 8)"


_FOLD = f"""h AS (SELECT *, row_number() OVER (PARTITION BY user_id, content_card_key ORDER BY reviewed_at, ingest_seq) AS k FROM review_log WHERE undone_at IS NULL),
f(user_id, content_card_key, k, state, stability, difficulty, due_at, last_review_at, reps, lapses, step) AS (
  SELECT user_id, content_card_key, k, CASE WHEN rating = 4 THEN 'Review' ELSE 'Learning' END,
    CAST(CASE rating WHEN 1 THEN {_w[0]} WHEN 2 THEN {_w[1]} WHEN 3 THEN {_w[2]} ELSE {_w[3]} END AS DOUBLE),
    CAST(round(least(greatest({_w[4]} + 1 - exp({_w[5]} * (rating - 1)), 1), 10), 8) AS DOUBLE),
    reviewed_at + CASE rating WHEN 1 THEN 60000 WHEN 2 THEN 360000 WHEN 3 THEN 600000 ELSE 8 * 86400000 END, reviewed_at, 1, 0, CASE WHEN rating = 3 THEN 1 ELSE 0 END
  FROM h WHERE k = 1
  UNION ALL
  SELECT user_id, content_card_key, k, CASE WHEN grad THEN 'Review' WHEN was = 'Review' THEN 'Relearning' ELSE was END,
    CASE rating WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END, d,
    reviewed_at + CASE WHEN grad THEN 86400000 * CASE rating WHEN 2 THEN least(i2, i3) WHEN 3 THEN good ELSE greatest(i4, good + 1) END
      WHEN rating = 1 THEN CASE WHEN was = 'Learning' THEN 60000 ELSE 600000 END
      WHEN rating = 2 THEN CASE WHEN was <> 'Learning' THEN 900000 WHEN was_step >= 1 THEN 600000 ELSE 360000 END ELSE 600000 END,
    reviewed_at, reps + 1, lapses + CASE WHEN was = 'Review' AND rating = 1 THEN 1 ELSE 0 END, CASE WHEN grad OR rating = 1 THEN 0 WHEN rating = 2 THEN was_step ELSE 1 END
  FROM (SELECT *, CASE WHEN was = 'Review' THEN greatest(i3, least(i2, i3) + 1) ELSE i3 END AS good FROM (
    SELECT *, CAST(greatest(round(s2), 1) AS BIGINT) AS i2, CAST(greatest(round(s3), 1) AS BIGINT) AS i3, CAST(greatest(round(s4), 1) AS BIGINT) AS i4,
      rating = 4 OR (rating = 3 AND (was = 'Relearning' OR was_step >= 1)) OR (was = 'Review' AND rating >= 2) AS grad FROM (
      SELECT p.user_id, p.content_card_key, p.nk AS k, p.rating, p.reviewed_at, p.state AS was, p.step AS was_step, p.reps, p.lapses, {_s(1)} AS s1, {_s(2)} AS s2, {_s(3)} AS s3, {_s(4)} AS s4,
        round(least(greatest({_w[7]} * ({_w[4]} + 1 - exp({_w[5]} * 3)) + (1 - {_w[7]}) * (p.difficulty + round(-{_w[6]} * (p.rating - 3) * (10 - p.difficulty) / 9, 8)), 1), 10), 8) AS d
      FROM (SELECT f.*, h.k AS nk, h.rating, h.reviewed_at, CAST(greatest(h.reviewed_at // 86400000 - f.last_review_at // 86400000, 0) AS DOUBLE) AS days
            FROM f JOIN h ON h.user_id = f.user_id AND h.content_card_key = f.content_card_key AND h.k = f.k + 1) p)))
),
st AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, content_card_key ORDER BY k DESC) = 1),
rt AS (SELECT *, round(pow(1 + {fsrs.FACTOR!r} * greatest(({NOW_MS} - last_review_at) // 86400000, 0) / stability, {fsrs.DECAY!r}), 8) AS r FROM st)"""


@_add("SS02_fold_reviews", f"""WITH RECURSIVE {_FOLD}
SELECT user_id, content_card_key, state, round(stability, 4) AS stability, round(difficulty, 4) AS difficulty, due_at, CAST(reps AS INT) AS reps, CAST(lapses AS INT) AS lapses FROM st""")
def fold_reviews(spark, d):
    return _states(spark, d).select("user_id", "content_card_key", "state", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), "due_at", "reps", "lapses")


@_add("A03_retention", f"WITH RECURSIVE {_FOLD} SELECT user_id, round(avg(r), 5) AS estimated_retention FROM rt GROUP BY user_id")
def retention(spark, d):
    return stats.retention(_states(spark, d), NOW_MS).select("user_id", F.round("estimated_retention", 5).alias("estimated_retention"))


_WORD_OF = "cw AS (SELECT content_card_key, min(word_key) AS word_key FROM card_definition GROUP BY 1)"
_HARD = f"""wd AS (SELECT user_id, word_key, CAST(sum(lapses) AS BIGINT) AS lapses, max(difficulty) AS max_difficulty, count(*) AS cards FROM st JOIN cw USING (content_card_key) GROUP BY 1, 2),
hard AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lapses DESC, max_difficulty DESC, word_key) AS place FROM wd WHERE lapses > 0 OR max_difficulty >= 8)"""


@_add("A04_word_difficulty", f"WITH RECURSIVE {_FOLD}, {_WORD_OF}, {_HARD} SELECT user_id, word_key, lapses, round(max_difficulty, 4) AS max_difficulty, cards FROM wd")
def word_difficulty(spark, d):
    return stats.word_difficulty(_states(spark, d), _cards(spark, d)).withColumn("max_difficulty", F.round("max_difficulty", 4))


@_add("O04_difficult_words", f"WITH RECURSIVE {_FOLD}, {_WORD_OF}, {_HARD} SELECT user_id, word_key, lapses, CAST(place AS INT) AS place FROM hard WHERE place <= 10")
def difficult_words(spark, d):
    return stats.difficult_words(stats.word_difficulty(_states(spark, d), _cards(spark, d))).select("user_id", "word_key", "lapses", "place")


_DUE = f"""due AS (SELECT us.user_id, greatest({_LOCAL.format('st.due_at')} - {_LOCAL.format(NOW_MS)}, 0) AS k FROM st JOIN user_settings us ON us.user_id = st.user_id),
fc AS (SELECT us.user_id, {_LOCAL.format(NOW_MS)} + CAST(n.k AS INT) AS day, count(due.k) AS cards
  FROM user_settings us JOIN range(30) n(k) ON true LEFT JOIN due ON due.user_id = us.user_id AND due.k = n.k GROUP BY 1, 2)"""


@_add("A06_due_forecast", f"WITH RECURSIVE {_FOLD}, {_DUE} SELECT user_id, CAST(day AS VARCHAR) AS day, cards FROM fc")
def due_forecast(spark, d):
    return stats.due_forecast(_states(spark, d), s.user_settings(spark, d), NOW_MS).withColumn("day", F.col("day").cast("string"))


_STAGE = """active AS (SELECT DISTINCT content_card_key, word_key FROM card_definition WHERE status = 'ACTIVE'),
stage AS (SELECT g.user_id, g.word_key, g.n AS graded_cards, CASE WHEN g.n = z.n THEN 'INTRODUCED' ELSE 'IN_PROGRESS' END AS stage
  FROM (SELECT l.user_id, a.word_key, count(*) AS n FROM (SELECT DISTINCT user_id, content_card_key FROM review_log WHERE undone_at IS NULL) l JOIN active a USING (content_card_key) GROUP BY 1, 2) g
  JOIN (SELECT word_key, count(*) AS n FROM active GROUP BY 1) z USING (word_key))"""


def _progress(spark, d):
    return scheduling.word_stages(_live(spark, d), _cards(spark, d))


@_add("SS04_word_stages", f"WITH {_STAGE} SELECT * FROM stage")
def word_stages(spark, d):
    return _progress(spark, d)


@_add("A01_learned_counts", f"""WITH RECURSIVE {_FOLD}, {_STAGE}
SELECT us.user_id, coalesce(w.n, 0) AS learned_words, coalesce(c.n, 0) AS learned_cards FROM user_settings us
LEFT JOIN (SELECT user_id, count(*) FILTER (stage = 'INTRODUCED') AS n FROM stage GROUP BY 1) w ON w.user_id = us.user_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM st GROUP BY 1) c ON c.user_id = us.user_id""")
def learned_counts(spark, d):
    return stats.learned_counts(_progress(spark, d), _states(spark, d), s.user_settings(spark, d))


@_add("A05_unit_mastery", f"""WITH RECURSIVE {_FOLD},
act AS (SELECT unit_key, content_card_key FROM card_definition WHERE status = 'ACTIVE'),
tot AS (SELECT u.unit_key, count(a.content_card_key) AS n FROM unit u LEFT JOIN act a USING (unit_key) GROUP BY 1),
got AS (SELECT rt.user_id, act.unit_key, count(*) AS n, avg(r) AS m FROM rt JOIN act USING (content_card_key) GROUP BY 1, 2)
SELECT us.user_id, t.unit_key, t.n AS total_cards, coalesce(g.n, 0) AS studied_cards, round(CASE WHEN t.n = 0 THEN 0 ELSE coalesce(g.n, 0) / t.n END, 6) AS coverage, round(g.m, 5) AS estimated_retention
FROM user_settings us JOIN tot t ON true LEFT JOIN got g ON g.user_id = us.user_id AND g.unit_key = t.unit_key""")
def unit_mastery(spark, d):
    from ..operators import aliases
    canonical = aliases.resolve_aliases(s.content_key_alias(spark, d)).where("code IS NULL").select("key", "root")
    out = stats.unit_mastery(s.unit(spark, d), _cards(spark, d), _states(spark, d), s.user_settings(spark, d), canonical, NOW_MS)
    return out.withColumns({"coverage": F.round("coverage", 6), "estimated_retention": F.round("estimated_retention", 5)})


@_add("C01_stats_overview", f"""WITH RECURSIVE {_FOLD}, {_WORD_OF}, {_HARD}, {_DUE}, {_STAGE}, {_STREAK}
SELECT us.user_id, coalesce(w.n, 0) AS learned_words, coalesce(c.n, 0) AS learned_cards, round(c.r, 5) AS estimated_retention, rc.total AS reviews_total, rc.today AS reviews_today,
  sk.streak_days, CAST(fd.total AS BIGINT) AS due_30_days, fd.today AS due_today, coalesce(hd.words, '') AS difficult_words
FROM user_settings us
LEFT JOIN (SELECT user_id, count(*) FILTER (stage = 'INTRODUCED') AS n FROM stage GROUP BY 1) w ON w.user_id = us.user_id
LEFT JOIN (SELECT user_id, count(*) AS n, avg(r) AS r FROM rt GROUP BY 1) c ON c.user_id = us.user_id
LEFT JOIN (SELECT us.user_id, count(l.reviewed_at) AS total, count(*) FILTER (l.reviewed_at >= {_DAY_START}) AS today FROM user_settings us LEFT JOIN (SELECT * FROM review_log WHERE undone_at IS NULL) l ON l.user_id = us.user_id GROUP BY 1) rc ON rc.user_id = us.user_id
LEFT JOIN streak sk ON sk.user_id = us.user_id
LEFT JOIN (SELECT user_id, sum(cards) AS total, arg_min(cards, day) AS today FROM fc GROUP BY 1) fd ON fd.user_id = us.user_id
LEFT JOIN (SELECT user_id, string_agg(word_key, ',' ORDER BY place) AS words FROM hard WHERE place <= 10 GROUP BY 1) hd ON hd.user_id = us.user_id""")
def stats_overview(spark, d):
    out = stats.stats_overview(s.review_log(spark, d), _states(spark, d), _progress(spark, d), _cards(spark, d), s.user_settings(spark, d), NOW_MS)
    return out.withColumn("estimated_retention", F.round("estimated_retention", 5))


@_add("WN02_latest_event", "SELECT user_id, event_id, reviewed_at FROM review_log WHERE undone_at IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at DESC, ingest_seq DESC) = 1")
def latest_event(spark, d):
    return stats.latest_event(s.review_log(spark, d)).select("user_id", "event_id", "reviewed_at")


@_add("O05_recent", f"""SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at DESC, ingest_seq DESC) AS place
FROM review_log WHERE reviewed_at <= {NOW_MS - 86_400_000}) WHERE place <= 5""")
def recent(spark, d):
    return stats.recent(s.review_log(spark, d), 5, NOW_MS - 86_400_000).select("user_id", "event_id", "place")


@_add("SS01_dedupe_events", "SELECT event_id, user_id, rating, reviewed_at FROM review_attempt QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingest_seq) = 1")
def dedupe_events(spark, d):
    return scheduling.dedupe_events(s.review_attempt(spark, d)).select("event_id", "user_id", "rating", "reviewed_at")


def _undos(spark, d):
    return s.review_log(spark, d).where("undone_at IS NOT NULL").selectExpr("user_id", "undone_at AS undo_at").unionByName(
        s.review_log(spark, d).where("event_id % 29 = 0").selectExpr("user_id", "reviewed_at + 90000 AS undo_at"))


@_add("SS03_undo_latest", """
WITH ev AS (SELECT user_id, reviewed_at AS moment, 0 AS kind, event_id FROM review_log
  UNION ALL SELECT user_id, undone_at, 1, NULL FROM review_log WHERE undone_at IS NOT NULL UNION ALL SELECT user_id, reviewed_at + 90000, 1, NULL FROM review_log WHERE event_id % 29 = 0),
raw AS (SELECT *, row_number() OVER w AS place, sum(CASE kind WHEN 0 THEN 1 ELSE -1 END) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY moment, kind, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
deep AS (SELECT *, depth - least(min(depth) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING), 0) + kind AS slot FROM raw),
paired AS (SELECT *, lead(kind) OVER (PARTITION BY user_id, slot ORDER BY place) AS next_kind, lead(moment) OVER (PARTITION BY user_id, slot ORDER BY place) AS next_at FROM deep)
SELECT p.event_id, p.user_id, p.moment AS reviewed_at, CASE WHEN next_kind = 1 AND next_at < s.expires_at THEN next_at END AS undone_at
FROM paired p JOIN study_session s ON s.session_id = 'u' || CAST(p.user_id AS VARCHAR) || '.' || CAST(p.moment // 86400000 AS VARCHAR) WHERE kind = 0""")
def undo_latest(spark, d):
    log = s.review_log(spark, d).withColumn("session_id", F.expr("concat('u', user_id, '.', reviewed_at div 86400000)"))
    return scheduling.undo_latest(log, _undos(spark, d), s.study_session(spark, d)).select("event_id", "user_id", "reviewed_at", "undone_at")


def _replayed(spark, d):
    """Grades of the log, undos of some, too late or not the latest, of unknown ids and of one another; every 23rd event is sent again."""
    rows = s.review_attempt(spark, d).join(s.study_session(spark, d).selectExpr("user_id", "created_at div 86400000 AS day", "expires_at"), "user_id").where("reviewed_at div 86400000 = day")
    grades = rows.selectExpr("user_id", "event_id", "ingest_seq AS seq", "reviewed_at AS at", "'grade' AS kind", "content_card_key AS card", "CAST(rating AS INT) AS rating",
                             "expires_at - CASE WHEN event_id % 7 = 0 THEN 86400000 ELSE 0 END AS expires_at", "CAST(NULL AS BIGINT) AS target")
    undo = ("user_id", "-event_id AS event_id", "ingest_seq AS seq", "undone_at AS at", "'undo' AS kind", "CAST(NULL AS STRING) AS card", "CAST(NULL AS INT) AS rating",
            "CAST(NULL AS BIGINT) AS expires_at", "CASE WHEN event_id % 5 = 0 THEN event_id + 1 WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END AS target")
    log = s.review_log(spark, d).where("undone_at IS NOT NULL")
    again = log.where("event_id % 2 = 0").selectExpr("user_id", "event_id", "ingest_seq", "undone_at + 1 AS undone_at").selectExpr(*undo).withColumn("event_id", F.expr("event_id - 1000000000"))
    return grades.unionByName(log.selectExpr(*undo)).unionByName(again)


@_add("U07_replay_users", """
WITH RECURSIVE grade AS (
  SELECT r.user_id, event_id, ingest_seq AS seq, reviewed_at AS moment, 'grade' AS kind, content_card_key AS card, expires_at - CASE WHEN event_id % 7 = 0 THEN 86400000 ELSE 0 END AS ends, NULL::BIGINT AS target
  FROM review_attempt r JOIN study_session s ON s.user_id = r.user_id AND s.created_at // 86400000 = reviewed_at // 86400000),
undo AS (
  SELECT user_id, -event_id AS event_id, ingest_seq AS seq, undone_at AS moment, 'undo' AS kind, NULL::VARCHAR AS card, NULL::BIGINT AS ends,
    CASE WHEN event_id % 5 = 0 THEN event_id + 1 WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END AS target
  FROM review_log WHERE undone_at IS NOT NULL),
every AS (SELECT * FROM grade UNION ALL SELECT * FROM undo UNION ALL SELECT user_id, event_id - 1000000000, seq, moment + 1, kind, card, ends, target FROM undo WHERE event_id % 2 = 0),
claimed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq, moment, user_id) AS nth FROM every),
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, seq, event_id) AS place FROM claimed WHERE nth = 1),
walk AS (
  SELECT user_id, 0 AS place, [] ::STRUCT(id BIGINT, ends BIGINT)[] AS stack, []::BIGINT[] AS undone, []::BIGINT[] AS graded, NULL::BIGINT AS event_id, NULL::VARCHAR AS code, NULL::VARCHAR AS kind FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, place, CASE WHEN kind = 'grade' THEN list_append(stack, {'id': event_id, 'ends': ends}) WHEN code = 'OK' THEN stack[:-2] ELSE stack END,
    CASE WHEN kind = 'undo' AND code = 'OK' THEN list_append(undone, target) ELSE undone END, CASE WHEN kind = 'grade' THEN list_append(graded, event_id) ELSE graded END, event_id, code, kind
  FROM (
    SELECT e.user_id, e.place, w.stack, w.undone, w.graded, e.event_id, e.kind, e.target, e.ends,
      CASE WHEN e.kind = 'grade' THEN 'OK' WHEN NOT list_contains(w.graded, e.target) THEN 'REVIEW_EVENT_NOT_FOUND' WHEN list_contains(w.undone, e.target) THEN 'REVIEW_EVENT_UNDONE'
        WHEN w.stack[-1].id <> e.target THEN 'REVIEW_UNDO_NOT_LATEST' WHEN e.moment >= w.stack[-1].ends THEN 'STUDY_SESSION_EXPIRED' ELSE 'OK' END AS code
    FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.place = w.place + 1)),
final AS (SELECT user_id, unnest(stack).id AS event_id FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place DESC) = 1)
SELECT user_id, 'event' AS what, CAST(event_id AS VARCHAR) AS name, code, NULL::INT AS reps FROM walk WHERE place > 0
UNION ALL SELECT user_id, 'event', CAST(event_id AS VARCHAR), 'REPLAYED', NULL FROM claimed WHERE nth > 1
UNION ALL SELECT f.user_id, 'card', card, NULL, count(*)::INT FROM final f JOIN ev e ON e.event_id = f.event_id GROUP BY f.user_id, card""")
def replay_users(spark, d):
    out = replay.replay_users(_replayed(spark, d))
    event = F.col("event_id").isNotNull()
    return out.select("user_id", F.when(event, "event").otherwise("card").alias("what"), F.when(event, F.col("event_id").cast("string")).otherwise(F.col("card")).alias("name"), "code", "reps")


@_add("SS06_validate_positions", """
WITH ev AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '.' || CAST(reviewed_at // 86400000 AS VARCHAR) AS session_id, user_id, event_id, content_card_key, reviewed_at FROM review_log),
p AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.session_id ORDER BY ev.reviewed_at, ev.event_id) - 1 AS position FROM ev)
SELECT p.session_id, p.event_id, CAST(position AS INT) AS position, CASE WHEN p.reviewed_at >= s.expires_at THEN 'SESSION_EXPIRED' WHEN position >= len(s.cards) THEN 'QUEUE_EXHAUSTED'
  WHEN s.cards[position + 1] <> p.content_card_key THEN 'CARD_MISMATCH' ELSE 'OK' END AS code FROM p JOIN study_session s USING (session_id)""")
def validate_positions(spark, d):
    events = s.review_log(spark, d).withColumn("session_id", F.expr("concat('u', user_id, '.', reviewed_at div 86400000)"))
    return scheduling.validate_positions(events, s.study_session(spark, d)).select("session_id", "event_id", "position", "code")


@_add("SS07_active_sessions", f"SELECT session_id, user_id, expires_at FROM study_session WHERE expires_at > {NOW_MS - 3 * 86_400_000}")
def active_sessions(spark, d):
    return scheduling.active_sessions(s.study_session(spark, d), NOW_MS - 3 * 86_400_000).select("session_id", "user_id", "expires_at")


@_add("SS09_upsert", """
WITH cur AS (SELECT user_id, timezone, new_words_per_group FROM user_settings WHERE user_id % 2 = 0),
chg AS (SELECT user_id, NULL AS timezone, CAST(max(rating) AS INT) AS n FROM (SELECT user_id, rating FROM review_log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq DESC) = 1) GROUP BY 1)
SELECT coalesce(cur.user_id, chg.user_id) AS user_id, cur.timezone, coalesce(chg.n, cur.new_words_per_group) AS new_words_per_group FROM cur FULL JOIN chg ON cur.user_id = chg.user_id""")
def upsert(spark, d):
    changes = s.review_log(spark, d).select("user_id", F.lit(None).cast("string").alias("timezone"), F.col("rating").cast("int").alias("new_words_per_group"), "ingest_seq")
    return scheduling.upsert(s.user_settings(spark, d).where("user_id % 2 = 0"), changes, ["user_id"], "ingest_seq")


@_add("WN11_chain_breaks", f"""WITH RECURSIVE {_FOLD}, b AS (SELECT user_id, content_card_key, k, reps, lag(reps) OVER (PARTITION BY user_id, content_card_key ORDER BY k) AS prev FROM f)
SELECT user_id, content_card_key, count(*) AS breaks FROM b WHERE reps % 3 = 0 AND prev IS NOT NULL GROUP BY 1, 2""")
def chain_breaks(spark, d):
    # Every third review carries a wrong state before it, so exactly those break the chain.
    from pyspark.sql import Window
    chain = scheduling.state_chain(_live(spark, d))
    before = F.lag("reps").over(Window.partitionBy("user_id", "content_card_key").orderBy("ingest_seq"))
    seeded = chain.withColumn("before", F.when(F.col("reps") % 3 == 0, before + 100).otherwise(before)).withColumn("after", F.col("reps"))
    return scheduling.chain_breaks(seeded).groupBy("user_id", "content_card_key").agg(F.count("*").alias("breaks"))


@_add("DT01_local_dates", f"""SELECT l.event_id, CAST({_LOCAL.format('l.reviewed_at')} AS VARCHAR) AS day,
epoch_ms(timezone(us.timezone, CAST({_LOCAL.format('l.reviewed_at')} AS TIMESTAMP))) AS day_start FROM review_log l JOIN user_settings us ON us.user_id = l.user_id""")
def local_dates(spark, d):
    rows = s.review_log(spark, d).join(s.user_settings(spark, d), "user_id")
    day = dates.local_date(F.col("reviewed_at"), F.col("timezone"))
    return rows.select("event_id", day.cast("string").alias("day"), dates.start_of_local_day_ms(day, F.col("timezone")).alias("day_start"))
