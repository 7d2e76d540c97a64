"""Queries over releases, sessions and content parity, with DuckDB SQL for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, releases
from ..sources import standins as s
from ..sources.standins import NOW_MS, with_views
from .study_queries import _STAGE, _progress

QUERIES, ORACLES = {}, {}
#: Sessions count as open for this long before the clock of the queries, so that some are.
_THEN = NOW_MS - 3 * 86_400_000


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query
    return keep


def _some_words(spark, d):
    return s.word(spark, d).where("p_partkey % 19 <> 0")


@_add("J03_orphans", """WITH w AS (SELECT * FROM word WHERE p_partkey % 19 <> 0)
SELECT 'sense->word' AS pair, count(*) AS orphans FROM sense WHERE word_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'phrase->word', count(*) FROM phrase WHERE word_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'example->word', count(*) FROM example WHERE word_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'card->word', count(*) FROM card_definition WHERE word_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'word->unit', count(*) FROM w WHERE unit_key NOT IN (SELECT unit_key FROM unit)
UNION ALL SELECT 'alias->word', count(*) FROM content_key_alias WHERE from_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'review->card', count(*) FROM review_log WHERE content_card_key NOT IN (SELECT content_card_key FROM card_definition)""")
def orphans(spark, d):
    w, c = _some_words(spark, d), s.card_definition(spark, d)
    return releases.orphans({
        "sense->word": (s.sense(spark, d), "word_key", w, "word_key"), "phrase->word": (s.phrase(spark, d), "word_key", w, "word_key"),
        "example->word": (s.example(spark, d), "word_key", w, "word_key"), "card->word": (c, "word_key", w, "word_key"),
        "word->unit": (w, "unit_key", s.unit(spark, d), "unit_key"), "alias->word": (s.content_key_alias(spark, d), "from_key", w, "word_key"),
        "review->card": (s.review_log(spark, d), "content_card_key", c, "content_card_key"),
    })


def _tables(spark, d):
    return {"words": s.word(spark, d), "senses": s.sense(spark, d), "phrases": s.phrase(spark, d), "examples": s.example(spark, d), "cards": s.card_definition(spark, d)}


_COUNTS = """cnt AS (SELECT unit_key, 'words' AS metric, count(*) AS n FROM word GROUP BY 1 UNION ALL SELECT unit_key, 'senses', count(*) FROM sense GROUP BY 1 UNION ALL SELECT unit_key, 'phrases', count(*) FROM phrase GROUP BY 1
  UNION ALL SELECT unit_key, 'examples', count(*) FROM example GROUP BY 1 UNION ALL SELECT unit_key, 'cards', count(*) FROM card_definition GROUP BY 1)"""


@_add("A07_count_parity", f"""WITH {_COUNTS}, w AS (SELECT unit_key, 'words' AS metric, count(*) AS n FROM word WHERE p_partkey % 19 <> 0 GROUP BY 1)
SELECT c.unit_key, c.metric, coalesce(CASE WHEN c.metric = 'words' THEN w.n ELSE c.n END, 0) AS expected, c.n AS actual FROM cnt c LEFT JOIN w ON w.unit_key = c.unit_key WHERE c.metric = 'words' AND coalesce(w.n, 0) <> c.n""")
def count_parity(spark, d):
    """The report was made from the words without every 19th."""
    tables = _tables(spark, d)
    report = releases.counts_by({**tables, "words": _some_words(spark, d)}, "unit_key").withColumnRenamed("n", "expected").withColumnRenamed("table", "metric")
    return releases.count_parity(report, tables, "unit_key")


@_add("A08_capacity", "SELECT 'words' AS metric, count(*) AS n, 20000 AS cap, count(*) <= 20000 AS within FROM word UNION ALL SELECT 'cards', count(*), 100000, count(*) <= 100000 FROM card_definition UNION ALL SELECT 'audio', count(*), 50000, count(*) <= 50000 FROM example")
def capacity(spark, d):
    return releases.capacity({"words": s.word(spark, d), "cards": s.card_definition(spark, d), "audio": s.example(spark, d)})


@_add("A09_index_parity", "SELECT (SELECT count(*) FROM word) + (SELECT count(*) FROM sense) + (SELECT count(*) FROM phrase) + (SELECT count(*) FROM example) AS expected, (SELECT count(*) FROM word) + (SELECT count(*) FROM sense) + (SELECT count(*) FROM phrase) + (SELECT count(*) FROM example) AS actual")
def index_parity(spark, d):
    from ..operators import search
    index = search.search_documents(s.sense(spark, d), s.phrase(spark, d), s.example(spark, d)).select("word_key").unionByName(s.word(spark, d).select("word_key"))
    parts = [t.select(F.lit(1).alias("x")) for n, t in _tables(spark, d).items() if n != "cards"]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.agg(F.count("*").alias("expected")).join(index.agg(F.count("*").alias("actual")))


@_add("X03_set_diff", """WITH a AS (SELECT word_key FROM word WHERE p_partkey % 19 <> 0), b AS (SELECT word_key FROM word WHERE p_partkey % 23 <> 0)
SELECT word_key, 'missing' AS side FROM a WHERE word_key NOT IN (SELECT word_key FROM b) UNION ALL SELECT word_key, 'extra' FROM b WHERE word_key NOT IN (SELECT word_key FROM a)""")
def set_diff(spark, d):
    return releases.set_diff(_some_words(spark, d).select("word_key"), s.word(spark, d).where("p_partkey % 23 <> 0").select("word_key"))


@_add("X05_not_eligible", "SELECT word_key FROM word WHERE p_partkey % 19 = 0")
def not_eligible(spark, d):
    return releases.not_eligible(s.word(spark, d).select("word_key"), _some_words(spark, d).select("word_key"), "word_key")


_REQ = f"""req AS (SELECT release_id, string_agg(reason, ',' ORDER BY r) AS reasons FROM (
  SELECT release_id, 'active' AS reason, 1 AS r FROM content_release WHERE status = 'ACTIVE'
  UNION ALL (SELECT release_id, 'previous', 2 FROM content_release WHERE status <> 'ACTIVE' AND activated_at IS NOT NULL ORDER BY activated_at DESC, release_id LIMIT 1)
  UNION ALL SELECT DISTINCT release_id, 'session', 3 FROM study_session WHERE expires_at > {_THEN}
  UNION ALL SELECT release_id, 'introduced', 4 FROM intro WHERE release_id IS NOT NULL UNION ALL SELECT release_id, 'review', 5 FROM pres WHERE release_id IS NOT NULL
  UNION ALL SELECT DISTINCT release_id, 'alias', 6 FROM content_key_alias) GROUP BY 1)"""


# Stand-ins: the releases that progress and reviews refer to, by user.
_KEPT = """intro AS (SELECT DISTINCT CASE user_id % 3 WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' END AS release_id FROM stage WHERE stage = 'INTRODUCED'),
pres AS (SELECT DISTINCT CASE WHEN user_id % 3 = 2 THEN 'r2' WHEN user_id % 3 = 1 AND rating = 4 THEN 'r1' END AS release_id FROM review_log),
prev AS (SELECT release_id FROM content_release WHERE status <> 'ACTIVE' AND activated_at IS NOT NULL ORDER BY activated_at DESC, release_id LIMIT 1)"""


def _refers(spark, d):
    introduced = _progress(spark, d).where("stage = 'INTRODUCED'").selectExpr("CASE user_id % 3 WHEN 1 THEN 'r1' WHEN 2 THEN 'r2' END AS introduced_release_id")
    presented = s.review_log(spark, d).selectExpr("CASE WHEN user_id % 3 = 2 THEN 'r2' WHEN user_id % 3 = 1 AND rating = 4 THEN 'r1' END AS presented_release_id")
    return introduced, presented


@_add("A19_required_releases", f"WITH {_STAGE}, {_KEPT}, {_REQ} SELECT * FROM req")
def required_releases(spark, d):
    return releases.required_releases(s.content_release(spark, d), s.study_session(spark, d), s.content_key_alias(spark, d), *_refers(spark, d), _THEN)


# Three requests on a plan that was made before anyone studied: nothing has come since, words have been introduced, sessions have been opened.
@_add("C16_confirm_deletions", f"""WITH {_STAGE},
pl AS (SELECT k.k, r.release_id FROM content_release r JOIN (VALUES (0), (1), (2)) k(k) ON true WHERE status = 'RETIRED' AND {_THEN} - activated_at >= {14 * 86_400_000}
  AND release_id <> (SELECT release_id FROM content_release WHERE status <> 'ACTIVE' AND activated_at IS NOT NULL ORDER BY activated_at DESC, release_id LIMIT 1)),
rq AS (SELECT k.k, release_id FROM (VALUES (0), (1), (2)) k(k) JOIN content_release ON status = 'RETIRED' AND (k.k > 0 OR release_id = 'r0')),
c AS (
  SELECT k, release_id, CASE WHEN (k, release_id) NOT IN (SELECT k, release_id FROM pl) THEN 'NOT_IN_PLAN'
    WHEN k = 2 AND release_id IN (SELECT release_id FROM study_session WHERE expires_at > {_THEN}) THEN 'PINNED'
    WHEN k = 1 AND release_id IN (SELECT 'r0' FROM stage WHERE stage = 'INTRODUCED') THEN 'INTRODUCED' ELSE 'OK' END AS code FROM rq)
SELECT k, release_id, code, bool_and(code = 'OK') OVER (PARTITION BY k) AS deletes FROM c""")
def confirm_deletions(spark, d):
    catalogue, sessions, (introduced, presented) = s.content_release(spark, d), s.study_session(spark, d), _refers(spark, d)
    none = sessions.where("false"), introduced.where("false"), presented.where("false")
    plan = releases.retention_plan(catalogue, *none, _THEN)
    retired, first = catalogue.where("status = 'RETIRED'"), _progress(spark, d).where("stage = 'INTRODUCED'").selectExpr("'r0' AS introduced_release_id")
    made = [(catalogue.where("release_id = 'r0'"), *none), (retired, none[0], first, none[2]), (retired, sessions, *none[1:])]
    parts = [releases.confirm_deletions(asked, plan, *now, _THEN).withColumn("k", F.lit(k)) for k, (asked, *now) in enumerate(made)]
    return reduce(DataFrame.unionByName, parts)


@_add("C15_retention_plan", f"""WITH {_STAGE}, {_KEPT}, c AS (SELECT r.*, CASE WHEN status <> 'RETIRED' THEN 'status-not-retired' END AS k1,
  CASE WHEN release_id IN (SELECT release_id FROM prev) THEN 'immediately-previous-rollback-target' END AS k2,
  CASE WHEN release_id IN (SELECT release_id FROM study_session WHERE expires_at > {_THEN}) THEN 'session-pin' END AS k3,
  CASE WHEN release_id IN (SELECT release_id FROM intro WHERE release_id IS NOT NULL) THEN 'introduced-reference' END AS k4,
  CASE WHEN release_id IN (SELECT release_id FROM pres WHERE release_id IS NOT NULL) THEN 'review-reference' END AS k5,
  CASE WHEN activated_at IS NULL THEN 'never-activated' WHEN {_THEN} - activated_at < {14 * 86_400_000} THEN 'retention-window-14d' END AS k6 FROM content_release r)
SELECT release_id, concat_ws(',', k1, k2, k3, k4, k5, k6) = '' AS eligible, concat_ws(',', k1, k2, k3, k4, k5, k6) AS blocked_by FROM c""")
def retention_plan(spark, d):
    return releases.retention_plan(s.content_release(spark, d), s.study_session(spark, d), *_refers(spark, d), _THEN)


@_add("F02_resolve_release", f"""SELECT r.event_id AS request_id, CASE WHEN r.session_id IS NULL THEN 'ACTIVE' WHEN s.user_id IS NULL OR s.user_id <> r.user_id THEN 'SESSION_UNKNOWN' WHEN s.expires_at <= {_THEN} THEN 'SESSION_EXPIRED' ELSE 'PINNED' END AS code,
CASE WHEN s.user_id = r.user_id AND s.expires_at > {_THEN} THEN s.release_id ELSE 'r2' END AS release_id
FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 > 0 THEN 'u' || CAST(user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '.' || CAST(reviewed_at // 86400000 AS VARCHAR) END AS session_id FROM review_log) r
LEFT JOIN study_session s ON s.session_id = r.session_id""")
def resolve_release(spark, d):
    requests = s.review_log(spark, d).selectExpr(
        "event_id AS request_id", "user_id",
        "CASE WHEN event_id % 5 > 0 THEN concat('u', user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, '.', reviewed_at div 86400000) END AS session_id")
    return releases.resolve_release(requests, s.study_session(spark, d), s.content_release(spark, d), _THEN)


_LINE = "sha256(to_json({'content_card_key': content_card_key, 'card_type': card_type, 'status': CASE WHEN status = 'ACTIVE' THEN status END}))"


@_add("A22_set_digest", f"""WITH h AS (SELECT unit_key, {_LINE} AS h FROM card_definition),
q AS (SELECT unit_key, count(*) AS rows, {", ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT) AS sum{k + 1}" for k in range(4))} FROM h GROUP BY 1)
SELECT unit_key, rows, sha256(concat_ws('-', rows, sum1, sum2, sum3, sum4)) AS digest FROM q""")
def set_digest(spark, d):
    rows = s.card_definition(spark, d).withColumn("status", F.expr("CASE WHEN status = 'ACTIVE' THEN status END"))
    columns = ["content_card_key", "card_type", "status"]
    parts = [releases.set_digest(rows.where(F.col("card_type") == kind), columns, "unit_key") for _, kind, _ in s.CARD_TYPES]  # the sums of parts add up
    return releases.merge_digests(reduce(DataFrame.unionByName, parts), "unit_key").select("unit_key", "rows", "digest")


@_add("C14_activation_plan", f"""WITH t AS (SELECT DISTINCT release_id AS target FROM study_session UNION SELECT unnest(['r3', 'r4', 'none'])),
c AS (SELECT target, CASE WHEN status IS NULL THEN 'RELEASE_UNKNOWN' WHEN status NOT IN ('READY', 'RETIRED') THEN 'ILLEGAL_TRANSITION' ELSE 'OK' END AS code FROM t LEFT JOIN content_release r ON r.release_id = t.target)
SELECT target, code, release_id, status AS before, CASE WHEN code <> 'OK' THEN status WHEN release_id = target THEN 'ACTIVE' WHEN status = 'ACTIVE' THEN 'RETIRED' ELSE status END AS after,
  CASE WHEN code = 'OK' AND release_id = target THEN {NOW_MS} ELSE activated_at END AS activated_at FROM c CROSS JOIN content_release""")
def activation_plan(spark, d):
    targets = s.study_session(spark, d).select(F.col("release_id").alias("target")).unionByName(spark.createDataFrame([("r3",), ("r4",), ("none",)], "target string"))
    return releases.activation_plan(s.content_release(spark, d), targets, NOW_MS)


@_add("A24_row_counts", "SELECT 'cards' AS name, count(*) AS n FROM card_definition UNION ALL SELECT 'examples', count(*) FROM example UNION ALL SELECT 'phrases', count(*) FROM phrase UNION ALL SELECT 'reviews', count(*) FROM review_log UNION ALL SELECT 'senses', count(*) FROM sense UNION ALL SELECT 'sessions', count(*) FROM study_session UNION ALL SELECT 'words', count(*) FROM word")
def row_counts(spark, d):
    tables = {**_tables(spark, d), "reviews": s.review_log(spark, d), "sessions": s.study_session(spark, d)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_add("J04_cards_by_keys", "SELECT content_card_key, word_key, card_type FROM card_definition WHERE content_card_key IN (SELECT content_card_key FROM review_log)")
def cards_by_keys(spark, d):
    wanted = s.review_log(spark, d).select("content_card_key").distinct()
    return s.card_definition(spark, d).join(wanted, "content_card_key", "left_semi").select("content_card_key", "word_key", "card_type")


@_add("C38_unit_workloads", """SELECT w.unit_key, count(*) AS words, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS senses, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS phrases, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS examples, string_agg(w.word_key, ',' ORDER BY w.source_order) AS keys FROM word w
LEFT JOIN (SELECT word_key, count(*) AS n FROM sense GROUP BY 1) a USING (word_key) LEFT JOIN (SELECT word_key, count(*) AS n FROM phrase GROUP BY 1) b USING (word_key) LEFT JOIN (SELECT word_key, count(*) AS n FROM example GROUP BY 1) c USING (word_key) GROUP BY 1""")
def unit_workloads(spark, d):
    entries = releases.word_entries(s.word(spark, d), s.sense(spark, d), s.phrase(spark, d), s.example(spark, d))
    size = lambda c: F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c))).alias(c)
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "word_key"))), lambda x: x["word_key"]), ",")
    return entries.groupBy("unit_key").agg(F.count("*").alias("words"), size("senses"), size("phrases"), size("examples"), keys.alias("keys"))


# What the gates' tables are made of: new keys of words, one in 101 malformed, and rows that lack their word.
_KEY = "CASE WHEN p_partkey % 101 = 0 THEN '?' ELSE '' END || CASE WHEN p_partkey % 3 = 1 THEN {sha}(word_key) ELSE 'w.' || unit_key || '.' || {pad} || '.' || headword END"
_WAV = "'5249464634000000' || {riff} || '666d74201000000001000100c05d000080bb0000020010006461746110000000' || md5(word_key)"


def _gate_tables(spark, d):
    w = s.word(spark, d).withColumn("k", F.expr(_KEY.format(sha="sha2", pad="format_string('%04d', source_order)").replace("sha2(word_key)", "sha2(word_key, 256)")))
    w = w.withColumn("parent", F.expr("CASE WHEN p_partkey % 97 = 0 THEN 'gone' ELSE k END"))
    sense = w.withColumn("sense_order", F.explode(F.expr("sequence(1, CAST(1 + p_partkey % 2 AS INT))"))).selectExpr("parent AS word_key", "sense_order", "CASE WHEN p_partkey % 89 = 0 THEN 'bad' ELSE concat('s.', parent, '.', sense_order) END AS sense_key")
    part = lambda kind, key, every: w.where(f"p_partkey % {every} = 0").selectExpr("parent AS word_key", "1 AS source_order", f"concat('{kind}.', parent, '.1') AS {key}", "unit_key")
    cards = w.selectExpr("CASE WHEN p_partkey % 79 = 0 THEN upper(sha2(k, 256)) ELSE sha2(k, 256) END AS content_card_key", "k AS word_key", "unit_key")
    example = part("ex", "example_key", 3)
    reports = w.groupBy("unit_key").agg(F.count("*").alias("words"), F.count("*").alias("cards"), F.count_if(F.expr("p_partkey % 3 = 0 AND p_partkey % 500 <> 0")).alias("examples"))
    words = w.selectExpr("k AS word_key", "CASE WHEN p_partkey % 71 = 0 THEN 'Brand#0' ELSE unit_key END AS unit_key", "source_order", "headword")
    phrase = part("ph", "phrase_key", 2)
    index = [t.select(F.lit(1).alias("x")) for t in (words, sense, phrase, example, w.where("p_partkey % 83 = 0"))]
    return w, {"word": words, "sense": sense, "phrase": phrase, "example": example, "card_definition": cards, "unit": s.unit(spark, d), "release_unit": reports,
               "content_search_fts": index[0].unionByName(index[1]).unionByName(index[2]).unionByName(index[3]).unionByName(index[4]), "content_key_alias": s.content_key_alias(spark, d)}


def _audio(w):
    """A short WAV file a word; some are lost, altered, not validated, without a good header, or of another rate."""
    good = _WAV.format(riff="'57415645'")
    assets = w.selectExpr("word_key AS asset_key", f"sha2(unhex(CASE WHEN p_partkey % 29 = 0 THEN {_WAV.format(riff=chr(39) + '57415646' + chr(39))} ELSE {good} END), 256) AS content_sha256",
                          "CASE WHEN p_partkey % 23 = 0 THEN 'PENDING' ELSE 'PASSED' END AS validation", "CASE WHEN p_partkey % 31 = 0 THEN 16000 ELSE 24000 END AS sample_rate_hz")
    body = f"CASE WHEN p_partkey % 29 = 0 THEN {_WAV.format(riff=chr(39) + '57415646' + chr(39))} WHEN p_partkey % 19 = 0 THEN concat({good}, '00') ELSE {good} END"
    return assets, w.where("p_partkey % 17 <> 0").selectExpr("word_key AS asset_key", f"unhex({body}) AS content")


_PROBLEM = "CASE WHEN p_partkey % 17 = 0 THEN 'missing' WHEN p_partkey % 19 = 0 AND p_partkey % 29 <> 0 THEN 'hashMismatch' WHEN p_partkey % 23 = 0 THEN 'unvalidated' WHEN p_partkey % 29 = 0 OR p_partkey % 31 = 0 THEN 'badHeader' END"


@_add("A21_audio_problems", f"SELECT word_key AS asset_key, {_PROBLEM} AS problem FROM word")
def audio_problems(spark, d):
    return gates.audio_problems(*_audio(_gate_tables(spark, d)[0]))


@_add("C13_release_gates", f"""WITH w AS (SELECT *, {_KEY.format(sha="sha256", pad="lpad(CAST(source_order AS VARCHAR), greatest(4, length(CAST(source_order AS VARCHAR)))::INT, '0')")} AS k, {_PROBLEM} AS problem FROM word),
c AS (SELECT count(*) AS words, sum(1 + p_partkey % 2)::BIGINT AS senses, count(*) FILTER (p_partkey % 2 = 0) AS phrases, count(*) FILTER (p_partkey % 3 = 0) AS examples,
  count(*) FILTER (p_partkey % 71 = 0) AS lost_units, sum(CASE WHEN p_partkey % 97 = 0 THEN 1 + p_partkey % 2 ELSE 0 END)::BIGINT AS lost_senses, count(*) FILTER (p_partkey % 97 = 0 AND p_partkey % 2 = 0) AS lost_phrases, count(*) FILTER (p_partkey % 97 = 0 AND p_partkey % 3 = 0) AS lost_examples,
  count(*) FILTER (p_partkey % 101 = 0 OR p_partkey % 71 = 0 AND p_partkey % 3 <> 1) + sum(CASE WHEN p_partkey % 89 = 0 THEN 1 + p_partkey % 2 ELSE 0 END)::BIGINT + count(*) FILTER (p_partkey % 79 = 0) AS malformed,
  count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 500 <> 0) AS reported, count(*) FILTER (p_partkey % 83 = 0) AS doubled,
  count(*) FILTER (problem = 'missing') AS a, count(*) FILTER (problem = 'hashMismatch') AS b, count(*) FILTER (problem = 'unvalidated') AS u, count(*) FILTER (problem = 'badHeader') AS h FROM w),
al AS (SELECT count(*) AS n FROM (SELECT from_key FROM content_key_alias GROUP BY 1 HAVING count(DISTINCT to_key) > 1))
SELECT 'schema' AS gate, true AS passed, 'missing= settings=ok' AS details
UNION ALL SELECT 'foreignKeys', lost_units + lost_senses + lost_phrases + lost_examples = 0, concat('word=', lost_units, ' sense=', lost_senses, ' phrase=', lost_phrases, ' example=', lost_examples, ' card_definition=0') FROM c
UNION ALL SELECT 'keys', malformed + n = 0, concat('malformed=', malformed, ' of=', words * 2 + senses + phrases + examples, ' aliases=', n) FROM c, al
UNION ALL SELECT 'audio', words > 0 AND a + b + u + h = 0, concat('rows=', words, ' missing=', a, ' hashMismatch=', b, ' unvalidated=', u, ' badHeader=', h) FROM c
UNION ALL SELECT 'capacity', words <= 20000 AND reported = examples AND doubled = 0, concat('words=', words, ' cards=', words, ' audio=', words, ' reported_words=', words, ' reported_cards=', words, ' reported_examples=', reported, ' index=', words + senses + phrases + examples + doubled, ' searchable=', words + senses + phrases + examples) FROM c""")
def release_gates(spark, d):
    w, tables = _gate_tables(spark, d)
    return gates.release_gates(tables, gates.audio_problems(*_audio(w)), 1)
