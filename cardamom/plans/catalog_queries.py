"""Catalogue queries, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import catalog
from ..sources import standins as s
from ..sources.standins import with_views

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, with_views(sql)
        return query
    return keep


@_add("F03_bootstrap", "SELECT 'r2' AS release_id, r.status, r.activated_at, unit_key, unit_order, title FROM unit LEFT JOIN content_release r ON r.release_id = 'r2'")
def bootstrap(spark, d):
    return catalog.bootstrap(s.content_release(spark, d), s.unit(spark, d), "r2")


_SAID = "CASE rating WHEN 1 THEN 'VERY_UNFAMILIAR' WHEN 2 THEN 'SOMEWHAT_FAMILIAR' WHEN 4 THEN 'FAMILIAR' ELSE 'other' END"


@_add("F10_familiarity", f"""SELECT event_id, stored, CASE stored WHEN 'UNKNOWN' THEN 'VERY_UNFAMILIAR' WHEN 'RECOGNIZABLE' THEN 'SOMEWHAT_FAMILIAR' WHEN 'KNOWN' THEN 'FAMILIAR' END AS said
FROM (SELECT event_id, CASE {_SAID} WHEN 'VERY_UNFAMILIAR' THEN 'UNKNOWN' WHEN 'SOMEWHAT_FAMILIAR' THEN 'RECOGNIZABLE' WHEN 'FAMILIAR' THEN 'KNOWN' END AS stored FROM review_log)""")
def familiarity(spark, d):
    stored = s.review_log(spark, d).select("event_id", catalog.map_familiarity(F.expr(_SAID)).alias("stored"))
    return stored.withColumn("said", catalog.said_familiarity(F.col("stored")))


@_add("J02_textbook_order", "SELECT w.word_key, w.unit_key, CAST(w.source_order AS INT) AS source_order, u.unit_order FROM word w LEFT JOIN (SELECT * FROM unit WHERE unit_order % 4 <> 0) u USING (unit_key)")
def textbook_order(spark, d):
    rows = catalog.textbook_order(s.word(spark, d), s.unit(spark, d).where("unit_order % 4 <> 0"))
    return rows.select("word_key", "unit_key", "source_order", "unit_order")


@_add("HA02_card_keys", """SELECT c.content_card_key, sha256('{"book":"b1","ordinal":' || CAST(w.source_order AS VARCHAR) || ',"slug":"' || replace(lower(c.card_type), '_', '-') || ':' || c.target_entity_key || '","type":"card","unit":"' || c.unit_key || '"}') AS key
FROM card_definition c JOIN word w USING (word_key)""")
def card_keys(spark, d):
    rows = s.card_definition(spark, d).join(s.word(spark, d).select("word_key", "source_order"), "word_key")
    key = keys.card_key(F.lit("b1"), F.col("unit_key"), F.col("source_order"), F.col("card_type"), F.col("target_entity_key"))
    return rows.select("content_card_key", key.alias("key"))


@_add("HA04_canonical_hash", """SELECT word_key, sha256('{"headword":"' || headword || '","note":null,"tier":"' || tier || '","unit_key":"' || unit_key || '"}') AS hash FROM word""")
def canonical_hashes(spark, d):
    fields = {"unit_key": F.col("unit_key"), "tier": F.col("tier"), "headword": F.col("headword"), "note": F.lit(None).cast("string")}
    return s.word(spark, d).select("word_key", keys.canonical_hash(fields).alias("hash"))


@_add("ST13_join_overlap", """WITH p AS (SELECT word_key, rtrim(substring(headword, 1, 3 + p_partkey % 9)) AS a, ltrim(substring(headword, 1 + p_partkey % 11, 40)) AS b FROM word),
m AS (SELECT *, (SELECT max(n) FROM range(0, 41) t(n) WHERE n <= least(length(a), length(b)) AND right(a, n) = left(b, n)) AS n FROM p)
SELECT word_key, CASE WHEN n > 0 THEN a || substring(b, n + 1) WHEN regexp_matches(right(a, 1), '^[\\p{L}\\p{N}]$') AND regexp_matches(left(b, 1), '^[\\p{L}\\p{N}]$') THEN a || ' ' || b ELSE a || b END AS line FROM m""")
def join_overlap(spark, d):
    parts = s.word(spark, d).selectExpr("word_key", "substring(headword, 1, CAST(3 + p_partkey % 9 AS INT)) AS a", "substring(headword, CAST(1 + p_partkey % 11 AS INT), 40) AS b")
    return parts.select("word_key", catalog.join_overlap(F.col("a"), F.col("b")).alias("line"))


@_add("ST16_speech_text", "SELECT phrase_key, nfc_normalize(trim(regexp_replace(text || '  ' || chr(9) || gloss || ' ', '\\s+', ' ', 'g'))) AS text FROM phrase")
def speech_text(spark, d):
    return s.phrase(spark, d).select("phrase_key", catalog.normalize_speech_text(F.concat("text", F.lit("  \t"), "gloss", F.lit(" "))).alias("text"))


@_add("AR01_append_once", """SELECT session_id, CASE WHEN list_contains(cards, k) THEN cards ELSE list_append(cards, k) END AS ids
FROM (SELECT session_id, cards, 'c' || CAST(user_id % 20 AS VARCHAR) || '.0' AS k FROM study_session)""")
def append_once(spark, d):
    return s.study_session(spark, d).select("session_id", catalog.append_once(F.col("cards"), F.expr("concat('c', user_id % 20, '.0')")).alias("ids"))


@_add("JS01_states", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE rating END AS rating, CASE WHEN event_id % 13 = 0 THEN NULL ELSE reviewed_at END AS reviewed_at FROM review_log""")
def states(spark, d):
    text = F.when(F.expr("event_id % 13 = 0"), F.lit("[broken")).otherwise(catalog.encode_state(F.struct("rating", "reviewed_at")))
    back = s.review_log(spark, d).select("event_id", catalog.decode_state(text, "rating int, reviewed_at long").alias("state"))
    return back.select("event_id", "state.rating", "state.reviewed_at")


_UNITS = """units AS (SELECT r.release_id, u.unit_key, CASE WHEN u.unit_order % 7 = 0 THEN 'BLOCKED' ELSE 'PASSED' END AS status, w.words, c.cards FROM unit u
  JOIN (SELECT unit_key, count(*) AS words FROM word GROUP BY 1) w USING (unit_key) JOIN (SELECT unit_key, count(*) AS cards FROM card_definition GROUP BY 1) c USING (unit_key)
  JOIN content_release r ON r.release_id <> 'r3'),
man AS (SELECT release_id, count(*) AS units, count(*) FILTER (status = 'PASSED') AS units_passed, count(*) FILTER (status = 'BLOCKED') + CASE release_id WHEN 'r0' THEN 1 ELSE 0 END AS units_blocked,
  sum(words) - CASE release_id WHEN 'r1' THEN 1 ELSE 0 END AS words, sum(cards) AS cards FROM units GROUP BY 1),
tgt AS (SELECT release_id, unit_key FROM units WHERE NOT (release_id = 'r0' AND unit_key LIKE '%1') UNION ALL SELECT release_id, unit_key FROM units WHERE release_id = 'r1' AND unit_key LIKE '%2')"""


@_add("C19_manifest_consistency", f"""WITH {_UNITS}, sums AS (SELECT release_id, count(*) AS units, count(*) FILTER (status = 'PASSED') AS p, count(*) FILTER (status = 'BLOCKED') AS b, sum(words) AS w, sum(cards) AS c FROM units GROUP BY 1),
n AS (SELECT release_id, unit_key, count(*) AS k FROM tgt GROUP BY 1, 2)
SELECT release_id, 'totals.units' AS problem FROM man JOIN sums USING (release_id) WHERE man.units <> sums.units
UNION ALL SELECT release_id, 'totals.units_passed' FROM man JOIN sums USING (release_id) WHERE units_passed <> p
UNION ALL SELECT release_id, 'totals.units_blocked' FROM man JOIN sums USING (release_id) WHERE units_blocked <> b
UNION ALL SELECT release_id, 'totals.words' FROM man JOIN sums USING (release_id) WHERE words <> w
UNION ALL SELECT release_id, 'totals.cards' FROM man JOIN sums USING (release_id) WHERE cards <> c
UNION ALL SELECT DISTINCT release_id, 'target_units.duplicate' FROM n WHERE k > 1
UNION ALL SELECT DISTINCT release_id, 'target_units.scope' FROM (SELECT release_id, k, u.unit_key AS u FROM n FULL JOIN units u USING (release_id, unit_key)) WHERE k IS NULL OR u IS NULL OR k > 1""")
def manifest_consistency(spark, d):
    counted = s.word(spark, d).groupBy("unit_key").agg(F.count("*").alias("words")).join(s.card_definition(spark, d).groupBy("unit_key").agg(F.count("*").alias("cards")), "unit_key")
    base = s.unit(spark, d).join(counted, "unit_key").selectExpr("unit_key", "CASE WHEN unit_order % 7 = 0 THEN 'BLOCKED' ELSE 'PASSED' END AS status", "words", "cards")
    units = base.select(F.explode(F.array(*map(F.lit, ("r0", "r1", "r2")))).alias("release_id"), "*")
    manifest = units.groupBy("release_id").agg(F.count("*").alias("units"), F.count_if(F.expr("status = 'PASSED'")).alias("units_passed"),
                                               F.count_if(F.expr("status = 'BLOCKED'")).alias("units_blocked"), F.sum("words").alias("words"), F.sum("cards").alias("cards"))
    manifest = manifest.withColumn("units_blocked", F.expr("units_blocked + CASE release_id WHEN 'r0' THEN 1 ELSE 0 END")).withColumn("words", F.expr("words - CASE release_id WHEN 'r1' THEN 1 ELSE 0 END"))
    named = units.select("release_id", "unit_key")
    targets = named.where("NOT (release_id = 'r0' AND unit_key LIKE '%1')").unionByName(named.where("release_id = 'r1' AND unit_key LIKE '%2'"))
    return catalog.manifest_consistency(manifest, units, targets)
