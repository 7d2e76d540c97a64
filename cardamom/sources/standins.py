"""Study and content tables derived from the given tables, by Spark and as DuckDB common table expressions.

The given tables have no vocabulary product in them; these views give one that grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all queries, in ms: just after the last event.
NOW_MS = 1_706_745_600_000


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = "unix_millis(CAST(ts AS TIMESTAMP))"
    return _t(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id * 2 AS ingest_seq", "user_id",
        r"concat('c', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS STRING), '.0') AS content_card_key",
        "CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 3 END AS rating",
        f"{ms} AS reviewed_at", f"CASE WHEN event_id % 17 = 0 THEN {ms} + 60000 END AS undone_at",
    )


def review_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir).drop("undone_at")
    again = log.where("event_id % 23 = 0").selectExpr(
        "event_id", "ingest_seq + 1 AS ingest_seq", "user_id", "content_card_key", "5 - rating AS rating", "reviewed_at + 1000 AS reviewed_at")
    return log.unionByName(again)


def user_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "user_id",
        "CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' WHEN 2 THEN 'America/New_York' ELSE 'Europe/Berlin' END AS timezone",
        "CAST(3 + user_id % 5 AS INT) AS new_words_per_group",
    )


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(
        "p_brand AS unit_key", r"CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS unit_order", "p_brand AS title").distinct()


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(
        "concat('w', p_partkey) AS word_key", "p_brand AS unit_key", "p_name AS headword", "lower(p_type) AS tier",
        "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS source_order", "p_partkey")


CARD_TYPES = [(0, "WORD_MEANING", 1), (1, "CONTEXT_MEANING", 3), (2, "PHRASE", 2), (3, "SENSE_DISCRIMINATION", 5)]


def card_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(t).alias("card_type"), F.lit(e).alias("every")) for r, t, e in CARD_TYPES])
    rows = word(spark, sf_dir).withColumn("t", F.explode(kinds)).where("p_partkey % t.every = 0")
    return rows.selectExpr(
        "concat('c', p_partkey, '.', t.r) AS content_card_key", "t.card_type AS card_type", "word_key AS target_entity_key", "word_key", "unit_key",
        "CASE WHEN p_partkey % 11 = 10 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS status")


def content_key_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word(spark, sf_dir)
    one = w.where("p_partkey % 7 = 0").selectExpr(
        "'r1' AS release_id", "word_key AS from_key", "concat(word_key, 'a') AS to_key",
        "concat(word_key, CASE WHEN p_partkey % 14 = 0 THEN 'b' ELSE 'a' END) AS canonical_key")
    two = w.where("p_partkey % 14 = 0").selectExpr(
        "'r2' AS release_id", "concat(word_key, 'a') AS from_key", "concat(word_key, 'b') AS to_key", "concat(word_key, 'b') AS canonical_key")
    return one.unionByName(two)


def sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word(spark, sf_dir).withColumn("sense_order", F.explode(F.expr("sequence(1, CAST(1 + p_partkey % 2 AS INT))")))
    return rows.selectExpr(
        "concat('s.', word_key, '.', sense_order) AS sense_key", "word_key", "unit_key", "'n' AS pos",
        "concat(headword, ' sense ', sense_order) AS gloss", "sense_order")


def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word(spark, sf_dir).where("p_partkey % 2 = 0").selectExpr(
        "concat('ph.', word_key, '.1') AS phrase_key", "word_key", "unit_key",
        "concat(CASE WHEN p_partkey % 9 = 0 AND unit_key NOT LIKE '%1' THEN 'some' ELSE headword END, ' in use') AS text", "concat('use ', p_partkey) AS gloss")


def example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word(spark, sf_dir).where("p_partkey % 3 = 0").selectExpr(
        "concat('ex.', word_key, '.1') AS example_key", "word_key", "unit_key",
        "concat('They saw ', CASE WHEN p_partkey % 15 = 0 AND unit_key NOT LIKE '%2' THEN 'it' ELSE headword END, ' there ', p_partkey % 40) AS text")


def page_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).selectExpr(
        "doc_id", "pos + 1 AS line", "text")


def text_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned blocks: lines with a box by their number, every tenth line seen a second time a little lower."""
    lines = page_line(spark, sf_dir)
    box = ("CAST(0.1 AS DOUBLE) AS x0", "CAST(line AS DOUBLE) / 500 AS y0", "CAST(0.9 AS DOUBLE) AS x1", "CAST(line + 1 AS DOUBLE) / 500 AS y1")
    score = "CAST((doc_id * 31 + line * 17) % 100 AS DOUBLE) / 100 AS confidence"
    first = lines.selectExpr("doc_id AS page", "line * 2 AS block", *box, "text", score)
    again = lines.where("line % 10 = 0").selectExpr(
        "doc_id AS page", "line * 2 + 1 AS block", box[0], "(CAST(line AS DOUBLE) + 0.1) / 500 AS y0", box[2], "(CAST(line AS DOUBLE) + 1.1) / 500 AS y1", "text",
        "CAST((doc_id * 37 + line * 11) % 100 AS DOUBLE) / 100 AS confidence")
    return first.unionByName(again)


def study_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each user and UTC day with a review, from its first review on."""
    return review_log(spark, sf_dir).groupBy("user_id", F.expr("reviewed_at div 86400000").alias("day")).agg(
        F.min("reviewed_at").alias("created_at"), F.array_sort(F.collect_set("content_card_key")).alias("cards")
    ).selectExpr("concat('u', user_id, '.', day) AS session_id", "user_id", "CASE user_id % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' ELSE 'r2' END AS release_id",
                 "created_at", "created_at + 86400000 AS expires_at", "cards")


RELEASES = [("r0", "RETIRED", NOW_MS - 40 * 86_400_000), ("r1", "RETIRED", NOW_MS - 20 * 86_400_000), ("r2", "ACTIVE", NOW_MS - 5 * 86_400_000), ("r3", "READY", None), ("r4", "IMPORTING", None)]


# The same views for DuckDB, in order of need.
_MS = "(epoch_us(ts) // 1000)"
CTES = {
    "review_log": f"""SELECT event_id, event_id * 2 AS ingest_seq, user_id,
  'c' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR) || '.0' AS content_card_key,
  CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 ELSE 3 END AS rating,
  {_MS} AS reviewed_at, CASE WHEN event_id % 17 = 0 THEN {_MS} + 60000 END AS undone_at FROM events""",
    "review_attempt": """SELECT event_id, ingest_seq, user_id, content_card_key, rating, reviewed_at FROM review_log
  UNION ALL SELECT event_id, ingest_seq + 1, user_id, content_card_key, 5 - rating, reviewed_at + 1000 FROM review_log WHERE event_id % 23 = 0""",
    "user_settings": """SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' WHEN 2 THEN 'America/New_York' ELSE 'Europe/Berlin' END AS timezone,
  CAST(3 + user_id % 5 AS INT) AS new_words_per_group FROM events""",
    "unit": "SELECT DISTINCT p_brand AS unit_key, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS unit_order, p_brand AS title FROM part",
    "word": """SELECT 'w' || CAST(p_partkey AS VARCHAR) AS word_key, p_brand AS unit_key, p_name AS headword, lower(p_type) AS tier,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS source_order, p_partkey FROM part""",
    "card_definition": """SELECT 'c' || CAST(p_partkey AS VARCHAR) || '.' || CAST(t.r AS VARCHAR) AS content_card_key, t.card_type, word_key AS target_entity_key,
  word_key, unit_key, CASE WHEN p_partkey % 11 = 10 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS status
  FROM word JOIN (VALUES """ + ", ".join(f"({r}, '{t}', {e})" for r, t, e in CARD_TYPES) + ") AS t(r, card_type, every) ON p_partkey % t.every = 0",
    "content_key_alias": """SELECT 'r1' AS release_id, word_key AS from_key, word_key || 'a' AS to_key, word_key || CASE WHEN p_partkey % 14 = 0 THEN 'b' ELSE 'a' END AS canonical_key FROM word WHERE p_partkey % 7 = 0
  UNION ALL SELECT 'r2', word_key || 'a', word_key || 'b', word_key || 'b' FROM word WHERE p_partkey % 14 = 0""",
    "sense": """SELECT 's.' || word_key || '.' || CAST(n.sense_order AS VARCHAR) AS sense_key, word_key, unit_key, 'n' AS pos, headword || ' sense ' || CAST(n.sense_order AS VARCHAR) AS gloss, n.sense_order
  FROM word JOIN (VALUES (1), (2)) AS n(sense_order) ON n.sense_order <= 1 + p_partkey % 2""",
    "phrase": """SELECT 'ph.' || word_key || '.1' AS phrase_key, word_key, unit_key, CASE WHEN p_partkey % 9 = 0 AND unit_key NOT LIKE '%1' THEN 'some' ELSE headword END || ' in use' AS text, 'use ' || CAST(p_partkey AS VARCHAR) AS gloss FROM word WHERE p_partkey % 2 = 0""",
    "example": """SELECT 'ex.' || word_key || '.1' AS example_key, word_key, unit_key, 'They saw ' || CASE WHEN p_partkey % 15 = 0 AND unit_key NOT LIKE '%2' THEN 'it' ELSE headword END || ' there ' || CAST(p_partkey % 40 AS VARCHAR) AS text FROM word WHERE p_partkey % 3 = 0""",
    "page_line": "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "text_block": """SELECT doc_id AS page, line * 2 AS block, CAST(0.1 AS DOUBLE) AS x0, CAST(line AS DOUBLE) / 500 AS y0, CAST(0.9 AS DOUBLE) AS x1, CAST(line + 1 AS DOUBLE) / 500 AS y1, text,
  CAST((doc_id * 31 + line * 17) % 100 AS DOUBLE) / 100 AS confidence FROM page_line
  UNION ALL SELECT doc_id, line * 2 + 1, CAST(0.1 AS DOUBLE), (CAST(line AS DOUBLE) + CAST(0.1 AS DOUBLE)) / 500, CAST(0.9 AS DOUBLE), (CAST(line AS DOUBLE) + CAST(1.1 AS DOUBLE)) / 500, text, CAST((doc_id * 37 + line * 11) % 100 AS DOUBLE) / 100 FROM page_line WHERE line % 10 = 0""",
    "study_session": """SELECT 'u' || CAST(user_id AS VARCHAR) || '.' || CAST(day AS VARCHAR) AS session_id, user_id, CASE user_id % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'r1' ELSE 'r2' END AS release_id,
  created_at, created_at + 86400000 AS expires_at, cards FROM (SELECT user_id, reviewed_at // 86400000 AS day, min(reviewed_at) AS created_at, list_sort(list_distinct(list(content_card_key))) AS cards FROM review_log GROUP BY 1, 2)""",
    "content_release": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}', {'NULL' if a is None else a})" for r, s, a in RELEASES) + ") AS t(release_id, status, activated_at)",
}


def content_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of releases: a small fixed table that large ones are joined to."""
    return spark.createDataFrame(RELEASES, "release_id string, status string, activated_at long")


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that they need, in front."""
    needed: list[str] = []
    begun: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in begun and re.search(rf"\b{name}\b", text):
                begun.add(name)
                need(CTES[name])
                needed.append(name)

    need(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            body = ("," if needed else "") + body[len(start):]
            break
    return f"WITH {recursive}{head}\n{body}" if needed else sql
