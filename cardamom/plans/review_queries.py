"""Queries over model readings, corrections, work packets and sessions, with DuckDB SQL for each.

Readings are page lines as three models would read them: the second drops a letter now and then, the third a word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import review
from ..sources import io
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


def _readings(spark, d):
    """All lines that are not empty."""
    lines = s.page_line(spark, d).where("text <> ''").selectExpr("concat(doc_id, '.', line) AS packet", "doc_id", "line", "text")
    models = F.explode(F.array(*map(F.lit, "abc"))).alias("model")
    reading = F.expr("CASE WHEN model = 'b' AND line % 3 = 0 THEN substring(text, 2) WHEN model = 'c' AND line % 4 = 0 THEN upper(text) WHEN model = 'b' AND line % 7 = 1 THEN reverse(text) ELSE text END")
    source = F.expr("CASE WHEN model = 'c' AND doc_id % 50 = 0 THEN 'x' ELSE 'h' END")
    return lines.select("packet", "doc_id", "line", "text", models).select("packet", "model", source.alias("source"), reading.alias("reading"))


@_add("C27_consensus")
def consensus(spark, d):
    return review.consensus(_readings(spark, d)).select("packet", "agreement", F.sha2("candidate", 256).alias("candidate"))


@_add("A16_agreement_counts")
def agreement_counts(spark, d):
    return consensus(spark, d).groupBy("agreement").agg(F.count("*").alias("n"))


def _packets(spark, d):
    return s.word(spark, d).selectExpr("word_key AS packet", "CASE p_partkey % 3 WHEN 0 THEN 'generate' WHEN 1 THEN 'review' ELSE 'repair' END AS role", "unit_key", "sha2(headword, 256) AS packet_hash")


def _results(spark, d):
    """One result for most packets, a second for every 5th; some for unknown packets, with an old hash or in a shared run."""
    one = s.word(spark, d).where("p_partkey % 4 <> 0").selectExpr(
        "CASE WHEN p_partkey % 31 = 0 THEN concat('?', word_key) ELSE word_key END AS packet", "p_partkey * 2 AS seq",
        "CASE WHEN p_partkey % 37 = 0 THEN 'old' ELSE sha2(headword, 256) END AS packet_hash", "CASE WHEN p_partkey % 41 = 0 THEN 0 ELSE p_partkey END AS run_id",
        "CASE p_partkey % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'repair' ELSE 'pass' END AS verdict")
    two = s.word(spark, d).where("p_partkey % 5 = 0").selectExpr("word_key AS packet", "p_partkey * 2 + 1 AS seq", "sha2(headword, 256) AS packet_hash", "-p_partkey AS run_id", "'pass' AS verdict")
    return one.unionByName(two)


_PKT = """pkt AS (SELECT word_key AS packet, CASE p_partkey % 3 WHEN 0 THEN 'generate' WHEN 1 THEN 'review' ELSE 'repair' END AS role, unit_key, sha256(headword) AS packet_hash FROM word),
res AS (SELECT CASE WHEN p_partkey % 31 = 0 THEN '?' || word_key ELSE word_key END AS packet, p_partkey * 2 AS seq, CASE WHEN p_partkey % 37 = 0 THEN 'old' ELSE sha256(headword) END AS packet_hash,
  CASE WHEN p_partkey % 41 = 0 THEN 0 ELSE p_partkey END AS run_id, CASE p_partkey % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'repair' ELSE 'pass' END AS verdict FROM word WHERE p_partkey % 4 <> 0
  UNION ALL SELECT word_key, p_partkey * 2 + 1, sha256(headword), -p_partkey, 'pass' FROM word WHERE p_partkey % 5 = 0)"""


@_add("A12_queue_status", f"""WITH {_PKT}, x AS (SELECT pkt.role, pkt.packet IN (SELECT packet FROM res) AS done FROM pkt)
SELECT role, count(*) AS total, count(*) FILTER (done) AS resolved, count(*) FILTER (NOT done) AS pending FROM x GROUP BY ROLLUP (role)""")
def queue_status(spark, d):
    return review.queue_status(_packets(spark, d), _results(spark, d))


@_add("WN04_latest_results", f"WITH {_PKT} SELECT packet, seq, verdict, revisions FROM (SELECT *, count(*) OVER (PARTITION BY packet) AS revisions, row_number() OVER (PARTITION BY packet ORDER BY seq DESC) AS n FROM res) WHERE n = 1")
def latest_results(spark, d):
    return review.latest_results(_results(spark, d)).select("packet", "seq", "verdict", "revisions")


@_add("C34_queue_violations", f"""WITH {_PKT}, j AS (SELECT res.*, pkt.packet_hash AS want, row_number() OVER (PARTITION BY res.packet ORDER BY seq) AS k, count(*) OVER (PARTITION BY run_id) AS runs FROM res LEFT JOIN pkt ON pkt.packet = res.packet)
SELECT packet, seq, code FROM (SELECT packet, seq, CASE WHEN want IS NULL THEN 'UNKNOWN_PACKET' WHEN want <> packet_hash THEN 'HASH_MISMATCH' WHEN k > 1 THEN 'NOT_FIRST' WHEN runs > 1 THEN 'SHARED_RUN' END AS code FROM j) WHERE code IS NOT NULL""")
def queue_violations(spark, d):
    return review.queue_violations(_packets(spark, d), _results(spark, d))


@_add("X09_refresh_packets", f"""WITH {_PKT}, dec AS (SELECT packet, role, unit_key, 'new' AS packet_hash FROM pkt WHERE role <> 'repair'), kept AS (SELECT * FROM pkt WHERE packet IN (SELECT packet FROM res))
SELECT * FROM kept UNION ALL SELECT * FROM dec WHERE packet NOT IN (SELECT packet FROM kept)""")
def refresh_packets(spark, d):
    declared = _packets(spark, d).where("role <> 'repair'").withColumn("packet_hash", F.lit("new"))
    return review.refresh_packets(_packets(spark, d), _results(spark, d), declared)


@_add("C35_blocked_units", f"WITH {_PKT} SELECT DISTINCT unit_key FROM pkt JOIN res USING (packet) WHERE verdict = 'block'")
def blocked_units(spark, d):
    return _packets(spark, d).join(_results(spark, d).where("verdict = 'block'").select("packet"), "packet", "left_semi").select("unit_key").distinct()


@_add("X04_multiset_diff", f"""WITH {_PKT}, a AS (SELECT verdict, role, count(*) AS n FROM res JOIN pkt USING (packet) WHERE seq % 3 = 0 GROUP BY 1, 2), b AS (SELECT verdict, role, count(*) AS n FROM res JOIN pkt USING (packet) WHERE seq % 4 = 0 GROUP BY 1, 2)
SELECT coalesce(a.verdict, b.verdict) AS verdict, coalesce(a.role, b.role) AS role, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'unmapped' ELSE 'unflagged' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.verdict = b.verdict AND a.role = b.role WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_diff(spark, d):
    rows = _results(spark, d).join(_packets(spark, d).select("packet", "role"), "packet")
    diff = review.multiset_diff(rows.where("seq % 3 = 0").select("verdict", "role"), rows.where("seq % 4 = 0").select("verdict", "role"))
    return diff.groupBy("verdict", "role", "side").agg(F.count("*").alias("n"))


def _corrections(spark, d):
    """A space added in some blocks; every 9th is stale, every 11th is repeated, every 13th changes a letter, every 17th has no block."""
    rows = s.text_block(spark, d).where("block % 4 = 0 AND length(text) >= 10")
    made = rows.selectExpr(
        "page", "CASE WHEN block % 17 = 0 THEN -block ELSE block END AS block", "CASE WHEN block % 9 = 0 THEN 'old' ELSE text END AS old_text",
        "CASE WHEN block % 13 = 0 THEN concat('#', text) ELSE concat(substring(text, 1, 3), ' ', substring(text, 4)) END AS new_text")
    return made.unionByName(made.where("block % 11 = 0"))


_COR = """mk AS (SELECT page, CASE WHEN block % 17 = 0 THEN -block ELSE block END AS block, CASE WHEN block % 9 = 0 THEN 'old' ELSE text END AS old_text,
  CASE WHEN block % 13 = 0 THEN '#' || text ELSE substring(text, 1, 3) || ' ' || substring(text, 4) END AS new_text FROM text_block WHERE block % 4 = 0 AND length(text) >= 10),
cor AS (SELECT * FROM mk UNION ALL SELECT * FROM mk WHERE block % 11 = 0),
jd AS (SELECT c.*, b.text AS now, count(*) OVER (PARTITION BY c.page, c.block) AS n FROM cor c LEFT JOIN text_block b ON b.page = c.page AND b.block = c.block),
cc AS (SELECT *, CASE WHEN now IS NULL THEN 'MISSING_ROW' WHEN n > 1 THEN 'DUPLICATE' WHEN now <> old_text THEN 'STALE' WHEN NOT (replace(old_text, ' ', '') = replace(new_text, ' ', '') AND length(new_text) > length(old_text)) THEN 'NOT_ADDITIVE' END AS code FROM jd)"""


@_add("J14_correction_violations", f"WITH {_COR} SELECT page, block, code FROM cc WHERE code IS NOT NULL")
def correction_violations(spark, d):
    return review.apply_corrections(s.text_block(spark, d), _corrections(spark, d))[1]


@_add("C29_apply_accepted", f"WITH {_COR} SELECT b.page, b.block, sha256(coalesce(c.new_text, b.text)) AS digest FROM text_block b LEFT JOIN cc c ON c.page = b.page AND c.block = b.block AND c.code IS NULL")
def apply_accepted(spark, d):
    return review.apply_corrections(s.text_block(spark, d), _corrections(spark, d))[0].select("page", "block", F.sha2("text", 256).alias("digest"))


def _spaced(spark, d):
    """Two readings of blocks that run words together before a vowel: the second misses splits before ``a``, reads some in capitals, lacks some blocks and names another source for some."""
    rows = s.text_block(spark, d).selectExpr("page", "block", "'h' AS source", "regexp_replace(text, ' ([aeiou])', '$1') AS old_text", "text", "0.85 + CAST((page * 31 + block * 17) % 20 AS DOUBLE) / 100 AS review_score")
    first = rows.where("block % 23 <> 5").withColumnRenamed("text", "review_text")
    second = rows.where("block % 19 <> 4").selectExpr(
        "page", "block", "CASE WHEN block % 29 = 3 THEN 'x' ELSE source END AS source", "old_text", "CASE block % 6 WHEN 1 THEN replace(text, ' a', 'a') WHEN 3 THEN upper(text) ELSE text END AS review_text",
        "0.95 AS review_score").withColumn("review_score", F.col("review_score").cast("double"))
    return first, second


_SPACED = """sp AS (SELECT page, block, regexp_replace(text, ' ([aeiou])', '\\1', 'g') AS old, text AS a, CASE block % 6 WHEN 1 THEN replace(text, ' a', 'a') WHEN 3 THEN upper(text) ELSE text END AS b,
  least(0.85::DOUBLE + ((page * 31 + block * 17) % 20)::DOUBLE / 100, 0.95::DOUBLE) AS score FROM text_block)"""


@_add("C28_spacing_candidates", f"""WITH {_SPACED}, ok AS (SELECT * FROM sp WHERE block % 23 <> 5 AND block % 19 <> 4 AND block % 29 <> 3 AND score >= 0.9 AND replace(old, ' ', '') = replace(a, ' ', '') AND replace(old, ' ', '') = replace(b, ' ', '')),
ch AS (SELECT page, block, 'old' AS w, old AS t, unnest(range(1, length(old) + 1)) AS i FROM ok UNION ALL SELECT page, block, 'a', a, unnest(range(1, length(a) + 1)) FROM ok UNION ALL SELECT page, block, 'b', b, unnest(range(1, length(b) + 1)) FROM ok),
c AS (SELECT page, block, w, i, t[i] AS c, t[i + 1] AS nxt, sum(CASE WHEN t[i] = ' ' THEN 0 ELSE 1 END) OVER (PARTITION BY page, block, w ORDER BY i) AS p FROM ch),
g AS (SELECT page, block, p FROM c WHERE w <> 'old' AND c = ' ' GROUP BY ALL HAVING count(DISTINCT w) = 2),
made AS (SELECT c.page, c.block, string_agg(c.c || CASE WHEN g.p IS NOT NULL AND regexp_matches(c.c || c.nxt, '^[A-Za-z]{{2}}$') THEN ' ' ELSE '' END, '' ORDER BY c.i) AS candidate FROM c LEFT JOIN g ON g.page = c.page AND g.block = c.block AND g.p = c.p WHERE c.w = 'old' GROUP BY c.page, c.block)
SELECT page, block, round(score, 6) AS score, sha256(candidate) AS candidate FROM made JOIN ok USING (page, block) WHERE candidate <> old""")
def spacing_candidates(spark, d):
    good, _ = review.spacing_candidates(*_spaced(spark, d))
    return good.select("page", "block", F.round("score", 6).alias("score"), F.sha2("candidate", 256).alias("candidate"))


@_add("C28_spacing_mismatches", """SELECT page, block, CASE WHEN block % 23 = 5 THEN 'MISSING_FIRST' WHEN block % 19 = 4 THEN 'MISSING_SECOND' ELSE 'SOURCE_DIFFERS' END AS code FROM text_block
WHERE (block % 23 = 5) <> (block % 19 = 4) OR block % 29 = 3 AND block % 23 <> 5 AND block % 19 <> 4""")
def spacing_mismatches(spark, d):
    return review.spacing_candidates(*_spaced(spark, d))[1]


def _auth(spark, d):
    sessions = s.study_session(spark, d).selectExpr(
        "session_id", "user_id + CASE WHEN created_at % 53 = 0 THEN 100000000 ELSE 0 END AS user_id", "CASE WHEN created_at % 29 = 0 THEN created_at END AS revoked_at", "expires_at", "CAST(created_at % 2 AS INT) AS session_version")
    users = s.user_settings(spark, d).selectExpr("user_id", "CASE WHEN user_id % 13 = 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status", "1 AS session_version")
    return sessions, users


@_add("F09_classify_sessions", f"""SELECT session_id, CASE WHEN created_at % 53 = 0 THEN 'INVALID' WHEN created_at % 29 = 0 THEN 'REVOKED' WHEN expires_at <= {NOW_MS - 4 * 86_400_000} THEN 'EXPIRED' WHEN user_id % 13 = 0 THEN 'DISABLED' WHEN created_at % 2 <> 1 THEN 'VERSION_MISMATCH' ELSE 'OK' END AS code FROM study_session""")
def classify_sessions(spark, d):
    sessions, users = _auth(spark, d)
    return review.classify_sessions(sessions, users, NOW_MS - 4 * 86_400_000)


@_add("F06_failed_rules", """SELECT event_id, rules FROM (SELECT event_id, concat_ws(',', CASE WHEN NOT rating BETWEEN 2 AND 4 THEN 'rating' END, CASE WHEN undone_at IS NULL OR undone_at <= reviewed_at THEN 'undone_after' END) AS rules FROM review_log) WHERE rules <> ''""")
def row_rules(spark, d):
    rules = {"rating": F.col("rating").between(2, 4), "undone_after": F.col("undone_at") > F.col("reviewed_at")}
    return review.failed_rules(s.review_log(spark, d), rules).where(F.size("failed_rules") > 0).select("event_id", F.array_join("failed_rules", ",").alias("rules"))


@_add("J21_reconcile_pages", """SELECT d.doc_id AS page, CASE WHEN b.ok IS NULL THEN 'missing' WHEN b.ok THEN 'complete' ELSE 'stale' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d
LEFT JOIN (SELECT page, bool_and(NOT (page % 7 = 0 AND block % 5 = 0) AND NOT (page % 11 = 0 AND block % 3 = 0)) AS ok FROM text_block WHERE page % 13 <> 0 GROUP BY 1) b ON b.page = d.doc_id""")
def reconcile_pages(spark, d):
    blocks = s.text_block(spark, d).where("page % 13 <> 0").selectExpr(
        "page", "CASE WHEN page % 7 = 0 AND block % 5 = 0 THEN 'v0' ELSE 'v1' END AS config", "CASE WHEN page % 11 = 0 AND block % 3 = 0 THEN NULL ELSE 'h' END AS image_hash")
    pages = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page")).distinct()
    return review.reconcile_pages(blocks, pages, "v1")


@_add("A14_confirm_regions", "SELECT block % 50 AS region, avg(CASE WHEN length(text) > 60 THEN 1.0 ELSE 0 END) >= 0.6 AS confirmed FROM text_block GROUP BY 1")
def confirm_regions(spark, d):
    evidence = s.text_block(spark, d).select((F.col("block") % 50).alias("region"), (F.length("text") > 60).alias("has_ink"))
    return review.confirm_regions(evidence, 0.6).select("region", "confirmed")


@_add("O06_range_sample", "SELECT CAST(CAST('0x' || substring(sha256(word_key), 1, 4) AS INT) * 8 // 65536 AS INT) AS part, arg_min(word_key, sha256(word_key)) AS word_key FROM word GROUP BY 1")
def range_sample(spark, d):
    return review.range_sample(s.word(spark, d), "word_key")


@_add("C26_reassign_texts", """WITH t AS (SELECT phrase_key AS entity_key, word_key, unit_key, text FROM phrase UNION ALL SELECT example_key, word_key, unit_key, text FROM example),
m AS (SELECT t.entity_key, w.word_key AS owner, row_number() OVER (PARTITION BY t.entity_key ORDER BY (w.word_key = t.word_key) DESC, length(w.headword) DESC, w.word_key) AS n FROM t JOIN word w ON w.unit_key = t.unit_key AND contains(lower(t.text), lower(w.headword)))
SELECT t.entity_key, t.word_key, m.owner FROM t LEFT JOIN m ON m.entity_key = t.entity_key AND m.n = 1""")
def reassign_texts(spark, d):
    texts = s.phrase(spark, d).selectExpr("phrase_key AS entity_key", "word_key", "unit_key", "text").unionByName(s.example(spark, d).selectExpr("example_key AS entity_key", "word_key", "unit_key", "text"))
    return review.reassign_texts(texts, s.word(spark, d))


def _rounds(spark, d):
    return s.word(spark, d).where("p_partkey % 3 <> 0").selectExpr("word_key AS packet", "p_partkey", "explode(sequence(1, 4)) AS round").selectExpr(
        "packet", "round", "CASE (p_partkey + round * 2) % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'repair' END AS verdict", "concat('v', round) AS value")


@_add("C40_replay_corrections", """WITH RECURSIVE c AS (SELECT word_key AS packet, p_partkey, r.round, CASE (p_partkey + r.round * 2) % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'repair' END AS verdict FROM word JOIN range(1, 4) r(round) ON true WHERE p_partkey % 3 <> 0),
f AS (SELECT word_key AS packet, 0 AS k, NULL::VARCHAR AS value, 'needs_review' AS outcome FROM word
  UNION ALL SELECT f.packet, f.k + 1, CASE WHEN f.outcome IN ('accepted', 'blocked') THEN f.value WHEN c.verdict = 'repair' THEN 'v' || CAST(c.round AS VARCHAR) ELSE f.value END,
    CASE WHEN f.outcome IN ('accepted', 'blocked') THEN f.outcome WHEN c.verdict = 'pass' THEN CASE WHEN f.value IS NULL THEN 'accepted' ELSE 'repaired' END WHEN c.verdict = 'block' THEN 'blocked' ELSE 'needs_review' END
  FROM f JOIN c ON c.packet = f.packet AND c.round = f.k + 1)
SELECT packet, coalesce(value, 'v0') AS value, outcome FROM f QUALIFY row_number() OVER (PARTITION BY packet ORDER BY k DESC) = 1""")
def replay_corrections(spark, d):
    fields = s.word(spark, d).select(F.col("word_key").alias("packet"), F.lit("v0").alias("value"))
    return review.replay_corrections(fields, _rounds(spark, d))


@_add("S06_tagged_rows", """SELECT count(*) AS n, sum(CASE WHEN t = 'word' THEN 1 ELSE 0 END)::BIGINT AS words, sum(CASE WHEN t = 'unit' THEN 1 ELSE 0 END)::BIGINT AS units FROM (SELECT 'word' AS t FROM word UNION ALL SELECT 'unit' FROM unit)""")
def tagged_rows(spark, d):
    lines = io.tagged_rows({"word": s.word(spark, d), "unit": s.unit(spark, d)})
    tables, unknown = io.untag(lines, {"word": s.word(spark, d).schema, "unit": s.unit(spark, d).schema})
    parts = review.union_all([df.select(F.lit(n).alias("t")) for n, df in tables.items()] + [unknown.select(F.lit("?").alias("t"))])
    return parts.agg(F.count("*").alias("n"), F.count_if(F.col("t") == "word").alias("words"), F.count_if(F.col("t") == "unit").alias("units"))


@_add("S03_strict_json", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'BAD_JSON' WHEN event_id % 5 = 0 THEN 'UNKNOWN_KEY' WHEN event_id % 3 = 0 THEN 'WRONG_TYPE' ELSE 'GOOD' END AS reason FROM events) GROUP BY 1""")
def strict_json(spark, d):
    from pyspark.sql.types import IntegerType, StructType
    events = spark.read.parquet(f"{d}/events.parquet")
    line = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 5 == 0, F.lit('{"k": 1, "z": 2}')).when(F.col("event_id") % 3 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    good, bad = io.parse_strict(events.select(line.alias("line")), "line", StructType().add("k", IntegerType()))
    return bad.select("reason").unionByName(good.select(F.lit("GOOD").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@_add("S13_plan_uploads", """WITH a AS (SELECT 'audio/' || substring(sha256(text), 1, 2) || '/' || sha256(text) || '.wav' AS object_key, sha256(text) AS h, min(word_key) AS w FROM example GROUP BY text)
SELECT object_key, CASE WHEN CAST(substring(w, 2) AS INT) % 2 = 1 THEN 'upload' WHEN CAST(substring(w, 2) AS INT) % 10 = 0 THEN 'conflict' ELSE 'skip' END AS action FROM a""")
def plan_uploads(spark, d):
    from ..functions import keys
    rows = s.example(spark, d).groupBy("text").agg(F.min("word_key").alias("w")).withColumn("sha256", F.sha2("text", 256)).withColumn("object_key", keys.object_key(F.col("sha256")))
    n = F.substring("w", 2, 20).cast("int")
    existing = rows.where(n % 2 == 0).select("object_key", F.when(n % 10 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return io.plan_uploads(rows.select("object_key", "sha256"), existing).select("object_key", "action")


@_add("ST01_normalize_lines", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_lines(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))
