"""Audit and assembly queries, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aliases, audit, releases, review
from ..sources import standins as s
from ..sources.standins import with_views
from .content_queries import _ROOTS, _canonical
from .review_queries import _PKT, _packets, _results
from .study_queries import _STAGE, _progress

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query
    return keep


_LAYOUT = """lay AS (SELECT page, block, CAST(CASE WHEN block % 5 = 0 OR block % 2 = 0 THEN 0.05 ELSE 0.55 END AS DOUBLE) AS x0, y0, CAST(CASE WHEN block % 5 = 0 THEN 0.95 WHEN block % 2 = 0 THEN 0.45 ELSE 0.95 END AS DOUBLE) AS x1 FROM text_block)"""


@_add("O07_reading_order", f"""WITH {_LAYOUT}, b AS (SELECT *, CASE WHEN x1 - x0 >= 0.6 THEN -1 WHEN (x0 + x1) / 2 < 0.5 THEN 0 ELSE 1 END AS col,
  sum(CASE WHEN x1 - x0 >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, block) AS band FROM lay)
SELECT page, block, CAST(row_number() OVER (PARTITION BY page ORDER BY band, col, y0, x0, block) AS INT) AS place FROM b""")
def reading_order(spark, d):
    blocks = s.text_block(spark, d).withColumns({
        "x0": F.when((F.col("block") % 5 == 0) | (F.col("block") % 2 == 0), 0.05).otherwise(0.55),
        "x1": F.when(F.col("block") % 5 == 0, 0.95).when(F.col("block") % 2 == 0, 0.45).otherwise(0.95)})
    return audit.reading_order(blocks).select("page", "block", "place")


@_add("SS05_apply_patches", """WITH g AS (SELECT DISTINCT s.session_id, c.word_key FROM (SELECT session_id, unnest(cards) AS content_card_key FROM study_session) s JOIN card_definition c USING (content_card_key)),
p AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '.' || CAST(reviewed_at // 86400000 AS VARCHAR) AS session_id, event_id // 2 AS event_id, 'w' || CAST(event_id % 25 AS VARCHAR) AS word_key, ingest_seq AS seq FROM review_log),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_id ORDER BY seq) AS k FROM p)
SELECT n.session_id, n.seq, CASE WHEN k > 1 THEN 'REPLAY' WHEN g.word_key IS NULL THEN 'NOT_IN_GROUP' ELSE 'APPLIED' END AS code FROM n LEFT JOIN g ON g.session_id = n.session_id AND g.word_key = n.word_key""")
def apply_patches(spark, d):
    members = s.study_session(spark, d).select("session_id", F.explode("cards").alias("content_card_key")).join(s.card_definition(spark, d), "content_card_key").select("session_id", "word_key")
    patches = s.review_log(spark, d).selectExpr("concat('u', user_id, '.', reviewed_at div 86400000) AS session_id", "event_id div 2 AS event_id", "concat('w', event_id % 25) AS word_key", "ingest_seq AS seq")
    return audit.apply_patches(patches, members).select("session_id", "seq", "code")


_CHG = """docs AS (SELECT 'sense' AS entity_type, sense_key AS entity_key, gloss AS text FROM sense UNION ALL SELECT 'phrase', phrase_key, text FROM phrase),
chg AS (SELECT 'sense' AS entity_type, sense_key AS entity_key, CASE WHEN sense_order = 1 THEN 'update' ELSE 'delete' END AS op, gloss || ' new' AS text, 1 AS seq FROM sense WHERE word_key LIKE '%3'
  UNION ALL SELECT 'sense', sense_key, 'insert', gloss || ' again', 2 FROM sense WHERE word_key LIKE '%13'
  UNION ALL SELECT 'phrase', phrase_key || 'x', 'insert', text, 1 FROM phrase WHERE word_key LIKE '%4')"""


@_add("SS08_maintain_documents", f"""WITH {_CHG}, l AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY entity_type, entity_key ORDER BY seq DESC) = 1)
SELECT * FROM docs WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.entity_type = docs.entity_type AND l.entity_key = docs.entity_key) UNION ALL SELECT entity_type, entity_key, text FROM l WHERE op <> 'delete'""")
def maintain_documents(spark, d):
    senses, phrases = s.sense(spark, d), s.phrase(spark, d)
    docs = senses.selectExpr("'sense' AS entity_type", "sense_key AS entity_key", "gloss AS text").unionByName(phrases.selectExpr("'phrase' AS entity_type", "phrase_key AS entity_key", "text"))
    changes = review.union_all([
        senses.where("word_key LIKE '%3'").selectExpr("'sense' AS entity_type", "sense_key AS entity_key", "CASE WHEN sense_order = 1 THEN 'update' ELSE 'delete' END AS op", "concat(gloss, ' new') AS text", "1 AS seq"),
        senses.where("word_key LIKE '%13'").selectExpr("'sense' AS entity_type", "sense_key AS entity_key", "'insert' AS op", "concat(gloss, ' again') AS text", "2 AS seq"),
        phrases.where("word_key LIKE '%4'").selectExpr("'phrase' AS entity_type", "concat(phrase_key, 'x') AS entity_key", "'insert' AS op", "text", "1 AS seq")])
    return audit.maintain_documents(docs, changes)


@_add("J20_progress_for", f"""WITH RECURSIVE {_ROOTS}, {_STAGE}, rq AS (SELECT user_id, event_id AS place, 'w' || CAST(event_id % 25 AS VARCHAR) AS word_key FROM review_log)
SELECT rq.user_id, rq.place, rq.word_key, g.stage FROM rq LEFT JOIN roots r ON r.key = rq.word_key AND r.code IS NULL LEFT JOIN stage g ON g.user_id = rq.user_id AND g.word_key = coalesce(r.root, rq.word_key)""")
def progress_for(spark, d):
    requests = s.review_log(spark, d).selectExpr("user_id", "event_id AS place", "concat('w', event_id % 25) AS word_key")
    return audit.progress_for(requests, _canonical(spark, d), _progress(spark, d)).select("user_id", "place", "word_key", "stage")


def _paged(df):
    return df.withColumn("page", F.regexp_extract("word_key", r"(\d+)", 1).cast("int") % 300)


@_add("A11_unit_page_spans", """WITH p AS (SELECT unit_key, CAST(substring(word_key, 2) AS INT) % 300 AS page FROM word UNION ALL SELECT unit_key, CAST(substring(word_key, 2) AS INT) % 300 + 7 FROM example)
SELECT u.unit_key, u.unit_order AS first_page, max(x.page) AS last_page FROM unit u JOIN (SELECT * FROM p UNION ALL SELECT unit_key, unit_order FROM unit) x ON x.unit_key = u.unit_key GROUP BY 1, 2""")
def unit_page_spans(spark, d):
    units = s.unit(spark, d).select("unit_key", F.col("unit_order").alias("page"))
    return audit.page_spans([_paged(s.word(spark, d)), _paged(s.example(spark, d)).withColumn("page", F.col("page") + 7)], units)


@_add("C12_release_checks", """WITH w AS (SELECT * FROM word WHERE p_partkey % 19 <> 0)
SELECT 'sense_orphans' AS "check", count(*) AS failures, count(*) = 0 AS passed FROM sense WHERE word_key NOT IN (SELECT word_key FROM w)
UNION ALL SELECT 'duplicate_words', count(*), count(*) = 0 FROM (SELECT word_key FROM w GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'cardless_words', count(*), count(*) = 0 FROM word WHERE word_key NOT IN (SELECT word_key FROM card_definition WHERE status = 'ACTIVE')
UNION ALL SELECT 'missing_alias_ends', count(*), count(*) = 0 FROM (SELECT DISTINCT key FROM (SELECT from_key AS key FROM content_key_alias UNION ALL SELECT to_key FROM content_key_alias)) WHERE key NOT IN (SELECT word_key FROM w)""")
def release_checks(spark, d):
    words = s.word(spark, d)
    some = words.where("p_partkey % 19 <> 0")
    return audit.checks({
        "sense_orphans": s.sense(spark, d).join(some, "word_key", "left_anti"), "duplicate_words": aliases.duplicates(some, ["word_key"]),
        "cardless_words": words.join(s.card_definition(spark, d).where("status = 'ACTIVE'"), "word_key", "left_anti"),
        "missing_alias_ends": aliases.missing_ends(s.content_key_alias(spark, d), some)})


_FIND = """fnd AS (SELECT p.unit_key, 'PHRASE_WITHOUT_HEAD' AS code FROM phrase p JOIN word w USING (word_key) WHERE NOT contains(lower(p.text), lower(w.headword))
  UNION ALL SELECT e.unit_key, 'EXAMPLE_WITHOUT_HEAD' FROM example e JOIN word w USING (word_key) WHERE NOT contains(lower(e.text), lower(w.headword))
  UNION ALL SELECT unit_key, 'NO_PHRASE' FROM word WHERE word_key NOT IN (SELECT word_key FROM phrase))"""


@_add("C31_validate_units", f"WITH {_FIND} SELECT u.unit_key, CASE WHEN f.codes IS NULL THEN 'PASSED' ELSE 'BLOCKED' END AS status, coalesce(f.codes, '') AS codes FROM unit u LEFT JOIN (SELECT unit_key, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM fnd GROUP BY 1) f USING (unit_key)")
def validate_units(spark, d):
    words = s.word(spark, d)
    forms = F.array(F.lower("headword"))

    def without_head(df, key, code):
        texts = df.select(F.col(key).alias("entity_key"), "word_key", "unit_key", "text")
        bad = releases.ownership_findings(words, texts, forms)
        return bad.select("unit_key", F.lit(code).alias("code"))

    findings = review.union_all([
        without_head(s.phrase(spark, d), "phrase_key", "PHRASE_WITHOUT_HEAD"), without_head(s.example(spark, d), "example_key", "EXAMPLE_WITHOUT_HEAD"),
        words.join(s.phrase(spark, d), "word_key", "left_anti").select("unit_key", F.lit("NO_PHRASE").alias("code"))])
    return audit.unit_verdicts(s.unit(spark, d), findings)


@_add("C32_assess_units", f"""WITH {_PKT}, r AS (SELECT pkt.unit_key, CASE WHEN seq % 2 = 0 THEN 'review' ELSE 'repair' END AS role, CAST(seq % 4 AS INT) AS round, seq, verdict FROM res JOIN pkt USING (packet) WHERE pkt.unit_key NOT LIKE '%3'),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY round DESC, seq DESC) = 1)
SELECT u.unit_key, CASE WHEN l.unit_key IS NULL THEN 'awaiting_generation' WHEN verdict = 'block' THEN 'blocked' WHEN role = 'review' AND verdict = 'pass' THEN 'passed' WHEN role = 'review' AND round >= 3 THEN 'blocked' WHEN role = 'review' THEN 'awaiting_repair' ELSE 'awaiting_review' END AS state FROM unit u LEFT JOIN l USING (unit_key)""")
def assess_units(spark, d):
    rows = _results(spark, d).join(_packets(spark, d).select("packet", "unit_key"), "packet").where("unit_key NOT LIKE '%3'")
    rows = rows.selectExpr("unit_key", "CASE WHEN seq % 2 = 0 THEN 'review' ELSE 'repair' END AS role", "CAST(seq % 4 AS INT) AS round", "seq", "verdict")
    return audit.assess_units(s.unit(spark, d), rows)


@_add("C33_fold_repairs", f"""WITH {_PKT}, rep AS (SELECT packet, seq % 5 AS round, seq, 'r' || CAST(seq AS VARCHAR) AS value FROM res), fl AS (SELECT DISTINCT packet FROM res WHERE verdict = 'repair'),
l AS (SELECT rep.* FROM rep JOIN fl USING (packet) WHERE round <= 3 QUALIFY row_number() OVER (PARTITION BY packet ORDER BY round DESC, seq DESC) = 1)
SELECT w.word_key AS entity, coalesce(l.value, w.headword) AS value, l.value IS NOT NULL AS repaired FROM word w LEFT JOIN l ON l.packet = w.word_key""")
def fold_repairs(spark, d):
    fields = s.word(spark, d).select(F.col("word_key").alias("entity"), F.lit("head").alias("field"), F.col("headword").alias("value"))
    results = _results(spark, d).select(F.col("packet").alias("entity"), F.lit("head").alias("field"), (F.col("seq") % 5).alias("round"), "seq", F.concat(F.lit("r"), "seq").alias("value"), "verdict")
    return review.fold_repairs(fields, results.drop("verdict"), results.where("verdict = 'repair'")).select("entity", "value", "repaired")


@_add("C39_work_packets", """WITH x AS (SELECT w.unit_key, count(*) AS words, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS senses, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS phrases, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS examples FROM word w
LEFT JOIN (SELECT word_key, count(*) AS n FROM sense GROUP BY 1) a USING (word_key) LEFT JOIN (SELECT word_key, count(*) AS n FROM phrase GROUP BY 1) b USING (word_key) LEFT JOIN (SELECT word_key, count(*) AS n FROM example GROUP BY 1) c USING (word_key) GROUP BY 1)
SELECT unit_key, 'generate' AS role, 1 AS round, sha256('{"examples":' || examples || ',"phrases":' || phrases || ',"senses":' || senses || ',"unit_key":"' || unit_key || '","words":' || words || '}') AS packet_hash FROM x""")
def work_packets(spark, d):
    from .release_queries import unit_workloads
    return audit.work_packets(unit_workloads(spark, d), "generate", 1).drop("payload")


@_add("A26_import_coverage", """SELECT (SELECT count(*) FROM word) AS words, (SELECT count(*) FROM sense) AS senses, (SELECT count(*) FROM example) AS examples, (SELECT count(*) FROM word WHERE word_key NOT IN (SELECT word_key FROM example)) AS words_without_example,
(SELECT count(*) FROM example e JOIN word w USING (word_key) WHERE NOT contains(lower(e.text), lower(w.headword))) AS spans_missing""")
def import_coverage(spark, d):
    words, examples = s.word(spark, d), s.example(spark, d)
    rows = words.select("word_key", "headword").join(examples.select("word_key", "example_key", "text"), "word_key", "left")
    missing = F.col("text").isNotNull() & ~F.contains(F.lower("text"), F.lower("headword"))
    one = rows.agg(F.count_distinct("word_key").alias("words"), F.count("example_key").alias("examples"), F.count_if(F.col("example_key").isNull()).alias("words_without_example"), F.count_if(missing).alias("spans_missing"))
    return one.join(s.sense(spark, d).agg(F.count("*").alias("senses")))


@_add("A25_audit_summary", r"""SELECT 'lines' AS kind, count(*) AS n FROM page_line UNION ALL SELECT 'digit', count(*) FROM page_line WHERE regexp_matches(text, '[0-9]') UNION ALL SELECT 'symbol', count(*) FROM page_line WHERE regexp_matches(text, '[#$%&*|]')""")
def audit_summary(spark, d):
    counts = s.page_line(spark, d).agg(F.count("*").alias("lines"), F.count_if(F.col("text").rlike("[0-9]")).alias("digit"), F.count_if(F.col("text").rlike("[#$%&*|]")).alias("symbol"))
    return counts.select(F.expr("stack(3, 'lines', lines, 'digit', digit, 'symbol', symbol) AS (kind, n)"))


@_add("F14_select_lines", r"SELECT page, block FROM text_block WHERE y1 - y0 <= 0.06 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 5 AND NOT regexp_matches(text, '[A-Za-z]{12,}')")
def select_lines(spark, d):
    fits = ((F.col("y1") - F.col("y0")) <= 0.06) & (F.regexp_count("text", F.lit("[A-Za-z]")) >= 5) & ~F.col("text").rlike("[A-Za-z]{12,}")
    return s.text_block(spark, d).where(fits).select("page", "block")


@_add("F12_confusion_flags", r"""SELECT doc_id, line, flags FROM (SELECT doc_id, line, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z][0-9]|[0-9][A-Za-z]') THEN 'digit_in_word' END, CASE WHEN contains(text, 'rn') THEN 'rn' END) AS flags FROM page_line) WHERE flags <> ''""")
def confusion_flags(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("text").rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"), "digit_in_word"), F.when(F.contains("text", F.lit("rn")), "rn")))
    return s.page_line(spark, d).select("doc_id", "line", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


@_add("MA04_duration_bands", "SELECT example_key, round(least(greatest(length(text) * 0.035, 0.3), 12.0), 2)::DOUBLE AS min_seconds, round(least(greatest(length(text) * 0.14, 0.3), 12.0), 2)::DOUBLE AS max_seconds FROM example")
def duration_bands(spark, d):
    return s.example(spark, d).select("example_key", audit.duration_band(F.length("text")).alias("b")).select("example_key", "b.*")


@_add("F16_redact", """SELECT event_id, CASE WHEN event_type = 'signup' THEN '[redacted]' ELSE props END AS value FROM events""")
def redact(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    record = F.create_map(F.when(F.col("event_type") == "signup", "session_token").otherwise(F.col("event_type")), F.col("props"))
    return events.select("event_id", F.get(F.map_values(audit.redact(record)), 0).alias("value"))


@_add("MA06_digit_candidates", """SELECT DISTINCT n, array_to_string(list_distinct([n, CAST(reverse(CAST(n AS VARCHAR)) AS INT)]), ',') <> '' AS has FROM (SELECT CAST(length(text) % 100 AS INT) AS n FROM page_line)""")
def digit_candidates(spark, d):
    rows = s.page_line(spark, d).select((F.length("text") % 100).cast("int").alias("n")).distinct()
    return rows.select("n", (F.size(text.digit_candidates(F.col("n"))) > 0).alias("has"))
