"""Queries over words, aliases, cards, queues and the dictionary, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import aliases, cards, releases, scheduling, search
from ..sources import standins as s
from ..sources.standins import NOW_MS, with_views
from .study_queries import _FOLD, _STAGE, _live, _progress, _states

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query
    return keep


@_add("J01_word_with_unit", "SELECT w.word_key, w.headword, u.unit_order, u.title, w.source_order FROM word w JOIN unit u ON u.unit_key = w.unit_key")
def word_with_unit(spark, d):
    return s.word(spark, d).join(s.unit(spark, d), "unit_key").select("word_key", "headword", "unit_order", "title", "source_order")


@_add("F04_unit_words", "SELECT unit_key, word_key, tier, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY tier, source_order, word_key) AS INT) AS place FROM word")
def unit_words(spark, d):
    from pyspark.sql import Window
    order = Window.partitionBy("unit_key").orderBy("tier", "source_order", "word_key")
    return s.word(spark, d).select("unit_key", "word_key", "tier", F.row_number().over(order).alias("place"))


_WALK = """walk AS (SELECT from_key AS key, to_key AS reached, 1 AS depth FROM (SELECT DISTINCT from_key, to_key FROM content_key_alias)
  UNION ALL SELECT w.key, e.to_key, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT from_key, to_key FROM content_key_alias) e ON e.from_key = w.reached WHERE w.depth < 64)"""


@_add("J09_alias_walk", f"WITH RECURSIVE {_WALK} SELECT DISTINCT key, reached, CAST(depth AS INT) AS depth FROM walk")
def alias_walk(spark, d):
    return aliases.alias_walk(s.content_key_alias(spark, d))


_ROOTS = f"""{_WALK}, roots AS (SELECT o.key, e.root, o.declared, CASE WHEN o.n > 1 THEN 'AMBIGUOUS' WHEN e.root IS NULL THEN 'CYCLE' WHEN e.root <> o.declared THEN 'ROOT_MISMATCH' END AS code
  FROM (SELECT from_key AS key, count(DISTINCT to_key) AS n, min(canonical_key) AS declared FROM content_key_alias GROUP BY 1) o
  LEFT JOIN (SELECT key, min(reached) AS root FROM walk WHERE reached NOT IN (SELECT from_key FROM content_key_alias) GROUP BY 1) e ON e.key = o.key)"""


@_add("C02_resolve_aliases", f"WITH RECURSIVE {_ROOTS} SELECT * FROM roots")
def resolve_aliases(spark, d):
    return aliases.resolve_aliases(s.content_key_alias(spark, d))


def _canonical(spark, d):
    return aliases.resolve_aliases(s.content_key_alias(spark, d)).where("code IS NULL").select("key", "root")


@_add("J08_canonicalize", f"WITH RECURSIVE {_ROOTS} SELECT w.word_key, coalesce(r.root, w.word_key) AS canonical_key FROM word w LEFT JOIN roots r ON r.key = w.word_key AND r.code IS NULL")
def canonicalize(spark, d):
    return aliases.canonicalize(s.word(spark, d).select("word_key"), "word_key", _canonical(spark, d))


def _bad_edges(spark, d):
    """The aliases with faults: a second successor, a repeated edge and a loop now and then."""
    edges = s.content_key_alias(spark, d).withColumn("n", F.regexp_extract("from_key", r"(\d+)", 1).cast("int"))
    again = edges.where("n % 21 = 0 AND release_id = 'r1'")
    extra = edges.where("n % 35 = 0 AND release_id = 'r1'").withColumn("to_key", F.concat("from_key", F.lit("z")))
    loop = edges.where("n % 77 = 0 AND release_id = 'r1'").select("release_id", F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"), "canonical_key", "n")
    return edges.unionByName(again).unionByName(extra).unionByName(loop).drop("n")


_BAD = """bn AS (SELECT *, CAST(regexp_extract(from_key, '([0-9]+)', 1) AS INT) AS n FROM content_key_alias),
bad AS (SELECT release_id, from_key, to_key, canonical_key FROM bn UNION ALL SELECT release_id, from_key, to_key, canonical_key FROM bn WHERE n % 21 = 0 AND release_id = 'r1'
  UNION ALL SELECT release_id, from_key, from_key || 'z', canonical_key FROM bn WHERE n % 35 = 0 AND release_id = 'r1'
  UNION ALL SELECT release_id, to_key, from_key, canonical_key FROM bn WHERE n % 77 = 0 AND release_id = 'r1'),
be AS (SELECT DISTINCT from_key, to_key FROM bad),
bw AS (SELECT from_key AS key, to_key AS reached, 1 AS depth FROM be UNION SELECT w.key, e.to_key, w.depth + 1 FROM bw w JOIN be e ON e.from_key = w.reached WHERE w.depth < 64),
br AS (SELECT o.key, CASE WHEN o.n > 1 THEN 'AMBIGUOUS' WHEN e.root IS NULL THEN 'CYCLE' WHEN e.root <> o.declared THEN 'CANONICAL_MISMATCH' END AS code
  FROM (SELECT from_key AS key, count(DISTINCT to_key) AS n, min(canonical_key) AS declared FROM bad GROUP BY 1) o
  LEFT JOIN (SELECT key, min(reached) AS root FROM bw WHERE reached NOT IN (SELECT from_key FROM be) GROUP BY 1) e ON e.key = o.key)"""


@_add("C03_validate_aliases", f"""WITH RECURSIVE {_BAD}
SELECT 'DUPLICATE_EDGE' AS code, from_key AS key, 1 AS n FROM bad GROUP BY release_id, from_key, to_key HAVING count(*) > 1
UNION ALL SELECT 'ONE_TO_MANY', from_key, 1 FROM bad GROUP BY from_key HAVING count(DISTINCT to_key) > 1
UNION ALL SELECT 'MANY_TO_ONE', to_key, 1 FROM bad GROUP BY to_key HAVING count(DISTINCT from_key) > 1
UNION ALL SELECT code, key, 1 FROM br WHERE code IN ('CYCLE', 'CANONICAL_MISMATCH')""")
def validate_aliases(spark, d):
    return aliases.edge_errors(_bad_edges(spark, d))


@_add("J07_missing_alias_ends", "SELECT DISTINCT key FROM (SELECT from_key AS key FROM content_key_alias UNION ALL SELECT to_key FROM content_key_alias) WHERE key NOT IN (SELECT word_key FROM word)")
def missing_ends(spark, d):
    return aliases.missing_ends(s.content_key_alias(spark, d), s.word(spark, d))


@_add("J06_state_conflicts", f"WITH RECURSIVE {_ROOTS}, {_STAGE} SELECT g.user_id, g.word_key, r.root FROM stage g JOIN roots r ON r.key = g.word_key AND r.code IS NULL AND r.root <> r.key")
def state_conflicts(spark, d):
    return aliases.state_conflicts(_progress(spark, d).select("user_id", "word_key"), _canonical(spark, d))


@_add("X02_edge_union", """WITH dec AS (SELECT release_id, from_key, to_key, from_key || 'c' AS canonical_key FROM content_key_alias WHERE release_id = 'r1' UNION ALL SELECT 'r3', to_key, to_key || 'n', to_key || 'n' FROM content_key_alias WHERE release_id = 'r2')
SELECT * FROM content_key_alias s WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.release_id = s.release_id AND d.from_key = s.from_key AND d.to_key = s.to_key) UNION ALL SELECT * FROM dec""")
def edge_union(spark, d):
    stored = s.content_key_alias(spark, d)
    declared = stored.where("release_id = 'r1'").withColumn("canonical_key", F.concat("from_key", F.lit("c"))).unionByName(
        stored.where("release_id = 'r2'").selectExpr("'r3' AS release_id", "to_key AS from_key", "concat(to_key, 'n') AS to_key", "concat(to_key, 'n') AS canonical_key"))
    return aliases.edge_union(stored, declared)


@_add("X07_closure", """WITH RECURSIVE b AS (SELECT from_key AS u, to_key AS v FROM content_key_alias UNION SELECT to_key, from_key FROM content_key_alias),
c AS (SELECT word_key AS key FROM word WHERE p_partkey % 28 = 0 UNION SELECT b.v FROM c JOIN b ON b.u = c.key) SELECT key FROM c""")
def closure(spark, d):
    return aliases.closure(s.content_key_alias(spark, d), s.word(spark, d).where("p_partkey % 28 = 0").selectExpr("word_key AS key"))


def _new_words(spark, d):
    """The words of the next release: every 7th has another key, every 10th is gone, every 9th is new."""
    w = s.word(spark, d)
    kept = w.where("p_partkey % 10 <> 0").withColumn("word_key", F.when(F.col("p_partkey") % 7 == 0, F.concat("word_key", F.lit("a"))).otherwise(F.col("word_key")))
    new = w.where("p_partkey % 9 = 0").withColumns({"word_key": F.concat("word_key", F.lit("n")), "headword": F.concat("headword", F.lit(" new"))})
    return kept.unionByName(new)


_CONT = """nw AS (SELECT unit_key, headword, CASE WHEN p_partkey % 7 = 0 THEN word_key || 'a' ELSE word_key END AS word_key FROM word WHERE p_partkey % 10 <> 0
  UNION ALL SELECT unit_key, headword || ' new', word_key || 'n' FROM word WHERE p_partkey % 9 = 0),
os AS (SELECT unit_key, lower(trim(headword)) AS head, word_key AS old_key, count(*) OVER (PARTITION BY unit_key, lower(trim(headword))) AS n FROM word),
ns AS (SELECT unit_key, lower(trim(headword)) AS head, word_key AS new_key, count(*) OVER (PARTITION BY unit_key, lower(trim(headword))) AS n FROM nw),
cont AS (SELECT coalesce(o.unit_key, n.unit_key) AS unit_key, coalesce(o.head, n.head) AS head, old_key, new_key,
  CASE WHEN old_key IS NULL THEN 'added' WHEN new_key IS NULL THEN 'removed' WHEN old_key = new_key THEN 'preserved' ELSE 'aliased' END AS kind
  FROM os o FULL JOIN ns n ON o.unit_key = n.unit_key AND o.head = n.head AND o.n = 1 AND n.n = 1)"""


@_add("C05_key_continuity", f"WITH {_CONT} SELECT * FROM cont")
def key_continuity(spark, d):
    return aliases.key_continuity(s.word(spark, d), _new_words(spark, d))


@_add("X06_continuity_counts", f"WITH {_CONT} SELECT kind, count(*) AS n FROM cont GROUP BY 1")
def continuity_counts(spark, d):
    return aliases.key_continuity(s.word(spark, d), _new_words(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@_add("A17_unique_by", "SELECT word_key, headword FROM (SELECT *, count(*) OVER (PARTITION BY headword) AS n FROM word) WHERE n = 1")
def unique_by(spark, d):
    return aliases.unique_by(s.word(spark, d), ["headword"]).select("word_key", "headword")


@_add("A18_duplicates", "SELECT tier, unit_key, count(*) AS n FROM word GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return aliases.duplicates(s.word(spark, d), ["tier", "unit_key"])


_RANK = "CASE card_type WHEN 'WORD_MEANING' THEN 0 WHEN 'CONTEXT_MEANING' THEN 1 WHEN 'PHRASE' THEN 2 ELSE 3 END"


@_add("O01_queue_order", f"""SELECT c.unit_key, c.content_card_key, CAST(row_number() OVER (PARTITION BY c.unit_key ORDER BY {_RANK}, w.source_order, c.target_entity_key, c.content_card_key) AS INT) AS place
FROM card_definition c JOIN word w ON w.word_key = c.word_key WHERE c.status = 'ACTIVE'""")
def queue_order(spark, d):
    return cards.queue_order(s.card_definition(spark, d), s.word(spark, d)).select("unit_key", "content_card_key", "place")


@_add("C06_generate_cards", """SELECT unit_key, word_key, card_type, target_entity_key, sha256('{"book":"b1","ordinal":' || CAST(w.source_order AS VARCHAR) || ',"slug":"' || replace(lower(card_type), '_', '-') || ':' || target_entity_key || '","type":"card","unit":"' || unit_key || '"}') AS content_card_key FROM (
  SELECT unit_key, word_key, 'WORD_MEANING' AS card_type, sense_key AS target_entity_key FROM sense UNION ALL SELECT unit_key, word_key, 'CONTEXT_MEANING', example_key FROM example
  UNION ALL SELECT unit_key, word_key, 'PHRASE', phrase_key FROM phrase) c JOIN (SELECT word_key, source_order FROM word) w USING (word_key)""")
def generate_cards(spark, d):
    return cards.generate_cards(s.word(spark, d), s.sense(spark, d), s.phrase(spark, d), s.example(spark, d), "b1")


@_add("A10_card_counts", "SELECT unit_key, count(*) FILTER (card_type = 'WORD_MEANING') AS WORD_MEANING, count(*) FILTER (card_type = 'CONTEXT_MEANING') AS CONTEXT_MEANING, count(*) FILTER (card_type = 'PHRASE') AS PHRASE, count(*) FILTER (card_type = 'SENSE_DISCRIMINATION') AS SENSE_DISCRIMINATION FROM card_definition GROUP BY 1")
def card_counts(spark, d):
    return s.card_definition(spark, d).groupBy("unit_key").pivot("card_type", list(cards.CARD_TYPE_RANK)).count().fillna(0)


_BOOK = "book AS (SELECT w.word_key, row_number() OVER (ORDER BY u.unit_order, u.unit_key, w.source_order, w.word_key) AS place FROM word w JOIN unit u USING (unit_key))"


@_add("WN10_next_new_words", f"""WITH {_STAGE}, {_BOOK},
b AS (SELECT user_id, count(*) AS n FROM stage GROUP BY 1),
o AS (SELECT us.user_id, us.new_words_per_group AS size, k.word_key, row_number() OVER (PARTITION BY us.user_id ORDER BY k.place) AS number
  FROM user_settings us LEFT JOIN b ON b.user_id = us.user_id JOIN book k ON k.place <= coalesce(b.n, 0) + us.new_words_per_group
  WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.user_id = us.user_id AND s.word_key = k.word_key))
SELECT user_id, word_key, CAST(number AS INT) AS number FROM o WHERE number <= size""")
def next_new_words(spark, d):
    words = s.word(spark, d).join(s.unit(spark, d), "unit_key")
    return cards.next_new_words(words, _progress(spark, d), s.user_settings(spark, d).select("user_id", "new_words_per_group"))


@_add("C07_new_words_queue", f"""WITH {_STAGE}, {_BOOK},
b AS (SELECT user_id, count(*) AS n FROM stage GROUP BY 1),
o AS (SELECT us.user_id, us.new_words_per_group AS size, k.word_key, row_number() OVER (PARTITION BY us.user_id ORDER BY k.place) AS number
  FROM user_settings us LEFT JOIN b ON b.user_id = us.user_id JOIN book k ON k.place <= coalesce(b.n, 0) + us.new_words_per_group
  WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.user_id = us.user_id AND s.word_key = k.word_key))
SELECT o.user_id, o.word_key, c.content_card_key FROM o JOIN card_definition c ON c.word_key = o.word_key AND c.status = 'ACTIVE' WHERE number <= size""")
def new_words_queue(spark, d):
    return next_new_words(spark, d).join(s.card_definition(spark, d).where("status = 'ACTIVE'"), "word_key").select("user_id", "word_key", "content_card_key")


@_add("C08_supplemental_queue", f"""WITH {_STAGE} SELECT g.user_id, c.content_card_key, c.card_type FROM stage g JOIN card_definition c ON c.word_key = g.word_key AND c.status = 'ACTIVE'
WHERE NOT EXISTS (SELECT 1 FROM review_log l WHERE l.undone_at IS NULL AND l.user_id = g.user_id AND l.content_card_key = c.content_card_key)""")
def supplemental_queue(spark, d):
    graded = _live(spark, d).select("user_id", "content_card_key").distinct()
    return cards.cards_without_state(_progress(spark, d), s.card_definition(spark, d), graded).select("user_id", "content_card_key", "card_type")


_QUEUE = f"""rq AS (SELECT user_id, content_card_key, row_number() OVER (PARTITION BY user_id ORDER BY due_at, content_card_key) AS place
  FROM st WHERE due_at <= {NOW_MS} AND content_card_key IN (SELECT content_card_key FROM card_definition WHERE status = 'ACTIVE'))"""


@_add("C09_review_queue", f"WITH RECURSIVE {_FOLD}, {_QUEUE} SELECT user_id, content_card_key, CAST(place AS INT) AS place FROM rq WHERE place <= 100")
def review_queue(spark, d):
    return cards.review_queue(_states(spark, d), s.card_definition(spark, d), NOW_MS).select("user_id", "content_card_key", "place")


@_add("C10_build_sessions", f"""WITH RECURSIVE {_FOLD}, {_QUEUE} SELECT user_id, CAST(count(*) AS INT) AS n_cards, string_agg(content_card_key, ',' ORDER BY place) AS cards, {NOW_MS} AS created_at, {NOW_MS + 86_400_000} AS expires_at FROM rq WHERE place <= 100 GROUP BY 1""")
def build_sessions(spark, d):
    return cards.build_sessions(review_queue(spark, d), NOW_MS)


@_add("A20_session_groups", """SELECT session_id, count(DISTINCT c.unit_key) AS n_units, array_to_string(list_sort(list_distinct(list(c.word_key))), ',') AS words
FROM (SELECT session_id, unnest(cards) AS content_card_key FROM study_session) s JOIN card_definition c USING (content_card_key) GROUP BY 1""")
def session_groups(spark, d):
    return cards.session_groups(s.study_session(spark, d), s.card_definition(spark, d))


def _documents(spark, d):
    return search.search_documents(s.sense(spark, d), s.phrase(spark, d), s.example(spark, d))


_DOCS = "docs AS (SELECT 'sense' AS entity_type, sense_key AS entity_key, word_key, gloss AS text FROM sense UNION ALL SELECT 'phrase', phrase_key, word_key, text FROM phrase UNION ALL SELECT 'example', example_key, word_key, text FROM example)"


@_add("S11_search_documents", f"WITH {_DOCS} SELECT * FROM docs")
def search_documents(spark, d):
    return _documents(spark, d)


def _queries(spark, d):
    """What is searched: first words, their beginnings, whole heads and pairs of words, taken from the parts."""
    return s.word(spark, d).where("p_partkey % 20 = 0").select(F.explode(F.array(
        F.substring_index("headword", " ", 1), F.substring("headword", 1, 2), F.col("headword"),
        F.concat(F.substring_index("headword", " ", -1), F.lit(" th")), F.lit("  "))).alias("query")).distinct()


_SEARCH = f"""{_DOCS},
asked AS (SELECT DISTINCT trim(q) AS query FROM (SELECT unnest([split_part(headword, ' ', 1), substring(headword, 1, 2), headword, split_part(headword, ' ', -1) || ' th', '  ']) AS q FROM word WHERE p_partkey % 20 = 0) WHERE trim(q) <> ''),
near AS (SELECT a.query, w.word_key, w.headword, w.source_order, u.unit_order, lower(w.headword) = lower(a.query) AS exact FROM asked a JOIN word w ON starts_with(lower(w.headword), lower(a.query)) JOIN unit u USING (unit_key)),
near2 AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query, exact ORDER BY unit_order, source_order, word_key) AS k FROM near),
bh AS (SELECT query, word_key, CASE WHEN exact THEN 0 ELSE 1 END AS rank, CASE WHEN exact THEN 'headword_exact' ELSE 'headword_prefix' END AS field, headword AS matched_text, '' AS ekey FROM near2 WHERE exact OR (n < 20 AND k <= 50)),
tk AS (SELECT entity_type, entity_key, word_key, text, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS token FROM docs),
aq AS (SELECT query, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')[1:8])) AS q, len(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')[1:8])) AS n FROM asked),
th AS (SELECT aq.query, entity_type, entity_key, word_key, text FROM aq JOIN tk ON starts_with(tk.token, aq.q) GROUP BY aq.query, entity_type, entity_key, word_key, text, aq.n HAVING count(DISTINCT q) = aq.n),
th2 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY entity_key) AS k FROM th),
bt AS (SELECT query, word_key, CASE entity_type WHEN 'sense' THEN 2 WHEN 'phrase' THEN 3 ELSE 4 END AS rank, CASE entity_type WHEN 'sense' THEN 'sense_gloss' ELSE entity_type END AS field, text AS matched_text, entity_key AS ekey FROM th2 WHERE k <= 200),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, word_key ORDER BY rank, ekey) AS b FROM (SELECT * FROM bh UNION ALL SELECT * FROM bt)) WHERE b = 1),
ranked AS (SELECT best.query, best.word_key, w.headword, best.field AS matched_field, matched_text, row_number() OVER (PARTITION BY best.query ORDER BY best.rank, u.unit_order, w.source_order, w.word_key) AS place
  FROM best JOIN word w ON w.word_key = best.word_key JOIN unit u ON u.unit_key = w.unit_key)"""


@_add("C11_search", f"WITH {_SEARCH} SELECT query, CAST(place AS INT) AS place, word_key, headword, matched_field, matched_text FROM ranked WHERE place <= 20")
def dictionary_search(spark, d):
    words = s.word(spark, d).join(s.unit(spark, d), "unit_key")
    return search.search(words, _documents(spark, d), _queries(spark, d))


@_add("J15_word_entries", """SELECT w.word_key, a.t AS senses, b.t AS phrases, c.t AS examples FROM word w
LEFT JOIN (SELECT word_key, string_agg(gloss, '; ' ORDER BY sense_key) AS t FROM sense GROUP BY 1) a USING (word_key)
LEFT JOIN (SELECT word_key, string_agg(text, '; ' ORDER BY phrase_key) AS t FROM phrase GROUP BY 1) b USING (word_key)
LEFT JOIN (SELECT word_key, string_agg(text, '; ' ORDER BY example_key) AS t FROM example GROUP BY 1) c USING (word_key)""")
def word_entries(spark, d):
    rows = releases.word_entries(s.word(spark, d), s.sense(spark, d), s.phrase(spark, d), s.example(spark, d))
    return rows.select("word_key", *[F.array_join(c, "; ").alias(c) for c in ("senses", "phrases", "examples")])


@_add("C25_ownership_findings", """SELECT e.entity_key, e.word_key FROM (SELECT phrase_key AS entity_key, word_key, text FROM phrase UNION ALL SELECT example_key, word_key, text FROM example) e JOIN word w ON w.word_key = e.word_key
WHERE NOT contains(lower(e.text), lower(trim(w.headword)))""")
def ownership_findings(spark, d):
    texts = s.phrase(spark, d).selectExpr("phrase_key AS entity_key", "word_key", "text").unionByName(s.example(spark, d).selectExpr("example_key AS entity_key", "word_key", "text"))
    return releases.ownership_findings(s.word(spark, d), texts, text.phrase_forms(F.col("headword"))).select("entity_key", "word_key")


@_add("ST05_target_spans", """SELECT e.example_key, CASE WHEN contains(lower(e.text), lower(w.headword)) THEN strpos(lower(e.text), lower(w.headword)) - 1 END AS span_start,
CASE WHEN contains(lower(e.text), lower(w.headword)) THEN strpos(lower(e.text), lower(w.headword)) - 1 + length(w.headword) END AS span_end FROM example e JOIN word w ON w.word_key = e.word_key""")
def target_spans(spark, d):
    rows = s.example(spark, d).join(s.word(spark, d).select("word_key", "headword"), "word_key")
    span = text.target_span(F.col("text"), text.phrase_forms(F.col("headword")))
    return rows.select("example_key", span["start"].alias("span_start"), span["end"].alias("span_end"))


@_add("F07_malformed_keys", r"""SELECT word_key FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN '?' || word_key ELSE word_key END AS word_key FROM word)
WHERE NOT (regexp_full_match(word_key, '[0-9a-f]{64}') OR regexp_full_match(word_key, '(w|s|ph|ex|c)\.?[\w.]*\d+[a-z]?'))""")
def malformed_keys(spark, d):
    rows = s.word(spark, d).select(F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("?"), "word_key")).otherwise(F.col("word_key")).alias("word_key"))
    return rows.where(keys.malformed(F.col("word_key")))


@_add("HA01_stable_keys", """SELECT word_key, sha256('{"book":"b1","ordinal":' || CAST(source_order AS VARCHAR) || ',"slug":"' || nfc_normalize(replace(lower(headword), ' ', '-')) || '","type":"word","unit":"' || nfc_normalize(unit_key) || '"}') AS key FROM word""")
def stable_keys(spark, d):
    key = keys.stable_key(F.lit("b1"), F.col("unit_key"), F.lit("word"), F.col("source_order"), text.slug(F.col("headword")))
    return s.word(spark, d).select("word_key", key.alias("key"))


@_add("A15_speech_plan", """SELECT sha256('["tts","m1","v1","' || text || '","1"]') AS cache_key, count(*) AS items, any_value(length(text)) AS chars FROM (SELECT text FROM phrase UNION ALL SELECT text FROM example UNION ALL SELECT headword FROM word) GROUP BY 1""")
def speech_plan(spark, d):
    items = s.phrase(spark, d).select("text").unionByName(s.example(spark, d).select("text")).unionByName(s.word(spark, d).select(F.col("headword").alias("text")))
    key = keys.cache_key("tts", "m1", "v1", F.col("text"), "1")
    return items.groupBy(key.alias("cache_key")).agg(F.count("*").alias("items"), F.first(F.length("text")).cast("long").alias("chars"))


@_add("WN12_source_order", "SELECT word_key, CAST(row_number() OVER (PARTITION BY unit_key ORDER BY headword, word_key) AS INT) AS ordinal FROM word")
def source_order(spark, d):
    from pyspark.sql import Window
    return s.word(spark, d).select("word_key", F.row_number().over(Window.partitionBy("unit_key").orderBy("headword", "word_key")).alias("ordinal"))
