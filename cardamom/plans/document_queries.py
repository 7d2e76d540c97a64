"""Queries over page lines and positioned blocks, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import boxes, documents
from ..sources import standins as s
from ..sources.standins import with_views

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return query
    return keep


@_add("S12_page_lines", "SELECT doc_id, line, sha256(text) AS digest FROM page_line WHERE trim(text) <> ''")
def page_lines(spark, d):
    return s.page_line(spark, d).where(F.trim("text") != "").select("doc_id", "line", F.sha2("text", 256).alias("digest"))


_BEFORE, _BEHIND = "( |" + "|".join(text.GLUED_BEFORE) + ")", "( |" + "|".join(text.GLUED_BEHIND) + ")"


@_add("ST04_headword_in_text", f"""WITH h AS (SELECT doc_id, line, regexp_extract(text, '[a-z]{{3,}}') AS h FROM page_line),
t AS (
  SELECT doc_id, line, CASE doc_id % 3 WHEN 0 THEN [h] WHEN 1 THEN [h, h || 'ly'] ELSE [h, 'other'] END AS bases,
    CASE line % 5 WHEN 0 THEN 'x the' || h || 'and y' WHEN 1 THEN 'pre' || h || 'zz' WHEN 2 THEN 'X ' || h || 'ing' WHEN 3 THEN left(h, 2) || '-  ' || substr(h, 3) || 's' ELSE h || 'ly from' END AS t
  FROM h WHERE h <> ''),
b AS (SELECT doc_id, line, ' ' || array_to_string(regexp_extract_all(regexp_replace(lower(t), '([a-z])-\\s+([a-z])', '\\1\\2'), '[a-z]+'), ' ') || ' ' AS words, unnest(bases) AS b FROM t),
f AS (
  SELECT doc_id, line, words, unnest([b, b || 's', b || 'es', b || 'ed', b || 'ing'] || CASE WHEN b LIKE '%e' THEN [left(b, -1) || 'ing', b || 'd'] ELSE [] END
    || CASE WHEN b LIKE '%y' THEN [left(b, -1) || 'ies', left(b, -1) || 'ied'] ELSE [] END
    || CASE WHEN regexp_matches(b, '[^aeiou][aeiou][^aeiouwxy]$') THEN [b || right(b, 1) || 'ed', b || right(b, 1) || 'ing'] ELSE [] END) AS f
  FROM b)
SELECT doc_id, line, bool_or(contains(words, f) AND (length(f) >= 5 OR contains(words, ' ' || f || ' ')
  OR regexp_matches(words, '{_BEFORE}' || f || '{_BEHIND}') OR (length(f) >= 4 AND regexp_matches(words, f || '{_BEHIND.replace(" |", "")}')))) AS found
FROM f GROUP BY doc_id, line""")
def headword_in_text(spark, d):
    """A line's first word as a headword with variants, looked for in texts that glue, break, bend or bury it."""
    rows = s.page_line(spark, d).select("doc_id", "line", F.regexp_extract("text", "[a-z]{3,}", 0).alias("h")).where("h <> ''")
    rows = rows.selectExpr(
        "doc_id", "line", "CASE doc_id % 3 WHEN 0 THEN h WHEN 1 THEN concat(h, '(ly)') ELSE concat(h, '/other') END AS head",
        """CASE line % 5 WHEN 0 THEN concat('x the', h, 'and y') WHEN 1 THEN concat('pre', h, 'zz') WHEN 2 THEN concat('X ', h, 'ing')
           WHEN 3 THEN concat(left(h, 2), '-  ', substr(h, 3), 's') ELSE concat(h, 'ly from') END AS t""")
    return rows.select("doc_id", "line", text.text_has_headword(F.col("t"), text.headword_forms(F.col("head"))).alias("found"))


@_add("A13_header_repeats", "SELECT sha256(text) AS line, count(DISTINCT doc_id) AS pages FROM page_line GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def header_repeats(spark, d):
    return documents.header_repeats(s.page_line(spark, d)).where("pages > 1").select(F.sha2("text", 256).alias("line"), "pages")


@_add("C22_furniture", "SELECT doc_id, line, trim(text) = '' OR count(DISTINCT doc_id) OVER (PARTITION BY text) >= 3 AS furniture FROM page_line".replace(
    "count(DISTINCT doc_id) OVER (PARTITION BY text) >= 3", "text IN (SELECT text FROM page_line GROUP BY text HAVING count(DISTINCT doc_id) >= 3)"))
def furniture(spark, d):
    return documents.partition_furniture(s.page_line(spark, d)).select("doc_id", "line", "furniture")


@_add("F08_quality_flags", r"""SELECT doc_id, line, flags FROM (SELECT doc_id, line, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(text, '[\[\](){}]') THEN 'bracket' END,
CASE WHEN regexp_matches(text, '[A-Za-z]{13,}') THEN 'long_run' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'symbol' END) AS flags FROM page_line) WHERE flags <> ''""")
def quality_flags(spark, d):
    return documents.quality_flags(s.page_line(spark, d))


@_add("F11_confidence_gate", "SELECT page, CASE WHEN confidence < 0.5 THEN 'dropped' WHEN confidence < 0.9 THEN 'review' ELSE 'kept' END AS verdict, count(*) AS n FROM text_block GROUP BY 1, 2")
def confidence_gate(spark, d):
    return documents.confidence_gate(s.text_block(spark, d)).groupBy("page", "verdict").agg(F.count("*").alias("n"))


_PAIRS = """pr AS (SELECT a.page, a.block, b.block AS block2, a.text AS t1, b.text AS t2, a.confidence AS c1, b.confidence AS c2,
  (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS inner_area, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_area
  FROM text_block a JOIN text_block b ON a.page = b.page AND a.block < b.block AND a.y0 < b.y1 AND b.y0 < a.y1),
ip AS (SELECT page, block, block2, t1, t2, c1, c2, inner_area / (both_area - inner_area) AS iou FROM pr WHERE inner_area > 0 AND inner_area / (both_area - inner_area) >= 0.5)"""


@_add("J12_iou_pairs", f"WITH {_PAIRS} SELECT page, block, block2, round(iou, 6) AS iou FROM ip")
def iou_pairs(spark, d):
    return documents.iou_pairs(s.text_block(spark, d), 0.5).withColumn("iou", F.round("iou", 6))


@_add("C23_duplicate_boxes", f"WITH {_PAIRS} SELECT DISTINCT page, CASE WHEN c1 >= c2 THEN block2 ELSE block END AS block FROM ip WHERE t1 = t2")
def duplicate_boxes(spark, d):
    return documents.duplicate_boxes(s.text_block(spark, d))


def _tiles(spark, d):
    """Blocks as overlapping tiles give them, by (page + block) % 4: whole; in two parts at the seam, one in eight with the right part a hair higher; whole with a
    narrow piece; three times, each a quarter lower than the last."""
    rows = s.text_block(spark, d).selectExpr("*", "(page + block) % 8 AS m", "CAST(length(text) div 2 AS INT) AS h")
    kinds = [
        ("m % 4 IN (0, 2)", "block * 4", "x0", "x1", "0.0", "text", "confidence"),
        ("m % 4 = 1", "block * 4", "x0", "0.5", "0.0", "substring(text, 1, h + 3)", "confidence"),
        ("m % 4 = 1", "block * 4 + 1", "0.49", "x1", "CASE m WHEN 5 THEN -0.00001 ELSE 0.00001 END", "substring(text, h + 1)", "confidence / 2"),
        ("m % 4 = 2", "block * 4 + 1", "0.12", "0.3", "0.0", "concat('~', substring(text, 2, 9))", "confidence"),
        ("m % 4 = 3", "block * 4", "x0", "x1", "0.0", "text", "confidence"),
        ("m % 4 = 3", "block * 4 + 1", "x0", "x1", "0.0005", "text", "(block * 7 % 10) / 10"),
        ("m % 4 = 3", "block * 4 + 2", "x0", "x1", "0.001", "text", "(block * 3 % 10) / 10")]
    box = "struct({1} AS block, CAST({2} AS DOUBLE) AS x0, y0 + CAST({4} AS DOUBLE) AS y0, CAST({3} AS DOUBLE) AS x1, y1 + CAST({4} AS DOUBLE) AS y1, {5} AS text, CAST({6} AS DOUBLE) AS confidence)"
    made = "array_compact(array(" + ", ".join(f"CASE WHEN {k[0]} THEN {box.format(*k)} END" for k in kinds) + "))"
    return rows.selectExpr("page", f"explode({made}) AS b").select("page", "b.*")


# Part of the pages' text stays out of the comparison of boxes but for its hash; SQL walks each page in order, with the list of what it kept.
_TILES = """src AS (SELECT *, (page + block) % 8 AS m, length(text) // 2 AS h FROM text_block),
tiles AS (SELECT page, block * 4 AS block, x0, y0, x1, y1, text, confidence::DOUBLE AS confidence FROM src WHERE m % 4 IN (0, 2, 3)
  UNION ALL SELECT page, block * 4, x0, y0, 0.5::DOUBLE, y1, substring(text, 1, h + 3), confidence FROM src WHERE m % 4 = 1
  UNION ALL SELECT page, block * 4 + 1, 0.49::DOUBLE, y0 + CASE m WHEN 5 THEN -0.00001::DOUBLE ELSE 0.00001::DOUBLE END, x1, y1 + CASE m WHEN 5 THEN -0.00001::DOUBLE ELSE 0.00001::DOUBLE END, substring(text, h + 1), confidence / 2 FROM src WHERE m % 4 = 1
  UNION ALL SELECT page, block * 4 + 1, 0.12::DOUBLE, y0, 0.3::DOUBLE, y1, '~' || substring(text, 2, 9), confidence FROM src WHERE m % 4 = 2
  UNION ALL SELECT page, block * 4 + 1, x0, y0 + 0.0005::DOUBLE, x1, y1 + 0.0005::DOUBLE, text, (block * 7 % 10) / 10 FROM src WHERE m % 4 = 3
  UNION ALL SELECT page, block * 4 + 2, x0, y0 + 0.001::DOUBLE, x1, y1 + 0.001::DOUBLE, text, (block * 3 % 10) / 10 FROM src WHERE m % 4 = 3)"""


@_add("C23_tile_duplicates", f"""WITH RECURSIVE {_TILES},
o AS (SELECT *, sha256(text) AS t, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, text, block) AS k FROM tiles),
walk AS (SELECT page, 0::BIGINT AS k, []::STRUCT(block BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, t VARCHAR)[] AS kept FROM (SELECT DISTINCT page FROM tiles)
  UNION ALL SELECT w.page, o.k, CASE WHEN len(list_filter(list_transform(w.kept, lambda p: struct_pack(
      same := p.t = o.t, part := greatest(least(p.x1, o.x1) - greatest(p.x0, o.x0), 0) * greatest(least(p.y1, o.y1) - greatest(p.y0, o.y0), 0), total := (p.x1 - p.x0) * (p.y1 - p.y0) + (o.x1 - o.x0) * (o.y1 - o.y0))),
      lambda q: q.part / (q.total - q.part) >= 0.8 OR q.same AND q.part / (q.total - q.part) >= 0.45)) > 0 THEN w.kept
    ELSE list_append(w.kept, struct_pack(block := o.block, x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1, t := o.t)) END
  FROM walk w JOIN o ON o.page = w.page AND o.k = w.k + 1)
SELECT page, unnest(kept).block AS block FROM (SELECT page, arg_max(kept, k) AS kept FROM walk GROUP BY page)""")
def tile_duplicates(spark, d):
    return boxes.drop_tile_duplicates(_tiles(spark, d), 500).select("page", "block")


@_add("C23_seam_matches", f"""WITH RECURSIVE {_TILES},
c AS (SELECT l.page, l.block, l.y0, l.x0, r.block AS right_block, (r.y0, r.x0, r.block) < (l.y0, l.x0, l.block) AS earlier, row_number() OVER (PARTITION BY l.page, l.block ORDER BY abs(r.x0 - l.x1), r.y0, r.x0, r.block) AS n
  FROM tiles l JOIN tiles r ON r.page = l.page AND r.block <> l.block AND l.x0 < 0.475 AND l.x1 BETWEEN 0.475 AND 0.55 AND r.x0 BETWEEN 0.45 AND 0.525 AND r.x1 > 0.525 AND r.x0 - l.x1 BETWEEN -0.10 AND 0.015
    AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 0 AND (least(l.y1, r.y1) - greatest(l.y0, r.y0)) / least(l.y1 - l.y0, r.y1 - r.y0) >= 0.65),
o AS (SELECT page, block, list(struct_pack(r := right_block, e := earlier) ORDER BY n) AS can, row_number() OVER (PARTITION BY page ORDER BY y0, x0, block) AS k FROM c GROUP BY page, block, y0, x0),
walk AS (SELECT page, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS block, NULL::STRUCT(r BIGINT, e BOOLEAN) AS got FROM (SELECT DISTINCT page FROM o)
  UNION ALL SELECT page, k, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.r) END, block, got
  FROM (SELECT w.page, o.k, w.used, o.block, CASE WHEN NOT list_contains(w.used, o.block) THEN list_filter(o.can, lambda x: NOT list_contains(w.used, x.r))[1] END AS got FROM walk w JOIN o ON o.page = w.page AND o.k = w.k + 1))
SELECT page, block, got.r AS right_block, got.e AS earlier FROM walk WHERE got IS NOT NULL""")
def seam_matches(spark, d):
    return boxes.seam_matches(_tiles(spark, d), 500).withColumnRenamed("right", "right_block")


@_add("C23_clean_boxes")
def clean_boxes(spark, d):
    return boxes.clean_boxes(_tiles(spark, d), 500).withColumn("text", F.sha2("text", 256))


@_add("J11_lines_in_regions", """SELECT page, block FROM text_block l WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id AS page, 0.05::DOUBLE AS x0, 0.02::DOUBLE AS y0, 0.95::DOUBLE AS x1, 0.06::DOUBLE AS y1 FROM documents) r
WHERE r.page = l.page AND l.x0 >= r.x0 - 0.005 AND l.x1 <= r.x1 + 0.005 AND l.y0 >= r.y0 - 0.005 AND l.y1 <= r.y1 + 0.005)""")
def lines_in_regions(spark, d):
    blocks = s.text_block(spark, d)
    regions = blocks.select("page").distinct().select("page", *[F.lit(v).alias(c) for c, v in (("x0", 0.05), ("y0", 0.02), ("x1", 0.95), ("y1", 0.06))])
    return documents.lines_in_regions(blocks, regions).select("page", "block")


_SIG = """sig AS (SELECT doc_id // 20 AS book, doc_id AS page, CASE WHEN length(text) % 3 <> 0 THEN length(text) // 50 END AS signal FROM page_line WHERE line = 1),
rn AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY page) AS run FROM (SELECT *, CASE WHEN signal IS NOT DISTINCT FROM lag(signal) OVER (PARTITION BY book ORDER BY page) THEN 0 ELSE 1 END AS new FROM sig WHERE signal IS NOT NULL)),
runs AS (SELECT book, CAST(run AS BIGINT) AS run, signal, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM rn GROUP BY 1, 2, 3)"""


def _signals(spark, d):
    return documents.page_signals(s.page_line(spark, d))


@_add("WN06_signal_runs", f"WITH {_SIG} SELECT * FROM runs")
def signal_runs(spark, d):
    return documents.signal_runs(_signals(spark, d))


@_add("WN07_smooth_runs", f"""WITH {_SIG} SELECT book, run, signal, CASE WHEN pages = 1 AND lag(signal) OVER w = lead(signal) OVER w THEN lag(signal) OVER w ELSE signal END AS smoothed FROM runs WINDOW w AS (PARTITION BY book ORDER BY run)""")
def smooth_runs(spark, d):
    return documents.smooth_runs(signal_runs(spark, d)).select("book", "run", "signal", "smoothed")


@_add("WN08_chapter_fill", f"WITH {_SIG} SELECT book, page, last_value(signal IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS chapter FROM sig")
def chapter_fill(spark, d):
    return documents.chapter_fill(_signals(spark, d)).select("book", "page", "chapter")


@_add("J17_nearest_signal", f"""WITH {_SIG} SELECT s.book, s.page, (SELECT arg_min(t.signal, abs(t.page - s.page) * 2 + CASE WHEN t.page > s.page THEN 1 ELSE 0 END) FROM sig t WHERE t.book = s.book AND t.signal IS NOT NULL) AS nearest FROM sig s""")
def nearest_signal(spark, d):
    return documents.nearest_signal(_signals(spark, d)).select("book", "page", "nearest")


@_add("WN13_attach_lines", "SELECT doc_id, line, last_value(CASE WHEN length(text) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS header_line FROM page_line")
def attach_lines(spark, d):
    return documents.attach_lines(s.page_line(spark, d), F.length("text") < 40).select("doc_id", "line", "header_line")


@_add("WN09_contiguity_errors", "SELECT doc_id AS page, line AS number, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line), 0) + 1 AS expected FROM page_line WHERE length(text) % 5 <> 0 QUALIFY line <> expected")
def contiguity_errors(spark, d):
    openers = s.page_line(spark, d).where("length(text) % 5 <> 0").selectExpr("doc_id AS group", "line AS place", "line AS number")
    return documents.contiguity_errors(openers).selectExpr("group AS page", "number", "expected")


@_add("X08_replace_pages", """WITH new AS (SELECT page, block, 'new' AS origin FROM text_block WHERE page % 4 = 0 AND block % 3 = 0)
SELECT page, block, 'old' AS origin FROM text_block WHERE page NOT IN (SELECT page FROM new) UNION ALL SELECT * FROM new""")
def replace_pages(spark, d):
    blocks = s.text_block(spark, d).select("page", "block")
    return documents.replace_pages(blocks.withColumn("origin", F.lit("old")), blocks.where("page % 4 = 0 AND block % 3 = 0").withColumn("origin", F.lit("new")))


@_add("ST08_close_spelling", """WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT a.w AS a, b.w AS b FROM v a JOIN v b ON a.w < b.w AND substring(a.w, 1, 1) = substring(b.w, 1, 1) AND levenshtein(a.w, b.w) <= CASE WHEN least(length(a.w), length(b.w)) >= 6 THEN 2 ELSE 1 END""")
def close_spelling(spark, d):
    v = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("a")).distinct().withColumn("f", F.substring("a", 1, 1))
    return v.join(v.withColumnRenamed("a", "b"), "f").where((F.col("a") < F.col("b")) & text.close_spelling(F.col("a"), F.col("b"))).select("a", "b")


@_add("ST02_join_hyphenated", r"SELECT doc_id, sha256(replace(regexp_replace(text, '-\n([a-zà-öø-ÿ])', '\1', 'g'), chr(10), ' ')) AS digest FROM documents")
def join_hyphenated(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(text.join_hyphenated(F.col("text")), 256).alias("digest"))
