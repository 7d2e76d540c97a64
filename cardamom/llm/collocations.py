"""Phrase collocations from a weighted de Bruijn graph of words.

A node is a run of ``longest - 1`` words, an edge a run of ``longest`` words between the two nodes that it overlaps, weighted
by its occurrences. Edges are all that is counted over the corpus: each word starts one, and at the end of a piece the edge is cut
short. So the occurrences of a shorter phrase are the flow out of the node or prefix that it is, plus the short edges at piece
ends that begin with it; counts of every length follow from the edges by summing prefixes, longest first. Edges are shuffled as lists of next
words by node, which takes less than half the bytes of one row an edge.

Edges of ``min_count`` occurrences and more span the graph that is kept. A node is unary if one edge brings all its flow and
one edge takes it all away; every occurrence then passes both, so a chain of such edges lies in one piece and can't be a
cycle. Chains are compacted by doubling: each edge points at the edge before it in its chain, and pointers are followed to
the first one in rounds that grow with the logarithm of the longest chain. Phrases inside a chain occur as often as its edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, memory_returned, read, small_batches

PIECE_ENDS, GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Characters of text whose lists a task makes at a time, and rows of a batch of them.
CHARS_A_BLOCK, ROWS_A_BATCH = 6_000_000, 5_000
MIN_COUNT, LONGEST, SCALE, COVER_PERCENT, TOP = 10, 3, 1_000_000, 50, 2000


def _words(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def adjacency(parts: pa.Array, texts: pa.Array, longest: int) -> pa.RecordBatch:
    """(part, node, next): what follows each run of ``longest - 1`` words of these texts, every occurrence a word; empty words stand behind a piece's end."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")), pattern=PIECE_ENDS)
    words = pc.split_pattern_regex(pieces.flatten(), pattern=GAPS)
    flat, part = words.flatten(), parts.dictionary_encode()
    real = pc.not_equal(flat, "")
    per_piece = words.value_lengths().to_numpy()
    piece = np.repeat(np.arange(len(per_piece)), per_piece)[real.to_numpy(zero_copy_only=False)]
    part_of_piece = np.repeat(part.indices.to_numpy(), pieces.value_lengths().to_numpy())
    coded = flat.filter(real).dictionary_encode()
    columns = [coded.indices.to_numpy()]
    for j in range(1, longest):
        column = np.full(len(piece), -1, np.int32)
        same = piece[j:] == piece[:-j] if j < len(piece) else np.empty(0, bool)
        column[: len(same)][same] = columns[0][j:][same]
        columns.append(column)
    columns.insert(0, part_of_piece[piece])
    order = np.lexsort(columns[::-1])
    node = [c[order] for c in columns[:-1]]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in node], axis=0)
    starts = np.flatnonzero(new)
    named = lambda codes: coded.dictionary.take(pa.array(codes, mask=codes < 0)).fill_null("")
    blank = pa.scalar(" ", pa.large_string())
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int64()), named(columns[-1][order]))
    names = pc.binary_join_element_wise(*[named(c[starts]) for c in node[1:]], blank)
    return pa.RecordBatch.from_arrays([part.dictionary.take(pa.array(node[0][starts])).cast(pa.string()), names.cast(pa.string()), pc.binary_join(lists, blank).cast(pa.string())], names=["part", "node", "next"])


def phrase_graph(df: DataFrame, part: Column, text: Column, longest: int = LONGEST) -> DataFrame:
    """(part, node, next): the edges of all texts, as lists of next words by node, several rows a node, the rows of a node in one partition.

    Tasks make the lists of ``CHARS_A_BLOCK`` characters of text at a time, so a list is never longer than such a block, and a node's words are
    shuffled once a block instead of once a word. Texts are lower-cased in A-Z. Null and empty texts have no words.
    """
    small_batches(df.sparkSession)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            block, size = [], 0
            for batch in chain(batches, [None]):
                if batch is not None:
                    block.append(batch)
                    size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
                if block and (batch is None or size >= CHARS_A_BLOCK):
                    table = pa.Table.from_batches(block).combine_chunks()
                    found = adjacency(table.column(0).chunk(0), table.column(1).chunk(0), longest) if table.num_rows else None
                    block, size = [], 0
                    for at in range(0, found.num_rows if found else 0, ROWS_A_BATCH):
                        yield found.slice(at, ROWS_A_BATCH)

    rows = df.select(part.cast("string").alias("part"), text.alias("text")).mapInArrow(lists, "part string, node string, next string")
    # Columns that can't be null keep Spark from filtering nulls below the exchange in one place and not in the other, which reads it a second time.
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns]).repartition("part", "node")


def frequent_phrases(graph: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(part, m, w1..wk, n): the phrases of every length with min_count occurrences and more, and the parts' totals as m = 0.

    What flows out of a node is added to each run of words that it begins with; at a piece's end a node is a shorter run itself. Parts of a
    frequent phrase are frequent too, so no count that is asked for later is missing. All counts come from one reading and one shuffle of the texts and are written before they are used.
    """
    k = longest
    nodes = graph.groupBy("part", "node").agg(F.sum(F.size(F.split("next", " "))).alias("n"))
    run = lambda m: F.coalesce(F.substring_index("node", " ", m), F.lit(""))
    begins = [F.struct(F.lit(m).alias("m"), run(m).alias("run"), "n", (~F.endswith(run(m), F.lit(" ")) & ((F.col("n") >= min_count) | F.lit(m < k - 1))).alias("counts")) for m in range(k)]
    runs = nodes.select("part", F.inline(F.array(*begins))).where("counts")
    counts = runs.groupBy("part", "m", "run").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("m") == 0))
    edges = graph.select("part", "node", F.explode(F.split("next", " ")).alias("next")).groupBy("part", "node", "next").agg(F.count("*").alias("n"))
    edges = edges.where((F.col("n") >= min_count) & (F.col("next") != ""))
    every = cut(counts.select("part", "m", "run", "n").unionByName(edges.select("part", F.lit(k).alias("m"), F.concat_ws(" ", "node", "next").alias("run"), "n")))
    words = F.split("run", " ")
    return every.select("part", "m", *[F.when(F.col("m") > i, F.get(words, F.lit(i))).alias(w) for i, w in enumerate(_words(k))], "n")


def _of(phrases: DataFrame, m: int, first: int = 1, count: str = "n") -> DataFrame:
    """Phrases of m words, their words renamed to stand at ``first``, their count to ``count``."""
    return phrases.where(F.col("m") == m).select("part", *[F.col(f"w{i}").alias(f"w{first + i - 1}") for i in range(1, m + 1)], F.col("n").alias(count))


def _with_count(rows: DataFrame, phrases: DataFrame, first: int, last: int, name: str) -> DataFrame:
    """Add the count of the phrase of words ``first`` to ``last`` of each row."""
    return rows.join(_of(phrases, last - first + 1, first, name), ["part", *[f"w{i}" for i in range(first, last + 1)]])


def compact_paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(part, words, n, flow_in, flow_out): the frequent edges, chains through unary nodes compacted to one row.

    ``words`` are a path's words in order, ``n`` the occurrences of each of its edges; ``flow_in`` and ``flow_out`` are those of its first and last node.
    Nodes inside it occur n times. A path is never longer than the longest piece.
    """
    k = longest
    edges = _with_count(_with_count(_of(phrases, k), phrases, 1, k - 1, "flow_in"), phrases, 2, k, "flow_out")
    edges = cut(edges.withColumn("edge", F.concat_ws(" ", *_words(k))))
    node = F.concat_ws(" ", *_words(k)[:-1]), F.concat_ws(" ", *_words(k)[1:])
    # At most one edge brings a node's whole flow, and at most one takes it.
    brings = edges.where("n = flow_out").select("part", node[1].alias("node"), F.col("edge").alias("at"))
    takes = edges.where("n = flow_in").select("part", node[0].alias("node"), "edge")
    links = cut(takes.join(brings, ["part", "node"]).select("part", "edge", "at", F.lit(1).cast("long").alias("steps")))
    while True:
        on = links.select("part", F.col("edge").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        links = cut(links.join(on, ["part", "at"], "left").select(
            "part", "edge", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"),
        ))
        if not links.where("moved").take(1):
            break
        links = links.drop("moved")
    chained = edges.join(links.select("part", "edge", "at", "steps"), ["part", "edge"], "left")
    here = F.struct(F.coalesce("steps", F.lit(0)).alias("steps"), *_words(k), "n", "flow_in", "flow_out")
    paths = chained.groupBy("part", F.coalesce("at", "edge").alias("at")).agg(F.array_sort(F.collect_list(here)).alias("e"))
    first, last = F.element_at("e", 1), F.element_at("e", -1)
    words = F.concat(F.array(*[first[w] for w in _words(k - 1)]), F.transform("e", lambda x: x[f"w{k}"]))
    return paths.select("part", words.alias("words"), first["n"].alias("n"), first["flow_in"].alias("flow_in"), last["flow_out"].alias("flow_out"))


def unfold_paths(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(part, w1..wk, n, flow_in, flow_out, inner) of the paths' edges; ``inner`` if the edge's first node lies inside the path."""
    size = F.size("words") - (longest - 1)
    rows = paths.select("part", "words", "n", "flow_in", "flow_out", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    return rows.select(
        "part", *[F.get("words", F.col("at") + i).alias(w) for i, w in enumerate(_words(longest))], "n", F.when(F.col("at") == 0, F.col("flow_in")).otherwise(F.col("n")).alias("flow_in"),
        F.when(F.col("at") == F.col("size") - 1, F.col("flow_out")).otherwise(F.col("n")).alias("flow_out"), (F.col("at") > 0).alias("inner"),
    )


def _least_cut(m: int) -> Column:
    """The cut with the least score (floored; ties: the first) as struct (score, k, l, r), in whole numbers of up to 38 digits."""
    long = lambda name: f"CAST({name} AS DECIMAL(15, 0))"
    score = lambda k: f"(CAST({SCALE} AS DECIMAL(7, 0)) * ({long('a')} * {long('a')})) DIV ({long(f'l{k}')} * {long(f'r{k}')})"
    return F.array_min(F.array(*[F.struct(F.expr(score(k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]))


def score_phrases(phrases: DataFrame, paths: DataFrame, longest: int = LONGEST, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """(part, phrase, a, l, r, score) of the candidates of 2 to longest words that no longer one covers.

    A longer phrase occurs no more often than a shorter one inside it, so looking at phrases of one word more is enough.
    """
    k = longest
    edges = cut(unfold_paths(paths, k))
    found = []
    for m in range(2, k + 1):
        if m == k:
            rows = edges.withColumnsRenamed({"n": "a", "flow_in": f"l{k - 1}", "flow_out": "r1"}).drop("inner")
        else:
            rows = _of(phrases, m, count="a")
            longer = edges if m == k - 1 else _of(phrases, m + 1)
            if m == k - 1:  # inner nodes occur as often as the edges beside them
                rows = rows.join(edges.where("inner").select("part", *_words(m)), ["part", *_words(m)], "left_anti")
            sides = [longer.select("part", *[F.col(f"w{i + shift}").alias(f"w{i}") for i in range(1, m + 1)], "n") for shift in (0, 1)]
            cover = sides[0].unionByName(sides[1]).groupBy("part", *_words(m)).agg(F.max("n").alias("cover"))
            rows = rows.join(cover, ["part", *_words(m)], "left").where(F.coalesce(F.col("cover"), F.lit(0)) * 100 < F.col("a") * cover_percent)
        for j in range(1, m):
            for name, first, last in ((f"l{j}", 1, j), (f"r{j}", j + 1, m)):
                if name not in rows.columns:
                    rows = _with_count(rows, phrases, first, last, name)
        found.append(rows.withColumn("best", _least_cut(m)).select("part", F.concat_ws(" ", *_words(m)).alias("phrase"), "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, found)


def mine_collocations(df: DataFrame, part: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST,
                      cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): each part's first ``top`` phrases by score, then occurrences, then the phrase's bytes.

    Null parts are ``und``. Null and empty texts add nothing, repeated rows count each time, other columns aren't read; a table without frequent phrases gives no rows.
    Occurrences below 10^15 are exact.
    """
    if not 1 <= cover_percent <= 100 or longest < 2 or min_count < 1:
        raise ValueError("cover_percent from 1 to 100, longest from 2 and min_count from 1 are needed")
    graph = phrase_graph(df, F.coalesce(F.col(part).cast("string"), F.lit("und")), F.col(text), longest)
    phrases = frequent_phrases(graph, min_count, longest)
    scored = score_phrases(phrases, compact_paths(phrases, longest), longest, cover_percent)
    # A part's phrases are ranked in as many groups as the session has shuffle partitions first, so no task sorts all of them.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("part", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*best)
    few = scored.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = phrases.where("m = 0").select("part", F.col("n").alias("total"))
    return ranked.join(totals, "part").select(F.col("part").alias(part), "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
size AS (SELECT unnest([1, 2, 3]) AS m),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS f FROM place JOIN size ON i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
cut AS (SELECT lang, p, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
part AS (SELECT lang, p, a, k, p[:k] AS left_p, p[k + 1:] AS right_p FROM cut),
cuts AS (
  SELECT c.lang, c.p, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM part c JOIN f l ON l.lang = c.lang AND l.p = c.left_p JOIN f r ON r.lang = c.lang AND r.p = c.right_p),
best AS (SELECT lang, p, a, arg_min(struct_pack(l := l, r := r, score := score), [score, k]) AS b FROM cuts GROUP BY ALL),
longer AS (
  SELECT lang, s AS p, max(f) AS f FROM (
    SELECT lang, f, unnest([p[1:2], p[2:3]]) AS s FROM f WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.b.l AS l, b.b.r AS r, b.b.score AS score
  FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.p = b.p WHERE x.f IS NULL OR 100 * x.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM ranked k JOIN total t ON t.lang = k.lang WHERE rank <= 2000
"""
