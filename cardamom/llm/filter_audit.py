"""Interaction audit of filters by counting paths through the lattice of applied filters.

A state is the set of filters applied so far, an edge adds one filter, and an order of all filters is a path from the empty to the full
state. Rows are reduced to counts by part and failure mask, the only step that sees them. Each mask's counts are then put on every
edge: what the edge's filter removes there, what it would have removed but an earlier one did, and what is left behind it.
Counting paths forward (orders that reach a state) and backward (orders that leave it) gives the number of orders that run
through an edge; the removals of a filter's edges weighted by it are its Shapley sum over all orders. The steps of an order
are the edges of its path.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, LOWER, UPPER, cut, read

#: The lattice has 2^k states and k! orders.
MAX_FILTERS = 7
SYMBOLS = "#$%&*|"


def edges_of(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge) for k filters; a state is a bit mask of the filters applied."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if state >> f & 1:
                backward[state & ~(1 << f)] += backward[state]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def steps_of(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, filter) of every order of the filters."""
    out = []
    for order in permutations(range(len(letters))):
        name, state = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            out.append((name, step, state, f))
            state |= 1 << f
    return out


def count_masks(df: DataFrame, part: Column, conditions: dict[str, Column], marks: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, one count by mark): rows by part and set of failed filters, bit k for the k-th condition.

    A null condition doesn't fail and a null mark doesn't count; a null part is the empty string.
    """
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in (marks or {}).items()]
    return df.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), *counts)


def audit_edges(masks: DataFrame, k: int, marks: list[str]) -> DataFrame:
    """One row a part and edge: state, filter, orders, kept, removed, redundant, unique_fails, <mark>_lost, shapley.

    masks is the table of ``count_masks``, 2^k rows a part at most; every part gets every edge, zeros included.
    """
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges_of(k)])
    on = masks.select("*", F.inline(edges))
    bit = F.expr("shiftleft(1, filter)")
    before = F.col("mask").bitwiseAND(F.col("state")) != 0
    fails = F.col("mask").bitwiseAND(bit) != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    counts = on.groupBy("part", "state", "filter", "orders").agg(
        total(~before & ~fails).alias("kept"), total(~before & fails).alias("removed"), total(before & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), *[total(~before & fails, m).alias(f"{m}_lost") for m in marks],
    )
    return counts.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter")))


def audit_filters(df: DataFrame, part: Column, conditions: dict[str, Column], marks: dict[str, Column] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost..., shapley) of every part, order and step.

    conditions are the filters' failure conditions by their letter, MAX_FILTERS at most; marks are conditions of rows whose loss is
    counted. All are long but ``step``. Every row of df counts, repeated ones and empty texts too; a table without rows has no
    parts. ``shapley`` is the filter's ``removed`` summed over all orders.
    """
    letters, marks = "".join(conditions), marks or {}
    if len(letters) != len(conditions) or not 1 <= len(conditions) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters of one letter each are needed")
    edges = audit_edges(count_masks(df, part, conditions, marks), len(letters), list(marks))
    # k! * k rows, 35,280 at most.
    steps = df.sparkSession.createDataFrame(steps_of(letters), "filter_order string, step int, state int, filter int")
    names = ["kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley"]
    return edges.join(F.broadcast(steps), ["state", "filter"]).select("part", "filter_order", "step", *names)


def with_failures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep and doc_id of df and five failures: A few words, B repeated words, C capitals, D symbols, E the text of a smaller id.

    Null texts are empty. Of rows that share the smallest id of a text none fails E; a null id neither fails it nor makes others fail.
    Texts are read once; what is shuffled and written is a digest and the four other failures by row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = df.select(F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep or []], whole.alias("_whole"))
    own = own.withColumn("_words", F.filter(F.split("_whole", f"[{BLANKS}]+"), lambda w: w != ""))
    n, length = F.size("_words"), F.length("_whole")
    flags = cut(own.select(
        "_id", *[f"_keep_{c}" for c in keep or []], F.unhex(F.sha2(F.col("_whole").cast("binary"), 256)).alias("_digest"),
        (n < 50).alias("A"), (F.size(F.array_distinct("_words")) * 100 < n * 65).alias("B"),
        ((length - F.length(F.translate("_whole", UPPER, ""))) * 100 > length * 5).alias("C"),
        (F.length(F.translate("_whole", SYMBOLS, "")) < length).alias("D"),
    ))
    # Joined on both columns, so the rows of one text don't meet in one task.
    first = flags.groupBy("_digest").agg(F.min("_id").alias("_id")).where("_id IS NOT NULL").withColumn("_first", F.lit(True))
    out = flags.join(first, ["_digest", "_id"], "left").withColumn("E", F.col("_first").isNull() & F.col("_id").isNotNull())
    return out.select(F.col("_id").alias(doc_id), *[F.col(f"_keep_{c}").alias(c) for c in keep or []], *"ABCDE")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_failures(read(spark, sf_dir, "documents"), keep=["source"])
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    return audit_filters(rows, F.col("source"), {f: F.col(f) for f in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")})


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
    (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce((t.doc_id > min(t.doc_id) OVER (PARTITION BY t))::INT, 0) AS e
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
f AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (
  SELECT [p.x, q.x, r.x, s.x, u.x] AS o FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x)
  JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
step AS (SELECT o, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), '') AS filter_order, x AS step, o[x] AS f FROM o CROSS JOIN x),
g AS (SELECT *, len(list_filter(o[:step - 1], lambda k: fails[k] = 1)) > 0 AS gone, fails[f] = 1 AS hit FROM f CROSS JOIN step),
r AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE hit AND list_sum(fails) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
