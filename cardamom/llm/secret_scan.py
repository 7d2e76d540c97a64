"""Secret scan with a trigram inverted index, in DataFrame operations.

From each rule's regular expression the trigrams that every match must hold are derived as a Boolean query (an OR of ANDs, on
lower-cased text). The inverted index lists the documents of each such trigram; intersecting its postings gives
the candidates of a rule, and only they are verified with the expression. Rules without mandatory trigrams scan
all documents.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, fresh, read


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    #: A match counts if this group (0: all of it) has at least so many characters.
    group: int = 0
    least: int = 1
    base: bool = False


# The rules, in the order of their kinds.
RULES = [
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("bearer", r"(?i:bearer) [A-Za-z0-9+/_.=-]{20,}"),
]
#: A query has so many alternatives at most; a larger one is cut to "everything".
MAX_ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of trigrams that all occur (lower-cased) in a text with a match; None if some match needs none."""
    found = {frozenset(t[i : i + 3] for t in runs for i in range(len(t) - 2)) for runs in _runs(parser.parse(pattern))}
    least = {a for a in found if not any(b < a for b in found)}
    return None if frozenset() in least else sorted(least, key=sorted)


def _runs(parsed) -> list[list[str]]:
    """Ways to match, each as runs of literal characters; a gap ends a run."""
    ways: list[list[str]] = [[""]]
    for op, value in parsed:
        if op is ops.LITERAL:
            parts = [[chr(value).lower()]]
        elif op is ops.SUBPATTERN:
            parts = _runs(value[-1])
        elif op is ops.BRANCH:
            parts = [way for branch in value[1] for way in _runs(branch)]
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= 8:
            parts = [[chr(c).lower()] for _, c in value]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] == 1 and value[0] == 0:
            parts = [[""], *_runs(value[2])]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] == value[1] == 1:
            parts = _runs(value[2])
        else:
            parts = [["", ""]]  # a gap
        if len(ways) * len(parts) > MAX_ALTERNATIVES:
            parts = [["", ""]]
        ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in parts]
    return ways


def trigram_index(df: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, id) of the given trigrams over whole lower-cased texts."""
    lowered = df.select(F.col(doc_id).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("_text"), g))
    return lowered.where("id is not null").select("id", F.explode(present).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, kinds): the rules whose query each document meets, by intersecting postings. Documents that meet none have no row."""
    clauses = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("way"), F.lit(len(grams)).alias("size"), F.array(*map(F.lit, sorted(grams))).alias("grams"))
        for kind, ways in queries.items() for k, grams in enumerate(ways)
    ])
    table = postings.sparkSession.range(1).select(F.explode(clauses).alias("_c")).select("_c.kind", "_c.way", "_c.size", F.explode("_c.grams").alias("gram"))
    met = postings.join(F.broadcast(table), "gram").groupBy("id", "kind", "way").agg(F.count_distinct("gram").alias("n"), F.first("size").alias("size"))
    return met.where("n = size").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches, in code points; leftmost and non-overlapping."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # The parts between matches and the matches alternate, so their lengths give the places.
    steps = F.zip_with(F.split(text, rule.pattern, -1), whole, lambda part, m: F.struct(F.length(part).alias("gap"), F.length(m).alias("size")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    placed = F.aggregate(
        F.filter(steps, lambda x: x["size"].isNotNull()), empty,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end")))).alias("out")),
        lambda s: s["out"],
    )
    kept = F.filter(F.arrays_zip(placed.alias("p"), judged.alias("j")), lambda x: F.length(x["j"]) >= rule.least)
    return F.transform(kept, lambda x: F.struct(
        x["p"]["start"].alias("start"), F.lit(order).alias("order"), x["p"]["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan_secrets(df: DataFrame, rules: list[SecretRule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``spans``: array<struct<start, order, end, kind>> of all matches, by start, then rule order.

    Null and empty texts have no spans. Rows without an id are candidates of every rule; rows that share an id share
    their candidate rules, and each is verified on its own text. An empty table stays empty. Whole texts are
    scanned. Spans of different rules may overlap. Other columns are untouched; ``spans`` is replaced.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for ways in queries.values() for way in ways for g in way})
    rows = df.drop("spans")
    candidate, met = fresh(df, "_candidate", "_kinds")
    kinds = F.array().cast("array<string>")
    if grams:
        found = few(cut(candidates(trigram_index(df, grams, doc_id, text), queries).select(F.col("id").alias(candidate), F.col("kinds").alias(met))))
        rows = rows.join(found, rows[doc_id] == found[candidate], "left").drop(candidate)
        kinds = F.coalesce(F.col(met), kinds)
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        tried = whole.rlike(rule.pattern)
        if rule.kind in queries:
            tried = (F.array_contains(kinds, rule.kind) | F.col(doc_id).isNull()) & tried
        parts.append(F.when(tried, spans_of(whole, rule, order)).otherwise(none))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*parts)))
    return rows.drop(met)


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace what the column ``spans`` covers by ``[kind]``; overlapping spans become one, with the first one's kind. Drops ``spans``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh_part = F.concat(s["out"], F.substr(whole, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.when(x["start"] >= s["at"], fresh_part).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substr(whole, s["at"] + 1, F.length(whole))))
    return df.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).drop("spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
