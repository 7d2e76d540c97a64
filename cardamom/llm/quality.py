"""Quality rules with risk-controlled thresholds, in DataFrame operations.

Each rule rejects texts whose feature lies beyond a cutoff. Cutoffs are chosen by stratum on a labelled holdout: for
every (stratum, rule, candidate cutoff) the good documents that it would reject are counted, and the cutoff is valid if the
exact binomial (Clopper-Pearson) upper bound of its false-rejection rate is at most ``alpha`` divided by the number of
rules. The confidence ``delta`` is divided by the number of all (stratum, rule, candidate) tests (Bonferroni), so with
probability 1 - delta no stratum loses more than alpha of its good documents to all rules together. Of the valid cutoffs the strictest is taken; a rule
without a valid cutoff is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, fresh, read

SYMBOLS = "#*$%&|<>"
#: feature -> candidate cutoffs; a rule rejects feature > cutoff.
RULES = {
    "symbol_ratio": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "mean_word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}
ALPHA, DELTA = 0.05, 0.05
WINDOW = 8


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the rule features (double).

    Null and empty texts have no words and zeros throughout.
    """
    words, hashes, windows, starts, n_lines = fresh(df, "_words", "_hashes", "_windows", "_starts", "_n_lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, F.filter(F.split(whole, f"[{BLANKS}]+"), lambda w: w != ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_lines: F.size(lines),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(words)
    none = F.array().cast("array<bigint>")
    n = F.size(hashes)
    df = df.withColumn(windows, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(none)).drop(hashes)
    # Windows found twice or more, by sorting (window, place) in the few texts that have any.
    sorted_ = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(starts, F.when(F.size(F.array_distinct(windows)) < F.size(windows), sorted_)).drop(windows)
    s = F.col(starts)
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    df = df.withColumn(starts, F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    gaps = F.transform(s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).cast("long")).drop(starts)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.withColumns({
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", n_lines),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word_length": ratio("word_chars", "n_words"),
    }).drop(n_lines)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly term by term in logarithms; 1 for k >= n p (not needed beyond)."""
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high = F.greatest(term, state["sum"])
        return F.struct(term.alias("term"), (high + F.log(F.exp(term - high) + F.exp(state["sum"] - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add)["sum"]))


def choose_cutoffs(labelled: DataFrame, stratum: str, label: str = "quality", rules: dict[str, list[float]] | None = None,
                   alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected) of the strictest valid cutoff by stratum and rule.

    labelled has the features, the stratum and a 0/1 label (1 is good). Rows with a null label are left out; a null stratum is one of its own.
    """
    rules = RULES if rules is None else rules
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff")) for r, cs in rules.items() for c in cs])
    good = labelled.where(F.col(label) == 1)
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n_good"),
        F.array(*[F.count_if(F.col(r) > c) for r, cs in rules.items() for c in cs]).alias("_rejected"),
    )
    tests = counts.select("stratum", "n_good", F.posexplode(F.arrays_zip(pairs.alias("pair"), F.col("_rejected").alias("rejected"))).alias("_k", "_x"))
    tests = tests.select("stratum", "n_good", "_x.pair.rule", "_x.pair.cutoff", F.col("_x.rejected").alias("n_rejected"))
    # Clopper-Pearson: the upper bound is at most a exactly if P(Bin(n, a) <= k) is at most the test's share of delta.
    tail = binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha / len(rules))
    n_tests = max(1, counts.count() * sum(map(len, rules.values())))
    valid = tests.where(tail <= delta / n_tests)
    best = valid.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("_b"))
    return best.select("stratum", "rule", "_b.*")


def apply_cutoffs(df: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add ``failed_rules`` (sorted array) and ``kept``: no base rule and no rule of the row's stratum fails.

    The cutoffs table has one row a stratum and rule; its strata are as few as the labelled holdout's. Strata without cutoffs fail no rule but the base.
    """
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    rows = df.join(by_stratum, df[stratum].eqNullSafe(by_stratum["stratum"]), "left").drop(by_stratum["stratum"])
    failed = F.array_compact(F.array(*[
        F.when(F.col(rule) > F.element_at("_cutoffs", rule), F.lit(rule)) for rule in sorted(RULES)
    ]))
    rows = rows.withColumn("failed_rules", failed).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cutoffs")


def quality_rules(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Features, failed rules and verdict of every row of df; cutoffs from the rows that labels judges.

    Null and empty texts fail the base rule of 20 words. Repeated rows get equal results. Equal texts with equal labels in a
    stratum count once for the cutoffs, as copies are no further draws for the bounds. An empty table gives an empty result; without labels only the base rules hold. Only id, text and stratum of df are used and
    returned beside the results.
    """
    rows = df.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text), F.col(stratum).alias(stratum))
    judged = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).where("_id is not null")
    names = fresh(rows, "_text1", "_text2")
    rows = rows.withColumns({names[0]: F.xxhash64(text), names[1]: F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    features = cut(with_features(rows, text).drop(text))
    holdout = features.join(judged, F.col(doc_id) == F.col("_id")).dropDuplicates([stratum, "_quality", *names])
    features = features.drop(*names)
    return apply_cutoffs(features, choose_cutoffs(holdout, stratum, "_quality"), stratum)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
