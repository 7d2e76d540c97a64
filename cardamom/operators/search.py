"""Ranked dictionary search: exact and prefix headwords, then token prefixes in senses, phrases and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Match fields in rank order.
FIELD_RANK = {"headword_exact": 0, "headword_prefix": 1, "sense_gloss": 2, "phrase": 3, "example": 4}
MAX_TOKENS, DEFAULT_LIMIT, MAX_LIMIT, SCAN_LIMIT = 8, 20, 50, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def query_tokens(query: Column) -> Column:
    """Letter and digit runs of a query, the first eight."""
    return F.slice(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, MAX_TOKENS)


def prefix_match(headword: Column, query: Column) -> Column:
    return F.startswith(ascii_lower(headword), ascii_lower(query))


def search_documents(senses: DataFrame, phrases: DataFrame, examples: DataFrame) -> DataFrame:
    """entity_type, entity_key, word_key, text: one row for each searchable entity."""
    return (
        senses.select(F.lit("sense").alias("entity_type"), F.col("sense_key").alias("entity_key"), "word_key", F.col("gloss").alias("text"))
        .unionByName(phrases.select(F.lit("phrase").alias("entity_type"), F.col("phrase_key").alias("entity_key"), "word_key", "text"))
        .unionByName(examples.select(F.lit("example").alias("entity_type"), F.col("example_key").alias("entity_key"), "word_key", "text"))
    )


def token_table(documents: DataFrame) -> DataFrame:
    """The inverted index: one row a document and distinct token (ASCII-folded)."""
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return documents.select("entity_type", "entity_key", "word_key", "text", F.explode(tokens).alias("token"))


def token_hits(documents: DataFrame, queries: DataFrame, prefix: int = 2) -> DataFrame:
    """query, entity: documents in which every token of the query begins some token; the SCAN_LIMIT smallest keys a query.

    Tokens meet by their first letters, an equality join; the rest is compared after it.
    """
    asked = queries.select("query", query_tokens(ascii_lower(F.col("query"))).alias("_all")).where(F.size("_all") > 0)
    asked = asked.select("query", F.size(F.array_distinct("_all")).alias("_n"), F.explode(F.array_distinct("_all")).alias("_q"))
    index = token_table(documents).withColumn("_short", F.substring("token", 1, prefix))
    long = asked.where(F.length("_q") >= prefix).withColumn("_short", F.substring("_q", 1, prefix))
    hits = index.join(long, "_short").where(F.startswith("token", "_q"))
    one = asked.where(F.length("_q") < prefix)
    hits = hits.drop("_short").unionByName(index.withColumn("_one", F.substring("token", 1, 1)).join(one.withColumnRenamed("_q", "_one"), "_one").withColumn("_q", F.col("_one")).drop("_short", "_one"))
    full = hits.groupBy("query", "entity_type", "entity_key", "word_key", "text", "_n").agg(F.count_distinct("_q").alias("_hit")).where("_hit = _n")
    order = Window.partitionBy("query").orderBy("entity_key")
    return full.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SCAN_LIMIT).drop("_k", "_n", "_hit")


def search(words: DataFrame, documents: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """query, place, word_key, headword, matched_field, matched_text for many queries at once.

    A word's best field counts. Prefixes are tried only if a query has fewer exact hits than the limit.
    """
    limit = min(max(int(limit), 1), MAX_LIMIT)
    asked = queries.select(F.trim("query").alias("query")).where("query <> ''").distinct()
    heads = words.select("word_key", "headword", "unit_order", "source_order").withColumn("_first", F.substring(ascii_lower(F.col("headword")), 1, 1))
    keyed = asked.withColumn("_first", F.substring(ascii_lower(F.col("query")), 1, 1))
    near = heads.join(keyed, "_first").where(prefix_match(F.col("headword"), F.col("query")))
    near = near.withColumn("_exact", ascii_lower(F.col("headword")) == ascii_lower(F.col("query")))
    near = near.withColumn("_n", F.count_if("_exact").over(Window.partitionBy("query")))
    order = Window.partitionBy("query", "_exact").orderBy("unit_order", "source_order", "word_key")
    near = near.withColumn("_k", F.row_number().over(order)).where(F.col("_exact") | ((F.col("_n") < limit) & (F.col("_k") <= MAX_LIMIT)))
    by_head = near.select("query", "word_key", F.when(F.col("_exact"), "headword_exact").otherwise("headword_prefix").alias("field"), F.col("headword").alias("matched_text"), F.lit("").alias("_key"))
    field = F.when(F.col("entity_type") == "sense", "sense_gloss").otherwise(F.col("entity_type"))
    by_token = token_hits(documents, asked).select("query", "word_key", field.alias("field"), F.col("text").alias("matched_text"), F.col("entity_key").alias("_key"))
    rank = F.element_at(F.create_map(*[F.lit(x) for p in FIELD_RANK.items() for x in p]), F.col("field"))
    best = by_head.unionByName(by_token).withColumn("_rank", rank)
    best = best.withColumn("_b", F.row_number().over(Window.partitionBy("query", "word_key").orderBy("_rank", "_key"))).where("_b = 1")
    ranked = best.join(words.select("word_key", "headword", "unit_order", "source_order"), "word_key")
    place = F.row_number().over(Window.partitionBy("query").orderBy("_rank", "unit_order", "source_order", "word_key"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "word_key", "headword", F.col("field").alias("matched_field"), "matched_text")
