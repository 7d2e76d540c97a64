"""Key aliases between releases: walks, roots, checks and release-to-release continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import normal_form

MAX_DEPTH = 64


def alias_walk(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """key, reached, depth: every key that each edge end leads to, by joins that double the covered depth.

    Keys on a cycle stop at max_depth.
    """
    step = edges.select(F.col("from_key").alias("key"), F.col("to_key").alias("reached")).distinct().withColumn("depth", F.lit(1))
    walk, span = cut(step), 1
    while span < max_depth:
        # walk holds all paths of length 1 to span; one more step table of length span doubles it.
        longest = walk.where(F.col("depth") == span).select(F.col("key").alias("reached"), F.col("reached").alias("_far"))
        if longest.isEmpty():
            break
        further = walk.join(longest, "reached").select("key", F.col("_far").alias("reached"), (F.col("depth") + span).alias("depth"))
        walk = cut(walk.unionByName(further).distinct())
        span *= 2
    return walk.where(F.col("depth") <= max_depth)


def resolve_aliases(edges: DataFrame) -> DataFrame:
    """key, root, declared, code: where each key's chain ends, the canonical key its edge declares, and what is wrong with it, if anything.

    AMBIGUOUS: a key has several successors; CYCLE: the chain doesn't end; ROOT_MISMATCH: it ends elsewhere than declared.
    """
    walk = alias_walk(edges)
    starts = edges.select(F.col("from_key").alias("key")).distinct()
    ends = walk.join(starts.withColumnRenamed("key", "reached"), "reached", "left_anti").groupBy("key").agg(F.min("reached").alias("root"))
    own = edges.groupBy(F.col("from_key").alias("key")).agg(F.count_distinct("to_key").alias("_next"), F.min("canonical_key").alias("declared"))
    code = F.when(F.col("_next") > 1, "AMBIGUOUS").when(F.col("root").isNull(), "CYCLE").when(F.col("root") != F.col("declared"), "ROOT_MISMATCH")
    return own.join(ends, "key", "left").select("key", "root", "declared", code.alias("code"))


def canonicalize(df: DataFrame, key: str, canonical: DataFrame) -> DataFrame:
    """Add ``canonical_key``: the root of the key, or the key itself where none is known."""
    roots = canonical.select(F.col("key").alias("_key"), F.col("root").alias("_root"))
    return df.join(roots, df[key] == roots["_key"], "left").withColumn("canonical_key", F.coalesce("_root", key)).drop("_key", "_root")


def edge_errors(edges: DataFrame) -> DataFrame:
    """code, key, n: what is wrong with an edge set, by code."""
    named = edges.select("release_id", "from_key", "to_key", "canonical_key")
    parts = [
        named.where("from_key IS NULL OR to_key IS NULL OR canonical_key IS NULL OR from_key = '' OR to_key = ''").select(F.lit("EDGE_INVALID").alias("code"), F.col("from_key").alias("key")),
        named.where("from_key = to_key").select(F.lit("SELF_REFERENCE").alias("code"), F.col("from_key").alias("key")),
        named.groupBy("release_id", "from_key", "to_key").count().where("count > 1").select(F.lit("DUPLICATE_EDGE").alias("code"), F.col("from_key").alias("key")),
        named.groupBy("from_key").agg(F.count_distinct("to_key").alias("n")).where("n > 1").select(F.lit("ONE_TO_MANY").alias("code"), F.col("from_key").alias("key")),
        named.groupBy("to_key").agg(F.count_distinct("from_key").alias("n")).where("n > 1").select(F.lit("MANY_TO_ONE").alias("code"), F.col("to_key").alias("key")),
        resolve_aliases(edges).where("code IN ('CYCLE', 'ROOT_MISMATCH')").select(F.when(F.col("code") == "CYCLE", "CYCLE").otherwise("CANONICAL_MISMATCH").alias("code"), "key"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("code", "key").agg(F.count("*").alias("n"))


def missing_ends(edges: DataFrame, words: DataFrame) -> DataFrame:
    """Edge ends that the word table lacks."""
    ends = edges.select(F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
    return ends.join(words.select(F.col("word_key").alias("key")), "key", "left_anti")


def state_conflicts(progress: DataFrame, canonical: DataFrame) -> DataFrame:
    """User rows stored under a key that is not its own root."""
    roots = canonical.where("key <> root").select(F.col("key").alias("word_key"), "root")
    return progress.join(roots, "word_key")


def edge_union(stored: DataFrame, declared: DataFrame) -> DataFrame:
    """Stored edges, superseded ones replaced by the declared edges with the same release and keys."""
    return stored.join(declared, ["release_id", "from_key", "to_key"], "left_anti").unionByName(declared)


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_DEPTH) -> DataFrame:
    """All keys that the seeds (column key) reach over edges in either direction."""
    both = edges.select(F.col("from_key").alias("key"), F.col("to_key").alias("_other")).union(edges.select("to_key", "from_key"))
    found, new = seeds.select("key").distinct(), seeds.select("key").distinct()
    for _ in range(max_rounds):
        new = cut(both.join(new, "key", "left_semi").select(F.col("_other").alias("key")).distinct().join(found, "key", "left_anti"))
        if new.isEmpty():
            break
        found = cut(found.union(new))
    return found


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_continuity(old: DataFrame, new: DataFrame) -> DataFrame:
    """unit_key, head, old_key, new_key, kind of the words of two snapshots, matched on unit and folded headword if both sides have it once.

    kind: preserved, aliased, added, removed. Ambiguous identities match nothing and count as added and removed.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("unit_key", F.lower(F.trim(normal_form("NFKC")("headword"))).alias("head"), F.col("word_key").alias(name))
        n = F.count("*").over(Window.partitionBy("unit_key", "head"))
        return rows.withColumn("_id", F.when(n == 1, "").otherwise(F.concat(F.lit(name), F.col(name))))

    both = side(old, "old_key").join(side(new, "new_key"), ["unit_key", "head", "_id"], "full").drop("_id")
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(
        F.col("old_key") == F.col("new_key"), "preserved").otherwise("aliased")
    return both.withColumn("kind", kind)
