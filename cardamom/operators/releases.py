"""Release data: parity, orphans, capacity, gates, retention, backup inventory and set comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Capacity of a release.
CAPS = {"words": 20_000, "cards": 100_000, "audio": 50_000}
REASONS = ["active", "previous", "session", "introduced", "review", "alias"]


def orphans(pairs: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """pair, orphans: child rows whose parent key is missing, for each named (child, key, parent, key)."""
    parts = [
        child.join(parent.select(F.col(pk).alias("_pk")), child[ck] == F.col("_pk"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("pair"), "orphans")
        for name, (child, ck, parent, pk) in pairs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def counts_by(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, table, n: rows by key in every table."""
    return reduce(DataFrame.unionByName, [df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(t).alias("table"), "n") for t, df in tables.items()])


def capacity(tables: dict[str, DataFrame]) -> DataFrame:
    """metric, n, cap, within."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("metric"), "n", F.lit(CAPS[t]).cast("long").alias("cap")) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("within", F.col("n") <= F.col("cap"))


def count_parity(reported: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, metric, expected, actual where a report's counts and the rows differ."""
    actual = counts_by(tables, key).withColumnRenamed("n", "actual").withColumnRenamed("table", "metric")
    return reported.join(actual, [key, "metric"], "full").fillna(0, ["expected", "actual"]).where("expected <> actual")


def set_diff(required: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of one multiset that the other lacks, marked missing or extra."""
    return required.exceptAll(present).withColumn("side", F.lit("missing")).unionByName(present.exceptAll(required).withColumn("side", F.lit("extra")))


def not_eligible(requested: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """Requested ids that are not eligible."""
    return requested.join(eligible, key, "left_anti")


def previous_release(releases: DataFrame) -> DataFrame:
    """The release that was activated last before the active one; ties go to the smaller id."""
    old = releases.where("status <> 'ACTIVE' AND activated_at IS NOT NULL")
    order = Window.orderBy(F.desc("activated_at"), "release_id")  # the catalogue of releases is small
    return old.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("release_id")


def required_releases(releases: DataFrame, sessions: DataFrame, aliases: DataFrame, progress: DataFrame, reviews: DataFrame, now_ms: int) -> DataFrame:
    """release_id, reasons: why a release must be kept, in the fixed order of reasons.

    progress has introduced_release_id, reviews has presented_release_id; nulls refer to nothing.
    """
    parts = [
        releases.where("status = 'ACTIVE'").select("release_id", F.lit("active").alias("reason")),
        previous_release(releases).select("release_id", F.lit("previous").alias("reason")),
        sessions.where(F.col("expires_at") > now_ms).select("release_id", F.lit("session").alias("reason")).distinct(),
        progress.where("introduced_release_id IS NOT NULL").select(F.col("introduced_release_id").alias("release_id"), F.lit("introduced").alias("reason")).distinct(),
        reviews.where("presented_release_id IS NOT NULL").select(F.col("presented_release_id").alias("release_id"), F.lit("review").alias("reason")).distinct(),
        aliases.select("release_id", F.lit("alias").alias("reason")).distinct(),
    ]
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    rows = reduce(DataFrame.unionByName, parts).withColumn("_r", rank)
    return rows.groupBy("release_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_r", "reason"))), lambda x: x["reason"]), ",").alias("reasons"))


def retention_plan(releases: DataFrame, sessions: DataFrame, progress: DataFrame, reviews: DataFrame, now_ms: int, days: int = 14) -> DataFrame:
    """release_id, eligible, blocked_by: what keeps each release, in fixed order.

    progress has introduced_release_id, reviews has presented_release_id; nulls refer to nothing.
    """
    referring = [
        ("pinned", sessions.where(F.col("expires_at") > now_ms).select("release_id")),
        ("introduced", progress.select(F.col("introduced_release_id").alias("release_id"))),
        ("presented", reviews.select(F.col("presented_release_id").alias("release_id"))),
        ("previous", previous_release(releases).select("release_id")),
    ]
    rows = releases
    for name, ids in referring:
        # As few rows as there are releases, once they are distinct.
        rows = rows.join(ids.where("release_id IS NOT NULL").distinct().withColumn(f"_{name}", F.lit(True)), "release_id", "left")
    # The codes and their order.
    codes = F.array_compact(F.array(
        F.when(F.col("status") != "RETIRED", F.lit("status-not-retired")),
        F.when(F.col("_previous"), F.lit("immediately-previous-rollback-target")),
        F.when(F.col("_pinned"), F.lit("session-pin")),
        F.when(F.col("_introduced"), F.lit("introduced-reference")),
        F.when(F.col("_presented"), F.lit("review-reference")),
        F.when(F.col("activated_at").isNull(), F.lit("never-activated")).when(
            now_ms - F.col("activated_at") < days * 86_400_000, F.lit(f"retention-window-{days}d")),
    ))
    return rows.select("release_id", (F.size(codes) == 0).alias("eligible"), F.array_join(codes, ",").alias("blocked_by"))


def confirm_deletions(requested: DataFrame, plan: DataFrame, sessions: DataFrame, progress: DataFrame, reviews: DataFrame, planned_at: int) -> DataFrame:
    """release_id, code, deletes: what becomes of a request to delete exactly these releases of an earlier ``retention_plan``.

    A release that the plan doesn't let go is NOT_IN_PLAN. The tables are as they are now: one that a session pins (beyond the time of the plan), or that a
    user's word or review has come to refer to since, is PINNED, INTRODUCED or REVIEWED, in this order. ``deletes`` is true for all or for none:
    one refusal refuses the request. Releases are few; references are reduced to distinct ids before they are joined.
    """
    since = [
        ("PINNED", sessions.where(F.col("expires_at") > planned_at).select("release_id")),
        ("INTRODUCED", progress.select(F.col("introduced_release_id").alias("release_id"))),
        ("REVIEWED", reviews.select(F.col("presented_release_id").alias("release_id"))),
    ]
    rows = requested.select("release_id").distinct().join(plan.where("eligible").select("release_id", F.lit(True).alias("_planned")), "release_id", "left")
    code = F.when(F.col("_planned").isNull(), "NOT_IN_PLAN")
    for name, ids in since:
        rows = rows.join(ids.where("release_id IS NOT NULL").distinct().withColumn(f"_{name}", F.lit(True)), "release_id", "left")
        code = code.when(F.col(f"_{name}"), name)
    rows = rows.select("release_id", code.otherwise("OK").alias("code"))
    refused = rows.agg(F.count_if(F.col("code") != "OK").alias("_refused"))
    return rows.join(F.broadcast(refused)).select("release_id", "code", (F.col("_refused") == 0).alias("deletes"))


# From which status a release may become active.
ACTIVATABLE = ("READY", "RETIRED")


def activation_plan(releases: DataFrame, targets: DataFrame, now_ms: int) -> DataFrame:
    """target, code, release_id, before, after, activated_at: every release's status after an attempt to activate each target.

    An unknown target (RELEASE_UNKNOWN) or one that isn't READY or RETIRED (ILLEGAL_TRANSITION) is refused, and then nothing changes. Otherwise it becomes
    ACTIVE and the active one RETIRED. The catalogue of releases is small and goes to each target as one array.
    """
    known = releases.select(F.col("release_id").alias("target"), F.col("status").alias("_status"))
    code = F.when(F.col("_status").isNull(), "RELEASE_UNKNOWN").when(~F.col("_status").isin(*ACTIVATABLE), "ILLEGAL_TRANSITION").otherwise("OK")
    catalogue = releases.agg(F.collect_list(F.struct("release_id", F.col("status").alias("before"), "activated_at")).alias("_all"))
    rows = targets.select("target").distinct().join(known, "target", "left").withColumn("code", code).join(F.broadcast(catalogue)).select("target", "code", F.inline("_all"))
    chosen = F.col("release_id") == F.col("target")
    after = F.when(F.col("code") != "OK", F.col("before")).when(chosen, "ACTIVE").when(F.col("before") == "ACTIVE", "RETIRED").otherwise(F.col("before"))
    return rows.withColumn("after", after).withColumn("activated_at", F.when((F.col("code") == "OK") & chosen, F.lit(now_ms)).otherwise(F.col("activated_at")))


def resolve_release(requests: DataFrame, sessions: DataFrame, releases: DataFrame, now_ms: int) -> DataFrame:
    """The release of each request: its session's if that is the user's own and unexpired, else the active one, with a code."""
    own = sessions.select("session_id", F.col("user_id").alias("_owner"), F.col("release_id").alias("_pinned"), "expires_at")
    active = releases.where("status = 'ACTIVE'").agg(F.min("release_id").alias("_active"))
    rows = requests.join(own, "session_id", "left").join(F.broadcast(active))
    code = F.when(F.col("session_id").isNull(), "ACTIVE").when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "SESSION_UNKNOWN").when(
        F.col("expires_at") <= now_ms, "SESSION_EXPIRED").otherwise("PINNED")
    return rows.withColumn("code", code).select("request_id", "code", F.when(F.col("code") == "PINNED", F.col("_pinned")).otherwise(F.col("_active")).alias("release_id"))


def set_digest(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """group, rows, sum1 to sum4, digest of a keyed multiset, whatever the order of its rows.

    Each row's JSON (names in order, nulls kept, so no two rows are written alike) is hashed to four numbers of 60 bits, which are summed
    exactly. Sums of parts add up to those of the whole, so increments need no second look at what is there; ``merge_digests`` adds them.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("_h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(k)).cast("decimal(38,0)").alias(f"sum{k + 1}") for k in range(4)]
    return _with_digest(df.select(F.col(group), digest.alias("_h")).groupBy(group).agg(F.count("*").alias("rows"), *sums))


def merge_digests(digests: DataFrame, group: str) -> DataFrame:
    """The digests of whole groups from those of their parts, as ``set_digest`` gives them."""
    return _with_digest(digests.groupBy(group).agg(F.sum("rows").alias("rows"), *[F.sum(f"sum{k}").cast("decimal(38,0)").alias(f"sum{k}") for k in range(1, 5)]))


def _with_digest(sums: DataFrame) -> DataFrame:
    return sums.withColumn("digest", F.sha2(F.concat_ws("-", "rows", *[F.col(f"sum{k}").cast("string") for k in range(1, 5)]), 256))


def word_entries(words: DataFrame, senses: DataFrame, phrases: DataFrame, examples: DataFrame) -> DataFrame:
    """One row a word with its senses, phrases and examples as ordered arrays."""
    def nested(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.groupBy("word_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias(name))

    return (
        words.join(nested(senses, "sense_key", "gloss", "senses"), "word_key", "left")
        .join(nested(phrases, "phrase_key", "text", "phrases"), "word_key", "left")
        .join(nested(examples, "example_key", "text", "examples"), "word_key", "left")
    )


def ownership_findings(words: DataFrame, texts: DataFrame, forms: Column) -> DataFrame:
    """Texts (entity_key, word_key, text) in which no form of their word's headword stands."""
    rows = texts.join(words.select("word_key", "headword"), "word_key").withColumn("_forms", forms)
    return rows.where(~F.exists("_forms", lambda f: F.contains(F.lower("text"), f))).drop("_forms")
