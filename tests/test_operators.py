"""Small cases of operators and helpers."""

from pyspark.sql import functions as F

from cardamom.functions import text
from cardamom.operators import aliases, documents, releases, review, scheduling
from cardamom.streaming import reviews


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_text_helpers(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="ＡＢ１ x　 y ") == "AB1 x y"
    assert one(spark, text.join_hyphenated(F.col("t")), t="inter-\nnal co-\nOp a\nb") == "internal co- Op a b"
    assert {"carries", "carried", "carrying"} <= set(one(spark, text.headword_forms(F.col("t")), t="carry"))
    assert tuple(one(spark, text.target_span(F.col("t"), text.headword_forms(F.col("h"))), t="He stopped it", h="stop")) == (3, 10)
    assert tuple(one(spark, text.split_en_zh(F.col("t")), t="a hall 大厅 x")) == ("a hall", "大厅 x")
    assert [tuple(x) for x in one(spark, text.split_pos_gloss(F.col("t")), t="n. hall v. to enter")] == [("n", "hall"), ("v", "to enter")]
    assert one(spark, text.close_spelling(F.col("a"), F.col("b")), a="recieve", b="receive") and not one(spark, text.close_spelling(F.col("a"), F.col("b")), a="cat", b="cut off")
    assert one(spark, text.is_additive_space(F.col("a"), F.col("b")), a="oneword", b="one word")
    assert one(spark, text.slug(F.col("t")), t="Été à Paris!") == "ete-a-paris"
    assert one(spark, text.target_ordinal(F.col("t")), t="s.w1.12") == 12 and one(spark, text.target_ordinal(F.col("t")), t="abc") is None
    assert tuple(one(spark, text.field_path(F.col("t")), t="explanations[3].note")) == (3, "note")
    assert one(spark, text.digit_candidates(F.col("n")), n=19) == [19, 91, 61]
    assert one(spark, text.similarity_ratio(F.col("a"), F.col("b")), a="abcd", b="abce") == 0.75


def test_headwords_in_texts(spark):
    def forms(head):
        return set(one(spark, text.headword_forms(F.col("h")), h=head))

    assert forms("carry") == {"carry", "carrys", "carryes", "carryed", "carrying", "carries", "carried"}
    assert {"stopped", "stopping"} <= forms("stop") and "showwed" not in forms("show") and {"moving", "moved"} <= forms("move")
    assert {"bore", "born", "borne"} <= forms("Bear") and {"hypotheses"} <= forms("hypothesis")
    assert {"organise", "organize"} <= forms("organise/-ize") and {"colour", "color", "colors"} <= forms("colo(u)r") and forms("-x") >= {"x"}

    def stands(head, *texts):
        df = spark.createDataFrame([(head, t) for t in texts], "h string, t string")
        return [r.x for r in df.select(text.text_has_headword(F.col("t"), text.headword_forms(F.col("h"))).alias("x")).collect()]

    assert stands("art", "The ART of", "theartof it", "a party", "smart", "art's place", "") == [True, True, False, False, True, False]
    assert stands("cost", "administrativecosts", "costis high", "Accost", "theco-\nst of") == [True, True, False, True]
    assert stands("rate", "corporate", "rateof", "the rate") == [False, True, True]
    assert stands("admin", "administrativecosts", None) == [True, None] and stands("it", "with", "do it") == [False, True]


def test_empty_and_null_edges(spark):
    edges = spark.createDataFrame([], "release_id string, from_key string, to_key string, canonical_key string")
    assert aliases.resolve_aliases(edges).count() == 0 and aliases.edge_errors(edges).count() == 0
    bad = spark.createDataFrame([("r", "a", "a", "a"), ("r", None, "b", "b")], edges.schema)
    assert {"EDGE_INVALID", "SELF_REFERENCE", "CYCLE"} <= {r.code for r in aliases.edge_errors(bad).collect()}


def test_long_chains_resolve(spark):
    rows = [("r", f"k{i:02}", f"k{i + 1:02}", "k40") for i in range(40)]
    edges = spark.createDataFrame(rows, "release_id string, from_key string, to_key string, canonical_key string")
    found = aliases.resolve_aliases(edges).collect()
    assert len(found) == 40 and all(r.root == "k40" and r.code is None for r in found)


def test_digest_ignores_order(spark):
    rows = [("g", str(i), i % 7) for i in range(500)]
    a = spark.createDataFrame(rows, "g string, k string, n int")
    b = spark.createDataFrame(rows[::-1], "g string, k string, n int").repartition(3)
    whole = releases.set_digest(a, ["k", "n"], "g").collect()
    assert whole == releases.set_digest(b, ["k", "n"], "g").collect()
    parts = [releases.set_digest(a.where(f"n % 2 = {k}"), ["k", "n"], "g") for k in range(2)]
    assert releases.merge_digests(parts[0].unionByName(parts[1]), "g").collect() == whole
    again = releases.set_digest(a.unionByName(a.limit(1)), ["k", "n"], "g").head()
    assert again.rows == 501 and again.digest != whole[0].digest


def test_digest_tells_rows_apart(spark):
    sets = [("a|b", "c", None), ("a", "b|c", None), ("a|b|c", None, None), ("a", "b", "c"), ('a","b', None, None), (None, None, None), ("", None, None)]
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(sets)], "g string, x string, y string, z string")
    assert len({r.digest for r in releases.set_digest(df, ["x", "y", "z"], "g").collect()}) == len(sets)


def test_activation_needs_a_legal_target(spark):
    states = [("a", "ACTIVE"), ("b", "READY"), ("c", "RETIRED"), ("d", "IMPORTING"), ("e", "FAILED")]
    df = spark.createDataFrame([(r, st, None) for r, st in states], "release_id string, status string, activated_at long")
    targets = spark.createDataFrame([(t,) for t in "abcdef"] + [("b",)], "target string")
    found = {}
    for r in releases.activation_plan(df, targets, 7).collect():
        found.setdefault((r.target, r.code), {})[r.release_id] = (r.after, r.activated_at)
    unchanged = {r: (st, None) for r, st in states}
    assert found[("a", "ILLEGAL_TRANSITION")] == found[("d", "ILLEGAL_TRANSITION")] == found[("e", "ILLEGAL_TRANSITION")] == found[("f", "RELEASE_UNKNOWN")] == unchanged
    for target in "bc":
        assert found[(target, "OK")] == unchanged | {"a": ("RETIRED", None), target: ("ACTIVE", 7)}
    assert len(found) == 6


def test_nearest_signal_takes_the_earlier_of_two(spark):
    df = spark.createDataFrame([(0, 1, 7), (0, 2, None), (0, 3, 9), (0, 4, None), (1, 1, None)], "book int, page int, signal int")
    found = {(r.book, r.page): r.nearest for r in documents.nearest_signal(df).collect()}
    assert found == {(0, 1): 7, (0, 2): 7, (0, 3): 9, (0, 4): 9, (1, 1): None}


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    schema = "event_id long, ingest_seq long, user_id long, content_card_key string, rating int, reviewed_at long"
    rows = [(i, 2 * i, i % 3, f"c{i % 4}", 1 + i % 4, 1_700_000_000_000 + i * 40_000_000) for i in range(40)]
    for k in range(2):
        part = rows[20 * k : 20 * k + 20] + ([rows[3][:1] + (99,) + rows[3][2:]] if k else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = {"log": None, "states": {}}

    def write_log(df):
        new = df.collect()
        old = kept["log"].collect() if kept["log"] is not None else []
        kept["log"] = spark.createDataFrame(old + new, df.schema)

    def write_states(df):
        kept["states"].update({(r.user_id, r.content_card_key): r for r in df.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    step = reviews.fold_into_table(lambda: kept["log"], write_log, write_states)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = scheduling.fold_reviews(scheduling.dedupe_events(spark.createDataFrame(rows, schema))).collect()
    assert {(r.user_id, r.content_card_key): r for r in batch} == kept["states"]


def test_stream_dedupes(spark, tmp_path):
    schema = "event_id long, user_id long, reviewed_at long"
    rows = [(i % 10, 1, 1_700_000_000_000 + i) for i in range(30)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reviews.dedupe_events_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").count() == 10


def test_ratio_reaches_is_the_ratio():
    import difflib
    import random

    from cardamom.functions import text

    r = random.Random(3)
    for k in range(600):
        a = "".join(r.choice("abcd ") for _ in range(r.randrange(60)))
        b = [a[1:], a[::-1], a.upper(), "".join(c for c in a if r.random() > 0.2), "".join(r.sample(a, len(a)))][k % 5]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert not b or text._longest_match(a, b)[2] == 0 or text._longest_match(a, b) == tuple(want.find_longest_match(0, len(a), 0, len(b)))
        for threshold in (0.3, 0.5, 0.82, 0.95, 1.0, want.ratio()):
            assert text.ratio_reaches(a, b, threshold) == (want.ratio() >= threshold)


def test_consensus_of_every_line(spark):
    from cardamom.plans import review_queries

    lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("explode(split(text, '\n')) AS line").where("line <> ''").count()
    assert review_queries.consensus(spark, "/root/testdata/sf0.001").count() == lines


def test_text_block_has_all_lines(spark, tmp_path):
    from cardamom.sources import standins

    spark.createDataFrame([(1, "\n".join(["line"] * 906))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = [r.block for r in standins.text_block(spark, str(tmp_path)).select("block").collect()]
    assert sorted(blocks) == sorted([2 * k for k in range(1, 907)] + [2 * k + 1 for k in range(10, 907, 10)])


def test_stable_key_vector(spark):
    from pyspark.sql import functions as F

    from cardamom.functions import keys

    row = spark.range(1).select(keys.stable_key(F.lit("llcy-2024"), F.lit("u01"), F.lit("word"), F.lit(3), F.lit("abandon")).alias("k"),
                                keys.stable_key(F.lit("b"), F.lit("u"), F.lit("word"), F.lit(1), F.lit("caf\u00e9")).alias("a"),
                                keys.stable_key(F.lit("b"), F.lit("u"), F.lit("word"), F.lit(1), F.lit("cafe\u0301")).alias("b")).first()
    assert row.k == "9a0f18ada558d783a3a0b13ed152bc2b0120c427c1cad75e15aa4fc0bf391e3d" and row.a == row.b


def test_reassign_texts_within_words_and_many_equal_headwords(spark):
    heads = [("u1", "w1", "old plate"), ("u1", "w2", "Plate"), ("u1", "w3", "a"), ("u2", "w4", "old plate"), ("u2", "w6", "old plate"), ("u2", "w5", None), ("u3", "w7", "\u00e9t\u00e9"), ("u4", "w9", ""), ("u4", "w8", "")]
    texts = [("e1", "w2", "u1", "A cold plate"), ("e2", "w9", "u1", "A cold plate"), ("e3", "w9", "u1", "replated"), ("e4", "w9", "u1", "xyz"), ("e5", "w9", "u1", "bad"), ("e6", "w6", "u2", "OLD PLATES"),
             ("e7", "w9", "u2", "OLD PLATES"), ("e8", "w9", "u2", "old"), ("e9", "w5", "u2", None), ("e10", "w9", "u3", "L'\u00c9T\u00c9 2"), ("e11", "w0", "u4", ""), ("e12", "w7", "u9", "old plate")]
    heads += [("u5", f"x{i:05}", f"large {i % 3}") for i in range(3000)]
    texts += [(f"t{i}", "x" if i % 2 else f"x{i:05}", "u5", f"a large {i % 7} b") for i in range(3000)]
    out = review.reassign_texts(spark.createDataFrame(texts, "entity_key string, word_key string, unit_key string, text string"), spark.createDataFrame(heads, "unit_key string, word_key string, headword string"))
    got = {r.entity_key: r.owner for r in out.collect()}
    known = {}
    for unit, word, head in heads:
        if head is not None:
            known.setdefault((unit, head.lower()), []).append((len(head), word))

    def owner(word, unit, text):
        if text is None:
            return None
        can = [(w != word, -n, w) for (u, head), rows in known.items() if u == unit and head in text.lower() for n, w in rows]
        return min(can)[2] if can else None

    assert got == {e: owner(w, u, t) for e, w, u, t in texts}
    assert got["e2"] == "w1" and got["e3"] == "w2" and got["e5"] == "w3" and got["e7"] == "w4"
