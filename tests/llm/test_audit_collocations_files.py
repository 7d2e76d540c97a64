"""Filter audit, collocations and token files against plain Python, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardamom.llm import collocations, filter_audit, token_files
from cardamom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_collocations"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(result.fetchall())


# --- Filter audit ---


def failures(docs):
    """{row: set of letters} by the filters' definitions; docs are (doc_id, text)."""
    least = {}
    for k, t in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > least[t]}
        out.append({f for f, x in fails.items() if x})
    return out


def walked(parts, failed, letters):
    """The audit by applying the filters of every order to the rows one after another."""
    rows = defaultdict(list)
    for part, f in zip(parts, failed):
        rows[part or ""].append(f)
    out, total = {}, Counter()
    for part, fs in rows.items():
        for order in permutations(letters):
            left = fs
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x]
                gone = sum(f in x for x in fs) - len(hit)
                left = [x for x in left if f not in x]
                out[part, "".join(order), step] = [len(left), len(hit), gone, sum(x == {f} for x in fs)]
                total[part, f] += len(hit)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


TEXTS = [None, "", "", "same text", "same text", "SAME TEXT $", "word " * 60, " ".join(f"w{k}" for k in range(60)), "UP " * 70, "long text " * 20_000, "x" * 100_000]


def test_filter_audit_of_rows(spark):
    docs = [(k if k != 7 else None, t, None if k % 4 == 0 else "s" if k % 3 else "") for k, t in enumerate(TEXTS)]
    docs += [(3, "same text", "s"), (3, "same text", "other"), (None, "same text", "s"), (None, None, None)]
    df = spark.createDataFrame([(*d, True, 5, 1) for d in docs], "doc_id long, text string, source string, B boolean, kept int, _digest int")
    rows = filter_audit.with_failures(df, keep=["source"])
    got = Counter((r.doc_id, r.source, frozenset(f for f in "ABCDE" if r[f])) for r in rows.collect())
    failed = failures([d[:2] for d in docs])
    assert got == Counter((d[0], d[2], frozenset(f)) for d, f in zip(docs, failed))
    audit = filter_audit.audit_filters(rows, F.col("source"), {f: F.col(f) for f in "ABCDE"})
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.collect()}
    assert found == walked([d[2] for d in docs], failed, "ABCDE")
    assert filter_audit.with_failures(df.limit(0), keep=["source"]).count() == 0


@pytest.mark.parametrize("k", [1, 3, 4])
def test_filter_audit_of_any_number(spark, k):
    letters, rng = "PQRS"[:k], np.random.default_rng(k)
    rows = [("s", *(None if x == 2 else bool(x) for x in rng.integers(0, 3, k))) for _ in range(200)]
    df = spark.createDataFrame(rows, "part string, " + ", ".join(f"{f} boolean" for f in letters))
    audit = filter_audit.audit_filters(df, F.col("part"), {f: F.col(f) for f in letters}, {"first": F.col("P")})
    failed = [{f for f, x in zip(letters, r[1:]) if x} for r in rows]
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.collect()} == walked(["s"] * 200, failed, letters)
    lost = {r.filter_order: r.first_lost for r in audit.where("step = 1").collect()}
    assert all(n == sum(order[0] in f and "P" in f for f in failed) for order, n in lost.items())
    with pytest.raises(ValueError):
        filter_audit.audit_filters(df, F.col("part"), {})


def test_orders_through_edges():
    edges = filter_audit.edges_of(4)
    assert len(edges) == 32 and sum(w for _, f, w in edges if f == 0) == 24  # each order adds each filter once
    for s, f, w in edges:
        assert w == sum(set(p[: p.index(f)]) == {g for g in range(4) if s >> g & 1} for p in permutations(range(4)))


# --- Collocations ---


def pieces(docs):
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            if w := re.findall(r"[^\x20\x09]+", piece):
                yield "und" if lang is None else lang, w


def mined(docs, least, longest, percent, top):
    count, total = Counter(), Counter()
    for lang, w in pieces(docs):
        total[lang] += len(w)
        for m in range(1, longest + 1):
            count.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    frequent = {p: n for p, n in count.items() if n >= least and len(p) > 2}
    covered = set()
    for p, n in frequent.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                part = (p[0], *p[i : i + m])
                if 100 * n >= percent * frequent[part]:
                    covered.add(part)
    rows = defaultdict(list)
    for p, a in frequent.items():
        if p not in covered:
            cuts = [(1_000_000 * a * a // (count[p[: k + 1]] * count[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            rows[p[0]].append((-score, -a, " ".join(p[1:]).encode(), count[p[: k + 1]], count[(p[0], *p[k + 1 :])]))
    return {(lang, n): (t.decode(), -a, left, right, total[lang], -s) for lang, r in rows.items() for n, (s, a, t, left, right) in enumerate(sorted(r)[:top], 1)}


def found(df):
    return {(r[0], r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("longest,top", [(3, 2000), (2, 5), (4, 2000)])
def test_collocations_equal_plain_counts(spark, longest, top):
    rng = np.random.default_rng(longest)
    passage = " ".join(f"p{k}" for k in range(40))  # a chain of unary nodes
    docs = [("en" if k % 3 else None, " ".join(rng.choice(["a", "B", "c", "é", "a a", "b.", "x\ty", "\U0001f600"], 60)) + (f" {passage} " if k % 2 else " p3 p4, p4 p5")) for k in range(50)]
    docs += [("fr", None), ("fr", ""), ("fr", " \t.,"), (None, "aa bb " * 20_000), ("de", "one two three. " * 9), ("es", "one two three. " * 10)]
    df = spark.createDataFrame([(lang, t, 1, "r") for lang, t in docs], "lang string, text string, n int, rank string")
    assert found(collocations.mine_collocations(df, longest=longest, top=top)) == mined(docs, 10, longest, 50, top)
    assert collocations.mine_collocations(df.limit(0), longest=longest).count() == 0


def test_paths_are_compacted(spark):
    passage = [f"p{k}" for k in range(300)]
    docs = [("en", " ".join(passage)), ("en", " ".join(passage[100:])), ("en", "p250 p251 q")]
    df = spark.createDataFrame(docs, "lang string, text string")
    phrases = collocations.frequent_phrases(collocations.phrase_graph(df, F.col("lang"), F.col("text")), 1)
    paths = {(tuple(r.words), r.n) for r in collocations.compact_paths(phrases).collect()}
    # The flow changes at node p100 p101, where the second text starts, and at p250 p251, which the third one shares.
    assert paths == {(tuple(passage[:102]), 1), (tuple(passage[100:252]), 2), (tuple(passage[250:]), 2), (("p250", "p251", "q"), 1)}
    edges = collocations.unfold_paths(collocations.compact_paths(phrases)).collect()
    counts = Counter(t for _, w in pieces(docs) for t in zip(w, w[1:], w[2:]))
    assert {(r.w1, r.w2, r.w3): r.n for r in edges} == counts and len(edges) == len(counts)
    flow = Counter(t for _, w in pieces(docs) for t in zip(w, w[1:]))
    assert all(r.flow_in == flow[r.w1, r.w2] and r.flow_out == flow[r.w2, r.w3] for r in edges)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**14 - 3, 10**14 + 7, 3 * 10**14 + 11
    df = spark.createDataFrame([(a, left, right)], "a long, l1 long, r1 long")
    assert df.select(collocations._least_cut(2)["score"]).head()[0] == 1_000_000 * a * a // (left * right)


# --- Token files ---


@pytest.mark.parametrize("widths", [[8, 8], [3, 5, 7, 1], [16], [1] * 16, [7, 9]])
def test_file_format(widths):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 65_536, 5_000).astype(np.int32)
    ids[::3] %= 100
    ids[::7] = 0
    writer = token_files.DacWriter(widths)
    for at in range(0, 5_000, 37):
        writer.add(at or None, ids[at : at + 37])
    writer.add(-5, ids[:0])
    data = b"".join(writer.bytes())
    read = []
    file = token_files.DacFile(lambda size, offset: read.append(size) or data[offset : offset + size])
    assert (file.tokens(0, 5_000) == ids).all() and file.documents(0, 2)[0] == [None, 37] and file.documents(file.n_docs - 1)[0] == [-5]
    read.clear()
    for at in range(0, 5_000, 11):
        assert file.token(at) == ids[at]
    assert max(read) <= token_files.RANK_BITS // 8  # a token never takes more than one block of the bitmap
    for at in range(0, 4_800, 313):
        assert (file.tokens(at, 200) == ids[at : at + 200]).all()
    for at, n in ((-1, 1), (5_000, 1), (0, 5_001)):
        with pytest.raises(IndexError):
            file.tokens(at, n)
    with pytest.raises(ValueError):
        writer = token_files.DacWriter([4, 4])
        writer.add(1, np.array([256]))
        writer.bytes()


def test_widths_are_the_best():
    def size(widths, counts):
        total, bits = 0, 0
        for k, w in enumerate(widths):
            n = sum(c for b, c in enumerate(counts) if b > bits or bits == 0)
            total, bits = total + n * (w if k == len(widths) - 1 else w + 1 + 32 / token_files.RANK_BITS), bits + w
        return total

    def every(bits):
        yield from ([w, *rest] for w in range(1, bits + 1) for rest in (every(bits - w) if w < bits else [[]]))

    for seed in range(5):
        counts = np.random.default_rng(seed).integers(0, 1000, 9).tolist()
        assert size(token_files.best_widths(counts), counts) == pytest.approx(min(size(w, counts) for w in every(8)))
    assert token_files.best_widths([0] * 33) == [1]


def test_token_files(spark, tokenizer, tmp_path):
    texts = [*TEXTS, "Ünïcödé ſtraße K İ \x00 H̱ 'S it's ''s   \x1c\x85 á", "mixed CASE, numbers 12345 and #tags", "\U0001f600" * 50]
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)] + [(None, "no id", "x", 7), (3, texts[3], "x", 7), (3, "other text of id 3", "x", 7), (-4, "negative", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, start int").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    token_files.store_texts(df, WORD_BPE, folder, tokens_a_file=300)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    want = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert sorted(((r.doc_id, i) for r, i in zip(got, ids)), key=key) == sorted(want, key=key)
    starts = np.cumsum([0, *map(len, ids)])
    assert [r.start for r in got] == starts[:-1].tolist() and [r.n_tokens for r in got] == list(map(len, ids))
    assert token_files.read_manifest(spark, folder).count() > 3
    flat = [t for i in ids for t in i]
    places = [0, 1, 299, 300, 301, len(flat) - 1, len(flat), None, -1, 5, 5, *range(17, len(flat), 997)]
    asked = spark.createDataFrame([(p, "t") for p in places], "position long, token string")
    answers = token_files.read_tokens(spark, folder, asked, tokens_a_file=300).collect()
    assert Counter((r.position, r.token) for r in answers) == Counter((p, flat[p] if p is not None and 0 <= p < len(flat) else None) for p in places)
    token_files.store_texts(df.limit(0), WORD_BPE, f"{folder}-none")
    assert token_files.read_token_files(spark, f"{folder}-none").count() == 0


def test_token_query_equals_the_library(spark, tokenizer):
    rows = QUERIES["op13_token_files"](spark, DATA).collect()
    docs, start, want = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}, 0, []
    for k in sorted(docs):
        ids = tokenizer.encode(docs[k] or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows)) == want
