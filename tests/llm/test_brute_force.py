"""The methods' own results over whole small tables against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from cardamom.llm import byte_bpe, decontaminate, language_id, licenses, quality, secret_scan, sharding, toxicity, url_filter
from cardamom.llm.common import read

DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read(spark, DATA, "documents").select("doc_id", "text").collect()}


def test_url_scores(spark):
    model = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    hashing, logistic = model.stages[0], model.stages[-1]
    weights, bias = logistic.coefficients.toArray(), logistic.intercept
    rows = url_filter.filter_urls(read(spark, DATA, "pages").select("page_id", "url").limit(40), model).collect()
    for r in rows:
        counts = Counter()
        for mark, part in (("h:", r.host), ("p:", r.path)):
            padded = f"^{part}$"
            for n in (3, 4, 5):
                counts.update(hashing.indexOf(mark + padded[i : i + n]) for i in range(len(padded) - n + 1))
        norm = math.sqrt(sum(c * c for c in counts.values()))
        z = bias + sum(weights[k] * c / norm for k, c in counts.items())
        assert r.block_score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if r.block_score >= 0.5 else "allow")


def plain_tiles(a, b, least):
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        at = defaultdict(list)
        for j, w in enumerate(b):
            at[w].append(j)
        for i in range(len(a)):
            for j in at[a[i]]:
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        tiles.append(n)
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n


def test_hits_equal_plain_tiling(spark, texts):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in read(spark, DATA, "benchmark").collect()}
    first = next(iter(items.values()))
    half = len(first) // 2
    extra = {10_001: " ".join(["x"] * 9 + first[half:] + ["y"] * 9 + first[:half]), 10_002: " ".join(first[: int(0.5 * len(first))]), 10_003: " ".join(first[: int(0.7 * len(first))])}
    docs = read(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.covered, r.tiles) for r in decontaminate.benchmark_hits(docs, read(spark, DATA, "benchmark")).collect()}
    want = {}
    for k, t in (texts | extra).items():
        w = words(t)
        fours = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        for item, own in items.items():
            if sum(tuple(own[i : i + 4]) in fours for i in range(len(own) - 3)) * 4 >= 0.6 * len(own):
                tiles = plain_tiles(own, w, min(4, len(own)))
                if sum(tiles) >= 0.6 * len(own):
                    want[k, item] = (sum(tiles), len(tiles))
    item = next(iter(items))
    assert found == want and {(10_001, item), (10_003, item)} <= set(found) and (10_002, item) not in found


def test_machine_scores_are_double_sums(spark, texts):
    model = toxicity.fit_toxicity(read(spark, DATA, "documents"), read(spark, DATA, "labels"))
    rows = toxicity.score_toxicity(read(spark, DATA, "documents").select("doc_id", "text"), model).limit(40).collect()
    for r in rows:
        words = {zlib.crc32(w.encode()) & ((1 << toxicity.HASH_BITS) - 1) for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())}
        at = sorted(int(model.slot[w]) for w in words if model.slot[w])
        z = model.w0 + sum(model.w[i] for i in at)
        for n, i in enumerate(at):
            for j in at[n + 1 :]:
                z += float(np.dot(model.v[i], model.v[j]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_license_labels(spark, texts):
    rows = licenses.op4_license_scan(spark, DATA).collect()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(FOLD))
        labels, shares = set(filter(None, r.base_labels.split(","))), [1.0] if r.base_labels else [0.0]
        for label, template, keys in licenses.TEMPLATES:
            template = template.split()
            wanted = licenses._key_places(template, keys)
            indexed = [i for i, x in enumerate(template) if x in licenses._KEY_WORDS or x not in licenses.COMMON]
            for s in range(-len(template), len(w)):
                if all(0 <= s + i < len(w) and w[s + i] == x for i, x in wanted.items()):
                    labels.add(label)
                    shares.append(sum(0 <= s + i < len(w) and w[s + i] == template[i] for i in indexed) / len(indexed))
        assert r.labels == ",".join(sorted(labels)) and (r.score == 1.0 if r.n_base else r.score == pytest.approx(max(shares)))


def test_ring_walked_key_by_key(spark, texts):
    import hashlib

    shards, nodes = 24, sharding.virtual_nodes(24, 128)
    room = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    places = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k in texts}
    own = {k: next((n for n, (p, _) in enumerate(nodes) if p >= place), 0) for k, place in places.items()}
    want = {}
    for k in sorted(texts, key=lambda k: (own[k], places[k], k)):
        step = own[k]
        while not room[nodes[step % len(nodes)][1]]:
            step += 1
        want[k] = nodes[step % len(nodes)][1]
        room[want[k]] -= 1
    assert {r.doc_id: r.shard for r in sharding.op6_ring_shards(spark, DATA).collect()} == want


def test_kept_follows_exact_bounds(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = read(spark, data, "documents"), read(spark, data, "labels")
    rows = quality.quality_rules(docs, labels).collect()
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None}
    text = {r.doc_id: (r.text or "") for r in docs.select("doc_id", "text").collect()}
    good = {}
    for r in rows:
        if marks.get(r.doc_id) == 1:
            good.setdefault(r.lang, {}).setdefault(text[r.doc_id], r)
    n_tests = len(good) * sum(map(len, quality.RULES.values()))
    alpha, cutoffs = quality.ALPHA / len(quality.RULES), {}
    for lang, own in good.items():
        n = len(own)
        for rule, candidates in quality.RULES.items():
            for c in sorted(candidates):
                k = sum(getattr(r, rule) > c for r in own.values())
                tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
                if k < n * alpha and tail <= quality.DELTA / n_tests:
                    cutoffs[lang, rule] = c
                    break
    for r in rows:
        failed = sorted(rule for rule in quality.RULES if (r.lang, rule) in cutoffs and getattr(r, rule) > cutoffs[r.lang, rule])
        assert r.failed_rules == failed and r.kept == (not r.base_failed and not failed)


def test_all_spans(spark, texts):
    extra = {20_000: "-----BEGIN RSA PRIVATE KEY----- é ghp_" + "a1" * 18 + " xoxb-1234567890-abc", 20_001: "Bearer " + "A9" * 12 + " eyJabcdefghi.eyJabcdefghi.abcdefghij-k"}
    docs = read(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    kinds = Counter()
    for r in secret_scan.scan_secrets(docs).collect():
        t = (texts | extra)[r.doc_id]
        want = sorted((m.start(), order, m.end(), rule.kind) for order, rule in enumerate(secret_scan.RULES) for m in re.finditer(rule.pattern, t) if len(m[rule.group]) >= rule.least)
        assert [(x.start, x.order, x.end, x.kind) for x in r.spans] == want
        kinds.update(x[3] for x in want)
    assert {"pem", "github", "slack", "jwt", "bearer"} <= set(kinds)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = abcdef12345", "a", "b", 3)], "doc_id long, text string, _kinds string, _candidate string, _n_lines int")
    out = secret_scan.scan_secrets(df).first()
    assert (out._kinds, out._candidate, len(out.spans)) == ("a", "b", 1)
    assert quality.with_features(df).first()._n_lines == 3


def test_code_lengths_walk_the_tree():
    """PPM with escapes C and exclusion, by dictionaries."""
    train = {"a": ["abracadabra abacus", "a bad cab"], "b": ["zebra crossing", "bazaar"]}
    trees = language_id.build_trees({k: language_id.count_contexts(v) for k, v in train.items()})
    alphabet = sorted({c for v in train.values() for t in v for c in t.encode()})
    for n, language in enumerate(trees.languages):
        counts = defaultdict(Counter)
        for t in train[language]:
            b = t.encode()
            for i in range(len(b)):
                for k in range(min(i, language_id.ORDER) + 1):
                    counts[b[i - k : i]][b[i]] += 1

        def p(context, symbol):
            seen = counts.get(context, {})
            shorter = lambda s: p(context[1:], s) if context else 1 / (len(alphabet) + 1)
            if not seen:
                return shorter(symbol)
            hits, kinds = sum(seen.values()), len(seen)
            left = sum(shorter(s) for s in [*alphabet, 0] if s not in seen)
            escape = kinds / (hits + kinds) if left > 0 else 0
            return seen[symbol] / hits * (1 - escape) if symbol in seen else escape * shorter(symbol) / left

        for text in ("abacus bazaar", "zebra", "crab"):
            b = text.encode()
            bits = -sum(math.log2(p(b[max(0, i - 3) : i], b[i])) for i in range(len(b)))
            assert trees.code_lengths(text)[n] == pytest.approx(bits, rel=1e-3)


@pytest.mark.parametrize("text", ["a b c d " * 1_000_000, " ".join(f"{k:06d}".translate(str.maketrans("0123456789", "abcdefghij")) * 30 for k in range(20_000)), "x" * 300_000, "文字" * 50_000])
def test_bpe_of_very_long_texts(text):
    import tiktoken

    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sizes, ids = bpe.encode([text])
    assert bpe.decode(sizes, ids) == [text.encode()]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    if len(text) < 4_000_000:
        assert ids.tolist() == own.encode_ordinary(text)
    else:
        part = own.encode_ordinary(text[:800])
        assert ids[: len(part) - 1].tolist() == part[:-1] and len(ids) == 4_000_001
    bpe.close()
