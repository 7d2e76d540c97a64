"""The queries over whole small tables against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cardamom.llm import byte_bpe, decontaminate, jaccard, language_id, licenses, quality, secret_scan, sharding, toxicity, url_filter
from cardamom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def by_id(df):
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else []))


def components(sets, percent):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_op1(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = url_filter.op1_url_filter(spark, DATA).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r.page_id].partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, r.verdict))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best)


def test_op3_and_op10_on_a_larger_table(spark):
    larger = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    toxic = by_id(toxicity.op3_toxicity(spark, larger))
    assert set(toxic) == set(truth) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in toxic.items())
    held = Counter((marks[k], r.predicted) for k, r in toxic.items() if k in marks and r.held_out)
    assert held[0, 1] <= 0.02 * (held[0, 0] + held[0, 1]) and held[1, 1] >= 0.4 * (held[1, 0] + held[1, 1])
    lang = by_id(language_id.op10_language_id(spark, larger))
    assert set(lang) == set(truth) and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in lang.items())
    assert sum(r.lang_pred == truth[k].lang for k, r in lang.items() if r.held_out) >= 0.97 * sum(r.held_out for r in lang.values())


def test_op2(spark, docs):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontamination(spark, DATA).collect()}
    whole = {(k, i) for k, r in docs.items() for i, w in items.items() if " ".join(w) in " ".join(words(r.text))}
    assert whole and whole <= found


def test_op4(spark, docs):
    out = by_id(licenses.op4_license_scan(spark, DATA))
    for k, r in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(FOLD))
        hits = [(at, label) for p, label in licenses.PHRASES for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        x = out[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert x.base_labels == ",".join(sorted({h[1] for h in hits})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))


def test_op5(spark, docs):
    encode, out = encoder(), by_id(byte_bpe.op5_byte_bpe(spark, DATA))
    for k, r in docs.items():
        ids = encode(r.text or "")
        assert out[k].n_tokens == len(ids) and out[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_op6(spark, docs):
    out, slots = by_id(sharding.op6_ring_shards(spark, DATA)), defaultdict(list)
    for k, r in docs.items():
        b = (r.text or "").encode()
        assert (out[k].size, out[k].text_crc32, out[k].law) == (len(b) + 8, zlib.crc32(b), "rows")
        slots[out[k].shard].append(out[k].slot)
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op7(spark, docs, labels):
    out = by_id(quality.op7_quality_rules(spark, DATA))
    for k, r in docs.items():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        x = out[k]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert x.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (x.base_failed and x.kept)


def test_op8(spark, docs):
    out = by_id(jaccard.op8_ngram_jaccard(spark, DATA))
    sets = {k: shingles(r.text) for k, r in docs.items()}
    want = components(sets, 85)
    assert all((out[k].n_shingles, out[k].component_id) == (len(sets[k]), want[k]) for k in sets)


def test_op8_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op8_ngram_jaccard']})").fetchall())
    assert sorted(map(tuple, QUERIES["op8_ngram_jaccard"](spark, DATA).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_op8_keeps_links_in_large_groups_of_near_copies(spark):
    import random

    random.seed(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(250):
        w = list(base)
        for at in random.sample(range(120), random.choice([0, 1, 1, 2, 3, 4, 5])):
            w[at] = f"e{random.randrange(40)}"
        texts.append(" ".join(w))
    texts += [" ".join(random.choices([f"z{k}" for k in range(2000)], k=60) + base[:30]) for _ in range(100)]
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = components(sets, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want


def test_op9(spark, docs):
    out = by_id(secret_scan.op9_secret_scan(spark, DATA))
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, r in docs.items():
        t = r.text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(s[3] for s in spans)
        joined = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(spans))
        x = out[k]
        assert (x.n_assign, x.n_access, x.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(x.spans.split(",")) | {""}


def test_pipeline(spark, docs):
    """Each stage by plain Python on what the stage before kept, with the toxicity model's own scores."""
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit_toxicity(source, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {k: r.text for k, r in docs.items() if model.score(toxicity.hashed_terms(r.text)) < 0.7}
    sets = {k: shingles(t, 5) for k, t in kept.items()}
    root = components(sets, 80)
    kept = {k: t for k, t in kept.items() if root[k] == k}
    hits = {r.doc_id for r in decontaminate.benchmark_hits(source, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    kept = {k: t for k, t in kept.items() if k not in hits}
    spans = {r.doc_id: r.spans for r in secret_scan.scan_secrets(source).collect()}
    encode, want = encoder(), {}
    for k, t in kept.items():
        out, at = "", 0
        for x in spans[k]:
            if x.start >= at:
                out += t[at : x.start] + f"[{x.kind}]"
            at = max(at, x.end)
        want[k] = encode(out + t[at:])
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()} == want
