"""Release gates: each rule alone, missing tables, sound and broken WAV files."""

import struct

import pytest
from pyspark.sql import functions as F

from cardamom.operators import gates

SHA = "a" * 64


def wav(rate=24000, pcm=1, data=b"\1\2", before=b"", riff=b"RIFF", kind=b"WAVE"):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = kind + before + chunk(b"fmt ", struct.pack("<HHIIHH", pcm, 1, rate, rate * 2, 2, 16)) + chunk(b"data", data)
    return riff + struct.pack("<I", len(body)) + body


def test_wav_headers(spark):
    files = [wav(), wav(rate=8000), wav(before=b"LIST" + struct.pack("<I", 3) + b"abc\0"), wav(data=b"\1"), wav(pcm=3), wav(data=b""), wav(riff=b"RIFX"), wav(kind=b"AVI "), wav()[:-4], b"", b"RIFF", None]
    got = spark.createDataFrame(list(enumerate(files)), "i int, b binary").select("i", gates.wav_header(F.col("b")).alias("w")).orderBy("i").collect()
    assert [r.w.valid for r in got] == [True, True, True, True, False, False, False, False, False, False, False, False]
    assert [r.w.sample_rate_hz for r in got[:4]] == [24000, 8000, 24000, 24000]


def release(spark, **change):
    rows = {
        "unit": ("unit_key string", [("u",)]),
        "word": ("word_key string, unit_key string, source_order int, headword string", [("w.u.0007.go", "u", 7, "go"), (SHA, "u", 10001, "x"), ("w.u.12345.y", "u", 12345, "y")]),
        "sense": ("sense_key string, word_key string, sense_order int", [(f"s.{SHA}.1", SHA, 1)]),
        "phrase": ("phrase_key string, word_key string, source_order int", []),
        "example": ("example_key string, word_key string, source_order int", [(f"ex.{SHA}.2", SHA, 2)]),
        "card_definition": ("content_card_key string, word_key string", [("b" * 64, SHA)]),
        "release_unit": ("words int, cards int, examples int", [(3, 1, 1)]),
        "content_search_fts": ("x int", [(1,)] * 5),
        "content_key_alias": ("release_id string, from_key string, to_key string, canonical_key string", [("r", "a", "b", "b")]),
    }
    made = {t: spark.createDataFrame(change.get(t, data), schema) for t, (schema, data) in rows.items() if change.get(t, data) is not None}
    problems = spark.createDataFrame(change.get("problems", [("k", None)]), "asset_key string, problem string")
    return {r.gate: (r.passed, r.details) for r in gates.release_gates(made, problems, change.get("version", 1)).collect()}


def failed(found):
    return [g for g, (ok, _) in found.items() if not ok]


@pytest.mark.parametrize("change, gate", [
    ({}, []), ({"version": None}, ["schema"]), ({"version": 0}, ["schema"]),
    ({"sense": [("s.gone.1", "gone", 1)]}, ["foreignKeys"]), ({"card_definition": [("B" * 64, SHA)]}, ["keys"]), ({"card_definition": [("b" * 64 + "\n", SHA)]}, ["keys"]),
    ({"sense": [(f"s.{SHA}.2", SHA, 1)]}, ["keys"]), ({"sense": [(None, SHA, 1)]}, ["keys"]), ({"content_key_alias": [("r", "a", "b", "b"), ("r", "b", "a", "b")]}, ["keys"]),
    ({"problems": []}, ["audio"]), ({"problems": [("k", None), ("l", "missing")]}, ["audio"]),
    ({"release_unit": [(2, 1, 1), (0, 0, 0)]}, ["capacity"]), ({"content_search_fts": [(1,)] * 6}, ["capacity"]), ({"release_unit": []}, ["capacity"]),
    ({"phrase": None}, ["schema", "foreignKeys", "keys", "capacity"]),
])
def test_each_gate_alone(spark, change, gate):
    assert failed(release(spark, **change)) == gate


def test_audio_problems_in_order(spark):
    import hashlib
    good, bad = wav(), wav(rate=8000)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assets = [("ok", sha(good), "PASSED", 24000), ("none", sha(good), "PENDING", 1), ("null", sha(good), "PASSED", 24000), ("hash", "0", "PENDING", 1), ("pend", sha(bad), None, 24000), ("rate", sha(bad), "PASSED", 24000)]
    objects = [("ok", good), ("null", None), ("hash", good), ("pend", bad), ("rate", bad), ("unused", bad)]
    df = gates.audio_problems(spark.createDataFrame(assets, "asset_key string, content_sha256 string, validation string, sample_rate_hz int"), spark.createDataFrame(objects, "asset_key string, content binary"))
    assert {r.asset_key: r.problem for r in df.collect()} == {"ok": None, "none": "missing", "null": "missing", "hash": "hashMismatch", "pend": "unvalidated", "rate": "badHeader"}
    assert tuple(gates.count_problems(df).first()) == (6, 2, 1, 1, 1)
