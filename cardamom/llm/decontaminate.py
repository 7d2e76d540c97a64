"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words; a seed is a run of ``min_match`` words. The seeds of the documents and of the
benchmark are joined, and the items that a text shares seeds with are its candidates, if the shared seeds are as many as
coverage to the threshold takes. Greedy string tiling then covers the item with the longest common runs that don't
overlap, found by running Karp-Rabin hashes of falling length; reordered passages are found as several tiles. The share
of the item's words that tiles cover decides.

Only seeds that the benchmark may hold leave the documents' tasks; a bitmap of bounded size tells. Equal texts are joined
once. Neither table goes through the driver.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, fresh, memory_returned, read, small_batches, texts_in

WORD = re.compile(r"[^\W_]+")
#: The bitmap of seeds has 16 bits a seed, but 2^26 bits (8 MB) at most; a fuller one lets more through to the join.
MIN_BITMAP, MAX_BITMAP = 10, 26
#: Characters hashed at a time, which may end within a word, and texts taken at a time.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 100_000, 256
_B = 0x9E3779B97F4A7C15


@cache
def _in_words() -> np.ndarray:
    """By code point, whether WORD takes it."""
    out = np.zeros(0x110000, bool)
    for run in WORD.finditer("".join(map(chr, range(len(out))))):
        out[run.start() : run.end()] = True
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words by text, 64-bit hashes of all words), from running hashes over the characters. Null texts have no words."""
    lowered = [t.lower() if t else "" for t in texts]
    limits = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    joined = " ".join(lowered)
    found = [np.empty((3, 0), np.uint64)]
    for at in range(0, len(joined), CHARS_AT_ONCE):
        points = np.frombuffer(joined[at : at + CHARS_AT_ONCE].encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = _in_words()[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        running = RunningHash(points.astype(np.uint64))
        h = np.diff(running.sums[edges])[::2] * running.inverse(edges[::2])
        found.append(np.stack([edges[::2] + at, edges[1::2] + at, h], dtype=np.uint64, casting="unsafe"))
    starts, ends, h = np.concatenate(found, axis=1)
    # A word that a cut went through stands there in parts.
    first = np.append(True, starts[1:] != ends[:-1])[: len(starts)]
    whole = np.flatnonzero(first)
    power = np.ones(len(h), np.uint64)
    for k in np.flatnonzero(~first):
        before = starts[k] - starts[whole[np.searchsorted(whole, k) - 1]]
        power[k] = pow(_B, int(before), 1 << 64)
    h = np.add.reduceat(h * power, whole) if len(whole) else h
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.diff(np.searchsorted(starts[whole], limits.astype(np.uint64))), h ^ (h >> np.uint64(32))


def _values(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.int64) + 2).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class RunningHash:
    """Karp-Rabin hashes of all windows of any length over words' values, modulo 2^64, from one running sum."""

    _power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(self._power) < n:
            steps = np.full(2 * n, _B, np.uint64)
            steps[0] = 1
            RunningHash._power = np.cumprod(steps)
            steps[1:] = pow(_B, -1, 1 << 64)
            RunningHash._inverse = np.cumprod(steps)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self._power[: len(values)])])

    def inverse(self, at: np.ndarray) -> np.ndarray:
        """By these, differences of sums from there on become hashes that don't depend on the place."""
        return self._inverse[at]

    def windows(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self._inverse[: max(len(self.sums) - length, 0)]


def greedy_tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of greedy string tiling: longest common runs first, none overlapping another;
    of equally long ones the first in the item, then in the text.

    The search length falls from the item's length by halves to min_match. At each length, windows without marked words
    are matched by their running hashes, extended, and marked from the longest on.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    item_hash, text_hash = RunningHash(_values(item)), RunningHash(_values(text))
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), len(text)))
    while min_match <= min(len(item), len(text)):
        length = min(length, len(item), len(text))

        def windows(hashes: RunningHash, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[length:] == taken[:-length])
            return at, hashes.windows(length)[at]

        at_item, h_item = windows(item_hash, free_item)
        at_text, h_text = windows(text_hash, free_text)
        places = defaultdict(list)
        for i, h in zip(at_item.tolist(), h_item.tolist()):
            places[h].append(i)
        found = []
        hit = np.isin(h_text, h_item)
        for j, h in zip(at_text[hit].tolist(), h_text[hit].tolist()):
            for i in places[h]:
                if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # part of a run that started before
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                if n >= length:
                    found.append((-n, i, j))
        for minus, i, j in sorted(found):
            n = -minus
            if free_item[i : i + n].all() and free_text[j : j + n].all():
                tiles.append((i, j, n))
                free_item[i : i + n] = False
                free_text[j : j + n] = False
        # A run that lost words to a longer one may still have length words left: search again before going down.
        if not _left(found, free_item, free_text, length):
            if length == min_match:
                break
            length = max(min_match, length // 2)
    return tiles


def _left(found: list[tuple[int, int, int]], free_item: np.ndarray, free_text: np.ndarray, length: int) -> bool:
    """Does a run of this search still hold a stretch of length unmarked words?"""
    for minus, i, j in found:
        both = free_item[i : i - minus] & free_text[j : j - minus]
        if both.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], both.astype(np.int8), [0]])))
            if (edges[1::2] - edges[::2]).max() >= length:
                return True
    return False


def _seed_hashes(values: np.ndarray, size: int) -> np.ndarray:
    h = RunningHash(values).windows(size)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(size)


def benchmark_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """(_item, _n, _size, _h, _times) of items (_item, _item_text): each distinct seed, how often the item of _n words has it, and its length."""

    @F.arrow_udf("struct<n:int,size:int,h:array<long>,times:array<int>>")
    def seeds(texts: pa.Array) -> pa.Array:
        rows = []
        counts, hashes = word_hashes(texts.to_pylist())
        for end, n in zip(np.cumsum(counts), counts):
            values = hashes[end - n : end]
            size = min(min_match, len(values))
            h, times = np.unique(_seed_hashes(values, size) if size else np.empty(0, np.uint64), return_counts=True)
            rows.append({"n": len(values), "size": size, "h": h.view(np.int64), "times": times.astype(np.int32)})
        return pa.array(rows, pa.struct([("n", pa.int32()), ("size", pa.int32()), ("h", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))

    found = items.select("_item", seeds("_item_text").alias("_s"))
    return found.select("_item", F.col("_s.n").alias("_n"), F.col("_s.size").alias("_size"), F.explode(F.arrays_zip("_s.h", "_s.times")).alias("_x")).select(
        "_item", "_n", "_size", F.col("_x.h").alias("_h"), F.col("_x.times").alias("_times"))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap over the upper bits of the seeds, as 64-bit words."""
    bits = min(MAX_BITMAP, max(MIN_BITMAP, (16 * seeds.count()).bit_length()))
    place = F.shiftrightunsigned("_h", 64 - bits)
    words = seeds.groupBy(F.shiftright(place, 6).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("_b"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["_w"].to_numpy()] = found["_b"].to_numpy()
    return out.view(np.uint64)


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text in joins; null for a null text."""
    return [F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.hash(text))]


def candidates(texts: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(_k1, _k2, _item): keys of texts (_k1, _k2, _text) with the items that share enough seeds with them.

    Tiles of min_match words or more that cover C words of an item hold C / min_match of its seeds at least, counted as
    often as the item has them.
    """
    small_batches(texts.sparkSession)
    seeds = cut(benchmark_seeds(items, min_match))
    sizes = sorted(r[0] for r in seeds.select("_size").distinct().collect())  # min_match numbers at most
    shared = texts.sparkSession.sparkContext.broadcast((_bitmap(seeds), sizes))

    @F.arrow_udf("array<long>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with memory_returned():
            bitmap, sizes = shared.value
            shift = np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
            for batch in batches:
                rows = [pa.array([], pa.list_(pa.int64()))]
                for start in range(0, len(batch), TEXTS_AT_ONCE):
                    counts, values = word_hashes(batch.slice(start, TEXTS_AT_ONCE).to_pylist())
                    row = np.repeat(np.arange(len(counts)), counts)
                    found = [np.empty((2, 0), np.uint64)]
                    for size in sizes:
                        if size <= len(values):
                            h = _seed_hashes(values, size)
                            at = h >> shift
                            hit = (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                            hit &= row[size - 1 :] == row[: len(h)]  # seeds don't reach from text to text
                            found.append(np.stack([row[: len(h)][hit].astype(np.uint64), h[hit]]))
                    some = np.concatenate(found, axis=1)
                    some = some[:, np.lexsort(some[::-1])]
                    some = some[:, np.append(True, (some[:, 1:] != some[:, :-1]).any(0))[: some.shape[1]]]
                    ends = np.searchsorted(some[0], np.arange(len(counts) + 1, dtype=np.uint64))
                    rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(some[1].view(np.int64))))
                yield pa.concat_arrays(rows)

    # Spark would push the filter below the projection, and so run a second function and worker over the texts that stay.
    seen = near.asNondeterministic()("_text")
    some = texts.select("_k1", "_k2", seen.alias("_near")).where(F.size("_near") > 0)
    once = some.groupBy("_k1", "_k2").agg(F.first("_near").alias("_near")).select("_k1", "_k2", F.explode("_near").alias("_h"))
    met = once.join(seeds, "_h").groupBy("_k1", "_k2", "_item").agg(F.sum("_times").alias("_times"), F.first("_n").alias("_n"))
    found = cut(met.where(F.col("_times") * min_match >= threshold * F.col("_n")).select("_k1", "_k2", "_item"))
    shared.unpersist()
    return found


def _judged(rows: DataFrame, benchmark: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """Rows (_k1, _k2, _text, ..) with the items that their texts contain: item_id and the struct _hit."""
    given = benchmark.select("item_id", F.col("text").alias("_item_text")).where("_item_text is not null").distinct()
    given = given.select("item_id", "_item_text", F.concat_ws("-", *_keys(F.col("_item_text"))).alias("_item"))
    items = given.select("_item", "_item_text").distinct()
    pairs = few(candidates(rows.select("_k1", "_k2", "_text"), items, min_match, threshold))

    @F.arrow_udf("struct<n_words:int,covered:int,tiles:int,coverage:double>")
    def judge(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for text, part in zip(texts_in(texts), texts_in(parts)):
            places: dict[str, int] = {}
            item = np.array([places.setdefault(w, len(places)) for w in WORD.findall(part.lower())], np.int64)
            words = WORD.findall(text.lower())
            ids = np.array([places.get(w, -1) for w in words], np.int64)
            tiles = greedy_tiles(item, ids, min(min_match, len(item)))
            covered = sum(n for _, _, n in tiles)
            out.append((len(item), covered, len(tiles), covered / len(item)))
        kinds = [("n_words", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32()), ("coverage", pa.float64())]
        return pa.array([dict(zip(dict(kinds), x)) for x in out], pa.struct(kinds))

    hits = rows.join(pairs, ["_k1", "_k2"]).join(items, "_item").withColumn("_hit", judge("_text", "_item_text"))
    hits = hits.where(F.col("_hit.covered") >= threshold * F.col("_hit.n_words"))
    return hits.drop("_item_text").join(given.drop("_item_text"), "_item")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", min_match: int = 4,
                   threshold: float = 0.6) -> DataFrame:
    """One row per document row and benchmark item that it contains: doc_id, item_id, n_words, covered, tiles, coverage.

    Null or empty texts hit nothing; null or empty items are skipped, and items with a null id are reported with it;
    ids keep their types. Items shorter than min_match words must occur whole. Repeated document rows give repeated hits,
    repeated benchmark rows count once. Empty tables give an empty result. Whole texts are scanned; other columns don't matter.
    """
    k1, k2 = _keys(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), k1.alias("_k1"), k2.alias("_k2"))
    return _judged(rows, benchmark, min_match, threshold).select(F.col("_doc").alias(doc_id), "item_id", "_hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_match: int = 4, threshold: float = 0.6) -> DataFrame:
    """The rows of docs that contain no benchmark item, with the columns of docs. Null and empty texts stay."""
    k1, k2 = _keys(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), k1.alias("_k1"), k2.alias("_k2"))
    names = fresh(docs, "_gone1", "_gone2")
    gone = cut(_judged(rows, benchmark, min_match, threshold).select(F.col("_k1").alias(names[0]), F.col("_k2").alias(names[1])).distinct())
    return docs.join(few(gone), reduce(Column.__and__, [k == gone[n] for k, n in zip((k1, k2), names)]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
