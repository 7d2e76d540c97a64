"""Toxicity: a factorization machine over hashed terms.

A text is the set of its lower-cased words, hashed. The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over its terms; the factors ``v`` let a pair of terms weigh more
(or less) than its parts, which an additive model cannot. The model is fitted on a bounded sample of labelled
rows and then broadcast; scoring all texts needs no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, fresh, memory_returned, read, small_batches, texts_in

WORD = re.compile(r"[^\W\d_]+")
HASH_BITS = 20
#: At most so many labelled rows are used for the fit.
MAX_TRAINING_ROWS = 12_000


def hashed_terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text; none for null or empty texts."""
    words = set(WORD.findall(text.lower())) if text else ()
    crc, mask = zlib.crc32, (1 << HASH_BITS) - 1
    return np.unique(np.fromiter((crc(w.encode()) & mask for w in words), np.int32, len(words)))


@dataclass
class FactorizationMachine:
    """Weights by hashed term; terms of a single row of the fit weigh nothing."""

    slot: np.ndarray  # hashed term -> row of w and v; row 0 is all zero
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        rows = self.slot[terms]
        rows = rows[rows > 0]
        v = self.v[rows]
        z = self.w0 + self.w[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _times_log(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _ratio_of_table(hits: np.ndarray, df: np.ndarray, ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """G of the two-by-two tables with hits of df rows in, and ones of n rows in all."""
    cells = (hits, df - hits, ones - hits, n - ones - df + hits)
    margins = (df, n - df, ones, n - ones)
    return 2 * (sum(map(_times_log, cells)) - sum(map(_times_log, margins)) + _times_log(n))


def _counts(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Rows with each term, and rows with label 1 among them."""
    df, hits = np.zeros(n_terms), np.zeros(n_terms)
    for some in (slice(i, i + at_once) for i in range(0, len(rows), at_once)):
        terms = np.concatenate(rows[some])
        df += np.bincount(terms, minlength=n_terms)
        hits += np.bincount(terms, np.repeat(labels[some], [len(r) for r in rows[some]]), minlength=n_terms)
    return df, hits


def _paired_terms(rows: list[np.ndarray], labels: np.ndarray, df: np.ndarray, hits: np.ndarray, significance: float, block: int = 256) -> np.ndarray:
    """Terms of the pairs that say more than either of their terms.

    A pair counts if, among the rows with one term, G of the other's presence and the label reaches ``significance``
    with more of label 1, whichever of the two is taken first. G is at most twice the entropy of the first term's labels,
    so terms below that can't be in such a pair and are left out; of the others, all pairs are counted.
    """
    kept = np.flatnonzero((df > 0) & (2 * (_times_log(df) - _times_log(hits) - _times_log(df - hits)) >= significance))
    # The fewest rows of label 1 with which a pair can reach it: G is largest if no other row has the pair.
    least = np.full(len(kept), np.inf)
    for k in range(1, int(hits[kept].max(initial=0)) + 1):
        open_ = np.flatnonzero(np.isinf(least) & (hits[kept] >= k))
        n, t = df[kept][open_], hits[kept][open_]
        least[open_[_ratio_of_table(np.full(len(n), float(k)), np.full(len(n), float(k)), t, n) >= significance]] = k
    order = np.argsort(least, kind="stable")
    kept, least = kept[order], least[order]
    # The rows of each kept term, those with label 1 first; only blocks of terms are spread out.
    place = np.full(len(df), -1, np.int32)
    place[kept] = np.arange(len(kept))
    ones, order = int(labels.sum()), np.argsort(-labels, kind="stable")
    terms = place[np.concatenate([rows[i] for i in order])].astype(np.int32)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(rows[i]) for i in order])[terms >= 0]
    terms = terms[terms >= 0]
    by_term = np.argsort(terms, kind="stable")
    at, terms = at[by_term], terms[by_term]
    ends = np.searchsorted(terms, np.arange(len(kept) + 1))

    def spread(which: np.ndarray, low: int, high: int) -> np.ndarray:
        has = np.zeros((len(which), high - low), np.float32)
        for k, term in enumerate(which.tolist()):
            mine = at[ends[term] : ends[term + 1]]
            has[k, mine[(mine >= low) & (mine < high)] - low] = 1
        return has

    # All as bits, of which those of label 1 become numbers again one block at a time.
    parts = [np.arange(i, min(i + block, len(kept))) for i in range(0, len(kept), block)]
    packed = [np.packbits(spread(part, 0, ones).astype(bool), axis=1) for part in parts]
    bits = np.concatenate([np.packbits(spread(part, ones, len(rows)).astype(bool), axis=1) for part in parts] or [np.zeros((0, 1), np.uint8)])

    def hit(p: int) -> np.ndarray:
        return np.unpackbits(packed[p], axis=1, count=ones).astype(np.float32)

    def rest(a: np.ndarray, b: np.ndarray, at_once: int = 2_048) -> np.ndarray:
        """Rows of label 0 that hold both terms."""
        some = [slice(k, k + at_once) for k in range(0, len(a), at_once)]
        return np.concatenate([np.bitwise_count(bits[a[x]] & bits[b[x]]).sum(1, dtype=np.int64) for x in some] or [np.zeros(0, np.int64)])

    n, t = df[kept], hits[kept]
    found = np.zeros(len(kept), bool)
    for p, i in enumerate(range(0, len(kept), block)):
        first = hit(p)
        for q, j in list(enumerate(range(0, len(kept), block)))[p:]:
            both_hit = first @ hit(q).T
            possible = both_hit >= np.maximum(least[i : i + block, None], least[None, j : j + block])
            a, b = np.nonzero(possible)
            k = both_hit[a, b].astype(float)
            a, b = i + a, j + b
            c = k + rest(a, b)
            more = (a != b) & (k * n[a] > c * t[a]) & (k * n[b] > c * t[b])
            a, b, k, c = a[more], b[more], k[more], c[more]
            good = np.minimum(_ratio_of_table(k, c, t[a], n[a]), _ratio_of_table(k, c, t[b], n[b])) >= significance
            found[a[good]] = found[b[good]] = True
    return kept[found]


class _Batch:
    """Rows of terms laid end to end, with the places where each row and, once sorted, each term begins."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows])
        self.n, self.filled = len(rows), np.flatnonzero(sizes)
        self.sizes = sizes[self.filled]
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate([*rows, np.empty(0, np.int32)], dtype=np.int32, casting="unsafe")
        self.order = np.argsort(self.terms, kind="stable").astype(np.int32)
        self.unique, self.starts = (x.astype(np.int32) for x in np.unique(self.terms[self.order], return_index=True))

    def forward(self, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by row, factors by term, their sums by filled row)."""
        z, vt = np.full(self.n, w0), v[self.terms]
        sums = np.add.reduceat(vt, self.firsts, axis=0) if len(self.firsts) else vt
        if len(self.firsts):
            own = np.add.reduceat(w[self.terms] - 0.5 * np.einsum("ij,ij->i", vt, vt), self.firsts)
            z[self.filled] += own + 0.5 * np.einsum("ij,ij->i", sums, sums)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), vt, sums


def _descend(rows: list[np.ndarray], labels: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, epochs: int, rate: float, l2: float,
             start: float, seed: int, held_out: tuple[list[np.ndarray], np.ndarray] | None = None, patience: int = 3, size: int = 16):
    """AdaGrad in small batches: (w0, w, v), changed in place, and the epochs after which the log loss of the held-out rows was least."""
    rng = np.random.default_rng(seed)
    gw, gv, g0 = np.full_like(w, start), np.full_like(v, start), start
    dealt = rng.permutation(len(rows))
    parts = [dealt[at : at + size] for at in range(0, len(dealt), size)]
    apart = _Batch(held_out[0]) if held_out else None

    def loss() -> float:
        p = np.clip(apart.forward(w0, w, v)[0], 1e-6, 1 - 1e-6)
        return float(-np.log(np.where(held_out[1] == 1, p, 1 - p)).mean())

    losses = [loss()] if held_out else []
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            batch = _Batch([rows[i] for i in parts[k]])
            p, vt, sums = batch.forward(w0, w, v)
            error = p - labels[parts[k]]
            g0 += float(error.sum()) ** 2
            if len(batch.terms):
                each, unique = np.repeat(error[batch.filled], batch.sizes), batch.unique
                slope = each[:, None] * (np.repeat(sums, batch.sizes, axis=0) - vt)
                dw = np.add.reduceat(each[batch.order], batch.starts) + l2 * w[unique]
                dv = np.add.reduceat(slope[batch.order], batch.starts, axis=0) + l2 * v[unique]
                gw[unique] += dw * dw
                gv[unique] += dv * dv
                w[unique] -= rate * dw / np.sqrt(gw[unique])
                v[unique] -= 0.2 * rate * dv / np.sqrt(gv[unique])
            w0 -= rate * float(error.sum()) / np.sqrt(g0)
        if held_out:
            losses.append(loss())
            if int(np.argmin(losses)) < len(losses) - patience:
                break
    return float(w0), w, v, int(np.argmin(losses)) if losses else epochs


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 30, rate: float = 0.1,
                l2: float = 1e-4, significance: float = 20.0, seed: int = 7, min_rows: int = 2, more_epochs: int = 8) -> FactorizationMachine:
    """AdaGrad on the logistic loss, in small batches of rows; without rows or with one label only, a constant score.

    First the terms are fitted whose presence and the label have a log-likelihood ratio of ``significance`` or more, alone
    or in a pair. Then all terms of ``min_rows`` rows or more join with no weight and no factors, which grow by what the first
    leave unexplained, alone and next to them. Few labelled rows have very many terms, which would fit the labels of single
    texts: this second fit has a stronger L2 and stops where the log loss of a held-out fifth is least.
    """
    n_terms = 1 << HASH_BITS
    df, hits = _counts(rows, labels, n_terms)
    n, positive = float(len(labels)), float(labels.sum()) if len(labels) else 0.0
    w0 = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    slot = np.zeros(n_terms, np.int32)
    if not rows or positive in (0.0, n):
        return FactorizationMachine(slot, w0, np.zeros(1), np.zeros((1, factors)))
    # From here on terms are numbered, so that arrays are as long as the terms that occur.
    present = np.flatnonzero(df)
    df, hits = df[present], hits[present]
    number = np.zeros(n_terms, np.int32)
    number[present] = np.arange(len(present))
    rows = [number[r] for r in rows]
    screened = _ratio_of_table(hits, df, np.array([positive]), np.array([n])) >= significance
    if not screened.all():
        screened[_paired_terms(rows, labels, df, hits, significance)] = True
    seen = np.concatenate([np.flatnonzero(screened), np.flatnonzero(~screened & (df >= min_rows))])
    slot[present[seen]] = np.arange(1, len(seen) + 1)
    first = int(screened.sum())
    coded = [s[s > 0] for s in (slot[present[r]] for r in rows)]
    del rows, number

    def fitted(of: np.ndarray, more: int, held_out: tuple[list[np.ndarray], np.ndarray] | None = None):
        w, v = np.zeros(len(seen) + 1), np.zeros((len(seen) + 1, factors))
        v[1 : first + 1] = np.random.default_rng(seed).normal(0, 0.01, (first, factors))
        mine, marks = [coded[i] for i in of], labels[of]
        at, w, v, _ = _descend([r[r <= first] for r in mine], marks, w0, w, v, epochs, rate, l2, 1e-2, seed + 1)
        return _descend(mine, marks, at, w, v, more, 0.1 * rate, 100 * l2, 1.0, seed + 2, held_out)

    more = 0
    order = np.random.default_rng(seed + 3).permutation(len(coded))
    fifth, rest = order[: len(order) // 5], order[len(order) // 5 :]
    if first < len(seen) and len(fifth):
        more = fitted(rest, more_epochs, ([coded[i] for i in fifth], labels[fifth]))[3]
    w0, w, v, _ = fitted(np.arange(len(coded)), more)
    return FactorizationMachine(slot, w0, w, v)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> FactorizationMachine:
    """Fit on documents with a label whose crc32(doc_id as text) mod 3 is not 1: those max_rows with the smallest id hashes.

    Rows with a null id or label are left out. Of rows that share an id, the text with the least hash counts. Only hashed
    terms of the bounded sample reach the driver.
    """
    small_batches(docs.sparkSession)
    wanted = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
        .where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & (crc32_of_id("_id") % 3 != 1))
        .orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(max_rows)
    )
    # The sample of ids has max_rows rows at most, hence the broadcast.
    sample = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(wanted), "_id")

    @F.arrow_udf("array<int>")
    def terms(texts: pa.Array) -> pa.Array:
        found = [hashed_terms(t) for t in texts_in(texts)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))

    coded = sample.select("_id", "_toxic", F.xxhash64("_text").alias("_hash"), terms("_text").alias("_terms"))
    # One row an id and label, so no more rows than the sample of ids has.
    found = coded.groupBy("_id", "_toxic").agg(F.min(F.struct("_hash", "_terms")).alias("_least")).select("_id", "_toxic", "_least._terms").toArrow()
    order, marks = np.lexsort((found["_toxic"].to_numpy(), found["_id"].to_numpy())), found["_toxic"].to_numpy()
    lists = found["_terms"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    del found
    # Copies would count as evidence again and again.
    distinct = {(blake2b(flat[ends[i] : ends[i + 1]].tobytes()).digest(), int(marks[i])): i for i in order[::-1].tolist()}
    with memory_returned():
        return fit_machine([flat[ends[i] : ends[i + 1]] for i in distinct.values()], np.array([y for _, y in distinct], float))


def score_toxicity(df: DataFrame, model: FactorizationMachine, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of each whole text as column ``into`` (replaced if df has it).

    Null and empty texts get the score of a text without terms; repeated rows score alike; an empty table stays
    empty; other columns are untouched.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with memory_returned():
            machine = shared.value
            for texts in batches:
                yield pa.array([machine.score(hashed_terms(t)) for t in texts_in(texts)], pa.float64())

    return df.withColumn(into, scores(F.col(text)))


def drop_toxic(df: DataFrame, model: FactorizationMachine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows whose score is below the threshold, with the columns of df."""
    (name,) = fresh(df, "_toxicity")
    return score_toxicity(df, model, text, name).where(F.col(name) < threshold).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (crc32_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
