"""Language identification by partial matching (PPM).

Each language has a variable-order context tree over bytes: counts of a symbol after its last 0 to 3 bytes. A
symbol's code length comes from the longest context the tree has; symbols not seen there cost an escape
(method C: distinct symbols against occurrences) and go on to the next shorter context, without the symbols
already excluded. The statistics are frozen after training, so the code lengths of all (context, symbol) pairs
are tabulated once and a text costs two table look-ups a byte. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, read, small_batches, texts_in

ORDER = 3
#: At most so many training documents are used of each language.
MAX_DOCS_PER_LANGUAGE = 300
HASH_BUCKETS = 4096


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def count_contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of all byte strings of length 1 to ORDER + 1, as numbers with a leading 1 byte."""
    codes = []
    for text in texts:
        b = _bytes(text).astype(np.int64)
        for n in range(1, ORDER + 2):
            if len(b) >= n:
                code = np.ones(len(b) - n + 1, np.int64)
                for k in range(n):
                    code = code * 256 + b[k : len(b) - n + 1 + k]
                codes.append(code)
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 for bytes never seen
    n_symbols: int
    state: np.ndarray  # last three symbols -> longest known context
    cost: np.ndarray  # (context * symbols + symbol, language) -> bits

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the text under each language's tree."""
        s = self.symbol[_bytes(text)]
        a = self.n_symbols
        padded = np.concatenate([np.zeros(ORDER, np.int32), s])
        context = (padded[:-3] * a + padded[1:-2]) * a + padded[2:-1]
        return self.cost[self.state[context] * a + s].sum(0, dtype=np.float64)


def build_trees(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
    """Tabulate the code lengths of every known context for every language."""
    languages = sorted(counts)
    seen = np.unique(np.concatenate([c[(c >= 256) & (c < 512)] & 255 for c, _ in counts.values()] or [np.empty(0, np.int64)]))
    a = len(seen) + 1
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, a)
    known: dict[int, set] = {n: set() for n in range(1, ORDER + 1)}
    coded = {}
    for language, (codes, numbers) in counts.items():
        for n in range(1, ORDER + 2):
            mine = (codes >= 256**n) & (codes < 2 * 256**n)
            c, number = codes[mine] - 256**n, numbers[mine]
            parts = np.stack([symbol[(c >> (8 * (n - 1 - k))) & 255] for k in range(n)]).astype(np.int64)
            context = np.zeros(len(c), np.int64)
            for k in range(n - 1):
                context = context * a + parts[k]
            coded[language, n - 1] = (context, parts[-1], number)
            if n > 1:
                known[n - 1].update(np.unique(context).tolist())
    contexts = {n: np.array(sorted(known[n]), np.int64) for n in known}
    first = {0: 0}
    for n in range(1, ORDER + 1):
        first[n] = first[n - 1] + (1 if n == 1 else len(contexts[n - 1]))
    total = first[ORDER] + len(contexts[ORDER])

    def row(n: int, context: np.ndarray) -> np.ndarray:
        """Row of the longest known context that the last n symbols end with."""
        if n == 0:
            return np.zeros(len(context), np.int64)
        if not len(contexts[n]):
            return row(n - 1, context % a ** (n - 1))
        at = np.minimum(np.searchsorted(contexts[n], context), len(contexts[n]) - 1)
        hit = contexts[n][at] == context
        return np.where(hit, first[n] + at, row(n - 1, context % a ** (n - 1)))

    cost = np.zeros((total, a, len(languages)), np.float32)
    for which, language in enumerate(languages):
        p = np.zeros((total, a))
        for n in range(ORDER + 1):
            rows = 1 if n == 0 else len(contexts[n])
            if not rows:
                continue
            number = np.zeros((rows, a))
            context, last, found = coded[language, n]
            at = np.zeros(len(context), np.int64) if n == 0 else np.searchsorted(contexts[n], context)
            np.add.at(number, (at, last), found)
            shorter = np.full((1, a), 1.0 / a) if n == 0 else p[row(n - 1, contexts[n] % a ** (n - 1))]
            hits, kinds = number.sum(1, keepdims=True), (number > 0).sum(1, keepdims=True)
            left = np.where(number > 0, 0, shorter).sum(1, keepdims=True)
            escape = np.where(left > 0, kinds / np.maximum(hits + kinds, 1), 0)
            own = number / np.maximum(hits, 1) * (1 - escape)
            p[first[n] : first[n] + rows] = np.where(
                hits == 0, shorter, np.where(number > 0, own, escape * shorter / np.maximum(left, 1e-300))
            )
        cost[:, :, which] = -np.log2(np.maximum(p, 1e-30))
    state = np.empty(a**ORDER, np.int32)
    step = 1 << 20
    for at in range(0, a**ORDER, step):
        block = np.arange(at, min(at + step, a**ORDER), dtype=np.int64)
        state[at : at + len(block)] = row(ORDER, block)
    return ContextTrees(languages, symbol, a, state, cost.reshape(total * a, len(languages)))


def fit_languages(docs: DataFrame, max_docs: int = MAX_DOCS_PER_LANGUAGE) -> ContextTrees:
    """Trees of all languages, from documents with text and lang whose crc32(doc_id as text) mod 4 is not 2.

    Of each language the max_docs documents with the smallest id hashes are used, whole. Contexts are counted in tasks;
    the driver gets the distinct contexts of that bounded sample.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (crc32_of_id("_id") % 4 != 2))
    small_batches(docs.sparkSession)
    ids = rows.select("_id", "_lang", F.shiftright(F.xxhash64("_id"), 64 - HASH_BUCKETS.bit_length() + 1).alias("_bucket"))
    # Buckets of the hash say how far the smallest max_docs of a language reach, so only about so many rows meet in a task.
    least_first = Window.partitionBy("_lang").orderBy("_bucket")
    sizes = ids.groupBy("_lang", "_bucket").count().withColumn("_before", F.sum("count").over(least_first) - F.col("count"))
    near = ids.join(F.broadcast(sizes.where(F.col("_before") < max_docs).select("_lang", "_bucket")), ["_lang", "_bucket"])
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_docs)
    # max_docs rows a language at most, hence the broadcast.
    sample = rows.join(F.broadcast(picked.select("_id", "_lang").distinct()), ["_id", "_lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("_lang")["_text"]:
                codes, numbers = count_contexts(list(texts))
                yield pd.DataFrame({"_lang": language, "_code": codes, "_count": numbers})

    counted = sample.select("_lang", "_text").mapInPandas(count, "_lang string, _code long, _count long")
    table = counted.groupBy("_lang", "_code").agg(F.sum("_count").alias("_count")).toPandas()
    counts = {}
    for language, part in table.groupby("_lang"):
        part = part.sort_values("_code")
        counts[language] = (part["_code"].to_numpy(np.int64), part["_count"].to_numpy(np.int64))
    return build_trees(counts)


def identify_language(df: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the share of the best language if each code length is taken as evidence).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned.
    Whole texts are coded, however long; ties go to the first language in order of name. Repeated rows get equal
    results; an empty table stays empty; other columns are untouched, ``lang_pred`` and ``score`` are replaced.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = shared.value
        for batch in batches:
            names, scores = [], []
            for text in texts_in(batch):
                if not trees.languages or not text:
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = trees.code_lengths(text)
                best = int(bits.argmin())
                names.append(trees.languages[best])
                scores.append(float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    judged = df.withColumn("lang_pred", judge(F.when(has_letter, F.col(text))))
    found = F.col("lang_pred")
    return judged.withColumns({"score": found["score"], "lang_pred": found["lang"]})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = fit_languages(docs)
    held_out = (crc32_of_id("doc_id") % 4 == 2).alias("held_out")
    return identify_language(docs.select("doc_id", "text"), trees).select("doc_id", held_out, "lang_pred", "score")
