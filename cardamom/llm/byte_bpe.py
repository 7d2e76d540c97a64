"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Encoding: a text is split into words by the tokenizer's pattern. Words not met before in this task become rows of a
word's number and its list of tokens, one a byte at first. A recursive query joins neighbouring tokens with the merge table
and contracts each word's leftmost pair of minimum rank, until no word has a pair left. Decoding: the tokens of a text, in
their order, select from the list of the vocabulary's bytes.

Words are cut where no token of the vocabulary can reach across, which no merge can undo; so text without blanks becomes
short pieces too. Pieces that stay long (runs of one letter) have all pairs of their minimum rank contracted in one
step, in ``_ENCODE_LONG``, a block of them at a time. That gives the same ids if each token of the vocabulary is what its own bytes encode to: while
a pair of rank r is the least, no new pair can have a rank below r, or the token it makes would have been made before.
The vocabulary is held against this before the first such piece; if it fails, long pieces take single steps too.

The vocabulary is a rank file (base64 token and rank a line), read from its path in each task. A task holds one
DuckDB session and the ids of ``MAX_WORDS`` words at most; both go when it ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import closing
from itertools import islice, repeat

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, memory_returned, read, small_batches

#: Characters and tokens taken at a time; of longer texts, so many words at a time. Words that a task remembers.
CHARS_AT_ONCE, TOKENS_AT_ONCE, WORDS_AT_ONCE, MAX_WORDS = 500_000, 150_000, 100_000, 200_000
#: Bytes of words in one recursive query. Pieces longer than LONG_BYTES contract all pairs of a rank at once.
BYTES_A_QUERY, LONG_BYTES = 200_000, 64
#: Of a longer piece, so many bytes are encoded at a time, and so many of their last tokens tried as the end of what is settled.
BLOCK_BYTES, TRIES = 50_000, 16
#: A query on long pieces goes on for so many rows in all steps together, then starts anew from where it is.
ROWS_A_QUERY = 4_000_000

_ENCODE = """
WITH RECURSIVE step(word, tokens, done) AS (
  SELECT word, tokens, false FROM start
  UNION ALL
  SELECT * FROM (
    WITH pair AS (
      SELECT word, unnest(tokens[:-2]) AS token, unnest(tokens[2:]) AS next_token, unnest(range(1, len(tokens))) AS place FROM step WHERE NOT done),
    best AS (
      SELECT p.word, min(m.rank * 128 + p.place) AS best
      FROM pair p JOIN merges m ON m.a = p.token AND m.b = p.next_token GROUP BY p.word)
    SELECT s.word, CASE WHEN best IS NULL THEN s.tokens
      ELSE s.tokens[:(best & 127) - 1] || [(best >> 7)::INT] || s.tokens[(best & 127) + 2:] END, best IS NULL
    FROM step s LEFT JOIN best b ON b.word = s.word WHERE NOT s.done)
),
ready AS (SELECT word, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM step WHERE done)
SELECT word, token FROM ready ORDER BY word, place
"""

# Pairs that overlap stand in runs; every other one of a run is contracted, from its first on.
_ENCODE_LONG = """
WITH RECURSIVE step(place, token, done, n) AS (
  SELECT place, token, false, 0 FROM start
  UNION ALL
  SELECT * FROM (
    WITH pair AS (
      SELECT place, token, lead(place) OVER w AS next_place, lead(token) OVER w AS next_token
      FROM step WHERE NOT done AND n < {steps} WINDOW w AS (ORDER BY place)),
    found AS (
      SELECT p.place, p.next_place, m.rank FROM pair p JOIN merges m ON m.a = p.token AND m.b = p.next_token
      WHERE p.next_place >> 32 = p.place >> 32),
    best AS (SELECT place >> 32 AS word, {pick} AS best FROM found GROUP BY place >> 32),
    hit AS (
      SELECT f.place, f.next_place, f.rank, lag(f.next_place, 1, -1) OVER (ORDER BY f.place) <> f.place AS first
      FROM found f JOIN best b ON b.word = f.place >> 32 AND {same}),
    run AS (SELECT place, next_place, rank, sum(first::INT) OVER (ORDER BY place) AS run FROM hit),
    taken AS (SELECT place, next_place, rank FROM run QUALIFY row_number() OVER (PARTITION BY run ORDER BY place) % 2 = 1)
    SELECT s.place, coalesce(t.rank, s.token), b.word IS NULL, s.n + 1
    FROM step s LEFT JOIN best b ON b.word = s.place >> 32 LEFT JOIN taken t ON t.place = s.place
    WHERE NOT s.done AND s.n < {steps} AND s.place NOT IN (SELECT next_place FROM taken))
)
SELECT place, token, done FROM step WHERE done OR n = {steps} ORDER BY place
"""
_ALL_OF_A_RANK = {"pick": "min(rank)", "same": "b.best = f.rank"}
_LEFTMOST = {"pick": "min(rank * 4294967296 + (place & 4294967295))", "same": "b.best = f.rank * 4294967296 + (f.place & 4294967295)"}

# Token bytes are text of one character a byte. Missing tokens are null, which adds nothing.
_DECODE = """
SELECT t.row, coalesce(array_to_string(list_select(v.every, t.slots), ''), '') AS bytes FROM tokens t, vocabulary v
"""


class ByteBpe:
    """One task's vocabulary, DuckDB session and remembered words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern, get = regex.compile(pattern), self.ranks.get
        parts = [(a, b, rank) for t, rank in self.ranks.items() for k in range(1, len(t))
                 if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        merges = np.array(parts, np.int64).reshape(-1, 3)
        # What a query frees goes back to the system, as other workers share the executor's memory.
        freed = {"allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", **freed})
        self._run("CREATE TABLE merges AS SELECT * FROM given", given=pa.table(dict(zip(("a", "b", "rank"), merges.T.copy()))))
        every: list[str | None] = [None] * (max(self.ranks.values()) + 2)
        for t, k in self.ranks.items():
            every[k] = t.decode("latin-1")
        self.last = len(every) - 1  # stands for all ids that the vocabulary lacks
        self._run("CREATE TABLE vocabulary AS SELECT * FROM given", given=pa.table({"every": pa.array([every], pa.list_(pa.string()))}))
        self.byte_token = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.size_of = {k: len(t) for t, k in self.ranks.items()}
        self.reach, self.own = None, None
        self.forget()

    def close(self) -> None:
        self.db.close()
        self.forget()
        self.ranks, self.reach = {}, None

    def _run(self, sql: str, **tables: pa.Table):
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.execute(sql).fetchnumpy()
        for name in tables:
            self.db.unregister(name)
        return out

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return (np.repeat(np.arange(len(pieces)) << 32, sizes) + inside, self.byte_token[np.frombuffer(b"".join(pieces), np.uint8)])

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens by piece, all tokens), with one pair of each piece a step. For pieces of LONG_BYTES at most."""
        ends = np.cumsum([0, *map(len, pieces)])
        tokens = pa.array(self.byte_token[np.frombuffer(b"".join(pieces), np.uint8)], pa.int32())
        start = pa.table({"word": np.arange(len(pieces)), "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)})
        out = self._run(_ENCODE, start=start)
        return np.bincount(np.asarray(out["word"]), minlength=len(pieces)), np.asarray(out["token"])

    def contract_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of any length, with all pairs of the least rank a step."""
        if self.own is None:
            tokens = [t for t in self.ranks if len(t) <= LONG_BYTES]
            sizes, ids = self.contract(tokens)
            # A token's first id suffices: it is alone and the token itself.
            firsts = ids[np.cumsum(sizes) - sizes]
            self.own = bool((sizes == 1).all() and (firsts == [self.ranks[t] for t in tokens]).all())
            for t in self.ranks:
                if self.own and len(t) > LONG_BYTES:
                    self.own = self._long([t], _LEFTMOST)[1].tolist() == [self.ranks[t]]
        if not self.own:
            return self._long(pieces, _LEFTMOST)
        short = [p for p in pieces if len(p) <= BLOCK_BYTES]
        own = iter(())
        if short:
            sizes, ids = self._long(short, _ALL_OF_A_RANK)
            own = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        each = [self._in_blocks(p) if len(p) > BLOCK_BYTES else next(own) for p in pieces]
        return np.array([len(i) for i in each], np.int64), np.concatenate(each)

    def _in_blocks(self, piece: bytes) -> np.ndarray:
        """All tokens of a very long piece, BLOCK_BYTES of it at a time.

        Where each token is what its own bytes encode to, tokens are an encoding if each two neighbours are one: no merge can reach further than
        the two tokens that it joins. So a block's tokens hold up to a boundary at which the token before and the first token of what follows, encoded
        by itself, encode to these two. If a block has no such boundary among its last TRIES tokens, it is made twice as long.
        """
        at, size, out = 0, BLOCK_BYTES, []
        block = self._long([piece[:size]], _ALL_OF_A_RANK)[1]
        while at + size < len(piece):
            ends = np.cumsum([self.size_of[t] for t in block[-TRIES - 1 :].tolist()])
            ends += min(size, len(piece) - at) - ends[-1]  # where the last tokens end in the block
            for back in range(len(ends) - 2, -1, -1):
                cut, last = at + int(ends[back]), int(block[len(block) - len(ends) + back])
                after = self._long([piece[cut : cut + BLOCK_BYTES]], _ALL_OF_A_RANK)[1]
                two = [last, int(after[0])]
                if self._long([piece[cut - self.size_of[last] : cut + self.size_of[two[1]]]], _ALL_OF_A_RANK)[1].tolist() == two:
                    out.append(block[: len(block) - len(ends) + back + 1])
                    at, size, block = cut, BLOCK_BYTES, after
                    break
            else:
                size *= 2
                block = self._long([piece[at : at + size]], _ALL_OF_A_RANK)[1]
        return np.concatenate([*out, block])

    def _long(self, pieces: list[bytes], which: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
        place, token = self._rows(pieces)
        ready = []
        while len(place):
            steps = max(1, ROWS_A_QUERY // len(place))
            out = self._run(_ENCODE_LONG.format(steps=steps, **which), start=pa.table({"place": place, "token": token}))
            done = np.asarray(out["done"])
            place, token = np.asarray(out["place"]), np.asarray(out["token"])
            ready.append((place[done], token[done]))
            place, token = place[~done], token[~done]
        place, token = map(np.concatenate, zip(*ready))
        order = np.argsort(place)
        return np.bincount(place >> 32, minlength=len(pieces)), token[order]

    def cuts(self, word: bytes) -> list[bytes]:
        """The word in pieces: cut between two bytes if no token holds both with what stands before or after them."""
        if self.reach is None:
            long = [np.frombuffer(t, np.uint8).astype(np.int64) for t in self.ranks if len(t) > 2]
            threes = [(t[:-2] << 16) | (t[1:-1] << 8) | t[2:] for t in long]
            self.reach = np.zeros(1 << 24, bool), np.zeros(1 << 16, bool)
            self.reach[0][np.concatenate([*threes, np.empty(0, np.int64)])] = True
            self.reach[1][[(t[0] << 8) | t[1] for t in self.ranks if len(t) == 2]] = True
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        two = (b[:-1] << 8) | b[1:]
        three = self.reach[0][(two[:-1] << 8) | b[2:]]
        joined = self.reach[1][two]
        joined[1:] |= three
        joined[:-1] |= three
        ends = (np.flatnonzero(~joined) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)])]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of distinct words (matches of the pattern). Words that are a token are that token."""
        pieces: dict[bytes, int] = {}
        used, counts = [], np.ones(len(words), np.int64)  # pieces by word, and their number
        for k, b in enumerate(map(str.encode, words)):
            if len(b) <= LONG_BYTES:
                used.append(pieces.setdefault(b, len(pieces)))
            else:
                some = self.cuts(b)
                counts[k] = len(some)
                used += [pieces.setdefault(p, len(pieces)) for p in some]
        known = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        numbers, sizes, ids = [np.flatnonzero(known >= 0)], [np.ones((known >= 0).sum(), np.int64)], [known[known >= 0]]
        every = list(pieces)
        for mine, contract in ((lengths <= LONG_BYTES, self.contract), (lengths > LONG_BYTES, self.contract_long)):
            some = np.flatnonzero(mine & (known < 0))
            for part in _parts(lengths[some].tolist(), BYTES_A_QUERY):
                numbers.append(some[part])
                own = contract([every[k] for k in some[part]])
                sizes.append(own[0])
                ids.append(own[1])
        size, start = np.empty((2, len(pieces)), np.int64)
        where, sizes, ids = map(np.concatenate, (numbers, sizes, ids))
        size[where], start[where] = sizes, np.cumsum(sizes) - sizes
        used = np.array(used, np.int64)
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.add.reduceat(size[used], np.cumsum(counts) - counts))])
        self.flat = np.concatenate([self.flat, _picked(ids, start[used], size[used])], dtype=np.int32, casting="unsafe")

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens by word, all tokens)."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        if len(self.place) > MAX_WORDS:
            self.forget()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            missing = [words[k] for k in new]
            self.learn(list(dict.fromkeys(missing)))
            at[new] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        sizes = self.starts[at + 1] - self.starts[at]
        return sizes, _picked(self.flat, self.starts[at], sizes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens by text, all tokens)."""
        if sum(len(t or "") for t in texts) > CHARS_AT_ONCE:
            each = [self.encode([t]) if len(t or "") <= CHARS_AT_ONCE else self._encode_long(t) for t in texts]
            return np.concatenate([s for s, _ in each]), np.concatenate([i for _, i in each])
        found = [self.pattern.findall(t) if t else [] for t in texts]
        sizes, ids = self.ids([w for f in found for w in f])
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, found)])]), ids

    def _encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        matches = (m[0] for m in self.pattern.finditer(text))
        ids = [np.empty(0, np.int32)]
        while words := list(islice(matches, WORDS_AT_ONCE)):
            ids.append(self.ids(words)[1])
        ids = np.concatenate(ids)
        return np.array([len(ids)]), ids

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each row's tokens; rows of no tokens are empty. Of a row, TOKENS_AT_ONCE tokens at a time."""
        bounds, out = np.concatenate([[0], np.cumsum(sizes)]), [[] for _ in sizes]
        slots = pa.array(np.where((ids < 0) | (ids > self.last), self.last, ids) + 1, pa.int64())  # lists count from 1
        for at in range(0, len(ids), TOKENS_AT_ONCE):
            inside = np.clip(bounds, at, min(at + TOKENS_AT_ONCE, len(ids)))
            rows = np.flatnonzero(inside[1:] > inside[:-1])
            offsets = pa.array(np.append(inside[rows], inside[rows[-1] + 1]), pa.int32())
            found = self._run(_DECODE, tokens=pa.table({"row": rows, "slots": pa.ListArray.from_arrays(offsets, slots)}))
            for row, characters in zip(found["row"].tolist(), found["bytes"].tolist()):
                out[row].append(characters.encode("latin-1"))
        return [b"".join(x) for x in out]


def _picked(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]


def _parts(sizes: list[int], at_once: int) -> Iterator[slice]:
    """Slices of rows with at_once units at most, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > at_once:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text as column ``into`` (array<int>, replaced if df has it).

    With ``decoded``, also add the bytes that decoding those ids gives, in the same pass. Null and empty texts have
    no tokens. Very long texts are taken in parts that the pattern doesn't cut; what a task holds beside a text's own ids
    doesn't grow with it, nor with an unbroken run of a character, which is encoded in blocks. Strings that look like special
    tokens are ordinary text. Repeated rows are encoded alike; an empty table stays empty; other columns are untouched.
    """
    small_batches(df.sparkSession)
    kind = "struct<ids:array<int>,bytes:binary>" if decoded else "struct<ids:array<int>>"

    @F.arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with memory_returned(), closing(ByteBpe(path, pattern)) as bpe:
            for batch in batches:
                lengths = pc.binary_length(batch).fill_null(0).to_pylist()
                lists, texts = [], []
                for part in _parts(lengths, CHARS_AT_ONCE):
                    sizes, tokens = bpe.encode(batch[part].to_pylist())
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32())))
                    if decoded:
                        texts.append(pa.array(bpe.decode(sizes, tokens), pa.binary()))
                columns = [pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.concat_arrays(texts) if texts else pa.array([], pa.binary()))
                yield pa.StructArray.from_arrays(columns, names=["ids", "bytes"][: len(columns)])

    (name,) = fresh(df, "_coded")
    out = df.withColumn(name, coded(F.col(text))).withColumn(into, F.col(f"{name}.ids"))
    return (out.withColumn(decoded, F.col(f"{name}.bytes")) if decoded else out).drop(name)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """Add the bytes that each row's token ids stand for as column ``into`` (binary, replaced if df has it).

    Null and empty id arrays give no bytes. Ids that the vocabulary lacks add nothing.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with memory_returned(), closing(ByteBpe(path, public_tokenizers.PATTERN)) as bpe:
            for batch in batches:
                sizes = np.asarray(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                yield pa.array(bpe.decode(sizes, batch.flatten().to_numpy(zero_copy_only=False)), pa.binary())

    return df.withColumn(into, joined(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, decoded="bytes")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
