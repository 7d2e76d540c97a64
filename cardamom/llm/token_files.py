"""Token ids in files of directly addressable codes, written and read by Spark tasks.

A token id is split into chunks of a few bits, lowest first. Level 0 holds the first chunk of every token of a file, level 1 the second chunk of
those tokens that have one, and so on. A level's continuation bitmap says which of its entries go on, and its rank directory
counts the set bits before every block of ``RANK_BITS`` bits; so the place of a token's next chunk is one directory entry and the bits of one
block away. Any token, or any run of tokens, is read with a few small reads and without decoding what stands before it. Each file has the chunk
widths that make its levels smallest.

    magic, length of header, header (JSON: widths, numbers of tokens and documents, sections), then the sections:
    ids of documents (int64), null flags of ids (bytes), first token of every document and the end (int64), chunks, bitmap and ranks of each level

Documents are encoded where they are read; their ids are shuffled once, by ranges of ``doc_id`` whose bounds come from a scan of that column alone, and each
range becomes one file or more. A task gives each file a name of its own and the manifest lists the files of the tasks that Spark
committed, so files of lost executors are never read. Global positions are sums over the manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import memory_returned, read, shared_folder, small_batches

MAGIC, RANK_BITS = b"DACT", 512
#: Tokens in a file (a document is never split) and in one batch that a reading task returns.
TOKENS_A_FILE, TOKENS_A_BATCH = 8 << 20, 1 << 18
#: Bytes of texts that a task encodes at a time, words that the library gets at once, and the word between them.
CHARS_A_BLOCK, WORDS_AT_ONCE, MARK = 12_000_000, 20_000, "\x1f"
END_ID = 2
ID_BITS = 32
# The pattern of the tokenizer file, characters that it lower-cases one by one and that no other normalization touches, and what it
# matches among those (a space stands between words).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[!-~À-ÖØ-öø-ÿĀ-įı-ž]*$"
MATCHES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿā-ž]+|[0-9]|[^ a-z0-9ß-öø-ÿā-ž]+| ")
MATCHES_AT_ONCE = 500


# --- Encoding ---


class WordEncoder:
    """Encodes texts with a tokenizer file, each distinct word of a block once.

    Words are cut at ASCII white space, which the tokenizer drops and never reads across. The library gets many words in one text,
    MARK between them as a word of its own; words that hold it are given to it alone. Words of PLAIN characters are lower-cased and
    cut into what the tokenizer's pattern matches first, if the file has that pattern; the library then merges each distinct match once.
    """

    def __init__(self, path: str):
        self.tokenizer, self.merger, self.ends = _tokenizer(path), *_merger(path)
        self.mark = self._ids([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the tokenizer needs more than one id for the mark between words")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens by word, all tokens)."""
        marked = pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
        sizes, ids = np.zeros(len(words), np.int64), []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part, own = words.slice(at, WORDS_AT_ONCE), np.flatnonzero(marked[at : at + WORDS_AT_ONCE])
            if len(own):
                part = pc.replace_with_mask(part, pa.array(marked[at : at + WORDS_AT_ONCE]), pa.scalar("", part.type))
            (found,) = self._ids([_joined(part, f" {MARK} ")])
            found = np.array(found, np.int32)
            ends = np.append(np.flatnonzero(found == self.mark[0]), len(found))
            some = np.diff(ends, prepend=-1) - 1
            found = found[found != self.mark[0]]
            if len(own):
                alone = self._ids(words.take(pa.array(own + at)).to_pylist())
                found = np.insert(found, np.repeat((np.cumsum(some) - some)[own], list(map(len, alone))), [i for one in alone for i in one])
                some[own] = list(map(len, alone))
            sizes[at : at + len(part)] = some
            ids.append(found)
        return sizes, np.concatenate([*ids, np.empty(0, np.int32)])

    def _encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of PLAIN characters."""
        matches = pa.array(MATCHES.findall(_joined(words, " ").lower()), pa.large_string()).dictionary_encode()
        distinct, at = matches.dictionary.to_numpy(zero_copy_only=False).tolist(), matches.indices.to_numpy()
        sizes, ids = [], []
        for k in range(0, len(distinct), MATCHES_AT_ONCE):
            (found,) = self.merger.encode_batch_fast([" ".join(distinct[k : k + MATCHES_AT_ONCE])], add_special_tokens=False)
            found = np.array(found.ids, np.int32)
            own = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if " " in distinct[k : k + MATCHES_AT_ONCE]:  # what stands between words has no tokens
                own = np.insert(own, distinct[k : k + MATCHES_AT_ONCE].index(" "), 0)
            sizes.append(own)
            ids.append(found)
        if not distinct:
            return np.zeros(len(words), np.int64), np.empty(0, np.int32)
        sizes, flat = np.concatenate(sizes), np.concatenate(ids)
        picked = _picked(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
        blank = distinct.index(" ") if " " in distinct else -1
        ends = np.append(np.flatnonzero(at == blank), len(at))
        return np.diff(np.append(0, np.append(0, np.cumsum(sizes[at]))[ends])), picked

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens by text, all tokens); null texts have none."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False) & (self.merger is not None)
        of_word, where = np.zeros((2, len(distinct)), np.int64)
        flat, n = [], 0
        for own, encode in ((plain, self._encode_plain), (~plain, self._encode_words)):
            of_word[own], ids = encode(distinct.filter(pa.array(own)))
            where[own] = n + np.cumsum(of_word[own]) - of_word[own]
            flat.append(ids)
            n += len(ids)
        at = coded.indices.to_numpy()
        by_text = np.diff(np.append(0, np.cumsum(of_word[at]))[np.cumsum([0, *words.value_lengths().to_pylist()])])
        return by_text, _picked(np.concatenate(flat), where[at], of_word[at])


def _joined(words: pa.Array, between: str) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(between, words.type))[0].as_py()


def _picked(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _merger(path: str):
    """(the file's merges alone, which ids end a word) for texts of matches between spaces; (None, None) if the file prepares texts in another way."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as source:
        file = json.load(source)
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    prepares = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = (file["normalizer"] or {}).get("normalizers") == prepares and len(steps) == 2 and steps[0] == split and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]
    if not known or not file["model"].get("end_of_word_suffix"):
        return None, None
    merger = Tokenizer.from_file(path)
    merger.normalizer = normalizers.Sequence([])
    merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(merger.get_vocab_size(), bool)
    ends[[k for t, k in merger.get_vocab().items() if t.endswith(file["model"]["end_of_word_suffix"])]] = True
    return merger, ends


def _blocks(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Batches of texts in lists of CHARS_A_BLOCK bytes, or one batch."""
    block, size = [], 0
    for batch in batches:
        block.append(batch)
        size += pc.sum(pc.binary_length(batch)).as_py() or 0
        if size >= CHARS_A_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_texts(df: DataFrame, path: str, text: str = "text", into: str = "ids", end_id: int | None = END_ID, item_bytes: int | None = None) -> DataFrame:
    """Add the ids of each whole text as column ``into`` (array<int>, replaced if df has it), ``end_id`` at their end unless it is None.

    With ``item_bytes`` (2 or 4), ids are binary instead, so many bytes each, little-endian. The tokenizer of the file at ``path`` must drop white
    space, as one with word ends does. No special tokens are added. Null and empty texts have only the end id; repeated rows are encoded alike;
    an empty table stays empty; other columns are untouched. What a task holds is a block of texts; an unbroken run of characters is
    one word, given to the library whole.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("binary" if item_bytes else "array<int>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with memory_returned():
            encoder = WordEncoder(path)
            for block in _blocks(batches):
                sizes, ids = encoder.encode(pa.concat_arrays(block))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                offsets = np.append(0, np.cumsum(sizes))
                if item_bytes:
                    if len(ids) and int(ids.max()) >> 8 * item_bytes:
                        raise ValueError(f"an id doesn't fit in {item_bytes} bytes")
                    out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((offsets * item_bytes).astype("<i4")), pa.py_buffer(ids.astype(f"<u{item_bytes}"))])
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                at = 0
                for batch in block:
                    yield out.slice(at, len(batch))
                    at += len(batch)

    return df.withColumn(into, coded(F.col(text)))


# --- The file format ---


def best_widths(counts: list[int]) -> list[int]:
    """Chunk widths with the smallest levels, bitmaps and rank directories; counts[b] tokens have b significant bits (0 for the id 0)."""
    top = max([b for b, n in enumerate(counts) if n], default=1) or 1
    left = [sum(counts[b + 1 :]) if b else sum(counts) for b in range(top + 1)]  # tokens with a chunk from bit b on
    cost, first = [0.0] * (top + 1), [0] * (top + 1)
    for b in range(top - 1, -1, -1):
        options = [(left[b] * (w if b + w == top else w + 1 + 32 / RANK_BITS) + cost[b + w], w) for w in range(1, min(16, top - b) + 1)]
        cost[b], first[b] = min(options)
    widths, b = [], 0
    while b < top:
        widths.append(first[b])
        b += first[b]
    return widths


def pack(values: np.ndarray, width: int) -> bytes:
    """values of ``width`` bits each, one after another, lowest bits first."""
    if width in (8, 16):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8])
    return np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(packed: bytes, skip: int, count: int, width: int) -> np.ndarray:
    """count values of ``width`` bits after the first ``skip`` bits."""
    if width in (8, 16) and not skip:
        return np.frombuffer(packed, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[skip : skip + count * width].reshape(count, width)
    out = np.zeros((count, 4), np.uint8)
    some = np.packbits(bits, axis=1, bitorder="little")
    out[:, : some.shape[1]] = some
    return out.view("<u4").reshape(count)


class _Level:
    """A level of the file that is being written; what it holds is packed."""

    def __init__(self, width: int, last: bool):
        self.width, self.last = width, last
        self.chunks, self.bitmap, self.rest = bytearray(), bytearray(), np.empty(0, np.uint32)

    def add(self, values: np.ndarray, end: bool = False) -> None:
        values = np.concatenate([self.rest, values])
        whole = len(values) if end else len(values) // 8 * 8
        values, self.rest = values[:whole], values[whole:]
        self.chunks += pack(values & ((1 << self.width) - 1), self.width)
        if not self.last:
            self.bitmap += np.packbits(values >> self.width != 0, bitorder="little").tobytes()

    def ranks(self) -> bytes:
        """Set bits before each block, and before the end."""
        ones = np.bitwise_count(np.frombuffer(bytes(self.bitmap) + bytes(-len(self.bitmap) % (RANK_BITS // 8)), np.uint8)).reshape(-1, RANK_BITS // 8)
        return np.concatenate([[0], np.cumsum(ones.sum(1, dtype=np.int64))]).astype("<u4").tobytes()


class DacWriter:
    """Builds one file in memory. Chunk widths are those given, else the best for its ids."""

    def __init__(self, widths: list[int] | None = None):
        self.widths, self.levels = widths, []
        self.docs, self.starts, self.ids = [], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.ids.append(ids.astype(np.uint32))

    def _levels(self, values: np.ndarray, end: bool = False) -> None:
        if len(values) and int(values.max()) >> sum(self.widths):
            raise ValueError(f"an id doesn't fit in chunks of {self.widths} bits")
        for level in self.levels:
            level.add(values, end)
            if not level.last:
                values = values >> level.width
                values = values[values != 0]

    def bytes(self) -> list[bytes]:
        """The file's parts, in order."""
        every = np.concatenate([*self.ids, np.empty(0, np.uint32)])
        blocks = [every[at : at + TOKENS_A_BATCH] for at in range(0, len(every), TOKENS_A_BATCH)]
        if self.widths is None:
            bits = sum((np.bincount(np.frexp(b.astype(np.float64))[1], minlength=ID_BITS + 1) for b in blocks), np.zeros(ID_BITS + 1, np.int64))
            self.widths = best_widths(bits.tolist())
        self.levels = [_Level(w, k == len(self.widths) - 1) for k, w in enumerate(self.widths)]
        for block in blocks:
            self._levels(block)
        self._levels(np.empty(0, np.uint32), end=True)
        sections = {
            "docs": np.array([d or 0 for d in self.docs], "<i8").tobytes(), "nulls": bytes(d is None for d in self.docs) if None in self.docs else b"",
            "starts": np.array(self.starts, "<i8").tobytes(),
        }
        for k, level in enumerate(self.levels):
            sections |= {f"chunks{k}": bytes(level.chunks)} | ({} if level.last else {f"bitmap{k}": bytes(level.bitmap), f"ranks{k}": level.ranks()})
        places, at = {}, 0
        for name, part in sections.items():
            places[name], at = [at, len(part)], at + len(part)
        header = json.dumps({"widths": self.widths, "tokens": self.starts[-1], "docs": len(self.docs), "sections": places}).encode()
        return [MAGIC, struct.pack("<I", len(header)), header, *sections.values()]


class DacFile:
    """Reads tokens of one file by place; ``read_at(size, offset)`` gives bytes of it."""

    def __init__(self, read_at):
        self.read_at = read_at
        start = read_at(8, 0)
        if start[:4] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", start[4:])
        self.header = json.loads(read_at(size, 8))
        self.widths, self.n_tokens, self.n_docs = (self.header[k] for k in ("widths", "tokens", "docs"))
        self.base = 8 + size

    def _section(self, name: str, offset: int, size: int) -> bytes:
        at, length = self.header["sections"][name]
        return self.read_at(max(0, min(size, length - offset)), self.base + at + offset)

    def _rank(self, level: int, place: int) -> int:
        """Set bits of the level's bitmap before ``place``."""
        block, inside = divmod(place, RANK_BITS)
        before = int(np.frombuffer(self._section(f"ranks{level}", block * 4, 4), "<u4")[0])
        bits = np.unpackbits(np.frombuffer(self._section(f"bitmap{level}", block * RANK_BITS // 8, (inside + 7) // 8), np.uint8), bitorder="little")
        return before + int(bits[:inside].sum())

    def tokens(self, start: int, count: int) -> np.ndarray:
        """The ids of tokens ``start`` to ``start + count - 1``: one run of each level."""
        if start < 0 or count < 0 or start + count > self.n_tokens:
            raise IndexError(f"tokens {start} to {start + count} of {self.n_tokens}")
        out, where, shift = np.zeros(count, np.uint32), np.arange(count), 0
        for k, width in enumerate(self.widths):
            n = len(where)
            if not n:
                break
            first, skip = divmod(start * width, 8)
            out[where] |= unpack(self._section(f"chunks{k}", first, (skip + n * width + 7) // 8), skip, n, width) << np.uint32(shift)
            shift += width
            if k < len(self.widths) - 1:
                first, skip = divmod(start, 8)
                bits = np.unpackbits(np.frombuffer(self._section(f"bitmap{k}", first, (skip + n + 7) // 8), np.uint8), bitorder="little")
                start, where = self._rank(k, start), where[bits[skip : skip + n] != 0]
        return out

    def token(self, place: int) -> int:
        return int(self.tokens(place, 1)[0])

    def documents(self, first: int = 0, count: int | None = None) -> tuple[list[int | None], np.ndarray]:
        """(ids, first tokens and the end) of ``count`` documents from ``first`` on."""
        count = self.n_docs - first if count is None else min(count, self.n_docs - first)
        ids = np.frombuffer(self._section("docs", first * 8, count * 8), "<i8").tolist()
        if nulls := self._section("nulls", first, count):
            ids = [None if null else d for d, null in zip(ids, nulls)]
        return ids, np.frombuffer(self._section("starts", first * 8, (count + 1) * 8), "<i8")


# --- Spark jobs over files ---


def _opened(path: str):
    files, place = pa.fs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def write_token_files(df: DataFrame, folder: str, doc_id: str = "doc_id", ids: str = "ids", tokens_a_file: int = TOKENS_A_FILE, widths: list[int] | None = None,
                      item_bytes: int = 4) -> None:
    """Write the ids of all rows as token files under ``folder``, in ascending order of doc_id (integers; nulls first), and their manifest.

    ``ids`` are arrays or, ``item_bytes`` each, binary. Rows of one id stand in the order of their ids' number and digest. Null ids are documents without tokens; an empty table
    gives a manifest without files. Of df, ``doc_id`` is read first for the ranges, then all rows once; the rows of one id are one range. ``folder`` must be a place
    that pyarrow opens by its URI (local and shared disks, HDFS, S3, GCS); its manifest is Parquet.
    """
    spark = df.sparkSession
    small_batches(spark)
    packed = df.schema[ids].dataType.typeName() == "binary"
    nothing = F.lit(b"") if packed else F.array().cast("array<int>")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(ids), nothing).alias("ids"))

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where each row's ids start, and the end; all ids) of a batch."""
        offsets = np.frombuffer(lists.buffers()[1], "<i4", len(lists) + 1, 4 * lists.offset)
        if packed:
            data = lists.buffers()[2]
            return offsets // item_bytes, np.frombuffer(data, f"<u{item_bytes}", offsets[-1] // item_bytes) if data else np.empty(0, np.uint16)
        return offsets, lists.values.to_numpy(zero_copy_only=False)

    # Ranges of ids: a few times as many as partitions, so that those are even.
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("b")).head()["b"] or []

    @F.arrow_udf("int")
    def range_of(batch: pa.Array) -> pa.Array:
        return pa.array(np.where(batch.is_null(), 0, np.searchsorted(bounds, batch.fill_null(0).to_numpy())), pa.int32())

    rows = rows.withColumns({"part": range_of("doc_id"), "size": F.length("ids") if packed else F.size("ids"), "tie": F.xxhash64("ids")})
    placed = rows.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "size", "tie").select("doc_id", "ids", "part")
    place = folder.rstrip("/")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, writer = 0, 0, None

        def flush() -> pa.RecordBatch:
            name = f"{place}/tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            files, path = pa.fs.FileSystem.from_uri(name)
            files.create_dir(path.rsplit("/", 1)[0])
            parts = writer.bytes()
            with files.open_output_stream(path) as out:
                for p in parts:
                    out.write(p)
            row = {"part": part, "seq": seq, "path": name, "docs": len(writer.docs), "tokens": writer.starts[-1], "bytes": sum(map(len, parts))}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
        with memory_returned():
            for batch in batches:
                docs, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                ends, every = flat(batch.column(1))
                for k, doc in enumerate(docs):
                    if writer and (parts[k] != part or writer.starts[-1] >= tokens_a_file):
                        yield flush()
                        seq, writer = (seq + 1 if parts[k] == part else 0), None
                    part, writer = parts[k], writer or DacWriter(widths)
                    writer.add(doc, every[ends[k] : ends[k + 1]])
            if writer:
                yield flush()

    placed.mapInArrow(written, "part int, seq int, path string, docs long, tokens long, bytes long").write.parquet(f"{place}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, start, docs, tokens, bytes) of the files, ``start`` being the tokens of all files before."""
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    # One row a file; files are as many as the tokens by tokens_a_file, and partitions of the writing job.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), "docs", "tokens", "bytes")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files that the manifest lists.

    ``start`` is the global place of its first token and ``ids`` the bytes of its ids, little-endian unsigned 32-bit integers. A file is read in runs of documents.
    """
    small_batches(spark)
    manifest = read_manifest(spark, folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            for path, base in ((p, b) for batch in batches for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                with _opened(path) as source:
                    file = DacFile(source.read_at)
                    docs, starts = file.documents()
                    at = 0
                    while at < len(docs):
                        end = max(at + 1, int(np.searchsorted(starts, starts[at] + TOKENS_A_BATCH, "right")) - 1)
                        ids = file.tokens(int(starts[at]), int(starts[end] - starts[at])).astype("<u4")
                        inside = starts[at : end + 1] - starts[at]
                        blobs = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer((inside * 4).astype("<i4")), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays([pa.array(docs[at:end], pa.int64()), pa.array(starts[at:end] + base), pa.array(np.diff(inside)), blobs], schema=schema)
                        at = end

    files = manifest.select("path", "start")
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(tasks, "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, folder: str, positions: DataFrame, position: str = "position", tokens_a_file: int = TOKENS_A_FILE) -> DataFrame:
    """Add ``token``, the id at each global position (long), null where none is; by small reads from the files that hold them.

    Files and positions meet on stretches of ``tokens_a_file`` places. Nulls and positions beyond the tokens stay; repeated positions are looked up each.
    """
    files = read_manifest(spark, folder).where("tokens > 0").select("path", "start", "tokens")
    stretch = F.explode(F.sequence(F.expr(f"start DIV {tokens_a_file}"), F.expr(f"(start + tokens - 1) DIV {tokens_a_file}")))
    own = positions.withColumn("_position", F.col(position).cast("long")).withColumn("_stretch", F.expr(f"_position DIV {tokens_a_file}"))
    on = files.select(stretch.alias("_stretch"), F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("tokens").alias("_tokens"))
    inside = (own["_stretch"] == on["_stretch"]) & (own["_position"] >= on["_start"]) & (own["_position"] < on["_start"] + on["_tokens"])
    found = own.join(on, inside, "left").drop("_stretch").withColumn("_at", F.col("_position") - F.col("_start"))

    @F.arrow_udf("long")
    def looked_up(paths: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for path, at in paths:
            out: list[int | None] = [None] * len(path)
            order = sorted((p, a, k) for k, (p, a) in enumerate(zip(path.to_pylist(), at.to_pylist())) if p is not None)
            name, source = None, None
            for p, a, k in order:
                if p != name:
                    if source:
                        source.close()
                    name, source = p, _opened(p)
                    file = DacFile(source.read_at)
                out[k] = file.token(a)
            if source:
                source.close()
            yield pa.array(out, pa.int64())

    return found.withColumn("token", looked_up("_path", "_at")).drop("_position", "_path", "_start", "_tokens", "_at")


def store_texts(df: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", tokens_a_file: int = TOKENS_A_FILE) -> None:
    """Encode the texts of df and write them as token files under ``folder``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    item_bytes = 2 if _tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    write_token_files(encode_texts(rows, path, item_bytes=item_bytes), folder, tokens_a_file=tokens_a_file, item_bytes=item_bytes)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    store_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
