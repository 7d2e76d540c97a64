"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder  # noqa: F401
from ..functions.lookup import likely

#: A table of ids is broadcast up to so many rows (a few dozen bytes each), and joined by a shuffle beyond.
MAX_BROADCAST_IDS = 500_000

#: Bytes of texts in one Arrow batch, of which a task and its Python worker hold a few at a time.
BATCH_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet (Spark matches names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of the id written as decimal text; null ids count as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def texts_in(batch: pa.Array, at_once: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow batch one by one, so that few of them stand in memory twice."""
    for start in range(0, len(batch), at_once):
        yield from batch.slice(start, at_once).to_pylist()


def few(ids: DataFrame) -> DataFrame:
    """A table of ids for a join, to be broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id (a column of the same name) is among ids, without a shuffle of df; of more than MAX_BROADCAST_IDS ids, some other rows too.

    Few ids are broadcast, else a bitmap of their hashes is. Join again where other rows matter.
    """
    (name,) = ids.columns
    ids = ids.distinct()
    return df.join(F.broadcast(ids), name, "left_semi") if ids.count() <= MAX_BROADCAST_IDS else likely(df, ids)


@contextmanager
def memory_returned() -> Iterator[None]:
    """What the block frees goes back to the system, as Spark keeps idle Python workers beside those that work."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES, unless the user has set one; the rows in a batch follow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own
        spark.conf.set(key, f"{BATCH_BYTES}b")
