"""Rows found by their keys without a shuffle of the table that they stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap of keys (8 MB), and of each of its rows.
BITS, ROW_BITS = 1 << 26, 1 << 15


def likely(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of df whose key (columns of the same names and types) is among keys, and some others: a bitmap of hashes is broadcast, of BITS at most.

    Join again where other rows matter.
    """
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(BITS))
    row, bit = (at / ROW_BITS).cast("long"), F.pmod(at, F.lit(ROW_BITS))
    bitmap = keys.groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(bitmap), (row == F.col("_row")) & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1), "left_semi")
