"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on the ring; the first virtual node clockwise owns it. A shard takes at most its
capacity; keys beyond it continue clockwise to the next virtual node whose shard has room. Keys are
admitted in ring order, so the walk of a key depends only on its arc (the stretch before one virtual
node). Hence arcs, not keys, are balanced: count the keys of each arc, walk the bounded table of
``shards x virtual_nodes`` arcs once, and give each arc rank ranges in its shards. Keys then find their
shard and slot by their rank in the arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, read

RING_BITS = 60
CELL_BITS = 14


def ring_place(key: Column) -> Column:
    """Place of a key on the ring: 60 bits of the MD5 of its text (null: empty text)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, RING_BITS // 4), 16, 10).cast("long")


def virtual_nodes(shards: int, per_shard: int) -> list[tuple[int, int]]:
    """Sorted (place, shard) of all virtual nodes."""
    nodes = {}
    for shard in range(shards):
        for replica in range(per_shard):
            digest = hashlib.md5(f"shard-{shard}#{replica}".encode()).hexdigest()
            nodes.setdefault(int(digest[: RING_BITS // 4], 16), shard)
    return sorted(nodes.items())


def _cells(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Arcs cut at cell borders: (cell, low, high, arc), low <= place < high. Size: cells + virtual nodes."""
    width = 1 << (RING_BITS - CELL_BITS)
    ends = [place + 1 for place, _ in nodes]
    out, low, arc = [], 0, 0
    while low < 1 << RING_BITS:
        cell = low // width
        high = min((cell + 1) * width, ends[arc] if arc < len(ends) else 1 << RING_BITS)
        out.append((cell, low, high, arc % len(nodes)))
        low = high
        while arc < len(ends) and ends[arc] <= low:
            arc += 1
    return out


def admit(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges (arc, first rank, end rank, shard, first slot). Capacities differ by one at most and add up to all keys."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out = []
    for arc in sorted(counts):
        left, rank, step = counts[arc], 0, arc
        while left:
            shard = nodes[step % len(nodes)][1]
            taken = min(left, room[shard] - filled[shard])
            if taken:
                out.append((arc, rank, rank + taken, shard, filled[shard]))
                filled[shard] += taken
                rank += taken
                left -= taken
            step += 1
    return out


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small literal table as one SQL expression."""
    data = ";".join(",".join(map(str, row)) for row in rows)
    columns = [F.get(F.col("_f"), i).cast("long").alias(n) for i, n in enumerate(names.split())]
    lines = F.filter(F.split(F.lit(data), ";"), lambda x: x != "")
    return spark.range(1).select(F.explode(lines).alias("_l")).select(F.split("_l", ",").alias("_f")).select(*columns)


def shard_by_ring(
    df: DataFrame, key: str = "doc_id", shards: int = 24, virtual: int = 128, tie_breakers: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard); shard row counts differ by one at most.

    Nulls: a null key counts as the empty text, so its row is placed like any other. Repeated rows and repeated
    keys each take a slot of their own, ordered by key and then tie_breakers. An empty table gives an empty result. Columns of df are all
    kept; if df already has ``shard`` or ``slot``, the new ones get a leading underscore.
    Pass a narrow df (ids, sizes, digests): its rows are shuffled once by arc. The ring tables that are broadcast or
    walked on the driver have at most 2^14 + shards x virtual rows, whatever the size of df.
    """
    spark = df.sparkSession
    nodes = virtual_nodes(shards, virtual)
    place, arc, rank, out_shard, out_slot = fresh(df, "_place", "_arc", "_rank", "shard", "slot")
    cells = _table(spark, _cells(nodes), "_c_cell _c_low _c_high _c_arc")
    placed = df.withColumn(place, ring_place(F.col(key)))
    in_cell = (F.shiftright(F.col(place), RING_BITS - CELL_BITS) == F.col("_c_cell")) & (
        F.col(place) >= F.col("_c_low")
    ) & (F.col(place) < F.col("_c_high"))
    placed = placed.join(F.broadcast(cells), in_cell, "inner").withColumnRenamed("_c_arc", arc)
    placed = cut(placed.drop("_c_cell", "_c_low", "_c_high"))
    counts = {row[0]: row[1] for row in placed.groupBy(arc).count().collect()}
    ranges = _table(spark, admit(counts, nodes, shards), "_r_arc _r_from _r_to _r_shard _r_slot")
    order = Window.partitionBy(arc).orderBy(place, key, *tie_breakers)
    ranked = placed.withColumn(rank, F.row_number().over(order) - 1)
    hit = (F.col(arc) == F.col("_r_arc")) & (F.col(rank) >= F.col("_r_from")) & (F.col(rank) < F.col("_r_to"))
    return (
        ranked.join(F.broadcast(ranges), hit, "inner")
        .withColumn(out_shard, F.col("_r_shard").cast("int"))
        .withColumn(out_slot, F.col("_r_slot") + F.col(rank) - F.col("_r_from"))
        .select(*df.columns, out_shard, out_slot)
    )


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shard_by_ring(rows, "doc_id", shards=24, tie_breakers=("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
