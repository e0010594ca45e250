"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a hash ring. A row's place on it is a hash of its key and of
its text's checksum and size (so an edited text moves its row, and rows that share a key are
spread); it lies in the arc that ends at the next point clockwise and goes to that point's shard. A shard takes rows up to its
capacity; what overflows continues clockwise to the next points whose shards have room.
With ``slack=0`` the capacities are the even share, so the row counts of any two shards
differ by at most one; with slack, less moves and a shard holds up to (1 + slack) shares.

Rows of one arc are interchangeable, so only the counts of the arcs (shards x vnodes
numbers, whatever the input's size) decide which stretch of which arc goes where. A row's
rank in its arc is the offset of its hash cell plus its place in the cell. Cells are hash
prefixes that grow in number with the rows, so no window sees more than a small share.

Defined results: a null text has size 1 and checksum 0; a null key is a key like any
other; rows alike in key and text are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routegraph.llm.common import bits_for, owner, written


def ring_points(shards: int, vnodes: int) -> tuple[int, list[tuple[int, int]]]:
    """(bits of the ring's grid, sorted (grid slot, shard)); every point has a slot of its own."""
    bits = max(4, (shards * vnodes * 16 - 1).bit_length())
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard {shard} point {v}".encode(), digest_size=8).digest()
            slot = int.from_bytes(digest, "big") >> (64 - bits)
            while slot in taken:
                slot = (slot + 1) % (1 << bits)
            taken[slot] = shard
    return bits, sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill_ring(owners: list[int], counts: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (arc, first rank, end rank, shard, slot of the first) for the counts of the arcs.

    Every arc first fills its own shard; overflow then continues clockwise, arc by arc.
    """
    room, used, out, over = list(caps), [0] * len(caps), [], []

    def place(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            out.append((arc, lo, lo + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return lo + n

    for arc, n in enumerate(counts):
        done = place(arc, 0, n, owners[arc])
        if done < n:
            over.append((arc, done, n))
    for arc, lo, hi in over:
        at = arc
        while lo < hi:
            at = (at + 1) % len(owners)
            lo = place(arc, lo, hi, owners[at])
    return out


@owner
def shard_rows(
    docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0,
    key: str = "doc_id", text: str = "text", cell_rows: int = 20_000,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(key).alias("_key"),
            (F.octet_length(body) + 1).cast("long").alias("_size"),
            F.crc32(F.encode(body, "UTF-8")).alias("_crc"),
        ).withColumn("_hash", F.xxhash64("_key", "_crc", "_size")),
        "shard-rows",
    )
    grid_bits, points = ring_points(shards, vnodes)
    slots, owners = [p for p, _ in points], [s for _, s in points]
    arc_of_slot, arc = [], 0
    for slot in range(1 << grid_bits):
        if arc < len(slots) and slot > slots[arc]:
            arc += 1
        arc_of_slot.append(arc % len(slots))

    total = rows.count()
    cell_bits = bits_for(total, cell_rows, grid_bits)
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_hash", 64 - cell_bits))
    ring = F.lit(arc_of_slot)
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_arc", F.element_at(ring, (F.shiftright("_cell", cell_bits - grid_bits) + 1).cast("int"))
    )
    cells = written(cells, "shard-cells")

    # one number per arc reaches the driver: shards x vnodes of them at most
    counts = [0] * len(points)
    for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():
        counts[r["_arc"]] = r["n"]
    parts = fill_ring(owners, counts, capacities(total, shards, slack))
    # as literal rows: shards x vnodes stretches plus one for each time a shard fills up
    listed = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    plan = spark.range(1).select(F.explode(listed).alias("p")).select(
        *[F.col("p")[i].alias(n) for i, n in enumerate(("_p_arc", "_lo", "_hi", "_shard", "_base"))]
    )

    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        "_cell", "_arc", "_offset"
    )
    inside = Window.partitionBy("_cell").orderBy("_hash", "_key", "_crc", "_size")
    ranked = (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, "_cell")
        .withColumn("_rank", F.col("_offset") + F.col("_in"))
    )
    hit = (F.col("_arc") == F.col("_p_arc")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(F.broadcast(plan), hit).select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_base") + F.col("_rank") - F.col("_lo")).cast("long").alias("slot"),
    )


def op1_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of the query: law ``rows``, so counts differ by one at most."""
    return shard_rows(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
