"""A consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A document's key hash picks its cell; the next virtual
node clockwise owns the cell. No shard may hold more than its bound: keys that overflow a
full shard go on clockwise to the next node whose shard has room. With no slack the bounds
add up to the number of rows, so counts differ by one at most.

Only counts of cells come to the driver (as many as there are cells, at any input size);
there the walk is done over arcs, not keys. Rows are then numbered inside their cells, one
narrow shuffle by cell, and each cell's rows are mapped to shards by ranges of that number.
All of it is DataFrame operations.

Defined results: a null text has no bytes and the checksum of no bytes; a null id is hashed
as such, together with the text's checksum, so rows without ids spread; repeated rows are
placed each, and a cell that holds very many of them is numbered in parts; an empty table
gives no rows; a text of any length counts whole; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorvia.llm.common import cut

#: Cells of the ring, a power of two: bounds what the driver counts and what is broadcast (about 3 MB).
CELL_BITS = 16
VIRTUAL_NODES = 64
#: A cell is hot if it holds more than this and more than its share of one in HOT_CELLS; it is numbered in so many parts.
HOT_ROWS, HOT_CELLS, HOT_PARTS = 10_000, 256, 64


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; a node on a taken cell goes to the next free one."""
    cells = 1 << cell_bits
    if n_shards < 1 or n_shards * virtual_nodes > cells:
        raise ValueError("the ring has too few cells for so many nodes")
    taken: dict[int, int] = {}
    for v in range(virtual_nodes):
        for shard in range(n_shards):
            at = xxhash.xxh64_intdigest(f"{shard}/{v}") >> (64 - cell_bits)
            while at in taken:
                at = (at + 1) % cells
            taken[at] = shard
    return sorted(taken.items())


def bounds(total: int, n_shards: int, slack: float) -> list[int]:
    """The most rows of each shard."""
    if slack > 0:
        return [-int(-(1 + slack) * total // n_shards)] * n_shards
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def walk(counts: dict[int, int], n_shards: int, virtual_nodes: int, cell_bits: int, slack: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Ranges (cell, first row, last row + 1, shard, slot of the first row, hops) for rows by cell."""
    nodes = ring(n_shards, virtual_nodes, cell_bits)
    places = [cell for cell, _ in nodes]
    cells_of: list[list[int]] = [[] for _ in nodes]
    for cell in sorted(counts):
        cells_of[bisect_left(places, cell) % len(nodes)].append(cell)
    room = bounds(sum(counts.values()), n_shards, slack)
    left = {arc: n for arc, cells in enumerate(cells_of) if (n := sum(counts[c] for c in cells))}
    quotas: dict[int, list[list[int]]] = {arc: [] for arc in left}
    hop = 0
    while left:  # everyone's first node, then everyone's second, and so on round the ring
        for arc in list(left):
            shard = nodes[(arc + hop) % len(nodes)][1]
            if take := min(left[arc], room[shard]):
                quotas[arc].append([shard, take, hop])
                room[shard] -= take
                left[arc] -= take
                if not left[arc]:
                    del left[arc]
        hop += 1
    slots = [0] * n_shards
    for arc, given in quotas.items():
        given.reverse()
        for cell in cells_of[arc]:
            at = 0
            while at < counts[cell]:
                shard, room_left, hops = given[-1]
                n = min(room_left, counts[cell] - at)
                yield cell, at, at + n, shard, slots[shard], hops
                slots[shard] += n
                at += n
                given[-1][1] -= n
                if not given[-1][1]:
                    given.pop()


def shard_documents(
    docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS, slack: float = 0.0
) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, shard, slot (gapless in the shard), hops
    (nodes passed because they were full).

    slack: share by which a shard may exceed the mean; more slack, fewer hops.
    """
    utf8 = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("cell", F.shiftrightunsigned("hash", 64 - cell_bits).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    most = max(HOT_ROWS, sum(counts.values()) // HOT_CELLS)
    hot = sorted(c for c, n in counts.items() if n > most)
    rows = rows.withColumn("part", F.lit(0))
    firsts = [(c, 0, 0) for c in counts]
    if hot:
        # repeated rows hash alike: such a cell is numbered in parts, by where its rows lie, as written once
        rows = cut(rows.withColumn("part", F.when(F.col("cell").isin(hot), F.pmod(F.spark_partition_id(), F.lit(HOT_PARTS))).otherwise(0)), "sharding-rows")
        parts = {(r["cell"], r["part"]): r["count"] for r in rows.where(F.col("cell").isin(hot)).groupBy("cell", "part").count().collect()}
        at = dict.fromkeys(hot, 0)
        firsts = [(c, 0, 0) for c in counts if c not in at]
        for (cell, part), n in sorted(parts.items()):
            firsts.append((cell, part, at[cell]))
            at[cell] += n
    spark = docs.sparkSession
    ranges = list(walk(counts, n_shards, virtual_nodes, cell_bits, slack))
    plan = spark.createDataFrame(ranges, "cell int, low long, high long, shard int, first_slot long, hops int")
    number = F.row_number().over(Window.partitionBy("cell", "part").orderBy("hash", "doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("number", number)
    if hot:
        numbered = numbered.join(F.broadcast(spark.createDataFrame(firsts, "cell int, part int, first long")), ["cell", "part"]).withColumn("number", F.col("number") + F.col("first"))
    return (
        numbered.join(F.broadcast(plan), "cell")
        .where("number >= low and number < high")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("number") - F.col("low")).alias("slot"), "hops")
    )
