"""Histogram sort into shards of near-equal bytes, in DataFrame functions only.

The sort key is the text's crc32 and then a hash of the id, so equal texts are neighbours. Splitters between shards are found by counting the
exact bytes below candidate keys: each pass counts, for the key ranges that still hold a splitter, the bytes of up to 2 ** FAN_BITS parts, and
keeps the part the splitter lies in, until an edge is within the tolerance. Edges fall between different crc32 values, so equal texts share a
shard, unless a group is so large that sizes could not be near equal; only such a group is split, by the hash of the id. Then rows move once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textquarry.llm.scratch import stored

N_SHARDS = 40
#: A splitter is good when the bytes below it differ from its target by at most this part of a shard.
TOLERANCE = 0.005
ROW_BYTES = 16
KEY_BITS, ID_BITS = 63, 31
#: Bits of the key that are left open after each pass; ID_BITS among them, so that crc32 values are told apart before ids.
LEVELS = (51, 41, 31, 21, 10, 0)


def _crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _key(crc: Column) -> Column:
    return F.shiftleft(crc, ID_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of each row."""
    rows = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + ROW_BYTES).cast("long").alias("size"), _crc32().alias("text_crc32"))
    return rows.withColumn("key", _key(F.col("text_crc32")))


def splitters(rows: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """n_shards - 1 ascending keys; shard i holds the keys from splitter i - 1 on and below splitter i. `rows` has (key, size).

    A pass brings back at most (n_shards - 1) * 2 ** 12 sums, whatever the input.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * i / n_shards for i in range(1, n_shards)]
    near = tolerance * total / n_shards
    found: dict[int, int] = {}
    inside: dict[int, tuple[int, int]] = dict.fromkeys(range(n_shards - 1), (0, 0))  # of each open splitter: the part it lies in, bytes below it
    above = KEY_BITS
    for level in LEVELS:
        parts = sorted({p for p, _ in inside.values()})
        mine = rows if above == KEY_BITS else rows.where(F.shiftright("key", above).isin(parts))
        sums = defaultdict(list)
        for part, size in sorted(mine.groupBy(F.shiftright("key", level).alias("part")).agg(F.sum("size").alias("size")).collect()):
            sums[part >> (above - level)].append((part, size))
        for i, (parent, below) in list(inside.items()):
            edges, best = below, None
            for part, size in sums[parent]:
                for edge, at in ((part, edges), (part + 1, edges + size)):
                    gap = abs(at - targets[i])
                    if best is None or gap < best[0]:
                        best = gap, edge << level
                if edges + size >= targets[i]:
                    inside[i] = part, edges
                    break
                edges += size
            if best is None or best[0] <= near or level == 0:
                found[i] = best[1] if best else 0
                del inside[i]
        above = level
        if not inside:
            break
    return sorted(found.values())


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are at most `key`, by nested halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(bounds)).cast("int")


def shards(docs: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, size (bytes of the text + 16), text_crc32, shard, slot (0, 1, ... by key in each shard).

    A null text counts as empty; null ids and repeated rows each get a slot of their own. An empty table gives no rows; with fewer rows than
    shards some shards stay empty. Other columns of `docs` are ignored.
    """
    rows = stored(sized(docs))
    placed = rows.withColumn("shard", shard_of(F.col("key"), splitters(rows, n_shards, tolerance)))
    slot = F.row_number().over(Window.partitionBy("shard").orderBy("key", "doc_id")) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE) -> None:
    """Writes the rows of `docs`, all columns, as one folder shard=N each, sorted by key: the one exchange that moves texts."""
    rows = stored(sized(docs))
    bounds = splitters(rows, n_shards, tolerance)
    own = docs.withColumn("textquarry_key", _key(_crc32()))
    own = own.withColumn("shard", shard_of(F.col("textquarry_key"), bounds)).repartition(n_shards, "shard").sortWithinPartitions("shard", "textquarry_key", "doc_id")
    own.drop("textquarry_key").write.partitionBy("shard").parquet(path)


def shard_index(key: int, bounds: list[int]) -> int:
    """shard_of for one key."""
    return bisect_right(bounds, key)
