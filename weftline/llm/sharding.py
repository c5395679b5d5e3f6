"""Shards of nearly equal bytes that keep equal texts together: minimax cuts of an ordered sequence of atomic groups.

Groups are texts, in the order of a 64-bit hash, so neighbours in it are unrelated. The smallest capacity with which
consecutive groups fit into the shards is found by binary search, checked greedily on prefix sums, and the cuts are
made under it. The driver holds sums of units, ranges of the hash, never of all groups: a unit is split further
only where it may hold a cut for a capacity still in question, until each such unit is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release
from weftline.llm.scan import running

SHARDS, OVERHEAD = 40, 16
#: Bits of the hash that units start with, and by which one that may hold a cut is split.
FIRST_BITS, MORE_BITS = 16, 8


def group_sizes(rows: DataFrame) -> DataFrame:
    """(key, size): the bytes of each group; copies are summed before the shuffle."""
    return rows.groupBy("key").agg(F.sum("size").alias("size"))


def _units(groups: DataFrame, width: int) -> np.ndarray:
    """Rows (first hash, log2 of the width, bytes, most bytes of a group, its hash, groups) of units, in order."""
    found = groups.withColumn("start", F.expr(f"shiftleft(shiftright(key, {width}), {width})")).groupBy("start")
    rows = found.agg(F.lit(width), F.sum("size"), F.max("size"), F.max_by("key", F.struct("size", "key")), F.count("*")).collect()
    return np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 6)


def greedy(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """How many units each of ``shards`` shards ends with at most, filled one after another; ``ends`` are prefix sums."""
    cuts, full = np.zeros(shards, np.int64), 0
    for s in range(shards):
        cuts[s] = np.searchsorted(ends, full + capacity, side="right")
        full = int(ends[cuts[s] - 1]) if cuts[s] else 0
    return cuts


def reach(ends: np.ndarray, sizes: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Bytes that each shard ends with at most, if units that aren't ``whole`` groups could be cut anywhere."""
    out, full, total = np.zeros(shards, np.int64), 0, int(ends[-1])
    for s in range(shards):
        full = min(full + capacity, total)
        unit = int(np.searchsorted(ends, full, side="right"))
        if unit < len(ends) and whole[unit]:
            full = int(ends[unit] - sizes[unit])
        out[s] = full
    return out


def smallest(low: int, high: int, fits) -> int:
    """The smallest integer in the range for which ``fits`` (which then stays true) holds; ``high`` does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def capacities(sizes: np.ndarray, whole: np.ndarray, shards: int) -> tuple[int, int]:
    """Least capacity by which shards may do, and the least by which they do with cuts between the units."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    high = smallest(int(max(sizes.max(), -(-total // shards))), total, lambda c: greedy(ends, c, shards)[-1] == len(ends))
    low = smallest(int(max(sizes[whole].max(initial=0), -(-total // shards))), high, lambda c: reach(ends, sizes, whole, c, shards)[-1] == total)
    return low, high


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Units before each shard's end: as near to equal parts as can be with ``capacity``, which is one that does."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    total, need = int(ends[-1]), np.zeros(shards, np.int64)
    need[-1] = len(sizes)
    for s in range(shards - 2, -1, -1):  # the least that must be in the shards up to here, for the others to hold the rest
        need[s] = np.searchsorted(ends, ends[need[s + 1]] - capacity, side="left")
    out, at = np.zeros(shards, np.int64), 0
    for s in range(shards):
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        ideal = total * (s + 1) / shards
        near = int(np.searchsorted(ends, ideal))
        near -= bool(near and ideal - ends[near - 1] <= ends[min(near, len(sizes))] - ideal)
        out[s] = at = min(max(near, int(need[s]), at), most)
    return out


def _split(groups: DataFrame, units: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``units`` with the chosen ones split by more bits; a row of the broadcast table is a chosen unit."""
    spark = groups.sparkSession
    parts = []
    for width in np.unique(units[chosen, 1]).tolist():
        starts = units[chosen & (units[:, 1] == width), 0].tolist()
        listed = spark.createDataFrame([(s,) for s in starts], "unit long")
        inside = groups.withColumn("unit", F.expr(f"shiftleft(shiftright(key, {width}), {width})")).join(F.broadcast(listed), "unit", "left_semi").drop("unit")
        parts.append(_units(inside, max(width - MORE_BITS, 0)))
    out = np.concatenate([units[~chosen], *parts])
    return out[np.argsort(out[:, 0], kind="stable")]


def plan(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS) -> tuple[int, list[int], list[int]]:
    """(capacity, keys, alone): groups (key, size) of each shard by key: up to ``keys[0]``, up to ``keys[1]`` and so on.

    Groups of more bytes than an equal part of the rest have a shard of their own (``alone``, the largest first), as
    no cut can help; the capacity is that of the other shards. Without groups there are no cuts.
    """
    units = _units(groups, 64 - first_bits)
    alone: list[int] = []
    while len(units):
        rest, left = int(units[:, 2].sum()), shards - len(alone)
        top = int(np.argmax(units[:, 3]))
        if left == 1 or int(units[top, 3]) * left <= rest or units[:, 5].sum() == 1:
            break
        key, several = int(units[top, 4]), units[top, 5] > 1
        alone.append(key)
        groups = groups.where(F.col("key") != key)
        units = _split(groups, units, np.arange(len(units)) == top) if several else np.delete(units, top, axis=0)
    if not len(units):
        return 0, [], alone
    left = shards - len(alone)
    while True:
        sizes, whole = units[:, 2], (units[:, 5] == 1) | (units[:, 1] == 0)
        low, high = capacities(sizes, whole, left)
        ends = np.cumsum(sizes)
        unsure = ~whole & (sizes > 4 * max(ends[-1] >> FIRST_BITS, 1))  # far from the others: it alone would keep the bounds apart
        if low < high or not whole.all():
            begins = ends - sizes
            # a shard ends somewhere from what it reaches at least to what it reaches at most, counted from either side
            for e, b, w in ((ends, begins, whole), (ends[-1] - begins[::-1], ends[-1] - ends[::-1], whole[::-1])):
                own = e - b
                least = np.concatenate(([0], e))[greedy(e, low, left)]
                most = reach(e, own, w, high, left)
                hit = np.zeros(len(e) + 1, np.int64)
                np.add.at(hit, np.searchsorted(e, least, side="right"), 1)
                np.add.at(hit, np.searchsorted(b, most, side="left"), -1)
                touched = (np.cumsum(hit)[:-1] > 0) & ~w
                unsure |= touched if w is whole else touched[::-1]
        if not unsure.any():
            break
        units = _split(groups, units, unsure)
    cuts = even_cuts(sizes, high, left)
    last = units[:, 0] + (np.int64(1) << units[:, 1].clip(max=62)) - 1
    return high, [int(last[c - 1]) if c else -(2**63) for c in cuts[:-1].tolist()], alone


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(order column, size, text_crc32, shard, slot) of every row: equal texts share a shard, shards have nearly equal bytes.

    ``size`` is the text's bytes (null: none) and ``overhead``. ``slot`` counts a shard's rows from 0, by hash of the
    text, then ``order`` (nulls first). Null and empty texts are one group. Fewer groups than shards leave shards
    empty. Texts of equal 64-bit hashes are treated as equal. No rows: no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(order, (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("key")), "rows")
    groups = materialize(group_sizes(rows), "groups")
    _, keys, alone = plan(groups, shards)
    release(groups)
    shard = F.lit(0)
    for k in keys:  # one comparison a shard
        shard = shard + F.when(F.col("key") > k, 1).otherwise(0)
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, shards - 1 - i).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("_tie", F.monotonically_increasing_id())
    placed = running(dealt, "shard", ["key", F.col(order).asc_nulls_first(), "_tie"], slot=F.lit(1))
    return placed.select(order, "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def digests(docs: DataFrame) -> DataFrame:
    """``assign``'s rows of ``documents`` with the law that holds, and no shard for one more."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
