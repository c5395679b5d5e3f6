"""N-gram Jaccard join with groups of identical prefixes, and its components.

Two texts link when the Jaccard likeness of their sets of five-word shingles is at least
``percent`` / 100. In one order over all shingles, two such sets share a shingle within
their prefixes. The order is by the cells of a count table of fixed size, rare cells
first, then by hash, so common passages rarely stand in a prefix; it bears on speed alone.

1. Texts with one set are one class; classes with one size and prefix are one group, of at
   most ``BLOCK`` classes (larger ones are dealt to several groups).
2. Groups meet at their prefix shingles; meetings without a partner of fitting size are
   dropped. Where more than ``BLOCK`` classes meet at a shingle, as counted there, they are
   cut by size into blocks, and pairs of blocks of fitting sizes meet.
3. What is left is expanded to classes with bit signatures as long as their sets, whose
   differing bits bound the sets' difference from below. Pairs that pass tie classes to
   clusters; only spanning stars leave a task, never all pairs.
4. The sets of clustered classes are compared exactly: a breadth-first search compares each
   member with those not yet reached. Clusters beyond ``CLUSTER`` members or ``WEIGHT``
   shingles are cut into blocks, each compared within itself and with a few leaders of the
   whole cluster; where that doesn't tie all of a cluster together, all pairs of its blocks
   are compared.

No link is lost: a pair of likeness >= percent meets in step 2, passes the bound in step 3
and so lies in one cluster. Texts with one set share all of this work, however many there are.
Grouped work is streamed from sorted partitions one bounded unit after another, so what a
task holds does not depend on the input or on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import BLOCK_BYTES, blocks, bounded, materialize, release, shuffle_partitions, texts, whole_units
from weftline.llm.components import components, stars
from weftline.llm.packed import pack, unpack
from weftline.llm.tokens import mix, shingle_sets

PERCENT = 80
WIDTH = 5
CELLS_LOG = 20  # of the count table: 2^20 counts, 8 MB
SLICES = 16
FAN = 64  # tables that are added up at once
ENTRIES = 500_000  # prefix entries of a part, on average
LONG_LIST = 1 << 20  # rows beyond the usual in a cell, from which a shingle's list is dealt to several parts
BLOCK = 8192  # classes in a block of a shingle's list
LEADERS = 16
CLUSTER = 1024
WEIGHT = 1_500_000  # shingles of a cluster in one unit
AT_ONCE = 1_000_000
SHORTEST = 9  # log2 of the bits of the shortest signature
SHORT = 64  # meetings of up to so many classes are compared as one array of pairs
PAIR_WORDS = 800_000  # signature words that are compared at once
DESCRIBED = "tie long, doc_id long, n long, set_key long, group_key long, prefix binary, signature binary"


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS_LOG)).astype(np.int64)


def file_row(df: DataFrame) -> Column | None:
    """A key for each row of a plain scan of files, the same in each reading; None where ``df`` has none."""
    try:
        key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        df.select(key).schema
        return key
    except AnalysisException:
        return None


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A written copy of ``df`` with a key for each row."""
    return materialize(df.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def source(df: DataFrame, id_col: str, text_col: str, row: Column, tie: Column | None = None) -> DataFrame:
    """doc_id, text, row and tie; ``row`` is a key of its own for each row, that has to be the same in each reading."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"))


def count_table(rows: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How often the shingles of each cell occur (once per text). Its size does not depend on the input.

    Each task counts its own texts; tables are added up ``FAN`` at a time, level by level.
    """
    step = (1 << CELLS_LOG) // SLICES
    kind = "slice int, task long, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << CELLS_LOG, np.int64)
        for block in blocks(batches):
            found = shingle_sets(texts(block), width)
            table += np.bincount(cell(np.concatenate(found)), minlength=len(table))
        task = TaskContext.get().partitionId()
        counts = [pack(table[i * step : (i + 1) * step]) for i in range(SLICES) if table[i * step : (i + 1) * step].any()]
        places = [i for i in range(SLICES) if table[i * step : (i + 1) * step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([task] * len(places), pa.int64()), pa.array(counts, pa.binary())], ["slice", "task", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(unpack(c, "<i8") for c in group.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([pack(total)], pa.binary())})

    tables = bounded(rows.select("text")).mapInArrow(run, kind)
    n = rows.rdd.getNumPartitions()
    while True:
        n = -(-n // FAN)
        tables = tables.withColumn("task", (F.col("task") / FAN).cast("long")).groupBy("slice", "task").applyInArrow(add, kind)
        if n <= 1:
            break
    out = np.zeros(1 << CELLS_LOG, np.int64)
    for r in tables.collect():  # SLICES rows
        out[r["slice"] * step : (r["slice"] + 1) * step] += unpack(bytes(r["counts"]), "<i8")
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` of which a set that links with it has at least one in its own prefix."""
    return n - -(-percent * n // 100) + 1


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of sets that can link at all."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def bits_log(n: np.ndarray) -> np.ndarray:
    """log2 of the number of signature bits of sets of ``n`` shingles: about as many bits as shingles, up to twice."""
    return np.maximum(SHORTEST, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by hash: two sets differ in at least as many shingles as bits.

    Bit k of a signature of half the length is the sum of bits k and k + half, so signatures
    of different lengths compare at the shorter one.
    """
    size = 1 << int(bits_log(np.array([len(shingles)]))[0])
    bits = np.bincount((mix(shingles) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def set_key(shingles: np.ndarray) -> int:
    return int(mix(mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def describe(rows: DataFrame, table: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """For each row: size, class (hash of the set), group (hash of size and prefix), prefix, signature; nulls without words."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kind = T.StructType([rows.schema["row"], *T.StructType.fromDDL(DESCRIBED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for block in blocks(batches):
            out = []
            for own in shingle_sets(texts(block), width):
                n = len(own)
                if n:
                    prefix = own[np.lexsort((own, counts[cell(own)]))[: prefix_length(n, percent)]]
                    out.append((n, set_key(own), set_key(np.append(prefix, np.uint64(n))), pack(prefix), signature(own)))
                else:
                    out.append((0, None, None, None, None))
            made = [pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*out))]
            given = [block.column(block.schema.get_field_index(c)) for c in ("row", "tie", "doc_id")]
            yield pa.RecordBatch.from_arrays([*given, *made], kind.names)

    return bounded(rows).mapInArrow(run, kind)


def fitting_blocks(sizes: np.ndarray, weights: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """Pairs (from, to, from, to) of blocks of a list in order of size, of about ``BLOCK`` classes each, that may hold links.

    A block without a partner of fitting size is paired with nothing (0, 0).
    """
    block = (np.cumsum(weights) - weights) // BLOCK
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)])).tolist()
    spans = list(zip(cuts, cuts[1:]))
    out = []
    for i, (s, e) in enumerate(spans):
        others = [(s, e, x, y) for x, y in spans[i + 1 :] if int(sizes[e - 1]) * 100 >= int(sizes[x]) * percent]
        out += others or [(s, e, 0, 0)]
    return out


def meetings(groups: DataFrame, table: np.ndarray, percent: int, parts: int) -> DataFrame:
    """(place, group_key): groups that share a prefix shingle with a group of fitting size.

    ``groups``: group_key, n, weight (classes), prefix. ``place`` is the shingle; of a long
    list, the shingle and a pair of blocks. How long a list is is counted where it is; only
    lists that the count table shows to be far beyond a part are dealt to several parts before.
    """
    shared = groups.sparkSession.sparkContext.broadcast(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        usual = 4 * counts.sum() // len(counts)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owners, sizes, weights = [], [], [], []
            for group, n, weight, prefix in zip(*(batch.column(c).to_pylist() for c in ("group_key", "n", "weight", "prefix"))):
                own = unpack(prefix, "<u8")
                split = np.maximum(counts[cell(own)] - usual, 0) // LONG_LIST + 1
                whole = own[split == 1]
                keys.append(whole)
                for s, k in zip(own[split > 1], split[split > 1].tolist()):
                    mine = int(mix(np.array([group], np.int64).view(np.uint64) ^ s)[0] % np.uint64(k))
                    other = np.arange(k)
                    pair = (np.minimum(other, mine) * k + np.maximum(other, mine) + 1).astype(np.uint64)
                    keys.append(mix(s + mix(pair)))
                total = len(whole) + int(split[split > 1].sum())
                owners.append(np.full(total, group))
                sizes.append(np.full(total, n))
                weights.append(np.full(total, weight))
            keys, owners, sizes, weights = map(np.concatenate, (keys, owners, sizes, weights))
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            own = [order[s:e] for s, e in zip(np.append(0, cut), np.append(cut, len(order)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[o[0]]) for o in own], pa.int32()), *(pa.array([pack(x[o]) for o in own], pa.binary()) for x in (keys, owners, sizes.astype("<u4"), weights.astype("<u4")))],
                ["part", "keys", "owners", "sizes", "weights"],
            )

    def meet(group: pa.Table) -> pa.Table:
        def read(c: str, kind: str) -> np.ndarray:
            return np.concatenate([unpack(r, kind) for r in group.column(c).to_pylist()])

        keys, sizes = read("keys", "<u8"), read("sizes", "<u4")
        order = np.lexsort((sizes, keys))
        keys, sizes = keys[order], sizes[order].astype(np.int64)
        near = (keys[1:] == keys[:-1]) & fits(sizes[1:], sizes[:-1], percent)  # by size, the next one is the nearest
        kept = np.zeros(len(keys), bool)
        kept[1:] |= near
        kept[:-1] |= near
        keys, sizes, owners, weights = keys[kept], sizes[kept], read("owners", "<i8")[order[kept]], read("weights", "<u4")[order[kept]].astype(np.int64)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        long = np.add.reduceat(weights, starts) > BLOCK if len(starts) else np.empty(0, bool)
        plain = ~np.repeat(long, ends - starts)
        places, found = [keys[plain]], [owners[plain]]
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            for i, (a, b, x, y) in enumerate(fitting_blocks(sizes[s:e], weights[s:e], percent)):
                both = np.concatenate((owners[s + a : s + b], owners[s + x : s + y]))
                found.append(both)
                places.append(np.full(len(both), mix(keys[s : s + 1] + mix(np.array([i + 1], np.uint64)))[0]))
        return pa.table({"place": pa.array(np.concatenate(places).view(np.int64)), "group_key": pa.array(np.concatenate(found))})

    posted = bounded(groups.select("group_key", "n", "weight", "prefix")).mapInArrow(post, "part int, keys binary, owners binary, sizes binary, weights binary")
    return posted.groupBy("part").applyInArrow(meet, "place long, group_key long")


def near_pairs(sizes: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may link by size and signature: the sets' difference is at most (100-p)/(100+p) of their sizes' sum."""
    ok = fits(sizes[a], sizes[b], percent)
    at = np.flatnonzero(ok)
    differing = np.bitwise_count(bits[a[at]] ^ bits[b[at]]).sum(1, dtype=np.int64)
    ok[at] = differing * (100 + percent) <= (sizes[a[at]] + sizes[b[at]]) * (100 - percent)
    return ok


def near_ties(place: np.ndarray, key: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties (a, b) among classes that stand at one place, in order of place; their components join all pairs that may link."""
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    length = np.diff(np.append(starts, len(place)))
    found: list[tuple[np.ndarray, np.ndarray]] = [(key[:0], key[:0])]
    for m in np.unique(length[(length > 1) & (length <= SHORT)]).tolist():
        i, j = np.triu_indices(m, 1)
        own = starts[length == m]
        step = max(1, PAIR_WORDS // (len(i) * bits.shape[1]))
        for s in range(0, len(own), step):
            at = own[s : s + step, None]
            a, b = (at + i).ravel(), (at + j).ravel()
            ok = near_pairs(n, bits, a, b, percent)
            found.append((key[a[ok]], key[b[ok]]))
    for s, m in zip(starts[length > SHORT].tolist(), length[length > SHORT].tolist()):
        left = np.arange(s, s + m)
        while len(left):  # each search reaches all that its first class may be tied to
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                ok = np.concatenate([near_pairs(n, bits, np.full(len(some), at), some, percent) for some in np.array_split(left, -(-len(left) * bits.shape[1] // PAIR_WORDS))])
                found.append((np.full(int(ok.sum()), key[at]), key[left[ok]]))
                queue += left[ok].tolist()
                left = left[~ok]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes whose components join all pairs that may link; ``met``: place, set_key, n, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in whole_units(batches, "place"):
            place, key, n = (unit.column(c).to_numpy() for c in ("place", "set_key", "n"))
            signatures = unit.column("signature").to_pylist()
            level = bits_log(n)
            # a set just above a length of signature may link with sets of the length below, at that length
            low = np.flatnonzero((level > SHORTEST) & (n * percent <= 100 << (level - 1)))
            ties = []
            for k in np.unique(level).tolist():
                whole, folded = np.flatnonzero(level == k), low[level[low] == k + 1]
                at = np.append(whole, folded)
                raw = [signatures[i] for i in whole]
                for i in folded:
                    long = np.frombuffer(signatures[i], np.uint8)
                    raw.append((long[: len(long) // 2] ^ long[len(long) // 2 :]).tobytes())
                order = np.lexsort((key[at], place[at]))
                bits = np.frombuffer(b"".join(raw), np.uint64).reshape(len(at), -1)[order]
                at = at[order]
                ties.append(near_ties(place[at], key[at], n[at].astype(np.int64), bits, percent))
            a, b = stars(*(np.concatenate([t[i] for t in ties]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a long, b long")


def linked(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the exact links among sets: each member is compared with all not yet reached.

    Common shingles are counted by an inverted list, ``AT_ONCE`` entries at a time. ``sets`` is emptied.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    size = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    sets.clear()
    ends = np.cumsum(size)
    by = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[by]
    flat = flat[by]
    new = np.append(True, flat[1:] != flat[:-1])
    del flat
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(new)))
    number = np.empty(len(new), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    del by, new
    left = np.ones(len(size), bool)
    a, b = [], []
    for k in range(len(size)):
        if not left[k]:
            continue
        left[k] = False
        queue = [k]
        while queue and left.any():
            at = queue.pop()
            shingle = number[ends[at] - size[at] : ends[at]]
            shingle = shingle[often[shingle] > 1]
            total = np.cumsum(often[shingle])
            common = np.zeros(len(size), np.int64)
            s = 0
            while s < len(shingle):
                e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + AT_ONCE, side="right")))
                n = often[shingle[s:e]]
                inside = np.repeat(first[shingle[s:e]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                common += np.bincount(owner[inside], minlength=len(size))
                s = e
            hit = np.flatnonzero(left & (common * (100 + percent) >= (size + size[at]) * percent))
            left[hit] = False
            a += hit.tolist()
            b += [k] * len(hit)
            queue += hit.tolist()
    return keys[np.array(a, np.int64)], keys[np.array(b, np.int64)]


def verified(rows: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) stars of exact links within each unit of classes; ``members``: row, set_key, unit.

    A class is read from one row of its own; sets are computed again from whole texts, which
    take less room in the shuffle than their shingles.
    """
    # the side of texts is as large as the input: the plan is the same at every size
    joined = rows.select("row", "text").join(members.hint("merge"), "row").select("text", "set_key", "unit")

    def read(column: pa.ChunkedArray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        some, size = [], 0
        for text in column:
            some.append(text.as_py() or "")
            size += len(some[-1])
            if size >= BLOCK_BYTES:
                out += shingle_sets(some, width)
                some, size = [], 0
        return out + shingle_sets(some, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_units(batches, "unit"):
            unit, key = some.column("unit").to_numpy(), some.column("set_key").to_numpy()
            sets = read(some.column("text"))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            cuts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(unit)]):
                own, sets[s:e] = sets[s:e], [None] * (e - s)
                x, y = linked(key[s:e], own, percent)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return bounded(joined.repartition("unit").sortWithinPartitions("unit")).mapInArrow(run, "a long, b long")


def grouped(some: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group_key, n, weight, prefix), and the classes with the group each is dealt to."""
    sizes = classes.groupBy("group_key").agg(F.count("*").alias("weight"))
    cut = sizes.where(F.col("weight") > BLOCK).select("group_key", F.ceil(F.col("weight") / BLOCK * 1.25).cast("int").alias("pieces"))
    dealt = classes.join(cut, "group_key", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.xxhash64("group_key", F.pmod(F.xxhash64("set_key"), F.col("pieces")))).otherwise(F.col("group_key")))
    first = some.groupBy("group_key").agg(F.first("prefix").alias("prefix"))
    pieces = dealt.groupBy("group_key", "piece").agg(F.first("n").alias("n"), F.count("*").alias("weight"))
    groups = pieces.join(first, "group_key").select(F.col("piece").alias("group_key"), "n", "weight", "prefix")
    return groups, dealt.select("set_key", F.col("piece").alias("group_key"), "n")


def rooted(rows: DataFrame, width: int, percent: int, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """Described rows, and (set_key, root) of each class; ``rows`` as ``source`` gives them."""
    table = count_table(rows, width)
    entries = int(table.sum()) * (100 - percent) // 100
    parts = parts or max(shuffle_partitions(rows.sparkSession), entries // ENTRIES)
    described = materialize(describe(rows, table, width, percent), "described")
    some = described.where("n > 0")
    classes = materialize(some.groupBy("set_key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("group_key").alias("group_key")), "classes")
    groups, dealt = grouped(some, classes)
    dealt = materialize(dealt, "dealt")
    met = meetings(groups, table, percent, parts)
    # classes of one group share a prefix: they meet once, at the group itself
    crowd = groups.where(F.col("weight") > 1).select(F.xxhash64("group_key", F.lit(1)).alias("place"), "group_key")
    placed = materialize(met.unionByName(crowd).join(dealt, "group_key").select("place", "set_key", "n"), "placed")
    signatures = some.join(placed.select("set_key").distinct(), "set_key", "left_semi").groupBy("set_key").agg(F.first("signature").alias("signature"))
    edges = candidates(placed.join(signatures, "set_key"), percent)
    clusters = materialize(components(edges).select(F.col("node").alias("set_key"), F.col("root").alias("cluster")), "clusters")
    release(placed, dealt)
    weighed = clusters.join(classes.select("set_key", "row", "n"), "set_key")
    sizes = weighed.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CLUSTER, F.sum("n") / WEIGHT)).cast("int").alias("cuts"))
    cut = materialize(weighed.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("cuts")).cast("int")), "cut")
    return described, classes.select("set_key").join(linked_roots(rows, cut, width, percent), "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"))


def linked_roots(rows: DataFrame, cut: DataFrame, width: int, percent: int) -> DataFrame:
    """(set_key, root) by exact links; ``cut``: set_key, row, n, cluster, cuts (number of its blocks), own (a class's block)."""
    others = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    place = lambda *c: F.when(F.col("cuts") == 1, F.col("cluster")).otherwise(F.xxhash64("cluster", *c)).alias("unit")
    large = cut.where("cuts > 1")
    at_home = cut.select("row", "set_key", place("own"))
    everywhere = lambda df: df.select("*", others).where("other <> own").select("row", "set_key", place("other"))
    light_first = F.row_number().over(Window.partitionBy("cluster").orderBy("n", "set_key"))
    leaders = large.withColumn("rank", light_first).where(F.col("rank") <= LEADERS).drop("rank")
    links = materialize(verified(rows, materialize(at_home.unionByName(everywhere(leaders)), "members"), width, percent), "links")
    if large.isEmpty():  # a unit is a whole cluster, and its stars are the components
        return links.select(F.col("a").alias("set_key"), F.col("b").alias("root"))
    found = materialize(large.join(components(links), F.col("set_key") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "set_key")), "found")
    counted = found.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    most = counted.groupBy("cluster").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    # what isn't tied to a cluster's largest component is compared with all of the cluster
    left = most.select("cluster", F.col("top.root").alias("top"), (F.col("c") - F.col("top.c")).alias("c"), (F.col("w") - F.col("top.w")).alias("w")).where("c > 0")
    found = found.join(left.select("cluster", "top", ((F.col("c") <= CLUSTER) & (F.col("w") <= WEIGHT)).alias("light")), "cluster")
    few, many = found.where("light"), found.where("not light")
    pairs = many.select("row", "set_key", others, "cluster", "cuts", "own").select("row", "set_key", place(F.least("own", "other"), F.greatest("own", "other")))
    again = few.select("row", "set_key", place("own")).unionByName(everywhere(few.where("root <> top"))).unionByName(pairs)
    more = materialize(verified(rows, materialize(again, "members"), width, percent), "links")
    return components(links.unionByName(more)).select(F.col("node").alias("set_key"), "root")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, parts: int | None = None, row: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    ``component_id`` is the smallest doc_id that links reach, itself included. Null and
    empty texts and texts without words have no shingles and link with nothing. Rows that
    repeat link with each other; a null doc_id takes part and is never the smallest, unless
    all are null. Other columns are not read. Very long texts are read whole. Classes and
    groups are told apart by 64-bit hashes. ``row``: a key of its own for each row, the same
    in each reading, such as ``file_row`` gives; without it a copy of the texts is written.
    """
    if row is None:
        df = numbered(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
        id_col, text_col, row = "id", "text", F.col("row")
    described, of_class = rooted(source(df, id_col, text_col, row), width, percent, parts)
    some = described.where("n > 0")
    lowest = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).join(of_class, "set_key")
    least = lowest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = of_class.join(least, "root").select("set_key", "component_id")
    worded = some.join(component, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return worded.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, parts: int | None = None, row: Column | None = None) -> DataFrame:
    """One row of each component: that of the smallest id (nulls last), then of the smallest hash of all columns.

    Only rows that links tie to the one that stays are dropped, whatever their ids: texts
    without words all stay, and so does each of several unlike texts with one id or none.
    All columns stay as they are, whatever their names. ``row`` as in ``join``.
    """
    key = "_row"
    while key in df.columns:
        key += "_"
    keyed = numbered(df, key) if row is None else df.withColumn(key, row)
    described, of_class = rooted(source(keyed, id_col, text_col, F.col(key), F.xxhash64(*df.columns)), width, percent, parts)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    ranked = described.where("n > 0").select("set_key", rank.alias("rank")).join(of_class, "set_key")
    first = ranked.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("c")).where("c > 1")
    dropped = ranked.join(first, "root").where(F.col("rank.row") != F.col("first.row")).select(F.col("rank.row").alias(key))
    return keyed.join(materialize(dropped, "dropped").hint("merge"), key, "left_anti").select(*df.columns)
