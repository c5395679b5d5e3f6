"""Trie of conversations' prefixes: a node for each distinct sequence of first turns, with what its subtree holds.

Turns are summed into prefix fingerprints by numpy scans over ranges of the sorted table, so a conversation of any
length spreads over tasks: the fingerprint of d turns is the sum of turn value times base to the power of its place,
modulo two primes. Rows of equal depth and fingerprint are candidates for one node. Each is compared with the
group's representative, the smallest conversation: same last turn (by the sha256 of role and text) and same group
one turn before; by induction over depth, then, all turns are the same. Groups that hold several sequences are
split. What a subtree holds comes from suffix sums along conversations, summed up by node: each node counts once, at
its representative, whose path lies in every subtree above the node. No loop over depth, and no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release
from weftline.llm.scan import running

PRIMES = ((1 << 31) - 1, (1 << 31) - 99)
BASES = (1_103_515_245, 740_025_417)
CHUNK = 1 << 16  # ids joined to one text before a node's list of ends is hashed


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime below 2 ** 31, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return out


def rebuild(turns: DataFrame, conv: str, order: str, role: str, text: str, donor: Column, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """(conv, place, content, words) of rebuilt conversations, and (conv, length) of all, turnless ones too.

    Each conversation starts with the first ``borrowed`` turns of the conversation ``donor`` (columns over ``conv``)
    and goes on with its own after as many. Turns stand by ``order``, null first; those that tie by the digest of
    role and text. Null roles and texts are empty. Rows without a conversation are left out.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    content = F.unhex(F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said), 256))
    words = F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(order).alias("order"), content.alias("content"), words.alias("words"), F.monotonically_increasing_id().alias("_tie"))
    given = materialize(own, "turns")
    sorted_turns = running(given, "conv", [F.col("order").asc_nulls_first(), "content", "_tie"], place=F.lit(1))
    placed = sorted_turns.drop("_tie", "order")
    release(given)
    each = placed.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"donor": donor.cast("long"), "h": borrowed.cast("long")})
    donors = each.select(F.col("conv").alias("donor"), F.col("n").alias("donor_n"))
    sized = materialize(each.join(donors, "donor", "left").select("conv", "donor", "h", "n", F.least("h", F.coalesce("donor_n", F.lit(0))).alias("taken")), "sized")
    kept = placed.join(sized.where("n > h").select("conv", "h", "taken"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "content", "words")
    most = sized.agg(F.max("h")).first()[0] or 0
    lent = placed.where(F.col("place") <= most).withColumnRenamed("conv", "donor").join(sized.select("conv", "donor", "taken"), "donor").where("place <= taken").select("conv", "place", "content", "words")
    rebuilt = materialize(kept.unionByName(lent), "rebuilt")
    release(sorted_turns)
    return rebuilt, sized.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def fingerprints(rebuilt: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``rebuilt`` with ``print`` of the turns up to each, and ``above``, that of the turns before it."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 4)
            terms = [raw[:, i] % np.uint64(p) * powers(b, place, p) % np.uint64(p) for i, (p, b) in enumerate(zip(primes, BASES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(t.astype(np.int64)) for t in terms)], names=["conv", "place", "content", "words", "a", "b"])

    valued = rebuilt.select("conv", "place", "content", "words").mapInArrow(values, "conv long, place long, content binary, words long, a long, b long")
    summed = running(valued, "conv", ["place"], sum_a=F.col("a"), sum_b=F.col("b"))
    joined = lambda a, b: F.shiftleft(F.pmod(a, F.lit(primes[0])), 31) + F.pmod(b, F.lit(primes[1]))
    out = summed.select("conv", F.col("place").alias("depth"), "content", "words", joined(F.col("sum_a"), F.col("sum_b")).alias("print"), joined(F.col("sum_a") - F.col("a"), F.col("sum_b") - F.col("b")).alias("above"))
    out._folder = summed._folder
    return out


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "node").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n"), F.min_by(F.struct("above", "content", "words"), "conv").alias("of_rep"), (F.min("content") != F.max("content")).alias("odd_turn"), (F.min("above") != F.max("above")).alias("odd_above")
    )


def verified(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, above, content, words): rows of prefixes with a node for each distinct sequence.

    ``node`` is the fingerprint (with a mark of the split where one had to be made) and unique within a depth. Groups
    whose rows don't all share the representative's last turn and group before are split by these, depth by depth
    from the first such one on, as a split goes down to what follows.
    """
    rows = rows.withColumn("node", F.col("print").cast("string")).withColumn("above", F.col("above").cast("string")).drop("print")
    first, deepest = _groups(rows).agg(F.min(F.when(F.col("odd_turn") | F.col("odd_above"), F.col("depth"))), F.max("depth")).first()
    if first is None:
        return rows
    done, now = rows.where(F.col("depth") < first), rows.where(F.col("depth") >= first)
    parents = None
    for depth in range(first, deepest + 1):
        level = now.where(F.col("depth") == depth)
        if parents is not None:
            level = level.drop("above").join(parents, "conv")
        split = F.concat_ws("/", "node", F.sha2(F.concat(F.col("above").cast("binary"), F.col("content")), 256))
        level = materialize(level.withColumn("node", split).select(*rows.columns), "level")
        done = done.unionByName(level)
        parents = level.select("conv", F.col("node").alias("above"))
    return done


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): digest of the ids (conv) that end at each node, ascending, joined by commas.

    Ids are sorted by ranges and joined to texts of some thousands where they are; a node's few texts are then hashed
    in order, as a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                depth, name, conv = (part.column(i).to_pylist() for i in range(3))
                cuts = [0, *(i for i in range(1, len(conv)) if depth[i] != depth[i - 1] or name[i] != name[i - 1]), len(conv)]
                runs = [(depth[a], name[a], conv[a], ",".join(map(str, conv[a:b]))) for a, b in zip(cuts, cuts[1:]) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["depth", "node", "first", "ids"])

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(3).to_pylist()):
                if key == now:
                    digest.update(b",")
                else:
                    out += [(*now, digest.hexdigest())] if now else []
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield _named(out)
        yield _named([(*now, digest.hexdigest())] if now else [])

    def _named(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["depth", "node", "ends_sha256"])

    keys = ["depth", "node"]
    chunks = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(join, "depth long, node string, first long, ids string")
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hash_all, "depth long, node string, ends_sha256 string")


def trie(rebuilt: DataFrame, lengths: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``rebuilt`` and ``lengths`` as ``rebuild`` gives them; places count from 1. A node is named by its smallest
    member. The root, without turns, has depth 0 and is there if there are conversations.
    """
    printed = fingerprints(rebuilt, primes)
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("print"), F.lit(-1).cast("long").alias("above"))
    rows = materialize(verified(printed.unionByName(root)), "prefixes")
    release(printed)
    nodes = _groups(rows).select("depth", "node", "rep", "n", "of_rep.above", "of_rep.words")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children"]), "nodes")
    none, zero = F.lit(None).cast("string").alias("node"), F.lit(0).cast("long")
    weights = known.select(F.col("rep").alias("conv"), "depth", none, (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    paths = rows.select("conv", "depth", "node", zero.alias("leaf"), zero.alias("saved"))
    # down from the end of each conversation: what its own nodes weigh, before the rows that it is added to
    below = running(paths.unionByName(weights), "conv", [F.col("depth").desc(), F.col("node").asc_nulls_first()], n_leaves=F.col("leaf"), saved_tokens=F.col("saved"))
    totals = below.where("node is not null").groupBy("depth", "node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    last = rows.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"], "left_semi")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("rep").alias("parent_conv_id"))
    out = known.join(parents, ["depth", "above"], "left").join(totals, ["depth", "node"]).join(_ends(last), ["depth", "node"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def shared_starts(turns: DataFrame) -> DataFrame:
    """The trie of ``conversations`` where each starts as the first of its twenty does: 0 to 3 turns, by the crc32 of its id."""
    c = F.col("conv")
    return trie(*rebuild(turns, "conv_id", "turn", "role", "text", c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4))
