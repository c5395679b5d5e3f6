"""Merkle manifest of a table: leaves in groups, a tree for each group, a tree over the groups' roots, and a proof for every row.

A node is the lower-case hex sha256 of its run of up to ``FANOUT`` children, as hex text. While several nodes of a
group remain, every ``FANOUT`` consecutive ones (the last run: fewer, even one) become their node. Blocks of
``FANOUT ** LEVELS`` consecutive nodes are aligned, so a block is reduced alone; blocks' roots are the next round's
nodes. Proofs go down the same way: a block emits its nodes' successive authentication paths by fractal traversal
(stacked subtrees of ``HEIGHT`` levels: existing ones along the path, and for each but the topmost the next one
desired, which grows by a leaf a step), and each path goes on with its block's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release
from weftline.llm.scan import running

FANOUT, LEVELS, HEIGHT = 8, 4, 2
BLOCK = FANOUT**LEVELS


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def tall(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = ceil(n / FANOUT), out + 1
    return out


class Subtree:
    """A subtree that grows leaf by leaf: its nodes from height ``low`` to below ``top``, of those under it only open runs.

    It stands above the leaves of its place: ``FANOUT ** top`` from ``index * FANOUT ** top`` on, fewer at the end.
    """

    def __init__(self, leaves: list[bytes], low: int, top: int, index: int):
        width = FANOUT**top
        self.leaves, self.low, self.top, self.next, self.end = leaves, low, top, index * width, min(len(leaves), (index + 1) * width)
        self.open: list[list[bytes]] = [[] for _ in range(top + 1)]
        self.kept: list[list[bytes]] = [[] for _ in range(top - low)]

    def _put(self, height: int, value: bytes) -> None:
        self.open[height].append(value)
        if self.low <= height < self.top:
            self.kept[height - self.low].append(value)

    def grow(self) -> None:
        """Take one leaf more, and close all runs that are full with it, or at the last leaf all."""
        if self.next >= self.end:
            return
        self._put(0, self.leaves[self.next])
        self.next += 1
        for height in range(self.top):
            run = self.open[height]
            if len(run) < FANOUT and not (self.next == self.end and run):
                break
            self._put(height + 1, node(run))
            self.open[height] = []

    def grown(self) -> Subtree:
        while self.next < self.end:
            self.grow()
        return self

    @property
    def root(self) -> bytes:
        return self.open[self.top][0]


def block_root(leaves: list[bytes], levels: int) -> bytes:
    return Subtree(leaves, levels, levels, 0).grown().root


def traverse(leaves: list[bytes], levels: int, height: int = HEIGHT) -> Iterator[tuple[bytes, bytes]]:
    """For each leaf in order (turns, proof): two digits a level, place and size of its run, and the run's others, level by level."""
    spans = [(low, min(low + height, levels)) for low in range(0, levels, height)]
    existing = [Subtree(leaves, low, top, 0).grown() for low, top in spans]
    desired = [Subtree(leaves, low, top, 1) for low, top in spans[:-1]]
    above: tuple[int, bytes, bytes] = (-1, b"", b"")
    for at in range(len(leaves)):
        for level in range(levels):
            if level and above[0] == at // FANOUT:  # all but the lowest level are those of the leaf before
                turns, proof = turns + above[1], proof + above[2]
                break
            tree = existing[level // height]
            place = at // FANOUT**level
            inside = place % FANOUT ** (tree.top - level)
            run = tree.kept[level - tree.low][inside - place % FANOUT : inside - place % FANOUT + FANOUT]
            mine = (b"%d%d" % (place % FANOUT, len(run)), b"".join(run[: place % FANOUT]) + b"".join(run[place % FANOUT + 1 :]))
            turns, proof = (turns + mine[0], proof + mine[1]) if level else mine
        if not levels:
            turns, proof = b"", b""
        elif above[0] != at // FANOUT:
            others = 64 * (int(turns[1:2]) - 1)
            above = (at // FANOUT, turns[2:], proof[others:])
        yield turns, proof
        for i, (low, top) in enumerate(spans[:-1]):
            desired[i].grow()
            if (at + 1) % FANOUT**top == 0:
                existing[i] = desired[i]
                desired[i] = Subtree(leaves, low, top, (at + 1) // FANOUT**top + 1)


NODE = "key string, at long, of long, node string"
PATH = "turns binary, proof binary, subroot string, root string"


def _fold(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks, as nodes (key, at, of, node) of the next round; ``of`` counts a group's nodes."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        of = block["of"][0].as_py()
        root = block_root([x.encode() for x in block["node"].to_pylist()], min(LEVELS, tall(of)))
        return pa.table({"key": [block["key"][0].as_py()], "at": [block["at"][0].as_py() // BLOCK], "of": [ceil(of / BLOCK)], "node": [root.decode()]})

    return nodes.select("key", "at", "of", "node", F.expr(f"at div {BLOCK}").alias("block")).groupBy("key", "block").applyInArrow(run, NODE)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes``, then the written nodes of each round, up to one node a group."""
    most = nodes.agg(F.max("of")).first()[0] or 0
    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(materialize(_fold(out[-1]), "nodes"))
        most = ceil(most / BLOCK)
    return out


def _prove(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with path columns, where ``above`` (key, at and path columns) holds those of the blocks' roots."""
    names = nodes.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", " + PATH

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        up = upper.to_pylist()[0]
        found = list(traverse([x.encode() for x in block["node"].to_pylist()], min(LEVELS, tall(block["of"][0].as_py()))))
        n = block.num_rows
        out = block.select(names)
        out = out.append_column("turns", pa.array([t + up["turns"] for t, _ in found], pa.binary())).append_column("proof", pa.array([p + up["proof"] for _, p in found], pa.binary()))
        return out.append_column("subroot", pa.array([up["subroot"]] * n, pa.string())).append_column("root", pa.array([up["root"]] * n, pa.string()))

    left = nodes.withColumn("_block", F.expr(f"at div {BLOCK}")).groupBy("key", "_block")
    return left.cogroup(above.select("key", F.col("at").alias("_block"), "turns", "proof", "subroot", "root").groupBy("key", "_block")).applyInArrow(run, kind)


def _proofs(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the first round's nodes; ``top`` has those of the last round's."""
    above = top
    for nodes in reversed(rounds[1:-1]):
        above = materialize(_prove(nodes, above), "paths")
    return _prove(rounds[0], above)


def leaf(*columns: str | Column) -> Column:
    """sha256 of a row: each column as ``-`` if null, else its length in bytes, a colon and its text."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def prove(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """``rows`` with turns, proof (the siblings' hex text, level by level), subroot and root.

    A group's leaves stand by ``order`` (nulls first; rows that tie by their leaf's text, and equal leaves in any
    order, which no result shows). Groups' roots stand by group, null first, then by the bytes of its UTF-8. Rows,
    never texts, are shuffled; a block is bounded, so a group of any size spreads over tasks. No rows: no rows.
    Names that begin with an underscore, ``key``, ``at``, ``of`` and ``node`` can't be columns of ``rows``.
    """
    spark = rows.sparkSession
    named = rows.withColumn("key", F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))).withColumn("node", F.col(leaf)).withColumn("_tie", F.monotonically_increasing_id())
    leaves = materialize(named, "leaves")
    placed = running(leaves, "key", [F.col(order).asc_nulls_first(), "node", "_tie"], at=F.lit(1)).withColumn("at", F.col("at") - 1).drop("_tie")
    release(leaves)
    sizes = materialize(placed.groupBy("key").agg(F.count("*").alias("of")), "sizes")
    trees = _rounds(placed.join(sizes, "key"))
    groups = trees[-1].select("node", F.col("key").alias("_group"), F.lit("").alias("key"))
    ranked = running(groups, "key", ["_group"], at=F.lit(1))
    crown = _rounds(ranked.withColumn("at", F.col("at") - 1).withColumn("of", F.lit(sizes.count()).cast("long")))
    root = crown[-1].first()
    top = spark.createDataFrame([("", 0, b"", b"", None, root.node)] if root else [], f"key string, at long, {PATH}")
    above = materialize(_proofs(crown, top).select(F.col("_group").alias("key"), F.lit(0).cast("long").alias("at"), "turns", "proof", F.col("node").alias("subroot"), "root"), "subroots")
    release(ranked, *crown[1:])
    return _proofs(trees, above).drop("key", "at", "of", "node")


def folded(leaf: Column | str, turns: Column | str = "turns", proof: Column | str = "proof") -> Column:
    """The root that a leaf (hex text) and a proof give, as a native column."""
    leaf, turns, proof = (F.col(c) if isinstance(c, str) else c for c in (leaf, turns, proof))
    digit = lambda i: F.ascii(F.substring(turns, i, F.lit(1)).cast("string")) - 48

    def up(state: Column, level: Column) -> Column:
        place, others = digit(level * 2 - 1), digit(level * 2) - 1
        left = F.substring(proof, state["at"], place * 64)
        right = F.substring(proof, state["at"] + place * 64, (others - place) * 64)
        return F.struct(F.sha2(F.concat(left, state["node"].cast("binary"), right), 256).alias("node"), (state["at"] + others * 64).alias("at"))

    levels = (F.octet_length(turns) / 2).cast("int")
    start = F.struct(leaf.alias("node"), F.lit(1).alias("at"))
    return F.when(levels == 0, leaf).otherwise(F.aggregate(F.sequence(F.lit(1), levels), start, up, lambda s: s["node"]))


def manifest(docs: DataFrame, tampered: Column, claimed: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, turns, proof, claim) of ``documents``; ``claim`` is the leaf that is to be checked.

    ``claimed`` is the text that rows of ``tampered`` claim. Null texts, ids and languages have their own leaf and
    place (see ``leaf``, ``prove``); other columns than doc_id, source, lang, n_chars and text are left out.
    """
    whole = docs.select("doc_id", "lang", leaf("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), F.when(tampered, leaf("doc_id", "source", "lang", "n_chars", claimed)).alias("other"))
    return prove(whole, "lang", "doc_id", "leaf").select("doc_id", "leaf", "subroot", "root", "turns", "proof", F.coalesce("other", "leaf").alias("claim"))


def digests(proved: DataFrame) -> DataFrame:
    """What a manifest's rows say in short: the proof's digest, the root it gives for the claim, and whether that is the root."""
    made = proved.withColumn("folded_root", folded("claim"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
