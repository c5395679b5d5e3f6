"""Graph operators over edges (trace, parent, child).

A trace is bounded by the data format (100,000 steps, 400,000 edges), so per-trace traversals
are grouped maps; whole-table traversals go level by level over written tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import materialize, release

MAX_STEPS, MAX_EDGES = 100_000, 400_000
PEELS = 2
PAIRS = 1_000_000  # rows that a task of ``ancestors`` makes at most, if a start alone does not make more


def peel(edges: DataFrame, rounds: int = PEELS) -> DataFrame:
    """Edges left after dropping, some times, those whose parent is no child or whose child is no parent.

    Such edges lie on no cycle. It empties shallow trees by joins alone.
    """
    left = edges.select("trace", "parent", "child").distinct()
    for _ in range(rounds):
        ends = left.select("trace", F.explode(F.array(F.struct(F.col("parent").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("child").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
        inner = ends.groupBy("trace", "e.node").agg(F.max("e.out").alias("out"), F.max("e.into").alias("into")).where("out = 1 and into = 1").select("trace", "node")
        left = left.join(inner.withColumnRenamed("node", "parent"), ["trace", "parent"], "left_semi").join(inner.withColumnRenamed("node", "child"), ["trace", "child"], "left_semi")
    return left


def strong_components(pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Nodes on a common cycle, sorted, for each such set; a self-loop is a set of one."""
    after: dict[str, list[str]] = {}
    before: dict[str, list[str]] = {}
    loops = set()
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
        if a == b:
            loops.add(a)
    # nodes by time of being finished forwards, then sets reached backwards
    seen: set[str] = set()
    finished: list[str] = []
    for root in sorted(after):
        if root in seen:
            continue
        seen.add(root)
        todo = [(root, iter(after[root]))]
        while todo:
            node, rest = todo[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                finished.append(node)
                todo.pop()
            else:
                seen.add(step)
                todo.append((step, iter(after.get(step, ()))))
    taken: set[str] = set()
    out = []
    for root in reversed(finished):
        if root in taken:
            continue
        taken.add(root)
        group, at = [root], 0
        while at < len(group):
            for n in before.get(group[at], ()):
                if n not in taken:
                    taken.add(n)
                    group.append(n)
            at += 1
        if len(group) > 1 or root in loops:
            out.append(sorted(group))
    return out


def cycles(edges: DataFrame) -> DataFrame:
    """(trace, members): the sets of steps on a common cycle, members sorted.

    A grouped map per trace, of edges that may lie on a cycle; traces with more than ``MAX_EDGES`` of these go through
    ``coloured_cycles``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = strong_components(zip(pdf["parent"], pdf["child"]))
        return pd.DataFrame({"trace": pd.Series([pdf["trace"].iloc[0]] * len(found), dtype=object), "members": pd.Series(found, dtype=object)})

    left = materialize(peel(edges), "peeled")
    large = left.groupBy("trace").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EDGES).select("trace")
    small = left.join(large, "trace", "left_anti").groupBy("trace").applyInPandas(run, "trace string, members array<string>")
    if large.isEmpty():
        return small
    return small.unionByName(coloured_cycles(left.join(large, "trace", "left_semi")))


def _until_stable(rows: DataFrame, step, name: str) -> DataFrame:
    """``step`` of a table (trace, node, value) until no value changes; each round is written, and the one before removed."""
    now = materialize(rows, name)
    while True:
        after = materialize(step(now), name)
        changed = after.join(now.withColumnRenamed("value", "old"), ["trace", "node"], "left").where("not (value <=> old)")
        settled = changed.isEmpty()
        release(now)
        now = after
        if settled:
            return now


def coloured_cycles(edges: DataFrame) -> DataFrame:
    """What ``cycles`` gives, over whole tables: for traces too large for a task.

    Each round gives every node the largest name that reaches it as its colour. The node that is its own colour and all
    of the colour that reach it are one set; edges between colours and those of sets found go, then edges that lie on no
    cycle. Rounds within a round go edge by edge, so they are as many as the longest way they have to go.
    """
    left = materialize(edges.select("trace", "parent", "child").distinct(), "coloured")
    found = left.sparkSession.createDataFrame([], "trace string, members array<string>")
    while not left.isEmpty():
        ends = left

        def spread(now: DataFrame) -> DataFrame:
            sent = ends.join(now.withColumnRenamed("node", "parent"), ["trace", "parent"]).select("trace", F.col("child").alias("node"), "value")
            return now.unionByName(sent).groupBy("trace", "node").agg(F.max("value").alias("value"))

        nodes = left.select("trace", F.explode(F.array("parent", "child")).alias("node")).distinct()
        colour = _until_stable(nodes.withColumn("value", F.col("node")), spread, "colours")
        named = lambda end: colour.select("trace", F.col("node").alias(end), F.col("value").alias(f"{end}_colour"))
        inside = materialize(left.join(named("parent"), ["trace", "parent"]).join(named("child"), ["trace", "child"]).where("parent_colour = child_colour").select("trace", "parent", "child", F.col("child_colour").alias("value")), "inside")

        def back(now: DataFrame) -> DataFrame:
            sent = inside.join(now.withColumnRenamed("node", "child"), ["trace", "child", "value"]).select("trace", F.col("parent").alias("node"), "value")
            return now.unionByName(sent).distinct()

        marked = _until_stable(colour.where("node = value"), back, "marked")
        loops = left.where("parent = child").select("trace", F.col("parent").alias("value"), F.lit(True).alias("loop"))
        sets = marked.groupBy("trace", "value").agg(F.array_sort(F.collect_set("node")).alias("members")).join(loops, ["trace", "value"], "left").where("size(members) > 1 or loop").select("trace", "members")
        found = found.unionByName(materialize(sets, "sets"))
        gone = marked.select("trace", "node")
        rest = inside.join(gone.withColumnRenamed("node", "parent"), ["trace", "parent"], "left_anti").join(gone.withColumnRenamed("node", "child"), ["trace", "child"], "left_anti")
        done, left = left, materialize(peel(rest), "coloured")
        release(done, colour, inside, marked)
    return found


def without_cycles(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges but those with both ends in one cycle set."""
    member = found.select("trace", F.col("members")[0].alias("set"), F.explode("members").alias("node"))
    a = member.select("trace", F.col("node").alias("parent"), F.col("set").alias("set_a"))
    b = member.select("trace", F.col("node").alias("child"), F.col("set").alias("set_b"))
    joined = edges.join(a, ["trace", "parent"], "left").join(b, ["trace", "child"], "left")
    return joined.where("set_a is null or set_b is null or set_a <> set_b").select(*edges.columns)


def cycle_gaps(found: DataFrame) -> DataFrame:
    return found.select("trace", F.lit("CYCLE").alias("code"), F.col("members")[0].alias("subject"), F.col("members").alias("related"))


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(trace, start, node, depth): what each start reaches over incoming edges, at least depth; the start itself at 0.

    A grouped map per trace and share of its starts, breadth first; shares hold about
    ``PAIRS`` rows of output, at least one start. Traces of more than ``MAX_EDGES`` edges go
    through ``reach``. Without ``max_depth`` there is no limit; with it, one row per trace and
    start beyond it has depth ``max_depth + 1`` and no node: limits are errors to raise, never
    truncation.
    """
    edges, starts = edges.select("trace", "parent", "child"), starts.select("trace", "node").distinct()
    sizes = materialize(edges.groupBy("trace").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > MAX_EDGES).select("trace")
    found = _ancestors_by_share(edges.join(large, "trace", "left_anti"), starts.join(large, "trace", "left_anti"), sizes, max_depth)
    if large.isEmpty():
        return found
    return found.unionByName(reach(edges.join(large, "trace", "left_semi"), starts.join(large, "trace", "left_semi"), max_depth))


def _ancestors_by_share(edges: DataFrame, starts: DataFrame, sizes: DataFrame, max_depth: int | None) -> DataFrame:
    def run(key: tuple, es: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        incoming: dict[str, list[str]] = {}
        for p, c in zip(es["parent"], es["child"]):
            incoming.setdefault(c, []).append(p)
        rows = []
        for start in dict.fromkeys(ss["node"]):
            depth, level, d = {start: 0}, [start], 0
            while level:
                level = list(dict.fromkeys(p for n in level for p in incoming.get(n, ()) if p not in depth))
                d += 1
                if level and max_depth is not None and d > max_depth:
                    rows.append((key[0], start, None, max_depth + 1))
                    break
                depth.update(dict.fromkeys(level, d))
            rows += [(key[0], start, n, d) for n, d in depth.items()]
        return pd.DataFrame(rows, columns=["trace", "start", "node", "depth"]).astype({"trace": object, "start": object, "node": object})

    shares = F.ceil(F.col("starts") * (F.coalesce("n", F.lit(0)) + 1) / PAIRS).cast("int")
    dealt = starts.groupBy("trace").agg(F.count("*").alias("starts")).join(sizes, "trace", "left").select("trace", F.least(shares, "starts").cast("int").alias("shares"))
    own = starts.join(dealt, "trace").select("trace", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node")
    each = edges.join(dealt, "trace").select("trace", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "parent", "child")
    kind = "trace string, start string, node string, depth int"
    return each.groupBy("trace", "share").cogroup(own.groupBy("trace", "share")).applyInPandas(run, kind)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(trace, start, node, depth) as ``ancestors`` gives, level by level over whole tables.

    For traces too large for a task. Each level is written and reread, so that no predicate of
    an earlier level stays in the plan; only a count reaches the driver.
    """
    parents = edges.select("trace", F.col("child").alias("node"), F.col("parent").alias("next")).distinct()
    level = materialize(starts.select("trace", F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for depth in count(1):
        step = level.join(parents, ["trace", "node"]).select("trace", "start", F.col("next").alias("node")).distinct()
        level = materialize(step.join(seen, ["trace", "start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            return seen.unionByName(level.select("trace", "start", F.lit(None).cast("string").alias("node"), "depth").distinct())
        seen = materialize(seen.unionByName(level), "seen")
    return seen


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace, node, position): order in which parents come first, the smallest hash among those ready.

    A grouped map per trace with a heap. Nodes on cycles have no position and are left out.
    """

    def run(key: tuple, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if len(ns) > MAX_STEPS or len(es) > MAX_EDGES:
            raise ValueError(f"a trace has more than {MAX_STEPS} steps or {MAX_EDGES} edges")
        missing = dict.fromkeys(ns["node"], 0)
        children: dict[str, list[str]] = {}
        for p, c in set(zip(es["parent"], es["child"])):
            if p in missing and c in missing:
                missing[c] += 1
                children.setdefault(p, []).append(c)
        ready = [n for n, k in missing.items() if k == 0]
        heapq.heapify(ready)
        order = []
        while ready:
            n = heapq.heappop(ready)
            order.append(n)
            for c in children.get(n, ()):
                missing[c] -= 1
                if missing[c] == 0:
                    heapq.heappush(ready, c)
        return pd.DataFrame({"trace": pd.Series([key[0]] * len(order), dtype=object), "node": pd.Series(order, dtype=object), "position": range(len(order))})

    return nodes.select("trace", "node").distinct().groupBy("trace").cogroup(edges.select("trace", "parent", "child").groupBy("trace")).applyInPandas(run, "trace string, node string, position int")
