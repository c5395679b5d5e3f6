"""Bounded ancestor paths: many requests in one plan, with limits that fail and never cut.

A request (request, trace, source, record, max_depth, max_nodes) asks for all that the step
of a record stands on. Results keep ``request``; a request that fails has its error in
``answers`` and no other rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import canonical
from weftline.functions.checks import CONFLICTS
from weftline.operators import graph
from weftline.storage import materialize

MAX_DEPTH, MAX_NODES, MAX_PATH_EDGES = 256, 4096, 16_384


class Paths(NamedTuple):
    answers: DataFrame  # request, trace, action, error, verdict
    nodes: DataFrame  # request, trace, node, depth
    edges: DataFrame  # request and the edge's columns
    gaps: DataFrame  # request, code, subject, related


def actions(steps: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with ``action`` (the step's hash) or ``error``: NOT_FOUND, or ACTION_CONFLICT for a record with versions."""
    known = steps.groupBy("trace", "source", "record").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    found = requests.join(known, ["trace", "source", "record"], "left")
    error = F.when(F.col("low").isNull(), "NOT_FOUND").when(F.col("low") != F.col("high"), "ACTION_CONFLICT")
    return found.select(*requests.columns, F.when(error.isNull(), F.col("low")).alias("action"), error.alias("error"))


def paths(steps: DataFrame, edges: DataFrame, gaps: DataFrame, requests: DataFrame) -> Paths:
    """Answers, nodes with least depth, edges between returned nodes, and gaps that concern them.

    Depth beyond ``max_depth``, nodes beyond ``max_nodes`` and edges beyond ``MAX_PATH_EDGES``
    are PATH_LIMIT. Nodes and edges are those of the reduced (acyclic) graph; repeated
    requests repeat. An unknown trace is NOT_FOUND.
    """
    asked = materialize(actions(steps, requests), "asked")
    starts = asked.where("error is null")
    links = edges.select("trace", "parent", "child").distinct()
    deepest = starts.agg(F.max("max_depth")).first()[0] or 0
    reached = materialize(graph.ancestors(links, starts.select("trace", F.col("action").alias("node")).distinct(), deepest), "reached")
    nodes = starts.select("request", "trace", "action", "max_depth", "max_nodes").join(reached.withColumnRenamed("start", "action"), ["trace", "action"])
    sized = nodes.groupBy("request").agg(F.count("node").alias("n"), F.max("depth").alias("depth"), F.first("max_depth").alias("most_depth"), F.first("max_nodes").alias("most"))
    over = materialize(sized.where("depth > most_depth or n > most").select("request"), "over")
    fitting = materialize(nodes.join(over, "request", "left_anti").select("request", "trace", "node", "depth"), "nodes")
    ends = fitting.select("request", "trace", "node")
    within = edges.join(ends.withColumnRenamed("node", "child"), ["trace", "child"]).join(ends.withColumnRenamed("node", "parent"), ["request", "trace", "parent"], "left_semi")
    within = materialize(within.select("request", *edges.columns), "path-edges")
    crowded = within.groupBy("request").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PATH_EDGES).select("request")
    limit = materialize(over.unionByName(crowded), "limit")
    kept = fitting.join(limit, "request", "left_anti")
    near = relevant_gaps(gaps, kept)
    verdicts = near.groupBy("request").agg(F.max(F.col("code").isin(*CONFLICTS)).alias("conflict"))
    failed = F.coalesce("error", F.when(F.col("limited"), "PATH_LIMIT"))
    verdict = F.when(F.col("conflict"), "CONFLICTED").when(F.col("conflict").isNotNull(), "INCOMPLETE").otherwise("COMPLETE_RELATIVE")
    answers = asked.join(limit.withColumn("limited", F.lit(True)), "request", "left").join(verdicts, "request", "left")
    return Paths(answers.select("request", "trace", "action", failed.alias("error"), F.when(failed.isNull(), verdict).alias("verdict")), kept, within.join(limit, "request", "left_anti"), near)


def relevant_gaps(gaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, trace, code, subject, related): gaps whose subject or one of whose related steps is a node."""
    named = gaps.withColumn("key", F.sha2(canonical(F.struct("code", "related", "subject")), 256))
    touched = named.select("trace", "key", F.explode(F.array_distinct(F.concat(F.array("subject"), "related"))).alias("node"))
    wanted = touched.join(nodes.select("request", "trace", "node"), ["trace", "node"]).select("request", "trace", "key").distinct()
    return wanted.join(named.dropDuplicates(["trace", "key"]), ["trace", "key"]).select("request", "trace", "code", "subject", "related")


def ordered(found: Paths) -> DataFrame:
    """(request, node, position): each path's nodes, parents first, the smallest hash among those ready."""
    nodes = found.nodes.select(F.col("request").cast("string").alias("trace"), "node")
    edges = found.edges.select(F.col("request").cast("string").alias("trace"), "parent", "child")
    return graph.topological(nodes, edges).withColumnRenamed("trace", "request")


def require(found: Paths) -> Paths:
    """``found``, or an error that names the first request that has one (by its key)."""
    first = found.answers.where("error is not null").agg(F.min_by("error", "request").alias("error"), F.min("request").alias("request")).first()
    if first.error is not None:
        raise ValueError(f"{first.error}: request {first.request}")
    return found
