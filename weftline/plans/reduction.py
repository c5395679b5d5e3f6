"""Reduction of steps and origins to edges, gaps and a graph manifest, many traces in one plan."""

from __future__ import annotations

from functools import reduce as fold
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import EDGE, GRAPH, canonical, digest, digest_text
from weftline.functions.types import EDGE_BODY, ORIGINS
from weftline.operators import graph, resolve, streams
from weftline.storage import materialize


class Reduced(NamedTuple):
    edges: DataFrame
    gaps: DataFrame


def unique_gaps(*parts: DataFrame) -> DataFrame:
    """All gaps, each once."""
    return fold(DataFrame.unionByName, parts).dropDuplicates(["trace", "code", "subject", "related"])


def reduce_steps(steps: DataFrame, origins: DataFrame | None = None) -> Reduced:
    """Edges (trace, parent, child, kind, delegation, scope, v, hash) and gaps of distinct steps.

    Independent of the order of rows. ``origins`` may hold streams of all traces, or, with a column ``trace``,
    those pinned to each; a step's own attestations decide what concerns its trace. Repeated steps change nothing: what
    is counted are hashes, and edges and gaps are made distinct.
    """
    conflicted = resolve.conflicts(steps)
    native, parent_gaps = resolve.native_parents(steps, conflicted)
    delegated, delegation_gaps = resolve.delegations(steps)
    # written once: cycle search and edge filter read it several times
    candidates = materialize(native.unionByName(delegated).dropDuplicates(["trace", "hash"]), "candidates")
    found = materialize(graph.cycles(candidates), "cycles")
    edges = graph.without_cycles(candidates, found)
    parts = [resolve.conflict_gaps(conflicted), parent_gaps, delegation_gaps, graph.cycle_gaps(found)]
    if origins is not None:
        parts.append(streams.origin_gaps(origins, steps))
    return Reduced(edges, unique_gaps(*parts))


def rename_traces(reduced: Reduced, names: DataFrame) -> Reduced:
    """What ``reduce_steps`` gives for graphs kept apart by a key of their own, with edges' hashes of the real trace.

    ``names``: trace (the key) and named (the trace that bodies name). Edges get a column ``named``.
    """
    body = F.struct(*(F.col("named").alias("trace") if c == "trace" else F.col(c) for c in EDGE_BODY))
    return Reduced(reduced.edges.join(names.select("trace", "named"), "trace").withColumn("hash", digest(EDGE, body)), reduced.gaps)


#: Bounds of a manifest's arrays (fixed values of the data format).
MOST = {"steps": 100_000, "origins": 100_000, "edges": 400_000, "gaps": 400_000}


def oversized(steps: DataFrame, reduced: Reduced, origins: DataFrame | None = None) -> DataFrame:
    """(trace): traces whose manifest would hold more than the format allows; counted, without building an array."""
    parts = {"steps": steps.select("trace", "hash").distinct(), "edges": reduced.edges.select("trace", "hash").distinct(), "gaps": reduced.gaps}
    if origins is not None:
        parts["origins"] = origins.select("trace", "hash").distinct()
    over = [df.groupBy("trace").agg(F.count("*").alias("n")).where(F.col("n") > MOST[name]).select("trace") for name, df in parts.items()]
    return fold(DataFrame.unionByName, over).distinct()


def manifests(steps: DataFrame, reduced: Reduced, origins: DataFrame | None = None, traces: DataFrame | None = None) -> DataFrame:
    """(trace, manifest, graph): canonical JSON of each trace's manifest and its hash.

    ``origins`` are those pinned to each trace (with a column ``trace``). ``traces`` (trace, workspace, and named
    where bodies name the trace otherwise than the key) adds traces without steps, whose manifest is empty. Arrays
    hold what the format allows: a trace of which they would hold more has a null manifest and graph.
    """
    spark = steps.sparkSession
    over = oversized(steps, reduced, origins)
    origins = spark.createDataFrame([], f"trace string, {ORIGINS}") if origins is None else origins
    fits = lambda df: df.join(over, "trace", "left_anti")
    listed = lambda df, name: fits(df).groupBy("trace").agg(F.array_sort(F.collect_set("hash")).alias(name))
    # gaps stand in the order of code, subject and the JSON text of what is related
    ordered = F.array_sort(F.collect_set(F.struct("code", "subject", canonical("related").alias("text"), "related")))
    gaps = fits(reduced.gaps).groupBy("trace").agg(F.transform(ordered, lambda g: F.struct(g["code"], g["related"], g["subject"])).alias("gaps"))
    if traces is None:
        base = steps.select("trace", "workspace", F.col("trace").alias("named")).distinct()
    elif "named" in traces.columns:
        base = traces.select("trace", "workspace", "named").distinct()
    else:
        base = traces.select("trace", "workspace").unionByName(steps.select("trace", "workspace")).distinct().withColumn("named", F.col("trace"))
    for part in (listed(steps, "steps"), listed(origins, "origins"), listed(reduced.edges, "edges"), gaps, over.withColumn("over", F.lit(True))):
        base = base.join(part, "trace", "left")
    empty = F.array().cast("array<string>")
    gap_kind = "array<struct<code:string,related:array<string>,subject:string>>"
    body = F.struct(
        F.coalesce("edges", empty).alias("edges"), F.coalesce("gaps", F.array().cast(gap_kind)).alias("gaps"), F.coalesce("origins", empty).alias("origins"), F.coalesce("steps", empty).alias("steps"),
        F.col("named").alias("trace"), F.lit(1).alias("v"), "workspace",
    )
    return base.select("trace", F.when(F.col("over").isNull(), canonical(body)).alias("manifest")).withColumn("graph", digest_text(GRAPH, "manifest"))
