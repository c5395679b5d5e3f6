"""Inventories of proof bundles, attachments, and checks of stored graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import from_base64url, sha256_text
from weftline.plans.reduction import manifests, reduce_steps


def items(envelopes: DataFrame) -> DataFrame:
    """(bundle, kind, digest, bytes) of envelopes (bundle, kind, json)."""
    return envelopes.select("bundle", "kind", sha256_text("json").alias("digest"), F.octet_length("json").cast("string").alias("bytes"))


def attachment_refs(steps: DataFrame) -> DataFrame:
    """(trace, digest, format, bytes, formats): what steps refer to, each digest once; ``formats`` counts differing claims."""
    refs = steps.select("trace", "hash", F.explode("attachments").alias("a"))
    return refs.groupBy("trace", "a.digest").agg(F.min_by("a.format", "hash").alias("format"), F.min_by("a.bytes", "hash").alias("bytes"), F.count_distinct("a.format", "a.bytes").alias("formats"))


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(bundle, kind, digest, fault): items that two inventories (bundle, kind, digest, bytes) don't agree on.

    MISSING or UNEXPECTED items, other BYTES, and items that one of them has twice.
    """
    keys = ["bundle", "kind", "digest"]
    sides = expected.select(*keys, "bytes", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*keys, "bytes", F.lit(0).alias("e"), F.lit(1).alias("a")))
    both = sides.groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    fault = F.when(F.col("a") == 0, "MISSING").when(F.col("e") == 0, "UNEXPECTED").when((F.col("e") > 1) | (F.col("a") > 1), "TWICE").when(F.col("low") != F.col("high"), "BYTES")
    return both.select(*keys, fault.alias("fault")).where("fault is not null")


def attachment_faults(refs: DataFrame, artifacts: DataFrame, include: bool = True) -> DataFrame:
    """(trace, digest, fault): attachments whose bytes, format or content are not what is referred to.

    ``refs`` as ``attachment_refs`` gives them, ``artifacts``: trace, digest, format, bytes, content
    (base64url). With ``include`` false no artifact may be there.
    """
    raw = from_base64url("content")
    given = artifacts.select("trace", "digest", F.col("format").alias("own_format"), F.col("bytes").alias("own_bytes"), F.sha2(raw, 256).alias("own"), F.length(raw).cast("string").alias("length"), F.lit(True).alias("there"))
    joined = refs.join(given, ["trace", "digest"], "full_outer")
    there = F.col("there").isNotNull()
    fault = (
        F.when(there & F.lit(not include), "UNEXPECTED").when(~there & F.lit(include), "UNAVAILABLE").when(~there, None).when(F.col("format").isNull(), "UNEXPECTED")
        .when(~F.col("own").eqNullSafe(F.col("digest")), "DIGEST").when((F.col("length") != F.col("own_bytes")) | (F.col("own_bytes") != F.col("bytes")), "BYTES").when(F.col("own_format") != F.col("format"), "FORMAT")
    )
    return joined.select("trace", "digest", fault.alias("fault")).where("fault is not null")


def graph_faults(heads: DataFrame, steps: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(trace, graph, stored): traces whose stored graph hash (trace, graph) isn't what reducing their steps gives; one plan for all.

    ``origins`` are those pinned to each trace, with a column ``trace``; those of one trace have no bearing on another.
    """
    made = manifests(steps, reduce_steps(steps, origins), origins).select("trace", "graph")
    return made.join(heads.select("trace", F.col("graph").alias("stored")), "trace", "full_outer").where("not (graph <=> stored)").select("trace", "graph", "stored")
