"""Edges and gaps from steps: versions, native parents and two-sided delegations.

All operators take steps of many traces at once and keep them apart by ``trace``. A gap is
(trace, code, subject, related), ``related`` sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import EDGE, digest
from weftline.functions.types import EDGE_BODY
from weftline.storage import materialize


def none() -> Column:
    return F.array().cast("array<string>")


def _gap(code: str, subject: Column | str, related: Column | str | None = None) -> list[Column]:
    subject = F.col(subject) if isinstance(subject, str) else subject
    related = none() if related is None else F.col(related) if isinstance(related, str) else related
    return [F.col("trace"), F.lit(code).alias("code"), subject.alias("subject"), related.alias("related")]


def with_edge_hash(edges: DataFrame) -> DataFrame:
    return edges.withColumn("v", F.lit(1)).withColumn("hash", digest(EDGE, F.struct(*EDGE_BODY)))


def versions(steps: DataFrame, *keys: str) -> DataFrame:
    """(trace, keys, hashes, n): the distinct step hashes of each key, sorted."""
    return steps.groupBy("trace", *keys).agg(F.array_sort(F.collect_set("hash")).alias("hashes")).withColumn("n", F.size("hashes"))


def conflicts(steps: DataFrame) -> DataFrame:
    """(trace, source, record, hashes): records with more than one version.

    Counted first by minimum and maximum, so that hashes are gathered for conflicted records only.
    """
    odd = steps.groupBy("trace", "source", "record").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("trace", "source", "record")
    return versions(steps.select("trace", "source", "record", "hash").join(odd, ["trace", "source", "record"], "left_semi"), "source", "record").drop("n")


def conflict_gaps(conflicted: DataFrame) -> DataFrame:
    return conflicted.select(*_gap("SOURCE_CONFLICT", F.col("hashes")[0], "hashes"))


def parent_references(steps: DataFrame) -> DataFrame:
    """A row per native parent of each step."""
    return steps.select("trace", "source", "native_trace", "record", "hash", F.explode("parents").alias("p")).select("trace", "source", "native_trace", "record", F.col("hash").alias("child"), F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))


def parent_targets(steps: DataFrame, meant: DataFrame) -> DataFrame:
    """(trace, source, native_trace, kind, value, low, high): what a reference of each kind can name; ``meant`` (source, kind): which there are."""
    ids = F.explode(F.array(F.struct(F.lit("record").alias("kind"), F.col("record").alias("value")), F.struct(F.lit("span").alias("kind"), F.col("native_span").alias("value")))).alias("t")
    rows = steps.select("trace", "source", "native_trace", "hash", ids).select("trace", "source", "native_trace", "t.kind", "t.value", "hash").join(meant, ["source", "kind"], "left_semi")
    return rows.groupBy("trace", "source", "native_trace", "kind", "value").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))


def native_parents(steps: DataFrame, conflicted: DataFrame, related=lambda hashes: hashes) -> tuple[DataFrame, DataFrame]:
    """Native edges, and gaps of missing and ambiguous parents; children with versions get no edge.

    ``related`` makes what gaps carry of the hashes that an ambiguous name can mean. It is
    computed once for each name, so with a digest no array is copied to the name's children.
    """
    keys = ["trace", "source", "native_trace", "kind", "value"]
    refs = parent_references(steps)
    # few sources refer to few kinds, and only these of a source's steps can be meant
    meant = F.broadcast(refs.select("source", "kind").distinct())
    # written once: edges and both gaps read it
    matched = materialize(refs.join(parent_targets(steps, meant), keys, "left"), "matched")
    missing = matched.where(F.col("low").isNull()).select(*_gap("PARENT_MISSING", "child", related(none())))
    several = matched.where("low <> high")
    named = steps.select("trace", "source", "native_trace", "hash", F.explode(F.array(F.struct(F.lit("record").alias("kind"), F.col("record").alias("value")), F.struct(F.lit("span").alias("kind"), F.col("native_span").alias("value")))).alias("t")).select("trace", "source", "native_trace", "t.kind", "t.value", "hash")
    names = several.select(*keys).distinct()
    hashes = named.join(names, keys, "left_semi").groupBy(*keys).agg(related(F.array_sort(F.collect_set("hash"))).alias("hashes"))
    ambiguous = several.join(hashes, keys).select(*_gap("PARENT_AMBIGUOUS", "child", "hashes"))
    one = matched.where("low = high").join(conflicted.select("trace", "source", "record"), ["trace", "source", "record"], "left_anti")
    null = F.lit(None).cast("string")
    edges = one.select("trace", F.col("low").alias("parent"), "child", F.lit("NATIVE_PARENT").alias("kind"), null.alias("delegation"), null.alias("scope")).distinct()
    return with_edge_hash(edges), missing.unionByName(ambiguous)


def _sides(steps: DataFrame) -> DataFrame:
    """(trace, delegation, h, offer, accept): a row for each offer and each acceptance; the other side of it is null.

    ``offer`` and ``accept`` are what the outcome depends on, with source and record of the step they are of.
    """
    offers = steps.select("trace", F.col("hash").alias("h"), "source", "record", F.explode("offers").alias("o")).select(
        "trace", F.col("o.id").alias("delegation"), "h", F.struct(F.col("o.child_source").alias("child_source"), F.col("o.child_agent").alias("child_agent"), F.col("o.scope").alias("scope"), "source", "record").alias("offer")
    )
    accepts = steps.where("accept is not null").select(
        "trace", F.col("accept.id").alias("delegation"), F.col("hash").alias("h"),
        F.struct(F.col("accept.parent.source").alias("p_source"), F.col("accept.parent.record").alias("p_record"), F.col("accept.parent.hash").alias("p_hash"), F.col("accept.scope").alias("scope"), "source", "agent").alias("accept"),
    )
    return offers.unionByName(accepts, allowMissingColumns=True)


def delegation_outcomes(steps: DataFrame) -> DataFrame:
    """One row per (trace, delegation): outcome, subject, related, and for edges parent, child and scope.

    Outcomes are tried in order: reused, offer missing, accept missing, no such parent record,
    wrong parent hash, mismatch, and else an edge (``DELEGATES``). One aggregate over both sides decides all but those
    whose sides don't agree: an acceptance that names the offering step by its hash, source and record names a step
    that is there. What versions the others' parent records have is looked up.
    """
    keys = ["trace", "delegation"]
    o, a = F.col("offer").isNotNull(), F.col("accept").isNotNull()
    of = lambda side: F.when(side, F.col("h"))
    both = _sides(steps).groupBy(*keys).agg(
        F.min(of(o)).alias("o_low"), F.max(of(o)).alias("o_high"), F.min_by("offer", of(o)).alias("offer"), F.min(of(a)).alias("a_low"), F.max(of(a)).alias("a_high"), F.min_by("accept", of(a)).alias("accept"),
        F.array_sort(F.collect_set("h")).alias("users"),
    )
    reused = F.coalesce(F.col("o_low") != F.col("o_high"), F.lit(False)) | F.coalesce(F.col("a_low") != F.col("a_high"), F.lit(False))
    parent = F.col("accept.p_hash")
    names = F.coalesce((F.col("o_low") == parent) & (F.col("offer.source") == F.col("accept.p_source")) & (F.col("offer.record") == F.col("accept.p_record")), F.lit(False))
    # the offering step's own offer is among its offers, so only the two sides are compared
    agrees = F.coalesce(
        (F.col("o_low") == parent) & (F.col("offer.child_source") == F.col("accept.source")) & F.col("accept.agent").isNotNull() & F.col("accept.agent").eqNullSafe(F.col("offer.child_agent"))
        & (F.col("offer.scope") == F.col("accept.scope")) & (F.col("offer.source") != F.col("accept.source")), F.lit(False),
    )
    outcome = F.when(reused, "DELEGATION_REUSED").when(F.col("o_low").isNull(), "OFFER_MISSING").when(F.col("a_low").isNull(), "ACCEPT_MISSING").when(names & agrees, "DELEGATES")
    many, edge = F.col("outcome") == "DELEGATION_REUSED", F.col("outcome") == "DELEGATES"
    open_ = F.col("outcome").isNull()
    judged = materialize(both.withColumn("outcome", outcome).select(
        *keys, "outcome", F.when(many, F.col("users")[0]).otherwise(F.coalesce("a_low", "o_low")).alias("subject"), F.when(many, F.col("users")).otherwise(none()).alias("related"), F.when(edge | open_, parent).alias("parent"),
        F.when(edge | open_, F.col("a_low")).alias("child"), F.when(edge | open_, F.col("offer.scope")).alias("scope"), F.when(open_, F.col("accept.p_source")).alias("p_source"), F.when(open_, F.col("accept.p_record")).alias("p_record"), agrees.alias("agrees"),
    ), "delegations")
    asked = judged.where("outcome is null").drop("outcome", "related")
    if asked.isEmpty():
        return judged.drop("p_source", "p_record", "agrees")
    named = asked.select("trace", F.col("p_source").alias("source"), F.col("p_record").alias("record")).distinct()
    versions_ = versions(steps.select("trace", "source", "record", "hash").join(named, ["trace", "source", "record"], "left_semi"), "source", "record").select("trace", F.col("source").alias("p_source"), F.col("record").alias("p_record"), F.col("hashes").alias("named"))
    found = F.when(F.col("named").isNull(), "DELEGATION_MISMATCH").when(~F.array_contains("named", F.col("parent")), "PARENT_HASH_MISMATCH").when(~F.col("agrees"), "DELEGATION_MISMATCH").otherwise("DELEGATES")
    rest = asked.join(versions_, ["trace", "p_source", "p_record"], "left").withColumn("outcome", found).withColumn("related", F.when(found != "DELEGATES", F.coalesce("named", none())).otherwise(none()))
    columns = [*keys, "outcome", "subject", "related", "parent", "child", "scope"]
    return judged.where("outcome is not null").select(*columns).unionByName(rest.select(*columns))


def delegations(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delegation edges and gaps."""
    judged = delegation_outcomes(steps)
    edges = judged.where("outcome = 'DELEGATES'").select("trace", "parent", "child", F.col("outcome").alias("kind"), "delegation", "scope")
    gaps = judged.where("outcome <> 'DELEGATES'").select("trace", F.col("outcome").alias("code"), "subject", "related")
    return with_edge_hash(edges), gaps
