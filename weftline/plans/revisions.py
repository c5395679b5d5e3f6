"""All revisions of traces at once: membership and what follows from it as intervals of revisions, and deep checks of a store.

A trace only grows: a step or attestation belongs to its revisions from ``first`` on. What a reduction gives changes only
where something near it arrives, so each edge and gap is computed once with the revisions it holds for (``since`` up to
before ``until``; null: still), not once a revision. Only manifests, which list their contents, are put together
for each revision.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.canonical import STEP, ZERO, digest, from_base64url
from weftline.functions.types import BODY
from weftline.operators import graph, resolve, streams
from weftline.operators.resolve import none, with_edge_hash
from weftline.plans.reduction import Reduced, manifests
from weftline.storage import materialize

EDGE = ("trace", "parent", "child", "kind", "delegation", "scope")
GAP = ("trace", "code", "subject", "related")


def _holds(since: str = "since", until: str = "until") -> Column:
    return F.col(until).isNull() | (F.col(since) < F.col(until))


def _members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members): the distinct hashes of each key with the revision of each, in the order of arrival."""
    each = rows.groupBy(*keys, "hash").agg(F.min("first").alias("first"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "hash"))).alias("members"))


def _states(members: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, since, until, hashes): what a key stands for from each revision that changes it, where that is ``least`` hashes or more."""
    points = F.array_distinct(F.transform("members", lambda m: m["first"]))
    rows = members.where(F.size("members") >= least).withColumn("points", points).select(*keys, "members", "points", F.posexplode("points").alias("i", "since"))
    hashes = F.array_sort(F.transform(F.filter("members", lambda m: m["first"] <= F.col("since")), lambda m: m["hash"]))
    return rows.select(*keys, "since", F.get("points", F.col("i") + 1).alias("until"), hashes.alias("hashes")).where(F.size("hashes") >= least)


def _spans(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, since, until) between the distinct revisions ``at`` of each key."""
    listed = points.groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("points"))
    return listed.select(*keys, "points", F.posexplode("points").alias("i", "since")).select(*keys, "since", F.get("points", F.col("i") + 1).alias("until"))


def _gap(rows: DataFrame, code: str, subject: str | Column, related: Column) -> DataFrame:
    return rows.select("trace", F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), related.alias("related"), "since", "until")


def _native(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Native edges and gaps, and gaps of records with versions, with their revisions."""
    record = ["trace", "source", "record"]
    versions = _members(steps.select(*record, "hash", "first"), record).where(F.size("members") > 1)
    conflicts = _gap(_states(versions, record, 2), "SOURCE_CONFLICT", F.col("hashes")[0], F.col("hashes"))
    keys = ["trace", "source", "native_trace", "kind", "value"]
    asked = steps.select("trace", "source", "native_trace", "record", F.col("hash").alias("child"), "first", F.explode("parents").alias("p")).select("trace", "source", "native_trace", "record", "child", "first", "p.kind", "p.value")
    ids = F.explode(F.array(F.struct(F.lit("record").alias("kind"), F.col("record").alias("value")), F.struct(F.lit("span").alias("kind"), F.col("native_span").alias("value")))).alias("t")
    named = steps.select("trace", "source", "native_trace", "hash", "first", ids).select("trace", "source", "native_trace", "t.kind", "t.value", "hash", "first")
    targets = materialize(_members(named.join(asked.select(*keys).distinct(), keys, "left_semi"), keys), "targets")
    joined = asked.join(targets, keys, "left").join(versions.select(*record, F.col("members")[1]["first"].alias("versioned")), record, "left")
    one, two = F.get("members", F.lit(0))["first"], F.get("members", F.lit(1))["first"]
    missing = joined.select("trace", "child", F.col("first").alias("since"), one.alias("until")).where(_holds())
    null = F.lit(None).cast("string")
    edges = joined.where("members is not null").select("trace", F.col("members")[0]["hash"].alias("parent"), "child", F.lit("NATIVE_PARENT").alias("kind"), null.alias("delegation"), null.alias("scope"), F.greatest("first", one).alias("since"), F.least(two, "versioned").alias("until"))
    several = asked.join(_states(targets, keys, 2), keys).select("trace", "child", "hashes", F.greatest("first", "since").alias("since"), "until").where(_holds())
    gaps = conflicts.unionByName(_gap(missing, "PARENT_MISSING", "child", none())).unionByName(_gap(several, "PARENT_AMBIGUOUS", "child", F.col("hashes")))
    return edges.where(_holds()), gaps


def _delegations(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delegation edges and gaps: each id is judged at the revisions at which a step that offers, accepts or is named arrives."""
    keys = ["trace", "delegation"]
    offers = steps.select("trace", F.explode("offers.id").alias("delegation"), "hash", "first")
    accepts = steps.where("accept is not null").select("trace", F.col("accept.id").alias("delegation"), "hash", "first", F.col("accept.parent.source").alias("source"), F.col("accept.parent.record").alias("record"))
    named = accepts.select(*keys, "source", "record").distinct().join(steps.select("trace", "source", "record", "hash", "first"), ["trace", "source", "record"])
    members = materialize(offers.unionByName(accepts.select(*keys, "hash", "first")).unionByName(named.select(*keys, "hash", "first")).distinct(), "members")
    spans = materialize(_spans(members.withColumnRenamed("first", "at"), keys).withColumn("key", F.concat_ws("/", *keys, F.col("since").cast("string"))), "spans")
    present = members.join(spans, keys).where("first <= since").select("trace", "key", "hash")
    at = steps.drop("first").join(present, ["trace", "hash"]).drop("trace").withColumnRenamed("key", "trace")
    judged = resolve.delegation_outcomes(at).withColumnRenamed("trace", "key").join(spans, ["key", "delegation"])
    edges = judged.where("outcome = 'DELEGATES'").select("trace", "parent", "child", F.col("outcome").alias("kind"), "delegation", "scope", "since", "until")
    gaps = judged.where("outcome <> 'DELEGATES'").select("trace", F.col("outcome").alias("code"), "subject", "related", "since", "until")
    return edges, gaps


def _acyclic(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges but those within a cycle set, and the sets as gaps. Only edges that may lie on a cycle of all revisions together are looked at by revision."""
    ends = ["trace", "parent", "child"]
    residue = materialize(graph.peel(edges), "residue")
    active = edges.join(residue, ends, "left_semi")
    points = active.select("trace", F.explode(F.array_compact(F.array("since", "until"))).alias("at"))
    spans = materialize(_spans(points, ["trace"]).withColumn("key", F.concat_ws("/", "trace", F.col("since").cast("string"))), "spans")
    at = active.withColumnsRenamed({"since": "from", "until": "to"}).join(spans, "trace").where("`from` <= since and (`to` is null or since < `to`)").withColumnRenamed("trace", "of").withColumnRenamed("key", "trace")
    found = materialize(graph.cycles(at), "cycles")
    kept = graph.without_cycles(at, found).drop("trace", "from", "to").withColumnRenamed("of", "trace")
    gaps = graph.cycle_gaps(found).withColumnRenamed("trace", "key").join(spans, "key").select(*GAP, "since", "until")
    return edges.join(residue, ends, "left_anti").unionByName(kept.select(*edges.columns)), gaps


def _origin_gaps(origins: DataFrame, steps: DataFrame) -> DataFrame:
    """Gaps of attestation streams; only streams that have a fork, or a link that came before its predecessor, are looked at by revision."""
    keys = ["trace", "source", "stream"]
    links = origins.withColumn("n", F.col("seq").cast("long")).groupBy(*keys, "n", "hash", "prev").agg(F.min("first").alias("first"))
    before = links.select(*keys, (F.col("n") + 1).alias("n"), F.col("hash").alias("prev"), F.col("first").alias("came"))
    late = links.join(before, [*keys, "n", "prev"], "left").where(F.when(F.col("n") == 1, F.col("prev") != ZERO).otherwise(F.col("came").isNull() | (F.col("came") > F.col("first"))))
    odd = materialize(late.select(*keys).unionByName(streams.forks(origins).select(*keys)).distinct(), "odd-streams")
    of = origins.join(odd, keys, "left_semi")
    seen = of.select(*keys, F.col("step").alias("hash")).distinct().join(steps.select("trace", "hash", "first"), ["trace", "hash"])
    spans = materialize(_spans(of.select(*keys, F.col("first").alias("at")).unionByName(seen.select(*keys, F.col("first").alias("at"))), keys).withColumn("span", F.concat_ws("/", *keys, F.col("since").cast("string"))), "spans")
    there = lambda df: df.join(spans, keys).where("first <= since").drop("trace").withColumnRenamed("span", "trace")  # noqa: E731  (an attestation has a key of its own)
    gaps = streams.origin_gaps(there(of), there(seen).select("trace", "hash"))
    return gaps.withColumnRenamed("trace", "span").join(spans, "span").select(*GAP, "since", "until")


def reduce_revisions(steps: DataFrame, origins: DataFrame | None = None) -> Reduced:
    """Edges (as ``reduce_steps`` gives them) and gaps of all revisions, each with ``since`` and ``until``.

    ``steps`` and ``origins`` have ``first``, the revision of their trace at which they arrived; ``origins`` are those
    pinned to each trace. An edge or gap may have several rows, of revisions that don't overlap.
    """
    first = steps.groupBy("trace", "hash").agg(F.min("first").alias("_first"))
    steps = materialize(steps.dropDuplicates(["trace", "hash"]).join(first, ["trace", "hash"]).withColumn("first", F.col("_first")).drop("_first"), "steps")
    native, gaps = _native(steps)
    delegated, more = _delegations(steps)
    candidates = materialize(native.unionByName(delegated).distinct(), "candidates")
    edges, cyclic = _acyclic(candidates)
    parts = [gaps, more, cyclic]
    if origins is not None:
        parts.append(_origin_gaps(origins, steps))
    return Reduced(with_edge_hash(edges), fold(DataFrame.unionByName, parts).distinct())


def at_revisions(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows (trace, since, until, ...) that hold at each of ``revisions`` (trace, revision, key), with the key for trace."""
    return rows.join(revisions.select("trace", "revision", "key"), "trace").where("since <= revision and (until is null or revision < until)").drop("trace", "since", "until", "revision").withColumnRenamed("key", "trace")


def graphs(steps: DataFrame, revisions: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(trace, revision, manifest, graph) of each of ``revisions`` (trace, workspace, revision); steps and origins as ``reduce_revisions`` takes them."""
    asked = materialize(revisions.select("trace", "workspace", "revision").distinct().withColumn("key", F.concat_ws("@", "trace", F.col("revision").cast("string"))), "revisions")
    reduced = reduce_revisions(steps, origins)
    lasting = lambda df: at_revisions(df.select("trace", "hash", F.col("first").alias("since"), F.lit(None).cast("long").alias("until")), asked)
    edges = at_revisions(reduced.edges.select("trace", "hash", "since", "until"), asked)
    made = manifests(lasting(steps), Reduced(edges, at_revisions(reduced.gaps, asked)), None if origins is None else lasting(origins), asked.select(F.col("key").alias("trace"), "workspace", F.col("trace").alias("named")))
    return made.withColumnRenamed("trace", "key").join(asked, "key").select("trace", "revision", "manifest", "graph")


def graph_faults(stored: DataFrame, made: DataFrame) -> DataFrame:
    """(trace, revision, fault): revisions stored (trace, revision, graph, manifest) otherwise than ``graphs`` makes them.

    GRAPH_MISMATCH and MANIFEST_MISMATCH, each on its own; a revision that can't be made has both.
    """
    both = stored.join(made.select("trace", "revision", F.col("graph").alias("own"), F.col("manifest").alias("text")), ["trace", "revision"], "left")
    faults = F.array_compact(F.array(F.when(~F.col("graph").eqNullSafe(F.col("own")) | F.col("own").isNull(), "GRAPH_MISMATCH"), F.when(~F.col("manifest").eqNullSafe(F.col("text")) | F.col("text").isNull(), "MANIFEST_MISMATCH")))
    return both.select("trace", "revision", F.explode(faults).alias("fault"))


def step_faults(steps: DataFrame) -> DataFrame:
    """(hash): stored steps whose hash isn't that of their body."""
    return steps.where(digest(STEP, F.struct(*BODY)) != F.col("hash")).select("hash").distinct()


def artifact_faults(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(name, fault): available artifacts (digest, state, path) that have no file (path, digest), or one of another digest, and files of no artifact.

    ``stored_files`` reads files and their digests. Spark's reader passes over files without content, so an artifact of no
    bytes isn't held against its file, and an empty file is no orphan.
    """
    there = files.select("path", F.col("digest").alias("own"))
    held = artifacts.where((F.col("state") == "AVAILABLE") & (F.col("digest") != F.sha2(F.lit(b""), 256))).join(there, "path", "left")
    fault = F.when(F.col("own").isNull(), "ARTIFACT_MISSING").when(F.col("own") != F.col("digest"), "ARTIFACT_HASH")
    orphans = there.join(artifacts.where("path is not null").select("path"), "path", "left_anti").select(F.col("path").alias("name"), F.lit("ARTIFACT_ORPHAN").alias("fault"))
    return held.select(F.col("digest").alias("name"), fault.alias("fault")).where("fault is not null").unionByName(orphans)


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest) of all files of a folder that have content, paths below it; digests are made where the files are read."""
    below = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(below.alias("path"), F.sha2("content", 256).alias("digest"))


def write_artifacts(artifacts: DataFrame, folder: str) -> DataFrame:
    """(digest, path) of artifacts (digest, content as base64url), whose bytes are written to files named by their digest.

    A digest is written once, by the task that has it; a file that is there already stays, as its name says what it
    holds. Content of another digest isn't written and has no path. Files appear whole: written aside, then renamed.
    """
    raw = from_base64url("content")
    path = F.concat_ws("/", F.substring("digest", 1, 2), F.substring("digest", 3, 4), "digest")
    rows = artifacts.dropDuplicates(["digest"]).select("digest", raw.alias("raw"), F.when(F.sha2(raw, 256) == F.col("digest"), path).alias("path")).repartition("digest")

    def put(batches):
        import os
        import uuid
        from urllib.parse import urlparse

        import pyarrow as pa
        from pyarrow import fs

        where = urlparse(folder)
        system, base = (fs.LocalFileSystem(), where.path if where.scheme else folder) if where.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, raw in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                target = None if path is None else os.path.join(base, path)
                if target is None or system.get_file_info(target).type != fs.FileType.NotFound:
                    continue
                system.create_dir(os.path.dirname(target))
                aside = f"{target}.tmp-{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(raw)
                system.move(aside, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["digest", "path"])

    return materialize(rows.mapInArrow(put, "digest string, path string"), "artifact-files")


def write_projection(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Members or derived rows (trace, since, until, ...) of all revisions in one table, partitioned so that a trace is in one bucket."""
    rows.withColumn("bucket", bucket(F.col("trace"), buckets)).repartition("bucket").sortWithinPartitions("trace", "since").write.mode("error").partitionBy("bucket").parquet(path)


def bucket(trace: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trace), F.lit(buckets)).cast("int")


def read_revision(spark: SparkSession, path: str, trace: str, revision: int, buckets: int = 64) -> DataFrame:
    """Rows of a projection that hold at one revision of a trace: one partition is read, and of that the row groups of the trace."""
    at = spark.range(1).select(bucket(F.lit(trace), buckets)).first()[0]
    held = spark.read.parquet(path).where((F.col("bucket") == at) & (F.col("trace") == trace) & (F.col("since") <= revision) & (F.col("until").isNull() | (F.col("until") > revision)))
    return held.drop("bucket")


def doctor(stored: DataFrame, steps: DataFrame, origins: DataFrame | None, artifacts: DataFrame, files: DataFrame, log: DataFrame) -> DataFrame:
    """(reason): all that a deep check of a store finds, as text. ``log`` is the audit log, ``stored`` the unpruned revisions with their workspace."""
    from weftline.plans.ledger import audit_faults

    text = lambda *parts: F.concat(*(F.lit(p) if i % 2 else F.col(p) for i, p in enumerate(parts))).alias("reason")
    made = graphs(steps, stored, origins)
    found = [
        graph_faults(stored, made).withColumn("revision", F.col("revision").cast("string")).select(text("fault", ":", "trace", "@", "revision")),
        step_faults(steps).select(F.concat(F.lit("STEP_HASH:"), "hash").alias("reason")),
        artifact_faults(artifacts, files).select(text("fault", ":", "name")),
        audit_faults(log).select(F.concat(F.lit("AUDIT_"), "fault", F.lit(":"), F.col("n").cast("string")).alias("reason")),
    ]
    return fold(DataFrame.unionByName, found).distinct()
