"""Staging, commits and the audit log as operations on tables, many traces in one plan.

State is tables: what is stored, what is staged, heads of traces, requests answered so far.
Each function says what a set of rows does to them; writing the result is the caller's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.canonical import AUDIT, BATCH, ZERO, canonical, digest_text
from weftline.functions.types import BODY
from weftline.operators.streams import link_check


def envelope_json(body: Column, hash_: Column | str, signature: Column | str | None = None) -> Column:
    """Canonical JSON of a body (a struct with fields in order) with its hash, and signature if it has one."""
    parts = [body.alias("body"), (F.col(hash_) if isinstance(hash_, str) else hash_).alias("hash")]
    if signature is not None:
        parts.append((F.col(signature) if isinstance(signature, str) else signature).alias("signature"))
    return canonical(F.struct(*parts))


def step_json() -> Column:
    return envelope_json(F.struct(*BODY), "hash")


#: Most that an import stages, and the bytes of each row and artifact (fixed values of the data format; rows can be set).
STAGE_ROWS, STAGE_ORIGINS, STAGE_ARTIFACTS, STAGE_BYTES = 1000, 4096, 64, 1 << 20


def stage_faults(staged: DataFrame, rows: int = STAGE_ROWS) -> DataFrame:
    """(import, code, field): the first bound of the format that an import is beyond; counted in one aggregate, nothing is gathered.

    ``staged``: import, kind (row, origin or artifact), place (from 0), bytes. An import without rows is SCHEMA_INVALID.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    long = lambda kind: F.min(F.when((F.col("kind") == kind) & (F.col("bytes") > STAGE_BYTES), F.col("place")))
    sums = staged.groupBy("import").agg(of("row").alias("r"), of("origin").alias("o"), of("artifact").alias("a"), long("row").alias("long_row"), long("artifact").alias("long_artifact"))
    fault = lambda code, field: F.struct(F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field"))
    found = F.coalesce(
        F.when(F.col("r") == 0, fault("SCHEMA_INVALID", "/params/rows")), F.when(F.col("r") > rows, fault("ROW_LIMIT", "/params/rows")), F.when(F.col("o") > STAGE_ORIGINS, fault("ROW_LIMIT", "/params/origins")),
        F.when(F.col("a") > STAGE_ARTIFACTS, fault("ROW_LIMIT", "/params/artifacts")), F.when(F.col("long_row").isNotNull(), fault("ROW_LIMIT", F.concat(F.lit("/params/rows/"), F.col("long_row").cast("string")))),
        F.when(F.col("long_artifact").isNotNull(), fault("ROW_LIMIT", F.concat(F.lit("/params/artifacts/"), F.col("long_artifact").cast("string")))),
    )
    return sums.select("import", found.alias("f")).where("f is not null").select("import", "f.code", "f.field")


def source_standing(asked: DataFrame, stored: DataFrame, most: int = 256) -> DataFrame:
    """``asked`` sources (id, json, place; ``stored``: id, json) with ``standing``: NEW, SAME, SOURCE_CONFLICT, or TRACE_LIMIT beyond ``most`` sources.

    Requests stand in the order of ``place``; of an id asked for several times the first is new.
    """
    first = asked.groupBy("id").agg(F.min_by("json", "place").alias("first"), F.min("place").alias("at"))
    known = first.join(stored.select("id", F.col("json").alias("held")), "id", "left")
    # new ids are at most ``most`` where one is taken at all, so their turn is that of a small table
    turn = known.where("held is null").select("id", F.row_number().over(Window.orderBy("at")).alias("turn"))
    room = most - stored.select("id").distinct().count()
    joined = asked.join(known, "id").join(turn, "id", "left")
    same = F.when(F.col("json") == F.coalesce("held", "first"), "SAME").otherwise("SOURCE_CONFLICT")
    standing = F.when(F.col("held").isNotNull(), same).when(F.col("turn") > room, "TRACE_LIMIT").when(F.col("place") == F.col("at"), "NEW").otherwise(same)
    return joined.select(*asked.columns, standing.alias("standing"))


def batch_hash(batches: DataFrame) -> DataFrame:
    """(import, batch): hash of what an import stages, whatever its order.

    ``batches``: import, trace, source, kind (step, origin or artifact), json (an envelope's
    canonical JSON). An import's envelopes are one document, as ``stage_faults``'s bounds allow; one with more of
    a kind is left out.
    """
    most = {"step": STAGE_ROWS, "origin": STAGE_ORIGINS, "artifact": STAGE_ARTIFACTS}
    over = batches.groupBy("import").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in most)).where(" or ".join(f"{k} > {n}" for k, n in most.items())).select("import")
    listed = lambda kind: F.array_join(F.array_sort(F.filter("all", lambda e: e["kind"] == kind)).getField("json"), ",")
    gathered = batches.join(over, "import", "left_anti").groupBy("import", "trace", "source").agg(F.collect_list(F.struct("kind", "json")).alias("all"))
    text = F.concat(F.lit('{"artifacts":['), listed("artifact"), F.lit('],"origins":['), listed("origin"), F.lit('],"source":"'), "source", F.lit('","steps":['), listed("step"), F.lit('],"trace":"'), "trace", F.lit('"}'))
    return gathered.select("import", digest_text(BATCH, text).alias("batch"))


def stage_warnings(normalized: DataFrame) -> DataFrame:
    """(trace, warnings, native_traces): distinct warnings in order, and how many native traces a stage names (one is allowed)."""
    rows = normalized.where("error is null").select("trace", "native_trace", F.explode_outer("warnings").alias("warning"))
    return rows.groupBy("trace").agg(F.array_sort(F.collect_set("warning")).alias("warnings"), F.count_distinct("native_trace").alias("native_traces"))


def new_steps(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged steps that are not stored, each hash once."""
    return staged.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def new_origins(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged attestations whose envelope is not stored; two envelopes may share a body's hash."""
    return staged.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")


def commit_counters(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """(trace, added, duplicates, conflicts) of a commit of staged steps (trace, source, record, hash).

    A step is added once, however often it is staged; all other rows are duplicates. A conflict is an added step whose
    record has a stored version, or one that was added before it: all but the first of a record, whatever their order.
    Two aggregates, no window. Rows are dealt by what they are joined by, which their aggregate can use too.
    """
    known = stored.select("hash").distinct().withColumn("have", F.lit(True))
    records = stored.select("source", "record").distinct().withColumn("prior", F.lit(1))
    steps = staged.select("trace", "source", "record", "hash").repartition("hash").groupBy("trace", "source", "record", "hash").agg(F.count("*").alias("rows")).join(known, "hash", "left")
    new = F.col("have").isNull()
    each = steps.select("trace", "source", "record", "rows", "have").repartition("source", "record").groupBy("trace", "source", "record").agg(F.sum("rows").alias("rows"), F.count_if(new).alias("added")).join(records, ["source", "record"], "left")
    again = F.greatest(F.col("added") - 1 + F.coalesce("prior", F.lit(0)), F.lit(0))
    return each.groupBy("trace").agg(F.sum("added").cast("long").alias("added"), F.sum(F.col("rows") - F.col("added")).cast("long").alias("duplicates"), F.sum(F.when(F.col("added") > 0, again).otherwise(0)).cast("long").alias("conflicts"))


def binding_conflicts(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """(trace, source, kind, name): native traces and records of staged steps that belong to another trace already."""

    def names(df: DataFrame) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit("native").alias("kind"), F.col("native_trace").alias("name")), F.struct(F.lit("record").alias("kind"), F.col("record").alias("name")))).alias("b")
        return df.select("trace", "source", both).select("trace", "source", "b.kind", "b.name").distinct()

    bound = names(stored).groupBy("source", "kind", "name").agg(F.min("trace").alias("low"), F.max("trace").alias("high"))
    return names(staged).join(bound, ["source", "kind", "name"]).where((F.col("low") != F.col("trace")) | (F.col("high") != F.col("trace"))).select("trace", "source", "kind", "name")


def request_standing(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """``asked`` (id, hash) with ``standing``: NEW, REPLAY of an answered request, or IDEMPOTENCY_CONFLICT with one."""
    joined = asked.join(answered.select("id", F.col("hash").alias("known")), "id", "left")
    return joined.withColumn("standing", F.when(F.col("known").isNull(), "NEW").when(F.col("known") == F.col("hash"), "REPLAY").otherwise("IDEMPOTENCY_CONFLICT")).drop("known")


def commit_standing(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Commits (import, trace, expected) with ``error``: NOT_FOUND, or REVISION_CONFLICT for all but the first that expects the head."""
    joined = commits.join(heads.select("trace", "revision"), "trace", "left")
    turn = F.row_number().over(Window.partitionBy("trace", "expected").orderBy("import"))
    error = F.when(F.col("revision").isNull(), "NOT_FOUND").when((F.col("expected") != F.col("revision")) | (turn > 1), "REVISION_CONFLICT")
    return joined.select("import", "trace", "expected", error.alias("error"))


def import_states(imports: DataFrame, now: int) -> DataFrame:
    """Imports (import, state, reason, expires_at) as of ``now``: staged ones whose time is over are cancelled as EXPIRED."""
    over = (F.col("state") == "STAGED") & (F.col("expires_at") <= now)
    return imports.withColumn("reason", F.when(over, "EXPIRED").otherwise(F.col("reason"))).withColumn("state", F.when(over, "CANCELLED").otherwise(F.col("state")))


def prune_standing(revisions: DataFrame, keep: int, before: int | None = None, leased: DataFrame | None = None) -> DataFrame:
    """``revisions`` (trace, revision; a boolean ``pruned``, if there is the column) with ``standing``.

    PRUNED already, LATEST of its trace (never pruned), NEWER than ``before`` or equal to it, within the WINDOW of the
    last ``keep`` numbers, LEASED (``leased``: trace, revision), or else PRUNE. Revisions count by number, pruned ones too.
    """
    last = revisions.groupBy("trace").agg(F.max("revision").alias("latest"))
    rows = revisions.join(last, "trace")
    held = F.lit(False)
    if leased is not None:
        rows = rows.join(leased.select("trace", "revision").distinct().withColumn("held", F.lit(True)), ["trace", "revision"], "left")
        held = F.coalesce("held", F.lit(False))
    done = F.coalesce("pruned", F.lit(False)) if "pruned" in revisions.columns else F.lit(False)
    newer = F.lit(False) if before is None else F.col("revision") >= before
    standing = (
        F.when(done, "PRUNED").when(F.col("revision") == F.col("latest"), "LATEST").when(newer, "NEWER").when(F.col("revision") >= F.col("latest") - keep + 1, "WINDOW").when(held, "LEASED").otherwise("PRUNE")
    )
    return rows.select(*revisions.columns, standing.alias("standing"))


def prunable(revisions: DataFrame, keep: int, before: int | None = None, leased: DataFrame | None = None) -> DataFrame:
    """Revisions (trace, revision, ...) that may go: see ``prune_standing``."""
    return prune_standing(revisions, keep, before, leased).where("standing = 'PRUNE'").drop("standing")


def prunable_artifacts(artifacts: DataFrame, staged: DataFrame, held: DataFrame, cutoff: int) -> DataFrame:
    """(digest): available artifacts (digest, state, created_at) of up to ``cutoff`` that no import stages and no leased revision's step refers to (both: digest)."""
    old = artifacts.where((F.col("state") == "AVAILABLE") & (F.col("created_at") <= cutoff)).select("digest").distinct()
    return old.join(staged.select("digest"), "digest", "left_anti").join(held.select("digest"), "digest", "left_anti")


AUDIT_ROW = "workspace string, n long, prev string, hash string, body string"


def append_audit(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """Audit rows (workspace, n, prev, hash, body) that follow each workspace's head.

    ``entries``: workspace, place (order), request, key, data (canonical JSON). ``heads``:
    workspace, n, hash; none starts a chain. A chain is serial by its nature: a workspace's
    entries stream through one task in order, which keeps the last hash only.
    """
    rows = entries.join(heads.select("workspace", F.col("n").alias("head"), F.col("hash").alias("head_hash")), "workspace", "left").select("workspace", "place", "request", "key", "data", F.coalesce("head", F.lit(0)).cast("long").alias("head"), F.coalesce("head_hash", F.lit(ZERO)).alias("head_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, prev = None, 0, ZERO
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.workspace != now:
                    now, n, prev = r.workspace, r.head, r.head_hash
                n += 1
                quoted = [json.dumps(x, ensure_ascii=False) for x in (r.key, prev, r.request, str(n), r.workspace)]
                body = '{"data":%s,"key":%s,"prev":%s,"request":%s,"seq":%s,"v":1,"workspace":%s}' % (r.data, *quoted)
                own = hashlib.sha256(AUDIT.encode() + b"\0" + body.encode()).hexdigest()
                out.append((now, n, prev, own, body))
                prev = own
            yield pd.DataFrame(out, columns=["workspace", "n", "prev", "hash", "body"])

    return rows.repartition("workspace").sortWithinPartitions("workspace", "place", "request").mapInPandas(run, AUDIT_ROW)


def audit_faults(log: DataFrame) -> DataFrame:
    """(workspace, n, fault) of a log's entries (workspace, n, prev, hash, body).

    LINK where an entry doesn't follow its predecessor, HASH where its hash isn't its body's, BODY where its columns
    aren't what the body says.
    """
    linked = link_check(log, ["workspace"])
    said = lambda name: F.get_json_object("body", f"$.{name}")
    agrees = said("seq").eqNullSafe(F.col("n").cast("string")) & said("prev").eqNullSafe(F.col("prev")) & said("workspace").eqNullSafe(F.col("workspace"))
    faults = F.array(F.when(~F.col("linked"), "LINK"), F.when(~digest_text(AUDIT, "body").eqNullSafe(F.col("hash")), "HASH"), F.when(~agrees, "BODY"))
    return linked.select("workspace", "n", F.explode(F.array_compact(faults)).alias("fault"))


def audit_head(log: DataFrame) -> DataFrame:
    """(workspace, n, hash) of each log's last entry."""
    return log.groupBy("workspace").agg(F.max("n").alias("n"), F.max_by("hash", "n").alias("hash"))


def audit_prefix(log: DataFrame, bindings: DataFrame) -> DataFrame:
    """Entries up to the one that binds a revision; ``bindings``: workspace, n."""
    return log.join(bindings.select("workspace", F.col("n").alias("last")), "workspace").where("n <= last").drop("last")
