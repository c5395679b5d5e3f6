"""All revisions at once against one reduction a revision, and deep checks of a store."""

import base64
import hashlib
import random

import lineage_case as case
from pyspark.sql import functions as F

from weftline.functions.types import ORIGINS
from weftline.plans import revisions
from weftline.plans.reduction import manifests, reduce_steps
from weftline.storage import materialize


def history(seed):
    """Rows (source, raw) and attestations that arrive at random revisions: versions, missing and ambiguous parents, delegations of every outcome, cycles, forks."""
    r = random.Random(seed)
    names = [f"r{i}" for i in range(6)]
    rows = [case.row_a(record=n, parent=r.choice([None, *names, "gone"])) for n in names] + [case.row_a(case.lineage(agent=case.agent(x)), record="r1", parent=r.choice(names)) for x in "xy"]
    rows += [case.row_c(record=f"c{i}", span=r.choice("pq"), parents=[r.choice("pqs")]) for i in range(5)]
    rows += [case.row_a(case.META_A), case.row_b(case.META_B), case.row_c(case.META_C)]
    rows += [case.row_b(case.META_B, record=f"b{i}") for i in range(r.choice([0, 1]))] + [case.row_a(case.lineage(policy=case.POLICY), record="a")] * r.choice([0, 1])
    links, prev = [], case.ZERO
    for n, h in enumerate(("A", "B", "C"), 1):
        o = case.origin(case.SA, {"A": case.HASH_A, "B": case.HASH_B, "C": case.HASH_C}[h], "l", n, prev)
        links.append(o)
        prev = o["hash"]
    links.append(case.origin(case.SA, case.HASH_C, "l", 2, links[0]["hash"], stream="main"))
    return rows, links, r


def test_every_revision_is_what_reducing_it_gives(spark):
    """Several traces at once, each with a history of its own; three arrive in order, so that all outcomes are met."""
    parts, seen = [], []
    names = [c.strip().split(" ")[0] for c in ORIGINS.split(",")]
    for seed in range(4):
        rows, links, r = history(seed)
        steps = case.steps_of(spark, rows)
        trace = "vlt_" + f"{seed}" * 21
        parts.append((steps.collect(), trace, r))
        seen += [(*(o[n] for n in names), trace, r.randint(1, 4)) for o in links]
    kind = steps.schema.fieldNames()
    listed = [tuple(trace if c == "trace" else s[c] for c in kind) + (r.randint(1, 4),) for rows, trace, r in parts for s in sorted(rows, key=lambda s: s.hash)]
    from pyspark.sql import types as T

    table = materialize(spark.createDataFrame(listed, T.StructType([*steps.schema.fields, T.StructField("first", T.LongType())])), "given")
    origins = materialize(spark.createDataFrame(seen, f"{ORIGINS}, trace string, first long"), "given-origins")
    asked = table.select("trace", "workspace").distinct().crossJoin(spark.range(5).withColumnRenamed("id", "revision"))
    got = {(r.trace, r.revision): (r.manifest, r.graph) for r in revisions.graphs(table, asked, origins).collect()}
    assert len(got) == 20
    codes = set()
    # one reduction a revision, each trace at a revision as a trace of its own
    key = F.concat_ws("@", "trace", F.col("revision").cast("string"))
    at = lambda df: df.join(spark.range(5).withColumnRenamed("id", "revision"), F.col("first") <= F.col("revision")).withColumn("of", F.col("trace")).withColumn("trace", key).drop("first", "revision")
    names = asked.select(key.alias("trace"), "workspace", F.col("trace").alias("named"))
    from weftline.plans.reduction import rename_traces

    one = rename_traces(reduce_steps(at(table).drop("of"), at(origins).drop("of")), names)
    want = {r.trace: (r.manifest, r.graph) for r in manifests(at(table).drop("of"), one, at(origins).drop("of"), names).collect()}
    codes = {r.code for r in one.gaps.select("code").distinct().collect()}
    assert {f"{t}@{n}": v for (t, n), v in got.items()} == want
    assert codes >= {"SOURCE_CONFLICT", "PARENT_MISSING", "PARENT_AMBIGUOUS", "ORIGIN_FORK", "ORIGIN_GAP", "ACCEPT_MISSING", "OFFER_MISSING"}, codes


def test_deep_check(spark, tmp_path):
    steps = materialize(case.steps_of(spark, case.ROWS).withColumn("first", F.element_at(F.create_map(*(F.lit(x) for x in ("a", 1, "b", 2, "c", 3))), F.col("record")).cast("long")), "doctor-steps")
    origins = case.origins_of(spark, case.ORIGINS).withColumn("trace", F.lit(case.T)).withColumn("first", F.element_at(F.create_map(*(F.lit(x) for x in (case.SA, 1, case.SB, 2, case.SC, 3))), F.col("source")).cast("long"))
    asked = spark.createDataFrame([(case.T, case.W, n) for n in range(4)], "trace string, workspace string, revision long")
    made = materialize(revisions.graphs(steps, asked, origins), "doctor-graphs")
    assert {r.revision: r.graph for r in made.collect()} == case.GRAPHS
    stored = made.withColumn("workspace", F.lit(case.W)).withColumn("graph", F.when(F.col("revision") == 2, case.ONE).otherwise(F.col("graph"))).withColumn("manifest", F.when(F.col("revision") != 3, F.col("manifest")))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    files = spark.createDataFrame([(digest(b"one"), b64(b"one")), (digest(b"two"), b64(b"two")), (digest(b"three"), b64(b"other")), (digest(b"one"), b64(b"one"))], "digest string, content string")
    for _ in range(2):  # again: what is there stays
        written = {r.digest: r.path for r in revisions.write_artifacts(files, str(tmp_path / "files")).collect()}
    path = lambda x: f"{digest(x)[:2]}/{digest(x)[2:6]}/{digest(x)}"
    assert written == {digest(b"one"): path(b"one"), digest(b"two"): path(b"two"), digest(b"three"): None}
    (tmp_path / "files" / path(b"two")).write_bytes(b"changed")
    (tmp_path / "files" / "stray").write_bytes(b"x")
    artifacts = spark.createDataFrame([(digest(x), "AVAILABLE", path(x)) for x in (b"one", b"two", b"gone", b"")] + [(digest(b"old"), "PRUNED", None)], "digest string, state string, path string")
    wrong = steps.withColumn("hash", F.when(F.col("record") == "c", case.ONE).otherwise(F.col("hash")))
    held = revisions.stored_files(spark, str(tmp_path / "files"))
    log = spark.createDataFrame([(case.W, 1, case.ZERO, case.ONE, "{}")], "workspace string, n long, prev string, hash string, body string")
    got = {r.reason for r in revisions.doctor(stored, steps, origins, artifacts, held, log).collect()}
    assert got == {
        f"GRAPH_MISMATCH:{case.T}@2", f"MANIFEST_MISMATCH:{case.T}@3", f"ARTIFACT_HASH:{digest(b'two')}", f"ARTIFACT_MISSING:{digest(b'gone')}", "ARTIFACT_ORPHAN:stray", "AUDIT_HASH:1", "AUDIT_BODY:1",
    }
    assert [r.hash for r in revisions.step_faults(wrong).collect()] == [case.ONE]


def test_projection_reads_one_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 9}", f"h{i}", i % 4, None if i % 3 else i % 4 + 1) for i in range(90)], "trace string, hash string, since long, until long")
    path = str(tmp_path / "members")
    revisions.write_projection(rows, path, 8)
    got = revisions.read_revision(spark, path, "t4", 2, 8)
    assert sorted(r.hash for r in got.collect()) == sorted(r.hash for r in rows.where("trace = 't4' and since <= 2 and (until is null or until > 2)").collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(trace)" in plan
