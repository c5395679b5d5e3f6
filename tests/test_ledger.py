"""Batches, commits, the audit log, inventories and stored graphs, on a small workspace."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

import lineage_case as case
from weftline.functions.types import ORIGIN_BODY
from weftline.plans import inventory, ledger


def test_batch_hash_whatever_the_order(spark):
    steps = case.steps_of(spark, case.ROWS[:1]).select(F.lit("i").alias("import"), "trace", "source", F.lit("step").alias("kind"), ledger.step_json().alias("json"))
    origin = case.origins_of(spark, case.ORIGINS[:1])
    body = ledger.envelope_json(F.struct(*ORIGIN_BODY), "hash", "signature").alias("json")
    origins = origin.select(F.lit("i").alias("import"), F.lit(case.T).alias("trace"), "source", F.lit("origin").alias("kind"), body)
    for rows in (steps.unionByName(origins), origins.unionByName(steps)):
        assert [tuple(r) for r in ledger.batch_hash(rows).collect()] == [("i", "2c7686a3bef575039478fc56d4431a9f1b41d3f9b3fe5382b220407895ccde1c")]


def test_bounds_of_a_stage_and_of_sources(spark):
    rows = lambda name, kind, n, size=9: [(name, kind, i, size if i == n - 1 else 1) for i in range(n)]
    long = ledger.STAGE_BYTES + 1
    staged = rows("good", "row", 1000) + rows("many", "row", 1001) + rows("o", "row", 1) + rows("o", "origin", 4097) + rows("a", "row", 2) + rows("a", "artifact", 65) + rows("r", "row", 4, long) + rows("f", "row", 1) + rows("f", "artifact", 3, long) + rows("none", "origin", 1)
    got = {r["import"]: (r.code, r.field) for r in ledger.stage_faults(spark.createDataFrame(staged, "import string, kind string, place int, bytes long")).collect()}
    limit = lambda at: ("ROW_LIMIT", f"/params/{at}")
    assert got == {"many": limit("rows"), "o": limit("origins"), "a": limit("artifacts"), "r": limit("rows/3"), "f": limit("artifacts/2"), "none": ("SCHEMA_INVALID", "/params/rows")}
    stored = spark.createDataFrame([(f"s{i}", "{}") for i in range(3)], "id string, json string")
    asked = spark.createDataFrame([(0, "s0", "{}"), (1, "s1", "[]"), (2, "n", "{}"), (3, "n", "{}"), (4, "n", "[]"), (5, "m", "{}"), (6, "k", "{}")], "place int, id string, json string")
    assert [r.standing for r in ledger.source_standing(asked, stored, 5).orderBy("place").collect()] == ["SAME", "SOURCE_CONFLICT", "NEW", "SAME", "SOURCE_CONFLICT", "NEW", "TRACE_LIMIT"]


def test_commits_and_bindings(spark):
    kind = "trace string, place string, source string, record string, native_trace string, hash string"
    stored = spark.createDataFrame([("t", "0", "s", "a", "n", "h1"), ("u", "0", "s", "b", "m", "h2")], kind)
    staged = spark.createDataFrame([("t", "1", "s", "a", "n", "h1"), ("t", "2", "s", "a", "n", "h3"), ("t", "3", "s", "c", "n", "h4"), ("t", "4", "s", "c", "n", "h5"), ("t", "5", "s", "d", "m", "h6")], kind)
    assert [tuple(r) for r in ledger.commit_counters(staged, stored).collect()] == [("t", 4, 1, 2)]
    again = staged.unionByName(staged.where("hash = 'h3'")).unionByName(spark.createDataFrame([("t", "6", "s", "e", "n", "h7")] * 3, kind))
    assert [tuple(r) for r in ledger.commit_counters(again, stored).collect()] == [("t", 5, 4, 2)]  # a step staged three times is added once
    assert sorted(r.hash for r in ledger.new_steps(staged, stored).collect()) == ["h3", "h4", "h5", "h6"]
    origins = lambda *d: spark.createDataFrame([(x, h) for x, h in d], "digest string, hash string")
    assert sorted(tuple(r) for r in ledger.new_origins(origins(("d1", "h"), ("d2", "h"), ("d2", "h"), ("d3", "g")), origins(("d3", "g"))).collect()) == [("d1", "h"), ("d2", "h")]
    assert [tuple(r) for r in ledger.binding_conflicts(staged, stored).collect()] == [("t", "s", "native", "m")]
    heads = spark.createDataFrame([("t", 3)], "trace string, revision int")
    commits = spark.createDataFrame([("i", "t", 3), ("j", "t", 3), ("k", "t", 2), ("l", "x", 0)], "import string, trace string, expected int")
    assert {r["import"]: r.error for r in ledger.commit_standing(commits, heads).collect()} == {"i": None, "j": "REVISION_CONFLICT", "k": "REVISION_CONFLICT", "l": "NOT_FOUND"}
    imports = spark.createDataFrame([("i", "STAGED", None, 5), ("j", "STAGED", None, 6), ("k", "COMMITTED", None, 1)], "import string, state string, reason string, expires_at long")
    assert {r["import"]: (r.state, r.reason) for r in ledger.import_states(imports, 5).collect()} == {"i": ("CANCELLED", "EXPIRED"), "j": ("STAGED", None), "k": ("COMMITTED", None)}
    warned = ledger.stage_warnings(case.normalized(spark, [case.row_a(), case.row_b(case.META_B)])).first()
    assert (warned.warnings, warned.native_traces) == (["METADATA_ABSENT"], 2)


def test_what_may_be_pruned(spark):
    """By number, never the latest; leased revisions and what they refer to stay."""
    revisions = spark.createDataFrame([("t", n, n == 1) for n in (1, 2, 3, 5, 8, 9)] + [("u", 4, False)], "trace string, revision long, pruned boolean")
    leased = spark.createDataFrame([("t", 3)], "trace string, revision long")
    standing = lambda *args: {(r.trace, r.revision): r.standing for r in ledger.prune_standing(revisions, *args).collect()}
    assert standing(2, 8, leased) == {("t", 1): "PRUNED", ("t", 2): "PRUNE", ("t", 3): "LEASED", ("t", 5): "PRUNE", ("t", 8): "NEWER", ("t", 9): "LATEST", ("u", 4): "LATEST"}
    assert standing(5)["t", 5] == "WINDOW" and sorted(map(tuple, ledger.prunable(revisions.drop("pruned"), 0).select("trace", "revision").collect())) == [("t", n) for n in (1, 2, 3, 5, 8)]
    artifacts = spark.createDataFrame([("a", "AVAILABLE", 5), ("b", "AVAILABLE", 5), ("c", "AVAILABLE", 6), ("d", "PRUNED", 1), ("e", "AVAILABLE", 5)], "digest string, state string, created_at long")
    named = lambda *d: spark.createDataFrame([(x,) for x in d], "digest string")
    assert [r.digest for r in ledger.prunable_artifacts(artifacts, named("b"), named("e", "e"), 5).collect()] == ["a"]


def test_audit_chain(spark):
    entries = spark.createDataFrame([("w", f"{i:03d}", f"q{i}", "k", '{"kind":"X"}') for i in range(5)] + [("v", "000", "q", "k", "{}")], "workspace string, place string, request string, key string, data string")
    heads = spark.createDataFrame([("w", 7, "1" * 64)], "workspace string, n long, hash string")
    log = ledger.append_audit(entries, heads)
    rows = sorted((r.workspace, r.n, r.prev, r.hash, r.body) for r in log.collect())
    assert [(w, n) for w, n, *_ in rows] == [("v", 1), *(("w", n) for n in range(8, 13))]
    assert rows[0][2] == "0" * 64 and rows[1][2] == "1" * 64 and all(a[3] == b[2] for a, b in zip(rows[1:], rows[2:]))
    assert all(hashlib.sha256(b"VL-AUDIT/1\0" + r[4].encode()).hexdigest() == r[3] and json.dumps(json.loads(r[4]), sort_keys=True, separators=(",", ":")) == r[4] for r in rows)
    assert {(r.workspace, r.n, r.hash) for r in ledger.audit_head(log).collect()} == {("v", 1, rows[0][3]), ("w", 12, rows[-1][3])}
    changed = log.withColumn("body", F.when(F.col("n") == 10, F.replace("body", F.lit("X"), F.lit("Y"))).otherwise(F.col("body"))).where("n <> 9")
    assert {(r.workspace, r.n, r.fault) for r in ledger.audit_faults(changed).collect()} == {("w", 8, "LINK"), ("w", 10, "LINK"), ("w", 10, "HASH")}
    other = log.withColumn("n", F.when(F.col("n") == 12, 12).otherwise(F.col("n"))).withColumn("workspace", F.lit("u")).where("n > 7")
    assert {(r.n, r.fault) for r in ledger.audit_faults(other).collect()} == {(8, "LINK"), *((n, "BODY") for n in range(8, 13))}
    assert ledger.audit_prefix(log, spark.createDataFrame([("w", 9)], "workspace string, n long")).count() == 2


def test_inventories_and_attachments(spark):
    kind = "bundle string, kind string, json string"
    want = inventory.items(spark.createDataFrame([("b", "step", x) for x in ("one", "two", "four")], kind))
    held = inventory.items(spark.createDataFrame([("b", "step", x) for x in ("one", "three", "four", "four")], kind))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(r.digest, r.fault) for r in inventory.inventory_diff(want, held).collect()} == {(digest("two"), "MISSING"), (digest("three"), "UNEXPECTED"), (digest("four"), "TWICE")}
    assert inventory.inventory_diff(want, want).count() == 0
    b64 = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    refs = [(x, "text", str(len(x))) for x in ("good", "gone", "other", "long")]
    refs = spark.createDataFrame([("t", digest(x), f, n) for x, f, n in refs], "trace string, digest string, format string, bytes string")
    given = [("t", digest("good"), "text", "4", b64("good")), ("t", digest("other"), "html", "5", b64("other")), ("t", digest("long"), "text", "4", b64("longer")), ("t", digest("more"), "text", "4", b64("more"))]
    given = spark.createDataFrame(given, "trace string, digest string, format string, bytes string, content string")
    assert {(r.digest, r.fault) for r in inventory.attachment_faults(refs, given).collect()} == {(digest("gone"), "UNAVAILABLE"), (digest("other"), "FORMAT"), (digest("long"), "DIGEST"), (digest("more"), "UNEXPECTED")}
    assert inventory.attachment_faults(refs, given.limit(0), include=False).count() == 0


def test_stored_graphs(spark):
    steps, origins = case.steps_of(spark, case.ROWS), case.origins_of(spark, case.ORIGINS).withColumn("trace", F.lit(case.T))
    heads = spark.createDataFrame([(case.T, case.GRAPHS[3])], "trace string, graph string")
    assert inventory.graph_faults(heads, steps, origins).count() == 0
    wrong = inventory.graph_faults(heads, steps.where(F.col("record") != "c"), origins.limit(2)).collect()
    assert [r.trace for r in wrong] == [case.T]


def test_commit_counters_deal_rows_once_for_each_join(spark):
    from weftline.plans import ledger

    rows = spark.range(40).selectExpr("cast(id % 3 as string) trace", "cast(id % 2 as string) source", "cast(id % 9 as string) record", "cast(id % 20 as string) hash")
    staged, stored = rows.where("hash < '5'"), rows.where("hash > '3'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ledger.commit_counters(staged, stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 5, plan  # staged, what is known, records twice, traces
    have, prior = {r.hash for r in stored.collect()}, {(r.source, r.record) for r in stored.collect()}
    new, want = {}, {}
    for r in staged.collect():
        w = want.setdefault(r.trace, [0, 0, 0])
        key = (r.trace, r.source, r.record)
        if r.hash in have or r.hash in new.get(key, ()):
            w[1] += 1
        else:
            w[0] += 1
            w[2] += (r.source, r.record) in prior or bool(new.get(key))
            new.setdefault(key, set()).add(r.hash)
    assert {r.trace: [r.added, r.duplicates, r.conflicts] for r in out.collect()} == want
