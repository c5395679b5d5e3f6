import json

from lineage_case import (
    D1, EDGE_AB, EDGE_BC, GRAPHS, HASH_A, HASH_B, HASH_C, KEY, META_A, META_B, ONE, ORIGIN_HASHES, ORIGINS, ROWS, SA, SB, SOURCES, T, W, ZERO,
    accept, agent, hash_a, lineage, normalized, offer, origin, origins_of, row_a, row_b, row_c, steps_of,
)
from pyspark.sql import functions as F

from weftline.plans.reduction import Reduced, manifests, reduce_steps
from weftline.sources.vendor import clean, normalize
from weftline.storage import materialize


def reduce_and_keep(steps, origins=None):
    steps = materialize(steps, "steps")
    r = reduce_steps(steps, origins)
    return steps, Reduced(materialize(r.edges, "edges"), materialize(r.gaps, "gaps"))


def test_step_hashes_and_golden_graph(spark):
    assert tuple(o["hash"] for o in ORIGINS) == ORIGIN_HASHES
    steps, r = reduce_and_keep(steps_of(spark, [ROWS[2], ROWS[0], ROWS[1], ROWS[0]]), origins_of(spark, ORIGINS))
    assert {s.hash for s in steps.collect()} == {HASH_A, HASH_B, HASH_C}
    assert {e.hash for e in r.edges.collect()} == {EDGE_AB, EDGE_BC} and r.gaps.count() == 0
    pinned = origins_of(spark, ORIGINS).withColumn("trace", F.lit(T))
    other = spark.createDataFrame([("vlt_" + "z" * 21, W)], "trace string, workspace string")
    got = {m.trace: m.graph for m in manifests(steps, r, pinned, other).collect()}
    assert got[T] == GRAPHS[3] and len(got) == 2


def test_earlier_revisions(spark):
    for n in (1, 2):
        steps, r = reduce_and_keep(steps_of(spark, ROWS[:n]), origins_of(spark, ORIGINS[:n]))
        assert manifests(steps, r, origins_of(spark, ORIGINS[:n]).withColumn("trace", F.lit(T))).first().graph == GRAPHS[n]
    none = steps.limit(0)
    assert manifests(none, Reduced(r.edges.limit(0), r.gaps.limit(0)), traces=spark.createDataFrame([(T, W)], "trace string, workspace string")).first().graph == GRAPHS[0]


def trace_of(i: int) -> str:
    return f"vlt_{i:021d}"


def b_in(trace, **given):
    """Row B of a trace, accepting from row A of the same trace."""
    meta = META_B | {"trace_id": trace, "offers": []}
    return meta | {"accept": accept(D1, SA, "a", hash_a(trace, META_A | {"trace_id": trace}))} | given


CASES = [  # rows of a trace, expected gap codes, number of edges
    (lambda t: [row_a(META_A | {"trace_id": t})], ["ACCEPT_MISSING"], 0),
    (lambda t: [row_b(b_in(t))], ["OFFER_MISSING"], 0),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t))], [], 1),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t)), row_b(b_in(t), record="b2")], ["DELEGATION_REUSED"], 0),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t, accept=accept(D1, SA, "a", ONE)))], ["PARENT_HASH_MISMATCH"], 0),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t, accept=accept(D1, SA, "zzz", ONE)))], ["DELEGATION_MISMATCH"], 0),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t, agent=agent("eve")))], ["DELEGATION_MISMATCH"], 0),
    (lambda t: [row_a(META_A | {"trace_id": t}), row_b(b_in(t, agent=None))], ["DELEGATION_MISMATCH"], 0),
    (lambda t: [row_a(), row_a(lineage(trace_id=t, agent=agent("x")))], ["SOURCE_CONFLICT"], 0),
    (lambda t: [row_a(parent="b"), row_a(record="b", parent="a")], ["CYCLE"], 0),
    (lambda t: [row_a(parent="a")], ["CYCLE"], 0),
    (lambda t: [row_c(record="x", span="p"), row_c(record="y", span="p"), row_c(record="z", span="q", parents=["p"])], ["PARENT_AMBIGUOUS"], 0),
    (lambda t: [row_a(record="x", parent="gone")], ["PARENT_MISSING"], 0),
    (lambda t: [row_a(), row_a(record="child", parent="a"), row_b(record="a")], [], 1),
    (lambda t: [row_a(record="a"), row_b(record="a"), row_c(record="a", span="a")], [], 0),
    (lambda t: [row_a(), row_a(record="c", parent="a"), row_a(lineage(trace_id=t, agent=agent("x")), record="c", parent="a")], ["SOURCE_CONFLICT"], 0),
    (lambda t: [row_a(record="r"), row_a(record="x", parent="y"), row_a(record="y", parent="x"), row_a(record="leaf", parent="y"), row_a(record="t", parent="r")], ["CYCLE"], 2),
    (lambda t: [row_a(record=f"r{i}", parent=f"r{i - 1}" if i else None) for i in range(1000)], [], 999),
]


def test_many_traces_in_one_plan(spark):
    rows = [(s, f"{i:06d}:{j:06d}", r, trace_of(i)) for i, (make, _, _) in enumerate(CASES) for j, (s, r) in enumerate(make(trace_of(i)))]
    given = spark.createDataFrame(rows, "source string, place string, raw string, trace string")
    done = normalize(given, spark.createDataFrame(SOURCES, "id string, profile string"), KEY, W)
    assert done.where("error is not null").count() == 0
    steps, r = reduce_and_keep(clean(done))
    edges = {x.trace: x["count"] for x in r.edges.groupBy("trace").count().collect()}
    gaps: dict = {}
    for g in r.gaps.collect():
        gaps.setdefault(g.trace, []).append((g.code, g.subject, list(g.related)))
    for i, (_, codes_, n) in enumerate(CASES):
        assert sorted(c for c, *_ in gaps.get(trace_of(i), [])) == codes_, i
        assert edges.get(trace_of(i), 0) == n, i
    (cycle,) = gaps[trace_of(16)]
    assert cycle[1] == min(cycle[2]) and cycle[2] == sorted(cycle[2]) and len(cycle[2]) == 2


def test_native_edge_hash(spark):
    _, r = reduce_and_keep(steps_of(spark, [row_a(), row_a(record="child", parent="a")]))
    assert [e.hash for e in r.edges.collect()] == ["250ccfdfb5ca9021940b64bcb1edc2b57b9afd3214d580d22260c7a07397fdbb"]


def test_origin_gaps_and_forks(spark):
    one, two = origin(SA, HASH_A, "l"), origin(SA, HASH_B, "l")
    streams = [origin(SA, HASH_A, "l", seq=3, prev=ONE, stream="broken"), one, two]
    _, r = reduce_and_keep(steps_of(spark, ROWS[:1]), origins_of(spark, streams))
    got = {g.code: list(g.related) for g in r.gaps.collect()}
    assert got == {"ACCEPT_MISSING": [], "ORIGIN_GAP": [], "ORIGIN_FORK": sorted((one["hash"], two["hash"]))} and one["prev"] == ZERO


def test_normalization_errors_and_warnings(spark):
    rows = [
        (SA, "{"), (SA, '{"id":"a","id":"b"}'), (SA, "[]"), (SA, json.dumps({"id": "a"})), (SA, json.dumps({"id": "", "trace_id": "t"})), (SA, json.dumps({"id": "a\n", "trace_id": "t"})),
        row_a(parent=""), row_c(parents=["p", "p"]), row_c(parents=[str(i) for i in range(17)]), row_a(META_A | {"trace_id": "vlt_" + "x" * 21}), row_a(META_A | {"extra": 1}), row_a(META_A | {"v": 2}),
        row_a(lineage(offers=[offer(D1, SB, "b"), offer(D1, SB, "c")])), row_a(), ROWS[0], ("vls_" + "q" * 21, "{}"), (SA, json.dumps({"id": "a", "trace_id": "t", "pad": "x" * (1 << 20)})),
        (SA, json.dumps({"id": "a", "trace_id": "t", "extra": {"metadata": {KEY: None}}})),
    ]
    got = [r.error.code if r.error else None for r in normalized(spark, rows).orderBy("place").collect()]
    assert got == ["JSON_INVALID", "JSON_INVALID", "PROFILE_MISMATCH", "PROFILE_MISMATCH", "PROFILE_MISMATCH", "SCHEMA_INVALID", "PROFILE_MISMATCH", "SCHEMA_INVALID", "SCHEMA_INVALID", "TRACE_MISMATCH", "SCHEMA_INVALID", "UNSUPPORTED_VERSION", "SCHEMA_INVALID", None, None, "NOT_FOUND", "ROW_LIMIT", "SCHEMA_INVALID"]
    warned = {r.record: list(r.warnings) for r in normalized(spark, [row_a(), row_b(META_B)]).collect()}
    assert warned == {"a": ["METADATA_ABSENT"], "b": []}


def test_ignored_fields_do_not_survive(spark):
    plain = {"id": "a", "trace_id": "native-ls", "parent_run_id": None}
    extra = plain | {"inputs": {"secret": "s3cr3t"}, "start_time": "2020", "extra": {"metadata": {"other": 1}}}
    a, b = steps_of(spark, [(SA, json.dumps(plain))]).first(), steps_of(spark, [(SA, json.dumps(extra))]).first()
    assert a == b and a.hash == "e914beb56c6b8ff0cd07b12e64e6b7f33813c36b21254f6fdd510f31661dd911"


def test_shuffle_files_go_when_a_table_is_written(spark):
    import subprocess

    from weftline.storage import materialize

    files = lambda: int(subprocess.run(f"find {spark.conf.get('spark.local.dir')} -name 'shuffle_*_0.data' | wc -l", shell=True, capture_output=True, text=True).stdout)
    before = files()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert files() <= before and table.count() == 7


def test_sides_that_agree_are_judged_by_one_aggregate(spark):
    from lineage_case import D2

    from weftline.operators import resolve

    steps = steps_of(spark, ROWS)
    judged = resolve.delegation_outcomes(steps.unionByName(steps))
    assert {(r.delegation, r.outcome, r.parent, r.child) for r in judged.collect()} == {(D1, "DELEGATES", HASH_A, HASH_B), (D2, "DELEGATES", HASH_B, HASH_C)}
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
