"""Closed metadata objects, and rows of files."""

import json

import lineage_case as case
import pytest
from pyspark.sql import functions as F

from weftline.sources import vendor
from weftline.sources.vendor import normalize, read_rows

SOURCE, TRACE = "vls_" + "a" * 21, "vlt_" + "t" * 21
AGENT = {"namespace": "lab", "principal": None, "subject": "alice"}
META = {
    "accept": {"id": "vld_" + "d" * 21, "parent": {"hash": "1" * 64, "record": "p", "source": SOURCE}, "scope": "1" * 64}, "agent": AGENT, "attachments": [{"bytes": "3", "digest": "1" * 64, "format": "text"}],
    "offers": [{"child_agent": AGENT, "child_source": SOURCE, "id": "vld_" + "e" * 21, "scope": "1" * 64}], "policy": {"decision": "ALLOW", "digest": "1" * 64, "version": "1"}, "trace_id": TRACE, "v": 1,
}


def changed(path, value=None, drop=False):
    out = json.loads(json.dumps(META))
    at = out
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


CASES = [
    (META, None),
    (changed(["agent", "extra"], 1), "/row/metadata/agent"), (changed(["agent", "principal"], drop=True), "/row/metadata/agent"), (changed(["agent", "subject"], 7), "/row/metadata/agent"), (changed(["agent", "namespace"], "Lab"), "/row/metadata/agent/namespace"),
    (changed(["offers", 0, "extra"], None), "/row/metadata/offers"), (changed(["offers", 0, "child_agent", "principal"], drop=True), "/row/metadata/offers"), (changed(["offers"], {}), "/row/metadata/offers"), (changed(["offers"], META["offers"] * 2), "/row/metadata/offers"),
    (changed(["accept", "parent", "extra"], "x"), "/row/metadata/accept"), (changed(["accept", "scope"], None), "/row/metadata/accept"), (changed(["policy"], "ALLOW"), "/row/metadata/policy"), (changed(["policy", "decision"], "MAYBE"), "/row/metadata/policy/decision"),
    (changed(["attachments", 0, "bytes"], 3), "/row/metadata/attachments"), (changed(["attachments", 0, "bytes"], "03"), "/row/metadata/attachments"), (changed(["more"], 1), "/row/metadata"), (changed(["v"], drop=True), "/row/metadata"), (changed(["v"], 2), "/row/metadata/v"),
    (changed(["trace_id"], "vlt_" + "x" * 21), "/row/metadata/trace_id"), (None, "/row/metadata"), ("text", "/row/metadata"), (changed(["agent"], None), None), (changed(["accept"], None), None),
]


def test_closed_objects_at_every_level(spark):
    rows = [(SOURCE, f"{i:03d}", json.dumps({"id": f"r{i}", "traceId": "n", "metadata": {"lineage": m}}), TRACE) for i, (m, _) in enumerate(CASES)]
    got = {r.place: r for r in normalize(spark.createDataFrame(rows, "source string, place string, raw string, trace string"), spark.createDataFrame([(SOURCE, "langfuse-observations/1")], "id string, profile string"), "lineage", "vlw_" + "w" * 21).collect()}
    for i, (meta, field) in enumerate(CASES):
        r = got[f"{i:03d}"]
        assert (r.error.field if r.error else None) == field, (i, meta, r.error)
        assert (r.hash is None) == (field is not None)
    codes = {i: got[f"{i:03d}"].error.code for i, (_, f) in enumerate(CASES) if f}
    assert codes[17] == "UNSUPPORTED_VERSION" and codes[18] == "TRACE_MISMATCH" and set(codes.values()) == {"SCHEMA_INVALID", "UNSUPPORTED_VERSION", "TRACE_MISMATCH"}


@pytest.mark.parametrize("array", [False, True])
def test_row_files(spark, tmp_path, array):
    if array:
        (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
        (tmp_path / "b.json").write_text('[{"id": 3}, {]')
        (tmp_path / "c.json").write_text("[]")
    else:
        (tmp_path / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
        (tmp_path / "b.json").write_text('{"id": 3\n\n{"id": 4}')
    rows = read_rows(spark, str(tmp_path), SOURCE, array).orderBy("place").collect()
    assert [r.raw.replace(" ", "") for r in rows] == (['{"id":1}', '{"id":2}', ""] if array else ['{"id":1}', '{"id":2}', '{"id":3', "", '{"id":4}'])
    assert len({r.place for r in rows}) == len(rows)


def test_rows_beyond_variant_are_refused(spark):
    good = '{"id": "r", "traceId": "n", "metadata": {}, "in": %s}'
    raws = [good % "1", good % "1" + " x", good % '"\\ud800"', good % "1e999", good % ("[" * 32 + "]" * 32), good % ("[" * 31 + "]" * 31)]
    df = spark.createDataFrame([(SOURCE, str(i), raw, TRACE) for i, raw in enumerate(raws)], "source string, place string, raw string, trace string")
    got = normalize(df, spark.createDataFrame([(SOURCE, "langfuse-observations/1")], "id string, profile string"), "lineage", "vlw_" + "w" * 21)
    assert [r.error.code if r.error else None for r in got.orderBy("place").collect()] == [None, *["JSON_INVALID"] * 4, None]


def test_lines_keep_their_places_however_files_are_split(spark, tmp_path):
    """A file of many splits, blank and long lines, line ends of both kinds, multi-byte characters at split borders."""
    lines = [("é" * (i % 40)) + str(i) + ("\r" if i % 7 == 0 else "") for i in range(3000)]
    lines[5], lines[6], lines[100] = "", "\r", "x" * 20_000
    (tmp_path / "big.jsonl").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "one.jsonl").write_bytes(b'{"id":1}')
    want = {("big.jsonl", i, x.removesuffix("\r")) for i, x in enumerate(lines)} | {("one.jsonl", 0, '{"id":1}')}
    for size in ("64m", "3000", "777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = vendor.read_rows(spark, str(tmp_path), "s")
        parts = rows.rdd.getNumPartitions()
        got = {(r.place.rsplit("/", 1)[1].rsplit(":", 1)[0], int(r.place.rsplit(":", 1)[1]), r.raw) for r in rows.collect()}
        assert got == want and (size == "64m" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10), (size, parts)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_bytes_are_refused(spark, tmp_path):
    """Two rows that differ in a broken byte and its replacement must not meet."""
    good = '{"id":"r�","trace_id":"n","parent_run_id":null}'.encode()
    (tmp_path / "rows.jsonl").write_bytes(good + b"\n" + good.replace("�".encode(), b"\xff") + b"\n")
    rows = vendor.read_rows(spark, str(tmp_path), case.SA).withColumn("trace", F.lit(case.T))
    got = vendor.normalize(rows, spark.createDataFrame(case.SOURCES, "id string, profile string"), case.KEY, case.W).orderBy("place").collect()
    assert [r.error and (r.error.code, r.error.field) for r in got] == [None, ("JSON_INVALID", "/row")]
    (tmp_path / "rows.jsonl").write_bytes(b" \n [" + good + b"]")
    assert vendor.is_array(spark, str(tmp_path)).first().array and vendor.read_rows(spark, str(tmp_path), "s", array=True).count() == 1
    (tmp_path / "rows.jsonl").write_bytes(b'["\xff"]')
    assert [r.raw for r in vendor.read_rows(spark, str(tmp_path), "s", array=True).collect()] == [""]


def test_text_after_the_row_is_refused_whatever_it_is(spark):
    """A row and its digest are parsed as one array, so text that closes or continues that array is no row either."""
    import hashlib

    good = case.row_a(case.META_A)[1]
    more = ["]", "] x", ",1", ',"' + hashlib.sha256(good.encode()).hexdigest() + '"]', "}", " {}", '"]', ","]
    rows = [(case.SA, good + m) for m in more] + [(case.SA, f" {good}\r"), (case.SA, "]"), (case.SA, "1e999"), (case.SA, "[" + good + "]")]
    got = {int(r.place): None if r.error is None else r.error.code for r in case.normalized(spark, rows).select("place", "error").collect()}
    n = len(more)
    assert got == {i: "JSON_INVALID" for i in range(n)} | {n: None, n + 1: "JSON_INVALID", n + 2: "JSON_INVALID", n + 3: "PROFILE_MISMATCH"}
