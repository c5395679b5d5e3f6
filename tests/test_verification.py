"""Bundles against plain JSON, and verdicts from their phases."""

import hashlib
import json

import lineage_case as case
from weftline.plans import verification

Z = "0" * 64
HEAD = "bundle string, workspace string, trace string, revision string, attachment_policy string, graph string, path_request string, path string, action string"
PARTS = "bundle string, kind string, hash string, n long, json string"
CHAIN = "bundle string, integrity string, verdict string, reasons array<string>"
GOOD = ("VALID", "TRUSTED_AT_PIN", [])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def assembled(spark, policy="INCLUDE", limit=1 << 20, turned=False):
    parts = [("b", kind, sha(f"{kind}{n}"), n, case.canonical({"body": {"n": str(n)}, "hash": sha(f"{kind}{n}")})) for kind in ("step", "origin", "audit") for n in (9, 10, 2)]
    refs = [("b", sha("x"), "1"), ("b", sha("y"), "1"), ("b", sha("x"), "1")]
    files = [("b", sha(c), case.canonical({"digest": sha(c), "format": "é"})) for c in "yx"]
    way = -1 if turned else 1
    head = ("w", "t", "3", policy, '{"steps":[]}', '{"v":1}', "{}", '{"record":"a"}')
    df = verification.assemble(
        spark.createDataFrame([("b", *head), ("empty", *head)], HEAD), spark.createDataFrame(parts[::way], PARTS), spark.createDataFrame(refs[::way], "bundle string, digest string, bytes string"),
        spark.createDataFrame(files[::way], "bundle string, digest string, json string"), "f/1", limit,
    )
    return {r.bundle: r for r in df.collect()}, parts, files


def test_document_is_canonical_whatever_the_order(spark):
    rows, parts, files = assembled(spark)
    got = rows["b"]
    read = json.loads(got.document)
    assert case.canonical(read) == got.document and got.bytes == len(got.document.encode())
    items = [{"kind": k, "digest": sha(j), "bytes": str(len(j.encode()))} for _, k, _, _, j in parts] + [{"kind": "attachment", "digest": sha(c), "bytes": "1"} for c in "xy"]
    assert read["body"]["inventory"] == sorted(items, key=lambda i: (i["kind"], i["digest"]))
    assert read["hash"] == got.hash == case.tagged("VL-BUNDLE/1", read["body"])
    of = lambda kind, key: [json.loads(p[4]) for p in sorted((p for p in parts if p[1] == kind), key=key)]
    assert read["steps"] == of("step", lambda p: p[2]) and read["origins"] == of("origin", lambda p: p[4]) and read["audit"] == of("audit", lambda p: p[3])
    assert read["attachments"] == [json.loads(j) for _, _, j in sorted(files, key=lambda f: f[1])]
    assert json.loads(got.handoff)["graph"] == case.tagged("VL-GRAPH/1", {"steps": []}) and json.loads(got.handoff)["action"] == {"record": "a"}
    assert assembled(spark, turned=True)[0]["b"].document == got.document
    bare = json.loads(rows["empty"].document)
    assert bare["steps"] == bare["attachments"] == bare["body"]["inventory"] == []


def test_omitted_attachments_and_limit(spark):
    got = json.loads(assembled(spark, "OMIT")[0]["b"].document)
    assert got["attachments"] == [] and sum(i["kind"] == "attachment" for i in got["body"]["inventory"]) == 2
    over = assembled(spark, limit=1000)[0]
    whole = assembled(spark)[0]["b"]
    size = len(whole.document.encode())
    assert (over["b"].error, over["b"].document, over["b"].handoff, over["b"].bytes, over["b"].hash) == ("BUNDLE_LIMIT", None, None, size, whole.hash) and over["empty"].error is None
    for limit, error in ((size, None), (size - 1, "BUNDLE_LIMIT")):
        assert assembled(spark, limit=limit)[0]["b"].error == error


def test_attachments_that_are_not_there(spark):
    """An error where they are to be included; of repeated references the first in place counts."""
    head = ("w", "t", "3", "INCLUDE", "{}", "{}", "{}", '""')
    heads = spark.createDataFrame([("b", *head), ("c", *head[:3], "OMIT", *head[4:])], HEAD)
    refs = spark.createDataFrame([(b, sha("x"), n, p) for b in "bc" for n, p in (("2", 1), ("9", 0), ("1", 2))], "bundle string, digest string, bytes string, place int")
    none = spark.createDataFrame([], "bundle string, digest string, json string")
    got = {r.bundle: r for r in verification.assemble(heads, spark.createDataFrame([], PARTS), refs, none, "f/1").collect()}
    assert (got["b"].error, got["b"].document, got["b"].handoff) == ("ARTIFACT_UNAVAILABLE", None, None)
    assert [i["bytes"] for i in json.loads(got["c"].document)["body"]["inventory"]] == ["9"]


def test_first_failing_phase_decides(spark):
    names = ["good", "scope", "inventory", "path", "binding", "forged", "origin", "conflict", "lone", "no_path"]
    bundles = spark.createDataFrame([(n, None if n == "no_path" else "COMPLETE_RELATIVE") for n in names], "bundle string, structural string")
    fault = lambda *who: spark.createDataFrame([(w,) for w in who], "bundle string")
    faults = {"inventory": fault("inventory", "inventory"), "scope": fault("scope"), "graph": fault("scope", "inventory"), "path": fault("path", "no_path"), "binding": fault("binding", "path")}
    chain = lambda **other: spark.createDataFrame([(n, *other.get(n, GOOD)) for n in names if n != "lone"], CHAIN)
    chains = {
        "audit": chain(forged=("INVALID", "UNTRUSTED", ["SIGNATURE_INVALID"]), conflict=("VALID", "CONFLICTED", ["PIN_MISMATCH"])),
        "origin": chain(origin=("INVALID", "UNTRUSTED", ["SIGNATURE_INVALID"]), conflict=("VALID", "CONFLICTED", ["ORIGIN_FORK", "PIN_MISMATCH"]), scope=("INVALID", "UNTRUSTED", ["X"])),
    }
    df = verification.verdicts(verification.summarize(bundles, faults, chains))
    got = {r.bundle: (r.integrity, r.structural, r.origin, r.audit, r.reasons, r.exit_code) for r in df.collect()}
    whole, trusted, none = "COMPLETE_RELATIVE", "TRUSTED_AT_PIN", "UNTRUSTED"
    assert got == {
        "good": ("VALID", whole, trusted, trusted, [], 0), "scope": ("INVALID", "INCOMPLETE", none, none, ["INVENTORY_MISMATCH"], 3), "inventory": ("INVALID", "INCOMPLETE", none, none, ["INVENTORY_MISMATCH"], 3),
        "path": ("INVALID", whole, none, none, ["PATH_MISMATCH"], 3), "no_path": ("INVALID", "INCOMPLETE", none, none, ["PATH_MISMATCH"], 3), "binding": ("INVALID", whole, none, none, ["AUDIT_BINDING_MISMATCH"], 3),
        "forged": ("INVALID", whole, none, none, ["SIGNATURE_INVALID"], 3), "origin": ("INVALID", whole, none, trusted, ["SIGNATURE_INVALID"], 3), "conflict": ("VALID", whole, "CONFLICTED", none, ["ORIGIN_FORK", "PIN_MISMATCH"], 5),
        "lone": ("VALID", whole, "UNSIGNED", "INCOMPLETE", ["AUDIT_GAP", "ORIGIN_UNSIGNED"], 4),
    }


def test_lines_are_padded_and_never_cut(spark):
    nodes = spark.createDataFrame(
        [("q", 0, "a" * 64, case.SA, "a", None, None), ("q", 1, "b" * 64, case.SB, "a record of more than its column", ("lab", None, "someone"), ("ALLOW", case.ONE, "1"))],
        "request string, position int, hash string, source string, record string, agent struct<namespace:string,principal:string,subject:string>, policy struct<decision:string,digest:string,version:string>",
    )
    edges = spark.createDataFrame([("q", "b" * 64, "NATIVE_PARENT", "2"), ("q", "b" * 64, "DELEGATES", "1")], "request string, child string, kind string, hash string")
    lines = [r.line for r in verification.path_lines(nodes, edges, spark.createDataFrame([("q", "a" * 64)] * 2, "request string, step string")).orderBy("position").collect()]
    assert lines == [
        "aaaaaaaaaaaa  aaaaaaaa:a             -             UNKNOWN   -                SIGNED",
        "bbbbbbbbbbbb  bbbbbbbb:a record of more than its column lab/someone   ALLOW     DELEGATES+NATIVE_PARENT CLAIMED",
    ]
    assert all(verification.HEADING.index(word) == lines[0].index(cell) for word, cell in (("RECORD", "aaaaaaaa:a"), ("POLICY", "UNKNOWN"), ("EVIDENCE", "SIGNED")))
