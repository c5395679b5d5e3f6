"""Bundles read back and verified: a good one, one spoiled in each way, and objects that aren't what the format says."""

import json

import bundle_case as made
import lineage_case as case
import pytest
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.functions.types import HEAD_PINS, KEY_PINS
from weftline.plans import bundles

TRUSTED, DOC = "TRUSTED_AT_PIN", "bundle string, document string"


def verified(spark, documents):
    table = spark.createDataFrame(list(documents.items()), DOC)
    got = bundles.verify(table, case.W, spark.createDataFrame(made.KEYS, KEY_PINS), spark.createDataFrame([], HEAD_PINS), made.FORMAT).collect()
    assert len(got) == len(documents)
    return {r.bundle: r for r in got}


def change_step(b):
    b["steps"][0]["body"]["record"] = "other"


def foreign_step(b):
    s = b["steps"][0]
    s["body"]["trace"] = "vlt_" + "z" * 21
    s["hash"] = case.tagged("VL-STEP/1", s["body"])


def needless_origin(b):
    o = case.origin(case.SA, case.ONE, "l", seq=2, prev=case.ONE)
    b["origins"].append({"body": {k: v for k, v in o.items() if k not in ("hash", "signature")}, "hash": o["hash"], "signature": b["origins"][0]["signature"]})


def forge(name, at):
    def change(b):
        forged = b[name][at]["hash"]
        for o in (*b[name], *(b["body"]["path"][name] if name == "origins" else ())):
            if o["hash"] == forged:
                o["signature"] = made.b64(bytes(64))

    return change


def fork_origin(b):
    o = case.origin(case.SC, case.HASH_B, "n")
    b["origins"].append({"body": {k: v for k, v in o.items() if k not in ("hash", "signature")}, "hash": o["hash"], "signature": made.sign("n", "VL-ORIGIN-SIGN/1", o["hash"])})
    fork = sorted({x["hash"] for x in b["origins"] if x["body"]["source"] == case.SC})
    gaps = sorted(({"code": "ORIGIN_FORK", "related": fork, "subject": h} for h in (case.HASH_B, case.HASH_C)), key=lambda g: g["subject"])
    b["body"]["graph"] |= {"origins": sorted(x["hash"] for x in b["origins"]), "gaps": gaps}
    digest = case.tagged("VL-GRAPH/1", b["body"]["graph"])
    b["body"]["path"] |= {"origins": sorted(b["origins"], key=case.canonical), "gaps": gaps, "structural": "CONFLICTED", "graph": digest}
    b["audit"] = made.audit_log(b["audit"][0]["body"]["data"], b["audit"][1]["body"]["data"] | {"graph": digest})


INVENTORY, GOOD = ("INVALID", "INCOMPLETE", "UNTRUSTED", "UNTRUSTED", ["INVENTORY_MISMATCH"], 3), ("VALID", "COMPLETE_RELATIVE", TRUSTED, TRUSTED, [], 0)
ASTRAY = lambda reason, structural="COMPLETE_RELATIVE": ("INVALID", structural, "UNTRUSTED", "UNTRUSTED", [reason], 3)
CASES = {
    "good": (lambda b: None, True, GOOD), "body": (change_step, True, INVENTORY), "hash": (lambda b: b.update(hash=case.ONE), False, INVENTORY), "scope": (foreign_step, True, INVENTORY), "needless": (needless_origin, True, INVENTORY),
    "listed": (lambda b: b["body"]["inventory"].pop(), False, INVENTORY), "twice": (lambda b: b["steps"].append(b["steps"][0]), True, INVENTORY), "content": (lambda b: b["attachments"][0].update(content=made.b64(b"hallo")), True, INVENTORY),
    "format": (lambda b: b["attachments"][0].update(format="other"), True, INVENTORY), "missing": (lambda b: b["attachments"].clear(), True, INVENTORY), "omitted": (lambda b: b["body"].update(attachment_policy="OMIT"), True, INVENTORY),
    "graph": (lambda b: b["body"]["graph"].update(edges=[]), True, ASTRAY("GRAPH_MISMATCH", "INCOMPLETE")), "path": (lambda b: b["body"]["path"].update(steps=[]), True, ASTRAY("PATH_MISMATCH")),
    "limit": (lambda b: b["body"]["path_request"].update(max_nodes=2), True, ASTRAY("PATH_MISMATCH", "INCOMPLETE")), "revision": (lambda b: b["body"].update(revision="2"), True, ASTRAY("PATH_MISMATCH")),
    "binding": (lambda b: b["audit"].pop(), True, ASTRAY("AUDIT_BINDING_MISMATCH")), "forged audit": (forge("audit", 0), True, ASTRAY("SIGNATURE_INVALID")), "forged origin": (forge("origins", 0), True, ("INVALID", "COMPLETE_RELATIVE", "UNTRUSTED", TRUSTED, ["SIGNATURE_INVALID"], 3)),
    "fork": (fork_origin, True, ("VALID", "CONFLICTED", "CONFLICTED", TRUSTED, ["ORIGIN_FORK"], 5)), "gap": (lambda b: b["audit"].pop(0), True, ("VALID", "COMPLETE_RELATIVE", TRUSTED, "INCOMPLETE", ["AUDIT_GAP"], 4)),
}


def test_each_phase_of_spoiled_bundles(spark):
    """And text that differs only in form is the same bundle."""
    documents = {name: made.spoiled(change, reseal) for name, (change, reseal, _) in CASES.items()}
    turned = lambda x: {k: turned(x[k]) for k in sorted(x, reverse=True)} if isinstance(x, dict) else [turned(y) for y in x] if isinstance(x, list) else x
    more = {"turned": json.dumps(turned(json.loads(documents["good"])), indent=2), "omit": made.spoiled(lambda b: None, policy="OMIT")}
    got = verified(spark, documents | more)
    assert {k: (r.integrity, r.structural, r.origin, r.audit, r.reasons, r.exit_code) for k, r in got.items()} == {k: want for k, (_, _, want) in CASES.items()} | dict.fromkeys(more, GOOD)
    assert all(r.error is None for r in got.values())


def test_documents_that_are_no_bundles(spark):
    good = made.spoiled(lambda b: None)
    spoil = lambda change: made.spoiled(change, False)
    documents = {
        "null": None, "text": good[:-1], "more": good + "{}", "unsafe": good.replace('"max_depth":8', '"max_depth":9007199254740992'), "depth": good.replace('"max_depth":8', '"max_depth":257'),
        "unknown": spoil(lambda b: b.update(extra=1)), "missing": spoil(lambda b: b["body"].pop("path")), "element": spoil(lambda b: b["steps"][1]["body"]["agent"].update(namespace="Lab")), "id": spoil(lambda b: b["body"].update(trace="vlt_x")),
        "version": spoil(lambda b: b["audit"][1]["body"].update(v=2)), "prev": spoil(lambda b: b["origins"][2]["body"].update(seq="2")), "kind": spoil(lambda b: b["audit"][0]["body"]["data"].update(kind="Other")),
        "other": spoil(lambda b: b["body"].update(workspace="vlw_" + "x" * 21)), "first": spoil(lambda b: (b["steps"][0]["body"].update(v=3), b["body"]["path"]["gaps"].append({"code": "CYCLE", "related": [1], "subject": case.ONE}))),
    }
    found = verified(spark, documents)
    got = {k: (r.error, r.field) for k, r in found.items()}
    assert all(r.integrity is None for r in found.values())
    assert got == {
        "null": ("JSON_INVALID", ""), "text": ("JSON_INVALID", ""), "more": ("JSON_INVALID", ""), "unsafe": ("SCHEMA_INVALID", ""), "depth": ("SCHEMA_INVALID", "/bundle/body/path_request/max_depth"), "unknown": ("SCHEMA_INVALID", "/bundle/extra"),
        "missing": ("SCHEMA_INVALID", "/bundle/body/path"), "element": ("SCHEMA_INVALID", "/bundle/steps/1/body/agent/namespace"), "id": ("ID_INVALID", "/bundle/body/trace"), "version": ("UNSUPPORTED_VERSION", "/bundle/audit/1/body/v"),
        "prev": ("SCHEMA_INVALID", "/bundle/origins/2/body/prev"), "kind": ("SCHEMA_INVALID", "/bundle/audit/0/body/data/kind"), "first": ("SCHEMA_INVALID", "/bundle/body/path/gaps/0/related/0"),
        "other": ("TRUST_INVALID", "/trust/workspace"),
    }


def test_files_in_and_out(spark, tmp_path):
    good = made.spoiled(lambda b: None)
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + good.encode())
    (tmp_path / "c.json").write_bytes(good.encode().replace(b"native-ls", b"native-\xff"))
    (tmp_path / "d.json").write_text(good + " " * 10_000)
    got = {r.bundle[-6]: r for r in bundles.read_documents(spark, str(tmp_path), limit=len(good) + 100).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": "JSON_INVALID", "c": "JSON_INVALID", "d": "FILE_LIMIT"}
    assert got["a"].document == good and got["c"].document is None
    out = str(tmp_path / "out")
    assembled = spark.createDataFrame([("h1", good), ("h2", None)], "hash string, document string")
    bundles.write_documents(assembled, out)
    assert [(r.bundle, r.value) for r in spark.read.text(out, wholetext=True).collect()] == [("h1", good + "\n")]
    with pytest.raises(Exception, match="exist"):
        bundles.write_documents(assembled, out)


OBJECTS = {
    "source": {"id": case.SA, "profile": "langsmith-runs/1", "namespace": "lab", "project": "p"}, "trace_result": {"id": case.T, "revision": "1", "graph": case.ONE}, "external_head": {"v": 1, "workspace": case.W, "seq": "1", "hash": case.ONE},
    "backup_manifest": {"v": 1, "workspace": case.W, "schema": 1, "head": {"seq": "1", "hash": case.ONE}, "files": [{"path": "a", "bytes": "1", "digest": case.ONE}]},
    "trust_update": {"v": 1, "workspace": case.W, "retire": {"id": "vlk_" + "k" * 21, "last_seq": "3"}, "activate": {"id": "vlk_" + "l" * 21, "public": case.PUBLIC["l"], "first_seq": "4"}},
    "verification": {"integrity": "VALID", "structural": "INCOMPLETE", "origin": "UNSIGNED", "audit": "INCOMPLETE", "disclosure": "NORMALIZED_ONLY", "semantics": "NOT_VERIFIED", "current_authority": "UNKNOWN", "reasons": ["A"]},
    "stage_result": {"import": "vli_" + "i" * 21, "state": "STAGED", "batch": case.ONE, "rows": 0, "warnings": []},
    "import_state": {"import": "vli_" + "i" * 21, "state": "CANCELLED", "batch": case.ONE, "commit": None, "reason": "EXPIRED"},
    "trust_package": {"v": 1, "workspace": case.W, "keys": [dict(zip(("id", "public", "role", "workspace", "source", "stream", "first_seq", "last_seq", "status"), k)) for k in made.KEYS], "heads": []},
    "source_list": {"sources": []},
}


def test_every_member_of_every_object(spark):
    """Each object passes; without a member, with another, or with a member of another type it has an error there."""
    rows, want = [], {}
    for name, good in OBJECTS.items():
        rows.append((name, name, case.canonical(good)))
        want[name] = None
        for change in ("drop", "wrong", "extra"):
            for member in good if change != "extra" else ["zz~/"]:
                key = f"{name} {change} {member}"
                value = dict(good) | {member: True}
                rows.append((key, name, case.canonical({k: v for k, v in good.items() if k != member} if change == "drop" else value)))
                want[key] = "/x/" + member.replace("~", "~0").replace("/", "~1")
        rows.append((f"{name} array", name, "[]"))
        want[f"{name} array"] = "/x"
    df = spark.createDataFrame(rows, "key string, name string, raw string").select("key", "name", F.parse_json("raw").alias("v"))
    got = {}
    for name in OBJECTS:
        for r in df.where(F.col("name") == name).select("key", rules.DOCUMENTS[name].error("v", "/x").alias("e")).collect():
            got[r.key] = r.e and r.e.field
    assert got == want
