"""A small workspace: three sources, a delegation chain of three steps, one attestation each."""

from __future__ import annotations

import hashlib
import json

KEY = "lineage"  # where vendor metadata holds the lineage object in these tests
W, T = "vlw_" + "w" * 21, "vlt_" + "t" * 21
SA, SB, SC = ("vls_" + c * 21 for c in "abc")
D1, D2 = "vld_" + "d" * 21, "vld_" + "e" * 21
ONE, ZERO = "1" * 64, "0" * 64
PROFILE = {SA: "langsmith-runs/1", SB: "langfuse-observations/1", SC: "braintrust-spans/1"}
SOURCES = [(s, p) for s, p in PROFILE.items()]

HASH_A = "dc2b51faa2b69d0d8ab7848ec1b612839d6bb24415b121de2702c06f18ef4354"
HASH_B = "011de1ef761f7ea7af92fabb06ac0520df53572c235743fbe3cb537f571ee4ec"
HASH_C = "b6a5b18a48f02f79b384b816f8f0d5a0d35955bcb5171d87d5d256b2f799989d"
EDGE_AB = "ebfd733000e75231951c0cff713e69f5f109caf60ee9c1e8e5fe254c63516ae5"
EDGE_BC = "54d475d707825ef815312d5e1705f2fa909a92fd72757fa62940ebcf342d45d1"
GRAPHS = {
    0: "55c6b07ad72ca8913c2667a2a2b019cf668bd6f1f3f0bf96b49a0b77622d5bb6", 1: "7cf8d0976563186aa1edee4eb72e2b00d4b76332a5828265f9c9ff4ae04b24f5",
    2: "b87cc1efd7f6c0a43964e5c0388fc4a071f7dbcf4a5ce1aa040c1a5bc6eea665", 3: "254266ac6c98e6250badf6de27c4afdf2e2a32284e4bdb79210aa8b18f5c720a",
}
ORIGIN_HASHES = ("5acf023a71fb64e6eeb39c3114e07955f909486a82c92b438d6cf51b8c1cfb1b", "ea4ca766d5ba35e88d6910724c26469d53f74aa514b3d313063d86707e984786", "48cce25040fe8ae56e4f4f9d964e71ec2a37d72dc1e71319399044035ef1bf8d")
SIGNATURE_A = "ptmgqRvJxwjGG_1Dr31WGjK7PYPLCwiwJ0ARMgz0c6VCYxKdx2yXSE-I4w1RhzM_hV8CpLytHUp6HQH6j0iQDA"
PUBLIC = {
    "k": "11l5O7wTooGagnx2rbb7qKSa7gB_SfLQmS2ZuCWtLEg", "l": "0EqyMnQrtKs6E2i9RhXk5tAiSrcaAWuvhSCjMsl3hzc",
    "m": "oJql9HpnWYAv-VX43C0qFKXJnSO-l_hkEn_5ODRVpPA", "n": "F8t5-ytBIPKx7GXkGY1uCLKOgT_rAeSkAIObheGAgM4",
}
POLICY = {"decision": "ALLOW", "digest": ONE, "version": "policy-1"}


def canonical(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tagged(tag: str, x) -> str:
    return hashlib.sha256(tag.encode() + b"\0" + canonical(x).encode()).hexdigest()


def agent(subject: str) -> dict:
    return {"namespace": "lab", "principal": None, "subject": subject}


def lineage(**given) -> dict:
    return {"accept": None, "agent": None, "attachments": [], "offers": [], "policy": None, "trace_id": T, "v": 1} | given


def offer(id_: str, source: str, child: str) -> dict:
    return {"child_agent": agent(child), "child_source": source, "id": id_, "scope": ONE}


def accept(id_: str, source: str, record: str, hash_: str) -> dict:
    return {"id": id_, "parent": {"hash": hash_, "record": record, "source": source}, "scope": ONE}


def row_a(meta: dict | None = None, record: str = "a", parent=None) -> tuple[str, str]:
    return SA, json.dumps({"id": record, "trace_id": "native-ls", "parent_run_id": parent} | ({"extra": {"metadata": {KEY: meta}}} if meta else {}))


def row_b(meta: dict | None = None, record: str = "b", parent=None) -> tuple[str, str]:
    return SB, json.dumps({"id": record, "traceId": "native-lf", "parentObservationId": parent} | ({"metadata": {KEY: meta}} if meta else {}))


def row_c(meta: dict | None = None, record: str = "c", span: str = "c", parents=()) -> tuple[str, str]:
    return SC, json.dumps({"id": record, "span_id": span, "root_span_id": "native-bt", "span_parents": list(parents)} | ({"metadata": {KEY: meta}} if meta else {}))


def hash_a(trace: str, meta: dict) -> str:
    """Hash of the step of ``row_a(meta)`` in a trace, made without the library."""
    kept = {k: meta[k] for k in ("accept", "agent", "attachments", "offers", "policy")}
    return tagged("VL-STEP/1", kept | {"native_span": "a", "native_trace": "native-ls", "parents": [], "profile": PROFILE[SA], "record": "a", "source": SA, "trace": trace, "v": 1, "workspace": W})


META_A = lineage(agent=agent("alice"), policy=POLICY, offers=[offer(D1, SB, "bob")])
META_B = lineage(agent=agent("bob"), policy=POLICY, offers=[offer(D2, SC, "cara")], accept=accept(D1, SA, "a", HASH_A))
META_C = lineage(agent=agent("cara"), policy=POLICY, accept=accept(D2, SB, "b", HASH_B))
ROWS = [row_a(META_A), row_b(META_B), row_c(META_C)]


def origin(source: str, step: str, key: str, seq: int = 1, prev: str = ZERO, signature: str = "", stream: str = "main") -> dict:
    body = {"key": "vlk_" + key * 21, "prev": prev, "seq": str(seq), "source": source, "step": step, "stream": stream, "v": 1, "workspace": W}
    return body | {"hash": tagged("VL-ORIGIN/1", body), "signature": signature}


ORIGINS = [origin(SA, HASH_A, "l", signature=SIGNATURE_A), origin(SB, HASH_B, "m"), origin(SC, HASH_C, "n")]


def raw(spark, rows, trace: str = T):
    return spark.createDataFrame([(s, f"{i:09d}", r, trace) for i, (s, r) in enumerate(rows)], "source string, place string, raw string, trace string")


def normalized(spark, rows, trace: str = T):
    from weftline.sources.vendor import normalize

    return normalize(raw(spark, rows, trace), spark.createDataFrame(SOURCES, "id string, profile string"), KEY, W)


def steps_of(spark, rows, trace: str = T):
    from weftline.sources.vendor import clean

    return clean(normalized(spark, rows, trace))


def origins_of(spark, given):
    from weftline.functions.types import ORIGINS as KIND

    names = [c.strip().split(" ")[0] for c in KIND.split(",")]
    return spark.createDataFrame([tuple(o[n] for n in names) for o in given], KIND)
