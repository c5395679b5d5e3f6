"""DDL of the protocol objects, fields in alphabetical order so that their JSON is canonical."""

from __future__ import annotations

AGENT = "struct<namespace:string,principal:string,subject:string>"
POLICY = "struct<decision:string,digest:string,version:string>"
PARENT = "struct<kind:string,value:string>"
OFFER = f"struct<child_agent:{AGENT},child_source:string,id:string,scope:string>"
STEP_REF = "struct<hash:string,record:string,source:string>"
ACCEPT = f"struct<id:string,parent:{STEP_REF},scope:string>"
ATTACHMENT = "struct<bytes:string,digest:string,format:string>"
LINEAGE = f"struct<accept:{ACCEPT},agent:{AGENT},attachments:array<{ATTACHMENT}>,offers:array<{OFFER}>,policy:{POLICY},trace_id:string,v:int>"

#: Columns of a step's body, in canonical order.
BODY = {
    "accept": ACCEPT, "agent": AGENT, "attachments": f"array<{ATTACHMENT}>", "native_span": "string", "native_trace": "string", "offers": f"array<{OFFER}>", "parents": f"array<{PARENT}>",
    "policy": POLICY, "profile": "string", "record": "string", "source": "string", "trace": "string", "v": "int", "workspace": "string",
}
STEPS = ", ".join(f"{k} {v}" for k, v in BODY.items()) + ", hash string"
#: Columns of an attestation's body, in canonical order, then its envelope's.
ORIGIN_BODY = ("key", "prev", "seq", "source", "step", "stream", "v", "workspace")
ORIGINS = "key string, prev string, seq string, source string, step string, stream string, v int, workspace string, hash string, signature string"
#: Columns of an edge's body, in canonical order.
EDGE_BODY = ("child", "delegation", "kind", "parent", "scope", "trace", "v")
EDGES = "child string, delegation string, kind string, parent string, scope string, trace string, v int, hash string"
GAPS = "trace string, code string, subject string, related array<string>"
KEY_PINS = "id string, public string, role string, workspace string, source string, stream string, first_seq string, last_seq string, status string"
HEAD_PINS = "role string, source string, stream string, seq string, hash string"
SIGNED = "source string, stream string, seq string, prev string, key string, hash string, signature string, step string"
