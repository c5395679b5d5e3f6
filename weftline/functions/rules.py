"""Closed objects of the data format, from one description: their DDL, and their first error as a column over VARIANT.

A rule says what a value must be; ``Rule.error`` gives the first thing wrong with it as struct(code, field), null where
nothing is, with the field as a JSON pointer. An object must have all its members and no other: missing members come
first, in the order described here, then unknown ones (in the order of their names, as VARIANT keeps no other), then the
members themselves in order. All rules are native columns and evaluated without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import checks
from weftline.functions.canonical import ZERO, escape_pointer
from weftline.functions.strict import MAX_SAFE

INVALID = "SCHEMA_INVALID"


class Rule(NamedTuple):
    """``check`` takes (root, path, at): a variant, the path of the value in it, and its field as a column."""

    ddl: str
    check: Callable[[Column, str, Column], Column]

    def error(self, value: Column | str, at: Column | str = "") -> Column:
        return self.check(F.col(value) if isinstance(value, str) else value, "$", F.lit(at) if isinstance(at, str) else at)


def _fault(code: str, at: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), at.alias("field"))


def _get(root: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(root, path, kind)


def _kind(root: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(root, path)), F.lit(""))


def scalar(ok: Callable[[Column], Column], code: str = INVALID, of_other: str = INVALID) -> Rule:
    """A string for which ``ok`` holds; ``of_other`` is the code of what is no string."""

    def check(root: Column, path: str, at: Column) -> Column:
        return F.when(_kind(root, path) != "STRING", _fault(of_other, at)).when(~ok(_get(root, path, "string")), _fault(code, at))

    return Rule("string", check)


def typed_id(prefix: str) -> Rule:
    return scalar(lambda c: checks.is_typed_id(c, prefix), "ID_INVALID")


def one_of(*values: str, code: str = INVALID) -> Rule:
    return scalar(lambda c: checks.is_one_of(c, values), code, code)


def integer(low: int, high: int = MAX_SAFE, code: str = INVALID) -> Rule:
    def check(root: Column, path: str, at: Column) -> Column:
        value = _get(root, path, "decimal(38,9)")
        whole = _kind(root, path).rlike(r"\A(?:BIGINT|DECIMAL.*|DOUBLE)\z") & (value == F.floor(value)) & value.between(low, high)
        return F.when(~F.coalesce(whole, F.lit(False)), _fault(code, at))

    return Rule("bigint", check)


def true() -> Rule:
    return Rule("boolean", lambda root, path, at: F.when(~F.coalesce(_get(root, path, "boolean") & (_kind(root, path) == "BOOLEAN"), F.lit(False)), _fault(INVALID, at)))


def nullable(rule: Rule) -> Rule:
    return Rule(rule.ddl, lambda root, path, at: F.when(_kind(root, path) != "VOID", rule.check(root, path, at)))


def array(of: Rule | None, most: int | None = None, unique: tuple[str, ...] = ()) -> Rule:
    """An array, of at most so many elements, which ``of`` holds for and which differ in their members ``unique``.

    Without ``of`` the elements are left to a scan of their own, in which each is a row.
    """

    def check(root: Column, path: str, at: Column) -> Column:
        items = _get(root, path, "array<variant>")
        none = F.lit(None).cast("struct<code:string,field:string>")
        found = F.when(~_kind(root, path).startswith("ARRAY"), _fault(INVALID, at))
        if most is not None:
            found = found.when(F.size(items) > most, _fault(INVALID, at))
        inner = none
        if of is not None:
            errors = F.transform(items, lambda x, i: of.check(x, "$", F.concat(at, F.lit("/"), i.cast("string"))))
            inner = F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))
        again = none
        if unique:
            keys = F.transform(items, lambda x: F.struct(*(_get(x, f"$.{m}", "string").alias(m) for m in unique)))
            again = F.when(F.size(F.array_distinct(keys)) != F.size(keys), _fault(INVALID, at))
        return F.coalesce(found, inner, again)

    return Rule(f"array<{of.ddl if of else 'variant'}>", check)


def closed(_also: Callable[[Column, str, Column], Column] | None = None, **members: Rule) -> Rule:
    """An object with exactly these members; ``_also`` is what must hold of them together."""

    def check(root: Column, path: str, at: Column) -> Column:
        names = F.map_keys(_get(root, path, "map<string,variant>"))
        field = lambda name: F.concat(at, F.lit(f"/{name}"))
        missing = [F.when(_get(root, f"{path}.{m}").isNull(), _fault(INVALID, field(m))) for m in members]
        unknown = F.array_sort(F.array_except(names, F.array(*map(F.lit, members))))
        inside = [rule.check(root, f"{path}.{m}", field(m)) for m, rule in members.items()]
        last = [] if _also is None else [_also(root, path, at)]
        found = F.coalesce(*missing, F.when(F.size(unknown) > 0, _fault(INVALID, F.concat(at, F.lit("/"), escape_pointer(F.get(unknown, F.lit(0)))))), *inside, *last)
        return F.when(names.isNull(), _fault(INVALID, at)).otherwise(found)

    return Rule("struct<" + ",".join(f"{m}:{members[m].ddl}" for m in sorted(members)) + ">", check)


def tagged(member: str, **kinds: Rule) -> Rule:
    """One of several objects, told apart by a member of its own."""

    def check(root: Column, path: str, at: Column) -> Column:
        kind = _get(root, f"{path}.{member}", "string")
        out = F.when(~_kind(root, path).startswith("OBJECT"), _fault(INVALID, at)).when(_kind(root, f"{path}.{member}") != "STRING", _fault(INVALID, F.concat(at, F.lit(f"/{member}"))))
        for name, rule in kinds.items():
            out = out.when(kind == name, rule.check(root, path, at))
        return out.otherwise(_fault(INVALID, F.concat(at, F.lit(f"/{member}"))))

    return Rule("variant", check)


def _chained(root: Column, path: str, at: Column) -> Column:
    """The first link of a stream follows nothing, and no other does."""
    first, zero = _get(root, f"{path}.body.seq", "string") == "1", _get(root, f"{path}.body.prev", "string") == ZERO
    return F.when(first != zero, _fault(INVALID, F.concat(at, F.lit("/body/prev"))))


text, namespace, counter = scalar(checks.is_text), scalar(checks.is_namespace), scalar(checks.is_counter)
sha256, public_key, signature = scalar(checks.is_hash), scalar(checks.is_public_key), scalar(checks.is_signature)
position = scalar(lambda c: checks.is_counter(c) & (c != "0"))
string, path_text = scalar(lambda c: c.isNotNull()), scalar(lambda c: F.char_length(c).between(1, 512))
workspace, source_id, trace_id, import_id, request_id, delegation_id, key_id = map(typed_id, checks.ID_PREFIXES)
version = integer(1, 1, "UNSUPPORTED_VERSION")

# Members, values and bounds below are fixed values of the data format.
profile = one_of(*checks.PROFILES, code="PROFILE_MISMATCH")
disclosure, semantics, authority = one_of("NORMALIZED_ONLY"), one_of("NOT_VERIFIED"), one_of("UNKNOWN")
structural = one_of("COMPLETE_RELATIVE", "INCOMPLETE", "CONFLICTED")
role = one_of("origin", "audit")
agent = closed(namespace=namespace, subject=text, principal=nullable(text))
policy = closed(digest=sha256, version=text, decision=one_of(*checks.DECISIONS))
offer = closed(id=delegation_id, child_source=source_id, child_agent=agent, scope=sha256)
step_ref = closed(source=source_id, record=text, hash=sha256)
accept = closed(id=delegation_id, parent=step_ref, scope=sha256)
attachment = closed(digest=sha256, format=text, bytes=counter)
parent = closed(kind=one_of("record", "span"), value=text)
step_body = closed(
    v=version, workspace=workspace, trace=trace_id, source=source_id, profile=profile, record=text, native_trace=text, native_span=text, parents=array(parent, 16, ("kind", "value")), agent=nullable(agent),
    policy=nullable(policy), offers=array(offer, 32, ("id",)), accept=nullable(accept), attachments=array(attachment, 16, ("format", "digest")),
)
step = closed(body=step_body, hash=sha256)
origin_body = closed(v=version, workspace=workspace, source=source_id, stream=text, seq=position, prev=sha256, step=sha256, key=key_id)
origin = closed(_chained, body=origin_body, hash=sha256, signature=signature)
artifact = closed(digest=sha256, format=text, bytes=counter, content=string)
source = closed(id=source_id, profile=profile, namespace=text, project=text)
path_request = closed(trace=trace_id, revision=counter, action=closed(source=source_id, record=text), max_depth=integer(1, 256), max_nodes=integer(1, 4096))
key_pin = closed(id=key_id, public=public_key, role=role, workspace=workspace, source=nullable(source_id), stream=nullable(text), first_seq=counter, last_seq=counter, status=one_of("ACTIVE", "RETIRED", "COMPROMISED"))
head_pin = closed(role=role, source=nullable(source_id), stream=nullable(text), seq=counter, hash=sha256)
trust_package = closed(v=version, workspace=workspace, keys=array(key_pin), heads=array(head_pin))
gap = closed(code=one_of(*checks.GAP_CODES), subject=sha256, related=array(sha256))
edge = closed(body=closed(v=version, trace=trace_id, parent=sha256, child=sha256, kind=one_of(*checks.EDGE_KINDS), delegation=nullable(delegation_id), scope=nullable(sha256)), hash=sha256)
graph_manifest = closed(v=version, workspace=workspace, trace=trace_id, steps=array(sha256, 100_000), origins=array(sha256, 100_000), edges=array(sha256, 400_000), gaps=array(gap, 400_000))
inventory_item = closed(kind=one_of("step", "origin", "audit", "attachment"), digest=sha256, bytes=counter)
audit_data = tagged(
    "kind",
    WorkspaceCreated=closed(kind=string, config=sha256),
    SourceRegistered=closed(kind=string, source=source),
    TraceCreated=closed(kind=string, trace=trace_id, graph=sha256),
    ImportStaged=closed(**{"kind": string, "import": import_id, "trace": trace_id, "batch": sha256, "rows": integer(0)}),
    ImportCommitted=closed(**{"kind": string, "import": import_id, "trace": trace_id, "revision": counter, "graph": sha256, "batch": sha256}),
    ImportCancelled=closed(**{"kind": string, "import": import_id, "reason": one_of("USER", "EXPIRED")}),
    RetentionPruned=closed(kind=string, traces=array(closed(trace=trace_id, revisions=array(counter))), artifacts=array(sha256)),
    KeyRotated=closed(kind=string, old=key_id, next=key_id, next_public=public_key),
)
audit = closed(body=closed(v=version, workspace=workspace, seq=counter, prev=sha256, request=request_id, key=key_id, data=audit_data), hash=sha256, signature=signature)
backup_manifest = closed(v=version, workspace=workspace, schema=integer(1), head=closed(seq=counter, hash=sha256), files=array(closed(path=path_text, bytes=counter, digest=sha256)))
trust_update = closed(v=version, workspace=workspace, retire=closed(id=key_id, last_seq=counter), activate=closed(id=key_id, public=public_key, first_seq=counter))
external_head = closed(v=version, workspace=workspace, seq=counter, hash=sha256)
trace_result = closed(id=trace_id, revision=counter, graph=sha256)
verification = closed(
    integrity=one_of("VALID", "INVALID"), structural=structural, origin=one_of("TRUSTED_AT_PIN", "UNSIGNED", "UNTRUSTED", "INCOMPLETE", "CONFLICTED"), audit=one_of("TRUSTED_AT_PIN", "UNTRUSTED", "INCOMPLETE"),
    disclosure=disclosure, semantics=semantics, current_authority=authority, reasons=array(text),
)
stage_result = closed(**{"import": import_id, "state": one_of("STAGED"), "batch": sha256, "rows": integer(0), "warnings": array(text)})
commit_result = closed(**{"import": import_id, "state": one_of("COMMITTED"), "trace": trace_id, "revision": counter, "graph": sha256, "added": integer(0), "duplicates": integer(0), "conflicts": integer(0), "audit": sha256})
import_state = closed(**{"import": import_id, "state": one_of("STAGED", "COMMITTED", "CANCELLED"), "batch": sha256, "commit": nullable(commit_result), "reason": nullable(one_of("USER", "EXPIRED"))})
source_list = closed(sources=array(source))

#: Elements of a bundle's arrays, where they stand, and what each must be; each is checked as a row of its own.
BUNDLE_PARTS = {
    "body.graph.steps": sha256, "body.graph.origins": sha256, "body.graph.edges": sha256, "body.graph.gaps": gap, "body.path.steps": step, "body.path.origins": origin, "body.path.edges": edge, "body.path.gaps": gap,
    "body.inventory": inventory_item, "steps": step, "origins": origin, "audit": audit, "attachments": artifact,
}


def bundle(format: str) -> Rule:
    """A proof bundle of a format, but for the elements of its arrays (``BUNDLE_PARTS``)."""
    graph = closed(v=version, workspace=workspace, trace=trace_id, steps=array(None, 100_000), origins=array(None, 100_000), edges=array(None, 400_000), gaps=array(None, 400_000))
    path = closed(
        trace=trace_id, revision=counter, graph=sha256, action=sha256, steps=array(None, 4096), origins=array(None, 100_000), edges=array(None, 16_384), gaps=array(None, 100_000), structural=structural,
        evidence=one_of("CLAIMED"), disclosure=disclosure,
    )
    body = closed(
        v=version, format=one_of(format), workspace=workspace, trace=trace_id, revision=counter, graph=graph, path_request=path_request, path=path, inventory=array(None, 400_000), attachment_policy=one_of("INCLUDE", "OMIT"),
        disclosure=disclosure, trust_required=true(),
    )
    return closed(body=body, hash=sha256, steps=array(None, 100_000), origins=array(None, 100_000), audit=array(None, 100_000), attachments=array(None, 100_000))


def handoff(format: str) -> Rule:
    """The short summary that goes with a bundle."""
    return closed(v=version, kind=one_of("action-lineage"), format=one_of(format), bundle=sha256, action=sha256, trace=trace_id, graph=sha256, disclosure=disclosure, semantics=semantics)


DOCUMENTS = {
    "step": step, "origin": origin, "artifact": artifact, "source": source, "path_request": path_request, "trust_package": trust_package, "gap": gap, "edge": edge, "graph_manifest": graph_manifest, "inventory_item": inventory_item, "audit": audit,
    "backup_manifest": backup_manifest, "trust_update": trust_update, "external_head": external_head, "trace_result": trace_result, "verification": verification, "stage_result": stage_result, "commit_result": commit_result,
    "import_state": import_state, "source_list": source_list,
}
