"""Domain predicates and first-error columns of the protocol objects.

A predicate is a boolean column, null input giving false. ``first_error`` turns an ordered
list of (failed, code, field) into a nullable struct; rows without one are clean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.canonical import from_base64url

#: Codes of derived gaps (fixed values of the data format).
GAP_CODES = (
    "ACCEPT_MISSING", "CYCLE", "DELEGATION_MISMATCH", "DELEGATION_REUSED", "OFFER_MISSING", "ORIGIN_FORK",
    "ORIGIN_GAP", "PARENT_AMBIGUOUS", "PARENT_HASH_MISMATCH", "PARENT_MISSING", "SOURCE_CONFLICT",
)
#: Values of members of the objects, and prefixes of ids (fixed values of the data format).
DECISIONS = ("ALLOW", "REVIEW", "DENY", "UNKNOWN")
EDGE_KINDS = ("NATIVE_PARENT", "DELEGATES")
PROFILES = ("langsmith-runs/1", "langfuse-observations/1", "braintrust-spans/1")
#: Prefixes of typed ids: workspace, source, trace, import, request, delegation, key.
ID_PREFIXES = ("vlw_", "vls_", "vlt_", "vli_", "vlq_", "vld_", "vlk_")
#: Reasons that make a structural verdict conflicted.
CONFLICTS = ("SOURCE_CONFLICT", "PARENT_AMBIGUOUS", "DELEGATION_REUSED", "CYCLE", "ORIGIN_FORK")
MAX_COUNTER = 2**63 - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _so(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_hash(c: Column | str) -> Column:
    return _so(_col(c).rlike(r"\A[0-9a-f]{64}\z"))


def is_counter(c: Column | str) -> Column:
    """Decimal text without leading zeros, at most 2^63 - 1."""
    c = _col(c)
    return _so(c.rlike(r"\A(?:0|[1-9][0-9]{0,18})\z") & (c.try_cast("decimal(20,0)") <= F.lit(MAX_COUNTER)))


def is_typed_id(c: Column | str, prefix: str) -> Column:
    return _so(_col(c).rlike(rf"\A{prefix}[-_0-9A-Za-z]{{21}}\z"))


def is_text(c: Column | str) -> Column:
    """1 to 256 code points, at most 1024 bytes of UTF-8, no control characters."""
    c = _col(c)
    return _so(F.char_length(c).between(1, 256) & (F.octet_length(c) <= 1024) & ~c.rlike(r"[\x00-\x1f\x7f]"))


def is_namespace(c: Column | str) -> Column:
    return _so(_col(c).rlike(r"\A[a-z][a-z0-9.-]{0,63}\z"))


def is_public_key(c: Column | str) -> Column:
    return _so(F.length(from_base64url(_col(c))) == 32)


def is_signature(c: Column | str) -> Column:
    return _so(F.length(from_base64url(_col(c))) == 64)


def is_one_of(c: Column | str, values: Sequence[str]) -> Column:
    return _so(_col(c).isin(*values))


def first_error(rules: Sequence[tuple[Column, str, str]]) -> Column:
    """The first rule whose condition holds, as struct(code, field); null if none does."""
    return F.coalesce(*(F.when(_so(failed), F.struct(F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field"))) for failed, code, field in rules))


def bad(ok: Column, field: str, code: str = "SCHEMA_INVALID") -> tuple[Column, str, str]:
    return ~ok, code, field


def agent_rules(a: Column, at: str) -> list[tuple[Column, str, str]]:
    here = a.isNotNull()
    return [
        (here & ~is_namespace(a["namespace"]), "SCHEMA_INVALID", f"{at}/namespace"),
        (here & ~is_text(a["subject"]), "SCHEMA_INVALID", f"{at}/subject"),
        (here & a["principal"].isNotNull() & ~is_text(a["principal"]), "SCHEMA_INVALID", f"{at}/principal"),
    ]


def policy_rules(p: Column, at: str) -> list[tuple[Column, str, str]]:
    here = p.isNotNull()
    return [
        (here & ~is_hash(p["digest"]), "SCHEMA_INVALID", f"{at}/digest"),
        (here & ~is_text(p["version"]), "SCHEMA_INVALID", f"{at}/version"),
        (here & ~is_one_of(p["decision"], DECISIONS), "SCHEMA_INVALID", f"{at}/decision"),
    ]


def each(items: Column, ok) -> Column:
    """Whether a predicate holds for all elements (also where there are none)."""
    return F.when(F.size(items) > 0, F.coalesce(F.forall(items, ok), F.lit(True))).otherwise(True)


def distinct(items: Column) -> Column:
    return F.when(F.size(items) <= 1, True).otherwise(F.size(F.array_distinct(items)) == F.size(items))


def lineage_rules(m: Column, at: str) -> list[tuple[Column, str, str]]:
    """Rules of the lineage metadata object; ``m`` is null where there is none."""
    here = m.isNotNull()
    agent_ok = lambda a: is_namespace(a["namespace"]) & is_text(a["subject"]) & (a["principal"].isNull() | is_text(a["principal"]))
    accept = m["accept"]
    rules = [
        (here & (F.coalesce(m["v"], F.lit(0)) != 1), "UNSUPPORTED_VERSION", f"{at}/v"),
        *agent_rules(m["agent"], f"{at}/agent"),
        *policy_rules(m["policy"], f"{at}/policy"),
        (here & (m["offers"].isNull() | (F.size(m["offers"]) > 32)), "SCHEMA_INVALID", f"{at}/offers"),
        (here & ~each(m["offers"], lambda o: is_typed_id(o["id"], "vld_") & is_typed_id(o["child_source"], "vls_")), "ID_INVALID", f"{at}/offers"),
        (here & ~each(m["offers"], lambda o: _so(agent_ok(o["child_agent"])) & is_hash(o["scope"])), "SCHEMA_INVALID", f"{at}/offers"),
        (here & ~distinct(F.transform(m["offers"], lambda o: o["id"])), "SCHEMA_INVALID", f"{at}/offers"),
        (accept.isNotNull() & ~(is_typed_id(accept["id"], "vld_") & is_typed_id(accept["parent"]["source"], "vls_")), "ID_INVALID", f"{at}/accept"),
        (accept.isNotNull() & ~(is_text(accept["parent"]["record"]) & is_hash(accept["parent"]["hash"]) & is_hash(accept["scope"])), "SCHEMA_INVALID", f"{at}/accept"),
        (here & (m["attachments"].isNull() | (F.size(m["attachments"]) > 16)), "SCHEMA_INVALID", f"{at}/attachments"),
        (here & ~each(m["attachments"], lambda r: is_hash(r["digest"]) & is_text(r["format"]) & is_counter(r["bytes"])), "SCHEMA_INVALID", f"{at}/attachments"),
        (here & ~distinct(F.transform(m["attachments"], lambda r: F.struct(r["format"], r["digest"]))), "SCHEMA_INVALID", f"{at}/attachments"),
    ]
    return rules
