"""Canonical JSON, digests and encodings, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domain tags (fixed values of the data format).
STEP, ORIGIN, EDGE, GRAPH, AUDIT, BUNDLE = "VL-STEP/1", "VL-ORIGIN/1", "VL-EDGE/1", "VL-GRAPH/1", "VL-AUDIT/1", "VL-BUNDLE/1"
BATCH, REQUEST, CONFIG, BACKUP, TRUST_UPDATE = "VL-BATCH/1", "VL-REQUEST/1", "VL-CONFIG/1", "VL-BACKUP/1", "VL-TRUST-UPDATE/1"
ORIGIN_SIGN, AUDIT_SIGN = "VL-ORIGIN-SIGN/1", "VL-AUDIT-SIGN/1"
ZERO = "0" * 64


def canonical(value: Column | str) -> Column:
    """Canonical JSON text of a struct, map or array.

    Struct fields must be declared in alphabetical order; nulls are written. Numbers have to
    be integers.
    """
    return F.to_json(value, {"ignoreNullFields": "false"})


def sha256_text(text: Column | str) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def digest_text(tag: str, json: Column | str) -> Column:
    """sha256 of tag, a zero byte and canonical JSON text, as hex."""
    return F.sha2(F.concat(F.lit(tag.encode() + b"\0"), F.encode(json, "utf-8")), 256)


def digest(tag: str, value: Column | str) -> Column:
    return digest_text(tag, canonical(value))


def sign_payload(tag: str, digest_hex: Column | str) -> Column:
    """What is signed for a digest: tag, a zero byte and the digest's bytes."""
    return F.concat(F.lit(tag.encode() + b"\0"), F.unhex(digest_hex))


def base64url(raw: Column | str) -> Column:
    """Unpadded base64url text of bytes."""
    return F.rtrim(F.translate(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), "+/=", "-_ "))


def from_base64url(text: Column | str) -> Column:
    """Bytes of canonical unpadded base64url text; null for any other text."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.when(text.rlike(r"\A[A-Za-z0-9_-]*\z"), text)
    padded = F.concat(F.translate(whole, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4)).cast("int")))
    raw = F.when(F.length(whole) % 4 != 1, F.unbase64(padded))
    return F.when(base64url(raw) == text, raw)


def escape_pointer(text: Column | str) -> Column:
    """A member name as a JSON pointer token."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def short(text: Column | str) -> Column:
    return F.substring(text, 1, 12)


def sorted_by_json(values: Column, key=None) -> Column:
    """An array in the order of its elements' canonical JSON (of ``key`` of each, if given)."""
    keyed = F.transform(values, lambda x: F.struct(canonical(key(x) if key else x).alias("k"), x.alias("x")))
    return F.when(F.size(values) <= 1, values).otherwise(F.transform(F.array_sort(keyed), lambda p: p["x"]))
