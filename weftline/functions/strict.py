"""What JSON text must satisfy beyond what VARIANT refuses, as native column expressions.

VARIANT refuses malformed text and repeated members, but takes text after the first value,
half surrogate pairs, numbers beyond a double and nesting of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of one document (fixed values of the data format).
MAX_DEPTH, MAX_MEMBERS, MAX_ELEMENTS = 32, 1024, 4096
MAX_SAFE = 2**53 - 1
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def _bound(value: Column, use) -> Column:
    """``use`` of a column that is computed once."""
    return F.transform(F.array(value), use)[0]


def _bare(raw: Column) -> Column:
    """The text with each string as an ``s``: escapes go first, then a string ends at the next quote."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), r'"[^"]*"', "s")


def _shape_fault(bare: Column) -> Column:
    """DEPTH, MEMBERS, ELEMENTS or TRAILING: innermost containers become a scalar, a level a turn."""
    shape = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^{}\[\],: \t\r\n]+", "s"), r"[: \t\r\n]+", " "))
    levels = F.least(F.lit(MAX_DEPTH), F.length(F.regexp_replace(bare, r"[^{\[]", "")))

    def turn(state: Column, _: Column) -> Column:
        commas = F.regexp_replace(state["text"], "[s ]", "")
        over = F.when(commas.rlike(rf"\{{,{{{MAX_MEMBERS}}}"), "MEMBERS").when(commas.rlike(rf"\[,{{{MAX_ELEMENTS}}}"), "ELEMENTS")
        return F.struct(F.regexp_replace(state["text"], r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]", "s").alias("text"), F.coalesce(state["fault"], over).alias("fault"))

    start = F.struct(shape.alias("text"), F.lit(None).cast("string").alias("fault"))
    left = lambda s: F.when(s["text"].rlike(r"[{\[]"), "DEPTH").when(F.trim(s["text"]) != "s", "TRAILING")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), levels)), start, turn, lambda s: F.coalesce(s["fault"], left(s)))


def _numbers(bare: Column) -> Column:
    return F.transform(F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))


def beyond_variant(raw: Column | str) -> Column:
    """What is wrong with a text that VARIANT takes; null for good text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    paired = F.regexp_replace(F.regexp_replace(raw, r"\\\\", ""), _HIGH + _LOW, "s")
    large = lambda b: b.rlike(r"[eE]\+?[0-9]{3}|[0-9]{200}") & F.exists(_numbers(b), lambda x: F.abs(x) == float("inf"))
    return F.when(F.contains(raw, F.lit("\\u")) & paired.rlike(r"\\u[dD][89a-fA-F]"), "SURROGATE").otherwise(_bound(_bare(raw), lambda b: F.when(large(b), "NUMBER").otherwise(_shape_fault(b))))


def is_small(raw: Column) -> Column:
    """Whether an object's text that VARIANT takes as one value is good by its look alone.

    It is too short for too many members and has too few brackets for too many levels, no escape of a half pair, and no
    number that could be beyond a double. Text that looks otherwise may be good, too.
    """
    levels = rf"\A(?:[^{{\[]*+[{{\[]){{{MAX_DEPTH + 1}}}"
    large = r"[:,\[ \t\r\n]-?(?:[0-9]{200}|[0-9][0-9.]*+[eE]\+?[0-9]{3})"
    return (F.octet_length(raw) < 4 * MAX_MEMBERS) & F.startswith(raw, F.lit("{")) & ~F.contains(raw, F.lit("\\u")) & ~raw.rlike(levels) & ~raw.rlike(large)


def beside_digest(raw: Column | str) -> Column:
    """The text and its digest as two elements of a VARIANT array; null where that is no array.

    The array has exactly these two only if the text is one value: whatever follows a value in the text gives an array
    of another length or end, or none. So text that VARIANT would leave unread needs no reading of its own.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), F.sha2(raw.cast("binary"), 256), F.lit('"]')))


def is_beside(both: Column | str, digest: Column | str) -> Column:
    """Whether an array of ``beside_digest`` has the text as one value, and its digest."""
    at = lambda i, kind: F.try_variant_get(both, f"$[{i}]", kind)
    return F.coalesce((at(1, "string") == digest) & at(2, "variant").isNull(), F.lit(False))


def json_fault(raw: Column | str) -> Column:
    """Why VARIANT or the rules here refuse a text: SYNTAX, SURROGATE, NUMBER, DEPTH, MEMBERS, ELEMENTS, TRAILING; null for good text.

    Null text is SYNTAX. The first in that order is given, of the last four the one nearest to the innermost level.
    """
    return F.when(F.try_parse_json(raw).isNull(), "SYNTAX").otherwise(beyond_variant(raw))


def core_numbers(raw: Column | str) -> Column:
    """Whether all numbers of a good text are integers from 0 to 2^53 - 1 (in any notation; no minus zero)."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inside = lambda x: (x <= MAX_SAFE) & (x == F.floor(x))
    return _bound(_bare(raw), lambda b: ~b.rlike("(?<![eE])-") & F.forall(_numbers(b), inside))
