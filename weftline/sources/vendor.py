"""Vendor exports: row files, and their three profiles as projections over VARIANT.

Rows are read as text and parsed once into VARIANT, which refuses duplicate members; text
beyond the first value, half pairs, numbers and nesting out of bounds are refused beside it. Only
the fields a profile names are projected, so payloads, secrets and times are pruned here.
Every row keeps its place, so the first error of a file is defined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import checks
from weftline.functions.canonical import STEP, canonical, digest, sorted_by_json
from weftline.functions.strict import beside_digest, beyond_variant, is_beside, is_small
from weftline.functions.types import ATTACHMENT, BODY, LINEAGE, OFFER, PARENT
from weftline.storage import materialize

ROW_BYTES = 1 << 20
#: Per profile: paths of record, native trace, native span, parents, and the object that holds the metadata.
PROFILES = {
    "langsmith-runs/1": ("id", "trace_id", "id", "parent_run_id", "extra.metadata"),
    "langfuse-observations/1": ("id", "traceId", "id", "parentObservationId", "metadata"),
    "braintrust-spans/1": ("id", "root_span_id", "span_id", "span_parents", "metadata"),
}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, raw): lines of files, split by Spark at any byte, numbered from 0 within their file.

    A split holds the lines that begin in it. Lines are counted a split, and what stands before a split in its file is
    the sum over those before it, so numbers are the same however files are split. One row a split is shuffled for it.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    # counted once and written: ids of a second reading of the same splits are the same
    placed = materialize(splits.withColumn("before", F.coalesce(before, F.lit(0))), "splits")
    joined = lines.join(placed, ["file", "start"])
    within = F.col("id") - F.col("first")
    at = F.when(within.between(0, F.col("n") - 1), F.col("before") + within).otherwise(F.raise_error(F.lit("files changed while they were read")))
    bare = F.when(F.endswith("value", F.lit("\r")), F.substr("value", F.lit(1), F.char_length("value") - 1)).otherwise(F.col("value"))  # keeps broken bytes, as a pattern wouldn't
    return joined.select("file", at.alias("at"), bare.alias("raw"))


def is_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, array): whether the first character of a file that isn't blank opens an array."""
    lines = _lines(spark, path).withColumn("text", F.ltrim(F.col("raw"), F.lit(" \t\r"))).where("text <> ''")
    return lines.groupBy("file").agg(F.min_by(F.substring("text", 1, 1), "at").alias("c")).select("file", (F.col("c") == "[").alias("array"))


def read_rows(spark: SparkSession, path: str, source: str, array: bool = False) -> DataFrame:
    """(source, place, raw): rows of a JSON-lines file or folder, or with ``array`` of JSON arrays, a document each.

    ``place`` orders rows: file, then the line or element, stable from reading to reading. Files of lines are split at
    any byte, so one of any size spreads over tasks; an array is one document, and one task's work. Blank lines stay,
    they are invalid rows, as is a line with broken UTF-8 (``normalize`` refuses it); a document that is no array, or
    has broken UTF-8, is one row that doesn't parse. The line end after the last line is no row.
    """
    if array:
        files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
        parsed = F.when(F.is_valid_utf8("value"), F.try_parse_json("value"))
        rows = F.when(F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False)), parsed.cast("array<variant>"))
        split = files.select("file", F.posexplode_outer(rows).alias("at", "row"), rows.isNull().alias("odd")).where("odd or row is not null")
        lines = split.select("file", "at", F.when(F.col("odd"), F.lit("")).otherwise(F.to_json("row")).alias("raw"))
    else:
        lines = _lines(spark, path)
    return lines.select(F.lit(source).alias("source"), F.concat_ws(":", "file", F.lpad(F.coalesce("at", F.lit(0)).cast("string"), 12, "0")).alias("place"), "raw")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once per row.

    A filter over a cheap-looking column is otherwise pushed through the projections below it,
    and each of its mentions of a parsed object becomes a parse of its own.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def _kind(v: Column) -> Column:
    """JSON type of a variant: 'STRING', 'VOID' (null), 'OBJECT<...>', 'ARRAY<...>'; SQL null where there is none."""
    return F.schema_of_variant(v)


def _is(kind: Column, prefix: str) -> Column:
    return F.coalesce(kind.startswith(prefix), F.lit(False))


def _required(value: str, kind: str, field: Column) -> list[tuple[Column, str, Column]]:
    return [(~_is(F.col(kind), "STRING") | (F.col(value) == ""), "PROFILE_MISMATCH", field), (~checks.is_text(value), "SCHEMA_INVALID", field)]


def _by_profile(of) -> Column:
    """A column that depends on the row's profile."""
    out = None
    for profile, paths in PROFILES.items():
        out = (F if out is None else out).when(F.col("profile") == profile, of(profile, *paths))
    return out


#: Types of the metadata's members, nested ones too: member names and types of every closed object.
AGENT_KIND = "OBJECT<namespace: STRING, principal: (?:STRING|VOID), subject: STRING>"
REF_KIND = "OBJECT<hash: STRING, record: STRING, source: STRING>"
KINDS = {
    "accept": f"VOID|OBJECT<id: STRING, parent: {REF_KIND}, scope: STRING>", "agent": f"VOID|{AGENT_KIND}", "attachments": "ARRAY<.*>", "offers": "ARRAY<.*>",
    "policy": "VOID|OBJECT<decision: STRING, digest: STRING, version: STRING>", "trace_id": "STRING", "v": "BIGINT|DECIMAL.*|DOUBLE",
}
ELEMENTS = {"attachments": "OBJECT<bytes: STRING, digest: STRING, format: STRING>", "offers": f"OBJECT<child_agent: {AGENT_KIND}, child_source: STRING, id: STRING, scope: STRING>"}


def _matches(kind: str):
    return lambda found: F.coalesce(found.rlike(rf"\A{kind}\z"), F.lit(False))


def closed_rules(inner: Column, at: Column) -> list[tuple[Column, str, Column]]:
    """Rules on the members of a metadata object as it stands: no other member, none missing, each of its type."""
    here = inner.isNotNull()
    names = F.array_sort(F.json_object_keys(F.to_json(inner)))
    rules = [(here & ~_is(_kind(inner), "OBJECT"), "SCHEMA_INVALID", at), (here & (names != F.array(*map(F.lit, KINDS))), "SCHEMA_INVALID", at)]
    for name, kind in KINDS.items():
        field = F.concat(at, F.lit(f"/{name}"))
        member = F.try_variant_get(inner, f"$.{name}", "variant")
        rules.append((here & ~F.coalesce(_kind(member).rlike(rf"\A(?:{kind})\z"), F.lit(False)), "SCHEMA_INVALID", field))
        if name in ELEMENTS:
            kinds = F.transform(F.try_variant_get(inner, f"$.{name}", "array<variant>"), F.schema_of_variant)
            rules.append((here & ~checks.each(kinds, _matches(ELEMENTS[name])), "SCHEMA_INVALID", field))
    return rules


def plainly_closed(inner: Column, m: Column) -> Column:
    """Whether a metadata object breaks none of ``closed_rules`` for sure: read as typed members ``m`` it has the same JSON text, and nothing that a rule needs is null.

    Text that differs (``1.0`` for ``1``, say) breaks none either, maybe: the rules decide.
    """
    some = lambda x, *names: x.isNotNull() & reduce(and_, (x[n].isNotNull() for n in names))
    free = lambda x, *names: x.isNull() | some(x, *names)
    offers = checks.each(m["offers"], lambda o: some(o, "child_agent", "child_source", "id", "scope") & some(o["child_agent"], "namespace", "subject"))
    files = checks.each(m["attachments"], lambda a: some(a, "bytes", "digest", "format"))
    accept = m["accept"]
    whole = some(m, "attachments", "offers", "trace_id", "v") & free(m["agent"], "namespace", "subject") & free(m["policy"], "decision", "digest", "version") & (accept.isNull() | (some(accept, "id", "parent", "scope") & some(accept["parent"], "hash", "record", "source")))
    return F.coalesce(whole & offers & files & (F.to_json(inner) == canonical(m)), F.lit(False))


def normalize(rows: DataFrame, sources: DataFrame, metadata_key: str, workspace: str) -> DataFrame:
    """Steps of vendor rows: the step's columns, ``hash``, ``place``, ``warnings`` and ``error``.

    ``rows`` has source, place, raw and trace (the target); ``sources`` has id and profile.
    ``metadata_key`` is the member that holds the lineage metadata in a vendor's metadata
    object. ``error`` is null for clean rows, otherwise the first code and field; rows with one
    have no hash. Null rows, rows with broken UTF-8 and rows of unknown sources are errors too. Each row is read and
    parsed once, whatever its profile; no shuffle but the join with the (small) sources.
    """
    known = rows.join(sources.select(F.col("id").alias("source"), "profile"), "source", "left")
    odd = ~F.is_valid_utf8("raw") | F.when(is_small(F.col("raw")), False).otherwise(beyond_variant("raw").isNotNull())
    opens = F.startswith(F.ltrim(F.col("raw"), F.lit(" \t\r\n")), F.lit("{"))
    parsed = settled(known.withColumn("v", beside_digest("raw")).withColumn("digest", F.sha2(F.col("raw").cast("binary"), 256)).withColumn("bytes", F.octet_length("raw")).withColumn("odd", odd).withColumn("is_object", opens).drop("raw"))
    get = lambda path: F.try_variant_get("v", f"$[0].{path}", "variant")
    # a member is found in objects only, so what holds the metadata is one where there is any
    members = settled(parsed.select(
        "place", "source", "trace", "profile", "bytes", (F.col("odd") | ~is_beside("v", F.col("digest"))).alias("unread"), "is_object",
        _by_profile(lambda p, record, *_: get(record)).alias("a"), _by_profile(lambda p, r, trace, *_: get(trace)).alias("b"), _by_profile(lambda p, r, t, span, *_: get(span)).alias("c"),
        _by_profile(lambda p, r, t, s, parent, *_: get(parent)).alias("d"), _by_profile(lambda p, r, t, s, q, holder: get(f"{holder}.{metadata_key}")).alias("inner"),
    ))
    text = lambda c: F.try_variant_get(c, "$", "string")
    listed = F.try_variant_get("d", "$", "array<variant>")
    several = F.col("profile") == "braintrust-spans/1"
    some = _kind(F.col("d")).isNotNull() & (_kind(F.col("d")) != "VOID")
    named = F.transform(listed, lambda e: F.struct(F.lit("span").alias("kind"), F.try_variant_get(e, "$", "string").alias("value")))
    one = F.when(some, F.array(F.struct(F.lit("record").alias("kind"), text("d").alias("value")))).otherwise(F.array().cast(f"array<{PARENT}>"))
    odd_list = ~_is(_kind(F.col("d")), "ARRAY") | F.exists(listed, lambda e: F.schema_of_variant(e) != "STRING") | F.exists(named, lambda p: p["value"] == "")
    odd_one = some & ((_kind(F.col("d")) != "STRING") | (text("d") == ""))
    field = lambda i: _by_profile(lambda p, *paths: F.lit("/row/" + paths[i].replace(".", "/")))
    fields = settled(members.select(
        "place", "source", "trace", "profile", "bytes", "unread", "is_object",
        text("a").alias("record"), text("b").alias("native_trace"), text("c").alias("native_span"), *(F.coalesce(_kind(F.col(x)), F.lit("")).alias(f"{x}_kind") for x in "abc"),
        F.when(several, named).otherwise(one).alias("parents"), F.when(several, odd_list).otherwise(odd_one).alias("odd_parents"), F.col("inner").isNotNull().alias("given"),
        "inner", F.try_variant_get("inner", "$", LINEAGE).alias("lineage"),
    ))
    inner = F.col("inner")
    closed_error = F.when(inner.isNotNull() & ~plainly_closed(inner, F.col("lineage")), checks.first_error(closed_rules(inner, F.lit("/row/metadata"))))
    fields = settled(fields.withColumn("closed_error", closed_error).drop("inner"))
    m = F.when(F.col("closed_error").isNull(), F.col("lineage"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    error = lambda code, at: F.struct(F.lit(code).alias("code"), (F.lit(at) if isinstance(at, str) else at).alias("field"))
    found = F.coalesce(
        F.when(~F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False)), error("NOT_FOUND", "/source")),
        F.when(F.col("bytes") > ROW_BYTES, error("ROW_LIMIT", "/row")),
        F.when(F.col("unread"), error("JSON_INVALID", "/row")),
        F.when(~F.col("is_object"), error("PROFILE_MISMATCH", "/row")),
        checks.first_error([r for i, (c, k) in enumerate((("record", "a_kind"), ("native_trace", "b_kind"), ("native_span", "c_kind"))) for r in _required(c, k, field(i))]),
        F.when(F.col("odd_parents"), error("PROFILE_MISMATCH", field(3))),
        checks.first_error([(F.size("parents") > 16, "SCHEMA_INVALID", "/row/parents"), checks.bad(checks.each(F.col("parents"), lambda p: checks.is_text(p["value"])), "/row/parents"), checks.bad(checks.distinct(F.col("parents")), "/row/parents")]),
        F.col("closed_error"),
        checks.first_error(checks.lineage_rules(m, "/row/metadata")),
        F.when(m.isNotNull() & ~m["trace_id"].eqNullSafe(F.col("trace")), error("TRACE_MISMATCH", "/row/metadata/trace_id")),
    )
    offers = F.coalesce(m["offers"], empty(OFFER))
    body = fields.select(
        "place", (~F.col("given")).alias("metadata_absent"), found.alias("error"), m["accept"].alias("accept"), m["agent"].alias("agent"),
        sorted_by_json(F.coalesce(m["attachments"], empty(ATTACHMENT)), lambda r: F.array(r["format"], r["digest"])).alias("attachments"),
        "native_span", "native_trace",
        F.when(F.size(offers) <= 1, offers).otherwise(F.array_sort(F.transform(offers, lambda o: F.struct(o["id"].alias("k"), o.alias("o")))).getField("o")).alias("offers"),
        sorted_by_json(F.coalesce("parents", empty(PARENT)), lambda p: F.array(p["kind"], p["value"])).alias("parents"),
        m["policy"].alias("policy"), "profile", "record", "source", "trace", F.lit(1).alias("v"), F.lit(workspace).alias("workspace"),
    )
    steps = settled(body).withColumn("hash", F.when(F.col("error").isNull(), digest(STEP, F.struct(*BODY))))
    steps = steps.withColumn("warnings", F.when(F.col("error").isNull() & F.col("metadata_absent"), F.array(F.lit("METADATA_ABSENT"))).otherwise(F.array().cast("array<string>")))
    return steps.drop("metadata_absent")


def clean(normalized: DataFrame) -> DataFrame:
    """Distinct steps of rows without error."""
    return normalized.where(F.col("error").isNull()).select(*BODY, "hash").dropDuplicates(["hash"])


def first_error(normalized: DataFrame) -> DataFrame:
    """One row (code, field, place): the error of the earliest row that has one; no row if all are clean."""
    worst = normalized.where(F.col("error").isNotNull()).agg(F.min_by("error", "place").alias("e"), F.min("place").alias("place"))
    return worst.where(F.col("place").isNotNull()).select(F.col("e.code").alias("code"), F.col("e.field").alias("field"), "place")
