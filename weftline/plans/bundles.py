"""Proof bundles read back: documents shredded to keyed tables, and verified by recomputing all they say.

A document is parsed once into VARIANT. Its arrays become rows of one table (``Parts``), each checked by the rule of its
place; digests, inventories, scopes, graphs, paths and chains of all bundles are then recomputed by set operations
keyed by bundle, and compared as canonical text. No loop over bundles, nothing of them reaches the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.functions.canonical import AUDIT, BUNDLE, GRAPH, ORIGIN, STEP, canonical, digest_text, sha256_text
from weftline.functions.strict import core_numbers, json_fault
from weftline.functions.types import ATTACHMENT, BODY, ORIGIN_BODY
from weftline.operators import streams, trust
from weftline.operators.path import Paths, ordered, paths
from weftline.plans import inventory, verification
from weftline.plans.reduction import manifests, reduce_steps, rename_traces
from weftline.storage import materialize

FILE_BYTES = 68 << 20
#: The domain tag of each array of envelopes.
TAGS = {"steps": STEP, "origins": ORIGIN, "audit": AUDIT}
NAMES = {"steps": "step", "origins": "origin", "audit": "audit", "attachments": "attachment"}
ORDER = {name: i for i, name in enumerate(rules.BUNDLE_PARTS)}


class Shredded(NamedTuple):
    heads: DataFrame  # bundle, v (the document), error: of all documents
    parts: DataFrame  # bundle, section, place, env (an element of an array), json (its canonical text): of documents without error
    errors: DataFrame  # bundle, code, field


def read_documents(spark: SparkSession, path: str, limit: int = FILE_BYTES) -> DataFrame:
    """(bundle, document, error): files as documents, named by their paths.

    A file above ``limit`` bytes is FILE_LIMIT, without being read; one with a byte order mark or broken UTF-8 is
    JSON_INVALID. Either has no document. Spark's reader passes over files without content: they have no row.
    """
    files = spark.read.format("binaryFile").load(path)
    bad = ~F.is_valid_utf8(F.col("content").cast("string")) | F.startswith(F.col("content"), F.lit(b"\xef\xbb\xbf"))
    error = F.when(bad, "JSON_INVALID")
    read = files.where(F.col("length") <= limit).select(F.col("path").alias("bundle"), F.when(~bad, F.col("content").cast("string")).alias("document"), error.alias("error"))
    return read.unionByName(files.where(F.col("length") > limit).select(F.col("path").alias("bundle"), F.lit(None).cast("string").alias("document"), F.lit("FILE_LIMIT").alias("error")))


def write_documents(assembled: DataFrame, path: str) -> None:
    """A folder with a file for each bundle that has a document, ``bundle=<hash>``; it must not be there yet."""
    assembled.where("document is not null").select("hash", F.col("document").alias("value")).withColumnRenamed("hash", "bundle").repartition("bundle").write.mode("error").partitionBy("bundle").text(path)


def shred(documents: DataFrame, format: str) -> Shredded:
    """Documents (bundle, document; an ``error``, if there is the column, is kept) as tables, and the first error of each.

    Text that is no strict JSON is JSON_INVALID, numbers beyond the format's SCHEMA_INVALID. Of what a rule refuses
    the document's own members come first, then elements of its arrays, in order. A null document is JSON_INVALID.
    """
    given = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    text = F.coalesce("document", F.lit(""))
    parsed = documents.select("bundle", F.try_parse_json(text).alias("v"), F.when(given.isNotNull(), F.struct(given.alias("code"), F.lit("").alias("field"))).when(json_fault(text).isNotNull(), F.struct(F.lit("JSON_INVALID").alias("code"), F.lit("").alias("field"))).when(~core_numbers(text), F.struct(F.lit("SCHEMA_INVALID").alias("code"), F.lit("").alias("field"))).alias("odd"))
    heads = materialize(parsed.select("bundle", "v", F.coalesce("odd", rules.bundle(format).error("v", "/bundle")).alias("error")), "documents")

    def listed(name: str) -> Column:
        return F.transform(F.try_variant_get("v", f"$.{name}", "array<variant>"), lambda x, i: F.struct(F.lit(name).alias("section"), i.alias("place"), x.alias("env")))

    rows = heads.where("error is null").select("bundle", F.explode(F.concat(*map(listed, rules.BUNDLE_PARTS))).alias("p")).select("bundle", "p.*")
    at = F.concat(F.lit("/bundle/"), F.replace("section", F.lit("."), F.lit("/")), F.lit("/"), F.col("place").cast("string"))
    by_rule: dict = {}
    for name, rule in rules.BUNDLE_PARTS.items():
        by_rule.setdefault(id(rule), (rule, []))[1].append(name)
    error = F.coalesce(*(F.when(F.col("section").isin(*names), rule.error("env", at)) for rule, names in by_rule.values()))
    order = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("section")]
    parts = materialize(rows.select("bundle", "section", "place", "env", F.to_json("env").alias("json"), error.alias("error")), "parts")
    worst = parts.where("error is not null").groupBy("bundle").agg(F.min_by("error", F.struct(order.alias("o"), "place")).alias("error"))
    errors = materialize(heads.where("error is not null").select("bundle", "error").unionByName(worst).select("bundle", "error.code", "error.field"), "errors")
    return Shredded(heads, parts.join(errors, "bundle", "left_anti").drop("error"), errors)


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def bodies(found: Shredded) -> DataFrame:
    """(bundle, workspace, trace, revision, graph, path, ...): what each good document's body says, parts of it as canonical text."""
    text = lambda path: F.to_json(_at(path, "variant"))
    request = {"source": "action.source", "record": "action.record"}
    return found.heads.where("error is null").join(found.errors, "bundle", "left_anti").select(
        "bundle", *(_at(f"body.{c}").alias(c) for c in ("workspace", "trace", "revision", "attachment_policy")), text("body.graph").alias("graph"), text("body.path").alias("path"), text("body").alias("body"), _at("hash").alias("hash"),
        _at("body.path_request.trace").alias("request_trace"), _at("body.path_request.revision").alias("request_revision"), *(_at(f"body.path_request.{p}").alias(c) for c, p in request.items()),
        *(_at(f"body.path_request.{c}", "int").alias(c) for c in ("max_depth", "max_nodes")),
    )


def _members(parts: DataFrame, section: str, names: dict[str, str], *more: str) -> DataFrame:
    """Envelopes of a section as columns of their body, and of themselves (``more``)."""
    return parts.where(F.col("section") == section).select(
        F.col("bundle").alias("trace"), "place", "json", *(F.try_variant_get("env", f"$.body.{c}", t).alias(c if c != "trace" else "named") for c, t in names.items()), *(F.try_variant_get("env", f"$.{c}", "string").alias(c) for c in more),
    )


def inventory_faults(found: Shredded, heads: DataFrame) -> DataFrame:
    """(bundle, digest, fault): where a bundle's digests, inventory and attachments don't agree with what it holds."""
    parts = found.parts
    tag = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))[F.col("section")]
    sealed = parts.where(F.col("section").isin(*TAGS)).select("bundle", "section", "json", sha256_text("json").alias("digest"), F.octet_length("json").cast("string").alias("bytes"), F.to_json(F.try_variant_get("env", "$.body", "variant")).alias("body"), F.try_variant_get("env", "$.hash", "string").alias("hash"), tag.alias("tag"))
    own = F.sha2(F.concat(F.encode("tag", "utf-8"), F.lit(b"\0"), F.encode("body", "utf-8")), 256)
    wrong = sealed.where(own != F.col("hash")).select("bundle", "digest", F.lit("HASH").alias("fault"))
    bundle = heads.where(digest_text(BUNDLE, "body") != F.col("hash")).select("bundle", F.col("hash").alias("digest"), F.lit("BUNDLE").alias("fault"))
    # of repeated references the last in the document counts
    steps = parts.where("section = 'steps'").select("bundle", "place", F.posexplode(F.try_variant_get("env", "$.body.attachments", f"array<{ATTACHMENT}>")).alias("i", "a"))
    refs = steps.groupBy(F.col("bundle").alias("trace"), F.col("a.digest").alias("digest")).agg(F.max_by("a", F.struct("place", "i")).alias("a")).select("trace", "digest", "a.format", "a.bytes")
    files = parts.where("section = 'attachments'").select(F.col("bundle").alias("trace"), *(F.try_variant_get("env", f"$.{c}", "string").alias(c) for c in ("digest", "format", "bytes", "content")))
    policy = heads.select(F.col("bundle").alias("trace"), (F.col("attachment_policy") == "INCLUDE").alias("include"))
    faults = [
        inventory.attachment_faults(refs.join(policy.where(w), "trace", "left_semi"), files.join(policy.where(w), "trace", "left_semi"), include) for w, include in (("include", True), ("not include", False))
    ]
    twice = files.groupBy("trace", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("trace").alias("bundle"), "digest", F.lit("TWICE").alias("fault"))
    actual = sealed.select("bundle", F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))[F.col("section")].alias("kind"), "digest", "bytes").unionByName(refs.select(F.col("trace").alias("bundle"), F.lit("attachment").alias("kind"), "digest", "bytes"))
    listed = parts.where("section = 'body.inventory'").select("bundle", *(F.try_variant_get("env", f"$.{c}", "string").alias(c) for c in ("kind", "digest", "bytes")))
    out = wrong.unionByName(bundle).unionByName(twice).unionByName(inventory.inventory_diff(listed, actual).select("bundle", "digest", "fault"))
    for f in faults:
        out = out.unionByName(f.withColumnRenamed("trace", "bundle"))
    return out


def path_documents(found: Paths, steps: DataFrame, origins: DataFrame, heads: DataFrame, graphs: DataFrame) -> DataFrame:
    """(bundle, path, verdict): canonical JSON of each answered request, as the format has it.

    ``found`` is ``paths``'s result with the bundle for request and trace; ``steps``, ``origins`` have their envelopes'
    ``json``, edges the ``named`` trace; ``heads``: bundle, request_trace, request_revision; ``graphs``: trace, graph. Steps stand parents first, origins by their text, edges by hash.
    """
    answers = found.answers.where("error is null").select(F.col("request").alias("trace"), "action", "verdict")
    listed = lambda df, place, name, what="json": df.groupBy("trace").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(what).alias("json")))), lambda x: x["json"]), ","), F.lit("]")).alias(name))
    nodes = ordered(found).withColumnRenamed("request", "trace")
    own = steps.dropDuplicates(["trace", "hash"]).select("trace", F.col("hash").alias("node"), "json")
    reached = nodes.select("trace", F.col("node").alias("hash"))
    edge = F.struct(F.struct("child", "delegation", "kind", "parent", "scope", F.col("named").alias("trace"), "v").alias("body"), "hash")
    gap = F.struct("code", "related", "subject")
    parts = [
        listed(nodes.join(own, ["trace", "node"]), F.col("position"), "steps"),
        listed(streams.pinned(origins, reached), F.col("json"), "origins"),
        listed(found.edges.withColumn("json", canonical(edge)), F.col("hash"), "edges"),
        listed(found.gaps.withColumn("json", canonical(gap)), F.struct("code", "subject", canonical("related").alias("r")), "gaps"),
    ]
    out = answers.join(heads.select(F.col("bundle").alias("trace"), F.col("request_trace"), F.col("request_revision")), "trace").join(graphs, "trace")
    for p in parts:
        out = out.join(p, "trace", "left")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    some = lambda c: F.coalesce(c, F.lit("[]"))
    members = {
        "action": quoted("action"), "disclosure": F.lit('"NORMALIZED_ONLY"'), "edges": some("edges"), "evidence": F.lit('"CLAIMED"'), "gaps": some("gaps"), "graph": quoted("graph"), "origins": some("origins"),
        "revision": quoted("request_revision"), "steps": some("steps"), "structural": quoted("verdict"), "trace": quoted("request_trace"),
    }
    text = F.concat(*(x for i, (k, v) in enumerate(members.items()) for x in (F.lit(("," if i else "{") + f'"{k}":'), v)), F.lit("}"))
    return out.select(F.col("trace").alias("bundle"), text.alias("path"), "verdict")


def verify(documents: DataFrame, workspace: str, keys: DataFrame, heads: DataFrame, format: str) -> DataFrame:
    """(bundle, error, field, and the columns of ``verification.verdicts``) of each document.

    A document that isn't a bundle of the format has an error and field, and no verdict; so has a bundle of another
    workspace than the trust package's (``workspace``, ``keys``, ``heads``): TRUST_INVALID. Phases follow the format:
    inventory and digests, scope, graph, path, audit binding, audit chain, attestations. Each is recomputed for all
    bundles at once; the first that fails decides.
    """
    found = shred(documents, format)
    said = materialize(bodies(found), "bodies")
    named = said.select(F.col("bundle").alias("trace"), F.col("workspace").alias("of"), F.col("trace").alias("of_trace"))
    steps = materialize(_members(found.parts, "steps", BODY, "hash"), "steps")
    origins = materialize(_members(found.parts, "origins", dict.fromkeys(ORIGIN_BODY, "string"), "hash", "signature"), "origins")
    log = _members(found.parts, "audit", {"workspace": "string", "seq": "string", "prev": "string", "key": "string", "data": "variant"}, "hash", "signature")
    log = materialize(log.withColumn("data", F.to_json("data")), "log")
    # what is of another workspace or trace, and attestations that nothing needs
    foreign = steps.join(named, "trace").where("workspace <> of or named <> of_trace").select("trace").unionByName(origins.join(named, "trace").where("workspace <> of").select("trace"))
    needless = verification.unneeded_origins(origins.withColumnRenamed("trace", "bundle"), steps.select(F.col("trace").alias("bundle"), "hash"))
    # graphs
    names = said.select(F.col("bundle").alias("trace"), "workspace", F.col("trace").alias("named"))
    reduced = rename_traces(reduce_steps(steps.drop("named", "place", "json"), origins), names)
    edges, gaps = materialize(reduced.edges, "edges"), materialize(reduced.gaps, "gaps")
    made = materialize(manifests(steps, reduced._replace(edges=edges, gaps=gaps), origins, names), "manifests")
    other = said.join(made.select(F.col("trace").alias("bundle"), "manifest"), "bundle", "left").where("not (manifest <=> graph)").select("bundle")
    # paths
    asked = said.select(F.col("bundle").alias("request"), F.col("bundle").alias("trace"), "source", "record", "max_depth", "max_nodes")
    answered = paths(steps, edges, gaps, asked)
    written = materialize(path_documents(answered, steps, origins, said, made.select("trace", "graph")), "paths")
    compared = said.join(written.select("bundle", F.col("path").alias("made"), "verdict"), "bundle", "left")
    astray = compared.where("not (made <=> path) or request_trace <> trace or request_revision <> revision").select("bundle")
    # audit and attestations
    graph = said.withColumn("graph", digest_text(GRAPH, "graph"))
    bound = verification.audit_bindings(log.select(F.col("trace").alias("bundle"), "workspace", F.struct(F.col("seq").cast("long").alias("seq"), "place").alias("n"), "data"), graph)
    null = F.lit(None).cast("string")
    signed = ("trace", "source", "stream", "seq", "prev", "key", "hash", "signature", "step")
    chain = log.withColumns({"source": null, "stream": null, "step": null}).select(*signed)
    audit = trust.chain_verdict("audit", chain, said.select(F.col("bundle").alias("trace"), null.alias("step")), keys, heads)
    needed = answered.nodes.select("trace", F.col("node").alias("step"))
    attested = trust.chain_verdict("origin", origins.select(*signed), said.select(F.col("bundle").alias("trace"), null.alias("step")).unionByName(needed), keys, heads)
    faults = {
        "inventory": inventory_faults(found, said).select("bundle"), "scope": foreign.withColumnRenamed("trace", "bundle").unionByName(needless.select("bundle")), "graph": other, "path": astray, "binding": bound.where("not bound").select("bundle"),
    }
    chains = {"audit": audit.withColumnRenamed("trace", "bundle"), "origin": attested.withColumnRenamed("trace", "bundle")}
    judged = verification.verdicts(verification.summarize(compared.where(F.col("workspace") == workspace).select("bundle", F.col("verdict").alias("structural")), faults, chains))
    stranger = said.where(F.col("workspace") != workspace).select("bundle", F.lit("TRUST_INVALID").alias("error"), F.lit("/trust/workspace").alias("field"))
    failed = found.errors.select("bundle", F.col("code").alias("error"), "field").unionByName(stranger)
    return judged.unionByName(failed, allowMissingColumns=True)
