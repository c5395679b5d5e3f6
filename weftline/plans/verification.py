"""Proof bundles: assembly, verdicts from their phases, readable reports; many bundles in one plan.

The phases themselves are table operations: inventories and attachments (``inventory``), graphs
(``graph_faults``), paths (``operators.path``), chains (``operators.trust``). Here the first phase
that fails decides, as the format orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import BUNDLE, GRAPH, canonical, digest_text, sha256_text, short
from weftline.storage import materialize

#: Phases that a bundle can fail outright, in order, with the reason each gives (fixed values of the data format).
PHASES = {"inventory": "INVENTORY_MISMATCH", "scope": "INVENTORY_MISMATCH", "graph": "GRAPH_MISMATCH", "path": "PATH_MISMATCH", "binding": "AUDIT_BINDING_MISMATCH"}
#: Phases after which the path that was recomputed counts.
KNOWN_PATH = ("path", "binding")
#: Columns that say the same of every bundle.
FIXED = {"disclosure": "NORMALIZED_ONLY", "semantics": "NOT_VERIFIED", "current_authority": "UNKNOWN"}

BUNDLE_BYTES = 64 << 20


def assemble(heads: DataFrame, envelopes: DataFrame, refs: DataFrame, artifacts: DataFrame, format: str, limit: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle, hash, document, bytes, handoff, error) of each bundle: one canonical JSON document and its summary.

    ``heads``: bundle, workspace, trace, revision, attachment_policy, and as canonical JSON graph, path_request,
    path and action. ``envelopes``: bundle, kind (step, origin or audit), hash, n (an audit entry's position), json.
    ``refs``: bundle, digest, bytes of attachments referred to; of repeated digests the first by ``place``, if there
    is the column, counts, else the least bytes. ``artifacts``: bundle, digest, json; left out where the policy isn't
    INCLUDE. A bundle is one document by the format; one above ``limit`` bytes is BUNDLE_LIMIT, and one that refers to
    what isn't there under INCLUDE is ARTIFACT_UNAVAILABLE, without document and handoff. Parts are summed before any is
    gathered: of a bundle that doesn't fit only the inventory is, for its hash.
    """
    place = F.when(F.col("kind") == "step", F.col("hash")).when(F.col("kind") == "audit", F.lpad(F.col("n").cast("string"), 20, "0")).otherwise(F.col("json"))
    item = lambda kind, digest, size: F.struct(kind.alias("kind"), digest.alias("digest"), size.alias("bytes"))
    sealed = envelopes.select("bundle", "kind", place.alias("place"), "json", item(F.col("kind"), sha256_text("json"), F.octet_length("json").cast("string")).alias("item"))
    own = refs.groupBy("bundle", "digest").agg((F.min_by("bytes", "place") if "place" in refs.columns else F.min("bytes")).alias("bytes"))
    listed = own.select("bundle", F.lit("listed").alias("kind"), F.lit("").alias("place"), F.lit(None).cast("string").alias("json"), item(F.lit("attachment"), F.col("digest"), F.col("bytes")).alias("item"))
    included = heads.where("attachment_policy = 'INCLUDE'").select("bundle")
    files = artifacts.join(included, "bundle", "left_semi").select("bundle", F.lit("attachment").alias("kind"), F.col("digest").alias("place"), "json", F.lit(None).cast("struct<kind:string,digest:string,bytes:string>").alias("item"))
    parts = sealed.unionByName(listed).unionByName(files)
    lacking = own.join(included, "bundle", "left_semi").join(artifacts.select("bundle", "digest"), ["bundle", "digest"], "left_anti").select("bundle").distinct().withColumn("lacking", F.lit(True))
    kinds = ("attachment", "audit", "origin", "step")
    of = lambda kind: F.when(F.col("kind") == kind, F.octet_length("json"))
    # an array is its elements and the commas between them
    inner = sum((F.coalesce(F.sum(of(k)), F.lit(0)) + F.greatest(F.count(of(k)) - 1, F.lit(0)) for k in kinds), F.lit(0))
    items = F.transform(F.array_sort(F.collect_list("item")), lambda i: F.struct(i["bytes"].alias("bytes"), i["digest"].alias("digest"), i["kind"].alias("kind")))
    sums = parts.groupBy("bundle").agg(canonical(items).alias("items"), inner.alias("inner"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    some = lambda c: F.coalesce(c, F.lit("[]"))

    def document(**members: Column) -> Column:
        return F.concat(*(x for i, (k, v) in enumerate(members.items()) for x in (F.lit(("," if i else "{") + f'"{k}":'), v)), F.lit("}"))

    def bundle(**arrays: Column) -> Column:
        array = lambda k: arrays.get(k, F.lit("[]"))
        return document(attachments=array("attachment"), audit=array("audit"), body=F.col("body"), hash=text(F.col("hash")), origins=array("origin"), steps=array("step"))

    disclosure = F.lit(f'"{FIXED["disclosure"]}"')
    body = document(
        attachment_policy=text(F.col("attachment_policy")), disclosure=disclosure, format=F.lit(f'"{format}"'), graph=F.col("graph"), inventory=some("items"), path=F.col("path"), path_request=F.col("path_request"),
        revision=text(F.col("revision")), trace=text(F.col("trace")), trust_required=F.lit("true"), v=F.lit("1"), workspace=text(F.col("workspace")),
    )
    bodies = heads.join(sums, "bundle", "left").join(lacking, "bundle", "left").withColumn("body", body).withColumn("hash", digest_text(BUNDLE, "body"))
    size = (F.octet_length(bundle()) + F.coalesce("inner", F.lit(0))).cast("long")
    error = F.when(F.col("lacking"), "ARTIFACT_UNAVAILABLE").when(F.col("bytes") > limit, "BUNDLE_LIMIT")
    sized = materialize(bodies.withColumn("bytes", F.when(F.col("lacking").isNull(), size)).withColumn("error", error), "bodies")
    ordered = [F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "json")))), lambda x: x["json"]), ","), F.lit("]")).alias(f"all_{k}") for k in kinds]
    arrays = parts.join(sized.where("error is null").select("bundle"), "bundle", "left_semi").groupBy("bundle").agg(*ordered)
    handoff = document(
        action=F.col("action"), bundle=text(F.col("hash")), disclosure=disclosure, format=F.lit(f'"{format}"'), graph=text(digest_text(GRAPH, "graph")), kind=F.lit('"action-lineage"'),
        semantics=F.lit(f'"{FIXED["semantics"]}"'), trace=text(F.col("trace")), v=F.lit("1"),
    )
    fits = F.col("error").isNull()
    made = bundle(**{k: some(f"all_{k}") for k in kinds})
    whole = sized.join(arrays, "bundle", "left")
    return whole.select("bundle", F.when(F.col("lacking").isNull(), F.col("hash")).alias("hash"), F.when(fits, made).alias("document"), "bytes", F.when(fits, handoff).alias("handoff"), "error")


def audit_bindings(log: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle, bound): whether the last entry of a bundle's audit part binds its graph.

    ``log``: bundle, workspace, n, data (canonical JSON); ``bundles``: bundle, workspace, trace,
    revision, graph. Revision 0 is bound by the entry that creates the trace, others by the commit. All
    entries must be of the bundle's workspace; a bundle without entries is not bound.
    """
    last = log.groupBy("bundle").agg(F.max_by("data", "n").alias("data"), F.min("workspace").alias("low"), F.max("workspace").alias("high"))
    at = lambda name: F.get_json_object("data", f"$.{name}")
    first = F.col("revision") == "0"
    kind = F.when(first, "TraceCreated").otherwise("ImportCommitted")
    bound = (at("kind") == kind) & (at("trace") == F.col("trace")) & (at("graph") == F.col("graph")) & (first | (at("revision") == F.col("revision"))) & (F.col("low") == F.col("workspace")) & (F.col("high") == F.col("workspace"))
    return bundles.join(last, "bundle", "left").select("bundle", F.coalesce(bound, F.lit(False)).alias("bound"))


def unneeded_origins(origins: DataFrame, steps: DataFrame) -> DataFrame:
    """(bundle, hash) of attestations that a bundle has no need of: none of their stream at or after them attests one of its steps."""
    own = steps.select("bundle", F.col("hash").alias("step"), F.lit(True).alias("own")).distinct()
    marked = origins.join(own, ["bundle", "step"], "left")
    last = marked.where("own").groupBy("bundle", "source", "stream").agg(F.max(F.col("seq").cast("long")).alias("last"))
    return origins.join(last, ["bundle", "source", "stream"], "left").where(F.col("last").isNull() | (F.col("seq").cast("long") > F.col("last"))).select("bundle", "hash")


def summarize(bundles: DataFrame, faults: dict[str, DataFrame], chains: dict[str, DataFrame]) -> DataFrame:
    """What ``verdicts`` takes, of bundles (bundle, structural).

    ``faults``: for each phase a table with a column bundle, the bundles that fail it (repeats count once); a
    phase that isn't named fails none. ``chains``: ``chain_verdict``'s result for audit and origin, with
    bundle for trace; a bundle that isn't there has no chain, which is unsigned and for audit incomplete.
    """
    out = bundles.select("bundle", "structural")
    for phase in PHASES:
        if phase in faults:
            out = out.join(faults[phase].select("bundle").distinct().withColumn(phase, F.lit(True)), "bundle", "left")
        else:
            out = out.withColumn(phase, F.lit(None).cast("boolean"))
    for role, lone in (("audit", ("INCOMPLETE", "AUDIT_GAP")), ("origin", ("UNSIGNED", "ORIGIN_UNSIGNED"))):
        out = out.join(chains[role].select("bundle", *(F.col(c).alias(f"{role}_{c}") for c in ("integrity", "verdict", "reasons"))), "bundle", "left")
        none = F.col(f"{role}_integrity").isNull()
        out = out.withColumn(f"{role}_verdict", F.coalesce(f"{role}_verdict", F.lit(lone[0]))).withColumn(f"{role}_reasons", F.when(none, F.array(F.lit(lone[1]))).otherwise(F.col(f"{role}_reasons"))).withColumn(f"{role}_integrity", F.coalesce(f"{role}_integrity", F.lit("VALID")))
    return out


def verdicts(summary: DataFrame) -> DataFrame:
    """Verification of each bundle: integrity, structural, origin, audit, the fixed columns, reasons in order, exit code.

    ``summary`` has bundle, a boolean column for each of ``PHASES`` (true where it failed; null: it
    didn't), ``structural`` of the recomputed path (null where it couldn't be), and integrity, verdict and
    reasons of both chains as ``chain_verdict`` gives them, prefixed by ``audit_`` and ``origin_``.
    """
    failed = F.coalesce(*(F.when(F.col(name), F.lit(name)) for name in PHASES))
    reason = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))[failed]
    early = failed.isNotNull()
    forged = ~early & (F.col("audit_integrity") == "INVALID")
    stops = early | forged
    path = F.coalesce("structural", F.lit("INCOMPLETE"))
    structural = F.when(early & ~failed.isin(*KNOWN_PATH), "INCOMPLETE").otherwise(path)
    audit = F.when(F.col("audit_verdict") == "CONFLICTED", "UNTRUSTED").when(F.col("audit_verdict") == "UNSIGNED", "INCOMPLETE").otherwise(F.col("audit_verdict"))
    invalid = stops | (F.col("origin_integrity") == "INVALID")
    none = F.array().cast("array<string>")
    of = lambda role: F.coalesce(f"{role}_reasons", none)
    reasons = F.when(early, F.array(reason)).when(forged, of("audit")).when(invalid, of("origin")).otherwise(F.concat(of("audit"), of("origin")))
    out = summary.select(
        "bundle", F.when(invalid, "INVALID").otherwise("VALID").alias("integrity"), structural.alias("structural"), F.when(stops, "UNTRUSTED").otherwise(F.col("origin_verdict")).alias("origin"), F.when(stops, "UNTRUSTED").otherwise(audit).alias("audit"),
        *(F.lit(v).alias(k) for k, v in FIXED.items()), F.array_sort(F.array_distinct(reasons)).alias("reasons"),
    )
    return out.withColumn("exit_code", exit_code())


def exit_code() -> Column:
    """3 for invalid bundles, 5 for conflicts, 4 for whatever isn't complete and trusted, else 0."""
    whole = (F.col("origin") == "TRUSTED_AT_PIN") & (F.col("audit") == "TRUSTED_AT_PIN") & (F.col("structural") == "COMPLETE_RELATIVE")
    return F.when(F.col("integrity") == "INVALID", 3).when((F.col("structural") == "CONFLICTED") | (F.col("origin") == "CONFLICTED"), 5).when(whole, 0).otherwise(4)


def verdict_text() -> Column:
    """A verification as lines of text."""
    notes = {"disclosure": " (normalized metadata only — no raw provider payloads)", "semantics": " (structural evidence, never real-world truth)", "current_authority": " (no live authority)"}
    lines = [F.concat(F.lit(f"{name}: "), name, F.lit(notes.get(name, ""))) for name in ("integrity", "structural", "origin", "audit", *FIXED)]
    return F.concat_ws("\n", *lines, F.concat(F.lit("reasons: "), F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")).otherwise("none")))


def _wide(text: Column, width: int) -> Column:
    """Padded, never cut."""
    return F.rpad(text, F.greatest(F.char_length(text), F.lit(width)), F.lit(" "))


#: First line of a path table (fixed value of the data format).
HEADING = "STEP          RECORD                 AGENT         POLICY    EDGES            EVIDENCE"


def path_lines(nodes: DataFrame, edges: DataFrame, attested: DataFrame) -> DataFrame:
    """(request, position, line): a line for each step of each path.

    ``nodes``: request, position, hash, source, record, agent and policy as steps have them; ``edges``:
    request, child, kind, hash; ``attested``: request, step. A step without an attestation is only claimed.
    """
    into = edges.groupBy("request", F.col("child").alias("hash")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "kind"))), lambda e: e["kind"]), "+").alias("kinds"))
    signed = attested.select("request", F.col("step").alias("hash")).distinct().withColumn("signed", F.lit(True))
    agent = F.coalesce(F.concat_ws("/", "agent.namespace", "agent.subject"), F.lit("-"))
    parts = [
        F.concat(short("hash"), F.lit(" ")), _wide(F.concat(F.substring("source", 5, 8), F.lit(":"), "record"), 22), _wide(F.when(F.col("agent").isNull(), "-").otherwise(agent), 13),
        _wide(F.coalesce("policy.decision", F.lit("UNKNOWN")), 9), _wide(F.coalesce("kinds", F.lit("-")), 16), F.when(F.col("signed"), "SIGNED").otherwise("CLAIMED"),
    ]
    return nodes.join(into, ["request", "hash"], "left").join(signed, ["request", "hash"], "left").select("request", "position", F.concat_ws(" ", *parts).alias("line"))


def path_footers(answers: DataFrame, gaps: DataFrame) -> DataFrame:
    """(request, line): the last line of each path; ``answers``: request, trace, revision, graph, structural, evidence, ``gaps``: request, code."""
    forked = F.col("code") == "ORIGIN_FORK"
    counted = gaps.groupBy("request").agg(F.count_if(~forked).alias("missing"), F.count_if(forked).alias("forks"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    line = F.concat(F.lit("trace "), "trace", F.lit(" revision "), "revision", F.lit(" graph "), short("graph"), F.lit(" — "), number("missing"), F.lit(" missing reference(s), "), number("forks"), F.lit(" fork(s), relative to disclosed exports ["), "structural", F.lit("/"), "evidence", F.lit("]"))
    return answers.join(counted, "request", "left").select("request", line.alias("line"))
