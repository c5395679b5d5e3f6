"""Registered queries of the lineage engine and their SQL.

The tables play vendor exports: turns of a conversation are runs of a trace, events of a
user are spans, orders offer work that line items accept, and events are also links of
attestation streams. All queries run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.canonical import ZERO, base64url, canonical, digest_text, escape_pointer, from_base64url, sha256_text, short
from weftline.operators import graph, resolve, streams, trust
from weftline.operators.path import Paths, paths
from weftline.functions.strict import json_fault
from weftline.functions.types import OFFER
from weftline.plans import inventory, ledger, verification
from weftline.plans.reduction import Reduced, manifests, reduce_steps
from weftline.sources.vendor import clean, normalize
from weftline.storage import materialize

KEY = "lineage"
WORKSPACE = "vlw_" + "w" * 21
RUNS, OBSERVATIONS, SPANS = ("vls_" + c * 21 for c in "abc")
SOURCES = [(RUNS, "langsmith-runs/1"), (OBSERVATIONS, "langfuse-observations/1"), (SPANS, "braintrust-spans/1")]
SCOPE = "1" * 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a table whose files give fewer tasks than there are cores, dealt to all cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _trace(c: str) -> Column:
    return F.concat(F.lit("vlt_"), F.lpad(F.col(c).cast("string"), 21, "0"))


def _rows(df: DataFrame, source: str, trace: Column, place: Column, **members: Column) -> DataFrame:
    raw = canonical(F.struct(*(v.alias(k) for k, v in members.items())))
    return _spread(df.select(F.lit(source).alias("source"), place.cast("string").alias("place"), raw.alias("raw"), trace.alias("trace")))


def _normalized(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return normalize(rows, spark.createDataFrame(SOURCES, "id string, profile string"), KEY, WORKSPACE)


def _run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    parent = F.when(F.col("turn") > 0, name(1))
    return _rows(_table(spark, sf_dir, "conversations"), RUNS, _trace("conv_id"), name(0), id=name(0), parent_run_id=parent, trace_id=F.col("conv_id").cast("string"))


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).when(F.col("event_type") == "click", F.array(F.lit("view"))).otherwise(F.array(F.lit("click")))
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return _rows(_table(spark, sf_dir, "events"), SPANS, _trace("user_id"), event, id=event, root_span_id=user, span_id=F.col("event_type"), span_parents=before)


def _run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_normalized(spark, _run_rows(spark, sf_dir)))


def lineage_run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as steps, by the first profile."""
    return _run_steps(spark, sf_dir).select("trace", "record", "hash")


def lineage_span_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as steps, by the third profile."""
    return clean(_normalized(spark, _span_rows(spark, sf_dir))).select("trace", "record", "hash")


def _lineage(trace: Column, **given: Column) -> Column:
    text = "cast(null as {})".format
    kinds = {
        "accept": "struct<id:string,parent:struct<hash:string,record:string,source:string>,scope:string>", "agent": "struct<namespace:string,principal:string,subject:string>",
        "policy": "struct<decision:string,digest:string,version:string>",
    }
    values = {k: F.expr(text(v)) for k, v in kinds.items()} | {"attachments": F.expr("cast(array() as array<string>)"), "offers": F.expr("cast(array() as array<string>)"), "trace_id": trace, "v": F.lit(1)} | given
    return F.struct(F.struct(*(values[k].alias(k) for k in sorted(values))).alias(KEY))


def _agent(subject: Column) -> Column:
    return F.struct(F.lit("lab").alias("namespace"), F.lit(None).cast("string").alias("principal"), subject.alias("subject"))


def _order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a run that offers its work to the warehouse."""
    key, trace = F.col("o_orderkey").cast("string"), _trace("o_custkey")
    offer = F.struct(_agent(F.lit("warehouse")).alias("child_agent"), F.lit(OBSERVATIONS).alias("child_source"), F.concat(F.lit("vld_"), F.lpad(key, 21, "0")).alias("id"), F.lit(SCOPE).alias("scope"))
    meta = F.struct(_lineage(trace, agent=_agent(F.lit("shop")), offers=F.array(offer)).alias("metadata"))
    return clean(_normalized(spark, _rows(_table(spark, sf_dir, "orders"), RUNS, trace, key, extra=meta, id=key, parent_run_id=F.lit(None).cast("string"), trace_id=F.col("o_custkey").cast("string"))))


def _line_steps(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """A line item is an observation that accepts its order's work, naming the order's step."""
    owner = orders.select("trace", F.col("record").cast("long").alias("l_orderkey"), F.col("hash").alias("parent_hash"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(owner, "l_orderkey")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    parent = F.struct(F.col("parent_hash").alias("hash"), F.col("l_orderkey").cast("string").alias("record"), F.lit(RUNS).alias("source"))
    accept = F.struct(F.concat(F.lit("vld_"), F.lpad(F.col("l_orderkey").cast("string"), 21, "0")).alias("id"), parent.alias("parent"), F.lit(SCOPE).alias("scope"))
    meta = _lineage(F.col("trace"), agent=_agent(F.lit("warehouse")), accept=accept)
    return clean(_normalized(spark, _rows(lines, OBSERVATIONS, F.col("trace"), key, id=key, metadata=meta, parentObservationId=F.lit(None).cast("string"), traceId=F.col("l_orderkey").cast("string"))))


def lineage_delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each order's offer: one acceptance is an edge, none is a gap, several are reuse."""
    orders = materialize(_order_steps(spark, sf_dir), "orders")
    steps = materialize(orders.unionByName(_line_steps(spark, sf_dir, orders)), "steps")
    return resolve.delegation_outcomes(steps).select("trace", "delegation", "outcome", F.coalesce(F.size("related"), F.lit(0)).cast("long").alias("n_related"))


def lineage_native_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent edges between runs, with their hashes."""
    steps = materialize(_run_steps(spark, sf_dir), "steps")
    edges, _ = resolve.native_parents(steps, resolve.conflicts(steps))
    return edges.select("trace", "parent", "child", "hash")


def lineage_parent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose parent is missing or ambiguous."""
    steps = materialize(clean(_normalized(spark, _span_rows(spark, sf_dir))), "steps")
    number = lambda hashes: F.struct(F.size(hashes).cast("long").alias("n"), sha256_text(F.array_join(hashes, ",")).alias("sha256"))
    _, gaps = resolve.native_parents(steps, resolve.conflicts(steps), number)
    return gaps.select("trace", "code", "subject", F.col("related.n").alias("n_related"), F.col("related.sha256").alias("related_sha256"))


def lineage_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers exported as records that differ: each has its versions' hashes."""
    trace, key = _trace("o_custkey"), F.col("o_custkey").cast("string")
    rows = _rows(_table(spark, sf_dir, "orders"), OBSERVATIONS, trace, key, id=key, metadata=_lineage(trace, agent=_agent(F.col("o_orderpriority"))), parentObservationId=F.lit(None).cast("string"), traceId=key)
    found = resolve.conflict_gaps(resolve.conflicts(materialize(clean(_normalized(spark, rows)), "steps")))
    return found.select("trace", "code", "subject", F.size("related").cast("long").alias("n_related"), sha256_text(F.array_join("related", ",")).alias("related_sha256"))


def _type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's kind (type and size) to the kind of the same user's next event."""
    kind = F.concat_ws("-", "event_type", F.floor(F.col("value") / 5).cast("string"))
    following = F.lead(kind).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _table(spark, sf_dir, "events").select(_trace("user_id").alias("trace"), kind.alias("parent"), following.alias("child"))
    return rows.where("child is not null").distinct()


def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of event kinds that lead to each other, for each user."""
    found = graph.cycles(_type_edges(spark, sf_dir))
    return graph.cycle_gaps(found).select("trace", "code", "subject", F.array_join("related", ",").alias("members"))


def lineage_acyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left when those within a cycle set go."""
    edges = materialize(_type_edges(spark, sf_dir), "type-edges")
    return graph.without_cycles(edges, graph.cycles(edges)).select("trace", "parent", "child")


def _turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    turns = _table(spark, sf_dir, "conversations")
    named = turns.select(_trace("conv_id").alias("trace"), node(1).alias("parent"), node(0).alias("child"))
    there = turns.select(_trace("conv_id").alias("trace"), node(0).alias("parent"))
    return named.join(there, ["trace", "parent"], "left_semi").distinct().select("trace", "parent", "child")


def lineage_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn stands on, with depth; a turn itself at 0."""
    edges = materialize(_turn_edges(spark, sf_dir), "turn-edges")
    turns = _table(spark, sf_dir, "conversations")
    nodes = turns.select(_trace("conv_id").alias("trace"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node")).distinct()
    return graph.ancestors(edges, nodes).select("trace", "start", "node", F.col("depth").cast("long").alias("depth"))


def lineage_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in an order in which parents come first."""
    edges = materialize(_turn_edges(spark, sf_dir), "turn-edges")
    turns = _table(spark, sf_dir, "conversations")
    nodes = turns.select(_trace("conv_id").alias("trace"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"))
    return graph.topological(nodes, edges).select("trace", "node", F.col("position").cast("long").alias("position"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as links of a stream for each user: positions from ``props``, each naming the event before it."""
    events = _table(spark, sf_dir, "events")
    own = lambda c: sha256_text(c.cast("string"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    place = (F.get_json_object("props", "$.k").cast("long") + 1).cast("string")
    return events.select(F.lit(SPANS).alias("source"), F.col("user_id").cast("string").alias("stream"), place.alias("seq"), own(F.col("event_id")).alias("hash"), F.coalesce(own(before), F.lit(ZERO)).alias("prev"), F.col("event_type").alias("step"))


def lineage_stream_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a stream with a link whose predecessor isn't there."""
    return streams.broken_links(_links(spark, sf_dir)).select("source", "stream", "n")


def lineage_stream_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a stream with several links."""
    return streams.forks(_links(spark, sf_dir)).select("source", "stream", "n", F.array_join("hashes", ",").alias("hashes"))


def lineage_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links up to the last one of each stream that attests a purchase."""
    steps = spark.createDataFrame([("vlt_" + "p" * 21, "purchase")], "trace string, hash string")
    return streams.pinned(_links(spark, sf_dir), steps).select("trace", "source", "stream", "seq", "hash")


def lineage_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical graph of each conversation: its steps, edges and gaps, and their hash."""
    steps = materialize(_run_steps(spark, sf_dir), "steps")
    conflicted = resolve.conflicts(steps)
    edges, gaps = resolve.native_parents(steps, conflicted)
    return manifests(steps, Reduced(edges, gaps.unionByName(resolve.conflict_gaps(conflicted)))).select("trace", "graph")


def lineage_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, encodings and pointers of all document texts."""
    text = F.coalesce("text", F.lit(""))
    raw = F.encode(text, "utf-8")
    hexed = sha256_text(text)
    return _table(spark, sf_dir, "documents").select(
        "doc_id", hexed.alias("sha256"), base64url(F.unhex(hexed)).alias("sha256_base64url"), (from_base64url(base64url(raw)) == raw).alias("round_trip"),
        digest_text("VL-BATCH/1", text).alias("tagged"), short(hexed).alias("short"), sha256_text(escape_pointer(text)).alias("pointer_sha256"),
    )


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, numbered: steps of a trace whose names are digests of their ids."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    number = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").select(_trace("user_id").alias("trace"), F.lit(SPANS).alias("source"), F.col("event_id").cast("string").alias("record"), sha256_text(F.col("event_id").cast("string")).alias("hash"), "event_type", place.cast("long").alias("n"), number.alias("k"))


def _paths(spark: SparkSession, sf_dir: str) -> Paths:
    """For each user, what the 40th, the 60th and a missing event stand on.

    An event stands on the one before it of its type and, if its number is even, on the one
    before it of any type. Events with small numbers have gaps. Every fifth user's paths may
    hold 30 nodes, every seventh's be 12 deep.
    """
    work = materialize(_work(spark, sf_dir), "work")
    before = F.lag("hash").over(Window.partitionBy("trace", "event_type").orderBy("n"))
    same = work.select("trace", before.alias("parent"), F.col("hash").alias("child")).where("parent is not null")
    other = work.where("k % 2 = 0").select("trace", (F.col("n") - 1).alias("n"), F.col("hash").alias("child")).join(work.select("trace", "n", F.col("hash").alias("parent")), ["trace", "n"]).select("trace", "parent", "child")
    edges = materialize(same.unionByName(other).distinct(), "edges")
    gaps = work.where("k < 4").select("trace", F.when(F.col("k") == 0, "PARENT_AMBIGUOUS").otherwise("PARENT_MISSING").alias("code"), F.col("hash").alias("subject"), F.array().cast("array<string>").alias("related"))
    user = F.substring("trace", 5, 21).cast("long")
    asked = work.where("n in (40, 60)").select("trace", "source", "record").unionByName(work.where("n = 1").select("trace", "source", F.concat(F.lit("no"), "record").alias("record")))
    requests = asked.select(F.concat_ws("/", "trace", "record").alias("request"), "*", F.when(user % 7 == 0, 12).otherwise(256).alias("max_depth"), F.when(user % 5 == 0, 30).otherwise(4096).alias("max_nodes"))
    return paths(work, edges, gaps, requests)


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each path, with least depth."""
    return _paths(spark, sf_dir).nodes.select("request", "node", F.col("depth").cast("long").alias("depth"))


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes of each path."""
    return _paths(spark, sf_dir).edges.select("request", "parent", "child")


def path_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that concern each path."""
    return _paths(spark, sf_dir).gaps.select("request", "code", "subject")


def structural_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error or verdict of each request."""
    return _paths(spark, sf_dir).answers.select("request", "error", "verdict")


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key pins: a customer is a key of its nation's stream for a range of positions."""
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("vlk_"), F.lpad((F.col("c_custkey") % 500).cast("string"), 21, "0")).alias("id"), F.lit("origin").alias("role"), F.lit(None).cast("string").alias("public"),
        F.when(F.col("c_nationkey") % 2 == 0, RUNS).otherwise(SPANS).alias("source"), F.col("c_mktsegment").alias("stream"), (F.col("c_custkey") % 50 + 1).cast("string").alias("first_seq"), (F.col("c_custkey") % 50 + 30).cast("string").alias("last_seq"),
        F.when(F.col("c_custkey") % 11 == 0, "COMPROMISED").when(F.col("c_custkey") % 3 == 0, "RETIRED").otherwise("ACTIVE").alias("status"),
    )


def pin_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pins say of each order as an attestation signed by its customer's key."""
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("hash"), F.concat(F.lit("vlk_"), F.lpad((F.col("o_custkey") % 700).cast("string"), 21, "0")).alias("key"), F.when(F.col("o_custkey") % 2 == 0, RUNS).otherwise(SPANS).alias("source"),
        F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("stream"), (F.col("o_orderkey") % 90 + 1).cast("string").alias("seq"),
    )
    return trust.key_standing(rows, _pins(spark, sf_dir), "origin").select("hash", "standing")


def head_pin_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads pinned at every third position of each user's stream, against the stream."""
    links = _links(spark, sf_dir)
    heads = links.where("cast(seq as long) % 3 = 0").groupBy("source", "stream", "seq").agg(F.min("hash").alias("hash"))
    wrong = F.col("stream").cast("long") % 4 == 0
    pins = heads.select("source", "stream", F.when(F.col("stream").cast("long") % 5 == 0, F.lit("500")).otherwise(F.col("seq")).alias("seq"), F.when(wrong, sha256_text(F.col("hash"))).otherwise(F.col("hash")).alias("hash")).distinct()
    return trust.head_status(links, pins)


def lineage_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of edges and gaps by kind and code, of orders and line items reduced with all rules.

    Perturbed by key: offers of another scope, to another agent or source, left out, and
    acceptances that name another hash or record.
    """
    steps = materialize(_perturbed(spark, sf_dir), "steps")
    reduced = reduce_steps(steps)
    edges = reduced.edges.groupBy(F.col("kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("trace").alias("traces"))
    gaps = reduced.gaps.groupBy(F.col("code").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("trace").alias("traces"))
    return edges.unionByName(gaps)


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders offer, and the first line items accept, both perturbed by the order's key."""
    key, trace, o = F.col("o_orderkey").cast("string"), _trace("o_custkey"), F.col("o_orderkey")
    delegation = F.concat(F.lit("vld_"), F.lpad(key, 21, "0"))
    scope = F.when(o % 10 == 1, "2" * 64).otherwise(SCOPE)
    offer = F.struct(F.struct(F.lit("lab").alias("namespace"), F.lit(None).cast("string").alias("principal"), F.when(o % 10 == 2, "other").otherwise("warehouse").alias("subject")).alias("child_agent"), F.when(o % 10 == 3, SPANS).otherwise(OBSERVATIONS).alias("child_source"), delegation.alias("id"), scope.alias("scope"))
    offers = F.when(o % 10 == 4, F.array().cast(f"array<{OFFER}>")).otherwise(F.array(offer))
    meta = F.struct(_lineage(trace, agent=_agent(F.lit("shop")), offers=offers).alias("metadata"))
    orders = _table(spark, sf_dir, "orders")
    shops = materialize(clean(_normalized(spark, _rows(orders, RUNS, trace, key, extra=meta, id=key, parent_run_id=F.lit(None).cast("string"), trace_id=F.col("o_custkey").cast("string")))), "shops")
    first = _table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey").distinct()
    taken = first.join(shops.select("trace", F.col("record").cast("long").alias("l_orderkey"), "hash"), "l_orderkey")
    key, k = F.col("l_orderkey").cast("string"), F.col("l_orderkey")
    parent = F.struct(F.when(k % 10 == 5, SCOPE).otherwise(F.col("hash")).alias("hash"), F.when(k % 10 == 6, F.concat(F.lit("no"), key)).otherwise(key).alias("record"), F.lit(RUNS).alias("source"))
    accept = F.struct(F.concat(F.lit("vld_"), F.lpad(key, 21, "0")).alias("id"), parent.alias("parent"), F.lit(SCOPE).alias("scope"))
    lines = _rows(taken, OBSERVATIONS, F.col("trace"), key, id=key, metadata=_lineage(F.col("trace"), agent=_agent(F.lit("warehouse")), accept=accept), parentObservationId=F.when(k % 10 == 7, F.concat(F.lit("no"), key)), traceId=key)
    return shops.unionByName(clean(_normalized(spark, lines)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps by part: place, trace (of the order's customer class), source, record, native trace, hash."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    place = F.concat_ws("/", key, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
    # the hash is the place's, so places are made distinct, before columns are made of them
    lines = _table(spark, sf_dir, "lineitem").select(place.alias("place"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").dropDuplicates(["place"])
    return lines.select(
        "place", F.concat(F.lit("vlt_"), F.lpad((F.col("l_orderkey") % 97).cast("string"), 21, "0")).alias("trace"),
        F.lit(RUNS).alias("source"), key.alias("record"), F.col("l_partkey").cast("string").alias("native_trace"), sha256_text("place").alias("hash"), "l_suppkey",
    )


def commit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commit of the line items of some suppliers does where those of others are stored."""
    items = materialize(_items(spark, sf_dir), "items")
    return ledger.commit_counters(items.where("l_suppkey % 3 <> 0"), items.where("l_suppkey % 4 <> 1"))


def binding_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and records of line items that belong to another trace already."""
    items = materialize(_items(spark, sf_dir), "items")
    return ledger.binding_conflicts(items.where("l_suppkey % 3 <> 0"), items.where("l_suppkey % 40 = 1"))


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listed and as held, by source: some not held, not listed, listed twice or of another length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("bundle"), F.lit("attachment").alias("kind"), F.coalesce("text", F.lit("")).alias("json"))
    docs = docs.groupBy("bundle", "kind", "json").agg(F.min("doc_id").alias("doc_id"))
    listed = inventory.items(docs.where("doc_id % 11 <> 0")).unionByName(inventory.items(docs.where("doc_id % 13 = 1 and doc_id % 11 <> 0")))
    held = inventory.items(docs.where("doc_id % 7 <> 0")).withColumn("bytes", F.when(F.substring("digest", 1, 1) == "a", "0").otherwise(F.col("bytes")))
    return inventory.inventory_diff(listed, held)


def audit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last position of the audit log of each market segment's customers, and whether its chain holds."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("workspace"), F.lpad(F.col("c_custkey").cast("string"), 21, "0").alias("place"), F.concat(F.lit("vlq_"), F.lpad(F.col("c_custkey").cast("string"), 21, "0")).alias("request"), F.lit("vlk_" + "k" * 21).alias("key"), canonical(F.struct(F.lit("SourceRegistered").alias("kind"), F.col("c_name").alias("name"))).alias("data"))
    log = materialize(ledger.append_audit(rows, spark.createDataFrame([], "workspace string, n long, hash string")), "audit")
    faults = ledger.audit_faults(log).groupBy("workspace").agg(F.count("*").alias("faults"))
    return ledger.audit_head(log).join(faults, "workspace", "left").select("workspace", "n", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


def request_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for again, some with another total."""
    orders = _table(spark, sf_dir, "orders")
    known = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("id"), sha256_text("o_orderstatus").alias("hash"))
    asked = orders.select(F.col("o_orderkey").cast("string").alias("id"), sha256_text(F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("hash"))
    return ledger.request_standing(asked, known).select("id", "standing")


def prunable_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions of their customers, but those within three numbers of the last."""
    rows = _table(spark, sf_dir, "orders").select(_trace("o_custkey").alias("trace"), F.col("o_orderkey").alias("revision"))
    return ledger.prunable(rows, 3)


def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as JSON, most of them spoiled in a way that depends on the document."""
    nested = lambda n: F.concat(F.lit('{"t":' + "[" * (n - 1)), text, F.lit("]" * (n - 1) + "}"))
    listed = lambda n: F.concat(F.lit('{"t":['), text, F.lit(",0" * (n - 1) + "]}"))
    with_member = lambda m: F.concat(F.lit('{"t":'), text, F.lit(f",{m}}}"))
    text = F.concat(F.lit('"'), F.regexp_extract(F.to_json(F.array(F.coalesce("text", F.lit("")))), r'(?s)^\["(.*)"\]$', 1), F.lit('"'))
    made = [
        with_member('"u":-0.5e3'), F.concat(with_member('"u":1'), F.lit(" x")), with_member('"t":1'), with_member('"u":"\\ud800"'), with_member('"u":1e999'), nested(32), nested(33),
        with_member(",".join(f'"{i}":{i}' for i in range(1024))), listed(4096), listed(4097),
    ]
    case = F.element_at(F.array(*made), (F.col("doc_id") % len(made) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", case.alias("raw")).select("doc_id", json_fault("raw").alias("fault"))


def path_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all paths of events, and a last line for each path."""
    found = _paths(spark, sf_dir)
    work = _work(spark, sf_dir)
    agent = F.when(F.col("k") % 5 > 0, F.struct(F.lit("lab").alias("namespace"), F.lit(None).cast("string").alias("principal"), F.col("event_type").alias("subject")))
    policy = F.when(F.col("k") % 4 > 0, F.struct(F.when(F.col("k") % 4 == 1, "ALLOW").otherwise("REVIEW").alias("decision")))
    steps = work.select("trace", F.col("hash").alias("node"), "source", "record", agent.alias("agent"), policy.alias("policy"))
    nodes = found.nodes.join(steps, ["trace", "node"]).select("request", F.lit(0).alias("position"), F.col("node").alias("hash"), "source", "record", "agent", "policy")
    edges = found.edges.select("request", "child", F.when(F.col("parent") < F.col("child"), "NATIVE_PARENT").otherwise("DELEGATES").alias("kind"), F.col("parent").alias("hash"))
    attested = found.nodes.join(work.where("k % 3 = 0").select("trace", F.col("hash").alias("node")), ["trace", "node"]).select("request", F.col("node").alias("step"))
    answers = found.answers.where("error is null").select("request", "trace", F.lit("1").alias("revision"), F.col("action").alias("graph"), F.col("verdict").alias("structural"), F.lit("UNSIGNED").alias("evidence"))
    gaps = found.gaps.select("request", F.when(F.col("code") == "PARENT_AMBIGUOUS", "ORIGIN_FORK").otherwise(F.col("code")).alias("code"))
    return verification.path_lines(nodes, edges, attested).select("request", "line").unionByName(verification.path_footers(answers, gaps))


def audit_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bundles, their line items as audit entries; the last one binds the graph or fails to."""
    name = F.col("l_orderkey").cast("string")
    case = F.col("l_orderkey") % 7
    data = F.struct(
        F.when(case == 1, "other").otherwise(name).alias("graph"), F.when(F.col("l_orderkey") % 2 == 0, "TraceCreated").otherwise("ImportCommitted").alias("kind"), F.when(case == 2, "9").otherwise(F.col("l_linenumber").cast("string")).alias("revision"), name.alias("trace"),
    )
    log = _table(spark, sf_dir, "lineitem").select(name.alias("bundle"), F.when((case == 3) & (F.col("l_linenumber") == 1), "other").otherwise(WORKSPACE).alias("workspace"), F.col("l_linenumber").cast("long").alias("n"), canonical(data).alias("data"))
    key = F.col("o_orderkey").cast("string")
    bundles = _table(spark, sf_dir, "orders").select(key.alias("bundle"), F.lit(WORKSPACE).alias("workspace"), key.alias("trace"), (F.col("o_orderkey") % 4).cast("string").alias("revision"), key.alias("graph"))
    return verification.audit_bindings(log, bundles)


def unneeded_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a user's stream after the last one that attests a purchase, or a view for every third user."""
    links = _links(spark, sf_dir).withColumn("bundle", F.col("stream"))
    third = F.col("stream").cast("long") % 3 == 0
    steps = links.select("bundle", F.when(third, "view").otherwise("purchase").alias("hash")).distinct()
    return verification.unneeded_origins(links, steps).distinct()


def verification_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bundles whose phases and chains end in every way, with their reports."""
    key = F.col("o_orderkey")
    one = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    failed = one(("none", *verification.PHASES, "none", "none", "none", "none", "none"), key)
    origin, audit = (one(values, F.col("o_custkey") + key) for values in (("TRUSTED_AT_PIN", "CONFLICTED", "UNSIGNED", "TRUSTED_AT_PIN", "INCOMPLETE"), ("TRUSTED_AT_PIN", "UNTRUSTED", "CONFLICTED", "UNSIGNED")))
    reasons = lambda verdict, names: F.when(verdict == "TRUSTED_AT_PIN", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, names)))
    summary = _table(spark, sf_dir, "orders").select(
        key.cast("string").alias("bundle"), *((failed == name).alias(name) for name in verification.PHASES), one(("COMPLETE_RELATIVE", "CONFLICTED", "COMPLETE_RELATIVE"), key).alias("structural"),
        F.when(key % 13 == 0, "INVALID").otherwise("VALID").alias("audit_integrity"), audit.alias("audit_verdict"), reasons(audit, ("PIN_AHEAD", "AUDIT_GAP")).alias("audit_reasons"),
        F.when(key % 17 == 0, "INVALID").otherwise("VALID").alias("origin_integrity"), origin.alias("origin_verdict"), reasons(origin, ("PIN_AHEAD", "ORIGIN_GAP")).alias("origin_reasons"),
    )
    out = verification.verdicts(summary)
    return out.select("bundle", "integrity", "structural", "origin", "audit", F.array_join("reasons", ",").alias("reasons"), F.col("exit_code").cast("long").alias("exit_code"), sha256_text(verification.verdict_text()).alias("report_sha256"))


def bundle_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as bundles: what users say are steps, assistants attest, the rest is audit; greetings are attachments."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    key = F.col("conv_id").cast("string")
    kind = F.when(F.col("role") == "user", "step").when(F.col("role") == "assistant", "origin").otherwise("audit")
    envelopes = turns.select(key.alias("bundle"), kind.alias("kind"), sha256_text("text").alias("hash"), F.col("turn").cast("long").alias("n"), canonical(F.struct(sha256_text("text").alias("hash"), F.col("turn").cast("long").alias("turn"))).alias("json"))
    first = turns.where("turn = 0")
    refs = first.select(key.alias("bundle"), sha256_text("text").alias("digest"), F.octet_length("text").cast("string").alias("bytes"))
    artifacts = first.select(key.alias("bundle"), sha256_text("text").alias("digest"), canonical(F.struct(sha256_text("text").alias("digest"))).alias("json")).distinct()
    policy = F.when(F.col("conv_id") % 2 == 0, "INCLUDE").otherwise("OMIT")
    heads = turns.select("conv_id").distinct().select(key.alias("bundle"), F.lit(WORKSPACE).alias("workspace"), _trace("conv_id").alias("trace"), F.lit("1").alias("revision"), policy.alias("attachment_policy"), *(F.lit("{}").alias(c) for c in ("graph", "path_request", "path", "action")))
    return verification.assemble(heads, envelopes, refs, artifacts, "lineage-bundle/1", limit=1500).select("bundle", "hash", "bytes", "error", sha256_text(F.coalesce("document", F.lit(""))).alias("document_sha256"), "handoff")


_NAMES = (
    lineage_run_steps, lineage_span_steps, lineage_native_edges, lineage_parent_gaps, lineage_conflicts, lineage_delegations, lineage_cycles, lineage_acyclic_edges, lineage_ancestors, lineage_topological,
    lineage_stream_breaks, lineage_stream_forks, lineage_pinned, lineage_manifests, lineage_encodings, lineage_reduced, path_nodes, path_edges, path_gaps, structural_verdict, pin_interval_join, head_pin_status, commit_counters, binding_conflicts, inventory_diff, audit_head, request_standing, prunable_revisions, json_faults, path_report, audit_bindings, unneeded_origins, verification_verdicts, bundle_hashes,
)
QUERIES: dict = {f.__name__: f for f in _NAMES}


def _step_json(agent: str, span: str, native: str, parents: str, profile: str, record: str, source: str, trace: str) -> str:
    """SQL text of a step's canonical JSON; arguments are SQL."""
    return (
        f"""'{{"accept":null,"agent":' || {agent} || ',"attachments":[],"native_span":"' || {span} || '","native_trace":"' || {native} || '","offers":[],"parents":' || {parents} || ',"policy":null,"profile":"{profile}","record":"' """
        f"""|| {record} || '","source":"{source}","trace":"' || {trace} || '","v":1,"workspace":"{WORKSPACE}"}}'"""
    )


def _tagged(tag: str, json: str) -> str:
    return f"sha256('{tag}' || chr(0) || {json})"


def _sql_trace(c: str) -> str:
    return f"'vlt_' || lpad({c}::varchar, 21, '0')"


_RUN = "conv_id || '-' || turn"
_RUN_PARENTS = """CASE WHEN turn > 0 THEN '[{"kind":"record","value":"' || conv_id || '-' || (turn - 1) || '"}]' ELSE '[]' END"""
_RUN_STEPS = f"""SELECT DISTINCT conv_id, turn, {_sql_trace("conv_id")} AS trace, {_RUN} AS record,
  {_tagged("VL-STEP/1", _step_json("'null'", _RUN, "conv_id", _RUN_PARENTS, "langsmith-runs/1", _RUN, RUNS, _sql_trace("conv_id")))} AS hash FROM conversations"""
_BEFORE = "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'view' ELSE 'click' END"
_SPAN_PARENTS = f"""coalesce('[{{"kind":"span","value":"' || ({_BEFORE}) || '"}}]', '[]')"""
_SPAN_STEPS = f"""SELECT user_id, event_type, {_BEFORE} AS before, {_sql_trace("user_id")} AS trace, event_id::varchar AS record,
  {_tagged("VL-STEP/1", _step_json("'null'", "event_type", "user_id", _SPAN_PARENTS, "braintrust-spans/1", "event_id", SPANS, _sql_trace("user_id")))} AS hash FROM events"""
_EDGE_JSON = """'{"child":"' || child || '","delegation":null,"kind":"NATIVE_PARENT","parent":"' || parent || '","scope":null,"trace":"' || trace || '","v":1}'"""
_RUN_EDGES = f"""SELECT trace, parent, child, {_tagged("VL-EDGE/1", _EDGE_JSON)} AS hash FROM (
  SELECT c.trace, p.hash AS parent, c.hash AS child FROM steps c JOIN steps p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)"""
_CUSTOMER = """'{"namespace":"lab","principal":null,"subject":"' || o_orderpriority || '"}'"""
_CUSTOMERS = f"""SELECT DISTINCT {_sql_trace("o_custkey")} AS trace, {_tagged("VL-STEP/1", _step_json(_CUSTOMER, "o_custkey", "o_custkey", "'[]'", "langfuse-observations/1", "o_custkey", OBSERVATIONS, _sql_trace("o_custkey")))} AS hash FROM orders"""
_TYPE_EDGES = f"""SELECT DISTINCT {_sql_trace("user_id")} AS trace, kind AS parent, following AS child FROM (
  SELECT user_id, kind, lead(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM (SELECT *, event_type || '-' || floor(value / 5)::bigint AS kind FROM events)) WHERE following IS NOT NULL"""
_MUTUAL = f"""WITH RECURSIVE e AS ({_TYPE_EDGES}), r AS (SELECT trace, parent AS a, child AS b FROM e UNION SELECT r.trace, r.a, e.child FROM r JOIN e ON e.trace = r.trace AND e.parent = r.b),
  m AS (SELECT x.trace, x.a, x.b FROM r x JOIN r y ON y.trace = x.trace AND y.a = x.b AND y.b = x.a)"""
_LINKS = f"""SELECT '{SPANS}' AS source, user_id::varchar AS stream, json_extract_string(props, '$.k')::bigint + 1 AS n, sha256(event_id::varchar) AS hash,
  coalesce(sha256(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)::varchar), '{ZERO}') AS prev, event_type AS step FROM events"""
_PREVIOUS = "SELECT DISTINCT c.conv_id, c.turn, {} AS trace, p.turn AS before FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1".format(_sql_trace("c.conv_id"))

_WORK = f"""SELECT {_sql_trace("user_id")} AS trace, user_id, event_id::varchar AS record, sha256(event_id::varchar) AS hash, event_type, json_extract_string(props, '$.k')::bigint AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)::varchar AS p1, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::varchar AS p2 FROM events"""
_PATHS = f"""WITH RECURSIVE w AS ({_WORK}), e AS (SELECT trace, sha256(p2) AS parent, hash AS child FROM w WHERE p2 IS NOT NULL UNION SELECT trace, sha256(p1), hash FROM w WHERE k % 2 = 0 AND p1 IS NOT NULL),
  a AS (SELECT trace || '/' || record AS request, trace, user_id, hash FROM w WHERE n IN (40, 60)), r AS (SELECT request, trace, hash AS node, 0 AS depth FROM a UNION SELECT r.request, r.trace, e.parent, r.depth + 1 FROM r JOIN e ON e.trace = r.trace AND e.child = r.node),
  d AS (SELECT request, trace, node, min(depth) AS depth FROM r GROUP BY ALL), s AS (SELECT request, count(*) AS n, max(depth) AS depth FROM d GROUP BY request),
  l AS (SELECT a.request FROM a JOIN s ON s.request = a.request WHERE (user_id % 7 = 0 AND depth > 12) OR (user_id % 5 = 0 AND n > 30)), m AS (SELECT * FROM d WHERE request NOT IN (SELECT request FROM l)),
  g AS (SELECT m.request, CASE WHEN w.k = 0 THEN 'PARENT_AMBIGUOUS' ELSE 'PARENT_MISSING' END AS code, w.hash AS subject FROM m JOIN w ON w.trace = m.trace AND w.hash = m.node WHERE w.k < 4)"""
_ITEMS = f"""SELECT DISTINCT {_sql_trace("(l_orderkey % 97)")} AS trace, l_orderkey || '-' || l_linenumber AS record, l_suppkey, l_partkey::varchar AS native, l_orderkey || '-' || l_linenumber || '/' || l_suppkey || '/' || l_partkey AS hash FROM lineitem"""
_NATION_STREAM = "CASE WHEN {} % 2 = 0 THEN '" + RUNS + "' ELSE '" + SPANS + "' END"

ORACLE_SQL: dict = {
    "bundle_hashes": f"""WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
      e AS (SELECT conv_id, CASE role WHEN 'user' THEN 'step' WHEN 'assistant' THEN 'origin' ELSE 'audit' END AS kind, sha256(text) AS hash, turn, '{{"hash":"' || sha256(text) || '","turn":' || turn || '}}' AS j FROM t),
      r AS (SELECT conv_id, sha256(text) AS digest, min(strlen(text)::varchar) AS bytes FROM t WHERE turn = 0 GROUP BY ALL),
      i AS (SELECT conv_id, '[' || string_agg('{{"bytes":"' || bytes || '","digest":"' || digest || '","kind":"' || kind || '"}}', ',' ORDER BY kind, digest, bytes) || ']' AS items FROM (SELECT conv_id, kind, sha256(j) AS digest, strlen(j)::varchar AS bytes FROM e UNION ALL SELECT conv_id, 'attachment', digest, bytes FROM r) GROUP BY conv_id),
      g AS (SELECT conv_id, coalesce(string_agg(j, ',' ORDER BY hash, j) FILTER (kind = 'step'), '') AS steps, coalesce(string_agg(j, ',' ORDER BY j) FILTER (kind = 'origin'), '') AS origins, coalesce(string_agg(j, ',' ORDER BY turn, j) FILTER (kind = 'audit'), '') AS audit FROM e GROUP BY conv_id),
      f AS (SELECT conv_id, string_agg('{{"digest":"' || digest || '"}}', ',' ORDER BY digest) AS files FROM r WHERE conv_id % 2 = 0 GROUP BY conv_id),
      b AS (SELECT g.*, coalesce(files, '') AS files, '{{"attachment_policy":"' || CASE WHEN g.conv_id % 2 = 0 THEN 'INCLUDE' ELSE 'OMIT' END || '","disclosure":"NORMALIZED_ONLY","format":"lineage-bundle/1","graph":{{}},"inventory":' || items || ',"path":{{}},"path_request":{{}},"revision":"1","trace":"'
        || {_sql_trace("g.conv_id")} || '","trust_required":true,"v":1,"workspace":"{WORKSPACE}"}}' AS body FROM g JOIN i ON i.conv_id = g.conv_id LEFT JOIN f ON f.conv_id = g.conv_id),
      h AS (SELECT *, {_tagged("VL-BUNDLE/1", "body")} AS hash FROM b), d AS (SELECT *, '{{"attachments":[' || files || '],"audit":[' || audit || '],"body":' || body || ',"hash":"' || hash || '","origins":[' || origins || '],"steps":[' || steps || ']}}' AS document FROM h)
      SELECT conv_id::varchar AS bundle, hash, strlen(document)::bigint AS bytes, CASE WHEN strlen(document) > 1500 THEN 'BUNDLE_LIMIT' END AS error, sha256(CASE WHEN strlen(document) > 1500 THEN '' ELSE document END) AS document_sha256, CASE WHEN strlen(document) <= 1500 THEN
        '{{"action":{{}},"bundle":"' || hash || '","disclosure":"NORMALIZED_ONLY","format":"lineage-bundle/1","graph":"' || {_tagged("VL-GRAPH/1", "'{}'")} || '","kind":"action-lineage","semantics":"NOT_VERIFIED","trace":"' || {_sql_trace("conv_id")} || '","v":1}}' END AS handoff FROM d""",
    "json_faults": "SELECT doc_id, ([NULL, 'TRAILING', 'SYNTAX', 'SURROGATE', 'NUMBER', NULL, 'DEPTH', 'MEMBERS', NULL, 'ELEMENTS'])[doc_id % 10 + 1] AS fault FROM documents",
    "path_report": f"""{_PATHS}, i AS (SELECT m.request, m.node, string_agg(CASE WHEN e.parent < e.child THEN 'NATIVE_PARENT' ELSE 'DELEGATES' END, '+' ORDER BY e.parent) AS kinds FROM m JOIN e ON e.trace = m.trace AND e.child = m.node JOIN m p ON p.request = m.request AND p.node = e.parent GROUP BY ALL),
      t AS (SELECT m.request, w.hash, w.record, w.event_type, w.k, coalesce(i.kinds, '-') AS kinds FROM m JOIN w ON w.trace = m.trace AND w.hash = m.node LEFT JOIN i ON i.request = m.request AND i.node = m.node),
      c AS (SELECT request, count_if(code = 'PARENT_MISSING') AS missing, count_if(code = 'PARENT_AMBIGUOUS') AS forks FROM g GROUP BY request)
      SELECT request, left(hash, 12) || '  ' || rpad('{SPANS[4:12]}:' || record, 22, ' ') || ' ' || rpad(CASE WHEN k % 5 > 0 THEN 'lab/' || event_type ELSE '-' END, 13, ' ') || ' ' || rpad((['UNKNOWN', 'ALLOW', 'REVIEW', 'REVIEW'])[k % 4 + 1], 9, ' ') || ' '
        || rpad(kinds, greatest(16, len(kinds))::int, ' ') || ' ' || CASE WHEN k % 3 = 0 THEN 'SIGNED' ELSE 'CLAIMED' END AS line FROM t
      UNION ALL SELECT a.request, 'trace ' || a.trace || ' revision 1 graph ' || left(a.hash, 12) || ' — ' || coalesce(missing, 0) || ' missing reference(s), ' || coalesce(forks, 0) || ' fork(s), relative to disclosed exports ['
        || CASE WHEN forks > 0 THEN 'CONFLICTED' WHEN missing > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE_RELATIVE' END || '/UNSIGNED]' FROM a LEFT JOIN c ON c.request = a.request WHERE a.request NOT IN (SELECT request FROM l)""",
    "audit_bindings": """WITH z AS (SELECT l_orderkey AS k, max(l_linenumber) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)
      SELECT o_orderkey::varchar AS bundle, coalesce(n IS NOT NULL AND o_orderkey % 7 <> 1 AND NOT (o_orderkey % 7 = 3 AND first = 1) AND CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 2 = 0 THEN false ELSE o_orderkey % 7 <> 2 AND n = o_orderkey % 4 END, false) AS bound FROM orders LEFT JOIN z ON k = o_orderkey""",
    "unneeded_origins": f"""WITH l AS ({_LINKS}), p AS (SELECT stream, max(n) AS last FROM l WHERE step = CASE WHEN stream::bigint % 3 = 0 THEN 'view' ELSE 'purchase' END GROUP BY stream)
      SELECT DISTINCT l.stream AS bundle, hash FROM l LEFT JOIN p ON p.stream = l.stream WHERE last IS NULL OR n > last""",
    "verification_verdicts": """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 11 AS f, CASE WHEN k % 3 = 1 THEN 'CONFLICTED' ELSE 'COMPLETE_RELATIVE' END AS s, (['TRUSTED_AT_PIN', 'CONFLICTED', 'UNSIGNED', 'TRUSTED_AT_PIN', 'INCOMPLETE'])[(o_custkey + k) % 5 + 1] AS o, (['TRUSTED_AT_PIN', 'UNTRUSTED', 'UNTRUSTED', 'INCOMPLETE'])[(o_custkey + k) % 4 + 1] AS a FROM orders),
      e AS (SELECT *, f BETWEEN 1 AND 5 AS early, f NOT BETWEEN 1 AND 5 AND k % 13 = 0 AS forged FROM b),
      v AS (SELECT k::varchar AS bundle, CASE WHEN early OR forged OR k % 17 = 0 THEN 'INVALID' ELSE 'VALID' END AS integrity, CASE WHEN f BETWEEN 1 AND 3 THEN 'INCOMPLETE' ELSE s END AS structural, CASE WHEN early OR forged THEN 'UNTRUSTED' ELSE o END AS origin, CASE WHEN early OR forged THEN 'UNTRUSTED' ELSE a END AS audit,
        CASE WHEN early THEN (['INVENTORY_MISMATCH', 'INVENTORY_MISMATCH', 'GRAPH_MISMATCH', 'PATH_MISMATCH', 'AUDIT_BINDING_MISMATCH'])[f] WHEN forged THEN CASE WHEN a = 'TRUSTED_AT_PIN' THEN '' ELSE 'AUDIT_GAP,PIN_AHEAD' END WHEN k % 17 = 0 THEN CASE WHEN o = 'TRUSTED_AT_PIN' THEN '' ELSE 'ORIGIN_GAP,PIN_AHEAD' END
        WHEN a <> 'TRUSTED_AT_PIN' AND o <> 'TRUSTED_AT_PIN' THEN 'AUDIT_GAP,ORIGIN_GAP,PIN_AHEAD' WHEN a <> 'TRUSTED_AT_PIN' THEN 'AUDIT_GAP,PIN_AHEAD' WHEN o <> 'TRUSTED_AT_PIN' THEN 'ORIGIN_GAP,PIN_AHEAD' ELSE '' END AS reasons FROM e)
      SELECT *, (CASE WHEN integrity = 'INVALID' THEN 3 WHEN structural = 'CONFLICTED' OR origin = 'CONFLICTED' THEN 5 WHEN origin = 'TRUSTED_AT_PIN' AND audit = 'TRUSTED_AT_PIN' AND structural = 'COMPLETE_RELATIVE' THEN 0 ELSE 4 END)::bigint AS exit_code,
        sha256('integrity: ' || integrity || chr(10) || 'structural: ' || structural || chr(10) || 'origin: ' || origin || chr(10) || 'audit: ' || audit || chr(10) || 'disclosure: NORMALIZED_ONLY (normalized metadata only — no raw provider payloads)' || chr(10) || 'semantics: NOT_VERIFIED (structural evidence, never real-world truth)' || chr(10)
        || 'current_authority: UNKNOWN (no live authority)' || chr(10) || 'reasons: ' || CASE WHEN reasons = '' THEN 'none' ELSE replace(reasons, ',', ', ') END) AS report_sha256 FROM v""",
    "commit_counters": f"""WITH i AS ({_ITEMS}), s AS (SELECT DISTINCT hash FROM i WHERE l_suppkey % 4 <> 1), r AS (SELECT DISTINCT record FROM i WHERE l_suppkey % 4 <> 1),
      a AS (SELECT i.*, hash IN (SELECT hash FROM s) AS have, record IN (SELECT record FROM r) AS prior FROM i WHERE l_suppkey % 3 <> 0), t AS (SELECT *, row_number() OVER (PARTITION BY record, have ORDER BY hash) AS turn FROM a)
      SELECT trace, count_if(NOT have)::bigint AS added, count_if(have)::bigint AS duplicates, count_if(NOT have AND (prior OR turn > 1))::bigint AS conflicts FROM t GROUP BY trace""",
    "binding_conflicts": f"""WITH i AS ({_ITEMS}), s AS (SELECT DISTINCT trace, 'native' AS kind, native AS name FROM i WHERE l_suppkey % 3 <> 0 UNION SELECT trace, 'record', record FROM i WHERE l_suppkey % 3 <> 0),
      b AS (SELECT trace, 'native' AS kind, native AS name FROM i WHERE l_suppkey % 40 = 1 UNION SELECT trace, 'record', record FROM i WHERE l_suppkey % 40 = 1)
      SELECT trace, '{RUNS}' AS source, kind, name FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.kind = s.kind AND b.name = s.name AND b.trace <> s.trace)""",
    "inventory_diff": """WITH d AS (SELECT coalesce(source, '') AS bundle, coalesce(text, '') AS t, min(doc_id) AS id FROM documents GROUP BY ALL), x AS (SELECT bundle, sha256(t) AS digest, id % 11 <> 0 AS e, id % 7 <> 0 AS a, id % 13 = 1 AND id % 11 <> 0 AS twice, left(sha256(t), 1) = 'a' AND strlen(t) <> 0 AS other FROM d)
      SELECT bundle, 'attachment' AS kind, digest, CASE WHEN e AND NOT a THEN 'MISSING' WHEN a AND NOT e THEN 'UNEXPECTED' WHEN twice THEN 'TWICE' ELSE 'BYTES' END AS fault FROM x WHERE (e OR a) AND (NOT e OR NOT a OR twice OR other)""",
    "audit_head": "SELECT c_mktsegment AS workspace, count(*)::bigint AS n, 0::bigint AS faults FROM customer GROUP BY ALL",
    "request_standing": "SELECT o_orderkey::varchar AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' WHEN o_orderkey % 5 = 0 THEN 'IDEMPOTENCY_CONFLICT' ELSE 'REPLAY' END AS standing FROM orders",
    "prunable_revisions": f"SELECT {_sql_trace('o_custkey')} AS trace, o_orderkey AS revision FROM orders JOIN (SELECT o_custkey AS c, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) ON c = o_custkey WHERE o_orderkey <= last - 3",
    "path_nodes": f"{_PATHS} SELECT request, node, depth::bigint AS depth FROM m",
    "path_edges": f"{_PATHS} SELECT c.request, e.parent, e.child FROM e JOIN m c ON c.trace = e.trace AND c.node = e.child JOIN m p ON p.request = c.request AND p.node = e.parent",
    "path_gaps": f"{_PATHS} SELECT request, code, subject FROM g",
    "structural_verdict": f"""{_PATHS}, v AS (SELECT request, bool_or(code = 'PARENT_AMBIGUOUS') AS c FROM g GROUP BY request)
      SELECT a.request, CASE WHEN l.request IS NOT NULL THEN 'PATH_LIMIT' END AS error, CASE WHEN l.request IS NOT NULL THEN NULL WHEN c THEN 'CONFLICTED' WHEN c IS NOT NULL THEN 'INCOMPLETE' ELSE 'COMPLETE_RELATIVE' END AS verdict
      FROM a LEFT JOIN l ON l.request = a.request LEFT JOIN v ON v.request = a.request UNION ALL SELECT trace || '/no' || record, 'NOT_FOUND', NULL FROM w WHERE n = 1""",
    "pin_interval_join": f"""WITH p AS (SELECT DISTINCT 'vlk_' || lpad((c_custkey % 500)::varchar, 21, '0') AS id, {_NATION_STREAM.format("c_nationkey")} AS source, c_mktsegment AS stream, c_custkey % 50 + 1 AS a, c_custkey % 50 + 30 AS b, c_custkey % 11 = 0 AS bad FROM customer),
      o AS (SELECT o_orderkey::varchar AS hash, 'vlk_' || lpad((o_custkey % 700)::varchar, 21, '0') AS key, {_NATION_STREAM.format("o_custkey")} AS source, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[o_orderkey % 5 + 1] AS stream, o_orderkey % 90 + 1 AS n FROM orders),
      j AS (SELECT o.hash, count(p.id) AS known, count_if(p.source = o.source AND p.stream = o.stream) AS scoped, count_if(p.source = o.source AND p.stream = o.stream AND n BETWEEN a AND b) AS covered, count_if(p.source = o.source AND p.stream = o.stream AND n BETWEEN a AND b AND bad) AS bad
        FROM o LEFT JOIN p ON p.id = o.key GROUP BY o.hash)
      SELECT hash, CASE WHEN known = 0 THEN 'KEY_UNKNOWN' WHEN scoped = 0 THEN 'SCOPE_MISMATCH' WHEN covered = 0 THEN 'KEY_UNKNOWN' WHEN bad > 0 THEN 'KEY_COMPROMISED' ELSE 'COVERED' END AS standing FROM j""",
    "head_pin_status": f"""WITH l AS ({_LINKS}), h AS (SELECT source, stream, n, min(hash) AS hash FROM l WHERE n % 3 = 0 GROUP BY ALL),
      p AS (SELECT DISTINCT source, stream, CASE WHEN stream::bigint % 5 = 0 THEN 500 ELSE n END AS seq, CASE WHEN stream::bigint % 4 = 0 THEN sha256(hash) ELSE hash END AS hash FROM h),
      b AS (SELECT source, stream, min(n) AS a, max(n) AS z FROM l GROUP BY ALL)
      SELECT p.source, p.stream, p.seq::varchar AS seq, p.hash, CASE WHEN p.seq < a THEN 'BELOW' WHEN EXISTS (SELECT 1 FROM l WHERE l.stream = p.stream AND l.n = p.seq AND l.hash = p.hash) THEN 'MATCH'
        WHEN EXISTS (SELECT 1 FROM l WHERE l.stream = p.stream AND l.n = p.seq) THEN 'PIN_MISMATCH' ELSE 'PIN_AHEAD' END AS status FROM p JOIN b ON b.source = p.source AND b.stream = p.stream""",
    "lineage_reduced": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS t, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AS taken FROM orders),
      d AS (SELECT t, CASE WHEN NOT taken AND k % 10 <> 4 THEN 'ACCEPT_MISSING' WHEN taken AND k % 10 = 4 THEN 'OFFER_MISSING' WHEN taken AND k % 10 IN (1, 2, 3, 6) THEN 'DELEGATION_MISMATCH' WHEN taken AND k % 10 = 5 THEN 'PARENT_HASH_MISMATCH'
        WHEN taken THEN 'DELEGATES' END AS kind FROM o UNION ALL SELECT t, 'PARENT_MISSING' FROM o WHERE taken AND k % 10 = 7)
      SELECT kind, count(*)::bigint AS n, count(DISTINCT t)::bigint AS traces FROM d WHERE kind IS NOT NULL GROUP BY kind""",
    "lineage_run_steps": f"SELECT trace, record, hash FROM ({_RUN_STEPS})",
    "lineage_span_steps": f"SELECT trace, record, hash FROM ({_SPAN_STEPS})",
    "lineage_native_edges": f"WITH steps AS ({_RUN_STEPS}) {_RUN_EDGES}",
    "lineage_parent_gaps": f"""WITH steps AS ({_SPAN_STEPS}), named AS (SELECT user_id, event_type, list_sort(list(hash)) AS hashes FROM steps GROUP BY ALL),
      m AS (SELECT s.trace, s.hash, n.hashes FROM steps s LEFT JOIN named n ON n.user_id = s.user_id AND n.event_type = s.before WHERE s.before IS NOT NULL)
      SELECT trace, CASE WHEN hashes IS NULL THEN 'PARENT_MISSING' ELSE 'PARENT_AMBIGUOUS' END AS code, hash AS subject, coalesce(len(hashes), 0)::bigint AS n_related,
      sha256(coalesce(array_to_string(hashes, ','), '')) AS related_sha256 FROM m WHERE hashes IS NULL OR len(hashes) > 1""",
    "lineage_conflicts": f"""WITH v AS (SELECT trace, list_sort(list(hash)) AS h FROM ({_CUSTOMERS}) GROUP BY trace)
      SELECT trace, 'SOURCE_CONFLICT' AS code, h[1] AS subject, len(h)::bigint AS n_related, sha256(array_to_string(h, ',')) AS related_sha256 FROM v WHERE len(h) > 1""",
    "lineage_delegations": f"""WITH n AS (SELECT o_orderkey, o_custkey, count(DISTINCT l_linenumber) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
      SELECT {_sql_trace("o_custkey")} AS trace, 'vld_' || lpad(o_orderkey::varchar, 21, '0') AS delegation, CASE k WHEN 0 THEN 'ACCEPT_MISSING' WHEN 1 THEN 'DELEGATES' ELSE 'DELEGATION_REUSED' END AS outcome,
      CASE WHEN k > 1 THEN k + 1 ELSE 0 END::bigint AS n_related FROM n""",
    "lineage_cycles": f"{_MUTUAL}, s AS (SELECT DISTINCT trace, list_sort(list(DISTINCT b)) AS h FROM m GROUP BY trace, a) SELECT trace, 'CYCLE' AS code, h[1] AS subject, array_to_string(h, ',') AS members FROM s",
    "lineage_acyclic_edges": f"{_MUTUAL} SELECT trace, parent, child FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trace = e.trace AND m.a = e.parent AND m.b = e.child)",
    "lineage_ancestors": f"""WITH RECURSIVE t AS ({_PREVIOUS}), r AS (SELECT conv_id, turn AS s, turn, trace, before, 0 AS depth FROM t UNION ALL SELECT r.conv_id, r.s, t.turn, r.trace, t.before, r.depth + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.before)
      SELECT trace, conv_id || '-' || s AS start, conv_id || '-' || turn AS node, depth::bigint AS depth FROM r""",
    "lineage_topological": f"""SELECT trace, conv_id || '-' || turn AS node, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::bigint AS position FROM ({_PREVIOUS})""",
    "lineage_stream_breaks": f"""WITH l AS ({_LINKS}) SELECT DISTINCT source, stream, n FROM l a WHERE (n = 1 AND prev <> '{ZERO}') OR (n > 1 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.stream = a.stream AND b.n = a.n - 1 AND b.hash = a.prev))""",
    "lineage_stream_forks": f"WITH l AS ({_LINKS}), g AS (SELECT source, stream, n, list_sort(list(DISTINCT hash)) AS h FROM l GROUP BY ALL) SELECT source, stream, n, array_to_string(h, ',') AS hashes FROM g WHERE len(h) > 1",
    "lineage_pinned": f"""WITH l AS ({_LINKS}), p AS (SELECT stream, max(n) AS last FROM l WHERE step = 'purchase' GROUP BY stream)
      SELECT 'vlt_{"p" * 21}' AS trace, source, l.stream, n::varchar AS seq, hash FROM l JOIN p ON p.stream = l.stream WHERE n <= last""",
    "lineage_manifests": f"""WITH steps AS ({_RUN_STEPS}), edges AS ({_RUN_EDGES}), s AS (SELECT trace, '["' || string_agg(hash, '","' ORDER BY hash) || '"]' AS j FROM steps GROUP BY trace),
      e AS (SELECT trace, '["' || string_agg(hash, '","' ORDER BY hash) || '"]' AS j FROM edges GROUP BY trace),
      g AS (SELECT trace, '[' || string_agg('{{"code":"PARENT_MISSING","related":[],"subject":"' || hash || '"}}', ',' ORDER BY hash) || ']' AS j FROM steps c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM steps p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1) GROUP BY trace)
      SELECT s.trace, {_tagged("VL-GRAPH/1", f'''('{{"edges":' || coalesce(e.j, '[]') || ',"gaps":' || coalesce(g.j, '[]') || ',"origins":[],"steps":' || s.j || ',"trace":"' || s.trace || '","v":1,"workspace":"{WORKSPACE}"}}')''')} AS graph
      FROM s LEFT JOIN e ON e.trace = s.trace LEFT JOIN g ON g.trace = s.trace""",
    "lineage_encodings": """SELECT doc_id, sha256(t) AS sha256, rtrim(translate(to_base64(unhex(sha256(t))), '+/', '-_'), '=') AS sha256_base64url, true AS round_trip, sha256('VL-BATCH/1' || chr(0) || t) AS tagged,
      left(sha256(t), 12) AS short, sha256(replace(replace(t, '~', '~0'), '/', '~1')) AS pointer_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
