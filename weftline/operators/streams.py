"""Hash-chained attestation streams: slots, breaks, forks, pinning, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import ZERO

STREAM = ["source", "stream"]


def _keys(origins: DataFrame) -> list[str]:
    """What keeps streams apart: source and stream, and the trace where attestations are those of one (a column ``trace``)."""
    return ["trace", *STREAM] if "trace" in origins.columns else STREAM


def _numbered(origins: DataFrame) -> DataFrame:
    return origins.withColumn("n", F.col("seq").cast("bigint"))


def broken_links(origins: DataFrame) -> DataFrame:
    """(source, stream, n): positions with a link whose predecessor isn't there; by trace, too, where ``origins`` have one."""
    keys = _keys(origins)
    slots = _numbered(origins).select(*keys, "n", "hash", "prev").distinct()
    before = slots.select(*keys, (F.col("n") + 1).alias("n"), F.col("hash").alias("prev"))
    unlinked = slots.where(F.col("n") > 1).join(before, [*keys, "n", "prev"], "left_anti")
    first = slots.where((F.col("n") == 1) & (F.col("prev") != ZERO))
    return unlinked.select(*keys, "n").unionByName(first.select(*keys, "n")).distinct()


def forks(origins: DataFrame) -> DataFrame:
    """(source, stream, n, hashes): positions with two or more hashes; by trace, too, where ``origins`` have one."""
    slots = _numbered(origins).groupBy(*_keys(origins), "n")
    return slots.agg(F.array_sort(F.collect_set("hash")).alias("hashes")).where(F.size("hashes") > 1)


def attested(origins: DataFrame, steps: DataFrame) -> DataFrame:
    """(trace, source, stream, step, last): the last position at which each step of a trace is attested."""
    of_trace = steps.select("trace", F.col("hash").alias("step")).distinct()
    own = ["trace", "step"] if "trace" in origins.columns else ["step"]
    return _numbered(origins).join(of_trace, own).groupBy("trace", *STREAM, "step").agg(F.max("n").alias("last"))


def origin_gaps(origins: DataFrame, steps: DataFrame) -> DataFrame:
    """Gaps of steps that are attested at or after a stream's first break, and at or after each fork.

    Attestations with a column ``trace`` are those of that trace, whose gaps no other trace's attestations bear on.
    """
    keys = _keys(origins)
    seen = attested(origins, steps)
    first = broken_links(origins).groupBy(*keys).agg(F.min("n").alias("first"))
    gap = seen.join(first, keys).where("last >= first").select("trace", F.lit("ORIGIN_GAP").alias("code"), F.col("step").alias("subject"), F.array().cast("array<string>").alias("related"))
    fork = seen.join(forks(origins), keys).where("last >= n").select("trace", F.lit("ORIGIN_FORK").alias("code"), F.col("step").alias("subject"), F.col("hashes").alias("related"))
    return gap.unionByName(fork)


def pinned(origins: DataFrame, steps: DataFrame) -> DataFrame:
    """Origins that belong to a set of steps, by trace: each stream up to its last attestation of one.

    One aggregate and one join by stream, whatever the number of attestations.
    """
    last = attested(origins, steps).groupBy("trace", *STREAM).agg(F.max("last").alias("last"))
    return _numbered(origins).join(last, _keys(origins)).where("n <= last").drop("n", "last")


def link_check(chain: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of a chain (n, prev, hash) with unique positions, and whether each follows its predecessor.

    The predecessor is found by an equi-join on the position before, so a single long chain
    spreads over all tasks; no window runs over the whole of it.
    """
    keys = keys or []
    before = chain.select(*keys, (F.col("n") + 1).alias("n"), F.col("hash").alias("expected"))
    first = F.col("n") == 1
    good = F.when(first, F.col("prev") == ZERO).otherwise(F.coalesce(F.col("prev") == F.col("expected"), F.lit(False)))
    return chain.join(before, [*keys, "n"], "left").withColumn("linked", good).drop("expected")
