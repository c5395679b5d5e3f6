"""Two stores compared: digests of key ranges in a tree, and only what differs read.

A store is written by ranges of a key's hash, with digests of all ranges beside it, level over level. Two stores are
compared from the top: the ranges whose digests differ, then their parts, then the rows of the smallest such ranges,
each of them a partition of its own. Equal stores cost their digests at the top.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.canonical import canonical

BITS, STEP = 8, 4  # of the smallest ranges, and of a level


def write_store(rows: DataFrame, keys: list[str], path: str, bits: int = BITS) -> None:
    """Rows (unique by ``keys``, which nulls may be among) at ``path``/rows by range, their schema and, at ``path``/digests, the ranges' digests.

    A range's digest is its number of rows and two sums of 60 bits of each row's sha256, so ranges are digested by
    parts and their parents are sums. The path must not be there yet.
    """
    names = sorted(rows.columns)
    text = F.sha2(canonical(F.struct(*names)), 256)
    part = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)")
    placed = rows.withColumn("range", F.shiftrightunsigned(F.conv(F.substring(F.sha2(canonical(F.struct(*sorted(keys))), 256), 1, 4), 16, 10).cast("int"), 16 - bits))
    placed.repartition("range").sortWithinPartitions("range", *keys).write.mode("error").partitionBy("range").parquet(f"{path}/rows")
    level = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    spark = rows.sparkSession
    spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("error").text(f"{path}/schema")
    for at in range(bits, -1, -STEP):
        own = level.groupBy(F.shiftright("range", bits - at).alias("range")).agg(F.sum("n").cast("long").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
        own.coalesce(1).write.mode("error").parquet(f"{path}/digests/level={at}")
        level = spark.read.parquet(f"{path}/digests/level={bits}") if at == bits else level


def _rows(spark: SparkSession, path: str, ranges: list[int]) -> DataFrame:
    """Rows of some ranges of a store, which may have none at all."""
    kind = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0])).add("range", T.IntegerType())
    return spark.read.schema(kind).parquet(f"{path}/rows").where(F.col("range").isin(ranges))


def differing_ranges(spark: SparkSession, a: str, b: str, bits: int = BITS) -> list[int]:
    """The smallest ranges in which two stores differ: at most 2 ** ``bits`` numbers reach the driver, and those of a level only below ranges that differ."""
    found = [0]
    for i, at in enumerate(reversed(range(bits, -1, -STEP))):
        sides = [spark.read.parquet(f"{p}/digests/level={at}") for p in (a, b)]
        if i:
            sides = [s.where(F.shiftright("range", STEP).isin(found)) for s in sides]
        same = F.expr("x.n <=> y.n and x.a <=> y.a and x.b <=> y.b")
        found = [r[0] for r in sides[0].alias("x").join(sides[1].alias("y"), F.expr("x.range = y.range"), "full_outer").where(~same).select(F.coalesce("x.range", "y.range")).collect()]
        if not found:
            return []
    return sorted(found)


def compare(spark: SparkSession, a: str, b: str, keys: list[str], bits: int = BITS) -> DataFrame:
    """(keys, fault): rows that one of two stores lacks (MISSING in the second, UNEXPECTED there), or has otherwise (DIFFERS).

    Only partitions of ranges that differ are read.
    """
    ranges = differing_ranges(spark, a, b, bits)
    sides = [_rows(spark, p, ranges) for p in (a, b)]
    names = sorted(c for c in sides[0].columns if c not in ("range", *keys))
    x, y = (s.select("range", *keys, F.sha2(canonical(F.struct(*names)), 256).alias("own") if names else F.lit("").alias("own")) for s in sides)
    on = " and ".join(f"x.`{k}` <=> y.`{k}`" for k in ("range", *keys))
    both = x.alias("x").join(y.alias("y"), F.expr(on), "full_outer")
    fault = F.when(F.col("y.own").isNull(), "MISSING").when(F.col("x.own").isNull(), "UNEXPECTED").when(F.col("x.own") != F.col("y.own"), "DIFFERS")
    return both.select(*(F.when(F.col("x.own").isNotNull(), F.col(f"x.{k}")).otherwise(F.col(f"y.{k}")).alias(k) for k in keys), fault.alias("fault")).where("fault is not null")
