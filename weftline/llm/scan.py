"""Running totals within groups of a whole table, in order, at any size of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import materialize


def running(df: DataFrame, group: str, order: list[Column | str], **values: Column) -> DataFrame:
    """``df`` with running totals of integer columns ``values`` within ``group`` (no nulls), in ``order``, own row included.

    Rows are dealt by ranges of group and order, so a group of any size spreads over tasks. Each task sums its own
    range with numpy; what a group brings along from the ranges before is added after, from one row a range. The
    written table goes with ``release``. Order is as total as its columns: rows that tie get their totals in any order.
    """
    names = list(values)
    rows = df.select("*", *(v.cast("long").alias(n) for n, v in values.items()))
    kind = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField("_head", T.BooleanType())])
    at = [rows.columns.index(c) for c in (group, *names)]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, head, last, sums = TaskContext.get().partitionId(), 0, True, None, np.zeros(len(names), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(at[0])
            new = np.zeros(n, bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = place > 0 and key[0].as_py() != last
            run = np.cumsum(new)
            starts = np.flatnonzero(new)
            columns = list(batch.columns)
            for i, c in enumerate(at[1:]):
                own = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                sofar = np.cumsum(own)
                base = np.concatenate(([-sums[i]], sofar[starts] - own[starts]))[run]
                columns[c] = pa.array(sofar - base, pa.int64())
                sums[i] = sofar[-1] - base[-1]
            columns += [pa.array(np.full(n, part, np.int32)), pa.array(place + np.arange(n, dtype=np.int64)), pa.array(head & (run == 0))]
            place, head, last = place + n, head and not len(starts), key[-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    written = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(total, kind), "running")
    edges = written.groupBy("_range").agg(F.min_by(group, "_place").alias("first"), F.max_by(F.struct(F.col(group).alias("group"), *names), "_place").alias("last")).collect()
    carried, before, sums = [], None, [0] * len(names)
    for e in sorted(edges, key=lambda e: e["_range"]):
        sums = sums if before == e.first else [0] * len(names)
        if any(sums):
            carried.append((e["_range"], True, *sums))
        over = sums if e.first == e.last.group else [0] * len(names)  # the range is of one group: what came along goes on
        before, sums = e.last.group, [e.last[n] + s for n, s in zip(names, over)]
    out = written
    if carried:
        more = df.sparkSession.createDataFrame(carried, "_range int, _head boolean, " + ", ".join(f"_more{i} long" for i in range(len(names))))
        joined = written.join(F.broadcast(more), ["_range", "_head"], "left")  # a row a range at most
        out = joined.withColumns({n: F.col(n) + F.coalesce(f"_more{i}", F.lit(0)) for i, n in enumerate(names)})
    out = out.select(*rows.columns)
    out._folder = written._folder
    return out
