"""Shared helpers: session settings, shared-folder tables and bounded Arrow blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.storage import materialize, release, shared_folder  # noqa: F401

BLOCK_BYTES = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
UNBOUNDED = ("-1", "-1b", "0", "0b", str(2**63 - 1), f"{2**63 - 1}b", str(2**31 - 1), f"{2**31 - 1}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, not by rows alone, which may be long.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` where the session has no bound of its own; a batch goes
    over it by one row at most.
    """
    conf = df.sparkSession.conf
    if (conf.get(BATCH_SETTING, None) or "-1") in UNBOUNDED:
        conf.set(BATCH_SETTING, str(4 * BLOCK_BYTES))
    return df


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def whole_units(batches: Iterator[pa.RecordBatch], key: str, limit: int = 4 * BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of whole units, rows of one ``key`` that stand together, of about ``limit`` bytes (one unit at least)."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        size += batch.nbytes
        if size >= limit:
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cut = int(starts[-1]) if len(starts) else 0 if held and keys[0] != last else None
            if cut is not None:
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, batch = [], batch.slice(cut)
                size = batch.nbytes
        held.append(batch)
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null is the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").to_pylist()


def extended(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column, whose type is given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def remainder(column: str, by: int):
    """crc32 of an id's decimal text, modulo ``by`` (null ids: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by
