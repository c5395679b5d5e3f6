"""Document fingerprints from prefix polynomial hashes.

For a block of texts one modular prefix array is built over all code points; the hash
of any span follows from two of its entries and equal spans have equal hashes, wherever
they stand. A fingerprint holds the text's length, two whole-text hashes and the
smallest mixed hashes of its distinct ``GRAM``-character spans, so two fingerprints
compare without the texts. Longest common extensions of two positions are found by
binary search on span hashes and then checked on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, shuffle_partitions, texts

P = (1 << 31) - 1
BASE = 1_000_003_937 % P
SECOND = 918_273_645
GRAM = 8
SKETCH = 48


def reduce_mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for 0 <= x < 2^62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


class Powers:
    """Powers of the bases and inverse powers of the first, grown as needed; one per Python worker."""

    def __init__(self) -> None:
        self.up = self.down = self.other = np.ones(1, np.int64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down, self.other = (self._run(b, n) for b in (BASE, pow(BASE, -1, P), SECOND))

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) < n:  # doubling: the next stretch is the first times a power
            out = np.concatenate((out, reduce_mod(out * pow(base, len(out), P))))
        return out


POWERS = Powers()


class Prefixes:
    """Prefix array over several texts; spans are given by places in their concatenation."""

    def __init__(self, many: list[str]):
        self.points = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        size = np.fromiter(map(len, many), np.int64, len(many))
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        POWERS.reach(len(self.points) + 1)
        self.array = np.concatenate(([0], reduce_mod(np.cumsum(reduce_mod(self.points * POWERS.up[: len(self.points)])))))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans, the same for the same characters at any place."""
        return reduce_mod(reduce_mod(self.array[ends] - self.array[starts] + P) * POWERS.down[starts])

    def equal(self, i: int, j: int, n: int) -> bool:
        at = np.array([i, j])
        a, b = self.spans(at, at + n)
        return bool(a == b)

    def extension(self, i: int, j: int, most: int) -> int:
        """Length of the longest common extension of places ``i`` and ``j``, ``most`` at most."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, j, mid) else (low, mid - 1)
        return low

    def sketches(self, gram: int = GRAM, keep: int = SKETCH) -> list[str]:
        """A fingerprint of each text: length, whole-text hashes, sorted smallest gram hashes."""
        whole = self.spans(self.starts, self.ends)
        weighed = self.points * 1_315_423_911 % P
        n = len(self.points)
        at = np.arange(max(0, n - gram + 1))
        grams = _mixed(self.spans(at, at + gram)) if len(at) else np.empty(0, np.uint32)
        out = []
        for k, (s, e) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            if e - s >= gram:
                own = grams[s : e - gram + 1]
                low = own
                if len(own) > 4 * keep:  # the smallest distinct ones lie under a first guess of a bound, mostly
                    bound = np.uint32(min(0xFFFFFFFF, int(3 * keep / len(own) * 2**32)))
                    low = own[own <= bound]
                chosen = np.unique(low)
                if len(chosen) < keep and len(low) < len(own):
                    chosen = np.unique(own)
                chosen = chosen[:keep]
            elif e > s:
                chosen = _mixed(whole[k : k + 1] + (e - s))
            else:
                chosen = np.empty(0, np.uint32)
            second = int(reduce_mod(np.cumsum(reduce_mod(weighed[s:e] * POWERS.other[: e - s])))[-1]) if e > s else 0
            out.append(f"{e - s:x}.{int(whole[k]):08x}{second:08x}." + chosen.astype(">u4").tobytes().hex())
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints' gram sets: 1 for equal ones, 0 where one is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)
    # a sketch that is not full holds all of its text's grams
    keep = min(len(f) for f in (x, y) if len(f) >= SKETCH) if max(len(x), len(y)) >= SKETCH else len(both)
    both = both[: max(keep, 1)]
    return float(np.isin(both, x).__and__(np.isin(both, y)).sum() / len(both))


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the next document's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, common_suffix long"


def with_following(df: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of descending id, each partition sorted, with copies of the row that follows it.

    Range bounds are approximate quantiles of the ids, so no partition holds all rows. The
    row after a partition's last one is added to it with ``extra`` true (a row per partition,
    more if its id repeats). Ties of ids are in the order of texts; null ids come last. Rows
    of one id stand in one partition, which streams them.
    """
    spark = df.sparkSession
    parts = parts or shuffle_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cut = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cut), reverse=True)
    bounds = spark.sparkContext.broadcast(np.array(cuts[::-1], np.int64))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:  # a binary search: the number of bounds above an id
        return pd.Series(len(bounds.value) - bounds.value.searchsorted(doc_id, side="right")).astype("int32")

    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(part_of(F.coalesce("doc_id", F.lit(0))))
    heads = sorted(ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # a row per partition
    given = spark.createDataFrame([(heads[(i + 1) % len(heads)].head, heads[i].part) for i in range(len(heads))], "head long, part int")
    extra = rows.join(F.broadcast(given), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "part", F.lit(True).alias("extra"))
    both = rows.withColumns({"part": part, "extra": F.lit(False)}).unionByName(extra)
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    ``common_prefix`` and ``common_suffix`` are longest common extensions (code points) of
    the text and its edited text. Null is the empty text; a single row follows itself;
    repeated rows get a row each. One shuffle, by ranges of ids.
    """
    if not df.take(1):
        return df.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (doc_id, text, part) whose follower has not come by
        for block in blocks(batches, limit=1 << 20):
            pairs = []
            for doc, text, part, extra in zip(block.column(0).to_pylist(), texts(block), block.column(2).to_pylist(), block.column(3).to_pylist()):
                if held is not None:
                    pairs.append((held[0], held[1], text))
                held = None if extra else (doc, text, part)
            if pairs:
                yield describe(pairs)

    return bounded(with_following(df, id_col, text_col, parts)).mapInArrow(run, SCHEMA)


def describe(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """Output rows for (doc_id, text, following text)."""
    many: list[str] = []
    for _, text, following in rows:
        many += [text, edit(text, following)]
    many.append(rows[-1][2])
    prefixes = Prefixes(many)
    prints = prefixes.sketches()
    starts, out = prefixes.starts.tolist(), []
    for k, (doc, text, following) in enumerate(rows):
        changed, i, j, n = many[2 * k + 1], starts[2 * k], starts[2 * k + 1], min(len(text), len(many[2 * k + 1]))
        front = prefixes.extension(i, j, n)
        if text[:front] != changed[:front]:  # two spans of one hash
            front = next(x for x in range(n) if text[x] != changed[x])
        back = _suffix(prefixes, i + len(text), j + len(changed), n - front)
        if back and text[-back:] != changed[-back:]:
            back = next(x for x in range(n - front) if text[-1 - x] != changed[-1 - x])
        after = prints[2 * k + 2] if many[2 * k + 2] == following else Prefixes([following]).sketches()[0]
        own, new = prints[2 * k], prints[2 * k + 1]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, after), front, back))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split(" ")[0] for c in SCHEMA.split(", ")])


def _suffix(prefixes: Prefixes, i: int, j: int, most: int) -> int:
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if prefixes.equal(i - mid, j - mid, mid) else (low, mid - 1)
    return low
