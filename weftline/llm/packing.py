"""Packing token sequences into windows by minimum bin slack.

Each task packs its own documents, pool by pool. Whole windows are cut off a document
first; what remains (fewer ids than a window) goes into a pool that is held as counts by
length. A window is seeded with the longest remainder left; a subset-sum programme over
the multiset of the other lengths, held as one integer's bits, finds the filling that
leaves the least slack, and the counts of each length are read back from the saved
states. The same filling is used as often as the counts allow. Slack that no filling
closes is closed by cutting one more remainder, so only the last window of a pool is
padded.

Ids come from the byte-level BPE of ``path``; the ``tiktoken`` encoder is built from that
same file's vocabulary (ids are the ranks) and gives the ``tokenizers`` library's ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import WORDS, byte_symbols
from weftline.llm.common import blocks, bounded, texts

POOL = 20_000


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


def subset_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum comes closest to ``room`` from below.

    Bit ``s`` of a state says that sum ``s`` can be had. Each length is added in
    chunks of 1, 2, 4, ... copies; the states before each chunk are kept, and the
    chosen chunks are read back from the last one.
    """
    mask, state = (1 << (room + 1)) - 1, 1
    chunks: list[tuple[int, int, int]] = []
    full = 1 << room
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            after = (state | (state << (take * length))) & mask
            if after != state:
                chunks.append((length, take, state))
                state = after
            left -= take
            size *= 2
        if state & full:
            break
    at, used = state.bit_length() - 1, {}
    for length, take, before in reversed(chunks):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def fill_windows(counts: dict[int, int], window: int) -> Iterator[tuple[list[int], int, int]]:
    """(lengths, times, slack): fillings of windows until no length is left; empties ``counts``."""
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        used = subset_fill(counts, window - longest) if longest < window else {}
        slack = window - longest - sum(n * c for n, c in used.items())
        times = 1 + min([counts.get(longest, 0) // (1 + used[longest]) if longest in used else counts.get(longest, 0)] + [counts[n] // c - 1 for n, c in used.items() if n != longest])
        if longest in used:  # the seed has been taken already
            times = max(1, min([(counts[longest] + 1) // (used[longest] + 1)] + [counts[n] // c for n, c in used.items() if n != longest]))
        if slack:
            times = 1
        for n, c in used.items():
            counts[n] -= c * times
        if times > 1:
            counts[longest] -= times - 1
        for n in {*used, longest}:
            if n in counts and not counts[n]:
                del counts[n]
        yield [longest, *(n for n, c in used.items() for _ in range(c))], times, slack


def pack_pool(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) that hold each item of ``lengths`` once, cut where slack asks for it."""
    items: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        items.setdefault(n, []).append(i)
    done = [0] * len(lengths)
    counts = {n: len(own) for n, own in items.items()}
    for fill, times, slack in fill_windows(counts, window):
        for _ in range(times):
            out = []
            for n in fill:
                i = items[n].pop()
                out.append((i, done[i], n))
                done[i] += n
            if slack and counts:  # cut what is missing off the longest remainder left
                n = max(counts)
                i = items[n].pop()
                counts[n] -= 1
                if not counts[n]:
                    del counts[n]
                out.append((i, done[i], slack))
                done[i] += slack
                items.setdefault(n - slack, []).append(i)
                counts[n - slack] = counts.get(n - slack, 0) + 1
            yield out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` ids.

    A document is its text's ids, then ``end_id``; null and empty texts are that id
    alone. Each id lies in exactly one piece. ``ids`` are little-endian unsigned 32-bit
    integers. Sequences are filled from offset 0 without gaps; ids of sequences
    are unique (partition, then count), and repeated rows are packed each for itself.
    An empty table gives no pieces. Memory: one pool of remainders, under ``window`` ids each.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path).encode_to_numpy
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        waiting: list[tuple] = []  # doc_id, start, ids, doc_tokens
        out: list[tuple] = []

        def close() -> None:
            nonlocal sequence
            for window_items in pack_pool([len(w[2]) for w in waiting], window):
                offset = 0
                for i, start, n in window_items:
                    doc, first, ids, total = waiting[i]
                    out.append((doc, first + start, n, ids[start : start + n].tobytes(), total, sequence, offset))
                    offset += n
                sequence += 1
            waiting.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for block in blocks(batches):
            for doc, text in zip(block.column(0).to_pylist(), texts(block)):
                ids = np.concatenate((encode(text, allowed_special="all").astype("<u4"), end))
                whole = len(ids) // window * window
                for s in range(0, whole, window):
                    out.append((doc, s, window, ids[s : s + window].tobytes(), len(ids), sequence, 0))
                    sequence += 1
                if whole < len(ids):
                    waiting.append((doc, whole, ids[whole:].copy(), len(ids)))
                if len(waiting) >= pool:
                    close()
            if out:
                yield flush()
        close()
        while out:
            yield flush()

    return bounded(source).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
