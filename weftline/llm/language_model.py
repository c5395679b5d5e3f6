"""Deleted interpolation: a trigram model whose mixture weights depend on the context's frequency.

The probability of a word is a mix of its maximum-likelihood estimate after the two words
before it, after the one before it, without context, and a uniform one. Each level is mixed
with the levels below it by a weight per bucket of context frequency. The weights are learned
by expectation-maximisation on held-out training documents, against the counts of the other
training documents, from the lowest level up. Scores use all training counts; from these a
training document's own are deleted before it is scored, so that no text predicts itself and
scores of training and held-out documents compare.

Texts are hashed once into chunks: arrays of distinct word hashes and each word's place in
them. Each chunk asks for the corpus counts of its distinct words, bigrams and trigrams, by
ranges of keys; each range adds up the chunks' own counts and answers. No table of counts is
held whole anywhere, a frequent word is one entry per chunk, and what is gathered grows with
the corpus. Held-out evidence reaches the driver as a histogram per level over a fixed grid.

Words keep 64-bit keys. Keys of bigrams and trigrams keep as many bits as make two distinct
ones of the corpus meet with a probability below 2**-``SPARE_BITS`` for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, materialize, shuffle_partitions, texts
from weftline.llm.packed import slices_by_bucket, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys
from weftline.llm.tokens import mix, word_hashes

CHUNK_BYTES = 4 << 20
PART_TOKENS = 1 << 20  # per range of keys, at least: bounds what a range adds up
RANGES_TO_TASK, CHUNKS_TO_TASK = 8, 4  # about, one after the other: each task writes a file, for which Hadoop may start processes
KEPT, HELD, JUDGED = 0, 1, 2  # training counts; training documents that weights are learned on; scored only
END, BEGIN = np.uint64(0x5EED_0000_0000_0001), np.uint64(0x5EED_0000_0000_0002)
BUCKETS = 40  # of context frequency, by powers of two
STEP, LEVELS = 0.01, 2400  # the grid of held-out evidence: log10 of an estimate over that of the levels below it
SPARE_BITS = 14  # of a bigram's or trigram's key, beyond those that count the corpus's tokens
STORE = "chunk long, kind int, tokens long, doc_ids array<long>, sizes binary, words binary, stream binary"
ASKED = "part int, chunk long, kind int, keys binary, own binary"
EVIDENCE = "bucket_one binary, bucket_two binary, bucket_three binary, one binary, two binary, three binary"
ANSWERS = "chunk long, kind int, part int, total binary, held binary, n long, n_held long, v long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def chunks(df: DataFrame, id_col: str, text_col: str, fold: int, judged: int, held_of: int) -> DataFrame:
    """Documents as rows of arrays; a row holds documents of one kind, about ``CHUNK_BYTES`` of text."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    kind = F.when(crc % fold == judged, JUDGED).when(F.floor(crc / fold) % held_of == 0, HELD).otherwise(KEPT)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), kind.cast("int").alias("kind"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {k: [] for k in (KEPT, HELD, JUDGED)}
        held: dict[int, int] = dict.fromkeys(waiting, 0)

        def close(kind: int) -> pa.RecordBatch:
            nonlocal number
            ids = [i for part in waiting[kind] for i in part[0]]
            words, sizes = (np.concatenate([p[i] for p in waiting[kind]]) for i in (1, 2))
            stream = np.insert(words, np.cumsum(sizes), END)
            distinct, places = np.unique(stream, return_inverse=True)
            row = [number, kind, len(stream), ids, squeeze((sizes + 1).astype("<u4")), squeeze_keys(distinct, 64), squeeze(places.astype("<u4"))]
            waiting[kind].clear()
            held[kind] = 0
            number += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split(" ")[0] for c in STORE.split(", ")])

        for block in blocks(batches):
            kinds = np.array(block.column(1).to_pylist())
            for k in np.unique(kinds).tolist():
                own = block.filter(pa.array(kinds == k))
                many = texts(own)
                words, sizes = word_hashes(many)
                waiting[k].append((own.column(0).to_pylist(), words, sizes))
                held[k] += sum(map(len, many))
                if held[k] >= CHUNK_BYTES:
                    yield close(k)
        for k in waiting:
            if waiting[k]:
                yield close(k)

    return bounded(rows).mapInArrow(run, STORE)


class Chunk:
    """A stored chunk with its bigrams and trigrams."""

    def __init__(self, doc_ids: list, sizes: bytes, words: bytes, stream: bytes):
        self.doc_ids, self.sizes = doc_ids, unsqueeze(sizes, "<u4").astype(np.int64)
        self.words = np.append(unsqueeze_keys(words, 64), BEGIN)  # the last is the context of first words
        self.stream = unsqueeze(stream, "<u4").astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.words)
        self.before = self._previous(self.stream, n - 1)
        self.pair, self.pair_keys = self._joined(self.before, self.words, 3)
        self.pair_before = self._previous(self.pair, len(self.pair_keys))  # the place past the last: no pair before
        self.triple, self.triple_keys = self._joined(self.pair_before, np.append(self.pair_keys, BEGIN), 5)

    def _previous(self, ids: np.ndarray, none: int) -> np.ndarray:
        """Of each token, the id of the token before it in its document."""
        before = np.concatenate((np.array([none], np.int32), ids[:-1]))
        before[self.starts] = none
        return before

    def _joined(self, before: np.ndarray, context_keys: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the place of it and its context among the chunk's sorted keys of these; the keys."""
        n = len(self.words)
        codes, at = np.unique(before.astype(np.int64) * n + self.stream, return_inverse=True)
        keys = mix(mix(context_keys[codes // n]) + self.words[codes % n] * np.uint64(weight))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return place[at], keys[order]

    def counts(self) -> list[np.ndarray]:
        """Of the chunk's own words (without the begin mark), bigrams and trigrams."""
        return [np.bincount(ids, minlength=len(keys)) for ids, keys in ((self.stream, self.words[:-1]), (self.pair, self.pair_keys), (self.triple, self.triple_keys))]

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Of each token, how often its id occurs in its document."""
        document = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        order = np.argsort(ids, kind="stable")  # a document's equal ids stay together
        ids, document = ids[order], document[order]
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (document[1:] != document[:-1]))))
        often = np.diff(np.append(first, len(ids)))
        out = np.empty(len(ids), np.float64)
        out[order] = np.repeat(often, often)
        return out


class Told:
    """A chunk with the corpus counts of each token, its bigram, its trigram and their contexts."""

    def __init__(self, store: pa.Table, answers: pa.Table, parts: int, without_held: bool = False):
        row = store.to_pylist()[0]
        self.chunk = chunk = Chunk(row["doc_ids"], row["sizes"], row["words"], row["stream"])
        levels: list[list[np.ndarray]] = [[], [], []]
        for r in sorted(answers.select(["part", "total", "held"]).to_pylist(), key=lambda r: r["part"]):
            counts = unsqueeze(r["total"], "<u8")
            levels[r["part"] // parts].append(counts - unsqueeze(r["held"], "<u8") if without_held else counts)
        words, pairs, triples = (np.concatenate(x).astype(np.float64) for x in levels)
        end = words[int(np.searchsorted(chunk.words[:-1], END))]  # the begin mark stands once before each document
        self.one, self.two, self.three = words[chunk.stream], pairs[chunk.pair], triples[chunk.triple]
        self.context_two, self.context_three = np.append(words, end)[chunk.before], np.append(pairs, end)[chunk.pair_before]

    def delete_own(self) -> None:
        """Take each document's own counts away."""
        chunk = self.chunk
        self.context_two -= chunk.own(chunk.before)
        self.context_three -= chunk.own(chunk.pair_before)
        for name, ids in (("one", chunk.stream), ("two", chunk.pair), ("three", chunk.triple)):
            setattr(self, name, getattr(self, name) - chunk.own(ids))

    def levels(self, tokens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Estimates and buckets of all levels; ``tokens`` is the number of training tokens, for each token."""
        counts, contexts = (self.one, self.two, self.three), (tokens, self.context_two, self.context_three)
        return [_over(a, b) for a, b in zip(counts, contexts)], [np.minimum(tokens, 1).astype(np.int64), *map(buckets, contexts[1:])]


def ask(store: DataFrame, parts: int, bits: int) -> DataFrame:
    """Keys and own counts of each chunk by range of keys: parts 0.. for words, ``parts``.. for bigrams, 2 ``parts``.. for trigrams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["doc_ids"], row["sizes"], row["words"], row["stream"])
                for level, keys, own in zip(range(3), (chunk.words[:-1], chunk.pair_keys, chunk.triple_keys), chunk.counts()):
                    size = bits if level else 64
                    out = [(level * parts + int(b), row["chunk"], row["kind"], squeeze_keys(keys[s:e], size), squeeze(own[s:e].astype("<u4"))) for b, s, e in zip(*slices_by_bucket(keys, parts))]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split(" ")[0] for c in ASKED.split(", ")])

    return bounded(store).mapInArrow(run, ASKED)


def answer(asked: DataFrame, parts: int, bits: int) -> DataFrame:
    """Corpus counts for each chunk's keys (all training documents; those held out apart, for chunks of these).

    A row with chunk -1 per part has the part's number of training tokens, held-out ones and distinct keys.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unsqueeze_keys(r["keys"], 64 if r["part"] < parts else bits) for r in rows]
        size = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate([unsqueeze(r["own"], "<u4") for r in rows]).astype(np.float64)
        kind = np.repeat([r["kind"] for r in rows], size)
        held = np.bincount(at, weights=own * (kind == HELD), minlength=len(distinct))
        total = held + np.bincount(at, weights=own * (kind == KEPT), minlength=len(distinct))
        out, s = [], 0
        for r, n in zip(rows, size):
            own_at = at[s : s + n]
            s += n
            out.append((r["chunk"], r["kind"], r["part"], squeeze(total[own_at].astype("<u8")), squeeze(held[own_at].astype("<u8")) if r["kind"] == HELD else None, None, None, None))
        out.append((-1, -1, rows[0]["part"], None, None, int(total.sum()), int(held.sum()), int((total > 0).sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split(" ")[0] for c in ANSWERS.split(", ")])

    return asked.groupBy("task", "part").applyInArrow(run, ANSWERS)


def _tasks(df: DataFrame, groups: int, to_task: int) -> int:
    """Tasks that take ``groups`` in turn, ``to_task`` each or fewer on average."""
    return max(shuffle_partitions(df.sparkSession), -(-groups // to_task))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    tasks = _tasks(rows, parts, RANGES_TO_TASK)
    return rows.withColumn("task", F.col("part") % tasks).repartitionById(tasks, "task")


def _task_of(tasks: int):
    """Of a chunk, its task: those of a partition go to tasks side by side; partitions begin at steps of the golden section, which spreads any number of them."""
    step = next(a for a in range(max(1, round(tasks * 0.618)), 0, -1) if math.gcd(a, tasks) == 1)
    return ((F.shiftright("chunk", 32) * step + F.col("chunk").bitwiseAND(0xFFFFFFFF)) % tasks).cast("int")


def buckets(context: np.ndarray) -> np.ndarray:
    """Bucket of each context count: 0 for none, then by powers of two."""
    return np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def level_of(ratio: np.ndarray) -> np.ndarray:
    """Level of a ratio of estimates on the grid; 0 for an estimate of 0."""
    found = np.rint(np.log10(np.maximum(ratio, 1e-300)) / STEP).astype(np.int64) + LEVELS // 2
    return np.where(ratio > 0, np.clip(found, 1, LEVELS - 1), 0)


def learn(cells: np.ndarray, often: np.ndarray, logs: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weight of a level, for each bucket, that maximises the held-out likelihood, by expectation-maximisation.

    ``cells`` are bucket * ``LEVELS`` + level of the estimate over that of the levels below; ``often``
    and ``logs`` are a cell's number of tokens and the sum of their ratios' logarithms, so that a
    cell stands at its mean and the grid's width counts by its square only.
    Buckets without held-out evidence take the weight learned over all; half a token is added
    to each side, so no weight is 0 or 1, but for bucket 0 (an unseen context), where it is 0.
    """
    bucket, level = cells // LEVELS, cells % LEVELS
    ratio = np.where(level > 0, np.exp(logs / often), 0.0)
    used = bucket > 0
    bucket, ratio, often = bucket[used], ratio[used], often[used]

    def run(group: np.ndarray, n: int) -> np.ndarray:
        weights, total = np.full(n, 0.5), np.bincount(group, weights=often, minlength=n)
        for _ in range(rounds):
            share = weights[group] * ratio
            share = often * share / (share + 1 - weights[group])
            weights = (np.bincount(group, weights=share, minlength=n) + 0.5) / (total + 1)
        return weights

    weights = np.where(np.bincount(bucket, weights=often, minlength=BUCKETS) > 0, run(bucket, BUCKETS), run(np.zeros(len(bucket), np.int64), 1)[0])
    weights[0] = 0
    return weights


def mixed(weights: list[np.ndarray], v: int, estimates: list[np.ndarray], buckets_of: list[np.ndarray]) -> np.ndarray:
    """Probabilities by the levels whose weights are given, from the estimates of all levels, the lowest first."""
    p = np.full(len(estimates[0]), 1 / (v + 1))
    for w, estimate, bucket in zip(weights, estimates, buckets_of):
        p = w[bucket] * estimate + (1 - w[bucket]) * p
    return p


def _learned(evidence: DataFrame, v: int) -> list[np.ndarray]:
    """Weights of the three levels, each from a pass over the evidence that gives a histogram."""
    weights: list[np.ndarray] = []
    for level in range(3):

        def histogram(batches: Iterator[pa.RecordBatch], level: int = level, weights: tuple = tuple(weights)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    estimates = [unsqueeze(row[c], "<f4").astype(np.float64) for c in ("one", "two", "three")]
                    buckets_of = [unsqueeze(row[c], "u1").astype(np.int64) for c in ("bucket_one", "bucket_two", "bucket_three")]
                    ratio = estimates[level] / mixed(weights, v, estimates, buckets_of)
                    cells, at, often = np.unique(buckets_of[level] * LEVELS + level_of(ratio), return_inverse=True, return_counts=True)
                    logs = np.bincount(at, weights=np.log(np.where(ratio > 0, ratio, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(often, pa.int64()), pa.array(logs)], ["cell", "often", "logs"])

        found = evidence.mapInArrow(histogram, "cell long, often long, logs double").groupBy("cell").agg(F.sum("often").alias("often"), F.sum("logs").alias("logs"))
        cells = sorted(found.collect())  # at most BUCKETS * LEVELS
        weights.append(learn(np.array([r.cell for r in cells], np.int64), np.array([r.often for r in cells], float), np.array([r.logs for r in cells], float)))
    return weights


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, judged: int = 1, held_of: int = 10, parts: int | None = None) -> DataFrame:
    """Log10 probabilities of all whole texts, by the mixture and by the additive base model.

    Training documents are those whose crc32(doc_id) modulo ``fold`` isn't ``judged``; one in
    ``held_of`` of these is held out for the weights. ``score`` of a training document is by
    the counts of all others; ``base_score`` and ``n_known`` are by all counts. Null and empty
    texts are the end mark alone. Repeated rows count and are scored each for itself; other
    columns aren't read. Without (other) training documents the mix is uniform, over the
    training words and one unknown word. An empty table gives no rows.
    """
    spark = df.sparkSession
    store = materialize(chunks(df, id_col, text_col, fold, judged, held_of), "chunks")
    tokens, n_chunks = store.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if not parts:
        parts = max(shuffle_partitions(spark), -(-tokens // PART_TOKENS))
    bits = min(64, max(32, int(tokens).bit_length() + SPARE_BITS))
    answers = materialize(answer(_dealt(ask(store, parts, bits), 3 * parts), parts, bits), "counts")
    sums = answers.where("chunk = -1")
    n, n_held, v = sums.where(F.col("part") < parts).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_held"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    given = answers.where("chunk >= 0").select("chunk", "kind", "part", "total", "held")
    tasks = _tasks(store, n_chunks, CHUNKS_TO_TASK)

    def together(mine: DataFrame, theirs: DataFrame, run, schema: str) -> DataFrame:
        one, two = (x.withColumn("task", _task_of(tasks)).repartitionById(tasks, "task").groupBy("task", "chunk") for x in (mine, theirs))
        return one.cogroup(two).applyInArrow(run, schema)

    def evidence(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        told = Told(mine, theirs, parts, without_held=True)
        estimates, buckets_of = told.levels(np.full(len(told.one), float(n - n_held)))
        out = [squeeze(b.astype(np.uint8)) for b in buckets_of] + [squeeze(e.astype("<f4")) for e in estimates]
        return pa.Table.from_arrays([pa.array([x], pa.binary()) for x in out], names=[c.split(" ")[0] for c in EVIDENCE.split(", ")])

    held_store, held_given = (x.where(F.col("kind") == HELD) for x in (store, given))
    weights = _learned(materialize(together(held_store, held_given, evidence, EVIDENCE), "evidence"), v)

    def judge(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        told = Told(mine, theirs, parts)
        chunk, kind = told.chunk, mine.column("kind")[0].as_py()
        known, base = told.one > 0, np.log10((told.one + 0.5) / (n + 0.5 * (v + 1)))
        tokens = np.full(len(known), float(n))
        if kind != JUDGED:
            told.delete_own()
            tokens -= np.repeat(chunk.sizes, chunk.sizes)
        p = mixed(weights, v, *told.levels(tokens))
        add = lambda x: np.add.reduceat(x, chunk.starts)
        size = len(chunk.doc_ids)
        return pa.table({
            "doc_id": pa.array(chunk.doc_ids, pa.int64()), "held_out": pa.array([kind == JUDGED] * size), "n_tokens": pa.array(chunk.sizes), "n_known": pa.array(add(known.astype(np.int64))),
            "train_tokens": pa.array([int(n)] * size, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
        })

    return together(store, given, judge, SCORES)
