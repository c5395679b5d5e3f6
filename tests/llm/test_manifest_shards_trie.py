"""Manifest proofs, shards and prefix tries against brute force, on small tables with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, prefix_trie, sharding
from weftline.llm.common import remainder
from weftline.llm.scan import running

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_running_totals_cross_ranges(spark):
    rows = [(g, i, i % 7) for g in (1, 2, 3, 4) for i in range(3000 if g == 2 else 5)]
    got = running(spark.createDataFrame(rows, "g long, i long, v long").repartition(5), "g", ["i"], total=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == len(rows)
    for g in (1, 2, 3, 4):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.i)
        assert [r.n for r in own] == list(range(1, len(own) + 1))
        assert [r.total for r in own] == np.cumsum([r.v for r in own]).tolist()


# --- manifest


def plain_proofs(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root of a sequence and each leaf's runs (place, run) upwards, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    runs = [[(i // 8**k % 8, levels[k][i // 8**k // 8 * 8 : i // 8**k // 8 * 8 + 8]) for k in range(len(levels) - 1)] for i in range(len(leaves))]
    return levels[-1][0], runs


def plain_manifest(docs: list[tuple], claims: dict[int, str]) -> list[tuple]:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(map(field, (d[0], d[1], d[2], d[3], d[4]))))
    by_lang: dict = {}
    for i, d in enumerate(docs):
        by_lang.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), i))
    if not docs:
        return []
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_proofs([t[2] for t in sorted(by_lang[x])]) for x in langs}
    root, crown = plain_proofs([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, crown):
        for (*_, own, i), runs in zip(sorted(by_lang[x]), trees[x][1]):
            d = docs[i]
            node = leaf((*d[:4], claims[i])) if i in claims else own
            proof = ""
            for place, run in [*runs, *up]:
                proof += "".join(run[:place] + run[place + 1 :])
                node = sha("".join([*run[:place], node, *run[place + 1 :]]))
            out.append((d[0], own, trees[x][0], root, sha(proof), node, node == root))
    return out


def random_docs(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "É a B", "same", "".join(r.choices("aBc \n", k=r.randint(1, 40)))])
    return [(r.choice([None, i, i, i, 5]), r.choice([None, "web", "né"]), r.choice(["en", "en", "en", "en", None, "", "fr", "z", "é"]), r.choice([None, 3]), text()) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_manifest_equals_levels_hashed_one_by_one(spark, n):
    docs = random_docs(n, n)
    table = spark.createDataFrame(docs, DOCS).withColumn("Other", F.lit(1)).repartition(3)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = sorted(map(tuple, merkle.digests(merkle.manifest(table, remainder("doc_id", 3) == 0, lower)).collect()), key=str)
    claims = {i: (d[4].translate({c: c + 32 for c in range(65, 91)}) if d[4] is not None else None) for i, d in enumerate(docs) if zlib.crc32(b"" if d[0] is None else str(d[0]).encode()) % 3 == 0}
    want = sorted(plain_manifest(docs, claims), key=str)
    # rows that tie in id and leaf are the same row: their proofs are dealt among them
    assert got == want


@pytest.mark.parametrize("n, levels, height", [(1, 0, 2), (1, 1, 2), (8, 1, 2), (9, 2, 2), (64, 2, 1), (65, 3, 2), (513, 4, 2), (700, 4, 3), (4096, 4, 2), (1, 4, 2)])
def test_fractal_traversal_gives_every_path(n, levels, height):
    leaves = [sha(str(i)).encode() for i in range(n)]
    rows = [leaves]
    for _ in range(levels):
        rows.append([merkle.node(rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    assert merkle.block_root(leaves, levels) == rows[-1][0]
    for i, (turns, proof) in enumerate(merkle.traverse(leaves, levels, height)):
        runs = [(i // 8**k % 8, rows[k][i // 8**k // 8 * 8 : i // 8**k // 8 * 8 + 8]) for k in range(levels)]
        assert turns == b"".join(b"%d%d" % (p, len(run)) for p, run in runs)
        assert proof == b"".join(x for p, run in runs for j, x in enumerate(run) if j != p)


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = [(i, "s", "en" if i % 50 else None, 1, str(i)) for i in range(600)]
    got = merkle.digests(merkle.manifest(spark.createDataFrame(docs, DOCS), F.lit(False), F.col("text"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(docs, {}), key=str)
    assert all(r.verified for r in got)


# --- shards


def plain_capacity(sizes: list[int], shards: int) -> int:
    """Smallest largest part of consecutive parts, by dynamic programming."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    best = ends[1:].astype(float)
    for _ in range(shards - 1):
        best = np.array([min([best[i], *(max(best[j], ends[i + 1] - ends[j + 1]) for j in range(i))]) for i in range(len(sizes))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    r = random.Random(seed)
    n = r.choice([1, 3, 40, 150])
    shards = r.choice([1, 2, 5, 9])
    keys = sorted({r.randint(-(2**63), 2**63 - 1) for _ in range(n)}) if seed % 2 else sorted(r.sample(range(5000), n))
    sizes = [r.choice([16, 17, 100, r.randint(16, 3000)]) for _ in keys]
    capacity, cuts, alone = sharding.plan(spark.createDataFrame(list(zip(keys, sizes)), "key long, size long"), shards, first_bits=4)
    rest = [(k, s) for k, s in zip(keys, sizes) if k not in alone]
    assert len(alone) < shards or not rest
    if rest:
        assert capacity == plain_capacity([s for _, s in rest], shards - len(alone))
        loads = [0] * (shards - len(alone))
        for k, s in rest:
            loads[sum(k > c for c in cuts)] += s
        assert max(loads) <= capacity
    for k in alone:
        assert sizes[keys.index(k)] * shards > sum(s for _, s in rest)


def test_shards_hold_groups_and_slots(spark):
    r = random.Random(5)
    texts = [None, "", "copy", *("".join(r.choices("abcé ", k=r.randint(0, 300))) for _ in range(500)), "x" * 40_000]
    docs = [(r.choice([None, i]), texts[i % len(texts)] if i % 3 else "copy") for i in range(1200)]
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").withColumn("Shard", F.lit(1)), shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in docs)
    shards: dict = {}
    for row in got:
        shards.setdefault(row.text_crc32, set()).add(row["shard"])
    assert all(len(s) == 1 for s in shards.values())
    for shard in {r["shard"] for r in got}:
        slots = sorted(r.slot for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    loads = sorted((sum(r.size for r in got if r["shard"] == s) for s in range(7)), reverse=True)
    assert loads[0] == 80_032 and loads[1] <= 1.05 * sum(loads[1:]) / 6 + 316 and loads[-1] >= 0.9 * sum(loads[1:]) / 6 - 316
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- tries


def plain_trie(turns: list[tuple]) -> list[tuple]:
    """Nodes by their whole sequences, subtrees by comparing prefixes."""
    order = lambda t: (t[1] is not None, t[1] or 0, hashlib.sha256(f"{len((t[2] or '').encode())}:{t[2] or ''}{t[3] or ''}".encode()).digest())
    own = {c: [(t[2] or "", t[3] or "") for t in sorted(rows, key=order)] for c, rows in groupby(sorted((t for t in turns if t[0] is not None), key=lambda t: t[0]), key=lambda t: t[0])}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + said[h:])
    members: dict = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    out = []
    for path, all_ in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(all_) if built[c] == path)
        childless = [p for p in under if not any(q[:-1] == p for q in members if q)]
        out.append((
            min(all_), len(path), min(members[path[:-1]]) if path else None, len(all_), sum(bool(q) and q[:-1] == path for q in members), len(childless), sum((len(members[p]) - 1) * words(p) for p in under), sha(ends),
        ))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def random_turns(seed: int, convs: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c if r.random() < 0.97 else None, r.choice([i, i, i, None]), r.choice(["user", "user", None]), r.choice(["hi there", "ok", None, "", "a b\tc"])) for i in range(r.choice([0, 1, 1, 2, 3, 6]))]
    return rows + [(40, i, "user", f"turn {i}") for i in range(60)] + [(47, i, "user", f"turn {i}") for i in range(3, 70)]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_whole_sequences(spark, seed):
    turns = random_turns(seed, 120)
    table = spark.createDataFrame(turns, TURNS).withColumn("Depth", F.lit(1)).repartition(3)
    got = prefix_trie.shared_starts(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(turns), key=str)


def test_collisions_are_split(spark):
    """With primes of 2 and 3 nearly all fingerprints collide."""
    turns = [t for t in random_turns(9, 60) if t[0] not in (40, 47)]
    c = F.col("conv")
    built = prefix_trie.rebuild(spark.createDataFrame(turns, TURNS), "conv_id", "turn", "role", "text", c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4)
    assert sorted(map(tuple, prefix_trie.trie(*built, primes=(2, 3)).collect()), key=str) == sorted(plain_trie(turns), key=str)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.shared_starts(spark.createDataFrame([], TURNS)).collect() == []
