"""Joins with blocks so small that clusters and groups are cut, against all pairs."""

import numpy as np
import pytest

pytest.importorskip("weftline.llm.jaccard_join")

from weftline.llm import jaccard_join as jj  # noqa: E402

KIND = "doc_id long, text string"


def corpus(n=70, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 else [f"u{i % 9}x{j}" for j in range(40 + i % 7)]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{int(rng.integers(0, 30))}"
        out.append(" ".join(words))
    return out


def brute(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block, cluster, weight, leaders", [(8192, 3, 10**6, 2), (8192, 10**6, 200, 1), (2, 4, 10**6, 0), (8192, 2, 100, 1)])
def test_cut_clusters_and_groups_lose_no_link(spark, monkeypatch, block, cluster, weight, leaders):
    for name, value in (("BLOCK", block), ("CLUSTER", cluster), ("WEIGHT", weight), ("LEADERS", leaders)):
        monkeypatch.setattr(jj, name, value)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(docs).collect())
    assert got == brute(texts)


def test_all_pairs_of_fitting_blocks(monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 60, 50))
    weights = rng.integers(1, 4, 50)
    spans = jj.fitting_blocks(sizes, weights, 80)
    together = set()
    for a, b, x, y in spans:
        assert weights[a:b].sum() + weights[x:y].sum() <= 2 * (4 + 3)
        own = [*range(a, b), *range(x, y)]
        together |= {(i, j) for i in own for j in own if i < j}
    for i in range(50):
        for j in range(i + 1, 50):
            if sizes[i] * 100 >= sizes[j] * 80:
                assert (i, j) in together


def test_signatures_of_any_length_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 511, 512, 513, 600, 1023, 1025, 5000):
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate((own[n // 9 :], rng.integers(0, 2**63, n // 9, dtype=np.uint64))))
        a, b = (np.frombuffer(jj.signature(x), np.uint8) for x in (own, other))
        while len(a) != len(b):
            long = max(a, b, key=len)
            half = long[: len(long) // 2] ^ long[len(long) // 2 :]
            a, b = (half if x is long else x for x in (a, b))
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(own, other))


def test_files_give_rows_keys_of_their_own(spark, tmp_path):
    texts = corpus(30)
    spark.createDataFrame([*enumerate(texts), (0, texts[0]), (0, texts[0])], KIND).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    row = jj.file_row(docs)
    assert row is not None and jj.file_row(spark.range(3)) is None
    got = sorted((r.doc_id, r.component_id) for r in jj.join(docs, row=row).collect())
    want = [(i, c) for i, _, c in brute(texts)]
    assert got == sorted([*want, want[0], want[0]])
    assert sorted(r.doc_id for r in jj.keep_one(docs, row=row).collect()) == sorted({c for _, c in want})


def test_batches_are_bounded_by_bytes(spark):
    from weftline.llm.common import BATCH_SETTING, bounded

    spark.conf.unset(BATCH_SETTING)
    rows = bounded(spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) as text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 300 and max(found) < 50
    spark.conf.set(BATCH_SETTING, "1m")
    bounded(rows)
    assert spark.conf.get(BATCH_SETTING) == "1m"  # a bound of the session's own stays
    spark.conf.unset(BATCH_SETTING)
