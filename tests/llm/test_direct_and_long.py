"""The discriminant computed another way, tables without rows, and very long texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("weftline.llm.quality")

from weftline.llm import bpe, fingerprints, language_model, media, packing, quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def corpus(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 9)))
    return [" ".join(word() if r.random() < 0.8 else r.choice(["!!", "42", "X", "a.b"]) for _ in range(r.choice([1, 5, 40, 90]))) for _ in range(n)]


def test_scores_are_those_of_the_densities(spark):
    """Means and covariances by numpy's own functions, densities by solving, not by factors; contradicting labels both count."""
    texts = corpus(160, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    marks = [(i, int(len(t) > 60) if i % 7 else i % 2) for i, t in enumerate(texts) if i % 3] + [(10, 0), (10, 1), (11, None), (13, 5), (14, 1), (14, 1)]
    model = quality.fit(docs, spark.createDataFrame([(*m, 0) for m in marks], "doc_id long, quality int, toxic int"))
    known = {m for m in marks if m[1] in (0, 1) and zlib.crc32(str(m[0]).encode()) % 5}
    x = [np.array([quality.features([texts[i]])[0] for i, q in sorted(known) if q == c]) for c in (0, 1)]
    n = [len(v) for v in x]
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    shrunk = [(1 - quality.SHRINK) * c + quality.SHRINK * (pooled + np.diag(np.diag(pooled))) / 2 + 1e-6 * np.eye(len(pooled)) for c in cov]

    def density(v, c):
        away = v - x[c].mean(0)
        return np.log(n[c] / sum(n)) - 0.5 * (np.linalg.slogdet(shrunk[c])[1] + away @ np.linalg.solve(shrunk[c], away))

    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        v = quality.features([t])[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -500, 500))), rel=1e-6, abs=1e-9)


def test_tables_without_rows(spark, tmp_path):
    import corpus_pipeline

    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b", "en", "s", 3), (None, None, None, None, None)], DOCS)
    assert quality.score(docs, quality.fit(docs, labels)).collect() == []
    assert [r.score for r in quality.score(some, quality.fit(some, labels)).collect()] == [0.5, 0.5]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_very_long_texts_are_taken_whole(spark):
    """A text of 1.5 million characters among short ones, through each operator that reads texts."""
    from tokenizers import Tokenizer

    long = " ".join(corpus(4000, 2)) + " é" * 300_000
    texts = [long, "short one", long[:-1], ""]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    encode = Tokenizer.from_file(PATH)
    encode.no_truncation()
    encode.no_padding()
    ids = {i: encode.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    digest = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    for r in bpe.digests(bpe.encode(df, PATH)).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), digest(ids[r.doc_id]), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    pieces = packing.digests(packing.pack(df, PATH)).collect()
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in ids} == {i: len(x) + 1 for i, x in ids.items()}
    for r in media.digests(media.inspect(media.store(df))).collect():
        raw = texts[r.doc_id].encode()
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")).hexdigest()
    scored = {r.doc_id: r for r in language_model.score(df).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {i: len(t.split()) + 1 for i, t in enumerate(texts)} and all(r.score < 0 for r in scored.values())
    prints = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    assert prints[0].n_chars == len(long) and prints[2].near_next < 0.2
    assert fingerprints.fingerprint_edits(df.where("doc_id in (0, 2)")).where("doc_id = 2").first().near_next > 0.8
