"""Registered queries of the numbered operators, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, fingerprints, html_text, jaccard_join, language_model, media, merkle, packing, prefix_trie, quality, secrets, sharding
from weftline.llm.common import remainder, table

#: Vocabulary used by the queries; operators take it as a parameter.
VOCABULARY = "byte_bpe_50k.json"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.find(docs, dictionary=public_tokenizers.path(VOCABULARY)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.inspect(media.store(table(spark, sf_dir, "documents"))))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


#: The conversation whose texts are control strings.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "conv_id long, turn long, role string, text string"
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.read_back(chat.format_turns(rows.unionByName(spark.createDataFrame(MARKED, kind))))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.join(docs, row=jaccard_join.file_row(docs))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = remainder("doc_id", 3) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.digests(merkle.manifest(table(spark, sf_dir, "documents"), tampered, lower))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_starts(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_quality, op3_media_columns, op4_language_model, op5_packing, op6_bpe, op7_fingerprints, op8_chat, op9_jaccard_join, op10_html, op11_merkle, op12_sharding, op13_prefix_trie,
    )
}

#: crc32 of the text of an id, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce({0}::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"


def _manifest_sql(levels: int = 12) -> str:
    """Levels one after another: runs of 8 for each language, then of the languages' roots; enough for 8 ** ``levels`` rows."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"
    out = [
        f"WITH leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_CRC.format('doc_id')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claim FROM documents), "
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g FROM leaves), "
        "a0 AS (SELECT g, spot, leaf AS node FROM placed)"
    ]

    def climb(of: str, top: str) -> None:
        for k in range(levels):
            out.append(f"{of}r{k} AS (SELECT g, spot // 8 AS spot, list(node ORDER BY spot) AS run, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {of}{k}) GROUP BY g, spot // 8)")
            out.append(f"{of}{k + 1} AS (SELECT g, spot, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {of}r{k})")
        out.append(f"{top} AS (SELECT g, node FROM {of}{levels})")

    climb("a", "subroots")
    out.append("b0 AS (SELECT 1 AS g, row_number() OVER (ORDER BY g) - 1 AS spot, node FROM subroots)")
    climb("b", "roots")
    out.append("p0 AS (SELECT placed.*, '' AS proof, claim AS node, spot AS pos FROM placed)")
    step = 0
    for of, key, start in (("a", "p.g", None), ("b", "1", "g - 1")):
        if start:
            out.append(f"p{step + 1} AS (SELECT * REPLACE ({start} AS pos) FROM p{step})")
            step += 1
        for k in range(levels):
            others = "array_to_string(list_filter(r.run, lambda x, i: i <> p.pos % 8 + 1), '')"
            whole = "array_to_string(r.run[:p.pos % 8], '') || p.node || array_to_string(r.run[p.pos % 8 + 2:], '')"
            out.append(f"p{step + 1} AS (SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN p.proof || {others} ELSE p.proof END AS proof, CASE WHEN r.n > 1 THEN sha256({whole}) ELSE p.node END AS node, p.pos // 8 AS pos) FROM p{step} p JOIN {of}r{k} r ON r.g = {key} AND r.spot = p.pos // 8)")
            step += 1
    out = [o.replace(" AS (", " AS MATERIALIZED (", 1) if i else o for i, o in enumerate(out)]
    return ", ".join(out) + f" SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, p.node AS folded_root, p.node = r.node AS verified FROM p{step} p JOIN subroots s ON s.g = p.g CROSS JOIN roots r"


_TRIE_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT v.c, o.i AS place, role, text FROM convs v JOIN own o ON o.c = v.c - v.c % 20 AND o.i <= h UNION ALL SELECT v.c, o.i + 1000000 AS place, role, text FROM convs v JOIN own o ON o.c = v.c AND o.i > h),
paths AS (SELECT v.c, coalesce(list(sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) ORDER BY place) FILTER (place IS NOT NULL), []) AS path, coalesce(list(text ORDER BY place) FILTER (place IS NOT NULL), []) AS texts FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c),
prefixes AS (SELECT c, d, path[:d] AS p, len(path) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(texts[d], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM paths, unnest(range(len(path) + 1)) AS u(d)),
nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, min(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM prefixes GROUP BY d, p),
grown AS (SELECT a.*, u.c AS parent, (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.p[:a.d] = a.p) AS children FROM nodes a LEFT JOIN nodes u ON u.d = a.d - 1 AND u.p = a.p[:a.d - 1])
SELECT a.c AS conv_id, a.d::BIGINT AS depth, a.parent AS parent_conv_id, a.n::BIGINT AS n_convs, a.children::BIGINT AS n_children, count(*) FILTER (s.children = 0)::BIGINT AS n_leaves, sum((s.n - 1) * s.words)::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM grown a JOIN grown s ON s.d >= a.d AND s.p[:a.d] = a.p GROUP BY ALL
"""

#: The other operators run models, set joins, tokenizers or a hash of their own.
ORACLE_SQL = {"op11_merkle": _manifest_sql(), "op13_prefix_trie": _TRIE_SQL}
