"""Registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_trie, chat_format, conversation_trie, decontaminate, parity_join, secret_scan, sharding, token_counts, toxicity, url_templates, warc,
    weighted_sampling, whitening,
)
from .url_templates import Rule

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 40
PROBE = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [Rule(True, "org/"), Rule(False, "example.org/es/"), Rule(False, "example.org/en/1"), Rule(True, "com/fr/"), Rule(False, "com/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return url_templates.judge(table(spark, sf_dir, "pages"), labels, RULES)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join_documents(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(PROBE))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return token_counts.count_tokens(docs, VOCABULARY).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), tree, sharding.grow(tree))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS set FROM s GROUP BY r),
u AS MATERIALIZED (SELECT min(r) AS r, set, any_value(n) AS n FROM c GROUP BY set),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r < b.r WHERE a.r IN (SELECT r FROM u) AND b.r IN (SELECT r FROM u) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN u x ON x.r = a JOIN u y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
v AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
t(a, b) AS (SELECT r, r FROM u UNION SELECT t.a, v.b FROM t JOIN v ON v.a = t.b),
m AS (SELECT t.a AS r, min(d.doc_id) AS component_id FROM t JOIN u ON u.r = t.b JOIN c USING (set) JOIN d ON d.r = c.r GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN u ON u.set = c.set LEFT JOIN m ON m.r = u.r""",
    "op3_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM m)),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
h AS (SELECT r, item_id, i, x.n FROM x JOIN t ON x.n = t.n AND x.s = t.s),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, sha1(h) AS digest, strlen(h) AS bytes FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM g)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m""",
    "op6_chat": rf"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
t AS (SELECT *, len(text) + len(text) - len(replace(text, '\', '')) + len(text) - len(replace(text, '<', '')) AS wide FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(wide + len(role) + 21) + 15)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op12_conversation_trie": rf"""
WITH t AS (SELECT conv_id, md5(concat(strlen(role), ':', role, text)) AS id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
l AS MATERIALIZED (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id),
k AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))) % 4 AS h FROM l),
r AS MATERIALIZED (SELECT k.conv_id, list_concat(coalesce(b.turns, [])[1:k.h], k.turns[k.h + 1:]) AS turns FROM k LEFT JOIN l b ON b.conv_id = k.conv_id - k.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
q AS MATERIALIZED (SELECT conv_id, n, depth, md5(array_to_string(list_transform(turns[1:depth], lambda x: x.id), ',')) AS key,
      CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.id), ',')) END AS up, coalesce(turns[depth].words, 0) AS words FROM p),
m AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, any_value(up) AS up, any_value(words) AS words, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY key, depth),
c AS (SELECT up, count(*) AS n FROM m GROUP BY up),
f AS MATERIALIZED (SELECT m.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * words AS own FROM m LEFT JOIN c ON c.up = m.key),
s AS (SELECT q.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.own) AS saved_tokens FROM f JOIN q ON q.conv_id = f.conv_id AND q.depth <= f.depth GROUP BY q.key)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.key = f.key LEFT JOIN m u ON u.key = f.up""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_jaccard, op3_decontaminate, op4_warc, op5_bpe, op6_chat, op7_fingerprints, op8_token_counts, op9_toxicity, op10_sharding,
        op11_whitening, op12_conversation_trie, op13_secret_scan,
    )
}
