"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_path
from . import (block_search, bpe, chat, decontaminate, prefix_trie, quality, quartile_digest, secret_scan, token_counts,
               url_rules, warc, whitening)
from .common import table
from .simhash import near_duplicates
from .tokens import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash groups of documents: 3-word shingles, links at two or fewer of 64 bits."""
    found = near_duplicates(table(spark, sf, "documents"), words=3, lanes=1, segments=2, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


BASE = "filter(spans, s -> s.kind <> 'novel')"


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query
def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in documents: spans by pattern and by compression."""
    docs = table(spark, sf, "documents")
    found = secret_scan.secret_spans(docs, keep=["doc_id"], learned=secret_scan.learn_identifiers(docs))
    return found.select("doc_id", _count("assign").alias("n_assign"), _count("access").alias("n_access"),
                        _count("hex").alias("n_hex"), F.sha2(_listed(F.expr(BASE)), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


@query
def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations formatted, read back and digested; conversation -1 is made of control strings."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit("</s>[INST] ok [/INST]"))
    return chat.read_back(chat.render_turns(turns.union(hard)))


SQL["op4_chat"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(text) + length(text) - length(replace(text, '␛', ''))
        + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|\[ANSWER\]|<<SYS>>|<</SYS>>|<role>|</role>|</turn>')) AS n
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 14 WHEN 'system' THEN 18
        ELSE length(role) + 20 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

# (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on page urls by the longest fitting rule."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL["op6_url_rules"] = r"""
WITH parsed AS (
    SELECT page_id, row_number() OVER () AS n,
        CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
    SELECT n, arg_max(rule_host || rule_path, (length(rule_host) + length(rule_path), length(rule_host))) AS rule,
        arg_max(verdict, (length(rule_host) + length(rule_path), length(rule_host))) AS verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)"""


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# Finds every alignment another way: of n words with e others, some run of (n - e) / (e + 1), rounded up, is equal.
SQL["op7_decontamination"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
items AS (SELECT *, ceil((needed) / (n - needed + 1))::INT AS run FROM (SELECT *, ceil(n * {decontaminate.IDENTITY})::INT AS needed FROM (
    SELECT *, least({decontaminate.STRETCH}, len(words)) AS n FROM (
    SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM benchmark)
    WHERE len(words) >= {decontaminate.LEAST_WORDS}))),
item_at AS (SELECT *, list_aggregate(words[p + 1:p + run], 'string_agg', ' ') AS seed FROM (
    SELECT *, unnest(range(len(words) - run + 1)) AS p FROM items)),
doc_at AS (SELECT *, list_aggregate(words[p + 1:p + run], 'string_agg', ' ') AS seed FROM (
    SELECT doc_id, words, run, unnest(range(len(words) - run + 1)) AS p FROM docs, (SELECT DISTINCT run FROM items) WHERE len(words) >= run)),
laid AS (SELECT DISTINCT doc_id, item_id, d.words AS dw, i.words AS iw, n, needed, d.p - i.p AS start
    FROM doc_at d JOIN item_at i ON d.run = i.run AND d.seed = i.seed),
compared AS (SELECT *, [CASE WHEN start + k >= 0 AND dw[start + k + 1] = iw[k + 1] THEN 1 ELSE 0 END FOR k IN range(len(iw))] AS eq FROM laid),
scored AS (SELECT doc_id, item_id, len(iw) AS item_words, needed,
    list_max([list_sum(eq[s + 1:s + n]) FOR s IN range(len(iw) - n + 1)]) AS matched FROM compared)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(item_words) AS BIGINT) AS item_words
FROM scored WHERE matched >= needed GROUP BY doc_id, item_id"""


@query
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as WARC captures and read back, one row per capture."""
    path = new_path(spark, "warc")
    warc.write_captures(table(spark, sf, "pages"), path)
    captures = warc.read_captures(spark, path)
    response = F.col("record_type") == "response"
    # the payload's digest is a column of its own, so that it is computed once
    read = captures.select(
        warc.field_of(F.col("metadata.block"), "pageId").cast("bigint").alias("page_id"),
        warc.field_of(F.col("metadata.block"), "payloadLength").cast("bigint").alias("length"),
        F.col("response.type").alias("record_type"), F.substring_index("response.payload_digest", ":", -1).alias("digest"),
        F.regexp_extract("response.refers_to", "^<urn:page:(-?[0-9]+)>$", 1).cast("bigint").alias("refers_to"),
        warc.payload_of(F.col("response.block")).alias("payload"))
    read = read.select("page_id", "length", "record_type", "digest", "refers_to", F.sha1("payload").alias("sha1"),
                       F.length("payload").cast("bigint").alias("bytes"))
    return read.withColumn("sha1", warc.base32_of_hex(F.col("sha1"))).select(
        "page_id", F.when(response, F.col("bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


SQL["op8_warc"] = """
WITH digested AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (SELECT page_id, octet_length(payload) AS payload_bytes, hex,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1) FOR i IN range(32)],
        'string_agg', '') AS payload_digest FROM digested),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM digits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to FROM firsts"""


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of documents."""
    counted = token_counts.count_tokens(table(spark, sf, "documents"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Documents encoded and decoded again, as digests."""
    docs, json = table(spark, sf, "documents").select("doc_id", "text"), vocabulary()
    return bpe.encode(docs, vocabulary_json=json, then=bpe.digest_batches(json, ["doc_id"]), then_schema=f"doc_id bigint, {bpe.DIGESTS}")


@query
def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return block_search.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


SQL["op3_nearest"] = """
WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT * FROM vectors WHERE v IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN v])
    AND list_bool_or([x <> 0 FOR x IN v])),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

GOOD = 0.3


@query
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.with_scores(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the trie of conversations, of which every twenty share up to three first turns."""
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(table(spark, sf, "conversations")))


SQL["op11_prefix_trie"] = r"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT FOR i IN range(8)]),
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
lengths AS (SELECT c, max(pos) AS n FROM turns GROUP BY c),
built AS (
    SELECT convs.c, t.pos AS d, role, text FROM convs JOIN turns t ON t.c = base AND pos <= h
    UNION ALL SELECT convs.c, pos - h + least(h, coalesce(n, 0)), role, text
    FROM convs JOIN turns t ON t.c = convs.c AND pos > h LEFT JOIN lengths ON lengths.c = base),
prefixes AS (
    SELECT c, d, md5(string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY c ORDER BY d)) AS node,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM built
    UNION ALL SELECT c, 0, 'root', 0 FROM convs),
sized AS (SELECT *, max(d) OVER (PARTITION BY c) AS size, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM prefixes),
nodes AS (SELECT node, min(c) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256 FROM sized GROUP BY node),
children AS (SELECT n.*, coalesce(k, 0) AS n_children FROM nodes n
    LEFT JOIN (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent) USING (node)),
below AS (SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM children n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM children n JOIN below USING (node) LEFT JOIN nodes u ON u.node = n.parent"""


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings in whitened coordinates of the first four components."""
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of documents, of their edited texts, and how near these and the next documents are."""
    return quartile_digest.compare_neighbours(table(spark, sf, "documents"))
