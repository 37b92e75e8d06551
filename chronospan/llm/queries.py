"""Queries over the given tables: one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe_prefix, filter_audit, html_extract, kneser_ney, license_scan, line_crf, mixing, prefix_trie, scaled_sketch, url_rules, vp_simhash, zdict_toxicity
from .text import table

#: The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pattern; the files belong to an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return kneser_ney.classify(docs, table(spark, sf_dir, "labels"), keep_text=False, details=True)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.label(docs, crf, drop_text=True)


def op3_zdict_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = zdict_toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = zdict_toxicity.scored(docs, model, drop_text=True)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    found = attention_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), training, *tokenizer())
    return found.withColumn("held_out", ~F.col("is_training") & F.col("doc_id").isNotNull()).drop("is_training")


def op7_vp_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vp_simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", vp_simhash.hex_fingerprint("fingerprint").alias("fingerprint"), "component_id")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.match_rules(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scaled_sketch.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = scaled_sketch.compare_edited(pairs)
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    encoded = bpe_prefix.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    decoded = bpe_prefix.decode_documents(encoded.drop("text"), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_extract.train())
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_line_crf": op2_line_crf,
    "op3_zdict_toxicity": op3_zdict_toxicity,
    "op4_source_mix": op4_source_mix,
    "op5_license_scan": op5_license_scan,
    "op6_attention_lm": op6_attention_lm,
    "op7_vp_simhash": op7_vp_simhash,
    "op8_url_rules": op8_url_rules,
    "op9_scaled_sketch": op9_scaled_sketch,
    "op10_bpe_prefix": op10_bpe_prefix,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_html_blocks": op13_html_blocks,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_rules": r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(action, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST, r.action DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), turns AS (
  SELECT ids.conv_id, k, turn, words FROM ids JOIN t ON t.conv_id = base AND k <= h
  UNION ALL SELECT ids.conv_id, k, turn, words FROM ids JOIN t ON t.conv_id = ids.conv_id AND k > h
), seqs AS (
  SELECT conv_id, coalesce(list(turn ORDER BY k) FILTER (k IS NOT NULL), []) AS seq, coalesce(list(words ORDER BY k) FILTER (k IS NOT NULL), []) AS words FROM ids LEFT JOIN turns USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS node, len(seq) AS n, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT node[1:e] AS node, e AS depth, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM nodes LEFT JOIN children USING (node, depth)) GROUP BY ALL
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below USING (node, depth) LEFT JOIN children USING (node, depth)
LEFT JOIN nodes AS up ON nodes.depth > 0 AND up.depth = nodes.depth - 1 AND up.node = nodes.node[1:nodes.depth - 1]
""",
    "op12_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again
  FROM documents
), docs AS (
  SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(again AS INT) AS fails,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM words
), counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM docs GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
  SELECT filter_order, step, filter_order[step] AS filter, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS own,
         CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS INT) AS earlier
  FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders)
), audited AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN fails & (coalesce(earlier, 0) | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & own <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & coalesce(earlier, 0) <> 0 AND fails & own <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & own <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & coalesce(earlier, 0) = 0 AND fails & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM audited
""",
    # On these pages the article is an element of that name, which the tree is not told.
    "op13_html_blocks": r"""
WITH parts AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), texts AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
         '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM parts
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10))) AS n_chars FROM texts
""",
}
