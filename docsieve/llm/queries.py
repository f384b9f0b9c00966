"""The registered queries of the training-data operators: operator, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import binary, classifier, decontamination, lines, merkle, packing, rules, sharding, simhash, substrings, tokens, toxicity, whitening
from docsieve.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op2's base rule reads; unlike its learned verdict they have SQL."""
    return rules.features(documents(spark, sf_dir), "doc_id").select("doc_id", *rules.COUNTS[:5])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), merkle.without_newlines())


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


OP10_SQL = """
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
         'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'item' GROUP BY id),
pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'doc' AND i.kind = 'item' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM pairs JOIN sizes ON item_id = id WHERE n_shared * 10 >= n_item * 8
"""

OP4_SQL = """
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM raw),
keyed AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT a.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE r.k IS NOT NULL AND a.doc_id <> r.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE r.k IS NULL OR a.doc_id = r.last_doc), '')) AS kept_sha256
FROM keyed a LEFT JOIN repeated r ON a.k = r.k
GROUP BY a.doc_id
"""


#: Windows of 100 bytes (200 hexadecimal digits) by their earliest start; the others are repeats. Repeats of one document
#: whose bytes touch form one removed span.
OP3_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (  -- stretches of 500 window starts, since a substring of a long string is slow
  SELECT doc_id, j, substr(x, 1000 * j + 1, 1198) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 1000 + 1)) AS j FROM b)),
w AS (SELECT doc_id, 500 * j + i AS i, md5(substr(x, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, j, x, unnest(range(0, least(500, length(x) // 2 - 99))) AS i FROM c)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS again FROM w),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM k WHERE again),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM r),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY ALL),
e AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM s),
o AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, min(lo) AS first, list(struct_pack(hi := hi, next := next) ORDER BY lo) AS rest FROM e GROUP BY doc_id)
SELECT b.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN first IS NULL THEN x ELSE x[1 : 2 * first] ||
         array_to_string(list_transform(rest, lambda p: x[2 * p.hi + 1 : coalesce(2 * p.next, length(x))]), '') END)) AS kept_sha256
FROM b LEFT JOIN o ON b.doc_id = o.doc_id
"""

#: CRC-32 over a text's bytes, with its table made from the polynomial; then the shard that holds the middle of a row's bytes.
OP9_SQL = """
WITH RECURSIVE step AS (
  SELECT 0 AS k, range AS i, range AS c FROM range(256)
  UNION ALL SELECT k + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
l AS (SELECT doc_id, octet_length(x) + 16 AS size, list_prepend(4294967295, list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM b),
d AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295) AS text_crc32 FROM l CROSS JOIN crc),
p AS (SELECT *, sum(size) OVER () AS total, 2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS middle FROM d),
s AS (SELECT *, least(39, middle * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

def field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def levels_sql(name: str, start: str) -> str:
    """A tree's nodes by level (t: which tree), and beside each node its siblings before and after it."""
    beside = lambda frame: f"coalesce(string_agg(node, '') OVER (PARTITION BY t, lvl, idx // 3 ORDER BY idx ROWS BETWEEN {frame}), '')"
    return f"""{name} AS (
  {start}
  UNION ALL SELECT t, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY t, lvl, idx // 3, n),
{name}_runs AS (SELECT t, lvl, idx, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name} WHERE n > 1)"""


#: The even checksums are found with a CRC table, as for op9; trees level by level; folding step by step through both trees.
OP12_SQL = f"""
WITH RECURSIVE step AS (
  SELECT 0 AS k, range AS i, range AS c FROM range(256)
  UNION ALL SELECT k + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
even AS (
  SELECT doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1])), 4294967295) % 2 = 0 AS is_even FROM documents CROSS JOIN crc),
shown AS (SELECT *, CASE WHEN is_even THEN replace(text, chr(10), '') ELSE text END AS tampered FROM even),
hashed AS (SELECT doc_id, source, {leaf_sql('text')} AS leaf, {leaf_sql('tampered')} AS own FROM shown),
leaves AS (SELECT doc_id, source AS t, leaf, own, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{levels_sql('low', 'SELECT t, 0 AS lvl, idx, leaf AS node, n FROM leaves')},
tops AS (SELECT t AS source, node, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{levels_sql('high', "SELECT 'root' AS t, 0 AS lvl, idx, node, n FROM tops")},
whole AS (SELECT node AS root FROM high WHERE n = 1),
fold AS (
  SELECT doc_id, t, leaf, 0 AS lvl, idx, own AS node, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, f.t, leaf, f.lvl + 1, f.idx // 3, sha256(b || node || a), proof || b || a FROM fold f JOIN low_runs r ON f.t IS NOT DISTINCT FROM r.t AND f.lvl = r.lvl AND f.idx = r.idx),
mid AS (
  SELECT doc_id, fold.t, leaf, tops.node AS subroot, tops.idx, fold.node, proof FROM fold JOIN tops ON fold.t IS NOT DISTINCT FROM tops.source
  QUALIFY lvl = max(lvl) OVER (PARTITION BY fold.t)),
up AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, idx, node, proof FROM mid
  UNION ALL SELECT doc_id, leaf, subroot, f.lvl + 1, f.idx // 3, sha256(b || node || a), proof || b || a FROM up f JOIN high_runs r ON f.lvl = r.lvl AND f.idx = r.idx)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM up CROSS JOIN whole QUALIFY lvl = max(lvl) OVER ()
"""

COUNTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(string_split(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda v: v <> '') AS w FROM t),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t)
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY doc_id),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
f AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM g),
a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) > 1 AS again FROM f),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM a WHERE again) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
       coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_simhash_groups": op7_simhash_groups,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_sharding": op9_sharding,
        "op10_decontamination": op10_decontamination,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_token_files": op13_token_files,
        "quality_counts": quality_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": OP3_SQL, "quality_counts": COUNTS_SQL, "op4_line_dedup": OP4_SQL, "op9_sharding": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_merkle_manifest": OP12_SQL}
