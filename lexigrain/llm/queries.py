"""Registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, egojoin, importance, jaccard, langid, linededup, lmscore, merkle, mixing, packing, quality, tokenfile, warc
from .common import scratch, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids in files, read back: doc_id, start, n_tokens, ids_crc32. Null text has the end id only."""
    path = scratch(spark, "ids")
    tokenfile.write_dataset(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocabulary=50257)
    return tokenfile.read_documents(spark, path)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens and the digests of ids and bytes. Null text counts as empty."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.DEFAULT_RANKS), public_tokenizers.PATTERN)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, rebuilt from the archive, written and parsed: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html counts as empty."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, kept of all documents; see jaccard.near_duplicates for nulls and repeated ids."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents; see linededup.drop_bitmaps for nulls and repeated ids."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all vectors; see egojoin.near_vectors for nulls and repeated ids."""
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of all documents; und for null text and text without a letter."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of all documents; null text has no words, a null host no verdict."""
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents; null text has the end only."""
    return lmscore.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; null source is a source of its own, null text has size 0."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in sequences of 2,048 ids; null text has the end id only. See packing.pack."""
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all documents; see merkle.verified_proofs."""
    return merkle.verified_proofs(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents towards benchmark; see importance.resample."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: crc32 of a DuckDB blob: the bits of each byte folded into the remainder.
CRC = "xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(hex({0}), 2 * k + 1, 2))::BIGINT FOR k IN range(octet_length({0}))], lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(({0})::VARCHAR))::VARCHAR || ':' || ({0})::VARCHAR END"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

SQL = {
    "op2_warc_archive": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
h AS (SELECT *, sha1(body) AS x FROM p),
g AS (SELECT *, [('0x' || substr(x, 10 * k + 1, 10))::BIGINT FOR k IN range(4)] AS parts FROM h)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to FROM g""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS g FROM w WHERE len(w) > 0),
k AS (SELECT min(doc_id) AS cid, len(any_value(g)) AS n, any_value(g) AS g, list(doc_id) AS docs FROM g GROUP BY md5(array_to_string(list_sort(g), chr(10)))),
t AS (SELECT cid, n, unnest(g) AS t FROM k),
p AS (SELECT a.cid AS a, b.cid AS b FROM t a JOIN t b ON a.t = b.t AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
r AS (SELECT cid AS a, cid AS b FROM k UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS cid, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT k.cid, len(k.docs) - 1 + coalesce((SELECT sum(len(o.docs)) FROM p JOIN k o ON o.cid = p.b WHERE p.a = k.cid), 0) AS n_links FROM k),
m AS (SELECT unnest(docs) AS doc_id, cid FROM k)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, d.doc_id = coalesce(class_id, d.doc_id) AS kept
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN c USING (cid) LEFT JOIN l USING (cid)""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (
  SELECT k, max(doc_id) AS first_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, firsts.k IS NOT NULL AND keyed.doc_id <> first_doc AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, {WORDS} AS w FROM documents),
tok AS (SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM d WHERE len(w) >= 5),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM tok WHERE i <= len(w) - 4),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, i - coalesce(p, i - 5))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
       FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(ln.n, 0) AS full_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * full_lines AS more_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR more_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
a AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN least(m * (1 - m) / v - 1, 1e6) ELSE 2.0 END AS s FROM p),
r AS (SELECT source, (k + m * s) / (n + s) > 0.5 AS rejected FROM h, a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN r USING (source)""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT *, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || digest || '|' || nth), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS nth FROM documents)),
t AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT % 3 + 1]::DOUBLE AS w, 2.0 * source_size AS cap FROM t),
l AS (SELECT *, 1.5 * sum(source_size) OVER () AS asked, cap / w <=
        (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS full_up
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE w * (asked - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) / sum(w) FILTER (NOT full_up) OVER () END AS target FROM l),
r AS (SELECT *, target - certain * source_size AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM g)),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT source, size, coalesce(sum(size * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS sure, sum(size * size * n) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares
      FROM z WINDOW o AS (PARTITION BY source ORDER BY size DESC)),
k AS (SELECT r.source, max(size) AS top, arg_max((rest - sure) / squares, size) AS scale, arg_max(sure, size) AS sure FROM y JOIN r ON y.source IS NOT DISTINCT FROM r.source
      WHERE rest > 0 AND (rest - sure) / squares * size < 1 GROUP BY r.source),
q AS (SELECT d.*, source_size, target, certain, top, rest - sure AS rest, CASE WHEN size > 0 AND size <= top THEN (u / (1 - u)) / (scale * size / (1 - scale * size)) END AS q
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
c AS (SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= rest AS picked FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (certain + CASE WHEN picked OR coalesce(size > top, false) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, lang, {LEAF.format("text")} AS leaf, coalesce({CRC.format("encode(doc_id::VARCHAR)")} % 3 = 0, false) AS hit,
         {LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r),
t AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, level, i // 8, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, h FROM s UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 8, n),
p AS (SELECT l.lang, l.i AS leaf_i, t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i // (8 ** t.level)::BIGINT), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i // (8 ** t.level)::BIGINT), '') AS after
  FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.i // 8 = l.i // (8 ** (t.level + 1))::BIGINT GROUP BY l.lang, l.i, t.level),
q AS (SELECT s.lang, u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.i // (8 ** u.level)::BIGINT), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.i // (8 ** u.level)::BIGINT), '') AS after
  FROM s JOIN u ON u.n > 1 AND u.i // 8 = s.i // (8 ** (u.level + 1))::BIGINT GROUP BY s.lang, u.level),
a AS (SELECT lang, leaf_i, list({{'b': before, 'a': after}} ORDER BY level) AS steps FROM p GROUP BY lang, leaf_i),
b AS (SELECT lang, list({{'b': before, 'a': after}} ORDER BY level) AS steps FROM q GROUP BY lang),
w AS (SELECT l.*, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(a.steps, []) || coalesce(b.steps, []) AS steps FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN a ON a.lang IS NOT DISTINCT FROM l.lang AND a.leaf_i = l.i LEFT JOIN b ON b.lang IS NOT DISTINCT FROM l.lang),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.b || x.a FOR x IN steps], '')) AS proof_sha256,
             list_reduce([{{'b': CASE WHEN hit THEN other ELSE leaf END, 'a': ''}}] || steps, lambda h, x: {{'b': sha256(x.b || h.b || x.a), 'a': ''}}).b AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM f""",
    "op13_importance_resampling": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY doc_id, w), ew AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM e) GROUP BY w),
k AS (SELECT w, {CRC.format("encode(w)")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM ew)),
s AS (SELECT b, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM ew JOIN k USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
v AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN v USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT)::BIGINT AS score FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS m FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * m // 100 THEN r END AS rank FROM y""",
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_warc_archive, op3_ngram_jaccard, op4_line_dedup, op5_byte_bpe, op6_embedding_dedup, op7_language_id, op8_quality_rules, op9_lm_score, op10_mixing,
        op11_packing, op12_merkle_manifest, op13_importance_resampling,
    )
}
