"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, license_scan, line_dedup, packed_ids, packing, pii, quality, substring_dedup, token_counts
from ._dist import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@_query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).drop("spans")


ORACLES["op2_substring_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
blocks AS (SELECT r, n, b, substring(h, 2 * b + 1, 2 * (500 + {substring_dedup.LENGTH - 1})) AS x FROM (SELECT r, n, h, unnest(generate_series(0, n - {substring_dedup.LENGTH}, 500)) AS b FROM docs)),
starts AS (SELECT r, b + j AS s, md5(substring(x, 2 * j + 1, {2 * substring_dedup.LENGTH})) AS k FROM (SELECT r, n, b, x, unnest(generate_series(0, least(499, n - {substring_dedup.LENGTH} - b))) AS j FROM blocks)),
twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
hits AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {substring_dedup.LENGTH} THEN 0 ELSE 1 END AS new FROM starts JOIN twice USING (k)),
runs AS (SELECT r, min(s) AS a, max(s) + {substring_dedup.LENGTH} AS z FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM hits) GROUP BY r, g),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS spans, max(z) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN kept.r IS NULL THEN h ELSE x || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("blocks")


ORACLES["op1_license_scan"] = license_scan.oracle_sql()


@_query("op3_packed_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ordix-ids-{uuid.uuid4().hex}"
    packed_ids.write(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return packed_ids.read(spark, path)


@_query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratio = quality.fit(docs, quality.trusted_ids(_table(spark, sf_dir, "labels")))
    return quality.score(docs, ratio)


ORACLES["op4_quality_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
windows AS (SELECT r, s, w[s : s + 2] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS s FROM docs)),
twice AS (SELECT r, x FROM windows GROUP BY r, x HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS k FROM windows JOIN twice USING (r, x)) GROUP BY r),
hexed AS (SELECT r, doc_id, hex(encode(t)) AS h, CAST(strlen(t) AS BIGINT) AS n FROM docs),
blocks AS (SELECT r, doc_id, n, b, substring(h, 2 * b + 1, 2 * (500 + {quality.N - 1})) AS x FROM (SELECT r, doc_id, n, h, unnest(generate_series(0, n - {quality.N}, 500)) AS b FROM hexed)),
grams AS (SELECT r, doc_id, ((('0x' || substring(x, 2 * j + 1, {2 * quality.N}))::UBIGINT * {0x9E3779B1}::UBIGINT) % 4294967296::UBIGINT) >> {32 - quality.BITS} AS k FROM (SELECT r, doc_id, x, unnest(generate_series(0, least(499, n - {quality.N} - b))) AS j FROM blocks)),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT k, count(*) AS raw, count(trusted.doc_id) AS target FROM grams LEFT JOIN trusted USING (doc_id) GROUP BY k),
sums AS (SELECT (sum(raw) + {1 << quality.BITS})::DOUBLE AS raw, (sum(target) + {1 << quality.BITS})::DOUBLE AS target, sum(target) > 0 AS fitted FROM counts),
ratio AS (SELECT k, CASE WHEN fitted THEN CAST(round((ln((counts.target + 1)::DOUBLE / sums.target) - ln((counts.raw + 1)::DOUBLE / sums.raw)) * {quality.SCALE}) AS BIGINT) ELSE 0 END AS x FROM counts, sums),
scores AS (SELECT r, CAST(sum(x) AS DOUBLE) / count(*) / {quality.SCALE} AS score FROM grams JOIN ratio USING (k) GROUP BY r),
base AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0) AS score FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN scores USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {quality.THRESHOLD} AS kept, score FROM judged
"""


@_query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), decontaminate.blocks(_table(spark, sf_dir, "benchmark")))


#: Fixed value: what a word is made of, once A-Z are lower-cased.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op5_decontaminate"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {decontaminate.N}) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, w[s : s + n - 1] AS x FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (SELECT r, n, s, w[s : s + n - 1] AS x FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item FROM places JOIN windows USING (n, x)),
words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
suffixes AS (SELECT i, n, s AS t, w[s : s + n - 1] AS x FROM (SELECT row_number() OVER () AS i, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM sized)),
diagonals AS (SELECT r, i, n, s, s - t AS d, s - row_number() OVER (PARTITION BY r, i, s - t ORDER BY s) AS run FROM places JOIN suffixes USING (n, x)),
longest AS (SELECT r, max(words) AS words FROM (SELECT r, any_value(n) + count(*) - 1 AS words FROM diagonals GROUP BY r, i, d, run) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated, CAST(coalesce(longest.words, 0) AS BIGINT) AS longest
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r) LEFT JOIN longest USING (r)
"""


@_query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


@_query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), digest=True)


@_query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts.counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model")))


@_query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(_table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLES["op9_jaccard_join"] = """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, x FROM (SELECT r, w[s : s + 3] AS x FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS s FROM docs WHERE len(w) > 0))),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT p.r AS a, q.r AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.x = q.x AND p.r < q.r GROUP BY p.r, q.r),
links AS (SELECT a, b FROM common JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, s) AS (SELECT r, r FROM docs UNION SELECT reach.r, sym.b FROM reach JOIN sym ON sym.a = reach.s)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(m.id AS BIGINT) AS component_id
FROM docs LEFT JOIN sizes USING (r) JOIN (SELECT reach.r AS r, min(d.doc_id) AS id FROM reach JOIN docs d ON d.r = reach.s GROUP BY reach.r) m USING (r)
"""


@_query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
