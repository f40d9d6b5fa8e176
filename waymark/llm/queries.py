"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, html, linededup, neardup, packing, periodic, pii, quality, sharding, topk, urls, whitening
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), words=3, percent=85).drop("row_key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_sharding without the checksum, which DuckDB lacks."""
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "shard", "slot")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed rules alone say, which SQL can express."""
    rows = urls.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return ctw.score(table(spark, sf_dir, "documents"), own % 5 == 1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_found", "kinds")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.periodic_runs(periodic.plant_runs(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = F.col("longest")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op12_whitening, which SQL can express: a row per vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).where("component = 1").select("vec_id", "n", "deviation")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_top_k, op3_near_dedup, op4_packing, op5_sharding, op6_url_filters, op7_quality, op8_ctw, op9_pii, op10_bpe, op11_periodic_runs, op12_whitening, op13_html_text, url_rules, shard_places, whitening_deviations)}

_OP1 = f"""
WITH lines AS (
  SELECT doc_id, text, source, line, list_extract(parts, line) AS words
  FROM (SELECT doc_id, text, source, parts, unnest(range(1, len(parts) + 1)) AS line
        FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))
  WHERE regexp_matches(list_extract(parts, line), '[^\\x20\\x09-\\x0D]')),
common AS (
  SELECT words, min(struct_pack(nul := doc_id IS NOT NULL, doc_id := doc_id, line := line)) AS first
  FROM lines GROUP BY words HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
gone AS (
  SELECT DISTINCT l.doc_id, l.text, l.line FROM lines l JOIN common c USING (words)
  WHERE struct_pack(nul := l.doc_id IS NOT NULL, doc_id := l.doc_id, line := l.line) <> c.first),
per AS (SELECT doc_id, text, list(line) AS lines FROM gone GROUP BY ALL),
counts AS (SELECT doc_id, text, count(DISTINCT line) AS n FROM lines GROUP BY ALL)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(len(p.lines), 0)::BIGINT AS n_removed,
  CASE WHEN p.lines IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(p.lines, i)), chr(10)) END AS text
FROM documents d
LEFT JOIN per p ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.text = p.text
LEFT JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
"""

_OP2 = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {topk.SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {topk.K}
"""


_FITS = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
_URLS = f"""
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits} THEN '{rule}'" for _, rule, fits in _FITS)} END AS rule, CASE {' '.join(f"WHEN {fits} THEN '{v}'" for v, _, fits in _FITS)} END AS verdict
FROM (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.SMALL}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
"""


_SHARDS = f"""
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1 AS slot
FROM (
  SELECT doc_id, size, floor((sum(size) OVER (ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size) * {sharding.SHARDS} / (sum(size) OVER ())::DOUBLE)::INTEGER AS shard
  FROM (SELECT doc_id, (strlen(coalesce(text, '')) + {sharding.OVERHEAD})::BIGINT AS size FROM documents))
"""


def _common_words() -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality.COMMON_WORDS.items()) + " ELSE []::VARCHAR[] END"


_STRIP = r"[\x20\x09-\x0D]"
_OP7 = f"""
WITH w0 AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_STRIP}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_STRIP}', '', 'g') <> '') AS l
  FROM documents),
wins AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w0)),
twice AS (SELECT k, x FROM wins GROUP BY ALL HAVING count(*) > 1),
cover AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT wins.k, unnest([i, i + 1, i + 2]) AS p FROM wins JOIN twice USING (k, x)) GROUP BY k),
f AS (
  SELECT k, doc_id, lang, w, len(w) AS n_words, strlen(t) AS b,
    length(regexp_replace(t, '{_STRIP}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    [length(t) - length(regexp_replace(t, x, '', 'g')) FOR x IN
      ['\\p{{Ll}}', '\\p{{Lu}}', '[\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]', '\\p{{N}}', '{_STRIP}', '[.,;:!?''"()-]', '[#*$%&|<>]',
       '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D.,;:!?''"()#*$%&|<>-]']] AS cc,
    {_common_words()} AS cw
  FROM w0 LEFT JOIN cover USING (k)),
g AS (
  SELECT *, [len(list_filter(w, lambda y: lower(y) = x)) FOR x IN cw] AS found FROM f),
h AS (SELECT *, CASE WHEN len(cw) > 0 THEN list_append(found, n_words - list_sum(found)::BIGINT) END AS wc FROM g),
r AS (
  SELECT lang, [{', '.join(f'sum(cc[{i + 1}])' for i in range(len(quality.CLASSES)))}] AS rc,
    [{', '.join(f'sum(wc[{i + 1}])' for i in range(quality.N_COMMON + 1))}] AS rw
  FROM h WHERE wc IS NOT NULL AND NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) GROUP BY lang),
s AS (
  SELECT h.*, {{js:cc:rc}} AS class_distance, {{js:wc:rw}} AS word_distance FROM h LEFT JOIN r USING (lang)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance,
  NOT base_failed AND NOT coalesce(class_distance > {quality.MAX_CLASS_DISTANCE}
    OR word_distance > greatest({quality.MAX_WORD_DISTANCE}, {quality.SCATTER[0]} + {quality.SCATTER[1]} / sqrt(greatest(n_words, 1))), false) AS kept
FROM v
"""


def _js(p: str, q: str) -> str:
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln(2 * {a} / ({a} + {b})) ELSE 0 END"
    x, y = f"({p}[i] / list_sum({p})::DOUBLE)", f"({q}[i] / list_sum({q})::DOUBLE)"
    terms = f"list_sum([{part(x, y)} + {part(y, x)} FOR i IN range(1, len({p}) + 1)])"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({terms}, 0) / (2 * ln(2.0))) END"


_OP7 = _OP7.replace("{js:cc:rc}", _js("cc", "rc")).replace("{js:wc:rw}", _js("wc", "rw"))

_DEVIATIONS = f"""
WITH whole AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {whitening.SCALE})::BIGINT + {whitening.SHIFT}) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
each AS (SELECT k, vec_id, len(x) AS dim, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS x FROM whole),
sums AS (SELECT dim, pos, count(*)::HUGEINT AS n, sum(x)::HUGEINT AS s FROM each GROUP BY ALL)
SELECT vec_id, any_value(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM each JOIN sums USING (dim, pos) GROUP BY k, vec_id
"""

ORACLE_SQL = {"op1_line_dedup": _OP1, "op2_top_k": _OP2, "op7_quality": _OP7, "url_rules": _URLS, "shard_places": _SHARDS, "whitening_deviations": _DEVIATIONS}
