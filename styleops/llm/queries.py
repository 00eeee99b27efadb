"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styleops.llm import (
    byte_bpe, embedding_dedup, exact_dedup, html_text, jaccard_join, license_scan, packing, periodic_runs, quality, sharding,
    source_divergence, substring_dedup, token_counts,
)
from styleops.llm.common import UPPER, LOWER, table
from styleops.session import scratch_path

SHARDS = [f"shard-{k:02d}" for k in range(32)]


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).withColumn("n_removed", F.size("removed"))


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf, "documents"), path, scratch_path(spark, "token-counts"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf, "documents"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, sf, "documents"), path, pattern, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.with_planted_tails(table(spark, sf, "documents"))
    return periodic_runs.summary(periodic_runs.periodic_runs(docs))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf, "documents"))


def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_packing, op4_quality, op5_jaccard_join,
        op6_exact_dedup, op7_html_text, op8_embedding_dedup, op9_byte_bpe, op10_sharding,
        op11_periodic_runs, op12_source_divergence, op13_license_scan,
    )
}

EXACT_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, false) AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""

_NUMBER = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
SHARD_SQL = f"""
WITH slots AS (
  SELECT unnest(range({sharding.TABLE_SIZE}))::INTEGER AS slot, unnest({sharding.lookup_table(SHARDS)}) AS shard
), placed AS (
  SELECT doc_id, ({_NUMBER.format("coalesce(doc_id::VARCHAR, '')")} % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents
)
SELECT placed.slot, doc_id, shard FROM placed JOIN slots ON placed.slot = slots.slot
"""


def table_sql(size: int) -> str:
    """The lookup table built turn by turn in SQL (``slot, shard``); it takes minutes at production size."""
    mine = _NUMBER.format("'offset:' || shard"), _NUMBER.format("'skip:' || shard")
    return f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS shard FROM range({len(SHARDS)}) AS r(k)
), walks AS (
  SELECT list(list_transform(range({size}), lambda j: ({mine[0]} + j * ({mine[1]} % {size - 1} + 1)) % {size}) ORDER BY k) AS walk FROM shards
), turns AS (
  SELECT 0 AS turn, NULL::BIGINT AS slot, list_transform(range({size}), lambda x: false) AS taken
  UNION ALL
  SELECT turn + 1, pick, list_concat(taken[1:pick], [true], taken[pick + 2:])
  FROM (
    SELECT turn, taken, list_filter(walk[turn % {len(SHARDS)} + 1], lambda s: NOT taken[s + 1])[1] AS pick
    FROM turns, walks WHERE turn < {size}
  )
)
SELECT slot, shard FROM turns JOIN shards ON k = (turn - 1) % {len(SHARDS)} WHERE slot IS NOT NULL
"""


def _share(count: str, total: str) -> str:
    return f"1 + ({source_divergence.SCALE}::HUGEINT * ({count} + {source_divergence.PRIOR})) // ({total} + {source_divergence.PRIOR} * terms)"


DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), tf AS (
  SELECT id, lang, source, term, count(*) AS n
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(norm, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS all_n FROM tf GROUP BY lang, term HAVING count(*) >= {source_divergence.LEAST_DOCS}
), size AS (
  SELECT lang, count(*)::HUGEINT AS terms, sum(all_n)::HUGEINT AS all_total FROM kept GROUP BY lang
), cell AS (
  SELECT lang, source, term, sum(n)::HUGEINT AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL
), grp AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cell USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total")} AS p, {_share("all_n", "all_total")} AS q
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cell USING (lang, source, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
"""


ORACLE = {"op6_exact_dedup": EXACT_SQL, "op10_sharding": SHARD_SQL, "op12_source_divergence": DIVERGENCE_SQL}
