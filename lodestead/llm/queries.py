"""One query per corpus operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audit, decontaminate, embeddings, linededup, lm, mixing, pii, quality, secrets, simhash, tokens, toxicity

#: The vocabulary of the token counts; a parameter of the operator.
VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary that the first is aligned with.
OTHER_VOCABULARY = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(_table(spark, sf_dir, "embeddings"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)[1])


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_units(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(OTHER_VOCABULARY))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = audit.filter_masks(_table(spark, sf_dir, "documents"))
    return audit.interactions(audit.mask_counts(masks, _table(spark, sf_dir, "labels")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def benchmark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items behind the class ids of ``op6_decontaminate``."""
    return decontaminate.item_classes(_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_embeddings, op3_tokens, op4_quality, op5_lm, op6_decontaminate, op7_simhash, op8_mixing, op9_linededup, op10_pii,
        op11_alignment, op12_filter_audit, op13_secrets, benchmark_classes)}


#: All pairs by cosine, and who reaches whom over the links.
_EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT vec_id, vec_id AS target FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.target = l.a),
least AS (SELECT vec_id, min(target) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree ON vec_id = a"""

#: Targets by water-filling, seats of sources and then of shards as the highest quotients, streams in seeded order.
_MIXING = """WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(concat_ws('|', '20', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS digest FROM documents),
so AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM so),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / CAST(weight AS DOUBLE), weight, source NULLS LAST)),
one AS (SELECT arg_min(level, cap / CAST(weight AS DOUBLE)) AS level FROM levels WHERE NOT cap < level * weight),
targets AS (SELECT l.source, source_size, n_docs, coalesce(CASE WHEN cap < l.level * weight THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), one.level * weight) END, 0) AS target
  FROM levels l, one),
blocks AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS n FROM targets),
source_quotients AS (SELECT source, target / (2 * seat - 1) AS q, seat FROM targets, blocks, LATERAL (SELECT unnest(range(1, n + 2)) AS seat)
  WHERE target > 0 AND target / (2 * seat - 1) > (SELECT sum(target) / (2.0 * n + 2 * count(*) + 2) FROM targets)),
source_won AS (SELECT source, count(*) AS won FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, seat) AS r FROM source_quotients), blocks WHERE r <= n GROUP BY source),
quota AS (SELECT t.*, coalesce(won, 0) AS source_blocks, greatest(1, CAST(ceil(n_docs / greatest(64.0, sqrt(n_docs))) AS BIGINT)) AS n_shards
  FROM targets t LEFT JOIN source_won w ON t.source IS NOT DISTINCT FROM w.source),
dealt AS (SELECT s.*, source_size, target, source_blocks, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS draw,
    CAST('0x' || substr(digest, 16, 15) AS BIGINT) % n_shards AS shard FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_blocks) AS n FROM dealt GROUP BY source, shard),
sums AS (SELECT source, sum(shard_size) AS total, count(*) AS parties, any_value(n) AS n FROM shards GROUP BY source),
quotients AS (SELECT s.source, s.shard, seat, shard_size / CAST(2 * seat - 1 AS DOUBLE) AS q FROM shards s JOIN sums USING (source), LATERAL (SELECT unnest(range(1, sums.n + 2)) AS seat)
  WHERE shard_size > 0 AND shard_size / (2.0 * seat - 1) > total / (2.0 * sums.n + 2 * parties + 2)
  UNION ALL SELECT s.source, s.shard, seat, shard_size / CAST(2 * seat - 1 AS DOUBLE) FROM shards s, sums, LATERAL (SELECT unnest(range(1, sums.n + 2)) AS seat)
  WHERE s.source IS NULL AND sums.source IS NULL AND shard_size > 0 AND shard_size / (2.0 * seat - 1) > total / (2.0 * sums.n + 2 * parties + 2)),
won AS (SELECT source, shard, count(*) AS won FROM (SELECT q.*, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, seat) AS r FROM quotients q) x
  WHERE r <= (SELECT any_value(n) FROM sums WHERE sums.source IS NOT DISTINCT FROM x.source) GROUP BY source, shard),
words AS (SELECT s.source, s.shard, shard_size, least(coalesce(won, 0) * 64, shard_size * 3) AS words FROM shards s
  LEFT JOIN won ON s.source IS NOT DISTINCT FROM won.source AND s.shard = won.shard),
streams AS (SELECT d.*, shard_size, words, coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY draw, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM dealt d JOIN words w ON d.source IS NOT DISTINCT FROM w.source AND d.shard = w.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN words // shard_size * size
  + greatest(0, least(size, words - words // shard_size * shard_size - start)) ELSE 0 END AS BIGINT) AS taken FROM streams"""


#: Masks by plain grouping of whole texts, then every order and step.
_AUDIT = """WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
judged AS (SELECT doc_id, part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > first, FALSE) AS INTEGER) AS mask FROM words JOIN least USING (t)),
told AS (SELECT part, mask, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), FALSE) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), FALSE) AS toxic FROM judged),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM told GROUP BY ALL),
f(k, letter) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS o
  FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
steps AS (SELECT filter_order, step, 1 << o[step] AS bit, CAST(list_sum(list_transform(o[1:step], lambda k: 1 << k)) AS INTEGER) - (1 << o[step]) AS before FROM orders, LATERAL (SELECT unnest(range(1, 6)) AS step)),
one AS (SELECT *, (mask & bit) > 0 AND (mask & before) = 0 AS gone FROM counts, steps),
removed AS (SELECT part, bit, sum(n) FILTER (gone) AS shapley FROM one GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER ((mask & (before + bit)) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (gone), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(any_value(shapley), 0) AS BIGINT) AS shapley
FROM one JOIN removed USING (part, bit) GROUP BY part, filter_order, step"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embeddings": _EMBEDDINGS, "op8_mixing": _MIXING, "op12_filter_audit": _AUDIT}
