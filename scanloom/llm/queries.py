"""Registered queries of the corpus operators, each over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import byte_bpe, divergence, exact_dedup, hard_negatives, html_extraction, language_id, mixing, near_dedup, packing, personal_data, quality_rules, secret_scan, substring_dedup
from scanloom.llm.common import RANKS, TOKENIZER, split_pattern, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents")).drop("found")


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


ORACLE["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source
), weighed AS (
  SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap,
         CASE rk % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope
  FROM sources
), limits AS (
  SELECT *, row_number() OVER by_limit AS nth,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM weighed WINDOW by_limit AS (ORDER BY cap::DOUBLE / weight, rk)
), first AS (
  SELECT nth AS f_nth, rest AS f_rest, rest_weight AS f_weight FROM limits WHERE weight * rest <= cap * rest_weight
  ORDER BY nth LIMIT 1
), plan AS (
  SELECT source, source_size, slope,
         CASE WHEN nth < f_nth THEN cap::DOUBLE ELSE (weight * f_rest)::DOUBLE / f_weight::DOUBLE END AS target
  FROM limits, first
), supplied AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.slope,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR)
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle <= target)::INT + (source_size::DOUBLE + middle <= target)::INT
                   + (2 * source_size::DOUBLE + middle <= target)::INT END AS copies
  FROM supplied
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN middle / target
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (middle / target)) - (1 - slope)) / (2 * slope) END AS first_position
FROM counted
"""


@query
def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf, "pages"))


@query
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents"))


@query
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = language_id.learn(docs.filter(~language_id.held_out("doc_id")))
    return language_id.identify(docs, profiles)


@query
def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.components(table(spark, sf, "documents"), shingle=2)


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


@query
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf, "documents"))


ORACLE["op8_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf, "documents")).drop("found")


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), s AS (
  SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS in_lang
  FROM gt JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), all_pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(p.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
), found AS (
  SELECT * FROM all_pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - in_lang) * (p - in_lang)) // (p + in_lang) FROM s WHERE n > 0 AND p > in_lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""


@query
def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf, "documents"), RANKS, split_pattern())


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf, "embeddings"))


ORACLE["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline  # which imports the operators from here on, so not at the top

    return corpus_pipeline.run(spark, sf)
