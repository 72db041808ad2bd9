"""Queries of the operators for language-model data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm import bpe, match, mix, truncation
from massweave.plans.runtime import cut_lineage, query, table


def _matched(spark: SparkSession, directory: str) -> DataFrame:
    return match.match(table(spark, directory, "features_a"), table(spark, directory, "features_b"))


@query
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of rows that are the same feature."""
    return _matched(spark, directory).select("feature_id", "peak_id")


@query
def p1_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """The pairs with their rule and confidence."""
    return _matched(spark, directory)


@query
def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, directory, "documents"))


def _mixed(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    sized = mix.sized_documents(table(spark, directory, "documents"))
    plan = mix.budgets(sized, table(spark, directory, "mix_targets"))
    return mix.mix(sized, plan), plan


@query
def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of the mix, with how often each is used."""
    return _mixed(spark, directory)[0]


@query
def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Target and actual share of every source."""
    return mix.shares(*_mixed(spark, directory))


def _by_characters(spark: SparkSession, directory: str) -> DataFrame:
    """Documents sized by characters, in an order that SQL knows too."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    rows = table(spark, directory, "documents").where("doc_id IS NOT NULL")
    return cut_lineage(rows.select(mix.source_name(F.col("source")).alias("source"), "doc_id", key.alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_tokens")))


@query
def p7_characters(spark: SparkSession, directory: str) -> DataFrame:
    """The mix by characters, as large as the caps allow."""
    sized = _by_characters(spark, directory)
    return mix.mix(sized, mix.budgets(sized, table(spark, directory, "mix_targets")))


@query
def p7_short(spark: SparkSession, directory: str) -> DataFrame:
    """Shares of a mix by characters of the size of the whole corpus, for which some sources are too small."""
    sized = _by_characters(spark, directory)
    plan = mix.budgets(sized, table(spark, directory, "mix_targets"), sized.agg(F.sum("n_tokens")).first()[0] or 0)
    shares = mix.shares(mix.mix(sized, plan), plan)
    return shares.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in shares.dtypes])


@query
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.judged(table(spark, directory, "documents")).where("cut").select("doc_id")


@query
def p8_limits(spark: SparkSession, directory: str) -> DataFrame:
    """Hidden limits of the sources, in every way of storing that shows them."""
    return truncation.hidden_limits(truncation.stored_lengths(table(spark, directory, "documents")))


@query
def p8_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Share of cut texts of each source."""
    return truncation.by_source(truncation.judged(table(spark, directory, "documents")))


_NAME = lambda c: f"NULLIF(REGEXP_REPLACE(REGEXP_REPLACE(LOWER({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"

_MIX = lambda total: f"""WITH d AS (SELECT {_NAME("source")} AS source, doc_id, ('0x' || SUBSTR(MD5(doc_id::VARCHAR), 1, 15))::BIGINT AS key, COALESCE(LENGTH(text), 0) AS n_tokens FROM documents),
  totals AS (SELECT source, SUM(n_tokens) AS tokens FROM d WHERE source IS NOT NULL GROUP BY source),
  w AS (SELECT {_NAME("source")} AS source, COALESCE(SUM(target_weight) FILTER (WHERE target_weight > 0), 0) AS weight, GREATEST(MIN(COALESCE(max_repeats, 0)), 0) AS max_repeats FROM mix_targets GROUP BY 1),
  t AS (SELECT w.*, COALESCE(tokens, 0) AS tokens, weight > 0 AND max_repeats > 0 AND COALESCE(tokens, 0) > 0 AS usable FROM w LEFT JOIN totals USING (source) WHERE source IS NOT NULL),
  s AS (SELECT SUM(weight) FILTER (WHERE usable) AS weights, MIN(max_repeats * tokens / weight) FILTER (WHERE usable) AS most, (SELECT SUM(n_tokens) FROM d) AS everything FROM t),
  b AS (SELECT t.*, CASE WHEN usable THEN weight / weights ELSE 0 END AS target_share, CASE WHEN usable THEN weight / weights * {total} ELSE 0 END AS budget FROM t, s),
  plan AS (SELECT *, CASE WHEN usable THEN LEAST(max_repeats, FLOOR(budget / tokens)) ELSE 0 END::INT AS epochs FROM b),
  p AS (SELECT *, CASE WHEN usable AND epochs < max_repeats THEN GREATEST(0, budget - epochs * tokens) ELSE 0 END AS rest FROM plan),
  o AS (SELECT d.*, epochs, rest, SUM(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM d JOIN p USING (source) WHERE n_tokens > 0),
  used AS (SELECT * FROM (SELECT doc_id, source, n_tokens, (epochs + CASE WHEN e <= rest OR (e - n_tokens < rest AND e - rest < rest - (e - n_tokens)) THEN 1 ELSE 0 END)::INT AS uses FROM o) WHERE uses > 0)"""  # noqa: E731

_COUNT = lambda c: f"(LENGTH(text) - LENGTH(REPLACE(text, {c}, '')))"
_ENTITIES = f"4 * {_COUNT(repr('&'))} + 3 * {_COUNT(repr('<'))} + 3 * {_COUNT(repr('>'))} + 5 * {_COUNT(repr(chr(34)))}"
_ESCAPES = " + ".join(_COUNT(f"chr({n})") for n in (34, 92, 9, 10, 13))
_RETURNS = f"{_COUNT('chr(10)')} - (LENGTH(text) - LENGTH(REPLACE(text, chr(13) || chr(10), chr(10))))"
_WAYS = ", ".join(f"('{way}_{unit}', {size} + {more})" for way, more in (("entity", _ENTITIES), ("json", _ESCAPES), ("crlf", _RETURNS)) for unit, size in (("chars", "LENGTH(text)"), ("bytes", "STRLEN(text)")))

_LIMITS = f"""WITH d AS (SELECT DISTINCT doc_id, {_NAME("source")} AS source, text FROM documents
    WHERE doc_id IS NOT NULL AND REGEXP_MATCHES(text, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]')),
  l AS (SELECT source, w.way, w.size::BIGINT AS size FROM d, LATERAL (SELECT * FROM (VALUES ('chars', LENGTH(text)), ('bytes', STRLEN(text)), {_WAYS}) v(way, size)) w WHERE source IS NOT NULL),
  c AS (SELECT source, way, size, COUNT(*) AS texts FROM l GROUP BY ALL),
  a AS (SELECT *, (SUM(texts) OVER (PARTITION BY source, way ORDER BY size RANGE BETWEEN {truncation.LIMIT_AROUND} PRECEDING AND {truncation.LIMIT_AROUND} FOLLOWING) - texts) / {2.0 * truncation.LIMIT_AROUND} + 0.5 AS mean,
    COALESCE(SUM(texts) OVER (PARTITION BY source, way ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS longer FROM c)"""

SQL: dict[str, str] = {
    "p8_limits": f"""{_LIMITS} SELECT source, way, size, texts FROM a
      WHERE texts >= {truncation.LIMIT_OVER} * mean AND texts >= mean + {truncation.LIMIT_DEVIATIONS} * SQRT(mean) AND longer <= texts""",
    "p7_characters": f"{_MIX('most * weights')} SELECT * FROM used",
    "p7_short": f"""{_MIX('everything')}, u AS (SELECT source, SUM(n_tokens * uses)::BIGINT AS used_tokens, COUNT(*) AS n_documents, MAX(uses) AS most_uses FROM used GROUP BY source)
      SELECT source, ROUND(target_share, 6) AS target_share, tokens::BIGINT AS available_tokens, ROUND(budget, 6) AS budget_tokens, max_repeats, COALESCE(used_tokens, 0) AS used_tokens,
        COALESCE(n_documents, 0) AS n_documents, COALESCE(most_uses, 0) AS most_uses, ROUND(GREATEST(0, budget - max_repeats * tokens), 6) AS shortfall_tokens,
        ROUND(COALESCE(used_tokens / (SELECT SUM(used_tokens) FROM u), 0), 6) AS actual_share FROM p LEFT JOIN u USING (source)""",
}

QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_characters": p7_characters, "p7_short": p7_short,
    "p8_found": p8_found, "p8_limits": p8_limits, "p8_sources": p8_sources,
}
