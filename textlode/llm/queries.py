"""Registered queries of the operators for training data and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.core.session import materialize, table
from textlode.llm import bpe, lookalikes, mixing, mojibake, pieces, quantiles, sentences, survivors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents")).select("doc_id")


@query()
def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_garbled(table(spark, d, "documents"))


_P6_SQL = """
WITH c AS (SELECT provider, model_id, CAST(called_at AS DATE) AS day, duration_ms AS v FROM model_calls WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms)),
v AS (SELECT 'all' AS scope, provider, model_id, NULL::DATE AS day, v FROM c UNION ALL SELECT 'day', provider, model_id, day, v FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, provider, model_id, day ORDER BY v) AS k, count(*) OVER (PARTITION BY scope, provider, model_id, day) AS n FROM v),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q)
SELECT scope, provider, model_id, day, q, n, v AS value FROM r, q WHERE k = greatest(1, CAST(ceil(q * n) AS BIGINT))
"""


@query(_P6_SQL)
def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of each model over all its calls (scope all) and over those of each day (scope day)."""
    calls = table(spark, d, "model_calls").select("provider", "model_id", F.to_date("called_at").alias("day"), "duration_ms")
    over_all = quantiles.percentiles(calls, ["provider", "model_id"], "duration_ms").withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")})
    by_day = quantiles.percentiles(calls, ["provider", "model_id", "day"], "duration_ms").withColumn("scope", F.lit("day"))
    return over_all.unionByName(by_day).select("scope", "provider", "model_id", "day", "q", "n", "value")


@query()
def p6_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Each day of calls summarised by itself, the days put together afterwards."""
    calls = table(spark, d, "model_calls").withColumn("day", F.to_date("called_at"))
    days = quantiles.summarize(calls, ["provider", "model_id", "day"], "duration_ms")
    merged = quantiles.merge_summaries(days, ["provider", "model_id"])
    return quantiles.summary_percentiles(merged, ["provider", "model_id"])


@query(
    """
WITH v AS (SELECT provider, model_id, duration_ms AS v FROM model_calls WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms)),
r AS (SELECT *, row_number() OVER (PARTITION BY provider, model_id ORDER BY v) AS k, count(*) OVER (PARTITION BY provider, model_id) AS n FROM v),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q)
SELECT provider, model_id, q, n, v AS exact, true AS within FROM r, q WHERE k = greatest(1, CAST(ceil(q * n) AS BIGINT))
"""
)
def p6_days_within(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles put together from days beside the exact ones, and whether they keep their bound of half a percent."""
    exact = quantiles.percentiles(table(spark, d, "model_calls"), ["provider", "model_id"], "duration_ms")
    put = p6_from_days(spark, d).select(F.col("provider").alias("_p"), F.col("model_id").alias("_m"), F.col("q").alias("_q"), F.col("n").alias("_n"), F.col("value").alias("_v"))
    both = exact.join(put, F.col("provider").eqNullSafe(F.col("_p")) & F.col("model_id").eqNullSafe(F.col("_m")) & (F.col("q") == F.col("_q")), "left")
    near = (F.col("_n") == F.col("n")) & ((F.col("_v") == F.col("value")) | (F.abs(F.col("_v") - F.col("value")) <= 0.005 * F.abs("value") * (1 + 1e-9) + 1e-9))
    return both.select("provider", "model_id", "q", "n", F.col("value").alias("exact"), F.coalesce(near, F.lit(False)).alias("within"))


_P2_SQL = """
WITH RECURSIVE r AS (
  SELECT DISTINCT extraction_id AS id, document_id AS doc, lower(trim(label)) AS lab, start_pos AS st, end_pos AS en, lower(upper(text)) AS lt,
    CASE WHEN alignment_status IN ('exact', 'match_exact') THEN 3 WHEN alignment_status IN ('lesser', 'match_lesser', 'match_greater') THEN 2 ELSE 1 END AS rank,
    coalesce(alignment_score, 0) AS score, coalesce(confidence, 0) AS conf, pass
  FROM extractions),
e AS (
  SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.doc = b.doc AND a.lab = b.lab AND a.id <> b.id
  AND ((a.st >= 0 AND a.st = b.st AND a.en = b.en) OR ((a.st < 0 OR b.st < 0) AND a.lt = b.lt))),
reach AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
g AS (SELECT id, min(root) AS first_id FROM reach GROUP BY id),
k AS (SELECT first_id, r.id, row_number() OVER (PARTITION BY first_id ORDER BY rank DESC, score DESC, conf DESC, pass, r.id) AS n FROM g JOIN r ON r.id = g.id)
SELECT first_id, id AS survivor_id FROM k WHERE n = 1
"""


@query(_P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_records(table(spark, d, "extractions"))


@query()
def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    return survivors.merged_records(table(spark, d, "extractions"))


@query(
    """
SELECT DISTINCT d.id AS document_id FROM input_docs d JOIN chunk_options o
ON o.profile = CASE WHEN regexp_matches(d.metadata['chunkProfile'], '[^ ]') THEN d.metadata['chunkProfile'] ELSE 'default' END
WHERE length(regexp_replace(d.text, '^[\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+|[\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+$', '', 'g')) > o.max_char_buffer
"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that come out in more than one piece."""
    cut = pieces.cut_documents(table(spark, d, "input_docs"), table(spark, d, "chunk_options"), oversized_only=True, with_text=False)
    return cut.filter("piece_no = 1").select(F.col("id").alias("document_id")).distinct()


@query()
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "input_docs").dropDuplicates(["id"])
    return pieces.cut_documents(docs, table(spark, d, "chunk_options"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.find_lookalikes(table(spark, d, "extractions"), table(spark, d, "resolve_inputs"))


@query()
def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Both text columns in one form, spelt by the vocabulary of all of them; repeated rows stay repeated."""
    e = table(spark, d, "extractions").select(F.lit("extractions").alias("source_table"), F.col("extraction_id").alias("record_id"), "text")
    r = table(spark, d, "resolve_inputs").select(F.lit("resolve_inputs").alias("source_table"), F.col("resolve_id").alias("record_id"), F.col("source_text").alias("text"))
    both = e.unionByName(r).withColumn("record", F.struct("source_table", "record_id"))
    out = lookalikes.canonical_texts(both, "record", "text", lookalikes.vocabulary(both, "text"))
    return out.select("record.source_table", "record.record_id", "text", "canonical")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every distinct document, by a model fitted to all texts; repeated deliveries carry the same text."""
    docs = table(spark, d, "input_docs").select("id", "text").filter("text is not null")
    units = sentences.split_documents(docs, sentences.fit(docs), once=True)
    return units.select(F.col("id").alias("document_id"), "start_pos", "end_pos")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.mix_sources(mixing.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@query()
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in each mix."""
    return _mixture(spark, d).rows


@query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that each mix reached."""
    return _mixture(spark, d).shares


def _sized_mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    """Each mix as large as what its sources hold: where targets and repeats don't give that, the bisected exponent decides."""
    sizes = materialize(mixing.token_sizes(table(spark, d, "documents")))
    targets = table(spark, d, "mix_targets")
    return mixing.mix_sources(sizes, targets, mixing.held_tokens(sizes, targets))


@query()
def p8_sized(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in each mix of a given size."""
    return _sized_mixture(spark, d).rows


@query()
def p8_sized_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that each mix of a given size reached, and its exponent."""
    return _sized_mixture(spark, d).shares
