"""Registered queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.control import registry
from textlode.core import jstext
from textlode.core.session import scratch, small, table
from textlode.operators import align, candidates, formats, merge, model, prompts, tokens, viz
from textlode.plans import pipeline
from textlode.sources import jsonl
from textlode.sources.strict_rows import check_answers, check_lines, split_rows
from textlode.streaming import extract as stream

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


def _checked_lines(spark: SparkSession, d: str) -> DataFrame:
    return check_lines(table(spark, d, "csv_rows"), table(spark, d, "csv_sources"))


_WS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# r: the fields of every line, and whether their number fits; the rules of a row that loads
_LINES_SQL = r"""
l AS (SELECT DISTINCT row_id, file_name, regexp_replace(line, chr(13) || '$', '') AS line FROM csv_rows),
s AS (SELECT row_id, header_cols, coalesce(delimiter, ',') AS dl, line FROM l JOIN csv_sources USING (file_name) WHERE regexp_matches(line, '[^\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]')),
c AS (SELECT row_id, dl, unnest(string_split(line || dl, '')) AS ch, generate_subscripts(string_split(line || dl, ''), 1) AS p FROM s),
q AS (SELECT *, sum(CASE WHEN ch = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY p) AS quotes FROM c),
n AS (SELECT *, ch = dl AND quotes % 2 = 0 AS parts FROM q),
i AS (SELECT *, sum(CASE WHEN parts THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY p) - CASE WHEN parts THEN 1 ELSE 0 END AS k FROM n),
f AS (SELECT row_id, k, coalesce(string_agg(ch, '' ORDER BY p) FILTER (NOT parts), '') AS raw FROM i GROUP BY row_id, k),
u AS (SELECT row_id, k, CASE WHEN raw LIKE '"%' THEN replace(substr(raw, 2, length(raw) - 2), '""', '"') ELSE raw END AS v,
  NOT contains(raw, '"') OR regexp_full_match(raw, '(?s:"([^"]|"")*")') AS sound FROM f),
m AS (SELECT row_id, list(v ORDER BY k) AS vs, bool_and(sound) AS sound FROM u GROUP BY row_id),
r AS (SELECT row_id, sound AND len(vs) = len(header_cols) AS fits, vs[list_position(header_cols, 'id')] AS id, vs[list_position(header_cols, 'text')] AS text, vs[list_position(header_cols, 'label')] AS label,
  vs[list_position(header_cols, 'start_pos')] AS sp, vs[list_position(header_cols, 'end_pos')] AS ep, vs[list_position(header_cols, 'confidence')] AS cf, vs[list_position(header_cols, 'recorded_at')] AS ra FROM m JOIN s USING (row_id))"""
_LOADS_SQL = r"""fits AND coalesce(regexp_matches(id, '[^\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]'), true) AND coalesce(regexp_full_match(sp, '[0-9]+'), true) AND coalesce(regexp_full_match(ep, '[0-9]+'), true)
AND coalesce(cf = '' OR regexp_full_match(cf, '[0-9]+(\.[0-9]+)?') AND TRY_CAST(cf AS DOUBLE) <= 1, true)
AND coalesce(regexp_full_match(ra, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') AND TRY_CAST(replace(replace(ra, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL AND substr(ra, 12, 2) < '24', true)"""


def _strict(x: str) -> str:
    """Whether a text is JSON without what DuckDB reads beyond the grammar: NaN, infinities and commas before a closing mark."""
    bare = rf"""regexp_replace({x}, '"([^"\\]|\\.)*"', '""', 'g')"""
    return rf"json_valid({x}) AND NOT regexp_matches({bare}, '(?i)nan|inf|,\s*[\]}}]')"


# an: what every answer holds, by its fence or as it is, with and without its reasoning
_ANSWERS_SQL = rf"""
a0 AS (SELECT DISTINCT resolve_id, regexp_replace(model_output, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS body FROM resolve_inputs WHERE model_output IS NOT NULL),
a1 AS (SELECT *, regexp_extract_all(body, '(?s)```([A-Za-z0-9_+-]+)?(?:[{_WS}]*\n)?(.*?)```', 1) AS tags, regexp_extract_all(body, '(?s)```([A-Za-z0-9_+-]+)?(?:[{_WS}]*\n)?(.*?)```', 2) AS blocks FROM a0),
a2 AS (SELECT *, list_filter(generate_series(1, len(tags)), lambda i: coalesce(tags[i], '') = '' OR lower(tags[i]) = 'json') AS own FROM a1),
a3 AS (SELECT resolve_id, CASE WHEN body = '' OR len(own) > 1 OR len(own) = 0 AND len(blocks) > 1 THEN NULL WHEN len(own) = 1 THEN blocks[own[1]] WHEN len(blocks) = 1 THEN blocks[1] ELSE body END AS content FROM a2),
a4 AS (SELECT resolve_id, regexp_replace(content, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS c, regexp_replace(regexp_replace(content, '(?is)<think>.*?</think>[{_WS}]*', '', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS c2 FROM a3),
a5 AS (SELECT resolve_id, CASE WHEN {_strict('c')} THEN c WHEN {_strict('c2')} THEN c2 END AS j FROM a4),
an AS (SELECT resolve_id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN CASE WHEN json_type(j, '$.extractions') = 'ARRAY' THEN json_extract(j, '$.extractions[*]') END END AS items FROM a5)"""


@query(
    f"""WITH {_LINES_SQL}, {_ANSWERS_SQL}
SELECT 'csv_rows' AS source_table, row_id AS record_id FROM r WHERE NOT ({_LOADS_SQL})
UNION SELECT 'resolve_inputs', resolve_id FROM an WHERE items IS NULL OR len(list_filter(items, lambda x: json_type(x) NOT IN ('OBJECT', 'ARRAY'))) > 0"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct failing record of both tables."""
    lines = split_rows(_checked_lines(spark, d).select("row_id", "errors"))[1]
    answers = split_rows(check_answers(table(spark, d, "resolve_inputs").select("resolve_id", "model_output")))[1]
    return (
        lines.select(F.lit("csv_rows").alias("source_table"), F.col("row_id").alias("record_id"))
        .unionByName(answers.select(F.lit("resolve_inputs").alias("source_table"), F.col("resolve_id").alias("record_id")))
        .distinct()
    )


@query(f"""WITH {_LINES_SQL} SELECT row_id, id, text, label, TRY_CAST(sp AS BIGINT) AS start_pos, TRY_CAST(ep AS BIGINT) AS end_pos, TRY_CAST(cf AS DOUBLE) AS confidence, TRY_CAST(replace(replace(ra, 'T', ' '), 'Z', '') AS TIMESTAMP) AS recorded_at FROM r WHERE {_LOADS_SQL}""")
def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that load, each distinct one once, with their typed values."""
    rows = split_rows(_checked_lines(spark, d))[0]
    names = [c for c in rows.columns if c.startswith("v_") and c != "v_other"]
    return rows.select("row_id", *(F.col(c).alias(c[2:]) for c in names)).distinct()


# Tokens and sentences




@query(
    r"""
SELECT lower(coalesce(lang, 'none')) AS lang, count(*) AS n_docs,
  CAST(coalesce(sum(len(regexp_extract_all(text, '[\p{L}\p{M}]+'))), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(len(regexp_extract_all(text, '\p{N}+'))), 0) AS BIGINT) AS n_numbers
FROM documents GROUP BY 1
"""
)
def q_token_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens.token_counts("text")
    docs = table(spark, d, "documents").select(F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"), counts["n_words"].cast("bigint").alias("w"), counts["n_numbers"].cast("bigint").alias("n"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_numbers"))


def _distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "input_docs").dropDuplicates(["id"])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_docs(spark, d).select(F.col("id").alias("document_id"), "text")


_TILE = rf"[\p{{L}}\p{{M}}]+|\p{{N}}+|[{_WS}]+|(?s:.)"
# tok: the tokens of every text, white space dropped and equal symbols in a row joined
_TOKENS_SQL = rf"""
d AS (SELECT id AS document_id, any_value(text) AS text, any_value(metadata) AS metadata FROM input_docs WHERE text IS NOT NULL GROUP BY id),
tl AS (SELECT document_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT document_id, regexp_extract_all(text, '{_TILE}') AS l FROM d)),
tk AS (SELECT *, sum(length(x)) OVER (PARTITION BY document_id ORDER BY p) AS e,
  CASE WHEN regexp_full_match(x, '[\p{{L}}\p{{M}}]+') THEN 0 WHEN regexp_full_match(x, '\p{{N}}+') THEN 1 WHEN regexp_full_match(x, '[{_WS}]+') THEN 3 ELSE 2 END AS ty FROM tl),
tr AS (SELECT *, sum(CASE WHEN ty = 2 AND same THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY p) AS r
  FROM (SELECT *, coalesce(lag(x) OVER (PARTITION BY document_id ORDER BY p) = x, false) AS same FROM tk)),
tg AS (SELECT document_id, r, min(ty) AS ty, min(e - length(x)) AS a, max(e) AS b, string_agg(x, '' ORDER BY p) AS tok FROM tr GROUP BY document_id, r),
tn AS (SELECT *, coalesce(lag(ty) OVER o = 3 AND regexp_matches(lag(tok) OVER o, '[\r\n]'), false) AS broken FROM tg WINDOW o AS (PARTITION BY document_id ORDER BY r)),
tok AS (SELECT document_id, CAST(i AS INTEGER) AS i, ty, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, broken AND i > 0 AS nl, tok FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY r) - 1 AS i FROM tn WHERE ty <> 3))"""


@query(f"WITH {_TOKENS_SQL} SELECT document_id, i AS idx, ty AS token_type, a AS start_pos, b AS end_pos, nl AS after_newline FROM tok")
def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of all documents."""
    return tokens.tokens_of(_texts(spark, d), "document_id")


# mk: the tokens at which a sentence may end, and where it ends then
_MARKS_SQL = (
    _TOKENS_SQL
    + r""",
f AS (SELECT *, lag(tok) OVER o AS prev, lead(nl) OVER o AS nnl, substr(lead(tok) OVER o, 1, 1) AS nc, ty = 2 AND tok IN ('"', '''', '”', '’', '»', ')', ']', '}') AS closer
  FROM tok WINDOW o AS (PARTITION BY document_id ORDER BY i)),
g AS (SELECT *, ty = 2 AND right(tok, 1) IN ('.', '?', '!', '。', '！', '？', '।') AND coalesce(prev, '') || tok NOT IN ('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'St.') AS stop,
  coalesce(nnl, false) AND NOT (lower(nc) = nc AND upper(nc) <> nc) AS brk FROM f),
h AS (SELECT *, sum(CASE WHEN closer THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY i) AS island, max(i) OVER (PARTITION BY document_id) + 1 AS n FROM g),
mk AS (SELECT *, CASE WHEN stop THEN max(i) OVER (PARTITION BY document_id, island) + 1 WHEN brk THEN i + 1 END AS leads FROM h),
-- se: where the sentence ends that begins at a token
se AS (SELECT document_id, i, a, b, nl, n, CAST(coalesce(first_value(leads IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS INTEGER) AS e FROM mk)"""
)


@query(
    f"""WITH RECURSIVE {_MARKS_SQL},
sn AS (SELECT document_id, 0 AS sentence_no, i AS s, e, a, n FROM se WHERE i = 0
  UNION ALL SELECT se.document_id, sn.sentence_no + 1, se.i, se.e, se.a, se.n FROM sn JOIN se ON se.document_id = sn.document_id AND se.i = sn.e)
SELECT sn.document_id, sentence_no, s AS start_tok, sn.e AS end_tok, sn.a AS start_pos, t.b AS end_pos FROM sn JOIN se t ON t.document_id = sn.document_id AND t.i = sn.e - 1
"""
)
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all documents under the sentence rule."""
    return tokens.sentences_of(_texts(spark, d), "document_id")


def _chunks_sql(budget: str) -> str:
    """ck: the chunks of all documents as token intervals; a step either adds a sentence to a chunk or begins the next one."""
    return f"""{_MARKS_SQL},
bu AS (SELECT document_id, text, greatest(1, coalesce({budget}, 1000)) AS most FROM d LEFT JOIN chunk_options o ON o.profile = coalesce(d.metadata['chunkProfile'], 'default')),
s1 AS (SELECT se.*, most, max(CASE WHEN nl THEN i END) OVER (PARTITION BY se.document_id ORDER BY i) AS line FROM se JOIN bu ON bu.document_id = se.document_id),
s2 AS (SELECT s1.*, CAST(coalesce(u.i + 1, 0) AS INTEGER) AS fits FROM s1 ASOF LEFT JOIN se u ON u.document_id = s1.document_id AND u.b <= s1.a + s1.most),
s3 AS (SELECT s2.*, coalesce(l.line, -1) AS line_at FROM s2 LEFT JOIN s1 l ON l.document_id = s2.document_id AND l.i = s2.fits),
-- what a chunk that begins at a token holds: behind a broken sentence, or elsewhere
s4 AS (SELECT *, CASE WHEN fits <= i THEN i + 1 WHEN fits < e THEN CASE WHEN line_at > i THEN line_at ELSE fits END ELSE e END AS ce,
  CASE WHEN fits <= i THEN i + 1 < e ELSE fits < e END AS breaks, fits > i AND fits >= e AS whole FROM s3),
st AS (SELECT document_id, 0 AS chunk_no, i AS s, ce, breaks, whole AS open, fits, n FROM s4 WHERE i = 0
  UNION ALL
  SELECT st.document_id, CASE WHEN st.open AND x.e <= st.fits THEN st.chunk_no ELSE st.chunk_no + 1 END, CASE WHEN st.open AND x.e <= st.fits THEN st.s ELSE x.i END,
    CASE WHEN st.open AND x.e <= st.fits THEN x.e ELSE x.ce END, CASE WHEN st.open AND x.e <= st.fits THEN false ELSE x.breaks END,
    CASE WHEN st.open AND x.e <= st.fits THEN true ELSE x.whole AND NOT st.breaks END, CASE WHEN st.open AND x.e <= st.fits THEN st.fits ELSE x.fits END, st.n
  FROM st JOIN s4 x ON x.document_id = st.document_id AND x.i = st.ce),
cn AS (SELECT document_id, chunk_no, s, max(ce) AS e FROM st GROUP BY document_id, chunk_no, s),
-- one join at a time: the two ends of a chunk must not be joined with each other first
c1 AS MATERIALIZED (SELECT cn.document_id, chunk_no, s, CAST(cn.e AS INTEGER) AS e, se.a FROM cn JOIN se ON se.document_id = cn.document_id AND se.i = s),
co AS MATERIALIZED (SELECT c1.*, se.b FROM c1 JOIN se ON se.document_id = c1.document_id AND se.i = c1.e - 1),
ck AS (SELECT document_id, chunk_no, s AS start_tok, e AS end_tok, a AS char_offset, substr(text, a + 1, b - a) AS chunk_text FROM co JOIN bu USING (document_id)
  UNION ALL SELECT document_id, 0, 0, 0, 0, text FROM bu WHERE document_id NOT IN (SELECT document_id FROM tok))"""


@query(f"WITH RECURSIVE {_chunks_sql('o.max_char_buffer')} SELECT document_id AS id, chunk_no, start_tok, end_tok, char_offset, chunk_text FROM ck")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents under the budget of their profile."""
    budget = table(spark, d, "chunk_options").select(F.col("profile").alias("_p"), "max_char_buffer")
    docs = _distinct_docs(spark, d).withColumn("_profile", F.coalesce(F.try_element_at("metadata", F.lit("chunkProfile")), F.lit("default")))
    docs = docs.join(small(budget), F.col("_profile") == F.col("_p"), "left")
    return tokens.chunks_of(docs, "id", F.coalesce("max_char_buffer", F.lit(1000)))


@query("SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT id, text FROM input_docs) WHERE text IS NOT NULL")
def q_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Tiles join to their text again: counts the documents for which they do."""
    docs = _distinct_docs(spark, d).filter("text is not null").withColumn("again", F.array_join(tokens.token_tiles("text"), ""))
    return docs.filter("again = text").agg(F.count("*").alias("n_docs"), F.sum(F.length("again")).cast("bigint").alias("chars"))


# Contexts and prompts


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolve_inputs").dropDuplicates(["resolve_id"])


_CHUNK_SQL = "r AS (SELECT DISTINCT resolve_id, document_id, chunk_index, char_offset, source_text, model_output FROM resolve_inputs)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _lower(x: str) -> str:
    """Small letters, a sigma at a word's end in its final form."""
    return rf"regexp_replace(lower({x}), '(\p{{L}})σ(\P{{L}}|$)', '\1ς\2', 'g')"


def _blank(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[^{_WS}]') THEN {x} END"


@query(
    f"""
WITH {_CHUNK_SQL}, l AS (SELECT *, {_trim("right(lag(source_text) OVER (PARTITION BY document_id ORDER BY chunk_index), 200)")} AS tail FROM r),
m AS (SELECT id, any_value(metadata['additionalContext']) AS own FROM input_docs GROUP BY id),
c AS (SELECT resolve_id, {_blank("own")} AS own, CASE WHEN length(tail) > 0 THEN 'Previous chunk context:' || chr(10) || tail END AS prev FROM l LEFT JOIN m ON m.id = l.document_id)
SELECT resolve_id, CASE WHEN own IS NULL THEN prev WHEN prev IS NULL THEN own ELSE own || chr(10) || chr(10) || prev END AS chunk_context FROM c
"""
)
def q_context_window(spark: SparkSession, d: str) -> DataFrame:
    return _with_context(spark, d).select("resolve_id", "chunk_context")


def _with_context(spark: SparkSession, d: str) -> DataFrame:
    own = _distinct_docs(spark, d).select(F.col("id").alias("_id"), F.try_element_at("metadata", F.lit("additionalContext")).alias("_own"))
    chunks = _chunks(spark, d).join(own, F.col("document_id") == F.col("_id"), "left").drop("_id")
    return tokens.with_context(chunks, "document_id", "chunk_index", "source_text", 200, F.col("_own"))


_PROMPTS = prompts.PromptOptions(description="Find people and drugs.", schema=(("person", "a name"), ("medication", None)), questions=("Who?", " What? "))
_HEAD = "You are an information extraction assistant.\nTask:\nFind people and drugs.\n\nContext:\n"
_TAIL = '\n\nExtraction schema:\n1. person: a name\n2. medication\n\nQuestions:\n1. Who?\n2. What?\n\nInput text:\n'
_END = '\n\nReturn JSON only in this shape:\n{"extractions":[{"text":"","label":"","confidence":0.0}]}'


@query(
    f"""
WITH {_CHUNK_SQL}, m AS (SELECT id, any_value(metadata['additionalContext']) AS own FROM input_docs GROUP BY id)
SELECT resolve_id, '{_HEAD}' || coalesce({_trim(_blank("own"))}, 'No additional context provided.') || '{_TAIL}' || {_trim("source_text")} || '{_END}' AS prompt
FROM r LEFT JOIN m ON m.id = r.document_id WHERE source_text IS NOT NULL
"""
)
def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    own = _distinct_docs(spark, d).select(F.col("id").alias("_id"), F.try_element_at("metadata", F.lit("additionalContext")).alias("_own"))
    chunks = _chunks(spark, d).filter("source_text is not null").join(own, F.col("document_id") == F.col("_id"), "left")
    return chunks.select("resolve_id", prompts.prompt(F.col("source_text"), tokens.compose_context(F.col("_own")), _PROMPTS).alias("prompt"))


@query(
    f"""
WITH {_CHUNK_SQL} SELECT resolve_id, 'Answer the question using only the provided context.' || chr(10) || 'If the answer is unknown, use an empty answer and confidence 0.' || chr(10) || 'Question:' || chr(10) || 'Who was seen?'
|| chr(10) || chr(10) || 'Context:' || chr(10) || {_trim("source_text")} || chr(10) || chr(10) || 'Return YAML in this shape:' || chr(10) || 'answer: <short answer>' || chr(10) || 'confidence: <0..1>' || chr(10) || 'evidence: <quoted phrase from context>' AS prompt FROM r WHERE source_text IS NOT NULL
"""
)
def q_qa_prompts(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d).filter("source_text is not null")
    return chunks.select("resolve_id", prompts.qa_prompt(" Who was seen? ", F.col("source_text"), "yaml").alias("prompt"))


@query(
    f"""
WITH {_CHUNK_SQL} SELECT resolve_id, CAST(length({_trim("source_text")}) = 0 AS INTEGER) AS is_empty, CAST(length({_trim("source_text")}) > 400 AS INTEGER) AS too_long,
CAST(NOT regexp_matches(source_text, '(?i)json') AS INTEGER) AS no_json FROM r WHERE source_text IS NOT NULL
"""
)
def q_prompt_lint(spark: SparkSession, d: str) -> DataFrame:
    codes = _chunks(spark, d).filter("source_text is not null").withColumn("issues", prompts.lint(F.col("source_text"), 400))
    has = lambda c: F.array_contains("issues", c).cast("int")
    return codes.select("resolve_id", has("empty-prompt").alias("is_empty"), has("too-long").alias("too_long"), has("missing-json-instruction").alias("no_json"))


# Answers and alignment


@query()
def q_parse_answers(spark: SparkSession, d: str) -> DataFrame:
    """The records of all answers, aligned to their chunk; failing answers with their error."""
    return candidates.resolve_answers(_chunks(spark, d), ["resolve_id"], resolver=candidates.Resolver(index_suffix=None))


@query(
    f"""
WITH e AS (SELECT DISTINCT extraction_id, resolve_id, text FROM extractions), r AS (SELECT DISTINCT resolve_id, source_text FROM resolve_inputs),
p AS (SELECT extraction_id, {_trim("text")} AS x, source_text AS s FROM e JOIN r USING (resolve_id)),
h AS (SELECT extraction_id, x, CASE WHEN contains(s, x) THEN strpos(s, x) ELSE strpos({_lower("s")}, {_lower("x")}) END - 1 AS a FROM p WHERE length(x) > 0)
SELECT extraction_id, 'exact' AS status, CAST(a AS INTEGER) AS start_pos, CAST(a + length(x) AS INTEGER) AS end_pos FROM h WHERE a >= 0
"""
)
def q_align_exact(spark: SparkSession, d: str) -> DataFrame:
    """Extractions that stand in their chunk as they are, or case aside."""
    out = _extraction_sources(spark, d).select("extraction_id", align.exact_span(F.col("source_text"), F.col("text")).alias("a"))
    return out.filter("a is not null").select("extraction_id", "a.status", F.col("a.start").alias("start_pos"), F.col("a.end").alias("end_pos"))


def _extraction_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").select("extraction_id", "resolve_id", "text").dropDuplicates(["extraction_id"])
    r = _chunks(spark, d).select("resolve_id", "source_text")
    return e.join(r, "resolve_id")


_FOLD = "CASE WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, -1) ELSE {0} END"
# al: every extraction aligned to its chunk: as it stands or case aside, by letters and digits, by shared words
_ALIGN_SQL = f"""
e AS (SELECT DISTINCT extraction_id, resolve_id, text, label FROM extractions), r AS (SELECT DISTINCT resolve_id, source_text FROM resolve_inputs),
p AS (SELECT extraction_id, label, text, {_trim("text")} AS x, source_text AS s FROM e JOIN r USING (resolve_id)),
h AS (SELECT *, CASE WHEN length(x) > 0 THEN CASE WHEN contains(s, x) THEN strpos(s, x) ELSE strpos({_lower("s")}, {_lower("x")}) END ELSE 0 END AS a,
  lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) AS want FROM p WHERE text IS NOT NULL AND s IS NOT NULL),
-- by letters and digits
b1 AS (SELECT extraction_id, want, strpos(lower(regexp_replace(s, '[^A-Za-z0-9]+', '', 'g')), want) AS k, string_split(s, '') AS l FROM h WHERE a = 0 AND want <> ''),
b2 AS (SELECT extraction_id, k, length(want) AS n, list_filter(generate_series(1, len(l)), lambda i: regexp_full_match(l[i], '[A-Za-z0-9]')) AS at FROM b1 WHERE k > 0),
-- by shared words
m AS (SELECT h.* FROM h WHERE a = 0 AND length(x) > 0 AND extraction_id NOT IN (SELECT extraction_id FROM b2)),
x1 AS (SELECT extraction_id, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM m),
x2 AS (SELECT extraction_id, {_FOLD.format("w")} AS w, count(*) AS c FROM x1 GROUP BY 1, 2),
xn AS (SELECT extraction_id, CAST(sum(c) AS INTEGER) AS n FROM x2 GROUP BY 1),
s1 AS (SELECT extraction_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT extraction_id, regexp_extract_all(s, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS l FROM m)),
s2 AS (SELECT *, CAST(sum(length(t)) OVER (PARTITION BY extraction_id ORDER BY i) AS INTEGER) AS e FROM s1),
s3 AS (SELECT extraction_id, lower(t) AS w, e - length(t) AS a, e, row_number() OVER (PARTITION BY extraction_id ORDER BY i) - 1 AS k FROM s2 WHERE regexp_matches(t, '^[A-Za-z0-9]')),
s4 AS (SELECT extraction_id, {_FOLD.format("w")} AS w, a, e, k, count(*) OVER (PARTITION BY extraction_id) AS words FROM s3),
hit AS (SELECT s4.extraction_id, s4.w, s4.k, x2.c FROM s4 JOIN x2 ON x2.extraction_id = s4.extraction_id AND x2.w = s4.w),
win AS (SELECT s4.extraction_id, s4.k, unnest(generate_series(greatest(1, n - 2), n + 2)) AS size, words, n FROM s4 JOIN xn USING (extraction_id)),
cnt AS (SELECT win.extraction_id, win.k, size, n, hit.w, least(count(*), any_value(c)) AS shared FROM win JOIN hit ON hit.extraction_id = win.extraction_id AND hit.k >= win.k AND hit.k < win.k + size WHERE win.k + size <= words GROUP BY ALL),
sc AS (SELECT extraction_id, k, size, sum(shared) / greatest(any_value(n), size) AS score FROM cnt GROUP BY 1, 2, 3),
best AS (SELECT extraction_id, k, size, score FROM sc WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY score DESC, k, size) = 1),
fz AS (SELECT best.extraction_id, f.a AS a, l.e AS b, score FROM best JOIN s4 f ON f.extraction_id = best.extraction_id AND f.k = best.k JOIN s4 l ON l.extraction_id = best.extraction_id AND l.k = best.k + size - 1),
al AS (SELECT p.extraction_id, p.label, CASE WHEN p.text IS NULL OR p.s IS NULL THEN NULL WHEN h.a > 0 THEN 'exact' WHEN b2.k > 0 THEN 'lesser' ELSE 'fuzzy' END AS status,
  CAST(CASE WHEN h.extraction_id IS NULL THEN NULL WHEN h.a > 0 THEN h.a - 1 WHEN b2.k > 0 THEN b2.at[b2.k] - 1 ELSE coalesce(fz.a, -1) END AS INTEGER) AS start_pos,
  CAST(CASE WHEN h.extraction_id IS NULL THEN NULL WHEN h.a > 0 THEN h.a - 1 + length(h.x) WHEN b2.k > 0 THEN b2.at[b2.k + b2.n - 1] ELSE coalesce(fz.b, -1) END AS INTEGER) AS end_pos,
  CASE WHEN h.extraction_id IS NULL THEN NULL WHEN h.a > 0 THEN 1.0 WHEN b2.k > 0 THEN 0.95 ELSE coalesce(fz.score, 0.0) END::DOUBLE AS score
  FROM p LEFT JOIN h USING (extraction_id) LEFT JOIN b2 USING (extraction_id) LEFT JOIN fz USING (extraction_id))"""


@query(f"WITH {_ALIGN_SQL} SELECT extraction_id, status, start_pos, end_pos, score FROM al")
def q_align(spark: SparkSession, d: str) -> DataFrame:
    """All steps of the alignment for all extractions."""
    out = align.align_columns(_extraction_sources(spark, d), "source_text", "text")
    return out.select("extraction_id", "alignment.status", F.col("alignment.start").alias("start_pos"), F.col("alignment.end").alias("end_pos"), "alignment.score")


_SPANS = "SELECT DISTINCT extraction_id, document_id, label, text, start_pos, end_pos, confidence, alignment_status, pass FROM extractions"


def _status(x: str = "alignment_status") -> str:
    return f"CASE WHEN {x} IN ('exact', 'match_exact') THEN 'exact' WHEN {x} IN ('lesser', 'match_lesser', 'match_greater') THEN 'lesser' ELSE 'fuzzy' END"


@query(f"SELECT {_status()} AS alignment_status, pass, count(*) AS n FROM ({_SPANS}) GROUP BY 1, 2")
def q_status_by_pass(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").dropDuplicates(["extraction_id"])
    return e.groupBy(merge.normalize_status("alignment_status").alias("alignment_status"), "pass").agg(F.count("*").alias("n"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").dropDuplicates(["extraction_id"])
    e = e.withColumn("alignment_status", merge.normalize_status("alignment_status"))
    return e.select("extraction_id", *merge.KEY, "pass", "confidence", "alignment_status", "alignment_score")


_RANKED = f"""
n AS (SELECT *, {_status()} AS st FROM ({_SPANS})),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, label, start_pos, end_pos, text ORDER BY CASE st WHEN 'exact' THEN 3 WHEN 'lesser' THEN 2 ELSE 1 END DESC, coalesce(confidence, 0) DESC, pass, extraction_id) AS rn FROM n)"""


@query(f"WITH {_RANKED} SELECT extraction_id FROM k WHERE rn = 1")
def q_dedup_prefer(spark: SparkSession, d: str) -> DataFrame:
    return merge.dedup(_records(spark, d), "extraction_id").select("extraction_id")


def _merge_sql(passes: int) -> str:
    rank = "CASE st WHEN 'exact' THEN 3 WHEN 'lesser' THEN 2 ELSE 1 END DESC, coalesce(confidence, 0) DESC, pass, extraction_id"
    best = f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY document_id, label, start_pos, end_pos, text ORDER BY {rank}) AS rn FROM {{}}) WHERE rn = 1"
    steps = [f"n AS (SELECT *, {_status()} AS st FROM ({_SPANS}))", f"k0 AS ({best.format('(SELECT * FROM n WHERE pass = 0)')})"]
    for p in range(1, passes):
        fresh = f"""(SELECT * FROM n WHERE pass = {p} AND NOT (start_pos >= 0 AND end_pos > start_pos AND EXISTS (SELECT 1 FROM k{p - 1} k WHERE k.document_id = n.document_id
 AND k.start_pos >= 0 AND k.end_pos > k.start_pos AND k.start_pos < n.end_pos AND n.start_pos < k.end_pos)))"""
        steps.append(f"k{p} AS ({best.format(f'(SELECT * FROM k{p - 1} UNION ALL SELECT * FROM {fresh})')})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT extraction_id FROM k{passes - 1}"


@query(_merge_sql(4))
def q_merge_passes(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_passes(_records(spark, d), "extraction_id", range(4)).select("extraction_id")


@query(
    f"""WITH {_RANKED}, x AS (SELECT * FROM k WHERE rn = 1)
SELECT d.id AS document_id, CAST(count(x.extraction_id) AS INTEGER) AS n, string_agg(x.label || ':' || x.text, '|' ORDER BY x.start_pos, x.end_pos, icu_sort_key(x.label, 'und'), x.extraction_id) AS texts
FROM (SELECT DISTINCT id FROM input_docs) d LEFT JOIN x ON x.document_id = d.id GROUP BY d.id"""
)
def q_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its extractions in order, those without any too."""
    docs = _distinct_docs(spark, d).select(F.col("id").alias("document_id"))
    kept = merge.dedup(_records(spark, d), "extraction_id")
    out = merge.by_document(docs, kept, "extraction_id")
    texts = F.array_join(F.transform("extractions", lambda x: F.concat(x["label"], F.lit(":"), x["text"])), "|")
    return out.select("document_id", F.size("extractions").alias("n"), F.when(F.size("extractions") > 0, texts).alias("texts"))


# Sources and sinks


@query(
    rf"""
WITH l AS (SELECT row_id, any_value(file_name) AS file_name, regexp_replace(any_value(line), '[{_WS}]+$', '') AS line FROM csv_rows GROUP BY row_id),
s AS (SELECT row_id, list_position(header_cols, id_key) AS i, list_position(header_cols, text_key) AS t, coalesce(delimiter, ',') AS dl, line FROM l JOIN csv_sources USING (file_name) WHERE line <> ''),
c AS (SELECT row_id, i, t, dl, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS p FROM s),
q AS (SELECT *, lead(ch) OVER o AS nx, sum(CASE WHEN ch = '"' THEN 1 ELSE 0 END) OVER o - CASE WHEN ch = '"' THEN 1 ELSE 0 END AS quotes FROM c WINDOW o AS (PARTITION BY row_id ORDER BY p)),
-- a delimiter behind an even number of quotes parts fields; a quote counts as text where it's the first of two within quotes
k AS (SELECT *, ch = dl AND quotes % 2 = 0 AS parts, CASE WHEN ch = '"' THEN coalesce(quotes % 2 = 1 AND nx = '"', false) ELSE NOT (ch = dl AND quotes % 2 = 0) END AS kept FROM q),
f AS (SELECT row_id, i, t, p, ch, kept, 1 + sum(CASE WHEN parts THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY p) AS n FROM k),
w AS (SELECT row_id, max(n) AS n, coalesce(string_agg(ch, '' ORDER BY p) FILTER (kept AND n = i), '') AS id, coalesce(string_agg(ch, '' ORDER BY p) FILTER (kept AND n = t), '') AS text, any_value(greatest(i, t)) AS need FROM f GROUP BY row_id)
SELECT row_id, id, text FROM w WHERE n >= need
"""
)
def q_csv_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Id and text of every dataset row, those of quoted fields too."""
    return jsonl.dataset_rows(_csv_lines(spark, d), F.col("header_cols"), F.col("delimiter"), F.col("id_key"), F.col("text_key"), ["row_id"])


def _csv_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "csv_rows").dropDuplicates(["row_id"])
    source = table(spark, d, "csv_sources").withColumnRenamed("file_name", "_f")
    return lines.join(small(source), F.col("file_name") == F.col("_f"))


@query(
    f"""
WITH e AS (SELECT DISTINCT extraction_id, document_id, label, text, start_pos, end_pos, alignment_status, alignment_score, pass FROM extractions)
SELECT document_id, label, text, start_pos AS start, end_pos AS "end", {_status()} AS alignment_status, coalesce(alignment_score, 0) AS alignment_score, coalesce(pass, 0) AS pass, count(*) AS n
FROM e WHERE document_id IN (SELECT id FROM input_docs) GROUP BY ALL
"""
)
def q_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Annotated documents written as JSON Lines and loaded again."""
    docs = _distinct_docs(spark, d).select(F.col("id").alias("document_id"), "text")
    records = jsonl.annotated_records(docs, table(spark, d, "extractions").dropDuplicates(["extraction_id"]))
    path = scratch(spark, "jsonl")
    jsonl.save_annotated(records, path)
    back = jsonl.load_annotated(spark, path).filter("label is not null")
    return back.groupBy("document_id", "label", "text", "start", "end", "alignment_status", "alignment_score", "pass").agg(F.count("*").alias("n"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|0[0-9]{2})"


@query(
    rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\S*[:/]\S*')) AS word FROM documents WHERE text IS NOT NULL),
p AS (SELECT word, lower(regexp_extract({{t}}, '^(?i:https?)://([^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)(:[0-9]*)?([/?#](?s:.*))?$', 2)) AS host, {{t}} AS t FROM w)
SELECT word, NOT regexp_matches(t, '[{_WS}]') AND length(host) > 0 AND CASE WHEN host = 'localhost' THEN true
  WHEN host[1] = '[' THEN regexp_matches(host, '^\[[0-9a-f:]*:[0-9a-f:.]*\]$')
  WHEN regexp_matches(host, '^[0-9.]+$') THEN regexp_matches(host, '^{_OCTET}(\.{_OCTET}){{3}}$')
  ELSE contains(host, '.') AND NOT regexp_matches(host, '[\s<>^|%\\"`{{}}]') END AS is_url FROM p
""".replace("{t}", _trim("word"))
)
def q_is_url(spark: SparkSession, d: str) -> DataFrame:
    """All words of documents that hold a colon or slash, and whether they are an address."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\S*[:/]\S*"), F.lit(0))).alias("word")).distinct()
    return words.select("word", jsonl.is_url("word").alias("is_url"))


@query(
    """
WITH e AS (SELECT DISTINCT extraction_id, raw FROM extractions WHERE raw IS NOT NULL)
SELECT extraction_id, list_sort(list_filter(json_keys(raw), lambda k: k NOT IN ('text', 'label', 'start', 'end', 'confidence'))) AS keys FROM e WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'
"""
)
def q_raw_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The keys of raw records that are attributes."""
    e = table(spark, d, "extractions").dropDuplicates(["extraction_id"]).withColumn("a", jsonl.attributes_json(F.col("raw")))
    return e.filter("a is not null").select("extraction_id", F.array_sort(F.coalesce(F.json_object_keys("a"), F.array().cast("array<string>"))).alias("keys"))


# Model calls


@query(r"SELECT call_id, left(regexp_replace(regexp_replace(error_message, '(?i)(api[_-]?key\s*[:=]\s*)([^\s,;]+)', '\1[REDACTED]', 'g'), '(?i)(authorization\s*[:=]\s*bearer\s+)([^\s,;]+)', '\1[REDACTED]', 'g'), 600) AS message, regexp_matches(error_message, '(?i)deprecated|not found|temporar|unavailable|rate limit|overload') AS retriable FROM (SELECT DISTINCT call_id, error_message FROM model_calls) WHERE error_message IS NOT NULL")
def q_call_errors(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "model_calls").filter("error_message is not null").select("call_id", "error_message").distinct()
    return calls.select("call_id", prompts.redact(F.col("error_message")).alias("message"), F.col("error_message").rlike(model.RETRIABLE_SQL).alias("retriable"))


@query(
    f"""
WITH {_CHUNK_SQL} SELECT resolve_id, CASE WHEN length(p) <= 160 THEN p ELSE left(p, 157) || '...' END AS preview, CAST(length(source_text) AS INTEGER) AS chars
FROM (SELECT *, {_trim(f"regexp_replace(source_text, '[{_WS}]+', ' ', 'g')")} AS p FROM r WHERE source_text IS NOT NULL)
"""
)
def q_debug_preview(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter("source_text is not null").select("resolve_id", prompts.debug_preview(F.col("source_text")).alias("preview"), F.length("source_text").alias("chars"))


@query(
    """
WITH r AS (SELECT DISTINCT resolve_id, source_text FROM resolve_inputs)
SELECT resolve_id, row_number() OVER o AS completed_chunks, count(*) OVER () AS total_chunks, CAST(sum(coalesce(length(source_text), 0)) OVER o AS BIGINT) AS processed_chars, CAST(sum(coalesce(length(source_text), 0)) OVER () AS BIGINT) AS total_chars
FROM r WINDOW o AS (ORDER BY resolve_id ROWS UNBOUNDED PRECEDING)
"""
)
def q_progress_running(spark: SparkSession, d: str) -> DataFrame:
    out = viz.running_progress(_chunks(spark, d).select("resolve_id", "source_text"), ["resolve_id"], "source_text")
    return out.select("resolve_id", F.col("completed_chunks").cast("bigint").alias("completed_chunks"), "total_chunks", F.col("processed_chars").cast("bigint").alias("processed_chars"), "total_chars")


@query("WITH r AS (SELECT DISTINCT resolve_id FROM resolve_inputs) SELECT resolve_id, CAST((row_number() OVER (ORDER BY resolve_id) - 1) // 10 AS BIGINT) AS batch_no FROM r")
def q_batches(spark: SparkSession, d: str) -> DataFrame:
    return tokens.batches_of(_chunks(spark, d).select("resolve_id"), 10, ["resolve_id"]).select("resolve_id", "batch_no")


@query(
    """
WITH d AS (SELECT DISTINCT id, text FROM input_docs WHERE text IS NOT NULL)
SELECT id, n.n AS attempt, n.n > 1 AS fallback_used, n.n = CASE WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END AS success FROM d, (SELECT unnest([1, 2]) AS n) n WHERE n.n <= CASE WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END
"""
)
def q_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """Events of a chain whose first model is unavailable for texts of odd length."""
    docs = _distinct_docs(spark, d).filter("text is not null").select("id", F.col("text").alias("prompt"))
    chain = model.Chain([model.Model("flaky", "a", _odd_fails), model.Model("steady", "b", _echo)])
    return model.call_events(model.generate(docs, chain), "id").select("id", "attempt", "fallback_used", "success")


def _odd_fails(p: str, settings: object) -> str:
    if len(p) % 2:
        raise model.ModelError("busy", 503)
    return p


def _echo(p: str, settings: object) -> str:
    return p


_ALIASES = [("fast", "fast-2"), ("fast-2", "fast-3"), ("fast-3", "fast-4"), ("best", "fast"), ("a", "b"), ("b", "a"), ("solo", "solo-1"), ("best-eu", "best")]


@query(
    f"""
WITH RECURSIVE t(alias, target) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ALIASES)}),
w AS (SELECT alias, target, 1 AS hops FROM t UNION ALL SELECT w.alias, t.target, hops + 1 FROM w JOIN t ON t.alias = w.target WHERE hops < 17),
e AS (SELECT w.alias, w.target, hops FROM w WHERE target NOT IN (SELECT alias FROM t) AND hops <= 16)
SELECT t.alias, e.target, e.hops FROM t LEFT JOIN e ON e.alias = t.alias
"""
)
def q_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    return registry.resolve_aliases(spark.createDataFrame(_ALIASES, "alias string, target string"))


# Pages


@query(
    """
WITH l AS (SELECT DISTINCT lower(trim(coalesce(label, 'unknown'))) AS label FROM extractions)
SELECT label, (['#D2E3FC', '#C8E6C9', '#FEF0C3', '#F9DEDC', '#FFDDBE', '#EADDFF', '#C4E9E4', '#FCE4EC', '#E8EAED', '#DDE8E8'])[CAST((row_number() OVER (ORDER BY label) - 1) % 10 + 1 AS BIGINT)] AS color FROM l
"""
)
def q_label_colors(spark: SparkSession, d: str) -> DataFrame:
    return viz.label_colors(table(spark, d, "extractions").select(F.lower(F.trim(F.coalesce("label", F.lit("unknown")))).alias("label")))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents WHERE text IS NOT NULL")
def q_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", viz.escape_html("text").alias("html"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


_PALETTE_SQL = "[" + ", ".join(f"'{c}'" for c in viz.PALETTE) + "]"
_STYLE_SQL = "'" + viz.STYLE.replace("'", "''") + "'"


@query(
    f"""WITH {_RANKED}, d AS (SELECT id, any_value(text) AS text FROM input_docs WHERE text IS NOT NULL GROUP BY id),
c AS (SELECT id, coalesce(label, '{viz.UNLABELLED}') AS label, greatest(0, least(start_pos, length(d.text))) AS s, greatest(0, least(end_pos, length(d.text))) AS e, start_pos, end_pos, extraction_id
  FROM k JOIN d ON d.id = k.document_id WHERE rn = 1 AND start_pos IS NOT NULL AND end_pos IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, s - e, start_pos, end_pos, icu_sort_key(label, 'und'), extraction_id) - 1 AS n FROM c WHERE e > s),
l AS (SELECT id, label, ({_PALETTE_SQL})[CAST((row_number() OVER (PARTITION BY id ORDER BY lower(label), label DESC) - 1) % {len(viz.PALETTE)} + 1 AS BIGINT)] AS color, lower(label) AS o FROM (SELECT DISTINCT id, label FROM h)),
g AS (SELECT id, string_agg('<span class="lx-label" style="background-color:' || color || ';">' || {_escaped("label")} || '</span>', ' ' ORDER BY o, label DESC) AS legend FROM l GROUP BY id),
v AS (SELECT id, e AS place, 0 AS opens, e - s AS size, n, '</span>' AS tag FROM h
  UNION ALL SELECT id, s, 1, s - e, n, '<span class="lx-highlight' || CASE WHEN n = 0 THEN ' lx-current-highlight' ELSE '' END || '" data-idx="' || n || '" style="background-color:' || color || ';">' FROM h JOIN l USING (id, label)),
w AS (SELECT v.*, coalesce(lag(place) OVER o, 0) AS before, row_number() OVER o AS i FROM v WINDOW o AS (PARTITION BY id ORDER BY place, opens, size, n)),
b AS (SELECT id, string_agg({_escaped("substr(d.text, before + 1, place - before)")} || tag, '' ORDER BY i) AS body, max(place) AS last FROM w JOIN d USING (id) GROUP BY id)
SELECT d.id AS document_id, {_STYLE_SQL} || CASE WHEN b.id IS NULL THEN '<div class="lx-animated-wrapper"><p>No valid extractions to animate.</p></div>'
  ELSE '<div class="lx-animated-wrapper lx-gif-optimized"><div class="lx-legend">Highlights Legend: ' || legend || '</div><div class="lx-text-window">' || body || {_escaped("substr(d.text, last + 1)")} || '</div></div>' END AS html
FROM d LEFT JOIN b ON b.id = d.id LEFT JOIN g ON g.id = d.id"""
)
def q_highlight_html(spark: SparkSession, d: str) -> DataFrame:
    docs = _distinct_docs(spark, d).select(F.col("id").alias("document_id"), "text")
    return viz.pages(merge.by_document(docs, merge.dedup(_records(spark, d), "extraction_id"), "extraction_id"))


@query("SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]')) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def q_utf16_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", jstext.utf16_length("text").alias("n"))


# The pipeline


def _pipeline_docs(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_docs(spark, d).select(F.col("id").alias("document_id"), "text", "metadata")


_RULES = model.RuleModel().rules


def _rules_sql() -> str:
    each = " UNION ALL ".join(f"SELECT document_id, char_offset, chunk_text, '{label}' AS label, unnest(regexp_extract_all(chunk_text, '{pattern}')) AS text FROM ck" for label, pattern in _RULES)
    return f"""WITH RECURSIVE {_chunks_sql("1000")}, hit AS ({each}),
rec AS (SELECT DISTINCT document_id, label, text, CAST(strpos(chunk_text, text) - 1 + char_offset AS INTEGER) AS start_pos FROM hit)
SELECT document_id, 0 AS pass, label, text, start_pos, CAST(start_pos + length(text) AS INTEGER) AS end_pos, 0.9::DOUBLE AS confidence, 'exact' AS alignment_status, 1.0::DOUBLE AS alignment_score,
'{{"text": "' || text || '", "label": "' || label || '", "confidence": 0.9}}' AS raw FROM rec"""


@query(_rules_sql())
def q_extract(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over all documents with the rule model (words of ASCII), in two passes."""
    chain = model.Chain([model.Model("rules", "rules-1", model.RuleModel(tuple((label, "(?a)" + pattern) for label, pattern in _RULES)))])
    return pipeline.extract(_pipeline_docs(spark, d), chain, pipeline.PipelineOptions(passes=2, context_window_chars=100))


@query(_rules_sql())
def q_stream_extract(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline over a stream of all deliveries, repeated ones too; the records are those of q_extract."""
    base = scratch(spark, "stream")
    table(spark, d, "input_docs").select(F.col("id").alias("document_id"), "text").write.parquet(f"{base}/in")
    docs = stream.stream_documents(spark, f"{base}/in", "document_id string, text string")
    chain = model.Chain([model.Model("rules", "rules-1", model.RuleModel(tuple((label, "(?a)" + pattern) for label, pattern in _RULES)))])
    stream.extract_stream(docs, f"{base}/out", f"{base}/checkpoint", chain).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"


@query(
    rf"""
WITH d AS (SELECT DISTINCT id, text FROM input_docs WHERE text IS NOT NULL)
SELECT id AS document_id, unnest(regexp_extract_all(text, '{_DATE}')) AS text FROM d
"""
)
def q_extract_dates(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's own records of dates. It merges those of one chunk that have one text, so a date repeated there would show as a difference from the SQL."""
    chain = model.Chain([model.Model("rules", "dates", model.RuleModel((("date", _DATE),)))])
    return pipeline.extract(_pipeline_docs(spark, d), chain).select("document_id", "text")


# Answers made from the tables of known content


@query("SELECT c_custkey, c_name AS text, 'customer' AS label, 0.5::DOUBLE AS confidence, 0 AS start_pos, CAST(length(c_name) AS INTEGER) AS end_pos, 'exact' AS alignment_status FROM customer")
def q_parse_yaml(spark: SparkSession, d: str) -> DataFrame:
    """Fenced YAML answers."""
    body = F.concat(F.lit("Result:\n```yaml\n# found\nextractions:\n  - text: "), F.col("c_name"), F.lit("\n    label: customer\n    confidence: 0.5\n```"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("source_text"), body.alias("model_output"))
    out = candidates.resolve_answers(rows, ["c_custkey"], resolver=candidates.Resolver(formats.FormatHandler("yaml")))
    return out.filter("parse_error is null").select("c_custkey", "text", "label", "confidence", "start_pos", "end_pos", "alignment_status")


@query(
    """
WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS seq FROM nation)
SELECT n_regionkey, CAST(seq AS INTEGER) AS seq, n_name AS text, 'nation' AS label, CAST(n_nationkey AS VARCHAR) AS key FROM n
"""
)
def q_parse_class_based(spark: SparkSession, d: str) -> DataFrame:
    """Class-based answers whose index keys give another order than they stand in."""
    record = F.struct(F.col("n_name").alias("nation"), F.col("n_nationkey").alias("nation_index"), F.struct(F.col("n_nationkey").cast("string").alias("key")).alias("nation_attributes"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(record), asc=False)).alias("model_output"), F.concat_ws(" ", F.collect_list("n_name")).alias("source_text"))
    out = candidates.resolve_answers(rows, ["n_regionkey"], resolver=candidates.Resolver(index_suffix="_index"))
    return out.select("n_regionkey", "seq", "text", "label", F.get_json_object("raw", "$.attributes.key").alias("key"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN 'lesser' ELSE 'exact' END AS status, 0 AS start_pos, CAST(length(p_name) AS INTEGER) AS end_pos FROM part")
def q_align_lesser(spark: SparkSession, d: str) -> DataFrame:
    """Names written with other separators and case."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("s"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-_"))).alias("x"))
    out = align.align_columns(rows, "s", "x")
    return out.select("p_partkey", "alignment.status", F.col("alignment.start").alias("start_pos"), F.col("alignment.end").alias("end_pos"))


@query(
    """
WITH s AS (SELECT p_partkey, p_name || ' of ' || p_brand AS s FROM part), w AS (SELECT p_partkey, s, len(regexp_extract_all(s, '[A-Za-z0-9]+')) AS n FROM s)
SELECT p_partkey, CASE WHEN n >= 3 THEN 0 ELSE -1 END AS start_pos, CASE WHEN n >= 3 THEN CAST(length(s) AS INTEGER) ELSE -1 END AS end_pos, CASE WHEN n >= 3 THEN n / (n + 1) ELSE 0 END AS score FROM w
"""
)
def q_align_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Names with a word too many, found by shared words."""
    s = F.concat("p_name", F.lit(" of "), "p_brand")
    rows = table(spark, d, "part").select("p_partkey", s.alias("s"), F.concat(F.lit("zzz "), s).alias("x"))
    out = align.align_columns(rows, "s", "x")
    return out.select("p_partkey", F.col("alignment.start").alias("start_pos"), F.col("alignment.end").alias("end_pos"), "alignment.score")


@query(
    f"""WITH {_ALIGN_SQL} SELECT lower(trim(label)) AS label, count(*) AS n, count(*) FILTER (coalesce(start_pos < 0 OR end_pos <= start_pos, true)) AS n_failed,
count(*) FILTER (start_pos >= 0 AND end_pos > start_pos AND status <> 'exact') AS n_non_exact FROM al GROUP BY 1"""
)
def q_example_alignment(spark: SparkSession, d: str) -> DataFrame:
    """All extractions as examples of their chunk: how many there are, fail to align and align inexactly, by label."""
    out = align.align_columns(_examples(spark, d), "source_text", "text")
    failed = F.coalesce((F.col("alignment.start") < 0) | (F.col("alignment.end") <= F.col("alignment.start")), F.lit(True))
    inexact = ~failed & (F.col("alignment.status") != "exact")
    return out.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(inexact).alias("n_non_exact"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").select("extraction_id", "resolve_id", "text", "label").dropDuplicates(["extraction_id"])
    return e.join(_chunks(spark, d).select("resolve_id", "source_text"), "resolve_id")
