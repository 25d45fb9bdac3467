"""The extraction pipeline: documents, chunks, prompts, model, records, merge.

Everything up to the prompts is one narrow plan: a chunk carries its document's
context and the end of the chunk before it, so nothing is shuffled for them. The
model stage runs while the pipeline is being called, as its output is written
once; what follows is lazy again, but for the writes between passes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.core.errors import InvalidDocumentError
from textlode.core.session import materialize
from textlode.operators.candidates import Resolver, resolve_answers
from textlode.operators.merge import merge_passes
from textlode.operators.model import Chain, Model, RuleModel, call_events, generate
from textlode.operators.prompts import PromptOptions, enforce_lint, prompt
from textlode.operators.tokens import Tokenizer, chunks_of, compose_context, random_document_id, tokenize
from textlode.plans.progress import Step, Watch, wants_line


@dataclass(frozen=True)
class PipelineOptions:
    """Settings of a run. ``context`` goes before each chunk's own; ``prompt_builder`` replaces the prompt expression."""

    max_char_buffer: int = 1000
    passes: int = 1
    context_window_chars: int | None = None
    context: str | None = None
    prompts: PromptOptions = field(default_factory=PromptOptions)
    prompt_builder: Callable[[Column, Column], Column] | None = None
    lint_level: str = "off"
    resolver: Resolver = field(default_factory=Resolver)
    workers: int = 10
    tokenizer: Tokenizer = tokenize
    fail_fast: bool = True
    batch_length: int = 10
    on_progress: Callable[[Step], object] | None = None
    show_progress: bool = False


def rule_chain() -> Chain:
    return Chain([Model("rules", "rules-1", RuleModel())])


@dataclass(frozen=True)
class Document:
    """A document made on the driver; without an id it gets one at random."""

    text: str | None
    document_id: str = field(default_factory=random_document_id)
    additional_context: str | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)


def documents(spark: SparkSession, items: Iterable[Document | str | None]) -> DataFrame:
    """(document_id, text, metadata) of documents, or of texts alone."""
    made = [x if isinstance(x, Document) else Document(x) for x in items]
    rows = [(x.document_id, x.text, {**x.metadata, **({"additionalContext": x.additional_context} if x.additional_context is not None else {})}) for x in made]
    return spark.createDataFrame(rows, "document_id string, text string, metadata map<string,string>")


def check_unique(documents: DataFrame, key: str) -> DataFrame:
    """``documents``, or InvalidDocumentError where an id occurs twice."""
    twice = documents.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise InvalidDocumentError(f"Duplicate document id: {twice[0][0]}")
    return documents


def plan_chunks(documents: DataFrame, o: PipelineOptions, key: str = "document_id", text: str = "text", metadata: str | None = "metadata") -> DataFrame:
    """(document_id, chunk_no, char_offset, chunk_text, chunk_context) of all chunks."""
    own = F.try_element_at(metadata, F.lit("additionalContext")) if metadata and metadata in documents.columns else F.lit(None)
    source = documents.select(key, text, own.cast("string").alias("_own"))
    tail = o.context_window_chars if o.context_window_chars and o.context_window_chars > 0 else None
    chunks = chunks_of(source, key, o.max_char_buffer, text, o.tokenizer, keep=["_own"], tail_chars=tail)
    before = F.concat(F.lit("Previous chunk context:\n"), F.col("chunk_tail")) if tail else F.lit(None).cast("string")
    return chunks.select(key, "chunk_no", "char_offset", "chunk_text", compose_context(F.col("_own"), before).alias("chunk_context"))


def plan_prompts(chunks: DataFrame, o: PipelineOptions) -> DataFrame:
    """The chunks of every pass with their prompt."""
    context = compose_context(F.lit(o.context).cast("string"), F.col("chunk_context"))
    build = o.prompt_builder or (lambda text, ctx: prompt(text, ctx, o.prompts))
    df = chunks.withColumn("prompt", build(F.col("chunk_text"), context))
    if o.lint_level != "off":
        df = enforce_lint(df, "prompt", o.lint_level, need_json=o.prompts.output != "none").drop("prompt_issues")
    passes = F.sequence(F.lit(0), F.lit(max(1, o.passes) - 1))
    return df.withColumn("pass", F.explode(passes)).withColumn("pass", F.col("pass").cast("int"))


@dataclass(frozen=True)
class Run:
    """What a run of the pipeline gives.

    ``records``: see ``extract``. ``events``: an attempt of a model call each, with
    document, pass and chunk. ``errors``: the chunks that gave no records, with
    what the model or the parser said.
    """

    records: DataFrame
    events: DataFrame
    errors: DataFrame


def run(documents: DataFrame, chain: Chain | None = None, options: PipelineOptions | None = None, key: str = "document_id", text: str = "text") -> Run:
    """Run the model over all documents.

    The model's output is written to the shared folder once, so later actions and
    retries don't call it again. Documents of a null text have no records; an id
    that occurs twice is refused before any call.
    """
    o = options or PipelineOptions()
    chain = chain or rule_chain()
    prompts = plan_prompts(plan_chunks(check_unique(documents, key), o, key, text), o)
    prompts = prompts.withColumn("chunk_chars", F.length("chunk_text"))
    line = sys.stderr if o.show_progress and wants_line() else None
    if o.on_progress or line:
        totals = prompts.agg(F.count("*").alias("n"), F.coalesce(F.sum("chunk_chars"), F.lit(0)).alias("c")).first()
        with Watch(documents.sparkSession, totals["n"], totals["c"], o.on_progress, chain.models[0].model_id, line) as watch:
            outputs = materialize(generate(prompts, chain, workers=o.workers, fail_fast=o.fail_fast, done=watch.reporter(), size="chunk_chars"))
    else:
        outputs = materialize(generate(prompts, chain, workers=o.workers, fail_fast=o.fail_fast))
    keys = [key, "pass", "chunk_no", "char_offset"]
    on_error = "drop" if o.resolver.suppress_parse_errors else "raise" if o.fail_fast else "keep"
    records = resolve_answers(outputs, keys, "chunk_text", "output", o.resolver, on_error)
    unread = records.filter("parse_error is not null").select(key, "pass", "chunk_no", F.col("parse_error").alias("error"))
    uncalled = outputs.filter("call_error is not null").select(key, "pass", "chunk_no", F.col("call_error").alias("error"))
    events = call_events(outputs, key, F.col("pass").alias("pass_index"), F.col("chunk_no").alias("chunk_index"))
    return Run(merged(records, o.passes, key), events, uncalled.unionByName(unread))


def extract(documents: DataFrame, chain: Chain | None = None, options: PipelineOptions | None = None, key: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, pass, label, text, start_pos, end_pos, confidence, alignment_status, alignment_score, raw) of all documents.

    Offsets are those of the document; unaligned records have -1. See ``run``,
    which gives the events of the model calls too.
    """
    return run(documents, chain, options, key, text).records


def merged(records: DataFrame, passes: int, key: str = "document_id") -> DataFrame:
    """Records moved to document offsets and merged over the passes."""
    shift = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("char_offset")).otherwise(F.col(c)).cast("int").alias(c)
    seq = (F.col("chunk_no").cast("bigint") * (1 << 20) + F.col("seq")).alias("_seq")
    rows = records.filter("parse_error is null").select(
        F.col(key).alias("document_id"), "pass", "label", "text", shift("start_pos"), shift("end_pos"), "confidence", "alignment_status", "alignment_score", "raw", seq
    )
    out = merge_passes(rows, "_seq", range(max(1, passes))).drop("_seq")
    return out if key == "document_id" else out.withColumnRenamed("document_id", key)
