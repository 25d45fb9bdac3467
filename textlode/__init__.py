"""Structured information extraction over text on Spark.

``extract`` runs the pipeline by options, ``run`` by settings; the parts are in
``operators``, ``sources``, ``plans``, ``streaming``, ``functions`` and
``control``. Names are imported when they're first used.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

_NAMES = {
    "textlode.control.options": ("ExtractOptions", "LodeWarning", "extract", "pipeline_of"),
    "textlode.control.registry": ("Alias", "Environment", "LifeCycle", "Provider", "Registry", "Route", "SchemaHooks", "builtin_registry", "default_registry", "load_plugins", "parse_route", "resolve_aliases"),
    "textlode.core.errors": ("FormatParseError", "InferenceConfigError", "InferenceRuntimeError", "InvalidDocumentError", "PromptValidationError", "ProviderError"),
    "textlode.core.session": ("discard", "discard_all", "materialize", "shared_dir"),
    "textlode.functions.register": ("register",),
    "textlode.operators.align": ("AlignOptions", "align", "align_columns"),
    "textlode.operators.candidates": ("Resolver", "resolve_answers"),
    "textlode.operators.formats": ("FormatHandler", "OutputParser"),
    "textlode.operators.merge": ("by_document", "merge_passes", "normalize_status"),
    "textlode.operators.model": ("Answer", "Chain", "Model", "ModelError", "RuleModel", "generate"),
    "textlode.operators.prompts": ("PromptOptions", "prompt", "qa_prompt"),
    "textlode.operators.tokens": ("chunk_views", "chunks_of", "document_id", "random_document_id", "sentences_of", "tokenize", "tokens_of"),
    "textlode.operators.viz": ("PageOptions", "Progress", "pages", "visualize"),
    "textlode.plans.pipeline": ("Document", "PipelineOptions", "Run", "documents", "run"),
    "textlode.plans.progress": ("Step",),
    "textlode.sources.jsonl": ("Fetched", "fetch_text", "is_url", "load_annotated", "load_csv", "load_dataset", "read_jsonl", "save_annotated", "write_jsonl"),
    "textlode.sources.strict_rows": ("check_answers", "check_lines", "split_rows"),
    "textlode.streaming.extract": ("extract_stream", "stream_documents"),
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
