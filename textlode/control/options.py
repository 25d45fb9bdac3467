"""Options of an extraction run by name, in snake or camel case, and what follows from them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from textlode.control.registry import Registry, Resolved, default_registry, load_plugins_once
from textlode.core.errors import InferenceConfigError
from textlode.operators.align import AlignOptions
from textlode.operators.candidates import Resolver
from textlode.operators.formats import ATTRIBUTE_SUFFIX, EXTRACTIONS_KEY, FormatHandler
from textlode.operators.model import Chain
from textlode.operators.prompts import PromptOptions, example_issues, handle_example_issues
from textlode.plans.pipeline import PipelineOptions, check_unique
from textlode.plans.pipeline import extract as run_pipeline
from textlode.sources.jsonl import resolve_input_text


@dataclass(frozen=True)
class LodeWarning:
    code: str
    message: str
    details: Mapping[str, Any] = field(default_factory=dict)


# Codes of warnings.
WARNINGS = ("batch_length_below_max_workers", "missing_examples", "prompt_alignment_failed", "prompt_alignment_non_exact", "alias_lifecycle", "schema_constraints_ignored_with_explicit_model", "schema_fences_incompatible", "schema_wrapper_incompatible", "provider_environment")
# Other names of options.
SYNONYMS = {"batch_size": "batch_length", "context": "additional_context", "passes": "extraction_passes"}
# Model parameters that the google provider takes, in snake case.
GOOGLE_PARAMS = frozenset(
    "tools tool_config stop_sequences system_instruction candidate_count safety_settings response_schema response_mime_type max_output_tokens top_k top_p seed temperature presence_penalty frequency_penalty".split()
)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


@dataclass(frozen=True)
class ExtractOptions:
    """Normalised options; see ``of`` for how names are read. Examples are (text, [(class, extracted, attributes)])."""

    examples: Sequence[Any] = ()
    model: Any = None
    model_id: str | None = None
    provider: str | None = None
    registry: Registry | None = None
    config: Mapping[str, Any] = field(default_factory=dict)
    settings: Mapping[str, Any] = field(default_factory=dict)
    temperature: float | None = None
    prompt_description: str | None = None
    questions: Sequence[str] = ()
    schema: Sequence[tuple[str, str | None]] = ()
    prompt_template: str | None = None
    format_type: str = "json"
    max_char_buffer: int = 1000
    batch_length: int = 10
    max_workers: int = 10
    extraction_passes: int = 1
    context_window_chars: int | None = None
    additional_context: str | None = None
    fence_output: bool | None = None
    use_schema_constraints: bool = True
    resolver_params: Mapping[str, Any] = field(default_factory=dict)
    language_model_params: Mapping[str, Any] = field(default_factory=dict)
    api_key: str | None = None
    model_url: str | None = None
    fetch_urls: bool = True
    prompt_validation_level: str = "warn"
    prompt_validation_strict: bool = False
    prompt_lint_level: str = "off"
    debug: bool = False
    on_warning: Callable[[LodeWarning], None] | None = None

    @classmethod
    def of(cls, **given: Any) -> ExtractOptions:
        """Options by any of their names; where one is given twice camel case wins, then snake case, then the old name. None means the default."""
        ranked: dict[str, tuple[int, Any]] = {}
        for name, value in given.items():
            key = snake(name)
            rank = 0 if key != name or name not in SYNONYMS and "_" not in name else 1
            if key in SYNONYMS:
                key, rank = SYNONYMS[key], 2
            if key not in cls.__dataclass_fields__:
                raise TypeError(f"unknown option: {name}")
            if value is not None and (key not in ranked or rank < ranked[key][0]):
                ranked[key] = (rank, value)
        o = {k: v for k, (_, v) in ranked.items()}
        for k in ("max_char_buffer", "batch_length", "max_workers", "extraction_passes"):
            if k in o:
                o[k] = max(1, math.floor(o[k]))
        if "context_window_chars" in o:
            o["context_window_chars"] = max(0, math.floor(o["context_window_chars"]))
        kind = str(o.get("format_type", "")).strip().lower()
        o["format_type"] = kind if kind in ("yaml", "none") else "json"
        return cls(**o)

    def warn(self, code: str, message: str, **details: Any) -> None:
        if self.on_warning:
            self.on_warning(LodeWarning(code, message, details))

    @property
    def routes(self) -> Registry:
        return self.config.get("registry") or self.registry or default_registry()

    def preflight(self) -> None:
        if self.batch_length < self.max_workers:
            self.warn("batch_length_below_max_workers", f"batchLength ({self.batch_length}) < maxWorkers ({self.max_workers}). Only {self.batch_length} workers will be used.", batch_length=self.batch_length, max_workers=self.max_workers)
        if not self.examples:
            self.warn("missing_examples", "No examples provided. Extraction quality may be lower than expected.")

    def check_examples(self) -> None:
        if not self.examples:
            raise InferenceConfigError("Examples are required for reliable extraction. Please provide at least one example.")
        if self.prompt_validation_level == "off":
            return
        p = {snake(k): v for k, v in self.resolver_params.items()}
        threshold = p.get("fuzzy_alignment_threshold")
        if threshold is not None and (isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1):
            raise InferenceConfigError("fuzzy_alignment_threshold must be a finite number between 0 and 1.")
        fuzzy, lesser = p.get("enable_fuzzy_alignment"), p.get("accept_match_lesser")
        policy = AlignOptions(fuzzy if isinstance(fuzzy, bool) else True, 0.75 if threshold is None else threshold, lesser if isinstance(lesser, bool) else True)
        issues = example_issues([(t, [(c, x) for c, x, *_ in xs]) for t, xs in self.examples], policy)
        handle_example_issues(
            issues, self.prompt_validation_level, self.prompt_validation_strict,
            lambda message, i: self.warn(f"prompt_alignment_{i.kind}", message, example=i.example, label=i.label, status=i.status or "none"),
        )

    def resolve_model(self) -> Resolved:
        """The model given before the one of config, and config's id and provider before the others."""
        explicit, c = self.model, self.config
        if explicit is not None:
            return self.routes.resolve(self.provider, self.model_id, explicit)
        if c.get("model") is not None:
            return self.routes.resolve(c.get("provider"), c.get("model_id"), c["model"])
        return self.routes.resolve(c.get("provider") or self.provider, c.get("model_id") or self.model_id)

    def fences(self, resolved: Resolved) -> bool:
        if self.fence_output is not None:
            return self.fence_output
        hooks = self._hooks(resolved)
        return not hooks.raw_output if self.use_schema_constraints and self.examples and hooks else True

    def _hooks(self, resolved: Resolved) -> Any:
        p = self.routes.providers.get(resolved.models[0].provider)
        return p.hooks if p else None

    def model_settings(self, resolved: Resolved) -> dict[str, Any]:
        """Settings of calls: config's, then the given, then temperature; provider options: keys, then schema, then model parameters."""
        first = resolved.models[0]
        out = {**self.config.get("settings", {}), **self.settings}
        if self.temperature is not None:
            out["temperature"] = self.temperature
        key, url, warnings = self.routes.environment(f"{first.provider}:{first.model_id}", self.api_key, self.model_url)
        for w in warnings:
            self.warn("provider_environment", w)
        own = dict(out.get("provider_options", {}).get(first.provider, {}))
        own |= {k: v for k, v in (("apiKey", key), ("baseURL", url)) if v is not None}
        hooks = self._hooks(resolved)
        if self.use_schema_constraints and self.examples and hooks and hooks.build:
            built = hooks.build(self.examples, ATTRIBUTE_SUFFIX)
            if not isinstance(built, Mapping):
                raise InferenceConfigError(f'Schema hooks for "{first.provider}" must return a mapping.')
            own |= built
        params = model_params(self.language_model_params, first.provider)
        if isinstance(own.get("reasoning"), Mapping) and isinstance(params.get("reasoning"), Mapping):
            params = {**params, "reasoning": {**own["reasoning"], **params["reasoning"]}}
        own |= params
        if own:
            out["provider_options"] = {**out.get("provider_options", {}), first.provider: own}
        return out

    def resolver(self, fenced: bool) -> Resolver:
        base = "json" if self.format_type == "none" else self.format_type
        return Resolver.from_params(self.resolver_params, format_type=base, use_fences=fenced)[0]

    def check_schema(self, resolved: Resolved, handler: FormatHandler) -> None:
        hooks = self._hooks(resolved)
        if self.model is not None and self.use_schema_constraints:
            self.warn("schema_constraints_ignored_with_explicit_model", "'useSchemaConstraints' is ignored when 'model' is provided. Configure schema on the explicit model itself.")
        if not self.use_schema_constraints or self.model is not None or not self.examples or not (hooks and hooks.raw_output):
            return
        if handler.use_fences:
            self.warn("schema_fences_incompatible", "Schema-constrained raw JSON output is used, but fenced output is enabled. Set fenceOutput=false to avoid parse issues.")
        if not handler.use_wrapper or handler.wrapper_key != EXTRACTIONS_KEY:
            self.warn("schema_wrapper_incompatible", f'Schema-constrained output expects wrapper key "{EXTRACTIONS_KEY}".', use_wrapper=handler.use_wrapper, wrapper_key=handler.wrapper_key)


def _without_nulls(v: Mapping[str, Any]) -> dict[str, Any]:
    return {k: _without_nulls(x) if isinstance(x, Mapping) else x for k, x in v.items() if x is not None}


def model_params(given: Mapping[str, Any], provider: str) -> dict[str, Any]:
    """Parameters for a provider: nulls dropped, reasoning effort nested, response_format renamed, google's held to its list."""
    p = _without_nulls(given)
    effort = next((p[k] for k in ("reasoning_effort", "reasoningEffort") if k in p), None)
    if isinstance(effort, str) and effort.strip():
        p["reasoning"] = {**(p["reasoning"] if isinstance(p.get("reasoning"), dict) else {}), "effort": effort}
    if "response_format" in p:
        p.setdefault("responseFormat", p["response_format"])
    for k in ("reasoning_effort", "reasoningEffort", "response_format"):
        p.pop(k, None)
    return {k: v for k, v in p.items() if snake(k) in GOOGLE_PARAMS} if provider == "google" else p


def pipeline_of(o: ExtractOptions) -> tuple[Chain, PipelineOptions]:
    """The model chain and pipeline settings that options lead to, with all checks and warnings made."""
    o.preflight()
    o.check_examples()
    load_plugins_once(o.routes)
    resolved = o.resolve_model()
    for w in resolved.warnings:
        o.warn("alias_lifecycle", w)
    resolver = o.resolver(o.fences(resolved))
    o.check_schema(resolved, resolver.handler)
    chain = resolved.chain(o.model_settings(resolved), o.debug)
    return chain, PipelineOptions(
        max_char_buffer=o.max_char_buffer,
        passes=o.extraction_passes,
        context_window_chars=o.context_window_chars,
        context=o.additional_context,
        prompts=PromptOptions(o.prompt_description, o.questions, o.schema, o.prompt_template, o.format_type),
        lint_level=o.prompt_lint_level,
        resolver=resolver,
        workers=min(o.max_workers, o.batch_length),
        batch_length=o.batch_length,
    )


def extract(spark: SparkSession, text: str | None = None, documents: DataFrame | None = None, document_id: str = "text-1", **given: Any) -> DataFrame:
    """Extractions of one text, or of documents (document_id, text and optionally metadata)."""
    o = ExtractOptions.of(**given)
    chain, settings = pipeline_of(o)
    if documents is None:
        documents = spark.createDataFrame([(document_id, text)], "document_id string, text string")
    documents = resolve_input_text(check_unique(documents, "document_id"), "text", o.fetch_urls)
    return run_pipeline(documents, chain, settings)
