"""Prompts as column expressions: constants of the driver around the text and context of a row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.errors import PromptAlignmentError, PromptTemplateError, PromptValidationError
from textlode.core.jstext import WS_CLASS, js_trim, strip
from textlode.operators.align import AlignOptions, align

# The wording of prompts.
TEMPLATE = """You are an information extraction assistant.
Task:
{{promptDescription}}

Context:
{{context}}

Extraction schema:
{{schema}}

Questions:
{{questions}}

Input text:
{{inputText}}

{{outputInstructions}}"""
NO_CONTEXT = "No additional context provided."
NO_DESCRIPTION = "Extract high-value structured information."
NO_QUESTIONS = "No explicit questions provided. Extract any high-value entities."
NO_SCHEMA = "No fixed schema provided. Infer useful labels from the text."
OUTPUT = {
    "json": 'Return JSON only in this shape:\n{"extractions":[{"text":"","label":"","confidence":0.0}]}',
    "yaml": 'Return YAML only in this shape:\nextractions:\n  - text: ""\n    label: ""\n    confidence: 0.0',
    "none": "Return concise extraction candidates without enforcing JSON or YAML formatting.",
}
ANSWER = {
    "json": 'Return JSON in this shape:\n{"answer":"","confidence":0.0,"evidence":""}',
    "yaml": "Return YAML in this shape:\nanswer: <short answer>\nconfidence: <0..1>\nevidence: <quoted phrase from context>",
    "none": "Return a concise plain-text answer.",
}
UNKNOWN = {"json": "If the answer is unknown, use an empty answer and confidence 0.", "none": "If the answer is unknown, return an empty answer."}
MAX_PROMPT = 12_000
_VARIABLE = re.compile(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}")


def render(template: str, values: Mapping[str, Column | str]) -> Column:
    """A template with its ``{{ names }}`` replaced, as one concatenation: replaced values aren't read again."""
    missing = sorted({m[1] for m in _VARIABLE.finditer(template)} - set(values))
    if missing:
        raise PromptTemplateError("Template is missing values for variables: " + ", ".join(f'"{k}"' for k in missing))
    parts: list[Column] = []
    at = 0
    for m in _VARIABLE.finditer(template):
        v = values[m[1]]
        parts += [F.lit(template[at : m.start()]), F.lit(v) if isinstance(v, str) else F.coalesce(v, F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass(frozen=True)
class PromptOptions:
    description: str | None = None
    questions: Sequence[str] = ()
    schema: Sequence[tuple[str, str | None]] = ()
    template: str | None = None
    output: str = "json"


def numbered(lines: Sequence[str]) -> str:
    return "\n".join(f"{k}. {x}" for k, x in enumerate(lines, 1))


def qa_prompt(question: str, context: Column, output: str = "json") -> Column:
    """A prompt that asks one question about a context."""
    unknown = UNKNOWN["none" if output == "none" else "json"]
    head = f"Answer the question using only the provided context.\n{unknown}\nQuestion:\n{strip(question)}\n\nContext:\n"
    body = context if output == "none" else js_trim(context)
    return F.concat(F.lit(head), body, F.lit(f"\n\n{ANSWER[output]}"))


def prompt(text: Column, context: Column | None = None, options: PromptOptions = PromptOptions()) -> Column:
    """The extraction prompt of a row; a single question that isn't blank asks that question instead."""
    o = options
    body = js_trim(text)
    ctx = F.coalesce(js_trim(context), F.lit(NO_CONTEXT)) if context is not None else F.lit(NO_CONTEXT)
    if len(o.questions) == 1 and strip(o.questions[0]):
        return qa_prompt(o.questions[0], F.concat(ctx, F.lit("\n\n"), body), o.output)
    schema = numbered([f"{label}: {strip(d)}" if d and strip(d) else label for label, d in o.schema])
    return render(
        TEMPLATE if o.template is None else o.template,
        {
            "promptDescription": strip(o.description) if o.description is not None else NO_DESCRIPTION,
            "context": ctx,
            "inputText": body,
            "questions": numbered([strip(q) for q in o.questions]) or NO_QUESTIONS,
            "schema": schema or NO_SCHEMA,
            "outputInstructions": OUTPUT[o.output],
        },
    )


# Codes and messages of prompt problems.
LINT = {
    "empty-prompt": "Prompt cannot be empty.",
    "too-long": "Prompt exceeds maxCharacters ({most}).",
    "unresolved-template-variable": "Prompt still contains unresolved template variables.",
    "missing-json-instruction": "Prompt should explicitly ask for JSON output.",
}


def lint(p: Column, most: int = MAX_PROMPT, need_json: bool = True) -> Column:
    """The codes of a prompt's problems as an array, empty for a sound one."""
    bare = js_trim(p)
    checks = [
        ("empty-prompt", F.length(bare) == 0),
        ("too-long", F.length(bare) > most),
        ("unresolved-template-variable", p.rlike(rf"\{{\{{[{WS_CLASS}]*[A-Za-z0-9_]+[{WS_CLASS}]*\}}\}}")),
    ]
    if need_json:
        checks.append(("missing-json-instruction", ~p.rlike("(?i)json")))
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in checks)))


def lint_message(code: str, most: int = MAX_PROMPT) -> str:
    return LINT[code].format(most=most)


def enforce_lint(df: DataFrame, column: str, level: str = "error", most: int = MAX_PROMPT, need_json: bool = True) -> DataFrame:
    """``df`` with the problems in ``prompt_issues``; at level error a row with any fails the query, at off none is looked for."""
    if level == "off":
        return df.withColumn("prompt_issues", F.array().cast("array<string>"))
    out = df.withColumn("prompt_issues", lint(F.col(column), most, need_json))
    if level == "error":
        fail = F.raise_error(F.concat(F.lit(f"[{PromptValidationError.code}] Prompt validation failed: "), F.concat_ws(", ", "prompt_issues")))
        out = out.withColumn("prompt_issues", F.when(F.size("prompt_issues") == 0, F.col("prompt_issues")).otherwise(F.array(fail.cast("string"))))
    return out


def preview(text: str, most: int = 120) -> str:
    flat = strip(re.sub(r"\s+", " ", text))
    return flat if len(flat) <= most else flat[: most - 1] + "…"


def debug_preview(c: Column, most: int = 160) -> Column:
    """Blanks collapsed, at most ``most`` characters with three dots in place of the rest."""
    flat = js_trim(F.regexp_replace(c, f"[{WS_CLASS}]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, F.lit(most - 3)), F.lit("...")))


def redact(c: Column) -> Column:
    """An error message without keys and bearer tokens, of 600 characters at most."""
    a = F.regexp_replace(c, r"(?i)(api[_-]?key\s*[:=]\s*)([^\s,;]+)", "$1[REDACTED]")
    return F.left(F.regexp_replace(a, r"(?i)(authorization\s*[:=]\s*bearer\s+)([^\s,;]+)", "$1[REDACTED]"), F.lit(600))


@dataclass(frozen=True)
class ExampleIssue:
    example: int
    label: str
    text: str
    status: str | None
    kind: str
    span: tuple[int, int] | None = None
    example_id: str | None = None

    def __str__(self) -> str:
        name = f" id={self.example_id}" if self.example_id is not None else ""
        span = f" char_span=({self.span[0]}, {self.span[1]})" if self.span else ""
        return f"[example#{self.example}{name}] class='{self.label}' status={self.status} text='{self.text}'{span}"


def example_issues(examples: Sequence[tuple[str, Sequence[tuple[str, str]]]], options: AlignOptions = AlignOptions()) -> list[ExampleIssue]:
    """Extractions of few-shot examples (text, [(class, extracted)]) that their own text doesn't hold exactly."""
    out = []
    for n, (text, extractions) in enumerate(examples):
        for label, x in extractions:
            hit = align(text, x, None, options)
            if hit.start < 0 or hit.end <= hit.start:
                out.append(ExampleIssue(n, label, preview(x), None, "failed"))
            elif hit.status != "exact":
                out.append(ExampleIssue(n, label, preview(x), hit.status, "non_exact", (hit.start, hit.end)))
    return out


def handle_example_issues(issues: Sequence[ExampleIssue], level: str = "warn", strict: bool = False, warn=None) -> None:
    """Warn of each issue; at level error fail on unaligned ones, under ``strict`` on inexact ones too."""
    if level == "off":
        return
    for i in issues:
        if warn:
            warn(f"Prompt alignment: {'failed to align' if i.kind == 'failed' else 'non-exact match'}: {i}", i)
    if level != "error":
        return
    failed = [i for i in issues if i.kind == "failed"]
    inexact = [i for i in issues if i.kind == "non_exact"]
    if failed:
        raise PromptAlignmentError(f"Prompt alignment validation failed: {len(failed)} extraction(s) could not be aligned (e.g., {failed[0]})", issues)
    if strict and inexact:
        raise PromptAlignmentError(f"Prompt alignment validation failed under strict mode: {len(inexact)} non-exact match(es) found (e.g., {inexact[0]})", issues)
