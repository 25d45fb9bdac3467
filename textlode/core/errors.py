"""Exceptions with stable codes."""

from __future__ import annotations


class LodeError(Exception):
    """Base of all errors of the package; ``code`` is stable."""

    code = "lode_error"


class InferenceError(LodeError):
    code = "inference_error"


class InferenceConfigError(InferenceError):
    code = "inference_config_error"


class InferenceRuntimeError(InferenceError):
    """A model call failed for good. Keeps the first cause and the provider."""

    code = "inference_runtime_error"

    def __init__(self, message: str, original: BaseException | None = None, provider: str | None = None):
        super().__init__(message)
        self.original, self.provider = original, provider


class InferenceOutputError(InferenceError):
    code = "inference_output_error"


class InvalidDocumentError(LodeError):
    code = "invalid_document_error"


class InternalError(LodeError):
    code = "internal_error"


class ProviderError(LodeError):
    code = "provider_error"


class SchemaError(LodeError):
    code = "schema_error"


class FormatError(LodeError):
    code = "format_error"


class FormatParseError(FormatError):
    """A model output that can't be read; ``original_input`` is that output."""

    code = "format_parse_error"

    def __init__(self, message: str, original_input: str = ""):
        super().__init__(message)
        self.original_input = original_input


class TokenizerError(LodeError):
    code = "base_tokenizer_error"


class InvalidTokenIntervalError(TokenizerError):
    code = "invalid_token_interval_error"


class SentenceRangeError(TokenizerError):
    code = "sentence_range_error"


class TokenUtilError(LodeError):
    code = "token_util_error"


class PromptTemplateError(LodeError):
    code = "prompt_template_error"


class PromptValidationError(LodeError):
    code = "prompt_validation_error"

    def __init__(self, message: str, report: object = None):
        super().__init__(message)
        self.report = report


class PromptAlignmentError(PromptValidationError):
    code = "prompt_alignment_error"


def error_code(e: BaseException) -> str:
    """The stable code of an exception, unknown_error for foreign ones."""
    return getattr(e, "code", "unknown_error") if isinstance(e, LodeError) else "unknown_error"
