"""Text rules shared by every operator.

White space is the wider Unicode set that extraction prompts and datasets are
written against (it holds the no-break, figure and ideographic blanks and the
byte order mark), so neither Java's ``\\s`` nor Spark's ``trim`` can be used.
Offsets are code points throughout.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of ECMAScript's \s.
WS_CHARS = "\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: The same set as the inside of a character class, valid in Java, Python and RE2.
WS_CLASS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
PY_WS = "[" + re.escape(WS_CHARS) + "]"

_NUMBER = re.compile(r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\Z")
_RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\Z")


def strip(s: str) -> str:
    """``s`` without white space at its ends."""
    return s.strip(WS_CHARS)


def js_trim(c: Column | str) -> Column:
    """Column form of :func:`strip`; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^[{WS_CLASS}]++|[{WS_CLASS}]++\z", "")


def not_blank(c: Column | str) -> Column:
    """True where the text holds a character that isn't white space; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(rf"[^{WS_CLASS}]")


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(not_blank(c), c)


def to_number(v: object) -> float | int | None:
    """A finite number given as a number or as text (decimal, exponent, 0x/0o/0b), else None."""
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        try:
            return v if math.isfinite(v) else None
        except OverflowError:
            return None
    if isinstance(v, str):
        s = strip(v)
        if _RADIX.match(s):
            return int(s, 0)
        if s and _NUMBER.match(s):
            x = float(s)
            return x if math.isfinite(x) else None
    return None


def to_integer(v: object) -> int | None:
    """As :func:`to_number` where the value is whole."""
    x = to_number(v)
    return int(x) if x is not None and x == math.floor(x) else None


def number_text(x: float | int) -> str:
    """The shortest decimal text of a number: 5.0 gives 5, 1e21 gives 1e+21."""
    if isinstance(x, int):
        if abs(x) < 10**21:
            return str(x) if abs(x) <= 2**53 else number_text(float(x))
        x = float(x)
    if x != x:
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exp = ("-" if x < 0 else ""), *_digits(abs(x))
    n = len(digits)
    if n <= exp <= 21:
        body = digits + "0" * (exp - n)
    elif 0 < exp <= 21:
        body = digits[:exp] + "." + digits[exp:]
    elif -6 < exp <= 0:
        body = "0." + "0" * -exp + digits
    else:
        e = exp - 1
        body = digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))
    return sign + body


def _digits(x: float) -> tuple[str, int]:
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    e = int(exp or 0) + len(whole)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    digits = digits.lstrip("0").rstrip("0") or "0"
    return digits, e - lead


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units, for callers whose offsets count those."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_to_codepoint(text: str, offset: int) -> int:
    """A UTF-16 offset as a code point offset."""
    return len(text.encode("utf-16-le", "surrogatepass")[: 2 * offset].decode("utf-16-le", "ignore"))
