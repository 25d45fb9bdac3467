"""Rows that fail to parse: every line and answer ends either typed or with the reasons of its failure.

Each line is loaded as nullable text fields, cast and constraint rules are
evaluated as column expressions into an array of errors, and the rows are split
by whether that array is empty. Only the JSON grammar of model answers leaves
the JVM (one Arrow UDF); no step shuffles, so hot files cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.core.jstext import not_blank
from textlode.operators.formats import FormatHandler, OutputParser

DEFAULT_DELIMITER = ","
#: Sources are a fixed table of file layouts; one of this many rows or more is joined by shuffle instead.
MAX_BROADCAST_SOURCES = 10_000
#: Different delimiters that get a pattern of their own; lines of others build theirs row by row.
MAX_DELIMITERS = 32

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _parted(line: Column, delimiter: Column, one: Column, d: Column | str) -> Column:
    """The raw fields of a line, null where one is neither free of quotes nor wholly enclosed in them.

    ``d``: the delimiter as an escaped character, one for all lines or each line's own.
    """

    def pattern(*parts: Column | str) -> Column:
        if isinstance(d, str):
            return F.lit("".join(d if p is d else str(p) for p in parts))
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    field = (rf"(?:{_QUOTED}|[^\"", d, "]*+)")
    sound = F.when(one, F.rlike(line, pattern(r"(?s)\A", *field, "(?:", d, *field, r")*+\z"))).otherwise(F.rlike(line, F.lit(rf'(?s)\A(?:{_QUOTED}|[^"]*+)\z')))
    # a leading delimiter makes every field follow one, so that empty first fields are found too
    parts = F.when(one, F.regexp_extract_all(F.concat(delimiter, line), pattern("(?s)", d, rf"({_QUOTED}|[^\"", d, "]*+)"), F.lit(1))).otherwise(F.array(line))
    plain = F.when(one, F.split(line, pattern("[", d, "]"), -1)).otherwise(F.array(line))
    return F.when(~F.contains(line, F.lit('"')), plain).when(sound, parts)


def delimited_fields(line: Column, delimiter: Column, known: Sequence[str] = ()) -> Column:
    """The raw fields of a line under a delimiter of its own row, null where the line isn't sound.

    A line is sound if each field either holds no quote or is wholly enclosed in
    quotes with inner ones doubled; only lines that hold a quote are matched for
    that. A delimiter of several characters never matches, so such a line is one
    field. ``known``: delimiters whose patterns are compiled once.
    """
    out = None
    for k in known:
        if len(k) == 1:
            fields = _parted(line, F.lit(k), F.lit(True), f"\\x{{{ord(k):x}}}")
            out = F.when(delimiter == k, fields) if out is None else out.when(delimiter == k, fields)
    own = F.concat(F.lit(r"\x{"), F.lower(F.hex(F.ascii(delimiter).cast("long"))), F.lit("}"))
    rest = _parted(line, delimiter, F.length(delimiter) == 1, own)
    return rest if out is None else out.otherwise(rest)


def unquote(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def is_moment(c: Column) -> Column:
    """A real moment written YYYY-MM-DDTHH:MM:SSZ."""
    shape = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z")
    return F.coalesce(shape & F.substring(c, 1, 10).try_cast("date").isNotNull(), F.lit(False))


@dataclass(frozen=True)
class FieldRule:
    """A column of a file: what its text must satisfy where the file has it, and how it's cast then."""

    name: str
    ok: Callable[[Column], Column] | None = None
    cast: Callable[[Column], Column] | None = None


def _to_moment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")


_DIGITS = r"\A[0-9]+\z"
#: The columns of extraction datasets.
EXTRACTION_FIELDS = (
    FieldRule("id", not_blank),
    FieldRule("text"),
    FieldRule("label"),
    FieldRule("start_pos", lambda c: c.rlike(_DIGITS), lambda c: c.try_cast("bigint")),
    FieldRule("end_pos", lambda c: c.rlike(_DIGITS), lambda c: c.try_cast("bigint")),
    FieldRule("confidence", lambda c: c.rlike(r"\A(?:0*0(?:\.[0-9]+)?|0*1(?:\.0+)?)?\z"), lambda c: c.try_cast("double")),
    FieldRule("recorded_at", is_moment, _to_moment),
)


def check_lines(lines: DataFrame, sources: DataFrame, fields: Sequence[FieldRule] = EXTRACTION_FIELDS) -> DataFrame:
    """``lines`` with typed columns and an ``errors`` array (empty: the row loads; null: a blank line, which is no record).

    lines: row_id, file_name, line; sources: file_name, delimiter, header_cols.
    One carriage return at a line's end is dropped. A null line counts as blank;
    a null delimiter as a comma; a file without a source fails with
    ``unknown_file``. Further columns of ``lines`` are kept as they are, a ``v_*``
    column is added for each of ``fields``, and ``v_other`` maps the file's other
    columns to their text. Repeated rows stay repeated.
    """
    layout = sources.select(
        F.col("file_name").alias("_file"), F.coalesce("delimiter", F.lit(DEFAULT_DELIMITER)).alias("_delim"), F.col("header_cols").alias("_cols"),
        F.array(*(F.array_position("header_cols", F.lit(x.name)) for x in fields)).alias("_at"),
    ).dropDuplicates(["_file"])
    known: list[str] = []
    if layout.limit(MAX_BROADCAST_SOURCES).count() < MAX_BROADCAST_SOURCES:
        layout = F.broadcast(layout)
        known = sorted(r[0] for r in sources.select(F.coalesce("delimiter", F.lit(DEFAULT_DELIMITER))).distinct().limit(MAX_DELIMITERS).collect())
    body = F.regexp_replace("line", r"\r\z", "")
    df = lines.withColumn("_line", F.when(not_blank(body), body)).join(layout, F.col("file_name") == F.col("_file"), "left")
    df = df.withColumn("_raw", delimited_fields(F.col("_line"), F.col("_delim"), known))
    df = df.withColumn("_fits", F.coalesce(F.size("_raw") == F.size("_cols"), F.lit(False)))
    values = {x.name: unquote(F.try_element_at("_raw", F.when(F.col("_fits") & (F.col("_at")[k] > 0), F.col("_at")[k].cast("int")))) for k, x in enumerate(fields)}
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    known_file = F.col("_file").isNotNull()
    faults = [
        F.when(~known_file, F.lit("unknown_file")),
        F.when(known_file & F.col("_raw").isNull(), F.lit("broken_quoting")),
        F.when(known_file & F.col("_raw").isNotNull() & ~F.col("_fits"), F.lit("column_count")),
    ]
    for k, x in enumerate(fields):
        if x.ok:
            good = F.coalesce(x.ok(F.col(f"_v_{x.name}")), F.lit(False))
            faults.append(F.when(F.col("_fits") & (F.col("_at")[k] > 0) & ~good, F.lit(f"bad_value:{x.name}")))
    df = df.withColumn("errors", F.when(F.col("_line").isNotNull(), F.array_compact(F.array(*faults))))
    loads = F.size("errors") == 0
    typed = {f"v_{x.name}": F.when(loads, x.cast(F.col(f"_v_{x.name}")) if x.cast else F.col(f"_v_{x.name}")) for x in fields}
    other = F.filter(F.arrays_zip(F.col("_cols").alias("k"), F.col("_raw").alias("v")), lambda e: ~e["k"].isin([x.name for x in fields]))
    # a name that a file has twice counts once, by its last column
    pairs = F.transform(other, lambda e: F.struct(e["k"].alias("k"), unquote(e["v"]).alias("v")))
    merged = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    typed["v_other"] = F.when(loads, merged)
    return df.withColumns(typed).drop("_line", "_file", "_delim", "_cols", "_raw", "_fits", "_at", *(f"_v_{x.name}" for x in fields))


def check_answers(answers: DataFrame, handler: FormatHandler | None = None, column: str = "model_output") -> DataFrame:
    """``answers`` with an ``errors`` array: empty where the format handler reads the answer, null for a null answer."""
    why = OutputParser(handler or FormatHandler()).error(column)
    return answers.withColumn("_why", why).withColumn(
        "errors", F.when(F.col(column).isNotNull(), F.array_compact(F.array("_why")))
    ).drop("_why")


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that load, failing rows with their errors); rows that are no records (null errors) are in neither."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
