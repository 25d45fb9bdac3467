"""JSON Lines and CSV datasets, annotated documents, URLs."""

from __future__ import annotations

import ipaddress
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import urlopen

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.core.jstext import PY_WS, WS_CLASS, js_trim, not_blank, strip
from textlode.operators.merge import normalize_status

# The schema of a line of an annotated file; attributes are open, so they stay JSON.
EXTRACTION = "struct<text:string,label:string,start:int,end:int,confidence:double,alignment_status:string,alignment_score:double,pass:int,attributes:string>"
ANNOTATED = f"document_id string, text string, extractions array<{EXTRACTION}>"
# Keys of a raw record that aren't attributes.
RESERVED = ("text", "label", "start", "end", "confidence")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON Lines file, blank lines aside; a line that isn't JSON fails the query."""
    lines = spark.read.text(path).filter(not_blank("value"))
    return lines.select(F.from_json(js_trim("value"), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line; nulls are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append" if append else "overwrite").text(path)


def dataset_format(path: str, explicit: str | None = None) -> str:
    """csv for a .csv path, else jsonl, unless told."""
    return explicit or ("csv" if os.path.splitext(path)[1].lower() == ".csv" else "jsonl")


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, id_key: str = "id", text_key: str = "text", delimiter: str = ",") -> DataFrame:
    """(id, text) of a dataset file of either format."""
    if dataset_format(path, fmt) == "csv":
        return load_csv(spark, path, id_key, text_key, delimiter)
    value = F.try_parse_json(js_trim("value"))
    lines = spark.read.text(path).filter(not_blank("value")).withColumn("_v", value)
    checked = lines.withColumn("_v", F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.left("value", F.lit(80)))).cast("variant")).otherwise(F.col("_v")))

    def string(k: str) -> Column:
        path = "$['" + k.replace("'", "\\'") + "']"
        return F.when(F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "STRING", F.try_variant_get("_v", path, "string"))

    return checked.select(string(id_key).alias("id"), string(text_key).alias("text")).filter("id is not null and text is not null")


def csv_fields(line: str, delimiter: str) -> list[str]:
    """Fields of a line whose quotes may open and close anywhere, doubled ones inside quotes standing for one."""
    out, part, quoted, k = [], [], False, 0
    special = re.compile('"' if len(delimiter) != 1 else f'["{re.escape(delimiter)}]')
    while True:
        m = special.search(line, k)
        if not m:
            part.append(line[k:])
            return [*out, "".join(part)]
        part.append(line[k : m.start()])
        k = m.end()
        if m[0] == '"':
            if quoted and line.startswith('"', k):
                part.append('"')
                k += 1
            else:
                quoted = not quoted
        elif quoted:
            part.append(m[0])
        else:
            out.append("".join(part))
            part = []


def dataset_rows(lines: DataFrame, header: Column, delimiter: Column, id_key: Column, text_key: Column, keep: list[str]) -> DataFrame:
    """(keep..., id, text) of delimited lines under their header's column order.

    White space at a line's end is dropped, blank lines are skipped, and rows
    that lack either column too; values stay strings.
    """
    kinds = dict(lines.dtypes)
    source = lines.select(*keep, F.col("line").alias("_line"), delimiter.alias("_d"), F.array_position(header, id_key).cast("int").alias("_i"), F.array_position(header, text_key).cast("int").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, ids, texts = [], [], []
            for k, (line, d, i, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(keep) :]), strict=True)):
                line = re.sub(f"{PY_WS}+\\Z", "", line or "")
                if not line or not i or not t:
                    continue
                fields = csv_fields(line, d if d is not None else ",")
                if max(i, t) <= len(fields):
                    take.append(k)
                    ids.append(fields[i - 1])
                    texts.append(fields[t - 1])
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keep))), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[*keep, "id", "text"])

    return source.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["id string", "text string"]))


def load_csv(spark: SparkSession, path: str, id_key: str, text_key: str, delimiter: str = ",") -> DataFrame:
    """(id, text) of CSV files, each with its own header; no file with lines and a missing column are errors."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.filter(not_blank("line")).withColumn("_at", F.monotonically_increasing_id())
    heads = lines.filter("_block = 0").groupBy(F.col("_file").alias("_f")).agg(F.min(F.struct("_at", "line")).alias("h"))

    @F.pandas_udf("array<string>")
    def fields(s: pd.Series) -> pd.Series:
        return s.map(lambda t: csv_fields(re.sub(f"{PY_WS}+\\Z", "", t), delimiter))

    heads = heads.select("_f", F.col("h._at").alias("_first"), fields("h.line").alias("_header"))
    lacking = heads.filter(~(F.array_contains("_header", id_key) & F.array_contains("_header", text_key))).limit(1).collect()
    if lacking:
        raise ValueError(f"CSV missing required columns. idKey={id_key}, textKey={text_key}")
    if heads.isEmpty():
        raise ValueError(f"Empty dataset: {path}")
    rows = lines.join(heads, F.col("_file") == F.col("_f")).filter(F.col("_at") != F.col("_first"))
    return dataset_rows(rows, F.col("_header"), F.lit(delimiter), F.lit(id_key), F.lit(text_key), [])


def attributes_json(raw: Column) -> Column:
    """The entries of a raw JSON record beside the reserved ones, as JSON with sorted keys; null where it isn't an object."""

    @F.pandas_udf("string")
    def pick(s):  # type: ignore[no-untyped-def]
        def one(t: str | None) -> str | None:
            try:
                v = json.loads(t) if t is not None else None
            except ValueError:
                return None
            return json.dumps({k: v[k] for k in sorted(v) if k not in RESERVED}, ensure_ascii=False) if isinstance(v, dict) else None

        return s.map(one, na_action=None).astype(object).where(lambda x: x.notna(), None)

    return pick(raw)


def annotated_records(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """(document_id, text, extractions) in the form of annotated files; documents of an empty or null id are left out."""
    x = extractions.withColumn("_attributes", attributes_json(F.col("raw")))
    item = F.struct(
        F.col("text"), F.col("label"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.col("confidence"), F.col("alignment_status"),
        F.col("alignment_score"), F.col("pass"), F.col("_attributes").alias("attributes"),
    )
    order = F.struct("start_pos", "end_pos", "label", "text", "pass", item.alias("x"))
    grouped = x.groupBy(F.col("document_id").alias("_d")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["x"]).alias("extractions"))
    docs = documents.select("document_id", "text").filter(F.length("document_id") > 0)
    joined = docs.join(grouped, F.col("document_id") == F.col("_d"), "left")
    return joined.select("document_id", "text", F.coalesce("extractions", F.array().cast(f"array<{EXTRACTION}>")).alias("extractions"))


def save_annotated(records: DataFrame, path: str, append: bool = False) -> None:
    """Write annotated documents; that there are none is an error."""
    if records.isEmpty():
        raise ValueError("No annotated documents to save.")
    write_jsonl(records, path, append)


def annotated_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text, extractions) of a file of annotated documents, spans named start_pos and end_pos."""
    spans = F.transform("extractions", lambda x: F.struct(x["start"].alias("start_pos"), x["end"].alias("end_pos"), x["label"].alias("label"), x["text"].alias("text")))
    return read_jsonl(spark, path, ANNOTATED).select("document_id", "text", spans.alias("extractions"))


def load_annotated(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text, extraction fields) with status names normalised, score and pass 0 where missing; one row per extraction, outer for documents without any."""
    docs = read_jsonl(spark, path, ANNOTATED)
    rows = docs.select("document_id", F.col("text").alias("document_text"), F.inline_outer("extractions"))
    return rows.withColumns(
        {
            "alignment_status": F.when(F.col("text").isNotNull(), normalize_status("alignment_status")),
            "alignment_score": F.when(F.col("text").isNotNull(), F.coalesce("alignment_score", F.lit(0.0))),
            "pass": F.when(F.col("text").isNotNull(), F.coalesce("pass", F.lit(0))),
        }
    )


# URLs

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|0[0-9]{2})"


def is_url(c: Column | str) -> Column:
    """Whether a text, outer blanks aside, is an http or https address with localhost, an IP address or a dotted name as host; null counts as not."""
    t = js_trim(c)
    host = F.lower(F.regexp_extract(t, r"(?i)\Ahttps?://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)(?::[0-9]*)?(?:[/?#].*)?\z", 1))
    numeric = host.rlike(r"\A[0-9.]+\z")
    good = F.when(host == "localhost", True).when(host.startswith("["), host.rlike(r"\A\[[0-9a-f:]*:[0-9a-f:.]*\]\z"))
    good = good.when(numeric, host.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")).otherwise(F.contains(host, F.lit(".")) & ~host.rlike(r"[\s<>^|%\\\"`{}]"))
    return F.coalesce(~t.rlike(f"[{WS_CLASS}]") & (F.length(host) > 0) & good, F.lit(False))


def is_url_text(text: str) -> bool:
    """As is_url for one text of the driver."""
    t = strip(text)
    if not t or re.search(PY_WS, t):
        return False
    try:
        u = urlsplit(t)
        host = u.hostname or ""
        _ = u.port
    except ValueError:
        return False
    if u.scheme.lower() not in ("http", "https") or not host:
        return False
    if host == "localhost":
        return True
    try:
        ipaddress.ip_address(host)
        return True
    except ValueError:
        return "." in host and not re.fullmatch(r"[0-9.]+", host)


@dataclass(frozen=True)
class Fetched:
    """What an address gave."""

    url: str
    status: int
    content_type: str | None
    text: str


def fetch_text(url: str, timeout: float = 30.0) -> Fetched:
    """The text behind an address; an answer other than 2xx is an error."""
    with urlopen(url, timeout=timeout) as r:  # noqa: S310 - the scheme was checked
        if not 200 <= r.status < 300:
            raise OSError(f"Failed to fetch URL {url}. HTTP {r.status}")
        text = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        return Fetched(url, r.status, r.headers.get("content-type"), text)


def fetch(url: str) -> str:
    return fetch_text(url).text


def resolve_input_text(df: DataFrame, text: str = "text", fetch_urls: bool = True, fetcher: Callable[[str], str] = fetch) -> DataFrame:
    """``df`` with texts that are URLs replaced by what they point to. The table is read once; only addresses leave the JVM."""
    if not fetch_urls:
        return df

    @F.pandas_udf("string")
    def body(urls: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else fetcher(strip(u)) for u in urls], dtype=object)

    c = F.col(f"`{text}`")
    there = F.coalesce(is_url(text), F.lit(False))
    return df.withColumn(text, F.when(there, body(F.when(there, c))).otherwise(c))
