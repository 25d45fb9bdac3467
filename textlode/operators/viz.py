"""Highlighted HTML of annotated documents, and the texts of progress displays."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textlode.core.session import materialize
from textlode.operators.tokens import numbered

# Colours of labels, and the page's style.
PALETTE = ("#D2E3FC", "#C8E6C9", "#FEF0C3", "#F9DEDC", "#FFDDBE", "#EADDFF", "#C4E9E4", "#FCE4EC", "#E8EAED", "#DDE8E8")
STYLE = """<style>
.lx-highlight { position: relative; border-radius: 3px; padding: 1px 2px; }
.lx-current-highlight { border-bottom: 4px solid #ff4444; font-weight: bold; }
.lx-animated-wrapper { max-width: 100%; font-family: Arial, sans-serif; }
.lx-text-window { font-family: monospace; white-space: pre-wrap; border: 1px solid #90caf9; padding: 12px; line-height: 1.6; }
.lx-legend { font-size: 12px; margin-bottom: 8px; padding-bottom: 8px; border-bottom: 1px solid #e0e0e0; }
.lx-label { display: inline-block; padding: 2px 4px; border-radius: 3px; margin-right: 4px; color: #000; }
.lx-gif-optimized .lx-text-window { font-size: 16px; line-height: 1.8; }
</style>"""
UNLABELLED = "unknown"


def escape(s: str) -> str:
    return html.escape(s, quote=True).replace("&#x27;", "&#39;")


def escape_html(c: Column | str) -> Column:
    """The five characters of markup as entities, in the JVM."""
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_colors(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, color): distinct labels in dictionary order, the palette in turn; null counts as unknown."""
    labels = df.select(F.coalesce(label, F.lit(UNLABELLED)).alias("label")).distinct()
    ranked = numbered(labels, [F.collate("label", "UNICODE"), "label"], "_rank")
    return ranked.select("label", F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("_rank") % len(PALETTE) + 1).cast("int")).alias("color"))


@dataclass(frozen=True)
class Highlight:
    start: int
    end: int
    label: str | None = None
    css: str | None = None


@dataclass(frozen=True)
class PageOptions:
    container: bool = True
    legend: bool = True
    large: bool = True


def clamp_highlights(size: int, highlights: Sequence[Highlight]) -> list[Highlight]:
    """Highlights within the text, empty ones dropped, by start and the longest first."""
    cut = [Highlight(min(max(int(h.start // 1), 0), size), min(max(int(h.end // 1), 0), size), h.label, h.css) for h in highlights]
    return sorted((h for h in cut if h.end > h.start), key=lambda h: (h.start, h.start - h.end))


def _alphabetic(label: str) -> tuple[str, str]:
    return label.casefold(), label.swapcase()


def page(text: str, highlights: Sequence[Highlight], options: PageOptions = PageOptions()) -> str:
    """The highlighted page of one text."""
    marks = clamp_highlights(len(text), highlights)
    style = STYLE if options.container else ""
    if not marks:
        return f'{style}<div class="lx-animated-wrapper"><p>No valid extractions to animate.</p></div>'
    colors = {x: PALETTE[k % len(PALETTE)] for k, x in enumerate(sorted({UNLABELLED if h.label is None else h.label for h in marks}, key=_alphabetic))}
    # ends before starts at one place; inner ends first, outer starts first
    events = [(h.end, 0, h.end - h.start, k) for k, h in enumerate(marks)] + [(h.start, 1, h.start - h.end, k) for k, h in enumerate(marks)]
    out, at = [], 0
    for place, opens, _, k in sorted(events):
        out.append(escape(text[at:place]))
        at = place
        if opens:
            h = marks[k]
            css = "lx-highlight" + " lx-current-highlight" * (k == 0) + (f" {escape(h.css)}" if h.css else "")
            out.append(f'<span class="{css}" data-idx="{k}" style="background-color:{colors[UNLABELLED if h.label is None else h.label]};">')
        else:
            out.append("</span>")
    out.append(escape(text[at:]))
    legend = ""
    if options.legend:
        legend = '<div class="lx-legend">Highlights Legend: ' + " ".join(f'<span class="lx-label" style="background-color:{c};">{escape(x)}</span>' for x, c in colors.items()) + "</div>"
    wrapper = "lx-animated-wrapper" + " lx-gif-optimized" * options.large
    return f'{style}<div class="{wrapper}">{legend}<div class="lx-text-window">{"".join(out)}</div></div>'


def pages(documents: DataFrame, key: str = "document_id", text: str = "text", extractions: str = "extractions", options: PageOptions = PageOptions()) -> DataFrame:
    """(key, html) of documents with an array of extractions (start_pos, end_pos, label)."""
    spans = F.transform(extractions, lambda x: F.struct(x["start_pos"], x["end_pos"], x["label"]))
    source = documents.filter(F.col(text).isNotNull()).select(key, text, spans.alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page(t, [Highlight(*s.values()) for s in spans or () if s and None not in list(s.values())[:2]], options) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "html"])

    return source.mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, html string")


def visualize(documents: DataFrame | str, document_id: str | None = None, options: PageOptions = PageOptions(), spark: SparkSession | None = None) -> str:
    """The page of one document: the one with the id, else the one with the smallest.

    ``documents`` have an array of extractions, or are the path of a file of
    annotated documents.
    """
    if isinstance(documents, str):
        from textlode.sources.jsonl import annotated_documents

        documents = annotated_documents(spark or SparkSession.active(), documents)
    chosen = documents.filter(F.col("document_id") == document_id) if document_id is not None else documents.orderBy("document_id")
    rows = pages(chosen.limit(1), options=options).collect()
    if not rows:
        raise ValueError("No annotated documents found to visualize." if document_id is None else f"Document ID not found in visualize input: {document_id}")
    return rows[0]["html"]


# Progress


NAME = "textlode"


@dataclass(frozen=True)
class Progress:
    """What a progress display shows: bytes are scaled, documents counted."""

    description: str
    total: int | None = None
    unit: str | None = None
    scaled: bool = False
    disabled: bool = False


def download_progress(size: float, url: str, most: int = 50) -> Progress:
    return Progress(f"{NAME}: Downloading {short_url(url, most)}", max(0, int(size // 1)), "B", True)


def extraction_progress(model: str | None = None, disabled: bool = False) -> Progress:
    return Progress(progress_line(model), disabled=disabled)


def save_progress(path: str, disabled: bool = False) -> Progress:
    return Progress(f"{NAME}: Saving to {base_name(path)}", unit="docs", disabled=disabled)


def load_progress(path: str, size: int | None = None, disabled: bool = False) -> Progress:
    return Progress(f"{NAME}: Loading {base_name(path)}", size, "docs" if size is None else "B", size is not None, disabled)


def model_name(model: object) -> str | None:
    """A model's id, else its URL, from a mapping or an object."""
    get = model.get if isinstance(model, dict) else lambda k: getattr(model, k, None)
    return next((v for k in ("model_id", "modelId", "model_url", "modelUrl") if isinstance(v := get(k), str) and v), None)


def short_url(url: str, most: int = 50) -> str:
    """A URL within a length: whole, else host and file, else cut with dots."""
    if len(url) <= most:
        return url
    parts = urlsplit(url)
    if parts.hostname:
        names = [x for x in parts.path.split("/") if x]
        short = f"{parts.hostname}/.../{names[-1] if names else 'file'}"
        if len(short) <= most:
            return short
    return url[: max(0, most - 3)] + "..."


def base_name(path: str) -> str:
    names = [x for x in re.split(r"[\\/]", path) if x]
    return names[-1] if names else path


def grouped(x: float) -> str:
    return f"{math.floor(x + 0.5):,}" if math.isfinite(x) else "0"


def extraction_stats(current: float, processed: float) -> str:
    return f"current={grouped(current)} chars, processed={grouped(processed)} chars"


def progress_line(model: str | None = None, current: float | None = None, processed: float | None = None) -> str:
    head = f"{NAME}: model={model}" if model else f"{NAME}: Processing"
    return head if current is None or processed is None else f"{head}, {extraction_stats(current, processed)}"


def running_progress(chunks: DataFrame, order: Sequence[str], text: str) -> DataFrame:
    """``chunks`` with completed and total chunks and characters in the order of processing, per partition of the order and offset by what lies before."""


    ranged = materialize(chunks.withColumn("_len", F.coalesce(F.length(text), F.lit(0)).cast("bigint")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_len").alias("_c"))
    prior = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.select(
        "_part", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_c0"),
        F.sum("_n").over(every).alias("total_chunks"), F.sum("_c").over(every).alias("total_chars"),
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumns({"_i": F.row_number().over(inside), "_s": F.sum("_len").over(inside)}).join(F.broadcast(sums), "_part")
    return out.withColumns({"completed_chunks": F.col("_n0") + F.col("_i"), "processed_chars": F.col("_c0") + F.col("_s")}).drop("_part", "_len", "_n0", "_c0", "_i", "_s")
