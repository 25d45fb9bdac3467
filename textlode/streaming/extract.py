"""The pipeline over a stream of documents: the same plan for each micro-batch, records written once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textlode.operators.model import Chain
from textlode.plans.pipeline import PipelineOptions, extract


def stream_documents(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_stream(documents: DataFrame, out: str, checkpoint: str, chain: Chain | None = None, options: PipelineOptions | None = None, key: str = "document_id", text: str = "text", once: bool = True, arrival: str | None = None, remember: str = "7 days") -> StreamingQuery:
    """Extract from a stream of documents into parquet at ``out``, a folder for each batch, so that a repeated batch replaces itself.

    A document delivered again is taken once, in the batch that first brought it:
    ids are kept as the stream's state, for ``remember`` behind the newest arrival
    where documents carry the time of it in ``arrival`` (for good without one), so
    only later repeats than that are extracted again. Merging over passes needs
    only the document's own records.
    """
    if arrival:
        first = documents.withWatermark(arrival, remember).dropDuplicatesWithinWatermark([key])
    else:
        first = documents.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        extract(batch, chain, options, key, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
