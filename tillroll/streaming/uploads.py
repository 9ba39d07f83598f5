"""Uploads as a stream: every new CSV file in a folder is one dataset.

The studied service handled one uploaded file per request (load, validate, clean, KPIs,
store). Here a file stream feeds micro-batches; each batch may hold many files, and the
whole run is computed per ``dataset_id`` (the file) with the ``by`` keys of every
operator, so a batch of a thousand uploads is one set of Spark jobs, not a thousand.
The stream's checkpoint records which files were processed; history writes are keyed
by the batch id, so a batch replayed after a failure overwrites its own records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.plans import upload_run
from tillroll.schema import RAW_COLUMNS
from tillroll.sources.files import read_uploads


FILES_PER_TRIGGER = 1000  # the names of a batch's files go through the driver


def upload_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Paths of newly arrived CSV uploads (their content is not read here)."""
    files = "path string, modificationTime timestamp_ltz, length long, content binary"  # the schema of this format
    reader = spark.readStream.format("binaryFile").schema(files).option("pathGlobFilter", "*.csv")
    reader = reader.option("maxFilesPerTrigger", max_files_per_trigger or FILES_PER_TRIGGER)
    return reader.load(input_dir).select("path")


def process_batch(history_root: str, on_error: str = "reject"):
    """foreachBatch handler: the whole upload run for every file of the batch, read by header names and in its own
    encoding as by the batch loader; ``dataset_id`` is the file name. Files with validation errors go to the
    quarantine with their rows (``on_error="clean"``: are cleaned like others)."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if not paths:
            return
        raw = read_uploads(batch.sparkSession, paths)
        missing = [F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS if c not in raw.columns]
        run = upload_run.run(raw.select("*", *missing), by=["dataset_id"], on_error=on_error)
        try:
            upload_run.store(run, history_root, by=["dataset_id"], batch=epoch_id)
        finally:
            run.release()
    return handle


def start(spark: SparkSession, input_dir: str, history_root: str, checkpoint_location: str,
          available_now: bool = False, interval: str = "1 minute",
          max_files_per_trigger: int | None = None, on_error: str = "reject") -> StreamingQuery:
    """Start the upload stream. ``available_now`` processes what is there and stops."""
    w = (upload_stream(spark, input_dir, max_files_per_trigger).writeStream
         .foreachBatch(process_batch(history_root, on_error)).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
