"""Prediction as a file stream (re-aimed from a request handler).

New files of texts in a folder are scored and labelled with the batch
functions (scoring and picking are row-local, so no state and no watermark
unless repeated rows are to be dropped) and appended to a Parquet folder.  The checkpoint folder makes the stream
restartable: a restarted query continues with the files not yet committed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textstrata.plans.jobs import predict_table


def start_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                 label: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint: str,
                 path_glob: str | None = None, available_now: bool = True,
                 files_per_trigger: int | None = None, once_by: Sequence[str] = (), event_time: str | None = None,
                 delay: str = "1 day") -> StreamingQuery:
    """Start a file stream through a row-local ``label`` function; ``available_now``
    processes what is there and stops.  ``source_dir`` may hold the files in folders
    of its own or be one file.

    With ``once_by`` a row whose key came before is dropped, also after a restart
    and when a file is sent again under another name.  The keys are kept as state
    until the watermark, ``delay`` behind the latest ``event_time``, has passed
    their row's time, so the state is bounded by the rows of that span; a row
    sent again later than that counts as new, and rows older than the watermark
    are dropped.
    """
    if bool(once_by) != bool(event_time):
        raise ValueError("once_by and event_time go together")
    reader = spark.readStream.schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(source_dir)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        source_dir = f"{source_dir[:-1]}[{source_dir[-1]}]"  # a stream's base must be a folder; a pattern has none
    rows = reader.parquet(source_dir)
    if once_by:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(once_by))
    writer = (label(rows).writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_stream_predict(spark: SparkSession, source_dir: str, schema: StructType | str, models: Mapping,
                         targets: Sequence[str], label_ids: Mapping[str, int], out_dir: str,
                         checkpoint: str, cutoff: float = 0.1, path_glob: str | None = None,
                         available_now: bool = True, files_per_trigger: int | None = None,
                         keep: Sequence[str] | None = None) -> StreamingQuery:
    """``start_stream`` with fitted models: score every target, then pick."""
    def label(texts: DataFrame) -> DataFrame:
        rows = texts if keep is None else texts.select(*keep)
        return predict_table(rows, models, targets, label_ids, cutoff)

    return start_stream(spark, source_dir, schema, label, out_dir, checkpoint, path_glob, available_now,
                        files_per_trigger)
