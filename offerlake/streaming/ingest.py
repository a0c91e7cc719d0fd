"""File-arrival ingestion with Structured Streaming.

A file source picks up new Parquet files; each micro-batch is merged insert-only into the target by
key inside ``foreachBatch``. The merge is idempotent per key, so a batch that is delivered again after
a failure (at-least-once) adds nothing, and no unbounded ``dropDuplicates`` state is kept. Run with
``availableNow`` from an outside trigger (file arrival or a nightly schedule).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.operators import tables as tb
from offerlake.sources.folders import path_exists


MERGED = "_merged_batches"  # hidden from readers of the table
FILTER_KEYS = 1_000_000


def merge_into_path(batch: DataFrame, target_path: str, key: str, order: str | Sequence[str] | None = None, batch_id: str | None = None) -> int:
    """Insert-only merge of ``batch`` into the Parquet table at ``target_path`` (created when missing); returns the number of
    rows inserted.

    Of the target only the keys that the batch may hold are shuffled: its key column is scanned within the batch's key
    range (row groups outside it are skipped) and, where the batch has at most ``FILTER_KEYS`` keys, filtered by them on
    the scan side. A batch recorded under its ``batch_id`` is not merged again; one that died before its record is, and the
    keys make that harmless."""
    spark = batch.sparkSession
    record = f"{target_path}/{MERGED}"
    if batch_id is not None and path_exists(spark, record):
        if not spark.read.schema("batch_id string").parquet(record).where(F.col("batch_id") == batch_id).isEmpty():
            return 0
    inserted = Observation("inserted")
    if path_exists(spark, target_path):
        target = spark.read.parquet(target_path)
        n, low, high = batch.agg(F.count(key), F.min(key), F.max(key)).first()
        if not n:
            return 0
        known = target.select(key).where(F.col(key).between(F.lit(low), F.lit(high)))
        keys = batch.select(key).where(F.col(key).isNotNull()).distinct()
        known = known.join(F.broadcast(keys) if n <= FILTER_KEYS else keys, key, "left_semi")
        new = tb.schema_align(tb.insert_only_rows(batch, known, key, order), target.schema)
    else:
        new = tb.insert_only_rows(batch, batch.limit(0), key, order)
    new.observe(inserted, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(target_path)
    if batch_id is not None:
        spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("append").parquet(record)
    return int(inserted.get["rows"])


def stream_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, target_path: str, key: str,
                  checkpoint: str, glob: str | None = None, order: str | Sequence[str] | None = None,
                  transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None) -> int:
    """Process every file present in ``source_dir`` now, then stop (``trigger(availableNow=True)``). Returns the number of rows
    inserted. Batches are recorded under the checkpoint's name and their number."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source_dir)
    if transform is not None:
        stream = transform(stream)

    def merge(batch: DataFrame, batch_id: int) -> None:
        counted.append(merge_into_path(batch, target_path, key, order, f"{checkpoint}#{batch_id}"))

    counted: list[int] = []
    query = (stream.writeStream.foreachBatch(merge)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(counted)
