"""Batch selection on rows, not on file listings.

Every landed row carries the name of the batch (file) it came from - from ``_metadata.file_name`` when
reading files, or a ``batch_id`` column. "Latest batch" and friends are then filters with scalar
subqueries, which the executors evaluate; nothing is listed or collected on the driver.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.sources.folders import data_files

# The batch stamp inside a file name (date_time) and its layout.
STAMP_PATTERN = r"(\d{8}_\d{6})"
STAMP_FORMAT = "yyyyMMdd_HHmmss"
_LOWEST = "0001-01-01 00:00:00"


def read_with_source(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, **options) -> DataFrame:
    """Read Parquet files (a path or a glob; ``mergeSchema="true"`` for files with differing columns) and keep, on
    every row, the file name, its modification time and the row's place in it, the order of first-wins rules."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).parquet(*([path] if isinstance(path, str) else path))
    return df.select("*", F.col("_metadata.file_name").alias("_file"),
                     F.col("_metadata.file_modification_time").alias("_modified"),
                     F.col("_metadata.row_index").alias("_row"))


def schema_groups(spark: SparkSession, files: list[str], **options) -> list[list[str]]:
    """Runs of files (in the given order) whose schemas merge. Spark reads the footers of a run in parallel on the executors;
    a run that does not merge is halved, so a few changes of type among many files cost a few reads each."""
    def merges(run: list[str]) -> bool:
        try:
            spark.read.options(**options).option("mergeSchema", "true").parquet(*run)
            return True
        except (PySparkException, Py4JJavaError) as e:  # a conflict surfaces as the one or the other
            if "CANNOT_MERGE" not in str(e):
                raise
            return False

    if not files:
        return []
    if len(files) == 1 or merges(files):
        return [files]
    half = len(files) // 2
    left, right = schema_groups(spark, files[:half], **options), schema_groups(spark, files[half:], **options)
    if merges([*left[-1], *right[0]]):  # the halves may cut a run
        return [*left[:-1], [*left[-1], *right[0]], *right[1:]]
    return [*left, *right]


def read_relaxed(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every file of a path or glob as one table, also where files disagree on a column's type: one scan for each run of
    files whose schemas merge, then the relaxed union (missing -> null, types widened). Rows keep file, time and place as in
    ``read_with_source``."""
    from offerlake.operators.tables import union_relaxed

    groups = schema_groups(spark, data_files(spark, path), **options)
    if not groups:
        raise FileNotFoundError(path)
    return union_relaxed([read_with_source(spark, group, mergeSchema="true", **options) for group in groups])


def batch_stamp(name: Column | str) -> Column:
    """Timestamp written in a batch name as ``yyyyMMdd_HHmmss``; null when there is none."""
    c = F.col(name) if isinstance(name, str) else name
    return F.try_to_timestamp(F.regexp_extract(c, STAMP_PATTERN, 1), F.lit(STAMP_FORMAT))


def _stamp_key(name: Column) -> Column:
    # Unstamped batches sort lowest; ties on the stamp are broken by the name.
    return F.struct(F.coalesce(batch_stamp(name), F.to_timestamp(F.lit(_LOWEST))).alias("s"), name.alias("n"))


def latest_batch(df: DataFrame, name_col: str = "_file", order: str = "stamp") -> DataFrame:
    """Rows of the newest batch. ``order="stamp"`` compares the stamp in the name (unstamped lowest,
    ties by name); ``order="name"`` compares the plain string (note: ``..._2026-01-..`` sorts below
    ``..._20260712_..`` in string order). An empty input gives an empty result."""
    name = F.col(name_col)
    if order == "name":
        return df.filter(name == df.select(F.max(name_col)).scalar())
    if order != "stamp":
        raise ValueError(f"unknown order {order!r}")
    newest = df.select(F.max(_stamp_key(name))).scalar()
    return df.filter(_stamp_key(name) == newest)


def recent_batches(df: DataFrame, as_of: str, days: int, name_col: str = "_file",
                   time_col: str | None = None) -> DataFrame:
    """Rows of batches from the last ``days`` days (by ``time_col``, e.g. ``_modified``, or by the stamp
    in the name); rows without a time are skipped; when no batch is recent, the newest batch."""
    t = F.col(time_col) if time_col else batch_stamp(F.col(name_col))
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    recent = t.isNotNull() & (t >= cutoff)
    n_recent = df.select(F.count_if(recent)).scalar()
    newest = df.select(F.max(_stamp_key(F.col(name_col)))).scalar()
    return df.filter(recent | ((n_recent == 0) & (_stamp_key(F.col(name_col)) == newest)))


def latest_day(df: DataFrame, name_col: str = "_file", time_col: str | None = None) -> DataFrame:
    """Rows of every batch of the most recent day (of the stamp, or of ``time_col``)."""
    t = F.col(time_col) if time_col else batch_stamp(F.col(name_col))
    day = F.to_date(t)
    return df.filter(day == df.select(F.max(day)).scalar())


def land_records(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """Land raw API records given as JSON text in typed columns; a column whose value is a literal ``{}`` is null
    (an object that holds keys stays, also if none of them is in the schema)."""
    rest = [c for c in df.columns if c != json_col]

    def column(f: T.StructField) -> Column:
        value = F.col(f"_rec.`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            raw = F.get_json_object(F.col(json_col), f"$['{f.name}']")
            value = F.when(raw.isNull() | (raw != F.lit("{}")), value)
        return value.alias(f.name)

    parsed = df.select(*rest, json_col, F.from_json(F.col(json_col), schema).alias("_rec"))
    return parsed.select(*rest, *[column(f) for f in schema.fields])


def write_batch(df: DataFrame, path: str, batch_id: str, ingestion_date: str) -> None:
    """Write a landed batch: the batch id is a column and the folder is partitioned by ingestion date."""
    (df.withColumn("batch_id", F.lit(batch_id))
       .withColumn("ingestion_date", F.to_date(F.lit(ingestion_date)))
       .write.mode("append").partitionBy("ingestion_date").parquet(path))


def backfill_coverage(rows: DataFrame, date_col: str, start: Column, end: Column) -> DataFrame:
    """Month chunks of [start, end], clipped at both ends, with the number of rows landed in each;
    chunks that got nothing are flagged. ``start``/``end`` are date expressions, typically scalar
    subqueries over the data."""
    span = rows.sparkSession.range(1).select(F.to_date(start).alias("s"), F.to_date(end).alias("e"))
    months = span.select(
        "s", "e",
        F.explode(F.sequence(F.trunc("s", "MM"), F.col("e"), F.expr("INTERVAL 1 MONTH"))).alias("month"),
    ).select(
        "month",
        F.greatest("month", "s").alias("chunk_start"),
        F.least(F.last_day("month"), F.col("e")).alias("chunk_end"),
    )
    d = F.to_date(F.col(date_col))
    counts = (rows.select(d.alias("_d"))
              .join(span, (F.col("_d") >= F.col("s")) & (F.col("_d") <= F.col("e")), "left_semi")
              .groupBy(F.trunc("_d", "MM").alias("month")).agg(F.count("*").alias("n_rows")))
    return (months.join(F.broadcast(counts), "month", "left")
            .select("chunk_start", "chunk_end",
                    F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                    F.col("n_rows").isNull().alias("empty")))


def batch_complete(silver: DataFrame, gold: DataFrame, date_col: str = "ingestion_date") -> DataFrame:
    """Per date: rows in silver, rows in gold, complete when both produced something."""
    tagged = (silver.select(F.col(date_col).alias("d"), F.lit(True).alias("is_silver"))
              .unionByName(gold.select(F.col(date_col).alias("d"), F.lit(False).alias("is_silver"))))
    return (tagged.groupBy(F.col("d").alias(date_col))
            .agg(F.count_if("is_silver").cast("long").alias("n_silver"),
                 F.count_if(~F.col("is_silver")).cast("long").alias("n_gold"))
            .withColumn("complete", (F.col("n_silver") > 0) & (F.col("n_gold") > 0)))
