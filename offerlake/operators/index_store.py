"""A stored posting index with a life cycle: create, append, delete, search.

Below ``path`` lie
* ``postings``, partitioned by the bucket count and a hash bucket of the lexeme, sorted by lexeme inside a file. Rows are dealt
  to tasks by ranges of (bucket, lexeme, key) cut from sampled frequencies, so the postings of a common lexeme fill several
  tasks and files and no task holds a bucket as a whole;
* ``offers``, the table of indexed offers: the key, and the buckets its postings lie in;
* ``options``, how texts were read (stems, symbols, stop words, bucket count), so that an append reads them alike.

A delete looks the offers up in ``offers``, reads the buckets named there and writes these, and no others, anew (dynamic
partition overwrite). Postings that stay are written by the task that read them, sorted again and not dealt anew, unless more
offers go than can be broadcast. It removes postings first and the offers' rows last, so one that was broken off is repeated whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators.search import SearchConfig, build_index, lexeme_bucket
from offerlake.session import scratch_path
from offerlake.sources.folders import drop_folder, path_exists

ROWS_PER_TASK = 1_000_000
OFFER_PARTS = 64
BROADCAST_KEYS = 2_000_000  # keys of offers shipped to every task
OPTIONS = "key string, buckets int, stem boolean, keep_symbols boolean, stopwords array<string>"


def by_lexeme_range(postings: DataFrame, buckets: int, key: str = "job_id", rows_per_task: int = ROWS_PER_TASK, rows: int | None = None) -> DataFrame:
    """``postings`` with ``n_buckets`` and ``bucket``, dealt to tasks of about equal size whatever the lexemes' frequencies."""
    rows = postings.count() if rows is None else rows
    tasks = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
    placed = postings.withColumn("bucket", lexeme_bucket(F.col("lexeme"), buckets)).withColumn("n_buckets", F.lit(buckets))
    return placed.repartitionByRange(tasks, "bucket", "lexeme", key).sortWithinPartitions("bucket", "lexeme", key)


def _write(df: DataFrame, path: str, parts: Sequence[str], mode: str) -> None:
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` of other offers than ``keys``, whose number is counted before they are broadcast."""
    keys = keys.select(key)
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_anti").select(*rows.columns)


def _buckets_of(made: DataFrame, key: str, buckets: int) -> DataFrame:
    """``(key, buckets)``: the buckets that the postings of each offer lie in, collected as bits of longs."""
    bucket, words = lexeme_bucket(F.col("lexeme"), buckets), range(0, buckets, 63)
    marked = made.select(key, bucket.alias("b")).groupBy(key).agg(*[
        F.bit_or(F.when(F.col("b").between(w, w + 62), F.expr(f"shiftleft(1L, b - {w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words])

    def named(w: int):
        bits = F.sequence(F.lit(0), F.lit(min(62, buckets - 1 - w)))
        return F.transform(F.filter(bits, lambda i: F.getbit(F.col(f"w{w}"), i) == 1), lambda i: i + F.lit(w))

    return marked.select(key, F.concat(*[named(w) for w in words]).alias("buckets"))


def create(spark: SparkSession, path: str, key: str = "job_id", buckets: int = SearchConfig.index_buckets, stem: bool = False,
           keep_symbols: bool = False, stopwords: Sequence[str] = ()) -> None:
    """An index without offers; the options hold for every append to it."""
    spark.createDataFrame([(key, buckets, stem, keep_symbols, list(stopwords))], OPTIONS).coalesce(1).write.parquet(f"{path}/options")


def options(spark: SparkSession, path: str):
    return spark.read.schema(OPTIONS).parquet(f"{path}/options").first()


def offers_in(spark: SparkSession, path: str) -> DataFrame | None:
    """``(key, buckets, part)`` of the indexed offers; None before the first append."""
    return spark.read.parquet(f"{path}/offers") if path_exists(spark, f"{path}/offers") else None


def postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings, as ``text_scores`` and ``rrf_search`` take an index."""
    return spark.read.parquet(f"{path}/postings")


def append(offers: DataFrame, path: str, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Index the offers that are not indexed yet. Known offers are looked up in the table of offers, not in the postings."""
    spark = offers.sparkSession
    o = options(spark, path)
    known = offers_in(spark, path)
    new = offers.filter(F.col(o.key).isNotNull())
    if known is not None:
        new = _without(new, known, o.key)
    # made once: the ranges are sampled from it, and the table of offers is made of it
    stage = scratch_path(spark, "new-postings")
    build_index(new, o.key, stem=o.stem, keep_symbols=o.keep_symbols, stopwords=o.stopwords).write.parquet(stage)
    made = spark.read.parquet(stage)
    _write(by_lexeme_range(made, o.buckets, o.key, rows_per_task), f"{path}/postings", ["n_buckets", "bucket"], "append")
    held = _buckets_of(made, o.key, o.buckets)
    # an offer without a word is indexed as well
    held = new.select(o.key).distinct().join(held, o.key, "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<int>")))
    held = held.withColumn("part", F.pmod(F.xxhash64(o.key), F.lit(OFFER_PARTS)).cast("int")).repartition("part")
    _write(held, f"{path}/offers", ["part"], "append")


def delete(spark: SparkSession, path: str, keys: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Take the offers named by ``keys`` out of the index."""
    o = options(spark, path)
    known = offers_in(spark, path)
    if known is None:
        return
    stage = scratch_path(spark, "dead-offers")
    known.join(keys.select(o.key).distinct(), o.key, "left_semi").write.parquet(stage)
    dead = spark.read.schema(known.schema).parquet(stage)
    buckets = sorted(r[0] for r in dead.select(F.explode("buckets")).distinct().collect())  # at most the bucket count
    if buckets:
        touched = postings(spark, path).filter((F.col("n_buckets") == o.buckets) & F.col("bucket").isin(buckets))
        few = dead.count() <= BROADCAST_KEYS
        kept = _without(touched, dead, o.key)
        sizes = kept.groupBy("bucket").count().collect()  # at most the bucket count
        if few:
            _write(kept.sortWithinPartitions("bucket", "lexeme", o.key), f"{path}/postings", ["n_buckets", "bucket"], "overwrite")
        else:  # the join deals by key
            _write(by_lexeme_range(kept.drop("n_buckets", "bucket"), o.buckets, o.key, rows_per_task, sum(r["count"] for r in sizes)),
                   f"{path}/postings", ["n_buckets", "bucket"], "overwrite")
        for bucket in set(buckets) - {r["bucket"] for r in sizes}:  # nothing is left to overwrite these with
            drop_folder(spark, f"{path}/postings/n_buckets={o.buckets}/bucket={bucket}")
    parts = sorted(r[0] for r in dead.select("part").distinct().collect())
    if parts:
        left = known.filter(F.col("part").isin(parts)).join(dead.select(o.key), o.key, "left_anti")
        remaining = {r[0] for r in left.select("part").distinct().collect()}
        _write(left.repartition("part"), f"{path}/offers", ["part"], "overwrite")
        for part in set(parts) - remaining:
            drop_folder(spark, f"{path}/offers/part={part}")


def keep_only(spark: SparkSession, path: str, kept: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Cascade: take out every indexed offer that ``kept`` (silver after retention or a delete) no longer holds."""
    known = offers_in(spark, path)
    if known is not None:
        key = options(spark, path).key
        delete(spark, path, known.join(kept.select(key), key, "left_anti"), rows_per_task)
