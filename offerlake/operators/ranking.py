"""Exact ``row_number()`` over huge groups without putting a whole group in one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends every row of a group to one task; for a search
that ranks a whole corpus for one CV that is the entire corpus in one task. Here the rows are range
partitioned on ``(g, k)`` instead, so every task holds a contiguous slice of the global order. A row's
rank is its position inside its slice plus the number of rows of its group in earlier slices. The
positioned rows are checkpointed to the shared checkpoint folder once, so the per-slice counts and the
positions are read from the same materialised data (a recomputed range sample could move boundaries),
and a lost executor does not send the job back to the start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.session import checkpoint_dir

# Groups up to this many rows are ranked by a plain window (one task sorts the group); larger or
# unknown groups take the range-partitioned path.
WINDOW_GROUP_ROWS = 5_000_000
# The per-slice offset table is broadcast only up to this many rows (checked), else joined normally.
BROADCAST_OFFSET_ROWS = 1_000_000


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank",
                partitions: int | None = None, max_group_rows: int | None = None,
                window_limit: int = WINDOW_GROUP_ROWS) -> DataFrame:
    """Add ``name`` = row_number over (partition by ``by`` order by ``order``); ``order`` must be total
    (end it with a unique column) for the result to be deterministic.

    ``max_group_rows`` is a proven bound on the largest group (e.g. the corpus size when ranking the
    corpus per CV). When it is known and small, a window is used; otherwise the range-partitioned rank.
    """
    if max_group_rows is not None and max_group_rows <= window_limit:
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return _range_rank(df, by, order, name, partitions)


def _range_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str,
                partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(c).asc() for c in by] + list(order)
    ranged = df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
    positioned = ranged.select("*", F.spark_partition_id().alias("_pid"),
                               F.monotonically_increasing_id().alias("_pos")).checkpoint(eager=True)
    # At most (slices + groups) rows: each slice is a contiguous range of the (g, k) order.
    slices = positioned.groupBy("_pid", *by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_pid", *by, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # (slices + groups) rows: tiny for a few CVs or a global rank, but many groups make it large.
    n_slices = slices.count()
    out = positioned.join(F.broadcast(slices) if n_slices <= BROADCAST_OFFSET_ROWS else slices, ["_pid", *by])
    return out.select(*df.columns, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias(name))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Rank over a whole table (a window without PARTITION BY), spread over all tasks."""
    return rank_within(df, [], order, name, partitions)
