"""Sharding by longest-processing-time scheduling; rows with equal texts stay together.

Law ``bytes``: shard sizes near equal. Groups of equal texts are the jobs. A group larger than
``1 / (shards * fine)`` of all bytes is a job of its own (there are at most ``shards * fine`` such groups); all
smaller groups are gathered into ``cells`` cells by the hash of their text, and each cell is a job. The jobs, a
bounded number whatever the input, are sorted by size and each goes to the least loaded shard through a heap.

A row's size is its text's UTF-8 bytes plus 8; a null text has no bytes and shares the group of the empty text's
bytes only in its checksum, not in its group. Slots number the rows of a shard without gaps: every job has sub-cells
of bounded size, whose row counts give offsets, and rows are ranked inside their sub-cell.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.common import saved, table


@dataclass(frozen=True)
class Config:
    shards: int = 24
    cells: int = 16384
    fine: int = 256
    sub_rows: int = 2_000  # rows ranked together, about


def least_loaded(jobs: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """job -> shard: largest first, each to the shard with the least load (lowest number on ties)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for job, size in sorted(jobs, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[job] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for every row."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # the group: null apart from empty, and 128 bits of the text
    rows = saved(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), data).alias("g1"), F.xxhash64(data, F.lit(1)).alias("g2")), "shard-rows")
    cell = F.pmod(F.col("g1"), F.lit(cfg.cells))
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large_from = max(1, total // (cfg.shards * cfg.fine))
    sized = groups.withColumn("large", F.col("bytes") > large_from)
    large = sized.where("large").select("g1", "g2", "bytes", "rows").collect()  # at most shards * fine groups
    small = (sized.where("not large").groupBy(cell.cast("int").alias("cell"))
             .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect())  # at most cfg.cells
    jobs = [(r["cell"], r["bytes"], r["rows"]) for r in small]
    jobs += [(cfg.cells + i, r["bytes"], r["rows"]) for i, r in enumerate(sorted(large, key=lambda r: (r["g1"], r["g2"])))]
    to = least_loaded([(j, b) for j, b, _ in jobs], cfg.shards)
    plan = spark.createDataFrame([(j, to[j], -(-n // cfg.sub_rows)) for j, _, n in jobs] or [(0, 0, 1)], "job int, shard int, subs long")
    heavy = spark.createDataFrame([(r["g1"], r["g2"], cfg.cells + i) for i, r in enumerate(sorted(large, key=lambda r: (r["g1"], r["g2"])))] or [(0, 0, -1)],
                                  "g1 long, g2 long, heavy int").where("heavy >= 0")
    # both tables hold at most cells + shards * fine rows
    placed = (rows.join(F.broadcast(heavy), ["g1", "g2"], "left").withColumn("job", F.coalesce("heavy", cell.cast("int")))
              .join(F.broadcast(plan), "job")
              .withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("subs")))
              .select("doc_id", "size", "text_crc32", "shard", "job", "sub"))
    counts = placed.groupBy("shard", "job", "sub").agg(F.count(F.lit(1)).alias("n"))
    per_job = counts.groupBy("shard", "job").agg(F.sum("n").alias("n"))
    jobs_before = per_job.select("shard", "job", (F.sum("n").over(Window.partitionBy("shard").orderBy("job")) - F.col("n")).alias("job_from"))
    offsets = counts.select("job", "sub", (F.sum("n").over(Window.partitionBy("job").orderBy("sub")) - F.col("n")).alias("sub_from"))
    rank = F.row_number().over(Window.partitionBy("job", "sub").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = placed.withColumn("rank", rank).join(offsets, ["job", "sub"]).join(F.broadcast(jobs_before), ["shard", "job"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("job_from") + F.col("sub_from") + F.col("rank")).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
