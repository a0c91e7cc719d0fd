"""Composite jobs: silver build, gold build, export, retention, full batch, serving load, lake report.

Each job is a function from DataFrames to DataFrames; writing is left to the caller (or to the small
``write_*`` helpers), so the same plan serves a notebook, a scheduled job and the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions import nested as nx
from offerlake.functions import text as tx
from offerlake.operators import tables as tb
from offerlake.operators.encode import encode
from offerlake.session import scratch_path

NESTED_TEXT_FIELDS = (
    ("competences", "libelle", "competences_text"),
    ("formations", "domaineLibelle", "formations_text"),
    ("qualitesProfessionnelles", "libelle", "qualites_text"),
)


def _nested(df: DataFrame, col: str, field: str):
    if col not in df.columns:
        return F.lit("")
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return tx.nested_text_from_json(F.col(col), field)
    if isinstance(dtype, T.StructType):
        return tx.nested_text_of_struct(F.col(col), field)
    return tx.nested_text(F.col(col), field)


def build_silver(bronze: DataFrame, as_of: str, order: str | list[str] | None = None,
                 target: T.StructType | None = None) -> DataFrame:
    """Bronze offers -> silver rows: HTML cleaned, nested texts, embedding input text, one row per id
    (first by ``order``; else by file and row where ``read_with_source`` noted them), ``id`` -> ``job_id`` (string), ingestion date stamped.
    Null ids are rejected. With ``target`` the result is aligned to that schema."""
    df = bronze
    parts = {name: _nested(df, col, field) for col, field, name in NESTED_TEXT_FIELDS}
    desc = tx.html_clean(F.col("description")) if "description" in df.columns else F.lit("")
    title = F.col("intitule") if "intitule" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({
        "description": desc,
        "vector_text_input": tx.vector_text(title, desc, parts["competences_text"], parts["formations_text"],
                                            parts["qualites_text"]),
    })
    df = df.filter(F.col("id").isNotNull())
    in_file_order = ["_file", "_row"] if {"_file", "_row"} <= set(df.columns) else "id"
    df = tb.dedup_first(df, "id", order or in_file_order)
    df = df.withColumn("id", F.col("id").cast("string")).withColumnsRenamed({"id": "job_id"})
    df = df.withColumn("ingestion_date", F.to_date(F.lit(as_of)))
    return tb.schema_align(df, target) if target is not None else df


def build_gold(silver: DataFrame, gold: DataFrame | None, as_of: str, dim: int = 384,
               encoder_factory: Callable[[], object] | None = None) -> DataFrame:
    """Embeddings for silver offers not in gold yet (``job_id, embedding, ingestion_date``).
    ``gold=None`` stands for a gold table that does not exist yet."""
    todo = silver if gold is None else tb.unprocessed(silver, gold, "job_id")
    if "ingestion_date" not in todo.columns:
        todo = todo.withColumn("ingestion_date", F.to_date(F.lit(as_of)))
    # an offer embedded later than it was ingested keeps the date of its silver row, which travels with the text
    return encode(todo, "job_id", "vector_text_input", dim=dim, encoder_factory=encoder_factory, keep=("ingestion_date",))


def export_latest(silver: DataFrame, gold: DataFrame, date_col: str = "ingestion_date") -> tuple[DataFrame, DataFrame]:
    """Newest ingestion date of silver, and the gold rows of that same date; nested columns become
    JSON text (null fields kept), vectors JSON arrays."""
    latest = silver.select(F.max(date_col)).scalar()
    s = silver.filter(F.col(date_col) == latest)
    s = s.select(*[nx.json_serialize(s, c).alias(c) for c in s.columns])
    g = gold.filter(F.col(date_col) == latest)
    g = g.select(*[(nx.vector_to_json(c) if c == "embedding" else F.col(c)).alias(c) for c in g.columns])
    return s, g


def run_batch(bronze: DataFrame, silver: DataFrame | None, gold: DataFrame | None, as_of: str,
              retention_days: int = 60, dim: int = 384, encoder_factory=None, order: str | list[str] | None = None,
              stage: str | None = None, counters: dict[str, int] | None = None):
    """Retention -> silver -> gold -> export, as DataFrames: returns (silver, gold, export_silver, export_gold).

    ``counters`` receives what the run observed while it wrote (no extra job): rows in, null and repeated ids, rows inserted
    into silver, offers embedded. Silver is cleaned once: it is written to ``stage`` (a fresh folder of the shared checkpoint folder by default)
    and read back, gold is made from those rows and staged likewise, and both exports read the staged pair."""
    spark = bronze.sparkSession
    stage = stage or scratch_path(spark, "run")
    seen, clean, merged, embedded = (Observation(n) for n in ("bronze", "silver", "merge", "gold"))
    rows = F.count(F.lit(1)).alias("rows")
    new_silver = build_silver(bronze.observe(seen, rows, F.count_if(F.col("id").isNull()).alias("null_ids")), as_of, order).observe(clean, rows)
    if silver is not None:
        kept = tb.retention(silver, "ingestion_date", as_of, retention_days)
        new = tb.insert_only_rows(new_silver, kept, "job_id")
        silver_all = kept.unionByName(tb.schema_align(new, kept.schema).observe(merged, rows))
    else:
        silver_all = new_silver.observe(merged, rows)
    silver_all = _staged(silver_all, f"{stage}/silver")
    if gold is not None:
        gold = tb.retention(gold, "ingestion_date", as_of, retention_days)
    new_gold = build_gold(silver_all, gold, as_of, dim=dim, encoder_factory=encoder_factory).observe(embedded, rows)
    gold_all = _staged(new_gold if gold is None else gold.unionByName(new_gold), f"{stage}/gold")
    if counters is not None:
        n = {o._name: o.get for o in (seen, clean, merged, embedded)}
        counters.update(rows_in=n["bronze"]["rows"], null_ids=n["bronze"]["null_ids"], repeated_ids=n["bronze"]["rows"] - n["bronze"]["null_ids"] - n["silver"]["rows"],
                        inserted=n["merge"]["rows"], embedded=n["gold"]["rows"])
    ex_s, ex_g = export_latest(silver_all, gold_all)
    return silver_all, gold_all, ex_s, ex_g


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


RUNS = "run_id string, n_silver long, n_gold long"


COUNTERS = "run_id string, counter string, n long"


def read_counters(spark, path: str) -> DataFrame:
    """``(run_id, counter, n)`` of the completed runs."""
    runs = spark.read.schema(RUNS).parquet(f"{path}/runs").select("run_id").distinct()
    return spark.read.schema(COUNTERS).parquet(f"{path}/counters").join(runs, "run_id", "left_semi")


def write_pair(silver: DataFrame, gold: DataFrame, path: str, run_id: str, counters: dict[str, int] | None = None) -> None:
    """Write silver and gold of one run as a pair below ``path``. The run is entered in ``path``/runs only after both
    tables are complete, with their row counts, so readers of ``read_pairs`` never see half a run; a run that died
    is written again under another id. The run's ``counters`` are written beside it."""
    spark = silver.sparkSession
    counts = [_staged(df, f"{path}/{name}/run_id={run_id}").count() for name, df in (("silver", silver), ("gold", gold))]
    if counters:
        spark.createDataFrame([(run_id, k, v) for k, v in counters.items()], COUNTERS).coalesce(1).write.mode("append").parquet(f"{path}/counters")
    spark.createDataFrame([(run_id, *counts)], RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def read_pairs(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Silver and gold of every completed run (``run_id`` tells which)."""
    runs = spark.read.schema(RUNS).parquet(f"{path}/runs").select("run_id").distinct()
    tables = [spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
              .withColumn("run_id", F.col("run_id").cast("string")).join(runs, "run_id", "left_semi")
              for name in ("silver", "gold")]
    return tables[0], tables[1]


def load_serving(silver_batch: DataFrame, gold_batch: DataFrame, served_silver: DataFrame,
                 served_gold: DataFrame, as_of: str, retention_days: int = 30,
                 silver_schema: T.StructType | None = None, order: str | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Serving load: parse JSON text columns and vectors, insert new silver keys, insert gold rows
    whose parent exists (orphans are kept out), then retention. Returns the served tables after.

    Of a repeated key the first row in source order is inserted: by ``order``, else by file and row where
    ``read_with_source`` noted them, else by a hash of the row."""
    target = silver_schema or served_silver.schema
    batch = tb.schema_align(_first_in_source(silver_batch, order), target)
    new_silver = tb.insert_only_rows(batch, served_silver, "job_id")
    silver_after = served_silver.unionByName(new_silver)
    gold_batch = _first_in_source(gold_batch, order)
    g = gold_batch.withColumn("embedding", nx.vector_sanitize(nx.vector_parse(gold_batch, "embedding")))
    g = tb.cascade_delete(g, silver_after, "job_id")
    new_gold = tb.insert_only_rows(g, served_gold, "job_id")
    gold_after = served_gold.unionByName(tb.schema_align(new_gold, served_gold.schema))
    silver_after = tb.retention(silver_after, "ingestion_date", as_of, retention_days)
    gold_after = tb.cascade_delete(tb.retention(gold_after, "ingestion_date", as_of, retention_days),
                                   silver_after, "job_id")
    return silver_after, gold_after


def _first_in_source(df: DataFrame, order: str | list[str] | None) -> DataFrame:
    order = order or (["_file", "_row"] if {"_file", "_row"} <= set(df.columns) else None)
    return df if order is None else tb.dedup_first(df.filter(F.col("job_id").isNotNull()), "job_id", order)


def lake_report(silver: DataFrame, gold: DataFrame, as_of: str, days: int = 14, top: int = 10,
                approx_distinct: bool = False, contract_col: str = "typeContratLibelle",
                sector_col: str = "secteurActiviteLibelle") -> dict[str, DataFrame]:
    """The five lake queries: total, top contract types, top sectors, per day (last ``days``), gold keys
    (exact distinct count, or a HyperLogLog estimate with ``approx_distinct``)."""
    def top_groups(col: str) -> DataFrame:
        return (silver.groupBy(col).agg(F.count("*").cast("long").alias("cnt"))
                .orderBy(F.col("cnt").desc(), F.col(col).asc_nulls_last()).limit(top))

    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    return {
        "total": silver.agg(F.count("*").cast("long").alias("total")),
        "contracts": top_groups(contract_col),
        "sectors": top_groups(sector_col),
        "per_day": (silver.filter(F.col("ingestion_date") >= cutoff).groupBy("ingestion_date")
                    .agg(F.count("*").cast("long").alias("cnt")).orderBy(F.col("ingestion_date").desc())),
        "gold_keys": gold.agg((F.approx_count_distinct("job_id") if approx_distinct else F.count_distinct("job_id"))
                              .cast("long").alias("jobs_with_embeddings")),
    }


def observe_run(df: DataFrame, key: str, name: str = "run") -> tuple[DataFrame, Observation]:
    """Attach run counters (rows, null keys) that fill in when ``df`` is written - one pass, no extra job."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys")), obs


def run_metrics(source: DataFrame, done: DataFrame, key: str, text_col: str, length_col: str,
                short: int = 100) -> DataFrame:
    """One row of counters over a whole table: rows, repeated texts, null keys, keys done already, short texts."""
    seen = done.select(F.col(key)).distinct().withColumn("_done", F.lit(True))
    return source.join(seen, key, "left").agg(
        F.count("*").alias("rows_in"),
        (F.count("*") - F.count_distinct(text_col)).alias("duplicate_texts"),
        F.count_if(F.col(key).isNull()).cast("long").alias("null_keys"),
        F.count_if(F.col("_done").isNotNull()).cast("long").alias("already_processed"),
        F.count_if(F.col(length_col) < short).cast("long").alias("short_texts"),
    )
