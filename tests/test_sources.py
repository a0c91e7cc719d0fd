from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.session import scratch_path
from offerlake.sources import batches as bt
from offerlake.sources.folders import path_exists
from offerlake.streaming.ingest import merge_into_path

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("k", T.IntegerType())])


def test_land_write_and_pick_batches(spark):
    path = scratch_path(spark, "landing")
    raw = spark.createDataFrame([('{"id": "a", "k": 1}',), ("{}",), ('{"id": "b", "k": 2}',)], "rec string")
    landed = bt.land_records(raw, "rec", SCHEMA)
    rows = sorted((r.id, r.k) for r in landed.collect() if r.id)
    assert rows == [("a", 1), ("b", 2)] and landed.filter(F.col("id").isNull() & F.col("k").isNull()).count() == 1
    bt.write_batch(landed, path, "jobs_raw_20240101_210000", "2024-01-01")
    bt.write_batch(landed.limit(1), path, "jobs_raw_20240102_210000", "2024-01-02")
    back = bt.read_with_source(spark, path)
    assert {"_file", "_modified", "batch_id", "ingestion_date"} <= set(back.columns)
    newest = bt.latest_batch(back, "batch_id")
    assert {r.batch_id for r in newest.collect()} == {"jobs_raw_20240102_210000"}
    recent = bt.recent_batches(back, "2024-01-03", 1, "batch_id")
    assert {r.batch_id for r in recent.collect()} == {"jobs_raw_20240102_210000"}
    # nothing recent -> the newest batch
    none_recent = bt.recent_batches(back, "2030-01-01", 1, "batch_id")
    assert {r.batch_id for r in none_recent.collect()} == {"jobs_raw_20240102_210000"}
    by_modified = bt.recent_batches(back, "2999-01-01", 365 * 2000, "batch_id", time_col="_modified")
    assert by_modified.count() == back.count()
    assert bt.latest_day(back, "batch_id").count() == 1


def test_merge_into_path_creates_then_appends(spark):
    path = scratch_path(spark, "silver")
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "z")], "job_id string, t string")
    assert not path_exists(spark, path)
    merge_into_path(a, path, "job_id", order="t")
    merge_into_path(a, path, "job_id", order="t")
    b = spark.createDataFrame([("3", "w"), ("1", "new")], "job_id string, t string")
    merge_into_path(b, path, "job_id")
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert got == [("1", "x"), ("2", "y"), ("3", "w")]


def test_land_records_nulls_each_literal_empty_object(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("salaire", T.StructType([T.StructField("min", T.IntegerType())]))])
    raw = spark.createDataFrame([(1, '{"id":"1","salaire":{}}'), (2, '{"id":"2","salaire":{"x":1}}'), (3, "{}"),
                                 (4, '{"id":"4","salaire":{"min":7}}'), (5, None)], "n int, record string")
    got = {r.n: (r.id, r.salaire) for r in bt.land_records(raw, "record", schema).collect()}
    assert got[1] == ("1", None) and got[3] == (None, None) and got[5] == (None, None)
    assert got[2][1] is not None and got[2][1].min is None and got[4][1].min == 7


def test_rows_keep_their_place_in_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i,) for i in (5, 3, 9)], "a int").coalesce(1).write.parquet(path)
    assert [(r.a, r._row) for r in bt.read_with_source(spark, path + "/*.parquet").orderBy("_row").collect()] == [(5, 0), (3, 1), (9, 2)]
