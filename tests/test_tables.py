import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.operators import links
from offerlake.operators import tables as tb
from offerlake.sources import batches as bt


def test_dedup_first_keeps_first_in_order(spark):
    df = spark.createDataFrame([("A", 1, 0), ("B", 2, 1), ("A", 3, 2), ("C", 4, 3), ("B", 5, 4)], "id string, v int, pos int")
    got = sorted((r.id, r.v) for r in tb.dedup_first(df, "id", "pos").collect())
    assert got == [("A", 1), ("B", 2), ("C", 4)]


def test_dedup_without_key_is_unchanged(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert tb.dedup_first(df, "id", "v").count() == 3


def test_dedup_hot_key_is_combined_map_side(spark):
    df = spark.range(0, 100000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("v"))
    out = tb.dedup_first(df, "k", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan or "partial_" in plan
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1), (1, 0)]


def test_insert_only_merge_is_idempotent(spark):
    target = spark.createDataFrame([("a", "old"), ("b", "old")], "job_id string, t string")
    source = spark.createDataFrame([("b", "new"), ("c", "new"), (None, "x"), ("c", "dup")], "job_id string, t string")
    once = tb.merge_insert_only(source, target, "job_id", order="t")
    twice = tb.merge_insert_only(source, once, "job_id", order="t")
    assert sorted(tuple(r) for r in once.collect()) == [("a", "old"), ("b", "old"), ("c", "dup")]
    assert sorted(tuple(r) for r in twice.collect()) == sorted(tuple(r) for r in once.collect())


def test_retention_partitions_input(spark):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, d date")
    kept = tb.retention(df, "d", "2024-01-30", 14)
    deleted = df.join(kept, "id", "left_anti")
    assert kept.count() + deleted.count() == df.count()
    assert kept.filter(F.col("d").isNull()).count() == 1
    assert kept.agg(F.min("d")).first()[0] == dt.date(2024, 1, 16)


def test_schema_align_nested(spark):
    df = spark.createDataFrame([("1", {"a": "x", "b": "2"}, 5)], "k string, s struct<a:string,b:string>, extra int")
    target = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StructType([
        T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType())])),
        T.StructField("missing", T.DateType())])
    out = tb.schema_align(df, target)
    assert out.schema == target
    r = out.first()
    assert r.k == 1 and r.s.a == "x" and r.s.b == 2 and r.s.c is None and r.missing is None


def test_union_relaxed_types(spark):
    a = spark.createDataFrame([(1, "2024-01-01")], "k int, d string")
    b = spark.createDataFrame([(2, 1.5)], "k bigint, v double")
    out = tb.union_relaxed([a, b])
    assert [f.dataType for f in out.schema.fields] == [T.LongType(), T.StringType(), T.DoubleType()]
    assert out.count() == 2


def test_latest_batch_by_name_and_stamp(spark):
    df = spark.createDataFrame([("job_20250601.parquet", 1), ("job_20250602.parquet", 2)], "f string, v int")
    assert [r.v for r in bt.latest_batch(df, "f", order="name").collect()] == [2]
    stamped = spark.createDataFrame([("jobs_raw_2026-01-01_x", 1), ("jobs_raw_20260712_210000", 2), ("plain", 3)], "f string, v int")
    assert [r.v for r in bt.latest_batch(stamped, "f").collect()] == [2]
    assert bt.latest_batch(df.limit(0), "f").count() == 0


def test_backfill_chunks(spark):
    rows = spark.createDataFrame([(dt.date(2026, 1, 20),), (dt.date(2026, 3, 1),)], "d date")
    out = bt.backfill_coverage(rows, "d", F.lit("2026-01-15"), F.lit("2026-03-10")).orderBy("chunk_start").collect()
    assert [(str(r.chunk_start), str(r.chunk_end), r.n_rows, r.empty) for r in out] == [
        ("2026-01-15", "2026-01-31", 1, False), ("2026-02-01", "2026-02-28", 0, True), ("2026-03-01", "2026-03-10", 1, False)]


def test_link_status_rules(spark):
    st = spark.createDataFrame([("A", "200"), ("B", "404"), ("C", "timeout"), ("D", "error"), ("E", "exception")],
                               "job_id string, status string")
    alive = {r.job_id: r.alive for r in links.link_classify(st).collect()}
    assert alive == {"A": True, "B": False, "C": True, "D": True, "E": True}
    results = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("E", 4), ("Z", 5)], "job_id string, rank int")
    kept = [r.job_id for r in links.dead_offer_filter(results, st).orderBy("rank").collect()]
    assert kept == ["A", "C", "Z"]
    assert links.dead_offer_filter(results.limit(0), st).count() == 0


def test_delete_dead_cascades(spark):
    st = spark.createDataFrame([("A", "200"), ("B", "404"), ("C", "exception")], "job_id string, status string")
    silver = spark.createDataFrame([("A",), ("B",), ("C",)], "job_id string")
    gold = spark.createDataFrame([("A", 1), ("B", 2), ("X", 3)], "job_id string, v int")
    s, g = links.delete_dead(silver, gold, st)
    assert sorted(r.job_id for r in s.collect()) == ["A", "C"]
    assert sorted(r.job_id for r in g.collect()) == ["A"]


def test_union_relaxed_keeps_structs_as_json_and_integers_exact(spark):
    a = spark.createDataFrame([("1", ("Acme",), 16777217)], "id string, e struct<nom:string>, n long")
    b = spark.createDataFrame([("2", '{"nom":"B"}', 0.5)], "id string, e string, n float")
    rows = {r.id: r for r in tb.union_relaxed([a, b]).collect()}
    assert rows["1"].e == '{"nom":"Acme"}' and rows["1"].n == 16777217 and rows["2"].n == 0.5


def test_missing_link_status_is_alive(spark):
    from offerlake.operators import links

    st = spark.createDataFrame([("a", None), ("b", "404")], "job_id string, status string")
    assert [r.job_id for r in links.dead_keys(st).collect()] == ["b"]
