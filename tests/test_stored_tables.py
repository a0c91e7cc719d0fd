import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from offerlake.operators import index_store, search, tables as tb
from offerlake.session import scratch_path
from offerlake.sources import batches as bt
from offerlake.streaming.ingest import merge_into_path

POSTING = ("job_id", "lexeme", "n_a", "n_b", "n_c", "title_len")


def _offers(spark, rows):
    return spark.createDataFrame(rows, "job_id long, title string, description string, skills string")


def _postings(df):
    return sorted(tuple(r[c] for c in POSTING) for r in df.collect())


def _files(path):
    path = path.removeprefix("file:")
    assert os.path.isdir(path)
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_index_life_equals_a_fresh_index(spark):
    rows = [(i, f"poste {i % 7}", f"mot{i % 11} commun rare{i}", "") for i in range(120)] + [(500, "", None, "")]
    path = scratch_path(spark, "life")
    index_store.create(spark, path, buckets=8, stem=True, stopwords=["commun"])
    index_store.append(_offers(spark, rows[:70]), path)
    index_store.append(_offers(spark, rows), path)
    index_store.append(_offers(spark, rows), path)
    gone = [3, 69, 70, 500, 9999]
    index_store.delete(spark, path, _offers(spark, [(i, "", "", "") for i in gone]))
    index_store.keep_only(spark, path, _offers(spark, rows).where("job_id != 4"))
    left = [r for r in rows if r[0] not in (*gone, 4)]
    fresh = search.build_index(_offers(spark, left), stem=True, stopwords=["commun"])
    assert _postings(index_store.postings(spark, path)) == _postings(fresh)
    assert sorted(r.job_id for r in index_store.offers_in(spark, path).collect()) == sorted(r[0] for r in left)


def test_delete_rewrites_touched_buckets_only(spark):
    rows = [(i, f"mot{i}", "", "") for i in range(200)]
    path = scratch_path(spark, "touched")
    index_store.create(spark, path, buckets=16)
    index_store.append(_offers(spark, rows), path)
    before = _files(f"{path}/postings")
    touched = index_store.offers_in(spark, path).where("job_id in (5, 6)").select(F.explode("buckets").alias("b")).distinct().collect()
    index_store.delete(spark, path, _offers(spark, rows[5:7]))
    after = _files(f"{path}/postings")
    changed = {f.split("bucket=")[1].split("/")[0] for f in before if after.get(f) != before[f]}
    assert changed == {str(r.b) for r in touched} and 0 < len(changed) <= 2
    index_store.delete(spark, path, _offers(spark, rows))
    assert not _files(f"{path}/postings") and not _files(f"{path}/offers")


def test_retention_drops_whole_dates(spark):
    path = scratch_path(spark, "dates")
    days = [dt.date(2024, 1, d) for d in (1, 2, 15, 16, 30)] + [None]
    spark.createDataFrame([(i, d) for i, d in enumerate(days * 3)], "id long, day date").write.partitionBy("day").parquet(path)
    before = _files(path)
    assert len(before) >= 6
    report = {r.day: r.deleted for r in tb.drop_expired(spark, path, "2024-01-30", 14, "day").collect()}
    assert report == {dt.date(2024, 1, d): 3 for d in (1, 2, 15)}
    after = _files(path)
    assert after == {f: t for f, t in before.items() if "day=2024-01-0" not in f and "day=2024-01-15" not in f}
    assert spark.read.parquet(path).where("day is null").count() == 3
    assert tb.drop_expired(spark, path, "2024-01-30", 14, "day").count() == 0


def test_conflicting_files_read_as_one_table(spark):
    path = scratch_path(spark, "mixed")
    kinds = ["int", "int", "long", "string", "int", "double"]
    for n, kind in enumerate(kinds):
        df = spark.range(3).select((F.col("id") + 10 * n).cast(kind).alias("id"))
        (df.withColumn("extra", F.lit("x")) if n == 1 else df).coalesce(1).write.parquet(f"{path}/jobs_raw_2024010{n + 1}_000000")
    groups = bt.schema_groups(spark, bt.data_files(spark, f"{path}/*"))
    assert [len(g) for g in groups] == [2, 1, 1, 1, 1]
    got = bt.read_relaxed(spark, f"{path}/*")
    assert dict(got.dtypes)["id"] == "string" and got.where("extra = 'x'").count() == 3
    assert sorted(r.id for r in got.collect()) == sorted([str(10 * n + i) for n in range(5) for i in range(3)] + ["50.0", "51.0", "52.0"])
    assert len(bt.schema_groups(spark, bt.data_files(spark, f"{path}/jobs_raw_2024010[12]*"))) == 1
    with pytest.raises(FileNotFoundError):
        bt.read_relaxed(spark, f"{path}/none*")


def test_decimals_keep_their_digits(spark):
    a = spark.sql("select cast('12345678901234567890123456789012345678' as decimal(38,0)) v")
    b = spark.sql("select cast('1.123456789012345678' as decimal(38,18)) v")
    assert sorted(r.v for r in tb.union_relaxed([a, b]).collect()) == ["1.123456789012345678", "12345678901234567890123456789012345678"]
    c, d = spark.sql("select cast(1.25 as decimal(5,2)) v"), spark.sql("select 9223372036854775807L v")
    both = tb.union_relaxed([c, d])
    assert dict(both.dtypes)["v"] == "decimal(21,2)" and both.where("v is null").count() == 0


def test_merge_counts_what_it_inserts_and_knows_a_replay(spark):
    path = scratch_path(spark, "merged")
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    assert merge_into_path(make([1, 2, 2, None], "a"), path, "id", batch_id="b0") == 2
    assert merge_into_path(make([2, 3, 9], "b"), path, "id", batch_id="b1") == 2
    assert merge_into_path(make([2, 3, 9, 10], "c"), path, "id", batch_id="b1") == 0  # recorded: not read again
    assert merge_into_path(make([9, 3], "d"), path, "id") == 0 and merge_into_path(make([], "d"), path, "id") == 0
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b"), (9, "b")]


def test_a_batch_killed_before_its_record_is_merged_once(spark, monkeypatch):
    from offerlake.streaming import ingest

    path = scratch_path(spark, "killed")
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    monkeypatch.setattr(ingest, "MERGED", "no/such=?\0")
    with pytest.raises(Exception):
        merge_into_path(df, path, "id", batch_id="b0")
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5
    assert merge_into_path(df, path, "id", batch_id="b0") == 0 and spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("few", [2_000_000, 3])
def test_delete_keeps_postings_in_their_tasks(spark, monkeypatch, few):
    """With few dead offers nothing is dealt anew; with more than can be broadcast the rows are the same."""
    dealt, by_range = [], index_store.by_lexeme_range
    monkeypatch.setattr(index_store, "BROADCAST_KEYS", few)
    rows = [(i, f"poste {i % 7}", f"mot{i % 11} commun rare{i}", "") for i in range(120)]
    path = scratch_path(spark, "in-place")
    index_store.create(spark, path, buckets=100)
    index_store.append(_offers(spark, rows[:50]), path)
    index_store.append(_offers(spark, rows), path)
    held = {r.job_id: r.buckets for r in index_store.offers_in(spark, path).collect()}
    stored = index_store.postings(spark, path).groupBy("job_id").agg(F.sort_array(F.collect_set("bucket")).alias("b")).collect()
    assert held == {r.job_id: r.b for r in stored} and max(max(b) for b in held.values()) > 63
    monkeypatch.setattr(index_store, "by_lexeme_range", lambda *a, **k: dealt.append(1) or by_range(*a, **k))
    index_store.delete(spark, path, _offers(spark, rows[20:40]))
    assert len(dealt) == (few == 3)
    assert _postings(index_store.postings(spark, path)) == _postings(search.build_index(_offers(spark, rows[:20] + rows[40:])))
