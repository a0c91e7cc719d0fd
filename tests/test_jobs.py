import datetime as dt

from pyspark.sql import functions as F

from offerlake.plans import jobs

BRONZE = ("id string, intitule string, description string, "
          "competences array<struct<code:string,libelle:string>>, formations array<struct<domaineLibelle:string>>, "
          "qualitesProfessionnelles array<struct<libelle:string,description:string>>")


def _bronze(spark, rows):
    return spark.createDataFrame(rows, BRONZE)


def test_silver_and_gold_two_offers(spark):
    b = _bronze(spark, [("J1", "Dev Python", "<p>Python dev</p>", [("1", "Python"), ("2", "GCP")], [("Informatique",)], None),
                        ("J2", "Data", None, None, None, [("Rigueur", "x")])])
    silver = jobs.build_silver(b, "2025-06-01")
    rows = {r.job_id: r for r in silver.collect()}
    assert rows["J1"].description == "Python dev"
    assert rows["J1"].vector_text_input == "Dev Python Python dev Python GCP Informatique "
    assert rows["J2"].description == "" and rows["J2"].vector_text_input == "Data    Rigueur"
    assert rows["J1"].ingestion_date == dt.date(2025, 6, 1)
    gold = jobs.build_gold(silver, None, "2025-06-01", dim=32)
    assert gold.count() == 2 and len(gold.first().embedding) == 32


def test_duplicate_ids_encoded_once(spark):
    b = _bronze(spark, [("J1", "A", "a", None, None, None), ("J1", "A2", "a", None, None, None), ("J2", "B", "b", None, None, None)])
    silver = jobs.build_silver(b, "2025-06-01")
    assert silver.count() == 2
    assert jobs.build_gold(silver, None, "2025-06-01", dim=16).count() == 2


def test_write_pair_is_seen_only_when_complete(spark, tmp_path):
    b = _bronze(spark, [("J1", "A", "x", None, None, None), ("J2", "B", "y", None, None, None)])
    silver = jobs.build_silver(b, "2025-06-01")
    gold = jobs.build_gold(silver, None, "2025-06-01", dim=8)
    path = str(tmp_path / "pairs")
    jobs.write_pair(silver, gold, path, "r1")
    silver.write.parquet(f"{path}/silver/run_id=r2")  # a run that died before its gold was written
    s, g = jobs.read_pairs(spark, path)
    assert s.count() == 2 and g.count() == 2
    assert {r.run_id for r in s.collect()} == {"r1"}


def test_gold_incremental(spark):
    b = _bronze(spark, [(f"J{i:02d}", f"T{i}", "d", None, None, None) for i in range(10)])
    silver = jobs.build_silver(b, "2025-06-01")
    first = jobs.build_gold(silver.filter("job_id < 'J03'"), None, "2025-06-01", dim=8)
    assert first.count() == 3
    rest = jobs.build_gold(silver, first, "2025-06-02", dim=8)
    assert rest.count() == 7 and rest.join(first, "job_id").count() == 0


def test_run_batch_and_report(spark):
    b = _bronze(spark, [("J1", "A", "<b>x</b>", None, None, None), ("J2", "B", "y", None, None, None)])
    silver, gold, ex_s, ex_g = jobs.run_batch(b, None, None, "2025-06-01", dim=8)
    assert ex_s.count() == 2 and ex_g.count() == 2
    assert ex_g.schema["embedding"].dataType.typeName() == "string"
    b2 = _bronze(spark, [("J2", "B2", "y2", None, None, None), ("J3", "C", "z", None, None, None)])
    silver2, gold2, ex_s2, ex_g2 = jobs.run_batch(b2, silver, gold, "2025-06-02", dim=8)
    assert sorted(r.job_id for r in silver2.collect()) == ["J1", "J2", "J3"]
    assert [r.intitule for r in silver2.filter(F.col("job_id") == "J2").collect()] == ["B"]  # first write wins
    assert sorted(r.job_id for r in ex_g2.collect()) == ["J3"]
    rep = jobs.lake_report(silver2.withColumn("typeContratLibelle", F.lit("CDI"))
                           .withColumn("secteurActiviteLibelle", F.lit(None).cast("string")), gold2, "2025-06-02")
    assert rep["total"].first().total == 3
    assert rep["gold_keys"].first().jobs_with_embeddings == 3
    assert [tuple(r) for r in rep["contracts"].collect()] == [("CDI", 3)]
    assert [r.cnt for r in rep["per_day"].collect()] == [1, 2]


def test_observed_run_counters(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "job_id string")
    observed, obs = jobs.observe_run(df, "job_id")
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "null_keys": 1}


def test_gold_keeps_one_row_for_each_silver_row(spark):
    silver = spark.createDataFrame([("J1", "a"), ("J1", "b"), ("J2", None)], "job_id string, vector_text_input string").withColumn("ingestion_date", F.to_date(F.lit("2025-05-01")))
    gold = jobs.build_gold(silver, None, "2025-06-01", dim=8)
    assert gold.count() == 3 and {str(r.ingestion_date) for r in gold.collect()} == {"2025-05-01"}
    plan = gold._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_serving_load_takes_the_first_row_in_source_order(spark):
    schema = "job_id string, text string, _file string, _row long"
    rows = [("A", "late", "f2", 0), ("A", "first", "f1", 3), ("A", "then", "f1", 4), ("B", "only", "f2", 1), (None, "none", "f1", 0)]
    batch = spark.createDataFrame(rows, schema).withColumn("ingestion_date", F.to_date(F.lit("2025-06-01")))
    gold = spark.createDataFrame([("A", "[2.0]", "f1", 9), ("A", "[1.0]", "f1", 1)], "job_id string, embedding string, _file string, _row long").withColumn("ingestion_date", F.to_date(F.lit("2025-06-01")))
    served = batch.limit(0).select("job_id", "text", "ingestion_date")
    served_gold = spark.createDataFrame([], "job_id string, embedding array<float>, ingestion_date date")
    s, g = jobs.load_serving(batch, gold, served, served_gold, "2025-06-02")
    assert {(r.job_id, r.text) for r in s.collect()} == {("A", "first"), ("B", "only")}
    assert [r.embedding for r in g.collect()] == [[1.0]]
    s, _ = jobs.load_serving(batch, gold, served, served_gold, "2025-06-02", order=["_row"])
    assert {(r.job_id, r.text) for r in s.collect()} == {("A", "late"), ("B", "only")}
