import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlake.operators import search
from offerlake.operators.ranking import _range_rank, global_rank, rank_within
from offerlake.plans import catalog


def test_candidate_depth_bound():
    cfg = search.SearchConfig()
    m = cfg.candidate_depth
    assert m == 208
    # an offer ranked below m everywhere scores less than any of the K best of the title list
    assert 5 / (cfg.rrf_k + m + 1) < 3 / (cfg.rrf_k + cfg.top_k)
    assert cfg.score_max == pytest.approx(5 / 61)


def _h2(n):
    return sum(1 / j ** 2 for j in range(1, n + 1))


def test_text_score_hand_worked(spark):
    offers = spark.createDataFrame([(1, "python dev", "python python java", ""), (2, "java", "go", "")],
                                   "job_id long, title string, description string, skills string")
    idx = search.build_index(offers)
    cfg = search.SearchConfig()
    q = search.cv_lexemes(spark.createDataFrame([(7, "Python")], "cv_id long, cv_text string"), cfg)
    got = {r.job_id: (r.fts_score, r.title_score) for r in search.text_scores(idx, q, cfg).collect()}
    # 'python': once in the title (A, 1.0) then twice in the description (B, 0.6), in that order
    fts = (1.0 * _h2(1) + 0.6 * (_h2(3) - _h2(1))) / 1.64493406685
    title = 0.1 * _h2(1) / 1.64493406685 / 2  # one query lexeme, two title words
    assert got == {1: (pytest.approx(fts), pytest.approx(title))}


def test_text_score_custom_weights_match_stored(spark):
    offers = spark.createDataFrame([(1, "a b", "b b a", "b")], "job_id long, title string, description string, skills string")
    idx = search.build_index(offers)
    q = search.cv_lexemes(spark.createDataFrame([(1, "aa bb")], "cv_id long, cv_text string"), search.SearchConfig())
    # same weights given explicitly but forcing the recomputation path
    idx2 = idx.drop("w_f", "w_t")
    a = search.text_scores(idx, q, search.SearchConfig()).collect()
    b = search.text_scores(idx2, q, search.SearchConfig()).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_non_monotone_weights_use_first_max(spark):
    # C heavier than A: the largest weight first appears at occurrence a+b+1
    offers = spark.createDataFrame([(1, "x", "x", "x")], "job_id long, title string, description string, skills string")
    idx = search.build_index(offers).drop("w_f", "w_t")
    cfg = search.SearchConfig(field_weights={"A": 0.2, "B": 0.1, "C": 1.0})
    q = search.cv_lexemes(spark.createDataFrame([(1, "xx x")], "cv_id long, cv_text string"), cfg)
    q = q.withColumn("terms", F.array(F.lit("x"))).withColumn("n_terms", F.lit(1))
    got = search.text_scores(idx, q, cfg).first().fts_score
    total = 0.2 + 0.1 / 4 + 1.0 / 9
    assert got == pytest.approx((total + 1.0 - 1.0 / 9) / 1.64493406685)


def test_range_rank_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 1000).alias("s"), "id")
    order = [F.col("s").desc(), F.col("id").asc()]
    fast = _range_rank(df, ["g"], order, "r", 6)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(tuple(r) for r in fast.collect()) == sorted(tuple(r) for r in ref.collect())


def test_global_rank_is_a_permutation(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 31) % 97).alias("s"), "id")
    r = [x.r for x in global_rank(df, [F.col("s").asc(), F.col("id").asc()], "r", 5).collect()]
    assert sorted(r) == list(range(1, 3001))


def test_rank_within_chooses_window_only_for_bounded_groups(spark):
    df = spark.range(0, 100).select((F.col("id") % 2).alias("g"), "id")
    windowed = rank_within(df, ["g"], [F.col("id").asc()], "r", max_group_rows=50)
    ranged = rank_within(df, ["g"], [F.col("id").asc()], "r")
    assert "Window" in windowed._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in windowed.collect()) == sorted(tuple(r) for r in ranged.collect())


def test_search_plan_has_no_single_partition(spark, sf_small):
    df = catalog.QUERIES["rrf_search"](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_matching_terms_and_headline(spark):
    df = spark.createDataFrame([("Développeur Python, expert python et FastAPI sur GCP", ["python", "fastapi", "gcp", "de"])],
                               "t string, terms array<string>")
    r = df.select(search.matching_terms(F.col("t"), F.col("terms")).alias("m"),
                  "t", "terms").transform(lambda d: search.headline(d, "t", "terms", "h")).first()
    assert r.m == ["python", "fastapi", "gcp"]
    assert r.h.startswith("<b>Python</b>,") and "<b>FastAPI</b>" in r.h and "<b>Développeur" not in r.h


def test_vector_scores_exact(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "job_id long, embedding array<float>")
    cvs = spark.createDataFrame([(10, "x", [1.0, 0.0])], "cv_id long, cv_text string, cv_embedding array<float>")
    got = {r.job_id: r.embedding_score for r in search.vector_scores(vecs, cvs, search.SearchConfig()).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(1 - math.sqrt(2))}


def test_result_contract_counters(spark, sf_small):
    res = catalog.QUERIES["search_results"](spark, sf_small)
    checked, obs = search.check_results(res)
    n = checked.count()
    m = obs.get
    assert m["rows"] == n and m["score_out_of_range"] == 0 and m["null_fields"] == 0 and m["null_terms"] == 0


def test_search_edge_cases(spark):
    offers = spark.createDataFrame([(1, "python dev", "python", ""), (2, "java", "go", ""), (3, "x", "y", "")],
                                   "job_id long, title string, description string, skills string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "job_id long, embedding array<float>")
    idx = search.build_index(offers)
    cfg = search.SearchConfig(top_k=2)
    cvs = spark.createDataFrame([(1, "", [1.0, 0.0]), (2, "de la", [0.0, 1.0]), (3, "Python", [0.0, 0.0])],
                                "cv_id long, cv_text string, cv_embedding array<float>")
    out = {(r.cv_id, r.rank): r.job_id for r in search.rrf_search(vecs, idx, cvs, cfg).collect()}
    assert len(out) == 6
    # No text hit: every title score is 0, so the title rank (weight 3) goes by key and offer 1 wins even
    # where the vector prefers offer 2 - equal scores still get unequal rank shares, as in the reference.
    assert out[(1, 1)] == 1 and out[(2, 1)] == 1 and out[(2, 2)] == 2
    assert out[(3, 1)] == 1  # text and title hit for 'python'
    empty = search.rrf_search(vecs, idx, cvs.limit(0), cfg)
    assert empty.count() == 0


def test_vector_scores_in_slices_equal_one_slice(spark, sf_small):
    corpus, cvs = catalog.corpus(spark, sf_small), catalog.cvs(spark, sf_small)
    one = search.vector_scores(corpus, cvs, search.SearchConfig())
    sliced = search.vector_scores(corpus, cvs, search.SearchConfig(broadcast_rows=64 * 7))
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in sliced.collect())


def test_cosine_metric(spark):
    vecs = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0])], "job_id long, embedding array<float>")
    cvs = spark.createDataFrame([(10, "x", [3.0, 0.0])], "cv_id long, cv_text string, cv_embedding array<float>")
    got = {r.job_id: r.embedding_score for r in search.vector_scores(vecs, cvs, search.SearchConfig(metric="cosine")).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(math.sqrt(0.5))


def test_round_half_up_matches_spark(spark):
    import numpy as np

    vals = [0.1234567895, 0.0000000005, 2.675, -0.1234567895, 0.987654321123, 1.0, -0.5000000005]
    got = search.round_half_up(np.array(vals))
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    want = [r[0] for r in df.select(F.round("x", 9)).collect()]
    assert list(got) == want


def test_vector_topk_equals_full_ranking(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet").select(F.col("vec_id").alias("job_id"), "embedding")
    cvs = catalog.cvs(spark, sf_small)
    cfg = search.SearchConfig(top_k=7)
    fast = {(r.cv_id, r.rank): (r.job_id, r.score) for r in search.vector_topk(e.repartition(5), cvs, cfg).collect()}
    full = search.vector_scores(e, cvs, cfg).withColumn("score", F.round("embedding_score", 9))
    w = Window.partitionBy("cv_id").orderBy(F.col("score").desc(), F.col("job_id").asc())
    ref = {(r.cv_id, r.rank): (r.job_id, r.score)
           for r in full.withColumn("rank", F.row_number().over(w)).filter("rank <= 7").collect()}
    assert fast == ref and len(fast) == cvs.count() * 7


def test_bucketed_index_prunes_and_matches(spark, sf_small):
    from offerlake.session import scratch_path

    cfg = search.SearchConfig()
    idx = search.build_index(catalog.offers(spark, sf_small))
    path = scratch_path(spark, "ix")
    search.write_index(idx, path, cfg.index_buckets)
    stored = spark.read.parquet(path)
    one_cv = catalog.cvs(spark, sf_small).limit(1)
    q = search.cv_lexemes(one_cv, cfg)
    a = search.text_scores(stored, q, cfg)
    b = search.text_scores(idx, q, cfg)
    rounded = lambda df: sorted((r.cv_id, r.job_id, round(r.fts_score, 9), round(r.title_score, 9)) for r in df.collect())
    assert rounded(a) == rounded(b)
    plan = a._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "lexeme" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


def test_index_written_with_another_bucket_count(spark, sf_small):
    from offerlake.session import scratch_path

    cfg = search.SearchConfig()
    idx = search.build_index(catalog.offers(spark, sf_small))
    path = scratch_path(spark, "ix16")
    search.write_index(idx, path, 16)
    q = search.cv_lexemes(catalog.cvs(spark, sf_small).limit(1), cfg)
    rounded = lambda df: sorted((r.cv_id, r.job_id, round(r.fts_score, 9)) for r in df.collect())
    got = rounded(search.text_scores(spark.read.parquet(path), q, cfg))
    assert got and got == rounded(search.text_scores(idx, q, cfg))


def test_null_element_vectors_are_left_out(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, None]), (3, [0.0, 1.0])], "job_id long, embedding array<float>")
    offers = spark.createDataFrame([(i, "python", "java", "") for i in (1, 2, 3)], "job_id long, title string, description string, skills string")
    cvs = spark.createDataFrame([(1, "python", [1.0, 0.0])], "cv_id long, cv_text string, cv_embedding array<float>")
    idx = search.build_index(offers)
    ids = lambda cfg: sorted(r.job_id for r in search.rrf_search(corpus, idx, cvs, cfg).collect())
    assert ids(search.SearchConfig(top_k=3)) == [1, 3]


def test_append_index_is_insert_only(spark, sf_small):
    from offerlake.session import scratch_path

    offers = catalog.offers(spark, sf_small)
    path = scratch_path(spark, "ix-append")
    first = offers.filter(F.col("job_id") < 100)
    search.append_index(first, path)
    search.append_index(offers, path)
    search.append_index(offers, path)
    stored = spark.read.parquet(path).drop("bucket")
    full = search.build_index(offers)
    key = lambda df: sorted((r.job_id, r.lexeme, r.n_a, r.n_b, r.n_c, r.title_len) for r in df.collect())
    assert key(stored) == key(full)


def test_a_hot_lexeme_is_dealt_to_several_tasks(spark):
    from offerlake.operators.index_store import by_lexeme_range

    words = spark.range(60_000).select(F.col("id").alias("job_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 5000)).alias("lexeme"))
    dealt = by_lexeme_range(words, 16, rows_per_task=5000)
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) >= 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert dealt.where("lexeme = 'hot'").select(F.spark_partition_id()).distinct().count() >= 4


def test_range_rank_spreads_a_hot_group(spark):
    # group 0 holds a third of all rows
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"),
                                      ((F.col("id") * 7919) % 10007).alias("s"), "id")
    order = [F.col("s").desc(), F.col("id").asc()]
    ranked = _range_rank(df, ["g"], order, "r", 8)
    hot = ranked.filter(F.col("g") == 0).select(F.spark_partition_id().alias("p"), "r")
    assert hot.select("p").distinct().count() > 1  # the hot group is split over several tasks
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(tuple(r) for r in ranked.collect()) == sorted(tuple(r) for r in ref.collect())


def test_headline_marker_in_text_is_no_match(spark):
    df = spark.createDataFrame([("a <b>b</b> c java d", ["java"]), ("x y", []), ("", ["java"]), (None, ["java"])], "t string, terms array<string>")
    got = [r.h for r in search.headline(df, "t", "terms", "h", max_words=2, min_words=1).collect()]
    assert got == ["<b>java</b> d", "x", "", ""]


def test_matrix_scores_equal_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 48)), rng.normal(size=(20, 48))
    b[0], b[1] = a[5], a[6] + 1e-7
    exact = 1.0 - np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    got = search._score_matrix(a, b, "l2")
    assert np.abs(got - exact).max() < 1e-12 and got[5, 0] == 1.0
    assert (search.round_half_up(got.ravel()) == search.round_half_up(exact.ravel())).all()


def test_search_from_text_alone(spark):
    from offerlake.operators.encode import encode

    offers = spark.createDataFrame([(1, "Java", "spring java"), (2, "Data", "python c++ spark"), (3, "Vente", None)],
                                   "job_id long, title string, description string")
    corpus = encode(offers.withColumn("t", F.concat_ws(" ", "title", "description")), "job_id", "t", dim=16)
    cvs = spark.createDataFrame([(7, "python spark"), (8, None)], "cv_id long, cv_text string")
    top = search.hybrid_search(corpus, search.build_index(offers), cvs, dim=16).collect()
    assert {(r.cv_id, r.job_id) for r in top} == {(c, j) for c in (7, 8) for j in (1, 2, 3)}
    best = {r.job_id: (r.embed_rank, r.fts_rank) for r in top if r.cv_id == 7}
    assert best[2] == (1, 1)  # two of its words are the CV's; no title holds one


def test_stems_and_symbols_on_both_sides(spark):
    offers = spark.createDataFrame([(1, "Développeur", "c++"), (2, "Vente", "c de")], "job_id long, title string, description string")
    cfg = search.SearchConfig(stem=True, keep_symbols=True)
    ix = search.build_index(offers, stem=True, keep_symbols=True, stopwords=["de"])
    assert {r.lexeme for r in ix.collect()} == {"développeur", "c++", "vent", "c"}
    cvs = spark.createDataFrame([(1, "développeurs C++"), (2, "")], "cv_id long, cv_text string")
    q = search.cv_lexemes(cvs, cfg)
    assert {r.cv_id: r.terms for r in q.collect()} == {1: ["c++", "développeur"], 2: []}
    assert {(r.cv_id, r.job_id) for r in search.text_scores(ix, q, cfg).collect()} == {(1, 1)}


def test_best_fragment_covers_most_lexemes():
    import random

    r = random.Random(4)
    for _ in range(300):
        words = [r.choice(["a", "b", "c", "d.e", "x", "x", "x"]) for _ in range(r.randint(0, 40))]
        terms, size = set(r.sample(["a", "b", "c", "d", "e", "z"], r.randint(0, 5))), r.randint(1, 12)
        cover = {i: len({p for w in words[i:i + size] for p in w.split(".")} & terms) for i, w in enumerate(words) if set(w.split(".")) & terms}
        want = min(cover, key=lambda i: (-cover[i], i)) if cover else None
        assert search.best_fragment(words, terms, size) == want


def test_index_shuffles_texts_and_no_postings(spark):
    import re

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # title lengths of many offers are not broadcast
    try:
        offers = spark.createDataFrame([(1, "a b", "b b", "c"), (2, "", "x " * 300 + "B", None), (None, "a", "a", "a")],
                                       "job_id long, title string, description string, skills string")
        df = search.build_index(offers)
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("== Initial Plan ==")[0])
        assert dealt and not [x for x in dealt if "lexeme" in x]
        assert "Sort [" not in plan.split("== Initial Plan ==")[0]
        got = {(r.job_id, r.lexeme): r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, "b")}
    assert (got[1, "b"].n_a, got[1, "b"].n_b, got[1, "b"].title_len) == (1, 2, 2)
    # 300 occurrences are beyond the sums that are looked up
    assert got[2, "x"].w_f == pytest.approx((0.6 * _h2(300)) / 1.64493406685, abs=1e-15)


@pytest.mark.parametrize("pairs", [2_000_000, 50])
def test_scores_shuffle_postings_not_pairs(spark, sf_small, monkeypatch, pairs):
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", pairs)
    idx = catalog.index(spark, sf_small)
    words = idx.groupBy("lexeme").count().orderBy(F.desc("count"), "lexeme").limit(30).agg(F.collect_list("lexeme")).first()[0]
    cvs = spark.createDataFrame([(i, words[i:i + 1 + i % 7] + [f"none{i}"]) for i in range(25)], "cv_id long, terms array<string>")
    q = cvs.withColumn("n_terms", F.size("terms"))
    fast, rows = search.text_scores(idx, q, search.SearchConfig()), search.text_scores(idx, q, search.SearchConfig(broadcast_rows=10))
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cv_id" not in plan and "HashAggregate" not in plan
    assert "hashpartitioning(cv_id" in rows._jdf.queryExecution().executedPlan().toString()
    rounded = lambda df: sorted((r.cv_id, r.job_id, round(r.fts_score, 9), round(r.title_score, 9)) for r in df.collect())
    assert rounded(fast) == rounded(rows) and rounded(fast)


def test_scores_of_no_lexeme_and_of_a_text_key(spark):
    offers = spark.createDataFrame([("a", "python", "java", ""), ("b", None, "java", "")], "job_id string, title string, description string, skills string")
    idx = search.build_index(offers)
    q = spark.createDataFrame([(1, ["java"], 1), (2, [], 0)], "cv_id long, terms array<string>, n_terms int")
    assert sorted((r.cv_id, r.job_id, r.title_score) for r in search.text_scores(idx, q, search.SearchConfig()).collect()) == [(1, "a", 0.0), (1, "b", 0.0)]
    assert search.text_scores(idx, q.where("cv_id = 2"), search.SearchConfig()).collect() == []


def test_snippets_run_where_the_package_is_not_installed():
    from pyspark import cloudpickle

    assert b"offerlake.functions" not in cloudpickle.dumps(search._fragments)


def test_snippet_texts_stay_where_they_are(spark, sf_small):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.headline(spark, sf_small)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [job_id" in plan and "SortMergeJoin [job_id" not in plan


def test_each_offer_is_encoded_once(spark):
    from pyspark.sql import types as T

    seen = spark.sparkContext.accumulator(0)
    texts = spark.range(40).select(F.col("id").alias("job_id"), F.concat(F.lit("python java "), F.col("id")).alias("title"))

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf[["job_id"]].assign(embedding=[[1.0, float(i)] for i in pdf["job_id"]])

    corpus = texts.mapInPandas(run, T.StructType([T.StructField("job_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    cvs = spark.createDataFrame([(1, "python 7")], "cv_id long, cv_text string")
    top = search.hybrid_search(corpus, search.build_index(texts), cvs, search.SearchConfig(top_k=5), dim=2).collect()
    assert len(top) == 5 and top[0].fts_score > 0
    assert seen.value == 40
