import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.operators import rrf, search
from offerlake.plans import catalog

COLS = ["cv_id", "rank", "job_id", "embedding_score", "fts_score", "title_score", "embed_rank", "fts_rank", "title_rank"]


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def brute(spark, corpus, idx, cvs, cfg):
    """All ranks of all offers, straight from the scores."""
    cvs = cvs.filter(search.searchable("cv_embedding"))
    vectors = search.vector_scores(corpus.filter(search.searchable("embedding")), cvs, cfg).toPandas()
    text = search.text_scores(idx, search.cv_lexemes(cvs, cfg), cfg).select(
        "cv_id", "job_id", F.round("fts_score", 9).alias("fts_score"), F.round("title_score", 9).alias("title_score")).toPandas()
    pairs = vectors.merge(text, on=["cv_id", "job_id"], how="left").fillna(0.0)
    out = []
    for cv, g in pairs.groupby("cv_id"):
        for c, r in (("embedding_score", "er"), ("fts_score", "fr"), ("title_score", "tr")):
            g = g.sort_values([c, "job_id"], ascending=[False, True]).copy()
            g[r] = np.arange(1, len(g) + 1)
        w, k = cfg.weights, cfg.rrf_k
        g["comb"] = w[0] / (k + g.er) + w[1] / (k + g.fr) + w[2] / (k + g.tr)
        g = g.sort_values(["comb", "job_id"], ascending=[False, True]).head(cfg.top_k)
        out += [(cv, i + 1, *x) for i, x in enumerate(zip(g.job_id, g.embedding_score, g.fts_score, g.title_score, g.er, g.fr, g.tr))]
    return sorted(out)


def fixture(spark):
    rng = np.random.default_rng(6)
    words = [f"mot{i}" for i in range(40)]
    offers, corpus = [], []
    for i in range(0, 900, 3):  # keys with gaps
        offers.append((i, " ".join(rng.choice(words[: 10 + i % 20], 2)), " ".join(rng.choice(words, 6)) if i % 4 else "", ""))
        v = rng.integers(-2, 3, 6) / 2 if i % 5 else np.zeros(6)  # many equal vectors: ties by key
        corpus.append((i, [float(x) for x in v]))
    corpus += [(1001, [None] * 6), (1002, None), (1003, [float("nan")] * 6)]
    cvs = [(c, " ".join(rng.choice(words, n)), [float(x) for x in rng.integers(-2, 3, 6) / 2]) for c, n in enumerate([1, 2, 5, 30])]
    cvs += [(10, "nothing known", [0.5] * 6), (11, "", [1.0] * 6), (12, None, [0.0] * 6), (13, "mot1", None)]
    make = spark.createDataFrame
    return (make(corpus, "job_id long, embedding array<float>").repartition(5),
            search.build_index(make(offers, "job_id long, title string, description string, skills string")),
            make(cvs, "cv_id int, cv_text string, cv_embedding array<float>"))


@pytest.mark.parametrize("cfg, per_slice", [
    (search.SearchConfig(top_k=4, hit_block=32, vector_block=16), 3),
    (search.SearchConfig(top_k=100), None),
    (search.SearchConfig(top_k=7, rrf_k=5, weights=(1.0, 2.0, 0.5), metric="cosine", hit_block=100), None),
])
def test_pruned_search_against_brute_force(spark, cfg, per_slice):
    corpus, idx, cvs = fixture(spark)
    got = _rows(rrf.rrf_search(corpus, idx, cvs, cfg, cvs_per_slice=per_slice))
    want = brute(spark, corpus, idx, cvs, cfg)
    assert [r[:3] + r[6:] for r in got] == [r[:3] + r[6:] for r in want]
    assert all(a[3:6] == pytest.approx(b[3:6], abs=2e-9) for a, b in zip(got, want))
    assert {r[0] for r in got} == {0, 1, 2, 3, 10, 11, 12}


def test_counting_before_candidates():
    rng = np.random.default_rng(1)
    scores, ords = rng.integers(0, 6, 300) / 2, rng.permutation(300)
    pick = rng.choice(300, 40, replace=False)
    pick = pick[np.lexsort((ords[pick], -scores[pick]))]
    counts = np.bincount(rrf._before(scores, ords, scores[pick], ords[pick]), minlength=41)
    place = np.argsort(np.lexsort((ords, -scores)))
    assert (np.cumsum(counts[:-1]) == place[pick]).all()


def test_real_tables_and_no_pairs_in_the_plan(spark, sf_small):
    corpus, idx, cvs = catalog.corpus(spark, sf_small), catalog.index(spark, sf_small), catalog.cvs(spark, sf_small)
    cfg = search.SearchConfig(top_k=5)
    df = search.rrf_search(corpus, idx, cvs, cfg)
    assert [r[:3] for r in _rows(df)] == [r[:3] for r in brute(spark, corpus, idx, cvs, cfg)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the only window is the last one, over the candidates of a CV
    assert plan.split("== Initial Plan ==")[0].count("Window [") == 1


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_blocks_of_hits_are_dealt_as_postings(spark, sf_small, size):
    import re

    cfg = search.SearchConfig()
    near = rrf.ordinals(catalog.corpus(spark, sf_small)).select("job_id", "ord")
    idx, queries = catalog.index(spark, sf_small), search.cv_lexemes(catalog.cvs(spark, sf_small), cfg)
    hits = search.text_scores(idx.join(near, "job_id").drop("job_id"), queries, cfg, "ord")
    hits = hits.select("cv_id", "ord", F.round("fts_score", 9).alias("fts_score"), F.round("title_score", 9).alias("title_score"))
    want = rrf.hit_blocks(hits.where("fts_score > 0 or title_score > 0"), size)
    terms = search.batch_terms(queries, cfg)
    found = search.matched_postings(idx, queries, cfg).join(terms.of, "lexeme").join(near, "job_id").select("ord", "term", "title_len", "w_f", "w_t")
    got = rrf.scored_blocks(found, terms, size)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not re.search(r"hashpartitioning\(cv_id", plan)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and got.select(F.sum(F.size("ords"))).first()[0] == hits.where("fts_score > 0 or title_score > 0").count()


def test_a_worker_is_given_bounded_batches_of_wide_rows(spark):
    """A CV has a row for each block of the corpus: what a worker holds at a time does not grow with them."""
    wide = spark.range(400).select(F.col("id").alias("cv_id"), F.array_repeat(F.col("id"), 8_000).alias("ords")).coalesce(1)  # 64 KB a row

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "rows"])

    got = rrf._in_tasks(wide, sizes, "size long, rows long").collect()
    assert sum(r.rows for r in got) == 400 and max(r.size for r in got) < 2 * rrf.BATCH_BYTES
    kept = rrf._merged(wide, lambda t: t.slice(0, 1), "cv_id long, ords array<long>").count()
    assert kept == 400


def test_matrix_blocks_have_at_most_their_rows():
    vectors = pa.array([[float(i), 1.0] for i in range(1000)], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), vectors], names=["ord", "embedding"])
    blocks = list(rrf._matrix_blocks(iter([batch, batch.slice(0, 0), batch.slice(10, 100)]), 64))
    ords = [np.frombuffer(b.column("ords")[0].as_py(), "<i8") for b in blocks]
    assert max(map(len, ords)) == 64 and np.concatenate(ords).tolist() == [*range(1000), *range(10, 110)]
    assert all(np.frombuffer(b.column("vectors")[0].as_py(), "<f8").reshape(-1, 2)[:, 0].tolist() == o.tolist() for b, o in zip(blocks, ords))
