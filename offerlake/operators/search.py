"""Hybrid CV -> offer search: vector score, weighted full-text score, title score, Reciprocal Rank Fusion.

Shape of the plan for a batch of CVs against the whole corpus:

* text index: one row per (offer, lexeme) with the number of occurrences per field. The text score of
  a lexeme depends only on those counts, so the index is a plain aggregate (map-side combined).
* text scores: the CV lexemes (small, size-checked broadcast) join the index on ``lexeme``; the postings
  that match are dealt by offer and summed there for every CV - sparse, only offers that share a word with the CV.
* vector scores: every offer against every CV, computed in NumPy blocks inside ``mapInPandas`` with
  the CV matrix shipped once per executor (size-checked), no cross join.
* ranks and fusion: only offers within the first M of some list can reach the top K (M = 208 for K = 100,
  k = 60, weights 1/1/3); ``operators/rrf.py`` ranks those, exactly, without a row for a pair of CV and offer.
* late materialisation: only the top K rows are joined back to the wide offer table.

Text score (``ts_rank`` of an OR query): per matched distinct query lexeme with occurrences of weights
w_1..w_n in position order, ``(Σ w_j / j² + w_max - w_max / j_max²) / 1.64493406685`` (j_max: first
occurrence of the largest weight); summed over lexemes and divided by the number of distinct query
lexemes. The title score uses default weights (all title words unlabelled, weight 0.1) and is further
divided by the number of words of the title.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions import text as tx
from offerlake.functions.text import START_SEL, STOP_SEL  # by value: a worker has no module of this package
from offerlake.functions.stemming import stem_vocabulary
from offerlake.operators.encode import encode

from offerlake.session import scratch_path, ship_by_value

# The functions of this module that run in Python workers travel with the task (no install on executors).
ship_by_value(__name__)

# Fixed values of the ranking, as in the reference.
TOP_K = 100
RRF_K = 60
TITLE_WEIGHT = 3.0
# Limit of Σ 1/j² (π²/6) used by the text score.
ZETA2 = 1.64493406685
# Weights per field label for the offer text score; title A, description B, skills C.
FTS_WEIGHTS = {"A": 1.0, "B": 0.6, "C": 0.3}
# The default weight of unlabelled words, used by the title score.
DEFAULT_WEIGHT_D = 0.1
SCORE_DIGITS = 9
# Characters of offer text that a task indexes at most, beyond the shuffle partitions of the session.
CHARS_PER_TASK = 32_000_000
_H2_FIRST = list(accumulate((1.0 / (float(j) * float(j)) for j in range(1, 256)), initial=0.0))


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = TOP_K
    rrf_k: int = RRF_K
    weights: tuple[float, float, float] = (1.0, 1.0, TITLE_WEIGHT)  # embedding, text, title
    field_weights: dict = field(default_factory=lambda: dict(FTS_WEIGHTS))
    title_weight_d: float = DEFAULT_WEIGHT_D
    metric: str = "l2"  # or "cosine"
    broadcast_rows: int = 2_000_000  # size check for shipping CV lexemes / vectors
    hit_block: int = 65_536  # ordinals in a block of a CV's text hits
    vector_block: int = 4_096  # offers scored in one matrix product
    index_buckets: int = 64  # lexeme hash buckets of an index stored with write_index
    stem: bool = False  # French stems, on both sides (build_index(stem=True))
    keep_symbols: bool = False  # c++, c# as words, on both sides (build_index(keep_symbols=True))

    @property
    def score_max(self) -> float:
        """Largest possible fused score: rank 1 in every list."""
        return sum(self.weights) / (self.rrf_k + 1)

    @property
    def candidate_depth(self) -> int:
        """M such that an offer ranked below M in every list cannot reach the top K.

        The K best offers of the heaviest list each score more than w_max / (k + K); an offer with all
        ranks > M scores at most W / (k + M + 1), which is smaller once M >= ceil(W (k + K) / w_max) - k + 1.
        """
        w, k, big_k = sum(self.weights), self.rrf_k, self.top_k
        return max(big_k, math.ceil(w * (k + big_k) / max(self.weights)) - k + 1)


# ----------------------------------------------------------------------------------------------
# text index


def build_index(offers: DataFrame, key: str = "job_id", fields: Sequence[tuple[str, str]] = (
        ("title", "A"), ("description", "B"), ("skills", "C")), title_col: str = "title", stem: bool = False,
                keep_symbols: bool = False, stopwords: Sequence[str] = (), broadcast_rows: int = 2_000_000) -> DataFrame:
    """Posting rows ``(key, lexeme, n_a, n_b, n_c, title_len, w_f, w_t)``: occurrences of the lexeme per
    field label, the number of title words, and the lexeme's text and title weights under the default
    field weights (query-independent, so computed once here instead of once per query hit).
    Fields missing from ``offers`` are skipped. With ``stem`` the lexemes are French stems (looked up in the distinct
    vocabulary); ``stopwords`` are left out of the postings; a CV is read with the same options."""
    present = [(c, lab) for c, lab in fields if c in offers.columns]
    offers = offers.filter(F.col(key).isNotNull())  # no search finds an offer without a key
    # All words of an offer are counted in one task: its texts are shuffled once, its words and postings are not.
    chars = offers.select(F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)).cast("long") for c, _ in present), F.lit(0).cast("long")))).first()[0] or 0
    tasks = max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_PER_TASK))
    texts = offers.select(key, *dict.fromkeys(c for c, _ in present)).repartition(tasks, key)
    per_field = texts.select(key, F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(c).cast("string").alias("text")) for c, lab in present])).alias("f"))
    words = per_field.select(key, "f.label", F.explode(tx.tokens("f.text", keep_symbols)).alias("lexeme"))
    counts = words.groupBy(key, "lexeme").agg(
        *[F.count_if(F.col("label") == lab).cast("int").alias(f"n_{lab.lower()}") for lab in "ABC"])
    if stopwords:
        counts = counts.filter(~F.col("lexeme").isin(list(stopwords)))
    if stem:
        stemmed = _with_stems(counts, words.select("lexeme"), broadcast_rows)
        counts = stemmed.groupBy(key, "lexeme").agg(*[F.sum(c).cast("int").alias(c) for c in ("n_a", "n_b", "n_c")])
    # The title length is joined back per offer; computing it next to the explode would evaluate it
    # once per exploded word (measured: 6x slower).
    title_len = (offers.select(key, F.size(tx.tokens(F.col(title_col), keep_symbols)).alias("title_len"))
                 if title_col in offers.columns else offers.select(key, F.lit(0).alias("title_len")))
    # One number for each offer: its side is hashed, the postings are not sorted.
    counts = counts.join(title_len.hint("shuffle_hash"), key)
    return counts.select(
        key, "lexeme", "n_a", "n_b", "n_c", "title_len",
        lexeme_weight(F.col("n_a"), F.col("n_b"), F.col("n_c"), FTS_WEIGHTS).alias("w_f"),
        title_weight(F.col("n_a"), DEFAULT_WEIGHT_D).alias("w_t"))


def _with_stems(rows: DataFrame, words: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` with ``lexeme`` replaced by its stem. The vocabulary is written once; it is broadcast only if it is small."""
    spark = rows.sparkSession
    path = scratch_path(spark, "stems")
    stem_vocabulary(words).write.parquet(path)
    stems = spark.read.schema("lexeme string, stem string").parquet(path)
    stems = _maybe_broadcast(stems, stems.count(), broadcast_rows)
    return rows.join(stems, "lexeme").drop("lexeme").withColumnRenamed("stem", "lexeme")


def lexeme_bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = SearchConfig.index_buckets, key: str = "job_id") -> None:
    """Store a posting index partitioned by a hash bucket of the lexeme and sorted by lexeme inside each file, so a search
    reads only the buckets of its own lexemes (partition pruning) and Parquet statistics narrow the row groups further.
    Tasks write ranges of (bucket, lexeme, key) of about equal size (``index_store``)."""
    from offerlake.operators.index_store import by_lexeme_range

    by_lexeme_range(index, buckets, key).write.partitionBy("n_buckets", "bucket").parquet(path)


def append_index(new_offers: DataFrame, path: str, key: str = "job_id", buckets: int = SearchConfig.index_buckets, **options) -> None:
    """Add the postings of offers not indexed yet to an index stored by ``write_index`` (insert-only, like silver). ``options``
    are those of ``build_index``; ``index_store`` keeps them, the indexed offers and deletes as well."""
    from offerlake.operators.index_store import by_lexeme_range
    from offerlake.sources.folders import path_exists

    spark = new_offers.sparkSession
    if path_exists(spark, path):
        done = spark.read.parquet(path).select(key).distinct()
        new_offers = new_offers.join(done, key, "left_anti")
    made = scratch_path(spark, "new-postings")
    build_index(new_offers, key, **options).write.parquet(made)
    by_lexeme_range(spark.read.parquet(made), buckets, key).write.mode("append").partitionBy("n_buckets", "bucket").parquet(path)


def _h2(n: Column) -> Column:
    """Σ_{j=1..n} 1/j² (0 for n = 0). The first sums are looked up; they are added up in the same order."""
    summed = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
                         lambda acc, j: acc + F.lit(1.0) / (j.cast("double") * j.cast("double"))) * (n > 0).cast("double")
    return F.when((n >= 0) & (n < len(_H2_FIRST)), F.get(F.lit(_H2_FIRST), n)).otherwise(summed)


def lexeme_weight(n_a: Column, n_b: Column, n_c: Column, w: dict) -> Column:
    """Contribution of one matched lexeme, occurrences ordered title (A), description (B), skills (C)."""
    wa, wb, wc = float(w["A"]), float(w["B"]), float(w["C"])
    ha, hab, habc = _h2(n_a), _h2(n_a + n_b), _h2(n_a + n_b + n_c)
    total = F.lit(wa) * ha + F.lit(wb) * (hab - ha) + F.lit(wc) * (habc - hab)
    # first occurrence of the largest weight present
    cands = [(wa, n_a > 0, F.lit(1)), (wb, n_b > 0, n_a + 1), (wc, n_c > 0, n_a + n_b + 1)]
    order = sorted(range(3), key=lambda i: (-cands[i][0], i))
    wmax = F.lit(None).cast("double")
    jmax = F.lit(None).cast("int")
    for i in reversed(order):
        wi, present, first = cands[i]
        wmax = F.when(present, F.lit(wi)).otherwise(wmax)
        jmax = F.when(present, first).otherwise(jmax)
    fix = wmax - wmax / (jmax.cast("double") * jmax.cast("double"))
    return (total + F.coalesce(fix, F.lit(0.0))) / F.lit(ZETA2)


def title_weight(n_a: Column, wd: float) -> Column:
    return F.lit(wd) * _h2(n_a) / F.lit(ZETA2)


def cv_lexemes(cvs: DataFrame, cfg: SearchConfig, text_col: str = "cv_text") -> DataFrame:
    """``(cv_id, terms, n_terms)``: distinct lexemes of the cleaned CV text."""
    terms = cvs.select("cv_id", tx.query_lexemes(tx.fts_terms(F.col(text_col)), cfg.keep_symbols).alias("terms"))
    if cfg.stem:
        words = terms.select("cv_id", F.explode("terms").alias("lexeme"))
        stems = _with_stems(words, words, cfg.broadcast_rows).groupBy("cv_id").agg(F.array_sort(F.collect_set("lexeme")).alias("terms"))
        terms = (terms.select("cv_id").join(stems, "cv_id", "left")
                 .withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))))
    return terms.withColumn("n_terms", F.size("terms"))


def _maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def matched_postings(index: DataFrame, queries: DataFrame, cfg: SearchConfig, key: str = "job_id") -> DataFrame:
    """``index`` with the weights ``w_f`` and ``w_t`` of ``cfg``; of a bucketed index only the buckets of the CV lexemes."""
    if "bucket" in index.columns:
        # The count that each part of the index was written with is stored beside it, so parts with different counts
        # are pruned alike.
        if "n_buckets" in index.columns:
            lexemes = queries.select(F.explode("terms").alias("lexeme"))
            keep = F.lit(False)
            for (n,) in index.select("n_buckets").distinct().collect():  # partition values only
                wanted = [r[0] for r in lexemes.select(lexeme_bucket(F.col("lexeme"), n)).distinct().collect()]  # at most n values
                keep = keep | ((F.col("n_buckets") == n) & F.col("bucket").isin(wanted))
            index = index.filter(keep).drop("n_buckets")
        index = index.drop("bucket")
    stored = dict(cfg.field_weights) == FTS_WEIGHTS and cfg.title_weight_d == DEFAULT_WEIGHT_D and "w_f" in index.columns
    w_f = F.col("w_f") if stored else lexeme_weight(F.col("n_a"), F.col("n_b"), F.col("n_c"), cfg.field_weights)
    w_t = F.col("w_t") if stored else title_weight(F.col("n_a"), cfg.title_weight_d)
    return index.select(key, "lexeme", "title_len", w_f.alias("w_f"), w_t.alias("w_t"))


@dataclass(frozen=True)
class Terms:
    """The lexemes of a CV batch: ``of`` names each lexeme's number; ``cvs[starts[t]:starts[t + 1]]`` are the places of the CVs
    that have lexeme ``t``, ``cv_ids`` and ``n_terms`` the CVs."""
    of: DataFrame
    starts: np.ndarray
    cvs: np.ndarray
    cv_ids: pa.Array
    n_terms: np.ndarray


def batch_terms(queries: DataFrame, cfg: SearchConfig) -> Terms | None:
    """The lexemes of the CVs, shipped like their vectors after a size check; None for a larger batch."""
    if (queries.select(F.sum("n_terms")).first()[0] or 0) > cfg.broadcast_rows:
        return None
    rows = queries.select("cv_id", "n_terms", F.explode("terms").alias("lexeme")).toArrow()  # bounded by the check
    lexeme, cv = rows.column("lexeme").combine_chunks().dictionary_encode(), rows.column("cv_id").combine_chunks().dictionary_encode("encode")
    term, place = lexeme.indices.to_numpy(), cv.indices.to_numpy()
    order = np.lexsort((place, term))
    n_terms = np.ones(len(cv.dictionary), dtype=np.int64)
    n_terms[place] = rows.column("n_terms").to_numpy()
    starts = np.searchsorted(term[order], np.arange(len(lexeme.dictionary) + 1))
    names = queries.sparkSession.createDataFrame(
        pa.table({"lexeme": lexeme.dictionary.cast(pa.string()), "term": pa.array(np.arange(len(lexeme.dictionary), dtype=np.int32))}))
    return Terms(names, starts, place[order].astype(np.int64), cv.dictionary, n_terms)


# (CV, posting) pairs that a task adds up at a time
PAIRS_AT_ONCE = 2_000_000


def _offer_starts(keys: pa.Array) -> np.ndarray:
    """Where the rows of each offer begin; the rows of an offer lie together."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=np.int64)
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _add_up(rows: pa.Table, key: str, starts: np.ndarray, cvs: np.ndarray, n_terms: np.ndarray):
    """``(row of the offer, CV, text score, title score)`` of whole offers, by offer and CV, some offers at a time."""
    term, w_f, w_t, title_len = (rows.column(c).to_numpy() for c in ("term", "w_f", "w_t", "title_len"))
    first = _offer_starts(rows.column(key).combine_chunks())
    n_cvs, fan = len(n_terms), starts[term + 1] - starts[term]
    upto = np.concatenate([[0], np.cumsum(fan)])
    bounds = np.append(first, len(term))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(upto[bounds], upto[bounds[at]] + PAIRS_AT_ONCE, side="right")) - 1)
        a, b = bounds[at], bounds[to]
        of = np.repeat(np.arange(a, b), fan[a:b])
        cv = cvs[np.arange(upto[b] - upto[a]) - (upto[of] - upto[a]) + starts[term[of]]]
        offer = np.repeat(np.arange(to - at), np.diff(bounds[at:to + 1]))
        cell = offer[of - a] * n_cvs + cv
        size = (to - at) * n_cvs
        if size > 4 * len(cell) + 65_536:  # few of the cells are met
            met, cell = np.unique(cell, return_inverse=True)
            size = len(met)
        else:
            met = None
        hit = np.flatnonzero(np.bincount(cell, minlength=size))
        f, t = (np.bincount(cell, weights=w[of], minlength=size)[hit] for w in (w_f, w_t))
        where = hit if met is None else met[hit]
        row, cv = first[at + where // n_cvs], where % n_cvs
        length = title_len[row]
        yield row, cv, f / n_terms[cv], np.where(length > 0, t / n_terms[cv] / np.maximum(length, 1), 0.0)
        at = to


def _whole_offers(batches, key: str):
    """The batches cut where an offer ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        last = int(_offer_starts(rows.column(key).combine_chunks())[-1])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None:
        yield held


def text_scores(index: DataFrame, queries: DataFrame, cfg: SearchConfig, key: str = "job_id") -> DataFrame:
    """Sparse ``(cv_id, key, fts_score, title_score)`` for offers sharing at least one lexeme with the CV.

    The postings with a lexeme of the batch are dealt by offer, and the scores of an offer for all CVs are added up in the
    task that has it: a posting is shuffled once, not once for each CV that has its lexeme."""
    hits, terms = matched_postings(index, queries, cfg, key), batch_terms(queries, cfg)
    if terms is None:  # a large batch is joined row by row
        per = hits.join(queries.select("cv_id", "n_terms", F.explode("terms").alias("lexeme")), "lexeme")
        return per.groupBy("cv_id", key).agg(
            (F.sum("w_f") / F.first("n_terms")).alias("fts_score"),
            F.when(F.first("title_len") > 0, F.sum("w_t") / F.first("n_terms") / F.first("title_len"))
            .otherwise(F.lit(0.0)).alias("title_score"),
        )
    starts, cvs, cv_ids, n_terms = terms.starts, terms.cvs, terms.cv_ids, terms.n_terms

    def run(batches):
        for rows in _whole_offers(batches, key):
            keys = rows.column(key).combine_chunks()
            for row, cv, fts, title in _add_up(rows, key, starts, cvs, n_terms):
                yield pa.RecordBatch.from_arrays([cv_ids.take(pa.array(cv)), keys.take(pa.array(row)), pa.array(fts), pa.array(title)],
                                                 names=["cv_id", key, "fts_score", "title_score"])

    schema = T.StructType([T.StructField("cv_id", queries.schema["cv_id"].dataType), T.StructField(key, index.schema[key].dataType),
                           T.StructField("fts_score", T.DoubleType()), T.StructField("title_score", T.DoubleType())])
    mine = hits.join(F.broadcast(terms.of), "lexeme").select(key, "term", "title_len", "w_f", "w_t")
    return mine.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


# ----------------------------------------------------------------------------------------------
# vector scores


def _score_matrix(mat: np.ndarray, cv_mat: np.ndarray, metric: str) -> np.ndarray:
    """(offers x CVs) scores: ``1 - L2`` or cosine, by one matrix product. Where a squared distance is small
    beside the norms its digits cancel in the product, so those pairs are taken from element-wise differences."""
    if metric == "cosine":
        n = np.linalg.norm(mat, axis=1, keepdims=True)
        c = np.linalg.norm(cv_mat, axis=1, keepdims=True)
        mat, cv_mat = mat / np.where(n == 0, 1.0, n), cv_mat / np.where(c == 0, 1.0, c)
        scores = mat @ cv_mat.T
        scaled = scores * 10.0 ** SCORE_DIGITS
        for o, c in _pieces(np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)):
            scores[o, c] = np.einsum("ij,ij->i", mat[o], cv_mat[c])
        return scores
    norms = np.einsum("ij,ij->i", mat, mat)[:, None] + np.einsum("ij,ij->i", cv_mat, cv_mat)[None, :]
    squared = norms - 2.0 * (mat @ cv_mat.T)
    for o, c in _pieces(np.nonzero(squared < 1e-4 * norms)):
        diff = mat[o] - cv_mat[c]
        squared[o, c] = np.einsum("ij,ij->i", diff, diff)
    scores = 1.0 - np.sqrt(np.maximum(squared, 0.0))
    # scores are rounded later: those next to a rounding edge get their last digits from differences as well
    scaled = scores * 10.0 ** SCORE_DIGITS
    for o, c in _pieces(np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)):
        diff = mat[o] - cv_mat[c]
        scores[o, c] = 1.0 - np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return scores


def _pieces(places: tuple[np.ndarray, np.ndarray], size: int = 65536):
    for s in range(0, len(places[0]), size):
        yield places[0][s:s + size], places[1][s:s + size]


def _batch_matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"].to_numpy()])


def _vector_block_fn(cv_ids: np.ndarray, cv_mat: np.ndarray, key: str, metric: str):
    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[key].to_numpy()
            sc = round_half_up(_score_matrix(_batch_matrix(pdf), cv_mat, metric).ravel())
            yield pd.DataFrame({"cv_id": np.tile(cv_ids, len(ids)), key: np.repeat(ids, len(cv_ids)),
                                "embedding_score": sc})

    return score


def _cv_slices(cvs: DataFrame, cfg: SearchConfig, cv_vector_col: str):
    """The CV matrix in slices of at most ``cfg.broadcast_rows`` values (size checked first)."""
    stats = cvs.select(F.count("*").alias("n"), F.max(F.size(cv_vector_col)).alias("d")).first()
    n_cv, dim = int(stats["n"] or 0), int(stats["d"] or 0)
    per_slice = max(1, min(max(n_cv, 1), cfg.broadcast_rows // max(dim, 1)))
    ordered = cvs.filter(F.col(cv_vector_col).isNotNull()).select(F.col("cv_id").cast("long"), cv_vector_col)
    out = []
    for start in range(0, n_cv, per_slice):
        rows = ordered.orderBy("cv_id").offset(start).limit(per_slice).collect()  # bounded by the check
        if not rows:
            break
        out.append((np.array([r[0] for r in rows], dtype=np.int64),
                    np.array([list(r[1]) for r in rows], dtype=np.float64)))
    return out


def vector_scores(vectors: DataFrame, cvs: DataFrame, cfg: SearchConfig, key: str = "job_id",
                  cv_vector_col: str = "cv_embedding") -> DataFrame:
    """``(cv_id, key, embedding_score)`` for every CV and every offer: ``1 - L2`` (or cosine), rounded to 9 places.

    The CV batch is the only side shipped whole; its size is checked first and larger batches are
    scored in slices of CVs (each slice a separate broadcast), so nothing beyond the bound is shipped.
    """
    key_type = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("cv_id", T.LongType()), T.StructField(key, key_type),
                           T.StructField("embedding_score", T.DoubleType())])
    vecs = vectors.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    parts = [vecs.mapInPandas(_vector_block_fn(ids, mat, key, cfg.metric), schema)
             for ids, mat in _cv_slices(cvs, cfg, cv_vector_col)]
    if not parts:
        return vecs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def round_half_up(x: np.ndarray, digits: int = SCORE_DIGITS) -> np.ndarray:
    """Spark's ``round`` in NumPy: half-up on the shortest decimal text of each double. ``np.round`` is
    half-even on the binary product, so values close to a half are redone with ``decimal``."""
    from decimal import ROUND_HALF_UP, Decimal

    scaled = x * (10.0 ** digits)
    out = np.round(scaled) / (10.0 ** digits)
    frac = np.abs(scaled - np.floor(scaled) - 0.5)
    near = np.nonzero(np.isfinite(x) & (frac < 1e-6))[0]
    q = Decimal(1).scaleb(-digits)
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(q, rounding=ROUND_HALF_UP))
    return out


def _topk_block_fn(cv_ids: np.ndarray, cv_mat: np.ndarray, key: str, metric: str, k: int):
    def topk(batches):
        best_ids: list = [None] * len(cv_ids)
        best_sc: list = [None] * len(cv_ids)
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[key].to_numpy()
            sc = _score_matrix(_batch_matrix(pdf), cv_mat, metric)
            sc = round_half_up(sc.ravel()).reshape(sc.shape)
            for j in range(len(cv_ids)):
                cand_ids = ids if best_ids[j] is None else np.concatenate([best_ids[j], ids])
                cand_sc = sc[:, j] if best_sc[j] is None else np.concatenate([best_sc[j], sc[:, j]])
                keep = np.lexsort((cand_ids, -cand_sc))[:k]  # score descending, key ascending
                best_ids[j], best_sc[j] = cand_ids[keep], cand_sc[keep]
        if best_ids[0] is not None:
            yield pd.DataFrame({"cv_id": np.concatenate([np.full(len(b), c) for c, b in zip(cv_ids, best_ids)]),
                                key: np.concatenate(best_ids), "embedding_score": np.concatenate(best_sc)})

    return topk


def vector_topk(vectors: DataFrame, cvs: DataFrame, cfg: SearchConfig, key: str = "job_id",
                cv_vector_col: str = "cv_embedding") -> DataFrame:
    """Exact k nearest offers per CV (``cfg.top_k``) by ``1 - L2`` (or cosine), scores rounded to 9 places,
    ties by key: ``(cv_id, key, score, rank)``.

    Each partition keeps a running top k per CV while it scores its offers, so only partitions x CVs x k
    rows leave the Python stage (not CVs x offers); a window over at most partitions x k rows per CV
    then picks the global top k.
    """
    key_type = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("cv_id", T.LongType()), T.StructField(key, key_type),
                           T.StructField("embedding_score", T.DoubleType())])
    vecs = vectors.filter(searchable("embedding")).select(key, "embedding")
    parts = [vecs.mapInPandas(_topk_block_fn(ids, mat, key, cfg.metric, cfg.top_k), schema)
             for ids, mat in _cv_slices(cvs, cfg, cv_vector_col)]
    if not parts:
        return vecs.sparkSession.createDataFrame([], schema).select(
            "cv_id", key, F.col("embedding_score").alias("score"), F.lit(0).cast("long").alias("rank"))
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    w = Window.partitionBy("cv_id").orderBy(F.col("embedding_score").desc(), F.col(key).asc())
    ranked = local.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= cfg.top_k)
    return ranked.select("cv_id", key, F.col("embedding_score").alias("score"), "rank")


# ----------------------------------------------------------------------------------------------
# fusion


def searchable(embedding: str) -> Column:
    """Vectors that have a distance: present and without null or NaN elements. Offers with any other vector are
    not part of a search, whichever way it runs."""
    v = F.col(embedding)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def rrf_search(corpus: DataFrame, index: DataFrame, cvs: DataFrame, cfg: SearchConfig | None = None,
               key: str = "job_id") -> DataFrame:
    """``(cv_id, rank, key, embedding_score, fts_score, title_score, combined_score, embed_rank, fts_rank,
    title_rank)`` - the top K offers per CV (``operators/rrf.py``). ``corpus`` has ``key`` and ``embedding``; ``cvs``
    has ``cv_id``, ``cv_text`` and ``cv_embedding``."""
    from offerlake.operators import rrf

    return rrf.rrf_search(corpus, index, cvs, cfg, key)


def encode_cvs(cvs: DataFrame, dim: int = 384, encoder_factory=None, text_col: str = "cv_text") -> DataFrame:
    """The CVs with the vector of their whole text (``cv_embedding``), by the encoder that made the offers' vectors."""
    vectors = encode(cvs, "cv_id", text_col, dim=dim, encoder_factory=encoder_factory, vector_col="cv_embedding")
    return cvs.join(vectors, "cv_id")


def hybrid_search(corpus: DataFrame, index: DataFrame, cvs: DataFrame, cfg: SearchConfig | None = None,
                  key: str = "job_id", dim: int = 384, encoder_factory=None) -> DataFrame:
    """Search from CV text alone: ``cvs(cv_id, cv_text)`` against ``corpus(key, embedding)``. The encoder and its
    ``dim`` must be those of the corpus; rows as in ``rrf_search``."""
    from offerlake.operators import rrf

    # written once: the corpus is read several times, and is often encoded on the way
    corpus = rrf._stored(corpus.select(key, "embedding"), "encoded")
    return rrf_search(corpus, index, encode_cvs(cvs.select("cv_id", "cv_text"), dim, encoder_factory), cfg, key)


# ----------------------------------------------------------------------------------------------
# result rows


def matching_terms(doc_text: Column, terms: Column, limit: int = 10) -> Column:
    """Query lexemes found in the offer text, in order of first appearance, longer than two letters,
    first ``limit`` - computed over the whole text."""
    found = F.array_intersect(tx.tokens(doc_text), terms)
    return F.slice(F.filter(found, lambda t: F.length(t) > 2), 1, limit)


_PIECES = re.compile(r"\w+|\W+")


def best_fragment(words: list[str], terms: set[str], max_words: int) -> int | None:
    """Where to start: of the windows of ``max_words`` words that begin with a hit, the first that covers the most distinct
    lexemes. One pass with two ends; None without a hit. ``words`` are lower-cased."""
    found: dict[str, tuple] = {}
    hits = []
    for i, word in enumerate(words):
        held = found.get(word)
        if held is None:
            held = found[word] = tuple(p for p in _PIECES.findall(word) if p in terms)
        hits.extend([(i, p) for p in held])
    inside: dict[str, int] = {}
    best, at, end = 0, None, 0
    for i, lexeme in hits:
        while end < len(hits) and hits[end][0] < i + max_words:
            inside[hits[end][1]] = inside.get(hits[end][1], 0) + 1
            end += 1
        if len(inside) > best:
            best, at = len(inside), i
        inside[lexeme] -= 1
        if not inside[lexeme]:
            del inside[lexeme]
    return at


def _fragments(batches, text_col: str, terms_col: str, name: str, max_words: int, min_words: int):
    import pyarrow as pa

    def mark(word: str, terms: set[str]) -> str:
        return "".join([f"{START_SEL}{p}{STOP_SEL}" if p.lower() in terms else p for p in _PIECES.findall(word)])

    for batch in batches:
        out = []
        for text, listed in zip(batch.column(text_col).to_pylist(), batch.column(terms_col).to_pylist()):
            words, terms = (text or "").split(), set(listed or ())
            at = best_fragment((text or "").lower().split(), terms, max_words)
            out.append(" ".join(words[:min_words] if at is None else [mark(w, terms) for w in words[at:at + max_words]]))
        names = [n for n in batch.schema.names if n not in (text_col, terms_col)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.string())], names=[*names, name])


def headline(df: DataFrame, text_col: str, terms_col: str, name: str = "headline", max_words: int = 100,
             min_words: int = 50) -> DataFrame:
    """Replace the text and the terms by a snippet with the matched lexemes marked ``<b>..</b>``: the ``max_words`` words
    (split on whitespace) that cover the most distinct lexemes, the first such window beginning with a hit; without a match
    the first ``min_words`` words. Markers that the text itself holds are words like any other.

    The best window needs two ends moving over the hits, which no column expression does in one pass; it is found in Arrow
    batches in time linear in the text. Only the top rows come here."""
    rest = [f for f in df.schema.fields if f.name not in (text_col, terms_col)]
    schema = T.StructType([*rest, T.StructField(name, T.StringType())])
    return df.mapInArrow(lambda it: _fragments(it, text_col, terms_col, name, max_words, min_words), schema)


def shipped(top: DataFrame, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The top rows with the terms of their CV, broadcast if they are few: the offers' texts stay where they are."""
    return _maybe_broadcast(top.join(queries.select("cv_id", "terms"), "cv_id"), queries.count() * cfg.top_k, cfg.broadcast_rows)


def result_rows(top: DataFrame, offers: DataFrame, queries: DataFrame, cfg: SearchConfig, key: str = "job_id",
                text_col: str = "search_text") -> DataFrame:
    """Result contract: scores scaled and rounded, display fields never null, matched terms.

    ``offers`` supplies ``intitule, entreprise, lieu, type_contrat, date_creation`` and ``text_col``;
    only the top K rows are joined to it (late materialisation).
    """
    joined = offers.join(shipped(top, queries, cfg), key)
    sim = tx.linear_map(F.col("combined_score"), 0.0, cfg.score_max, 0.0, 1.0)
    return joined.select(
        "cv_id", "rank", F.col(key).cast("string").alias("job_id"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim)), 2).alias("similarity_score"),
        F.round("embedding_score", 4).alias("embedding_score"),
        F.round("fts_score", 4).alias("fts_score"),
        F.round("combined_score", 4).alias("combined_score"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
          for c in ("intitule", "entreprise", "lieu", "type_contrat", "date_creation")],
        matching_terms(F.col(text_col), F.col("terms")).alias("matching_terms"),
    )


# Result contract: non-null display strings, similarity within [0, 1], a list of matched terms.
RESULT_FIELDS = ("job_id", "intitule", "entreprise", "lieu", "type_contrat", "date_creation")


def check_results(results: DataFrame, name: str = "result_contract") -> tuple[DataFrame, Observation]:
    """Attach contract counters to ``results``; they fill in when the rows are produced (no extra job)."""
    obs = Observation(name)
    checked = results.observe(
        obs,
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("similarity_score") < 0) | (F.col("similarity_score") > 1)).alias("score_out_of_range"),
        F.count_if(F.greatest(*[F.col(c).isNull() for c in RESULT_FIELDS])).alias("null_fields"),
        F.count_if(F.col("matching_terms").isNull()).alias("null_terms"),
        F.count_if(F.col("fts_score") > 0).alias("text_hits"),
    )
    return checked, obs
