"""Toxicity: bags of subwords, averaged embeddings, linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and of the word itself, so an unseen misspelling shares most
of its vectors with the word it disguises. A text is covered by consecutive windows of a few words; a window is
the average of its words' vectors and the softmax scores it. The text takes the score of its worst window, so
one abusive line in a long text counts as much as in a short one. Training follows the same rule: a text's loss
falls on its windows, weighted towards the worst.

The classifier is fitted on the whole texts of a bounded sample of labelled rows (``Config.max_toxic``,
``max_clean``); every whole text is scored. Null or empty texts (no word) score the bias alone, as a text
of unknown words does. Rows with a null id or a null label are not learned from; an id with several labels is
toxic if one of them says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import char_grams, crc_mod, give_back, table

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 250_000


@dataclass(frozen=True)
class Config:
    window: int = 2
    buckets: int = 1 << 16
    dim: int = 8
    min_n: int = 3
    max_n: int = 5
    max_toxic: int = 1500  # labelled rows of the training sample, by class
    max_clean: int = 2500
    epochs: int = 90
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    config: Config
    vectors: np.ndarray  # buckets x dim
    softmax: np.ndarray  # 2 x dim
    bias: float

    def margins(self) -> np.ndarray:
        """What each subword adds to the log odds of class 1."""
        return (self.vectors @ (self.softmax[1] - self.softmax[0])).astype(np.float64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def subwords(found: list[str], cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the given words, and the index of the word that each belongs to."""
    return char_grams(found, range(cfg.min_n, cfg.max_n + 1), range(0), cfg.buckets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, cfg: Config, folds: int = 5) -> pd.DataFrame:
    """Bounded labelled sample: per class the rows with the smallest id hash, at most the configured number."""
    marked = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
              .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (crc_mod("_id", folds) != 0))
              .groupBy("_id").agg(F.max("_y").alias("_y")))
    order = F.xxhash64("_id", F.lit(cfg.seed))
    picked = (marked.where("_y = 1").orderBy(order, "_id").limit(cfg.max_toxic)
              .union(marked.where("_y = 0").orderBy(order, "_id").limit(cfg.max_clean)))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    # picked holds max_toxic + max_clean rows of two numbers at most
    return texts.join(F.broadcast(picked), "_id").orderBy("_id").select("_id", "_text", "_y").toPandas()


def fit(texts: list[str], marks: list[int], cfg: Config = Config()) -> Model:
    """Train vectors and softmax together with Adam on all windows of the sample."""
    index: dict[str, int] = {}
    word_ids: list[np.ndarray] = []
    window_len: list[np.ndarray] = []
    per_text: list[int] = []
    for text in texts:
        found = words(text)
        parts = [found[i : i + cfg.window] for i in range(0, len(found), cfg.window)]
        ids = []
        for part in parts:
            for w in part:
                k = index.get(w)
                if k is None:
                    k = index[w] = len(index)
                ids.append(k)
        word_ids.append(np.array(ids, dtype=np.int32))
        window_len.append(np.array([len(p) for p in parts], dtype=np.int64))
        per_text.append(len(parts))
    rng = np.random.default_rng(cfg.seed)
    vectors = rng.normal(0, 0.1, (cfg.buckets, cfg.dim)).astype(np.float64)
    softmax = rng.normal(0, 0.1, (2, cfg.dim)).astype(np.float64)
    y = np.array([m for m, n in zip(marks, per_text) if n], dtype=np.float64)
    n_win = np.array([n for n in per_text if n], dtype=np.int64)
    if not len(y) or len(set(y.tolist())) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(cfg, vectors * 0, softmax, float(np.log(rate / (1 - rate))))
    listed = list(index)
    parts = [(g.astype(np.int32), (w + at).astype(np.int32)) for at in range(0, len(listed), 20_000) for g, w in [subwords(listed[at : at + 20_000], cfg)]]
    grams, gram_word = np.concatenate([g for g, _ in parts]), np.concatenate([w for _, w in parts])
    del parts, listed
    sizes_a = np.bincount(gram_word, minlength=len(index)).astype(np.float64)
    tokens = np.concatenate(word_ids)
    lens = np.concatenate(window_len)
    win_start = np.r_[0, np.cumsum(lens)[:-1]]
    blocks = [slice(i, i + 100_000) for i in range(0, len(lens), 100_000)]  # windows at a time, to bound the arrays with an entry for each word
    words_of = [slice(int(win_start[b.start]), int(win_start[b.stop]) if b.stop < len(lens) else len(tokens)) for b in blocks]
    text_start = np.r_[0, np.cumsum(n_win)[:-1]]
    win_text = np.repeat(np.arange(len(n_win)), n_win)

    bias = float(np.log(y.mean() / (1 - y.mean())))
    m = [np.zeros_like(vectors), np.zeros_like(softmax), 0.0]
    v = [np.zeros_like(vectors), np.zeros_like(softmax), 0.0]
    for epoch in range(1, cfg.epochs + 1):
        direction = softmax[1] - softmax[0]
        gram_score = vectors @ direction
        word_score = np.bincount(gram_word, gram_score[grams], len(index)) / sizes_a
        logit = np.concatenate([np.add.reduceat(word_score[tokens[t]], win_start[b] - t.start) for b, t in zip(blocks, words_of)]) / lens + bias
        sharp = min(1.0, epoch / (0.3 * cfg.epochs)) * 4.0  # from the mean of all windows to the worst one
        top = np.maximum.reduceat(logit, text_start)
        weight = np.exp(sharp * (logit - top[win_text]))
        weight /= np.add.reduceat(weight, text_start)[win_text]
        pooled = np.add.reduceat(weight * logit, text_start)
        error = (_sigmoid(pooled) - y) / len(y)
        on_win = error[win_text] * weight
        on_word = sum(np.bincount(tokens[t], np.repeat(on_win[b] / lens[b], lens[b]), len(sizes_a)) for b, t in zip(blocks, words_of))
        on_gram = np.bincount(grams, (on_word / sizes_a)[gram_word], cfg.buckets)
        d_dir = vectors.T @ on_gram
        grads = [on_gram[:, None] * direction[None, :] + cfg.decay * vectors,
                 np.stack([-d_dir, d_dir]) + cfg.decay * softmax, float(error.sum())]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            step = cfg.rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
            if k == 0:
                vectors = vectors - step
            elif k == 1:
                softmax = softmax - step
            else:
                bias -= float(step)
    return Model(cfg, vectors, softmax, bias)


class Scorer:
    """Log odds of class 1 for whole texts; margins of words are kept between texts, a bounded number of them."""

    def __init__(self, model: Model):
        self.model = model
        self.margin = model.margins()
        self.known: dict[str, float] = {}

    def learn(self, found: set[str]) -> None:
        """Margins of words not met before, all at once."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in found if w not in self.known]
        if new:
            grams, owner = subwords(new, self.model.config)
            sums = np.bincount(owner, self.margin[grams], len(new)) / np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, sums.tolist()))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.model.bias, dtype=np.float64)
        block: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            found = words(text)
            if found:
                block.append((i, found))
                size += len(found)
            if block and (size > 150_000 or i == len(texts) - 1):
                self._score(block, out)
                block, size = [], 0
        if block:
            self._score(block, out)
        return out

    def _score(self, block: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        self.learn({w for _, found in block for w in found})
        window = self.model.config.window
        for i, found in block:
            margins = np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))
            starts = np.arange(0, len(found), window)
            lens = np.minimum(window, len(found) - starts)
            out[i] += (np.add.reduceat(margins, starts) / lens).max()


def toxicity(model: Model, text: str | Column = "text") -> Column:
    """Probability of class 1 for each whole text, as a column."""
    shared = {"model": model}

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(shared["model"])
        for texts in batches:
            yield pd.Series(_sigmoid(score(list(texts))))
        give_back()

    return probability(F.col(text) if isinstance(text, str) else text)


def train(docs: DataFrame, labels: DataFrame, cfg: Config = Config(), folds: int = 5) -> Model:
    """Sample labelled texts whose id is outside fold 0 and fit; the driver holds the bounded sample only."""
    picked = sample(docs, labels, cfg, folds)
    return fit(picked["_text"].tolist(), [int(m) for m in picked["_y"]], cfg)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), toxicity(model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
