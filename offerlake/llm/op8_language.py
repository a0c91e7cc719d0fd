"""Language identification of words and texts by a linear-chain conditional random field.

Every word has affix, character n-gram and lexicon features with one weight per language; a learned transition
matrix ties neighbouring words. Forward-backward gives each word its language probabilities, so code-switched
texts come out word by word (``label_words``); a text takes the language with the largest mean probability over
its words that hold a letter, and that mean is its score.

Training uses a bounded sample: about ``Config.per_lang`` texts of each language (chosen by a hash of the row,
twice as many at most) and one run of ``sample_words`` words of each. Runs of different languages are spliced,
so the transitions learn both staying and switching. The lexicon holds the most frequent words of each language
in that sample. Whole texts are labelled, each as one chain of all its words.

Every value of lang in the training texts is learned; more than ``Config.max_langs`` of them raise an error.

A null text, or one without a letter, is ``und`` with score 0. With no labelled text at all, everything is ``und``.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import char_grams, crc_mod, give_back, table

LETTERS = regex.compile(r"\p{L}+")  # numbers that are no digits (½, Ⅷ, ①) are no letters
UNKNOWN = "und"
CACHE_WORDS = 250_000


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 15
    per_lang: int = 400
    max_langs: int = 1000  # more values of lang than this are an error: the weights have a column for each
    sample_words: int = 80
    lexicon: int = 300
    chain: int = 256  # words of a chain that are gone through at a time; changes no result
    epochs: int = 60
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    config: Config
    langs: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> bit set of languages
    weights: np.ndarray | None = None  # (buckets + langs) x langs
    moves: np.ndarray | None = None  # langs x langs, log space


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def features(found: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words and the index of the word each belongs to: n-grams of up to three characters,
    affixes of up to four (grams at the word's marked ends), the word itself, and its lexicon languages."""
    n = model.config.buckets
    rows, owner = char_grams(found, range(1, 4), range(4, 6), n)
    listed = [(n + k, i) for i, w in enumerate(found) if (bits := model.lexicon.get(w, 0)) for k in range(len(model.langs)) if bits >> k & 1]
    if listed:
        more = np.array(listed, dtype=np.int64)
        rows, owner = np.concatenate([rows, more[:, 0]]), np.concatenate([owner, more[:, 1]])
    return rows, owner


def forward_backward(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of padded chains. ``emit``: chains x length x states in log space; ``mask``: chains x length.
    Returns the state posteriors and the expected moves summed over all chains."""
    chains, length, states = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = a
    for i in range(1, length):
        nxt = (a @ t) * e[:, i]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(mask[:, i, None], nxt, a)
        alpha[:, i] = a
    beta = np.ones((chains, states))
    post = np.empty_like(e)
    expected = np.zeros((states, states))
    for i in range(length - 1, -1, -1):
        p = alpha[:, i] * beta
        post[:, i] = p / p.sum(1, keepdims=True)
        if i:
            right = e[:, i] * beta
            pair = alpha[:, i - 1, :, None] * t[None] * right[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            expected += pair[mask[:, i]].sum(0)
            back = right @ t.T
            back /= back.sum(1, keepdims=True)
            beta = np.where(mask[:, i, None], back, beta)
    return post, expected


def sample(docs: DataFrame, cfg: Config, folds: int = 4, held: int = 2) -> pd.DataFrame:
    """About ``per_lang`` training texts of each language (twice as many at most), cut to one run of words."""
    mine = docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (crc_mod("_id", folds) != held))
    counts = {r["_lang"]: r["n"] for r in mine.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).limit(cfg.max_langs + 1).collect()}
    if len(counts) > cfg.max_langs:
        raise ValueError(f"more than {cfg.max_langs} languages in lang (Config.max_langs)")
    if not counts:
        return pd.DataFrame({"_lang": [], "_run": []})
    draw = F.pmod(F.xxhash64("_id", F.lit(cfg.seed)), F.lit(1_000_000))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(1_000_000 * min(1.0, cfg.per_lang / n)))])
    words = F.split(F.trim(F.regexp_replace("_text", r"\s+", " ")), " ")
    first = F.pmod(F.xxhash64("_id", F.lit(3)), F.greatest(F.size("_w") - cfg.sample_words, F.lit(0)) + 1).cast("int") + 1
    picked = mine.where(draw < F.element_at(share, F.col("_lang"))).withColumn("_w", words)
    return (picked.select("_id", "_lang", F.slice("_w", first, cfg.sample_words).alias("_run"))
            .limit(2 * cfg.per_lang * len(counts)).orderBy("_id").select("_lang", "_run").toPandas())


def fit(runs: list[tuple[str, list[str]]], cfg: Config = Config()) -> Model:
    """Fit emissions and transitions by gradient steps (Adam) on the conditional likelihood of spliced runs."""
    runs = [(k, found) for k, ws in runs if (found := words(" ".join(ws)))]
    langs = sorted({k for k, _ in runs})
    if not langs:
        return Model(cfg, [])
    state = {k: i for i, k in enumerate(langs)}
    lexicon: dict[str, int] = {}
    for k in langs:
        seen = Counter(w for key, ws in runs if key == k for w in ws)
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: cfg.lexicon]:
            lexicon[w] = lexicon.get(w, 0) | 1 << state[k]
    n = len(langs)
    model = Model(cfg, langs, lexicon, np.zeros((cfg.buckets + n, n)), np.zeros((n, n)))
    rng = np.random.default_rng(cfg.seed)
    order = rng.permutation(len(runs))
    words_at: dict[str, int] = {}
    chains: list[list[tuple[int, int]]] = []
    chain: list[tuple[int, int]] = []
    waiting = deque([runs[j] for j in order])
    while waiting:  # cut every run into pieces and splice them with those of other texts; what is left of a run waits its turn
        k, ws = waiting.popleft()
        cut = 0
        while cut < len(ws):
            take = int(rng.integers(4, 33))
            chain += [(words_at.setdefault(w, len(words_at)), state[k]) for w in ws[cut : cut + take]]
            cut += take
            if rng.random() < 0.5 or len(chain) >= 48:
                chains.append(chain)
                chain = []
            elif cut < len(ws) and waiting and rng.random() < 0.7:
                waiting.append((k, ws[cut:]))
                break
    if chain:
        chains.append(chain)
    flat, owner = features(list(words_at), model)
    length = max(map(len, chains))
    ids = np.zeros((len(chains), length), dtype=np.int64)
    gold = np.zeros((len(chains), length), dtype=np.int64)
    mask = np.zeros((len(chains), length), dtype=bool)
    for i, c in enumerate(chains):
        ids[i, : len(c)] = [x for x, _ in c]
        gold[i, : len(c)] = [y for _, y in c]
        mask[i, : len(c)] = True
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    one_hot = np.eye(n)[gold]
    weights, moves = model.weights, model.moves
    m, v = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    total = mask.sum()
    for epoch in range(1, cfg.epochs + 1):
        by_word = np.stack([np.bincount(owner, weights[flat, s], len(words_at)) for s in range(n)], axis=1)
        post, expected = forward_backward(by_word[ids], mask, moves)
        gap = (post - one_hot)[mask]
        at = ids[mask]
        on_word = np.stack([np.bincount(at, gap[:, s], len(words_at)) for s in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, on_word[owner, s], len(weights)) for s in range(n)], axis=1) / total + cfg.decay * weights / len(langs)
        grads = [grad, (expected - gold_moves) / total + cfg.decay * moves]
        for k, (g, x) in enumerate(zip(grads, (weights, moves))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= cfg.rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
    return Model(cfg, langs, lexicon, weights, moves)


class Labeller:
    """Word posteriors of whole texts; emission rows of words are kept between texts, a bounded number of them."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.emit = np.zeros((1024, max(1, len(model.langs))), dtype=np.float32)

    def learn(self, found: set[str]) -> None:
        """Emission rows of words not met before, all at once."""
        if len(self.rows) > CACHE_WORDS:
            self.rows = {}
        new = [w for w in found if w not in self.rows]
        if not new:
            return
        have, need = len(self.rows), len(self.rows) + len(new)
        if need > len(self.emit):
            self.emit = np.concatenate([self.emit[:have], np.zeros((2 * need - have, self.emit.shape[1]), np.float32)])
        rows, owner = features(new, self.model)
        for k in range(len(self.model.langs)):
            self.emit[have:need, k] = np.clip(np.bincount(owner, self.model.weights[rows, k], len(new)), -60, 60)
        self.rows.update(zip(new, range(have, need)))

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """One words x langs matrix per text: a text is one chain. Its blocks of ``chain`` words run side by side:
        first each block's product of moves and emissions, which carries the forward messages over the blocks before
        and the backward ones over those behind, then the words inside with the messages that enter their block."""
        if not any(texts):
            return [np.zeros((0, len(self.model.langs))) for _ in texts]
        self.learn({w for t in texts for w in t})
        size = self.model.config.chain
        ids = [np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t)) for t in texts]
        pieces = [x[i : i + size] for x in ids for i in range(0, len(x), size)]
        moves = self.model.moves.astype(np.float32)
        entry, leave = np.ones((2, len(pieces), self.emit.shape[1]), dtype=np.float32)
        first = 0
        spans = []  # pieces of each text of several blocks
        for x in ids:
            n = -(-len(x) // size)
            if n > 1:
                spans.append(range(first, first + n))
            first += n
        at_once = max(1, min(2048, 4_000_000 // self.emit.shape[1] ** 2))
        longer = [i for span in spans for i in span]
        t = _moves(moves)
        through = np.concatenate([_products(*self._grid([pieces[i] for i in longer[at : at + at_once]]), moves) for at in range(0, len(longer), at_once)]) if longer else None
        at = 0
        for span in spans:
            mine = through[at : at + len(span)]
            at += len(span)
            message = mine[0].sum(0)
            for k in range(1, len(span)):
                entry[span[k]] = message = _scaled(message @ t)
                message = _scaled(message @ mine[k])
            message = np.ones(len(t), dtype=np.float32)
            for k in range(len(span) - 1, 0, -1):
                leave[span[k - 1]] = message = _scaled(t @ (mine[k] @ message))
        found: list[np.ndarray | None] = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), 2048):  # blocks of like length go together
            block = order[at : at + 2048]
            post = _posteriors(*self._grid([pieces[i] for i in block]), moves, entry[block], leave[block])
            for r, i in enumerate(block):
                found[i] = post[r, : len(pieces[i])]
        out, at = [], 0
        for x in ids:
            n = -(-len(x) // size)
            out.append(np.concatenate(found[at : at + n]) if n else np.zeros((0, len(self.model.langs))))
            at += n
        return out


    def _grid(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of the pieces, padded to one length, and the mask of their words."""
        lens = np.array([len(x) for x in pieces])
        grid = np.zeros((len(pieces), int(lens.max())), dtype=np.int64)
        for r, x in enumerate(pieces):
            grid[r, : lens[r]] = x
        mask = np.arange(grid.shape[1])[None, :] < lens[:, None]
        emit = self.emit[grid]
        emit[~mask] = 0
        return emit, mask


def _moves(moves: np.ndarray) -> np.ndarray:
    return np.exp(moves - moves.max())


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / (x.sum() + 1e-30)


def _products(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Of every block the states x states product of its words' emissions and the moves between them, scaled."""
    e = np.ascontiguousarray(np.exp(emit - emit.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    on = np.ascontiguousarray(mask.T)[:, :, None, None]
    t = _moves(moves)
    states = len(t)
    out = np.eye(states, dtype=e.dtype)[None] * e[0][:, None, :]
    for i in range(1, len(e)):
        nxt = (out.reshape(-1, states) @ t).reshape(out.shape) * e[i][:, None, :]
        nxt /= nxt.sum((1, 2), keepdims=True) + 1e-30
        out = np.where(on[i], nxt, out)
    return out


def _posteriors(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """State posteriors alone, time-major for speed, given the messages that enter each block from before and behind."""
    e = np.ascontiguousarray(np.exp(emit - emit.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    on = np.ascontiguousarray(mask.T)[:, :, None]
    t = _moves(moves)
    alpha = np.empty_like(e)
    a = entry * e[0]
    a /= a.sum(1, keepdims=True) + 1e-30
    alpha[0] = a
    for i in range(1, len(e)):
        nxt = (a @ t) * e[i]
        nxt /= nxt.sum(1, keepdims=True) + 1e-30
        a = np.where(on[i], nxt, a)
        alpha[i] = a
    beta = leave
    for i in range(len(e) - 1, 0, -1):
        back = (e[i] * beta) @ t.T
        alpha[i] *= beta
        beta = np.where(on[i], back / (back.sum(1, keepdims=True) + 1e-30), beta)
    alpha[0] *= beta
    alpha /= alpha.sum(2, keepdims=True) + 1e-30
    return alpha.transpose(1, 0, 2)


def label_words(model: Model, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, probability) for every word of a code-switched text; words without letters are skipped."""
    found = words(text)
    if not found or not model.langs:
        return []
    post = Labeller(model).posteriors([found])[0]
    return [(w, model.langs[int(p.argmax())], float(p.max())) for w, p in zip(found, post)]


def language(model: Model, text: str | Column = "text") -> Column:
    """Struct (lang_pred, score) for each whole text."""
    shared = {"model": model}

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared["model"]
        labeller = Labeller(model)
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at, size = [], 0
            block: list[list[str]] = []

            def flush() -> None:
                for i, post in zip(at, labeller.posteriors(block)):
                    mean = post.mean(axis=0, dtype=np.float64)
                    k = int(mean.argmax())
                    langs[i], scores[i] = model.langs[k], min(1.0, max(0.0, float(mean[k])))
                at.clear()
                block.clear()

            for i, text in enumerate(texts):
                found = words(text) if model.langs else []
                if not found:
                    continue
                at.append(i)
                block.append(found)
                size += len(found)
                if size > 150_000:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        give_back()

    return predicted(F.col(text) if isinstance(text, str) else text)


def train(docs: DataFrame, cfg: Config = Config(), folds: int = 4, held: int = 2) -> Model:
    picked = sample(docs, cfg, folds, held)
    return fit([(k, list(run)) for k, run in zip(picked["_lang"], picked["_run"])], cfg)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), language(model).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
