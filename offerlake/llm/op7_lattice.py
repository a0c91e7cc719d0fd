"""Log-probability of texts by a subword lattice over an existing vocabulary.

A word's probability is the sum over all its segmentations into vocabulary pieces of the product of the pieces'
probabilities, computed by forward recursion in log space over the word's bytes. The vocabulary's own scores
(ranks) give the first piece probabilities by Zipf's law; rounds of expectation-maximisation over the counts of
all training words then fit them (forward-backward over the same lattice). Only pieces with the word-start mark
may begin a word and only pieces without it go on, so the spelling model sums to one over all words. ``score`` is
this marginal over all words of the text; the mark for the end of a text, which has no spelling, is a token with
its share of the training tokens. ``mixed_score`` is given beside it and is no part of it: it mixes a word's share of
the training tokens with its spelling, whose weight is the share of training tokens whose word occurs once.

Counts come from every token of every training text. Words are counted per task before they are shuffled; the
``Config.head`` most frequent words travel to the tasks that read the texts, a bounded table, and the occurrences
of all other words are joined with the table of all words. Null and empty texts are a single end token.
Rows with equal id and text share their result; bytes outside the vocabulary are spelled by its byte pieces. Only
a word that no pieces spell, which takes a vocabulary without byte pieces, gets a fixed probability (``NO_PATH``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import crc_mod, entries, first_pairs, gathered, row_key, saved, scramble, slices, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁".encode()
END = b""  # the end token; no word is empty
COUNTED = 12 << 20  # bytes of text a task counts before it passes the words on
BLOCK = 50_000  # distinct words that are spelled together
SAFE = 600.0  # a path's natural-log probability above minus this is far from a double's smallest number
FLOOR = -1e30
NO_PATH = -1e6  # natural log, of a word that no pieces spell


@dataclass(frozen=True)
class Config:
    folds: int = 7
    held: int = 2
    rounds: int = 3  # of expectation-maximisation
    head: int = 150_000
    smooth: float = 0.01  # added to each piece's expected count


class Pieces:
    """Vocabulary pieces by 64-bit hash of their bytes, with log probabilities."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SHIFT = np.uint64(44)

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.names, self.logp = names, logp
        self.share = np.append(np.exp(logp), 0.0)  # the last one is that of no piece
        self.longest = max(map(len, names))
        hashes = np.array([self.hash_of(x) for x in names], dtype=np.uint64)
        # pieces sorted by their mixed hash, and for each value of its first bits where the pieces begin that have it
        mixed = scramble(hashes)
        order = np.argsort(mixed)
        self.keys, self.at = mixed[order], order
        heads = (self.keys >> self.SHIFT).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange(2 ** (64 - int(self.SHIFT)))).astype(np.int32)
        self.held = np.bincount(heads, minlength=len(self.begin)) > 0
        self.depth = int(np.bincount(heads).max())

    @classmethod
    def hash_of(cls, data: bytes) -> int:
        h = 0
        for byte in data:
            h = (h * int(cls.BASE) + byte + 1) % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        h = scramble(h)
        head = (h >> self.SHIFT).astype(np.int64)
        out = np.full(len(h), -1, dtype=np.int64)
        on = np.flatnonzero(self.held[head])  # few hashes share their first bits with a piece
        h, k = h[on], self.begin[head[on]]
        for step in range(self.depth):
            at = np.minimum(k + step, len(self.keys) - 1)
            same = self.keys[at] == h
            out[on[same]] = self.at[at[same]]
        return out

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces found in the marked words: (word, start, end, piece), and the words' lengths."""
        marked = [MARK + w for w in words]
        lens = np.fromiter(map(len, marked), np.int64, len(marked))
        flat = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(flat)) - starts[owner]
        left = lens[owner] - place
        h = np.zeros(len(flat), dtype=np.uint64)
        out = []
        at = np.arange(len(flat))
        for n in range(1, self.longest + 1):
            keep = left[at] >= n
            at, h = at[keep], h[keep]
            if not len(at):
                break
            h = h * self.BASE + flat[at + n - 1]
            # a marked piece begins the word and is longer than a part of the mark; any other lies behind the mark
            on = np.flatnonzero((place[at] >= len(MARK)) | ((place[at] == 0) & (n >= len(MARK))))
            piece = self.find(h[on])
            on, piece = on[piece >= 0], piece[piece >= 0]
            out.append((owner[at[on]], place[at[on]], place[at[on]] + n, piece))
        word, start, end, piece = (np.concatenate([o[i] for o in out]) for i in range(4))
        return word, start, end, piece, lens

    def forward(self, words: list[bytes], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural-log probability of every word. With ``expected``, each piece's posterior count (times the
        word's weight) is added to it by the backward recursion."""
        out = np.zeros(len(words))
        if not words:
            return out
        word, start, end, piece, lens = self.arcs(words)
        lp = self.logp[piece]
        top = int(lens.max())
        alpha = np.full((top + 1, len(words)), FLOOR)
        alpha[0] = 0.0
        self._recurse(alpha, end, start, word, lp, range(1, top + 1))
        out = alpha[lens, np.arange(len(words))]
        if expected is not None:
            beta = np.full((top + 1, len(words)), FLOOR)
            beta[lens, np.arange(len(words))] = 0.0
            self._recurse(beta, start, end, word, lp, range(top, -1, -1))
            share = np.exp(np.minimum(0.0, alpha[start, word] + lp + beta[end, word] - out[word]))
            expected += np.bincount(piece, share * weights[word], len(expected))
        return out

    @staticmethod
    def _recurse(table: np.ndarray, to: np.ndarray, since: np.ndarray, word: np.ndarray, lp: np.ndarray, places: range) -> None:
        """For each place in turn: table[place, word] = log-sum-exp over the word's arcs to it of table[since, word] + lp."""
        width = table.shape[1]
        target = to * width + word
        order = np.argsort(target, kind="stable")
        target, source, lp = target[order], (since * width + word)[order], lp[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])  # arcs that share place and word lie together
        sizes = np.diff(np.r_[heads, len(target)])
        cuts = np.searchsorted(target[heads], np.arange(len(table) + 1) * width)
        flat = table.reshape(-1)
        for place in places:
            a, b = cuts[place], cuts[place + 1]
            if a == b:
                continue
            first = heads[a]
            arcs = slice(first, heads[b - 1] + sizes[b - 1])
            value = flat[source[arcs]] + lp[arcs]
            best = np.maximum.reduceat(value, heads[a:b] - first)
            total = np.add.reduceat(np.exp(value - np.repeat(best, sizes[a:b])), heads[a:b] - first)
            flat[target[heads[a:b]]] = best + np.log(total)

    def _alike(self, words: list[bytes], weights: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """As ``forward`` for words of one length that is short enough for plain probabilities: all their places are
        reached in step, so each sum over arcs is a sum of whole rows."""
        many, size = len(words), len(words[0])
        text = np.ascontiguousarray(np.frombuffer(b"".join(words), dtype=np.uint8).reshape(many, size).T).astype(np.uint64) + np.uint64(1)
        # pieces with the mark and the word's first j bytes, then pieces of n bytes at each place
        h = np.full(many, self.hash_of(MARK), dtype=np.uint64)
        hashes = [h]
        for j in range(min(size, self.longest - len(MARK))):
            h = h * self.BASE + text[j]
            hashes.append(h)
        first = self.find(np.concatenate(hashes)).reshape(-1, many)
        inner = []
        h = np.zeros((size, many), dtype=np.uint64)
        for n in range(1, min(size, self.longest) + 1):
            h = h[: size - n + 1] * self.BASE + text[n - 1 :]
            inner.append(self.find(h.reshape(-1)).reshape(h.shape))
        p_first, p_inner = self.share[first], [self.share[x] for x in inner]
        alpha = np.zeros((size + 1, many))
        alpha[: len(first)] = p_first
        for j in range(1, size + 1):
            for n in range(1, min(j, len(inner)) + 1):
                alpha[j] += alpha[j - n] * p_inner[n - 1][j - n]
        out = alpha[size]
        if expected is not None:
            beta = np.zeros((size + 1, many))
            beta[size] = np.divide(weights, out, out=np.zeros(many), where=out > 0)
            for j in range(size - 1, -1, -1):
                for n in range(1, min(size - j, len(inner)) + 1):
                    beta[j] += p_inner[n - 1][j] * beta[j + n]
            pieces, counts = [first], [p_first * beta[: len(first)]]
            for n, (piece, p) in enumerate(zip(inner, p_inner), 1):
                pieces.append(piece)
                counts.append(alpha[: size - n + 1] * p * beta[n:])
            piece = np.concatenate([x.reshape(-1) for x in pieces])
            on = np.flatnonzero(piece >= 0)
            expected += np.bincount(piece[on], np.concatenate([x.reshape(-1) for x in counts])[on], len(expected))
        return np.where(out > 0, np.log(np.maximum(out, 1e-307)), FLOOR)

    def score(self, words: list[bytes], weights=None, expected=None) -> np.ndarray:
        """Natural-log probability of every word, in blocks of words of one length, or of like length where paths may
        be too unlikely for plain probabilities. ``expected``: as in ``forward``."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        out = np.zeros(len(words))
        plain = int(np.searchsorted(lens[order], SAFE / max(1e-9, -float(self.logp.min())) - 1))
        edges = np.r_[0, np.flatnonzero(np.diff(lens[order[:plain]])) + 1, plain].tolist()
        for a, b in zip(edges, edges[1:]):
            wide = max(1, min(4096, 400_000 // (int(lens[order[a]]) + 1) ** 2)) if a < b else 1
            for i in range(a, b, wide):
                block = order[i : min(b, i + wide)]
                out[block] = self._alike([words[k] for k in block.tolist()], None if weights is None else weights[block], expected)
        order = order[plain:].tolist()
        at = 0
        while at < len(order):
            size, stop = 0, at  # a block's table has words x longest entries
            while stop < len(order) and stop - at < 20_000 and (size := (stop - at + 1) * (len(words[order[stop]]) + 4)) <= 2_000_000 or stop == at:
                stop += 1
            block = order[at:stop]
            out[block] = self.forward([words[i] for i in block], None if weights is None else weights[block], expected)
            at = stop
        return out


def vocabulary(path: str) -> Pieces:
    """Pieces of the model file with probabilities by the rank that its scores give (Zipf's law)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode("utf-8")
        if MARK in name[1:] or (len(name) < len(MARK) and MARK.startswith(name) and not model.is_byte(i)):
            continue  # pieces over two words have no place in a word
        names.append(name)
        scores.append(float(model.get_score(i)) if not model.is_byte(i) else -1e9)
    seen: dict[bytes, int] = {}
    for i, name in enumerate(names):
        if name not in seen or scores[i] > scores[seen[name]]:
            seen[name] = i
    picked = sorted(seen.values(), key=lambda i: (-scores[i], names[i]))
    weight = 1.0 / (np.arange(len(picked)) + 3.0)
    return Pieces([names[i] for i in picked], np.log(weight / weight.sum()))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words_of`` of all texts behind each other, the end token after those of each text, and where the texts begin."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    # the white space added at the end leaves an empty last word
    spaced = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, spaced))
    begins = split.offsets.to_numpy().astype(np.int64)
    return begins - begins[0], split.flatten().cast(pa.large_binary())


def count_words(docs: DataFrame, cfg: Config, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, c, every): occurrences in training texts and in all texts, of every word and of the end token."""
    source = docs.select((crc_mod(id_col, cfg.folds) != cfg.held).alias("train"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []

        def out() -> pa.RecordBatch:
            words = pa.chunked_array([w for _, w in held], pa.large_binary()).combine_chunks().dictionary_encode()
            train, at, n = np.concatenate([t for t, _ in held]), words.indices.to_numpy(), len(words.dictionary)
            held.clear()
            return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(np.bincount(at[train], minlength=n), pa.int64()), pa.array(np.bincount(at, minlength=n), pa.int64())],
                                              ["word", "c", "every"])

        size = 0
        for b in slices(batches, "_text"):
            begins, words = tokens_of(b.column(1))
            held.append((np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(begins)), words))
            size += b.column(1).nbytes
            if size > COUNTED:
                yield out()
                size = 0
        if held:
            yield out()

    parts = source.mapInArrow(run, "word binary, c long, every long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def fit(counts: DataFrame, pieces: Pieces, cfg: Config) -> Pieces:
    """Expectation-maximisation over all training words; what comes back is one number for each piece."""
    for _ in range(cfg.rounds):
        now = pieces

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.names))
            for b in gathered(batches, "word", BLOCK, 1 << 20):
                now.score(entries(b.column(0)), b.column(1).to_numpy().astype(np.float64), total)
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["piece", "n"])

        found = counts.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c").mapInArrow(expect, "piece int, n double")
        sums = found.groupBy("piece").agg(F.sum(F.round("n", 6).cast("decimal(28,6)")).alias("n")).collect()  # a row for each piece at most
        total = np.full(len(pieces.names), cfg.smooth)
        for r in sums:
            total[r["piece"]] += float(r["n"])
        pieces = Pieces(pieces.names, np.log(total / total.sum()))
    return pieces


def score_texts(docs: DataFrame, pieces: Pieces, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) for every row; scores
    are log10. ``score`` is the lattice's: no word shares, but for the end token's."""
    spark = docs.sparkSession
    counts = saved(count_words(docs, cfg, id_col, text), "lattice-counts")
    t = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once"),
                   F.count(F.lit(1)).alias("words"), F.sum(F.when(F.octet_length("word") == 0, F.col("c"))).alias("ends")).first()
    n, v, once = t["n"] or 0, t["v"] or 0, t["once"] or 0
    spell = min(0.5, max(1e-6, (once + 1) / (n + 2)))
    pieces = fit(counts, pieces, cfg)
    ending = ((t["ends"] or 0) + 1) / (n + 2)
    base_log = float(np.log10(n + v + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, "word", BLOCK, 1 << 20):
            words, c = entries(b.column(0)), b.column(1).to_numpy().astype(np.float64)
            real = np.fromiter(map(len, words), np.int64, len(words)) > 0
            lattice = pieces.score(words)
            lattice = np.where(lattice > FLOOR / 2, lattice, NO_PATH)
            spelled = np.where(real, np.exp(np.maximum(lattice, -700)), 0.0)
            seen = c / n if n else np.zeros(len(c))
            p = (1 - spell) * seen + spell * spelled
            tiny = lattice / np.log(10) + np.log10(spell)
            logp = np.where(p < 1e-290, np.where(real, tiny, np.log10(1 / (n + 1))), np.log10(np.maximum(p, 1e-300)))
            alone = np.where(real, lattice / np.log(10) + np.log10(1 - ending), np.log10(ending))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c > 0), pa.array(np.log10(c + 1) - base_log), pa.array(logp), pa.array(alone), b.column(2)],
                                             ["word", "known", "base", "logp", "alone", "every"])

    table_ = saved(counts.select("word", "c", "every").mapInArrow(weigh, "word binary, known boolean, base double, logp double, alone double, every long"), "lattice-words")
    # head: as many words as the most frequent ``cfg.head`` have, a bounded table for every task
    head_rows = table_.orderBy(F.desc("every"), "word").limit(cfg.head).select("word", "known", "base", "logp", "alone").toArrow().combine_chunks()
    head_words = F.broadcast(spark.createDataFrame(head_rows.select(["word"]))) if head_rows.num_rows else None
    shared = spark.sparkContext.broadcast([head_rows.column(i).to_numpy() for i in range(1, 5)] + [head_rows.column(0).to_pylist()])
    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("k"), (crc_mod(id_col, cfg.folds) == cfg.held).alias("held_out"), F.col(text).alias("_text"))
    schema = source.drop("_text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("logp", "double"), ("alone", "double")):
        schema = schema.add(name, kind)
    schema = schema.add("tail", T.ArrayType(T.StructType().add("word", "binary").add("n", "integer")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, logp, alone, words = shared.value
        at = {w: i for i, w in enumerate(words)}
        miss = len(words)
        known_, base_, logp_ = np.r_[known.astype(np.int64), 0], np.r_[base.astype(np.float64), 0.0], np.r_[logp.astype(np.float64), 0.0]
        alone_ = np.r_[alone.astype(np.float64), 0.0]
        for b in slices(batches, "_text"):
            begins, words = tokens_of(b.column(3))
            words = words.dictionary_encode()
            word, listed = words.indices.to_numpy().astype(np.int64), entries(words.dictionary)
            row = np.fromiter(map(at.get, listed, repeat(miss)), np.int64, len(listed))[word]
            sums = [[x[i:j].sum() for i, j in zip(begins.tolist(), begins[1:].tolist())] for x in (known_[row], base_[row], logp_[row], alone_[row])]
            rare = np.flatnonzero(row == miss)
            text, word, n_rare = first_pairs(np.repeat(np.arange(len(b)), np.diff(begins))[rare], word[rare])
            rest = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)).cast(pa.binary()), pa.array(n_rare, pa.int32())], ["word", "n"])
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(b) + 1)), pa.int32()), rest)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(begins), pa.int64()), pa.array(sums[0], pa.int64()), *[pa.array(x, pa.float64()) for x in sums[1:]], tails],
                                             ["doc_id", "k", "held_out", "n_tokens", "n_known", "base", "logp", "alone", "tail"])

    first = saved(source.mapInArrow(read, schema), "lattice-texts")
    tail = first.select("doc_id", "k", F.explode("tail").alias("w")).select("doc_id", "k", "w.word", "w.n")
    others = table_.join(head_words, "word", "left_anti") if head_words is not None else table_
    sums = (tail.join(others, "word").groupBy("k", "doc_id")
            .agg(F.sum(F.col("known").cast("long") * F.col("n")).alias("more_known"), F.sum(F.col("base") * F.col("n")).alias("more_base"), F.sum(F.col("logp") * F.col("n")).alias("more_logp"),
                 F.sum(F.col("alone") * F.col("n")).alias("more_alone")))
    # rows with equal id and text were added up together
    copies = first.groupBy("k", "doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sums = sums.withColumnsRenamed({"k": "k2", "doc_id": "id2"})
    copies = copies.withColumnsRenamed({"k": "k3", "doc_id": "id3"})
    joined = (first.drop("tail").join(sums, (F.col("k") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
              .join(copies, (F.col("k") == F.col("k3")) & F.col("doc_id").eqNullSafe(F.col("id3")), "left").withColumn("copies", F.coalesce("copies", F.lit(1))))
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                         (F.col("base") + more("more_base")).alias("base_score"), (F.col("alone") + more("more_alone")).alias("score"),
                         (F.col("logp") + more("more_logp")).alias("mixed_score"))


def op7_lattice(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path(VOCABULARY)))
