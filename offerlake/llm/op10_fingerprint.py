"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its words (split at white space) with their counts. For every sample number and every
term, two gamma variates and one uniform variate are drawn from the hash of the term, the same in every text; the
sample takes the term whose drawn arrival for its weight comes first, together with the step of the weight. Two
texts take the same (term, step) with the probability of their generalised Jaccard similarity, so the share of
equal samples estimates it. A fingerprint is ``Config.samples`` such values of 32 bits, in hexadecimal.

A text without words (null, empty, white space alone) has the empty fingerprint; two of these are alike with 1,
one of these and another text with 0. Equal texts have equal fingerprints. ``near_edited`` and ``near_next``
compare each text with its edited form and with the text of the next row by ascending id; rows with equal ids are
ordered by a hash of their text, null ids come first. The row after the last is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import entries, first_pairs, saved, scramble, slices, table, worker_memory


@dataclass(frozen=True)
class Config:
    samples: int = 64
    keep: int = 100_000  # terms whose draws a task keeps, and as many (term, count > 1)
    rows: int = 1000  # rows of a range of ids, about; a task has four ranges or more, so that tasks are of like size
    ranges: int = 20_000  # ranges at most: beyond, each holds more rows, which are streamed
    seed: int = 3


class Kept:
    """Draws of terms under their row numbers. What is above ``keep`` goes when the next batch comes, but for the
    half of ``keep`` that most batches held."""

    def __init__(self, keep: int, **columns: np.ndarray):
        self.keep, self.columns = keep, columns
        self.at: dict = {}
        self.uses = np.zeros(0, dtype=np.int32)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def rows(self, terms: list, draw) -> np.ndarray:
        """Row of each of the distinct ``terms``; ``draw`` gives the columns of some of them, by their positions."""
        if len(self.at) > self.keep:
            self._drop()
        have = len(self.at)
        found = np.fromiter(map(self.at.get, terms, repeat(-1)), np.int64, len(terms))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(have, have + len(new))
        if have + len(new) > len(self.uses):
            self._resize(have, have + len(new) + self.keep // 4)
        for i in range(0, len(new), 512):
            some = new[i : i + 512]
            for name, x in draw(some).items():
                self.columns[name][have + i : have + i + len(some)] = x
        self.at.update(zip(map(terms.__getitem__, new.tolist()), range(have, have + len(new))))
        self.uses[found] += 1
        return found

    def _resize(self, have: int, room: int) -> None:
        for name, old in [*self.columns.items(), ("", self.uses)]:
            x = np.empty((room, *old.shape[1:]), old.dtype)
            x[:have] = old[:have]
            if name:
                self.columns[name] = x
            else:
                x[have:] = 0
                self.uses = x

    def _drop(self) -> None:
        most = np.argsort(-self.uses[: len(self.at)], kind="stable")[: self.keep // 2]
        most = np.sort(most[self.uses[most] > 1])
        terms = list(self.at)
        self.at = dict(zip(map(terms.__getitem__, most.tolist()), range(len(most))))
        self.columns = {name: x[most] for name, x in self.columns.items()}
        self.uses = self.uses[most] // 2


class Sampler:
    def __init__(self, cfg: Config):
        self.cfg = cfg
        grid = lambda kind: np.zeros((0, cfg.samples), dtype=kind)
        self.terms = Kept(cfg.keep, name=np.zeros(0, dtype=np.uint64), arrival=grid(np.float32))  # log arrival of weight 1
        self.often = Kept(cfg.keep, arrival=grid(np.float32), step=grid(np.int32))  # of a term with its count, where that is above 1
        self.shifts = [scramble(np.arange(cfg.samples, dtype=np.uint64) + np.uint64(1000 * draw + 7919 * cfg.seed)) for draw in range(6)]

    def _uniform(self, names: np.ndarray, draw: int) -> np.ndarray:
        """Uniform variates in (0, 1): one row for each term, one column for each sample."""
        x = names[:, None] ^ self.shifts[draw][None, :]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= np.uint64(40)
        out = x.astype(np.float32)
        out += np.float32(0.5)
        out *= np.float32(2.0**-24)
        return out

    def _draws(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gamma(2, 1) rate r, log of another such variate, and the uniform shift b."""
        r = -np.log(self._uniform(names, 1) * self._uniform(names, 2))
        c = -np.log(self._uniform(names, 3) * self._uniform(names, 4))
        return r, np.log(c), self._uniform(names, 5)

    def _once(self, names: np.ndarray) -> dict[str, np.ndarray]:
        r, log_c, b = self._draws(names)
        return {"name": names, "arrival": log_c + r * b - r}  # weight 1: log weight 0, so the step is floor(b) = 0

    def _weighed(self, names: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        r, log_c, b = self._draws(names)
        t = np.floor(np.log(n.astype(np.float32))[:, None] / r + b)
        return {"arrival": log_c - r * (t - b) - r, "step": t.astype(np.int32)}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Fingerprints of whole texts, together of bounded size."""
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        words = split.flatten().cast(pa.large_binary()).dictionary_encode()
        word, listed = words.indices.to_numpy(), entries(words.dictionary)
        if b"" in listed:  # what lies before or behind white space at an end of a text
            real = word != listed.index(b"")
            text, word = text[real], word[real]
        if not len(word):
            return [b""] * len(texts)
        text, word, count = first_pairs(text, word)
        digest = lambda some: np.fromiter([xxhash.xxh64_intdigest(listed[i]) for i in some], np.uint64, len(some))
        row = self.terms.rows(listed, lambda some: self._once(digest(some.tolist())))
        names, row = self.terms["name"][row], row[word]
        more = np.flatnonzero(count > 1)
        weighed, which = np.unique(word[more] << 32 | count[more], return_inverse=True)
        n = weighed & 0xFFFFFFFF
        own = self.often.rows([(listed[w], c) for w, c in zip((weighed >> 32).tolist(), n.tolist())], lambda some: self._weighed(names[weighed[some] >> 32], n[some]))
        often = np.full(len(word), -1)
        often[more] = own[which]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        more_bounds = np.searchsorted(more, bounds).tolist()
        bounds = bounds.tolist()
        first = np.zeros((len(texts), self.cfg.samples), dtype=np.int64)
        room = np.empty((max(b - a for a, b in zip(bounds, bounds[1:])), self.cfg.samples), dtype=np.float32)
        for i, (a, b, c, d) in enumerate(zip(bounds, bounds[1:], more_bounds, more_bounds[1:])):
            if a < b:
                arrival = np.take(self.terms["arrival"], row[a:b], axis=0, out=room[: b - a], mode="clip")
                if c < d:
                    arrival[more[c:d] - a] = self.often["arrival"][often[more[c:d]]]
                first[i] = arrival.argmin(axis=0) + a
        step = np.zeros(first.shape, dtype=np.int32)
        stepped = often[first] >= 0
        step[stepped] = self.often["step"][often[first[stepped]], np.nonzero(stepped)[1]]
        taken = (scramble(names[word[first]] + step.astype(np.uint64)) >> np.uint64(32)).astype(">u4")
        return [x.tobytes() if a < b else b"" for x, a, b in zip(taken, bounds, bounds[1:])]


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    return float((np.frombuffer(a, dtype=np.uint32) == np.frombuffer(b, dtype=np.uint32)).mean())


def fingerprints(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint as binary) of every row; nothing is shuffled."""
    source = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = source.select(id_col).schema.add("fingerprint", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_memory(f"sampler:{cfg}", lambda: Sampler(cfg))
        for b in slices(batches, "_text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sampler(b.column(1).to_pylist()), pa.binary())], [id_col, "fingerprint"])

    return source.mapInArrow(run, schema)


def ordered(docs: DataFrame, cfg: Config, id_col: str, text: str) -> DataFrame:
    """Every row under the number of its range of ids, and the first row of each range once more at the end of
    the range before it (``extra``; that of the first range at the end of the last). Columns: part, extra, id,
    tie, _text. Ranges hold about ``cfg.rows`` rows each, more where ``cfg.ranges`` would be exceeded, which bounds
    what the driver lists; their bounds come from the ids alone, so all rows of one id are one range."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("_text"))
    n = rows.count()
    parts = max(1, min(cfg.ranges, -(-n // cfg.rows)))
    # bounds are positions in the sorted ids at even steps, approximately; a row's part follows from its id alone
    accuracy = max(10_000, 4 * parts)
    cuts = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], accuracy)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds.value, ids.fillna(0).astype("int64").to_numpy(), side="right")).astype(np.int32))

    return rows.withColumn("part", part_of("id"))


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def compare(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    rows = ordered(docs, cfg, id_col, text)
    # the first row of every part, found by partial minima over (id, tie), nulls first
    key = F.struct(F.col("id").isNotNull().alias("has"), F.coalesce("id", F.lit(0)).alias("id"), "tie")
    first = rows.groupBy("part").agg(F.min(key).alias("first"))
    heads = saved(first, "fingerprint-heads")
    listed = heads.orderBy("part").collect()  # one row for each range of ids, ``cfg.ranges`` at most
    if not listed:
        return rows.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"), F.lit("").alias("fingerprint"),
                           F.lit("").alias("edited_fingerprint"), F.lit(1.0).alias("near_edited"), F.lit(1.0).alias("near_next"))
    names = [r["part"] for r in listed]
    before = spark.createDataFrame([(p, names[i - 1], r["first"]["has"], r["first"]["id"], r["first"]["tie"]) for i, (p, r) in enumerate(zip(names, listed))],
                                   "part int, target int, has boolean, hid long, htie long")
    is_head = (F.col("id").isNotNull() == F.col("has")) & (F.coalesce("id", F.lit(0)) == F.col("hid")) & (F.col("tie") == F.col("htie"))
    marked = rows.join(F.broadcast(before), "part").withColumn("head", is_head)
    # a head goes to its own part and, marked as extra, to the part before; repeated heads do no harm there
    sent = marked.withColumn("to", F.explode(F.when(F.col("head"), F.array(F.struct(F.lit(False).alias("extra"), F.col("part").alias("part")), F.struct(F.lit(True).alias("extra"), F.col("target").alias("part"))))
                                             .otherwise(F.array(F.struct(F.lit(False).alias("extra"), F.col("part").alias("part"))))))
    placed = sent.select("to.part", "to.extra", F.col("id").isNotNull().alias("has"), "id", "tie", "_text")
    lined = placed.repartition(max(1, min(len(names) // 4, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part", "extra", "has", "id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_memory(f"sampler:{cfg}", lambda: Sampler(cfg))
        last: tuple | None = None  # (part, id, text) of a row that waits for its follower

        def rows_of(pairs: list[tuple]) -> pa.RecordBatch:
            own = [p[1] for p in pairs]
            nexts = [p[2] for p in pairs]
            edited = [edited_text(a, b) for a, b in zip(own, nexts)]
            # nearly all following texts are the own texts of the next rows
            apart = [i for i, b in enumerate(nexts) if i + 1 == len(own) or own[i + 1] != b]
            made = sampler([*own, *edited, *[nexts[i] for i in apart]])
            f_own, f_edit, f_next = made[: len(own)], made[len(own) : 2 * len(own)], made[1 : len(own) + 1]
            for i, f in zip(apart, made[2 * len(own) :]):
                f_next[i] = f
            return pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]), pa.array([f.hex() for f in f_own]), pa.array([f.hex() for f in f_edit]),
                pa.array([likeness(a, b) for a, b in zip(f_own, f_edit)]), pa.array([likeness(a, b) for a, b in zip(f_own, f_next)])],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        pairs: list[tuple] = []
        for b in slices(batches, "_text", 1 << 20):
            for part, extra, doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist()):
                t = t or ""
                if last is not None and last[0] == part:
                    pairs.append((last[1], last[2], t))
                last = None if extra else (part, doc_id, t)
            if pairs:
                yield rows_of(pairs)
                pairs = []

    return lined.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
