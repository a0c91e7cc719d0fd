"""Phrase collocations counted in counting quotient filters.

1. ``chunks``: tasks split whole texts into pieces and words and write, for bounded runs of tokens, the tokens as local
   numbers beside a dictionary of the (lang, word) pairs in the run with their counts.
2. ``vocabulary``: the dictionaries add up to exact word counts. Every word of a phrase seen ``least`` times is itself seen
   as often, so only such words get an id (dense, from 1); any other word ends a phrase like a piece does, and no count
   of a candidate changes.
3. ``filters``: each run's tokens become ids; pairs and triples of neighbours are packed, an invertible Feistel permutation
   scatters the packed bits, and the first bits name a part of the value range, the next ones are the quotient and all the
   others the remainder, so nothing is lost. A task counts many runs in one sorted pass and writes a filter for each part.
4. ``counts``: a part's filters, sorted alike whatever their size, are merged; entries that reach ``least`` are permuted back.
   The number of parts follows from the number of tokens, so a part holds about ``Config.part`` occurrences at any size.
5. Cuts, scores and the rule on longer phrases are joins of the candidates; arithmetic is on integers of 38 digits.

The filter (``QuotientFilter``) holds occupied and run-end bits and slots at or behind their quotient; a count above one
follows its remainder as digits in slots of its own, marked in a third bit vector.

Every count is combined in the task that saw it, so a word, phrase or language that holds a third of the corpus reaches a
reducer as one entry for each task. The list of a language is cut to its first rows within hash groups before the last
window, which then sees at most groups x top rows. Bound: a count times itself stays below 10**32.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count each; ties as the contract orders them;
without a candidate the result is empty; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.llm.common import give_back, saved, scramble, slices, table
from offerlake.operators.ranking import global_rank
from offerlake.session import ship_by_value

ship_by_value(__name__)

# fixed values of the contract
BREAKS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    least: int = 10  # occurrences of a candidate
    cover: int = 50  # percent of a candidate's occurrences inside a longer candidate that drop it
    top: int = 2000  # rows for each language
    chunk: int = 1 << 20  # tokens in a run (a longer text is one run)
    batch: int = 1 << 21  # occurrences that a task counts in one pass, about
    part: int = 1 << 19  # occurrences of a part of the value range
    groups: int = 64  # hash groups of a language before its last window


# ---- counting quotient filter


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, as a matrix of bits."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]


def _unpack(bits: np.ndarray) -> np.ndarray:
    full = np.zeros((len(bits), 64), dtype=np.uint8)
    full[:, 64 - bits.shape[1] :] = bits
    return np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)


class QuotientFilter:
    """Sorted distinct values of ``high_bits + low_bits`` bits with counts. The quotient is the first ``q`` bits of the high
    part; what remains of it and the low part are the remainder, kept whole. As bytes only used slots are written: the run
    ends tell which they are."""

    DIGIT = 16  # bits of a count's digit, fewer where a remainder has fewer

    def __init__(self, q: int, high_bits: int, low_bits: int, occupied, runends, digits, slots):
        self.q, self.high_bits, self.low_bits = q, high_bits, low_bits
        self.occupied, self.runends, self.digits, self.slots = occupied, runends, digits, slots

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, high_bits: int, low_bits: int) -> QuotientFilter:
        """From values in ascending order of (high, low)."""
        width = high_bits + low_bits
        n_digits = np.zeros(len(high), dtype=np.int64)  # a count c above 1 is c in base 2**base
        base = min(cls.DIGIT, low_bits)
        rest = np.where(counts > 1, counts, 0)
        while rest.any():
            n_digits += rest > 0
            rest = rest >> base
        used = int(len(high) + n_digits.sum())
        q = min(high_bits, max(0, int(np.ceil(np.log2(max(1, used) / 0.95)))))
        quotient = (high >> np.uint64(high_bits - q)).astype(np.int64)
        before = np.cumsum(1 + n_digits) - (1 + n_digits)
        at = before + np.maximum.accumulate(quotient - before) if len(high) else before
        n_slots = max(1 << q, int(at[-1] + 1 + n_digits[-1]) if len(high) else 0)
        occupied, runends, digits = np.zeros(1 << q, bool), np.zeros(n_slots, bool), np.zeros(n_slots, bool)
        occupied[quotient] = True
        last = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True)) if len(high) else np.zeros(0, np.int64)
        runends[(at + n_digits)[last]] = True
        high_rest = high & np.uint64((1 << (high_bits - q)) - 1)
        rem_bits = width - q
        slots = np.zeros((n_slots, rem_bits), dtype=np.uint8)
        if high_bits > q:
            slots[at, : high_bits - q] = _pack(high_rest, high_bits - q)
        slots[at, high_bits - q : rem_bits] = _pack(low, low_bits)
        rest, k = np.where(counts > 1, counts, 0), 0
        while rest.any():
            now = np.flatnonzero(rest)
            k += 1
            slots[at[now] + k, :base] = _pack((rest[now] & ((1 << base) - 1)).astype(np.uint64), base)
            digits[at[now] + k] = True
            rest = rest >> base
        return cls(q, high_bits, low_bits, occupied, runends, digits, slots)

    @staticmethod
    def _runs(occupied: np.ndarray, runends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occupied quotients, lengths of their runs, used slots)."""
        quotients, ends = np.flatnonzero(occupied), np.flatnonzero(runends)
        starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends)
        lens = ends - starts + 1
        return quotients, lens, np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, count), ascending."""
        quotients, lens, slot = self._runs(self.occupied, self.runends)
        quotient = np.repeat(quotients, lens)
        is_digit = self.digits[slot]
        head = np.flatnonzero(~is_digit)
        high_rest_bits = self.high_bits - self.q
        rows = self.slots[slot[head]]
        low = _unpack(rows[:, high_rest_bits : high_rest_bits + self.low_bits])
        high = quotient[head].astype(np.uint64) << np.uint64(high_rest_bits)
        if high_rest_bits:
            high |= _unpack(rows[:, :high_rest_bits])
        base = min(self.DIGIT, self.low_bits)
        counts = np.ones(len(head), dtype=np.int64)
        owner = np.cumsum(~is_digit) - 1
        tail = np.flatnonzero(is_digit)
        if len(tail):
            place = tail - head[owner[tail]] - 1
            value = _unpack(self.slots[slot[tail], :base]).astype(np.int64) << (place * base)
            counts[owner[tail]] = 0
            np.add.at(counts, owner[tail], value)
        return high, low, counts

    def to_bytes(self) -> bytes:
        used = self._runs(self.occupied, self.runends)[2]
        head = struct.pack("<BBBI", self.q, self.high_bits, self.low_bits, len(self.runends))
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runends, self.digits[used], self.slots[used].ravel()))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        q, high_bits, low_bits, n = struct.unpack_from("<BBBI", data)
        at = struct.calcsize("<BBBI")

        def bits(size: int) -> np.ndarray:
            nonlocal at
            out = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size)
            at += -(-size // 8)
            return out

        occupied, runends = bits(1 << q).astype(bool), bits(n).astype(bool)
        used = cls._runs(occupied, runends)[2]
        width = high_bits + low_bits - q
        digits, slots = np.zeros(n, dtype=bool), np.zeros((n, width), dtype=np.uint8)
        digits[used] = bits(len(used))
        slots[used] = bits(len(used) * width).reshape(len(used), width)
        return cls(q, high_bits, low_bits, occupied, runends, digits, slots)


def sum_sorted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in ascending order with their summed counts (of ones where ``counts`` is None)."""
    if not len(high):
        return high, low, np.zeros(0, dtype=np.int64)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    total = np.diff(np.append(first, len(high))) if counts is None else np.add.reduceat(counts[order], first)
    return high[first], low[first], total


def merge(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all filters together; equal values add up."""
    parts = [f.entries() for f in filters]
    return sum_sorted(*[np.concatenate([p[i] for p in parts]) for i in range(3)])


# ---- packed n-grams


@dataclass(frozen=True)
class Packing:
    """Three ids of ``width`` bits (0: none) in two halves of ``half`` bits, permuted by a Feistel network."""

    width: int
    prefix: int  # bits that name a part

    @property
    def half(self) -> int:
        return -(-3 * self.width // 2)

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spare = self.half - self.width  # bits of the middle id in the low half
        low = ((b & np.uint64((1 << spare) - 1)) << np.uint64(self.width)) | c
        high = (a << np.uint64(self.width - spare)) | (b >> np.uint64(spare))
        return self._rounds(high, low, (1, 2, 3))

    def unpack(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = self._rounds(low, high, (3, 2, 1))
        spare, one = self.half - self.width, np.uint64((1 << self.width) - 1)
        b = ((high << np.uint64(spare)) & one) | (low >> np.uint64(self.width))
        return high >> np.uint64(self.width - spare), b, low & one

    def _rounds(self, left: np.ndarray, right: np.ndarray, keys: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.half) - 1)
        for key in keys:
            left, right = right, left ^ (scramble(right + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        return left, right


# ---- tasks


CHUNKS = "chunk long, tokens binary, words array<struct<lang:string,word:string,n:long>>, sizes array<struct<lang:string,n:long>>"
_TABLE = bytes.maketrans(BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\xff" * len(BREAKS) + b"abcdefghijklmnopqrstuvwxyz")


class _Ids(dict):
    """Numbers from 1 in order of first use, shared by the languages of a run."""

    def __init__(self, listed: list, lang: str):
        super().__init__({b"\xff": 0})
        self.listed, self.lang = listed, lang

    def __missing__(self, word: bytes) -> int:
        self.listed.append((self.lang, word))
        self[word] = len(self.listed)
        return len(self.listed)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text in order, ``\\xff`` between pieces (it is in no UTF-8 text)."""
    return text.encode().translate(_TABLE).replace(b"\xff", b" \xff ").split()


def _chunks(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    listed, known, runs, held = [], {}, [], 0

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate(runs)
        counts = np.bincount(tokens, minlength=len(listed) + 1)[1:]
        langs = pa.array([lang for lang, _ in listed], pa.string())
        words = pa.array([w for _, w in listed], pa.binary()).cast(pa.string())
        structs = pa.StructArray.from_arrays([langs, words, pa.array(counts)], names=["lang", "word", "n"])
        sums: dict = {}
        for (lang, _), n in zip(listed, counts.tolist()):
            sums[lang] = sums.get(lang, 0) + n
        sizes = pa.array([[{"lang": k, "n": v} for k, v in sums.items()]], schema.field("sizes").type)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([tokens.tobytes()], pa.binary()),
                                           pa.ListArray.from_arrays([0, len(structs)], structs).cast(schema.field("words").type), sizes], schema=schema)

    for batch in slices(batches, "text", 4 << 20):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            ids = known.get(lang)
            if ids is None:
                ids = known[lang] = _Ids(listed, lang)
            tokens = words_of(text)
            tokens.append(b"\xff")
            runs.append(np.fromiter(map(ids.__getitem__, tokens), np.uint32, len(tokens)))
            held += len(tokens)
            if held >= size:
                yield flush()
                number, listed, known, runs, held = number + 1, [], {}, [], 0
    if runs:
        yield flush()


FILTERS = "part long, filter binary"


def _filters(batches: Iterator[pa.RecordBatch], packing: Packing, size: int) -> Iterator[pa.RecordBatch]:
    highs, lows, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        high, low, n = sum_sorted(np.concatenate(highs), np.concatenate(lows), None)
        rest = packing.half - packing.prefix
        part = (high >> np.uint64(rest)).astype(np.int64)
        high = high & np.uint64((1 << rest) - 1)
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for s in range(0, len(cuts) - 1, 64):
            ends = list(zip(cuts[s : s + 64], cuts[s + 1 : s + 65]))
            blobs = [QuotientFilter.of(high[i:j], low[i:j], n[i:j], rest, packing.half).to_bytes() for i, j in ends]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[i]) for i, _ in ends], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "filter"])

    for batch in batches:
        for row in range(batch.num_rows):
            tokens = np.frombuffer(batch.column("tokens")[row].as_py(), np.uint32)
            ids = batch.column("ids")[row].values
            if ids is None:
                continue
            lookup = np.zeros(int(tokens.max()) + 1, dtype=np.uint64)
            lookup[ids.field("local").to_numpy()] = ids.field("id").to_numpy().astype(np.uint64)
            t = lookup[tokens]
            two = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
            three = two[:-1][(np.diff(two) == 1)] if len(two) else two
            none = np.zeros(len(two), dtype=np.uint64)
            for a, b, c in ((t[two], t[two + 1], none), (t[three], t[three + 1], t[three + 2])):
                h, low = packing.pack(a, b, c)
                highs.append(h)
                lows.append(low)
                held += len(h)
            if held >= size:
                yield from flush()
                highs, lows, held = [], [], 0
    if held:
        yield from flush()
    give_back()


GRAMS = "a long, id1 long, id2 long, id3 long"


def _counts(batches: Iterator[pa.RecordBatch], packing: Packing, least: int) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def flush() -> pa.RecordBatch:
        high, low, n = merge(held)
        at = np.flatnonzero(n >= least)
        rest = packing.half - packing.prefix
        ids = packing.unpack(high[at] | (np.uint64(now) << np.uint64(rest)), low[at])
        return pa.RecordBatch.from_arrays([pa.array(n[at]), *[pa.array(x.astype(np.int64)) for x in ids]], names=["a", "id1", "id2", "id3"])

    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("filter")):
            if part != now and held:
                yield flush()
                held = []
            now = part
            held.append(QuotientFilter.from_bytes(blob.as_py()))
    if held:
        yield flush()
    give_back()


# ---- plan


def phrase_counts(docs: DataFrame, cfg: Config, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary(id, lang, word, f), sizes(lang, n), grams(id1, id2, id3, a)); id3 is 0 in a pair."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN)).alias("lang"))
    schema = to_arrow_schema(spark.createDataFrame([], CHUNKS).schema)
    size, least = cfg.chunk, cfg.least
    chunks = saved(texts.mapInArrow(lambda it: _chunks(it, size, schema), CHUNKS), "token-runs")
    sizes = chunks.select(F.inline("sizes")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = chunks.select("chunk", F.posexplode("words").alias("local", "w")).select("chunk", (F.col("local") + 1).alias("local"), "w.*")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    vocabulary = saved(global_rank(frequent, [F.col("lang").asc(), F.col("word").asc()], "id"), "vocabulary")
    n_words, n_tokens = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    width = max(2, int(n_words).bit_length())
    if width > 42:
        raise ValueError("more than 2**42 frequent words")
    packing = Packing(width, min(-(-3 * width // 2) - 1, max(0, int(2 * n_tokens // cfg.part).bit_length())))
    ids = (words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk")
           .agg(F.collect_list(F.struct("local", "id")).alias("ids")))  # a run's own words
    batch = cfg.batch
    filters = chunks.select("chunk", "tokens").join(ids, "chunk").select("tokens", "ids").mapInArrow(lambda it: _filters(it, packing, batch), FILTERS)
    filters = filters.repartition("part").sortWithinPartitions("part")
    grams = saved(filters.mapInArrow(lambda it: _counts(it, packing, least), GRAMS), "phrases")
    return vocabulary, sizes, grams


def collocations(docs: DataFrame, cfg: Config | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``cfg.top`` phrases of two and three words."""
    cfg = cfg or Config()
    vocabulary, sizes, grams = phrase_counts(docs, cfg, text_col, lang_col)

    def word(i: int) -> DataFrame:
        lang = [F.col("lang")] if i == 1 else []
        return vocabulary.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"), *lang)

    def score(left: str, right: str):
        a, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", left, right))
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r)

    pairs = grams.where("id3 = 0").drop("id3")
    triples = grams.where("id3 > 0")
    inside = triples.select("id1", "id2", "a").unionByName(triples.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))
    most = inside.groupBy("id1", "id2").agg(F.max("a").alias("most"))
    loose = pairs.join(most, ["id1", "id2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cfg.cover * F.col("a")))
    two = (loose.join(word(1), "id1").join(word(2), "id2").select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"),
                                                                  F.col("f2").alias("r"), score("f1", "f2").alias("score")))
    first = pairs.select("id1", "id2", F.col("a").alias("f12"))
    last = pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("f23"))
    three = (triples.join(first, ["id1", "id2"]).join(last, ["id2", "id3"]).join(word(1), "id1").join(word(2), "id2").join(word(3), "id3")
             .withColumns({"s1": score("f1", "f23"), "s2": score("f12", "f3")}))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = two.unionByName(three).withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(cfg.groups)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= cfg.top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= cfg.top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM lists),
runs AS (
  SELECT lang, word AS a, lead(word) OVER (PARTITION BY id ORDER BY pos) AS b, lead(word, 2) OVER (PARTITION BY id ORDER BY pos) AS c FROM words),
grams AS MATERIALIZED (
  SELECT lang, 1 AS k, a AS p, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM runs WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM runs WHERE c IS NOT NULL GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(p, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
inner_parts AS (
  SELECT lang, p, max(f) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS p, f FROM candidates WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM candidates WHERE k = 3) GROUP BY lang, p),
parts AS (
  SELECT lang, p, k, f AS a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM candidates, range(1, 3) cuts(cut) WHERE cut < k),
cuts AS (
  SELECT c.lang, c.p, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts c JOIN grams x ON x.lang = c.lang AND x.p = c.first AND x.k = c.cut JOIN grams y ON y.lang = c.lang AND y.p = c.rest AND y.k = c.k - c.cut),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
kept AS (
  SELECT b.*, b.p AS phrase FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p
  WHERE i.most IS NULL OR 100 * i.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, s.n::BIGINT AS n, k.score::BIGINT AS score
FROM ranked k JOIN sizes s USING (lang) WHERE k.rank <= 2000
"""
