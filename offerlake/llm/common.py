"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.memory import give_back
from offerlake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # whole texts are long: smaller Arrow batches bound what a task and its Python worker hold at a time
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later plans start from files that
    every executor sees, so a lost executor costs the tasks it ran and no more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Equal for rows that hold the same id and the same text, which then share every result."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named string column of each slice stays near ``max_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(batch.num_rows * max_bytes / size))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    give_back()


def gathered(batches: Iterable[pa.RecordBatch], column: str, rows: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``rows`` rows made of smaller ones, while the named column stays near ``max_bytes``."""
    held, n, size = [], 0, 0
    for batch in slices(batches, column, max_bytes):
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.column(batch.schema.get_field_index(column)).nbytes
        if n >= rows or size >= max_bytes:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def entries(names: pa.Array) -> list[bytes]:
    """The entries of a string or binary array without nulls as bytes."""
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1].tolist()
    data = memoryview(names.buffers()[2])[ends[0] : ends[-1]].tobytes() if names.buffers()[2] and ends else b""
    base = ends[0] if ends else 0
    return [data[a - base : b - base] for a, b in zip(ends, ends[1:])]


def first_pairs(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) of a batch in the order in which they first occur, and their counts; both are numbers
    from 0, the texts' ascending."""
    n = len(word)
    if not n:
        return text, word, np.zeros(0, dtype=np.int64)
    word_bits, bits = int(word.max()).bit_length(), n.bit_length()
    both = np.sort((text << word_bits | word) << bits | np.arange(n))
    begin = np.flatnonzero(np.r_[True, both[1:] >> bits != both[:-1] >> bits])
    heads, count = both[begin], np.diff(np.r_[begin, n])
    place = np.full(n, -1)
    place[heads & ((1 << bits) - 1)] = np.arange(len(heads))
    order = place[place >= 0]
    pair = heads[order] >> bits
    return pair >> word_bits, pair & ((1 << word_bits) - 1), count[order]


_P = np.uint64(0x100000001B3)


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (xor-shift and odd multiplications), element by element."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def char_grams(words: list[str], inner: range, edge: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of marked words ``<word>``: of the lengths ``inner`` anywhere, of the lengths
    ``edge`` at the word's ends only, and the whole word. Returns (bucket of each gram, index of its word)."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(codes)) - starts[owner]
    left = lens[owner] - place  # characters from here to the end of the word
    power = np.cumprod(np.full(int(lens.max()), _P, dtype=np.uint64))
    whole = np.add.reduceat(codes * power[place], starts)
    rows, owners = [scramble(whole ^ np.uint64(0x5DEECE66D))], [np.arange(len(words))]
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max([*inner, *edge]) + 1):
        h = h[: len(codes) - n + 1] * _P + codes[n - 1 :]
        m = len(h)
        if n in inner:
            at = left[:m] >= n
        elif n in edge:
            at = (left[:m] == n) | ((place[:m] == 0) & (left[:m] >= n))
        else:
            continue
        at = np.flatnonzero(at)
        rows.append(scramble(h[at] + np.uint64(n * 0xD1B54A32D192ED03 % 2**64)))
        owners.append(owner[at])
    return (np.concatenate(rows) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


def worker_memory(name: str, make):
    """What a Python worker keeps between the tasks it runs (it may be lost at any time): made at first use."""
    import sys
    import types

    kept = sys.modules.setdefault("_offerlake_worker_memory", types.ModuleType("_offerlake_worker_memory"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


MARKS = ".,;:!?%&$#*|)"


class SegmentIds:
    """Token ids of whole texts from the ids of their space-separated segments, which repeat a lot.

    A segment may be encoded alone where the tokenizer's pattern is sure to cut at its leading space: it is not
    empty and no other white space touches the space on either side. A text with any other segment is encoded in
    one piece. Ids are held as little-endian unsigned 32-bit bytes; a bounded number of segments is kept.

    ``encode_segments``: list of segments -> list of id bytes; ``encode_text``: whole text -> id bytes.
    """

    def __init__(self, encode_segments, encode_text, whole=None, keep: int = 800_000):
        self.encode_segments, self.encode_text, self.whole, self.keep = encode_segments, encode_text, whole, keep
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        get, out, open_texts, new = known.get, [], [], set()
        for i, text in enumerate(texts):
            if not text or (self.whole and self.whole in text):
                out.append(self.encode_text(text) if text else b"")
                continue
            first, *rest = text.split(" ")
            parts = [first, *[" " + p for p in rest]]
            ids = list(map(get, parts))
            try:
                out.append(b"".join(ids))
            except TypeError:
                new.update([p for p, x in zip(parts, ids) if x is None])
                out.append(b"")
                open_texts.append((i, parts, ids))
        touched = [p for p in new if self._touched(p)]
        known.update(dict.fromkeys(touched, False))
        new.difference_update(touched)
        # a word and the marks behind it are matched apart by the pattern, so each is encoded once
        marked = [(p, core, p[len(core):]) for p in new if len(core := p.rstrip(MARKS)) < len(p) and core[-1:].isalpha()]
        new.difference_update([p for p, _, _ in marked])
        new.update([x for _, core, tail in marked for x in (core, tail) if x not in known])
        listed = list(new)
        known.update(zip(listed, self.encode_segments(listed)))
        known.update([(p, known[core] + known[tail]) for p, core, tail in marked])
        for i, parts, ids in open_texts:
            try:
                out[i] = b"".join([get(p) if x is None else x for p, x in zip(parts, ids)])
            except TypeError:  # a segment that may not stand alone
                out[i] = self.encode_text(texts[i])
        return out

    @staticmethod
    def _touched(segment: str) -> bool:
        """Whether the space before or behind the segment touches other white space."""
        part = segment[1:] if segment[:1] == " " else segment
        return bool(segment) and (not part or part[0].isspace() or part[-1].isspace())


_LETTER, _DIGIT, _MARK, _BLANK = 1, 2, 3, 4  # ASCII classes; 0: control characters and bytes of other characters
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _MARK
for _a, _b, _c in ((48, 58, _DIGIT), (65, 91, _LETTER), (97, 123, _LETTER), (9, 14, _BLANK), (32, 33, _BLANK)):
    _CLASS[_a:_b] = _c


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level tokenizers (contractions, letters, digits, other marks, each behind an optional space;
    white space) is sure to begin a match, whatever comes before: true at the first byte of such a match, for UTF-8 bytes of
    texts behind each other. Not every match: what depends on other characters than ASCII and a few blocks of letters stays
    together.

    A match holds white space only as its first character or alone, so one ends before white space that follows another
    character; behind a lone line end or tab (the pattern leaves a space to the next match, others not) the next one begins;
    letters, digits and marks share no match but in a contraction, which is a mark before letters.
    """
    n = len(data)
    # up to three bytes before each byte; in front of the first there is nothing
    before = [np.concatenate([np.zeros(k, dtype=np.uint8), data])[:n] for k in (1, 2, 3, 4)]
    now, last = _CLASS[data], _CLASS[before[0]]
    tail = before[0] & 0xC0 == 0x80
    two = tail & (before[1] >= 0xC3) & (before[1] <= 0xDF)  # characters of two bytes, none of them white space
    wide = tail & ((before[2] >= 0xE4) & (before[2] <= 0xEF) & (before[1] & 0xC0 == 0x80) | (before[3] >= 0xF0))
    full = (last > 0) & (last < _BLANK) | two | wide  # surely no white space
    cut = full & (now == _BLANK)
    letter = (last == _LETTER) | two & ((before[1] == 0xC4) | (before[1] == 0xC5) | (before[1] == 0xD0) | (before[1] == 0xD1)
                                        | (before[1] == 0xC3) & (before[0] != 0x97) & (before[0] != 0xB7))
    cut |= letter & ((now == _DIGIT) | (now == _MARK))
    cut |= (last == _DIGIT) & ((now == _LETTER) | (now == _MARK))
    cut |= (last == _MARK) & ((now == _DIGIT) | (now == _LETTER) & (before[0] != 39))
    solid = (now > 0) & (now < _BLANK) | (data >= 0xC3) & (data <= 0xDF) | (data >= 0xE4)
    lone = np.concatenate([[False], cut[:-1]])[:n]
    cut |= lone & (last == _BLANK) & (before[0] != 32) & solid
    return cut


class PieceIds:
    """Token ids of whole texts from the ids of their pieces between ``sure_cuts``, which repeat a lot.

    The pieces of a batch of texts are made distinct and put together again as Arrow arrays; what is done in Python is done
    once for each distinct piece of a batch. Ids are held as little-endian unsigned 32-bit bytes. A bounded number of pieces is
    kept in two generations: the older one goes when the younger is full, but for what was met again.

    ``encode_pieces``: list of pieces -> list of id bytes; ``encode_text``: whole text -> id bytes, for a text with ``whole``.
    """

    def __init__(self, encode_pieces, encode_text, whole: str, keep: int = 800_000):
        self.encode_pieces, self.encode_text, self.whole, self.keep = encode_pieces, encode_text, whole, keep
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.young) > self.keep // 2:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        held = [(i, self.old.get(pieces[i])) for i in missing]
        new = [i for i, x in held if x is None]
        made = self.encode_pieces([pieces[i].decode("utf-8") for i in new])
        for i, x in [*[h for h in held if h[1] is not None], *zip(new, made)]:
            found[i] = self.young[pieces[i]] = x
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lone = pc.match_substring(texts, self.whole).to_numpy(zero_copy_only=False)
        if lone.any():
            apart = {int(i): self.encode_text(texts[int(i)].as_py()) for i in np.flatnonzero(lone)}
            texts = pc.if_else(pa.array(lone), "", texts)
        else:
            apart = {}
        if not len(texts):
            return []
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        ends, at = ends - ends[0], int(ends[0])
        size = int(ends[-1])
        out = [b""] * len(texts)
        if size:
            held = texts.buffers()[2].slice(at, size)
            cut = sure_cuts(np.frombuffer(held, np.uint8))
            cut[ends[:-1][ends[:-1] < size]] = True
            starts = np.append(np.flatnonzero(cut), size).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), held]).dictionary_encode()
            names, spelled = pieces.dictionary, pieces.dictionary.buffers()[2].to_pybytes()
            edges = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].tolist()
            ids = pa.array(self._ids([spelled[a:b] for a, b in zip(edges, edges[1:])]), pa.binary()).take(pieces.indices)
            places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            bounds = places[np.searchsorted(starts, ends)].tolist()
            data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else b""
            out = [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        for i, x in apart.items():
            out[i] = x
        return out
