"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoder stores one number: the last token of the prefix's encoding. That
token is unique, because a token sequence is the encoding of its bytes exactly when every two neighbours are the
encoding of theirs; so the token that ends a prefix is the one that may follow the stored last token of the
shorter prefix. A stored table therefore serves appends (go on from its end) and edits (keep it up to the edit)
without encoding the untouched part again: ``Prefix.append`` and ``Prefix.edit``.

A text is cut by the tokenizer's pattern and every match is encoded alone; a match that is a token itself is
that token. Null and empty texts have no ids and decode to the empty string. Texts of any length are encoded
whole; matches of any length take time linear in their bytes. Decoding is the concatenation of token bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import SegmentIds, slices, table, worker_memory

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 400_000
# Unicode White_Space, which the rank files' own library means by \s; Python's \s holds four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Prefix tables over one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a single byte, None if merges never make it."""
        if token not in self._parts:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                self._parts[token] = (-1, -1)
            else:
                row = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
                while len(row) > 2:  # the lowest merge first, the leftmost of equals
                    best = min(((self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token), i) for i, (a, b) in enumerate(zip(row, row[1:]))))
                    if best[0] >= token:
                        break
                    row[best[1] : best[1] + 2] = [best[0]]
                self._parts[token] = (row[0], row[1]) if len(row) == 2 else None
        return self._parts[token]

    def _edge(self, token: int, side: int) -> tuple[tuple[bytes, int], ...]:
        """The tokens that stood at one side of this token while it was merged (their bytes), each with the rank
        of the merge that ended it; the token itself was not ended. Empty if merges never make this token."""
        out, end = [], 1 << 62
        while token >= 0:
            parts = self.parts(token)
            if parts is None:
                return ()
            out.append((self.bytes_of[token], end))
            end, token = token, parts[side]
        return tuple(out)

    def follows(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of the bytes of a and b: no merge across the border comes first."""
        right, left = self._right.get(a), self._left.get(b)
        if right is None:
            right = self._right[a] = self._edge(a, 1)
        if left is None:
            left = self._left[b] = self._edge(b, 0)
        if not right or not left:
            return False
        get = self.ranks.get
        for x, x_end in right:
            for y, y_end in left:
                across = get(x + y)
                # a merge inside a lies further left, so it wins a tie; one inside b loses it
                if across is not None and across < x_end and across <= y_end:
                    return False
        return True

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill the table ``last`` (last token of each non-empty prefix) up to the end of ``data``."""
        get, longest, follows = self.ranks.get, self.longest, self.follows
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and (follows(last[start - 1], token) if start else self.parts(token) is not None):
                    last.append(token)
                    break
            else:
                raise ValueError("the rank file does not hold every single byte")

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(data, last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefix:
    """A byte string with its prefix table; appends and edits reuse the table up to the first changed byte."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, []
        encoder.extend(data, self.last)

    def append(self, more: bytes) -> Prefix:
        self.data += more
        self.encoder.extend(self.data, self.last)
        return self

    def edit(self, start: int, end: int, put: bytes) -> Prefix:
        """Replace data[start:end]; prefixes that end at or before ``start`` keep their entries, and behind the
        edit the table is refilled until it agrees with the old one over a token's length, then copied."""
        old, shift = self.last, len(put) - (end - start)
        self.data = self.data[:start] + put + self.data[end:]
        self.last = old[:start]
        agree, longest = 0, self.encoder.longest
        for at in range(start, len(self.data)):
            self.encoder.extend(self.data[: at + 1] if at + 1 < len(self.data) else self.data, self.last)
            if at >= start + len(put):
                agree = agree + 1 if old[at - shift] == self.last[at] else 0
                if agree >= longest:
                    self.last += old[at - shift + 1 :]
                    break
        return self

    def ids(self) -> list[int]:
        return self.encoder.walk(self.data, self.last)


class Blocks:
    """The same prefix tables for many short byte strings side by side, in numpy: one step fills the entry of one
    prefix length for all of them. Substrings are known by a polynomial hash of 64 bits."""

    LONGEST = 64

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        size = max(encoder.bytes_of) + 1
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(2 * encoder.longest + self.LONGEST, self.base)].astype(np.uint64))
        self.length = np.zeros(size, dtype=np.int64)
        self.hash = np.zeros(size, dtype=np.uint64)
        for token, data in encoder.bytes_of.items():
            h = 0
            for byte in data:
                h = (h * int(self.base) + byte + 1) % 2**64
            self.length[token], self.hash[token] = len(data), h
        self.bits = 19
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        for token in encoder.bytes_of:
            at = int(self._slot(self.hash[token : token + 1])[0])
            while self.values[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.values[at] = self.hash[token], token
        edges = [[encoder._edge(t, side) if t in encoder.bytes_of else () for t in range(size)] for side in (1, 0)]
        self.made = np.array([len(e) > 0 for e in edges[0]])
        # edges[side]: (token, rank of the merge that ended it) by depth, -1 behind the last
        self.edges = []
        for rows in edges:
            depth = max(map(len, rows))
            tok, end = np.full((depth, size), -1, dtype=np.int64), np.full((depth, size), -1, dtype=np.int64)
            for t, row in enumerate(rows):
                for d, (data, e) in enumerate(row):
                    tok[d, t], end[d, t] = encoder.ranks[data], e
            self.edges.append((tok, end))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Token of each hash, or -1."""
        at = self._slot(h)
        out = self.values[at]
        miss = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        out[miss] = -1
        while len(miss):
            at[miss] = (at[miss] + 1) % len(self.keys)
            got = self.values[at[miss]]
            hit = (self.keys[at[miss]] == h[miss]) & (got >= 0)
            out[miss[hit]] = got[hit]
            miss = miss[~hit & (got >= 0)]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = self.made[a] & self.made[b]
        (right, right_end), (left, left_end) = self.edges
        for i in range(len(right)):
            rows = np.flatnonzero(good & (right[i][a] >= 0))
            if not len(rows):
                break
            x, x_end = right[i][a[rows]], right_end[i][a[rows]]
            for j in range(len(left)):
                y = left[j][b[rows]]
                on = np.flatnonzero(y >= 0)
                if not len(on):
                    break
                if len(on) < len(rows):
                    rows, x, x_end, y = rows[on], x[on], x_end[on], y[on]
                across = self.find(self.hash[x] * self.power[self.length[y]] + self.hash[y])
                good[rows[(across >= 0) & (across < x_end) & (across <= left_end[j][b[rows]])]] = False
        return good

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as bytes) of strings of at most ``LONGEST`` bytes, by prefix tables alone."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        n, top = len(pieces), int(lens[0]) if len(pieces) else 0
        flat = np.frombuffer(b"".join([pieces[i] for i in order]), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(lens) - lens
        prefix = np.zeros((top + 1, n), dtype=np.uint64)
        last = np.full((top + 1, n), -1, dtype=np.int64)
        active = [int(np.searchsorted(-lens, -end, side="right")) for end in range(top + 1)]
        for end in range(1, top + 1):
            k = active[end]
            prefix[end, :k] = prefix[end - 1, :k] * self.base + flat[starts[:k] + end - 1]
        for end in range(1, top + 1):
            k = active[end]
            widths = range(min(end, self.encoder.longest), 0, -1)
            tokens = np.stack([self.find(prefix[end, :k] - prefix[end - w, :k] * self.power[w]) for w in widths])
            rows = np.arange(k)
            for _ in widths:  # each row tries its widest token left
                pick = (tokens[:, rows] >= 0).argmax(axis=0)
                token = tokens[pick, rows]
                width = min(end, self.encoder.longest) - pick
                before = last[end - width, rows]
                good = np.where(before >= 0, self.follows(np.maximum(before, 0), np.maximum(token, 0)), (width == end) & self.made[token]) & (token >= 0)
                last[end, rows[good]] = token[good]
                tokens[pick, rows] = -1
                rows = rows[~good]
                if not len(rows):
                    break
        out: list[bytes] = [b""] * n
        count = np.zeros(n, dtype=np.int64)
        ids = np.zeros((n, top), dtype="<u4")  # filled from the right
        end = lens.copy()
        rows = np.arange(n)
        while len(rows := rows[end[rows] > 0]):
            token = last[end[rows], rows]
            count[rows] += 1
            ids[rows, top - count[rows]] = token
            end[rows] -= self.length[token]
        data, width = ids.tobytes(), 4 * top
        for k, (i, c) in enumerate(zip(order.tolist(), count.tolist())):
            out[i] = data[(k + 1) * width - 4 * c : (k + 1) * width]
        return out


class TextEncoder:
    """Whole texts through the pattern, each match by the prefix tables (see ``SegmentIds`` for what is kept)."""

    def __init__(self, encoder: Encoder, pattern: str, blocks: Blocks | None = None):
        self.encoder, self.blocks = encoder, blocks or Blocks(encoder)
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.pieces: dict[str, bytes] = {}
        self.segments = SegmentIds(self._segments, self._text)

    def _learn(self, found: list[str]) -> None:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        new = [p for p in set(found) if p not in self.pieces]
        short: list[tuple[str, bytes]] = []
        for piece in new:
            data = piece.encode("utf-8")
            token = self.encoder.ranks.get(data)
            if token is not None:
                self.pieces[piece] = token.to_bytes(4, "little")
            elif len(data) > Blocks.LONGEST:
                self.pieces[piece] = np.array(self.encoder.encode_piece(data), dtype="<u4").tobytes()
            else:
                short.append((piece, data))
        for at in range(0, len(short), 40_000):
            part = short[at : at + 40_000]
            self.pieces.update(zip([p for p, _ in part], self.blocks.encode([d for _, d in part])))

    def _text(self, text: str) -> bytes:
        found = self.find(text)
        self._learn(found)
        return b"".join(map(self.pieces.__getitem__, found))

    def _segments(self, segments: list[str]) -> list[bytes]:
        """All segments in one run of the pattern: behind the first of them, only a segment's start is a space."""
        inner = [s for s in segments if s[:1] == " "]
        lone = {s: self.find(s) for s in segments if s[:1] != " "}
        matches = self.find("".join(inner))
        self._learn(matches + [m for found in lone.values() for m in found])
        get = self.pieces.__getitem__
        at = [i for i, m in enumerate(matches) if m[0] == " "] + [len(matches)]
        inner_ids = iter([b"".join(map(get, matches[i:j])) for i, j in zip(at, at[1:])])
        return [next(inner_ids) if s[:1] == " " else b"".join(map(get, lone[s])) for s in segments]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return self.segments(texts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.segments([text])[0], dtype="<u4").tolist()


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every whole text. ``path`` is the rank file on the executors."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(f"bpe:{path}:{pattern}", lambda: TextEncoder(Encoder(load_ranks(path)), pattern))
        for b in slices(batches, "_text"):
            data = coder.encode_many(b.column(len(keep)).to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in data])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], ids], [*keep, "ids"])

    return source.mapInArrow(run, schema)


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id, null for a number that is none."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for data, token in ranks.items():
        out[token] = data
    return pa.array(out, pa.binary())


def joined(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids, one after the other."""
    data = tokens.take(ids.flatten())
    if data.null_count:
        raise ValueError("an id that is not in the rank file")
    ends = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]
    places = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset :] if len(data) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places[ends].astype(np.int32).tobytes()), data.buffers()[2] or pa.py_buffer(b"")])


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary), the bytes of the ids. A null list decodes to no bytes."""
    source = encoded.select(*keep, F.col("ids").alias("_ids"))
    schema = source.drop("_ids").schema.add("decoded", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_memory(f"bpe-bytes:{path}", lambda: token_bytes(load_ranks(path)))
        for b in slices(batches, "_ids"):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], joined(tokens, b.column(len(keep)))], [*keep, "decoded"])

    return source.mapInArrow(run, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    ids = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    back = decode(ids, path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
