"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Positions are put into buckets by the q-gram that starts there and buckets are refined by the bucket identifiers
of later offsets, used recursively: the identifier of 2L bytes is made of those of the L bytes here and L bytes
further on, up to the strings of ``Config.length`` bytes. A position whose bucket holds nothing else is settled
and goes no further. An identifier is a 64-bit name computed from the bytes alone, the same in every task, so
sorting one bucket needs no other.

To keep the work below one row per byte, positions are refined in runs. Every string of 400 bytes has an anchor:
its smallest 64-gram (the leftmost of equals). Neighbouring strings with one anchor form a run, about 170 long.
Equal strings have equal anchors at equal distances, so a run can only meet runs with the same anchor bucket:
  * the whole stretch of a run occurs twice: all its strings are repeated;
  * the bytes that all strings of a node share occur in this stretch alone: nothing more is to be found;
  * otherwise the run is refined: split by distance from the anchor into nodes of 42, 6 and at last 1 strings,
    whose shared bytes (buckets) are longer each time and are whole strings in the end.
Each step groups rows by (bucket, stretch) with partial counts, so a passage that a third of all texts share
reaches the reducers as a few counts. Nothing is capped and no pair is formed.

Texts are UTF-8 bytes; null counts as empty (nothing to remove). Rows with equal id and text are two
occurrences. A stretch is compared by its 64-bit name together with that of its bucket, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import row_key, saved, scramble, slices, table

GRAM = 64


@dataclass(frozen=True)
class Config:
    length: int = 400
    widths: tuple[int, ...] = (42, 6, 1)  # strings in a node, each a divisor of the one before
    block: int = 1 << 19  # strings of one text handled at a time


class Names:
    """Identifiers of all substrings of at least ``GRAM`` bytes of a buffer, from those of power-of-two lengths."""

    def __init__(self, data: np.ndarray, longest: int):
        ids = data.astype(np.uint64) + np.uint64(1)
        size = 1
        while size < 8:  # up to 8 bytes an identifier can simply hold the bytes
            ids = (ids[:-size] << np.uint64(8 * size)) | ids[size:] if len(ids) > size else ids[:0]
            size *= 2
        self.by_size: dict[int, np.ndarray] = {}
        while True:
            if size >= GRAM:
                self.by_size[size] = ids
            if 2 * size > longest:
                break
            ids = _join(ids[:-size], ids[size:]) if len(ids) > size else ids[:0]
            size *= 2

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Identifier of data[start : start + length] for each row."""
        out = np.zeros(len(start), dtype=np.uint64)
        size = GRAM
        while size in self.by_size:
            ids = self.by_size[size]
            on = np.flatnonzero((length >= size) & ((length < 2 * size) if 2 * size in self.by_size else True))
            s, n = start[on], length[on]
            out[on] = _join(ids[s], ids[s + n - size] + scramble(n.astype(np.uint64)))
            size *= 2
        return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    extra = width - size
    return np.minimum(v[: len(v) - extra], v[extra:]) if extra else v


def runs_of(pieces: list[bytes], cfg: Config) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor. ``pieces``: byte strings, together below 2**22 bytes.
    Returns (piece, first position, strings, distance of the first from the anchor, bucket, stretch)."""
    spread = cfg.length - GRAM + 1
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces) + bytes(spread), dtype=np.uint8)
    starts = np.cumsum(lens) - lens
    names = Names(data, cfg.length + spread)
    grams = names.by_size[GRAM]
    bits = np.uint64(22)
    place = np.arange(len(grams), dtype=np.uint64)
    low = _slide_min(((scramble(grams) >> bits) << bits) | place, spread)
    use = lens >= cfg.length
    count = np.where(use, lens - cfg.length + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), count)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    anchor = (low[pos] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, np.int64)
    n = np.diff(np.r_[head, len(owner)])
    first, anchor = pos[head], anchor[head]
    far = anchor - first
    stretch = _join(names.of(first, n + cfg.length - 1), scramble(far.astype(np.uint64)))
    return owner[head], first - starts[owner[head]], n, far, grams[anchor], stretch


def nodes_of(rid: np.ndarray, data: list[bytes], far: np.ndarray, node_from: np.ndarray, node_to: np.ndarray,
             part: np.ndarray, width: int, cfg: Config) -> tuple[np.ndarray, ...]:
    """Split node rows by distance into nodes of ``width``. ``data[i]`` is the stretch of run i, whose first
    string lies ``far[i]`` before the anchor; a row is (its run ``part``, smallest and largest distance).
    Returns (rid, from, to, bucket, stretch)."""
    low, high = node_from // width, node_to // width
    n = high - low + 1
    row = np.repeat(np.arange(len(part)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    a, b = np.maximum(node_from[row], k * width), np.minimum(node_to[row], (k + 1) * width - 1)
    lens = np.array([len(d) for d in data], dtype=np.int64)
    starts = np.cumsum(lens) - lens
    names = Names(np.frombuffer(b"".join(data), dtype=np.uint8), cfg.length + cfg.widths[0])
    run = part[row]
    zero = starts[run] + far[run]  # the anchor
    near = np.maximum(k * width, 0)
    # bytes shared by all strings of the whole node: they lie inside each of its strings
    bucket = _join(names.of(zero - near, np.full(len(row), cfg.length - width + 1)), scramble((k + 1000 * width).astype(np.uint64)))
    stretch = _join(names.of(zero - b, b - a + cfg.length), scramble((b + 1000 * width).astype(np.uint64)))
    return rid[run], a, b, bucket, stretch



def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _decide(rows: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose stretch occurs twice, and the rows to refine: of every bucket that holds a single stretch beside
    others, one row for each stretch (a single one may still share strings with a repeated one)."""
    pair = rows.groupBy("bucket", "stretch").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in carry])
    pair = saved(pair, "suffix-pairs")
    many = pair.where("copies > 1").select("bucket", "stretch")
    mixed = (pair.groupBy("bucket").agg(F.count(F.lit(1)).alias("stretches"), F.min("copies").alias("least"))
             .where("stretches > 1 and least = 1").select("bucket"))
    twice = rows.join(many, ["bucket", "stretch"], "left_semi").select(*carry)
    still = pair.join(mixed, "bucket", "left_semi").select(*carry)
    return twice, still


def repeated_spans(docs: DataFrame, cfg: Config = Config(), text: str = "text") -> DataFrame:
    """(k, pos, n): n strings of ``cfg.length`` bytes from byte ``pos`` on occur elsewhere; k is ``row_key``
    of the rows (``doc_id`` and text), equal for repeated rows."""
    source = docs.select(row_key("doc_id", text).alias("k"), F.col(text).alias("_text")).where(F.octet_length("_text") >= cfg.length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            pieces, at = [], []
            size = 0

            def out() -> pa.RecordBatch:
                owner, pos, n, far, bucket, stretch = runs_of(pieces, cfg)
                keys = np.array([x for x, _ in at], dtype=np.int64)[owner]
                base = np.array([x for _, x in at], dtype=np.int64)[owner]
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pos + base), pa.array(n.astype(np.int32)), pa.array(far.astype(np.int32)),
                                                   _signed(bucket), _signed(stretch)], ["k", "pos", "n", "far", "bucket", "stretch"])

            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = t.encode("utf-8")
                for i in range(0, max(1, len(data) - cfg.length + 1), cfg.block):  # blocks of strings, not of bytes
                    piece = data[i : i + cfg.block + cfg.length - 1]
                    if pieces and size + len(piece) > 1 << 20:
                        yield out()
                        pieces.clear()
                        at.clear()
                        size = 0
                    pieces.append(piece)
                    at.append((k, i))
                    size += len(piece)
            if pieces:
                yield out()

    runs = saved(source.mapInArrow(scan, "k long, pos long, n int, far int, bucket long, stretch long"), "suffix-runs")
    twice, still = _decide(runs, ["k", "pos", "n", "far"])
    found = [saved(twice.select("k", "pos", "n"), "suffix-spans")]
    contexts = saved(_contexts(source, saved(still, "suffix-open"), cfg), "suffix-contexts")
    nodes = contexts.select("rid", (F.col("far") - F.col("n") + 1).alias("a"), F.col("far").alias("b"))
    for width in cfg.widths:
        twice, still = _decide(_split(contexts, nodes, width, cfg), ["rid", "a", "b"])
        where = contexts.select("rid", "k", "pos", "far")
        spans = twice.join(where, "rid").select("k", (F.col("pos") + F.col("far") - F.col("b")).alias("pos"), (F.col("b") - F.col("a") + 1).alias("n"))
        found.append(saved(spans, "suffix-spans"))
        if width > 1:
            nodes = saved(still, "suffix-open")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _contexts(source: DataFrame, still: DataFrame, cfg: Config) -> DataFrame:
    """The bytes of every open run: (rid, k, pos, n, far, data)."""
    lists = still.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "far"))).alias("open"))
    joined = source.join(lists, "k").select("k", "_text", F.col("open.pos").alias("p"), F.col("open.n").alias("n"), F.col("open.far").alias("f"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 4 << 20):
            cols: list[list] = [[], [], [], [], []]
            for k, t, ps, ns, fs in zip(*[c.to_pylist() for c in b.columns]):
                data = t.encode("utf-8")
                for p, n, f in zip(ps, ns, fs):
                    for col, x in zip(cols, (k, p, n, f, data[p : p + n + cfg.length - 1])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["k", "pos", "n", "far", "data"])

    return joined.mapInArrow(cut, "k long, pos long, n int, far int, data binary").select(
        F.xxhash64("k", "pos").alias("rid"), "k", "pos", "n", "far", "data")


def _split(contexts: DataFrame, nodes: DataFrame, width: int, cfg: Config) -> DataFrame:
    """Rows (rid, a, b, bucket, stretch) of the open nodes cut to ``width``."""
    lists = nodes.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("open"))
    joined = contexts.join(lists, "rid").select("rid", "far", "data", F.col("open.a").alias("a"), F.col("open.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", 1 << 20):
            rid, far = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            lists_a, lists_b = b.column(3).to_pylist(), b.column(4).to_pylist()
            part = np.repeat(np.arange(len(rid)), [len(x) for x in lists_a])
            a = np.array([x for xs in lists_a for x in xs], dtype=np.int64)
            z = np.array([x for xs in lists_b for x in xs], dtype=np.int64)
            r, lo, hi, bucket, stretch = nodes_of(rid, b.column(2).to_pylist(), far, a, z, part, width, cfg)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), _signed(bucket), _signed(stretch)],
                                             ["rid", "a", "b", "bucket", "stretch"])

    return saved(joined.mapInArrow(run, "rid long, a int, b int, bucket long, stretch long"), "suffix-nodes")


def removed(docs: DataFrame, cfg: Config = Config(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes, ``spans`` (array of [from, to) byte ranges removed, maximal and in order) and
    ``kept`` (binary, the remaining bytes) for every row."""
    spans = repeated_spans(docs, cfg, text)
    lists = spans.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("found"))
    source = docs.select(row_key("doc_id", text).alias("k"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    joined = source.join(lists, "k", "left").select(*[c for c in source.columns if c not in ("k", "_text")], "_text", F.col("found.pos").alias("p"), F.col("found.n").alias("n"))
    schema = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]).schema
    out_schema = schema.add("n_bytes", "long").add("spans", T.ArrayType(T.ArrayType(T.LongType()))).add("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 4 << 20):
            m = len(keep)
            sizes, all_spans, kept = [], [], []
            for t, ps, ns in zip(*[b.column(m + i).to_pylist() for i in range(3)]):
                data = (t or "").encode("utf-8")
                merged: list[list[int]] = []
                for p, n in zip(ps or [], ns or []):
                    end = p + n + cfg.length - 1
                    if merged and p <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([p, end])
                at, rest = 0, []
                for p, e in merged:
                    rest.append(data[at:p])
                    at = e
                rest.append(data[at:])
                sizes.append(len(data))
                all_spans.append(merged)
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                                             [*schema.names[:m], "n_bytes", "spans", "kept"])

    found = joined.mapInArrow(cut, out_schema)
    return found.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "kept")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = removed(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
