"""Packing token ids into sequences of a fixed capacity by Karmarkar-Karp multiway differencing.

Every text becomes its token ids and one end id. Full capacities are cut off a long document and are sequences
of their own; its rest is cut into pieces of at most ``Config.piece`` ids. Rests are gathered into groups a few
ids per window short of ``Config.windows`` capacities (the last rest of a group goes on in the next one) and a
group's pieces are dealt to its windows: each piece begins as a partial partition of its own, and the two
partitions with the largest imbalance are merged again and again, largest sums onto smallest, so imbalances
cancel and the windows end nearly equal. If a window exceeds the capacity, the group is dealt again to one
window more. Every task packs the documents it reads, so nothing is shuffled and memory holds one group.

Null texts count as empty: the end id alone. Every id lies in exactly one piece. Sequence ids are unique over
all tasks; they and the pieces are the same whenever the same files are read with the same splits.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import PieceIds, slices, table, worker_memory

VOCABULARY = "byte_bpe_50k.json"
# A space and letters of the first blocks, which every version of Unicode has: one match of the pattern.
WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
# The letters in which byte-level vocabularies spell bytes that cannot be shown (a line end stays: it separates words here).
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN) if b != 10}


@dataclass(frozen=True)
class Config:
    capacity: int = 2048
    end_id: int = 1
    piece: int = 512
    windows: int = 32
    slack: int = 4  # ids by which a window of a full group stays short of its capacity on average


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items to ``windows`` sets with nearly equal sums; returns the item numbers of each set."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_sets = heapq.heappop(heap)  # sums in descending order
        _, tie, b, b_sets = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sets = [a_sets[k] + b_sets[windows - 1 - k] for k in order.tolist()]
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, sets))
    return heap[0][3] if heap else []


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that differencing fills without exceeding the capacity."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, n)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        n += 1


class Packer:
    """Rows (document number, start, length, sequence, offset) of documents given by their lengths, in order."""

    def __init__(self, cfg: Config):
        self.cfg = cfg
        self.sequence = 0
        self.held: list[tuple[int, int, int]] = []  # (document, start, length) of the open group
        self.total = 0

    def add(self, doc: int, length: int) -> list[tuple[int, int, int, int, int]]:
        cfg, out, start = self.cfg, [], 0
        while length - start >= cfg.capacity:
            out.append((doc, start, cfg.capacity, self.sequence, 0))
            self.sequence += 1
            start += cfg.capacity
        room = cfg.windows * (cfg.capacity - cfg.slack)
        while start < length:
            take = min(cfg.piece, length - start, room - self.total)
            self.held.append((doc, start, take))
            self.total += take
            start += take
            if self.total >= room:
                out += self.flush()
        return out

    def flush(self) -> list[tuple[int, int, int, int, int]]:
        out = []
        for members in windows_for([h[2] for h in self.held], self.cfg.capacity) if self.held else []:
            offset = 0
            for i in members:
                doc, start, length = self.held[i]
                out.append((doc, start, length, self.sequence, offset))
                offset += length
            self.sequence += 1
        self.held, self.total = [], 0
        return out


def tokenizer(path: str) -> PieceIds:
    """Ids of whole texts by the tokenizer file; its special string, if a text holds it, is left to the tokenizer."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    whole = Tokenizer.from_file(path)
    # the same merges behind a plain split, for words already spelled in the byte-level letters of the vocabulary
    words = Tokenizer(whole.model)
    words.pre_tokenizer = WhitespaceSplit()

    starts = np.zeros(whole.get_vocab_size(), dtype=bool)
    for token, k in whole.get_vocab().items():
        starts[k] = token[0] == "\u0120"  # the byte-level letter of a space

    def ids(texts: list[str], coder: Tokenizer = whole) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in coder.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(parts: list[str]) -> list[bytes]:
        """Many pieces in one text: those that are a space and letters, which are one match of the pattern, and those that are a
        space and other characters that are not white space."""
        out: dict[str, bytes] = {}
        plain = [p for p in parts if WORD(p)]
        ascii_ = [p for p in plain if p.isascii()]
        latin = [p for p in plain if not p.isascii()]
        rest = [p for p in parts if not WORD(p)] if len(plain) < len(parts) else []
        inner = [p for p in rest if p[0] == " " and p[1:].split() == [p[1:]]]
        for some, coder in ((ascii_, words), (latin, words), (inner, whole)):
            for at in range(0, len(some), 2000):
                block = some[at : at + 2000]
                if coder is whole:
                    text = "".join(block)
                elif some is ascii_:  # but for the space, bytes are spelled as they are
                    text = "\n".join(block).replace(" ", LETTERS[32])
                else:
                    text = "\n".join(block).encode("utf-8").decode("latin-1").translate(LETTERS)
                found = ids([text], coder)[0]
                cuts = [*(4 * np.flatnonzero(starts[found])).tolist(), 4 * len(found)]
                data = found.tobytes()
                out.update(zip(block, [data[i:j] for i, j in zip(cuts, cuts[1:])]))
        lone = [p for p in rest if p not in out]
        for at in range(0, len(lone), 2000):
            out.update(zip(lone[at : at + 2000], [x.tobytes() for x in ids(lone[at : at + 2000])]))
        return [out[p] for p in parts]

    return PieceIds(pieces, lambda t: ids([t])[0].tobytes(), whole="<|endoftext|>")


def pack(docs: DataFrame, path: str, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. With ``digest`` the
    column ids_crc32 (of these bytes, unsigned) stands for ids, which then do not leave the worker."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    schema = source.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long") if digest else ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = worker_memory(f"tokenizer:{path}", lambda: tokenizer(path))
        packer, end = Packer(replace(cfg)), np.array([cfg.end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        kept: dict[int, tuple] = {}  # document number -> (id, id bytes), while a piece of it is held
        n = 0

        def rows(found: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            docs_of = [kept[f[0]] for f in found]
            ids = [d[1][4 * f[1] : 4 * (f[1] + f[2])] for d, f in zip(docs_of, found)]
            cols = [pa.array([d[0] for d in docs_of], schema_id), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array(list(map(zlib.crc32, ids)), pa.int64()) if digest else pa.array(ids, pa.binary()),
                    pa.array([len(d[1]) // 4 for d in docs_of], pa.int64()),
                    pa.array([first + f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, schema.names)

        schema_id = None
        for b in slices(batches, "_text"):
            schema_id = b.schema.field(0).type
            found = []
            for doc_id, data in zip(b.column(0).to_pylist(), coder(b.column(1))):
                kept[n] = (doc_id, data + end)
                found += packer.add(n, len(data) // 4 + 1)
                n += 1
            if found:
                yield rows(found)
            open_docs = {h[0] for h in packer.held}
            kept = {k: v for k, v in kept.items() if k in open_docs}
        found = packer.flush()
        if found:
            yield rows(found)

    return source.mapInArrow(run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digest=True)
