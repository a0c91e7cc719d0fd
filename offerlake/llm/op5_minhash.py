"""Near-duplicate texts by MinHash: many universal hash minima, banding, signature verification, exact check,
and connected components by alternating large-star and small-star.

A text's set holds its distinct shingles of ``Config.words`` words (the whole sequence if it has fewer). Texts with
equal sets form a class and only classes are compared. Classes that agree in a band share a bucket. Then
  1. every class is paired with the two classes that are the smallest of most of its buckets; pairs whose signatures
     agree well enough are checked on their full sets and the links give components;
  2. in buckets that still hold several components, all pairs of classes of different components are compared by
     set size and signature, in blocks of bounded size. No pair leaves the task: it returns each class that has a
     likely partner once, with the smallest component that likely pairs of the task lead to;
  3. components joined by likely pairs form a family. The full sets of its classes are compared within blocks of
     bounded size, and a task returns only links that join components not joined yet.
A pair inside one component needs no check, since only reachability is asked for; so a large group of near copies
costs a star and not its square, and a family of like texts that are no near copies returns a row for each text. No
pair that shares a bucket is left out: a pair that step 1 does not check is in step 2, and a likely pair of step 2
lies in one family. With the default 26 bands of 4 minima a pair at similarity 0.8 shares no bucket with probability
1e-6, and its signature estimate (of each minimum, one byte is compared) falls below the bound (0.62) with
probability 1e-5.

Null texts and texts without words have the empty set and link with nothing. Rows that share an id are one node.
A null id links with nothing and has no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import saved, scramble, slices, table
from offerlake.llm.components import components


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 26
    rows: int = 4
    estimate: float = 0.62  # least share of equal minima of a pair that is checked on full sets
    block: int = 1500  # classes of a bucket or family in one block
    block_shingles: int = 1 << 20  # shingles of a family's full sets in one block
    broadcast_ids: int = 1_000_000  # most ids that are sent to every executor: 8 bytes each
    seed: int = 5


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of a text; words are split at ASCII white space."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = scramble(h) + w[k : len(w) - size + 1 + k]
    return np.unique(scramble(h))


def signature_matrix(cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    n = cfg.bands * cfg.rows
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], cfg: Config) -> np.ndarray:
    """Minima of every hash function over each non-empty set: sets x functions, unsigned 32-bit."""
    a, b = signature_matrix(cfg)
    out = np.zeros((len(sets), len(a)), dtype=np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(sigs: np.ndarray, cfg: Config) -> np.ndarray:
    """64-bit bucket of each band: sets x bands."""
    out = np.zeros((len(sigs), cfg.bands), dtype=np.uint64)
    for band in range(cfg.bands):
        h = np.full(len(sigs), band + 1, dtype=np.uint64)
        for k in range(cfg.rows):
            h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, band * cfg.rows + k])
        out[:, band] = h
    return out


def sketches(docs: DataFrame, cfg: Config, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, s1, s2, bands, sig) for every row; s1 and s2 name the set with 128 bits, bands are its buckets,
    sig is one byte of each minimum; both are null if the set is empty."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 4 << 20):
            sets = [shingles(t, cfg.words) for t in b.column(1).to_pylist()]
            found = signatures([s for s in sets if len(s)], cfg)
            rows, keys = iter(found.astype(np.uint8)), iter(band_keys(found, cfg).view(np.int64))
            sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(scramble(s)))) if len(s) else (0, 0) for s in sets]
            names = np.array(sums, dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0].copy().view(np.int64)),
                                              pa.array(names[:, 1].copy().view(np.int64)), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                                              pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                                             ["id", "n_shingles", "s1", "s2", "bands", "sig"])

    return source.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary")


def bytes_of(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(rows, -1)


def similar(pairs: DataFrame, sigs: DataFrame, cfg: Config) -> DataFrame:
    """The pairs (u, v) whose set sizes allow a link and whose signatures agree in at least the configured share."""
    u, v = (sigs.select(F.col("c").alias(x), F.col("n_shingles").alias("n" + x), F.col("sig").alias("s" + x)) for x in "uv")
    rows = pairs.join(u, "u").join(v, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * cfg.percent).select("u", "v", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "su", 4 << 20):
            on = pa.array((bytes_of(b.column(2), b.num_rows) == bytes_of(b.column(3), b.num_rows)).mean(axis=1) >= cfg.estimate)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def full_sets(ids: DataFrame, docs: DataFrame, cfg: Config, id_col: str, text: str) -> DataFrame:
    """(id, set) for the ids given, from their texts; equal rows once. Up to ``Config.broadcast_ids`` ids, as counted, go to
    the texts; with more of them both sides are shuffled."""
    ids = saved(ids.distinct(), "minhash-ids")
    if ids.limit(cfg.broadcast_ids + 1).count() <= cfg.broadcast_ids:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_text")).join(ids, "id", "left_semi").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 4 << 20):
            data = [shingles(t, cfg.words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def linked(pairs: DataFrame, docs: DataFrame, cfg: Config, id_col: str, text: str) -> DataFrame:
    """The pairs whose full sets are similar enough, counted on the sets themselves."""
    pairs = saved(pairs, "minhash-pairs")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id")))
    sets = saved(full_sets(ids, docs, cfg, id_col, text), "minhash-sets")
    rows = (pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
            .join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u").select("u", "v", "su", "sv"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for a, z in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(z, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= cfg.percent * (len(x) + len(y) - both) and both > 0)
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], ["u", "v"])

    return rows.mapInArrow(check, "u long, v long").distinct()


UNIT = 1 << 20  # weight of a full block


def dealt(rows: DataFrame, group: str, cfg: Config) -> DataFrame:
    """Rows of the groups that hold several components, once for each pair (i, j) of blocks their block ``own`` is in.

    ``rows``: (group, c, comp, weight). A component that fills several blocks makes blocks of its own, which are not
    compared with each other: its rows go out once for each block of the others only."""
    per_comp = rows.groupBy(group, "comp").agg(F.sum("weight").alias("w"))
    per_group = per_comp.groupBy(group).agg(F.sum("w").alias("w"), F.max(F.struct("w", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    settled = F.col("main.w") > UNIT
    n_settled = F.when(settled, F.col("main.w")).otherwise(F.lit(0).cast("long"))
    per_group = per_group.select(group, F.when(settled, F.col("main.comp")).alias("main"), F.ceil((F.col("w") - n_settled) / UNIT).alias("open_blocks"),
                                 F.ceil(n_settled / UNIT).alias("settled_blocks"))
    mine = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    draw = F.xxhash64("c", F.lit(cfg.seed))
    own = F.when(mine, F.col("open_blocks") + F.pmod(draw, F.greatest("settled_blocks", F.lit(1)))).otherwise(F.pmod(draw, F.col("open_blocks")))
    others = F.when(mine, F.col("open_blocks")).otherwise(F.col("open_blocks") + F.col("settled_blocks"))
    spread = rows.join(per_group, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("main", "open_blocks", "settled_blocks", "other", "weight")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows cut into tables that hold whole groups only."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        k = np.stack([held.column(n).to_numpy() for n in keys])
        last = np.flatnonzero((k != k[:, -1:]).any(axis=0))
        whole = int(last[-1]) + 1 if len(last) else 0  # rows of groups that surely ended
        if whole:
            yield held.slice(0, whole).combine_chunks()
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k]: ``label`` names the smallest member of each set, in place."""
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return
        np.minimum.at(label, np.maximum(x, y)[on], np.minimum(x, y)[on])
        while (label[label] != label).any():
            label[:] = label[label]


def likely(members: DataFrame, cfg: Config) -> DataFrame:
    """(c, comp, n_shingles, top) for each class with a likely partner of another component in one of its buckets; top is the
    smallest component that likely pairs of the same task lead to. ``members``: (bucket, i, j, own, c, comp, n_shingles, sig)."""
    keys = ("bucket", "i", "j")
    sorted_rows = members.select(*keys, "own", "c", "comp", "n_shingles", "sig").repartition(*keys).sortWithinPartitions(*keys, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            k = np.stack([t.column(n).to_numpy() for n in keys])
            group = np.cumsum(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)])
            own, c, size = (t.column(n).to_numpy() for n in ("own", "c", "n_shingles"))
            cross = k[1] != k[2]
            sig = bytes_of(t.column("sig"), len(c))
            comps, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
            label, active = np.arange(len(comps)), np.zeros(len(c), dtype=bool)
            rows, step = np.arange(len(c)), 1
            while len(rows):  # pairs of one group, by their distance in the sorted rows
                rows = rows[rows + step < len(c)]
                rows = rows[group[rows] == group[rows + step]]
                at = rows[(comp[rows] != comp[rows + step]) & (~cross[rows] | (own[rows] != own[rows + step]))]
                at = at[100 * np.minimum(size[at], size[at + step]) >= cfg.percent * np.maximum(size[at], size[at + step])]
                for s in range(0, len(at), 20_000):
                    p = at[s : s + 20_000]
                    p = p[(sig[p] == sig[p + step]).mean(axis=1) >= cfg.estimate]
                    active[p] = active[p + step] = True
                    join_labels(label, comp[p], comp[p + step])
                step += 1
            at = np.flatnonzero(active)
            at = at[np.unique(c[at], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(comps[comp[at]]), pa.array(size[at]), pa.array(comps[label[comp[at]]])], ["c", "comp", "n_shingles", "top"])

    return sorted_rows.mapInArrow(run, "c long, comp long, n_shingles long, top long").distinct()


def set_links(sizes: list[int], flat: np.ndarray, comp: np.ndarray, own: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs (row, row) of linked sets that join components not joined by the pairs before. ``flat`` holds the sets one after
    the other; in a cross group only sets of different blocks are compared."""
    size = np.array(sizes, dtype=np.int64)
    start = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    at = np.concatenate([np.arange(start[k], start[k] + size[k]) for k in order])
    names, word = np.unique(flat[at], return_inverse=True)
    size, comp, own = size[order], comp[order], own[order]
    start = np.cumsum(size) - size
    label = np.unique(comp, return_inverse=True)[1]
    mark, out = np.zeros(len(names), dtype=bool), []
    ends = np.searchsorted(size, size * 100 // percent, side="right")  # larger sets cannot be linked
    for a in range(len(size) - 1):
        z = int(ends[a])
        rows = np.arange(a + 1, z)
        rows = rows[(label[rows] != label[a]) & (own[rows] != own[a] if cross else True)]
        if not len(rows):
            continue
        mark[word[start[a] : start[a] + size[a]]] = True
        first, last = rows[0], rows[-1]
        both = np.add.reduceat(mark[word[start[first] : start[last] + size[last]]], start[first : last + 1] - start[first], dtype=np.int64)[rows - first]
        mark[word[start[a] : start[a] + size[a]]] = False
        for k in rows[(100 * both >= percent * (size[a] + size[rows] - both)) & (both > 0)]:
            if label[k] != label[a]:
                out.append((int(order[a]), int(order[k])))
                label[label == label[k]] = label[a]
    return out


def family_links(members: DataFrame, cfg: Config) -> DataFrame:
    """(u, v): components joined by a pair of full sets that are similar enough. ``members``: (family, i, j, own, c, comp, set)."""
    keys = ("family", "i", "j")
    sorted_rows = members.select(*keys, "own", "comp", "set").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            k = np.stack([t.column(n).to_numpy() for n in keys])
            cuts = np.r_[np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)]), t.num_rows]
            own, comp = (t.column(n).to_numpy() for n in ("own", "comp"))
            u, v = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                data = t.column("set").slice(s, e - s).to_pylist()
                found = set_links([len(x) // 8 for x in data], np.frombuffer(b"".join(data), dtype=np.uint64), comp[s:e], own[s:e], bool(k[1, s] != k[2, s]), cfg.percent)
                u += [int(comp[s + a]) for a, _ in found]
                v += [int(comp[s + b]) for _, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return sorted_rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    sk = saved(sketches(docs, cfg, id_col, text), "minhash-sketches")
    with_set = sk.where("n_shingles > 0 and id is not null")
    classes = saved(with_set.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("c"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "minhash-classes")
    in_bucket = classes.select("c", F.explode("bands").alias("bucket"))
    several = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first")).where("n > 1")
    members = saved(in_bucket.join(several, "bucket"), "minhash-members")
    shared = members.where("c != first").groupBy("c", "first").agg(F.count(F.lit(1)).alias("n"))
    most = shared.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "first"))), 1, 2).alias("best"))  # at most one entry a band
    stars = most.select(F.col("c").alias("u"), F.explode("best.first").alias("v"))
    comp = saved(components(linked(similar(stars, classes, cfg), docs, cfg, id_col, text)), "minhash-components").withColumnRenamed("u", "c")
    placed = members.select("bucket", "c").join(comp, "c", "left").select("bucket", "c", F.coalesce("component", "c").alias("comp"), F.lit(-(-UNIT // cfg.block)).cast("long").alias("weight"))
    rest = dealt(saved(placed, "minhash-placed"), "bucket", cfg).join(classes.select("c", "n_shingles", "sig"), "c")
    open_classes = saved(likely(rest, cfg), "minhash-likely")
    family = components(open_classes.select(F.col("comp").alias("u"), F.col("top").alias("v"))).select(F.col("u").alias("comp"), F.col("component").alias("family"))
    weight = F.greatest(F.lit(-(-UNIT // cfg.block)), F.ceil(F.col("n_shingles") * (UNIT / cfg.block_shingles))).cast("long")
    open_classes = saved(open_classes.select("c", "comp", "n_shingles").distinct().join(family, "comp").withColumn("weight", weight), "minhash-families")
    sets = full_sets(open_classes.select(F.col("c").alias("id")), docs, cfg, id_col, text).withColumnRenamed("id", "c")
    upper = components(family_links(dealt(open_classes, "family", cfg).join(sets, "c"), cfg)).select(F.col("u").alias("component"), F.col("component").alias("top"))
    whole = classes.select("s1", "s2", "n_shingles", "c").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))
    whole = whole.join(upper, "component", "left").select("s1", "s2", "n_shingles", F.coalesce("top", "component").alias("top"))
    found = sk.drop("sig", "bands").join(whole, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Config(words=2))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
  ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '  ' ORDER BY g)) AS h FROM s GROUP BY doc_id),
reps AS (SELECT h, min(doc_id) AS c, any_value(n) AS n FROM sets GROUP BY h),
rs AS (SELECT s.doc_id AS c, r.n, s.g FROM s JOIN reps r ON r.c = s.doc_id),
pairs AS (SELECT a.c AS u, b.c AS v FROM rs a JOIN rs b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(x.n, 0) AS n_shingles, coalesce(least(r.c, m.m), r.c, d.doc_id) AS component_id,
  d.doc_id = coalesce(least(r.c, m.m), r.c, d.doc_id) AS kept
FROM documents d LEFT JOIN sets x ON x.doc_id = d.doc_id LEFT JOIN reps r ON r.h = x.h LEFT JOIN comp m ON m.u = r.c
"""
