"""Exact Reciprocal Rank Fusion over a whole corpus, ranking only the offers that can reach the top K.

One path for every size. Offers are known by their ordinal in key order (``ordinals``), which is also the tie-break of all
lists, so no step after it moves keys. For a batch of CVs:

1. An offer can reach the top K only within the first M of some list (``SearchConfig.candidate_depth``); lists are cut there.
2. Postings with a lexeme of the batch are dealt by blocks of at most ``hit_block`` ordinals, added up there, and leave the task
   as a row for each CV and block: sorted ordinals with both scores, a compressed bitmap with payload. The first M of the text and title lists come from a running top M over a CV's blocks, with
   zero-score offers in key order behind them (``select`` on the first block).
3. One pass over the vectors, in matrix blocks: a running top M whose M-th score is the bound below which no offer is
   looked at, and for the text candidates, whose own scores are known by then, one array of counts a task: how many
   offers come before each of them. What tasks return for a CV is merged as a stream, a bounded number of rows at a time.
4. Text ranks of all candidates likewise: hits before a candidate by count arrays over the blocks; a zero-score offer's
   rank is (hits) + (its ordinal) - (hits before it), the latter by ``rank`` on its block and sums over a directory of blocks.
5. Fusion and top K over at most 3M candidates a CV; the keys come back last.

No row for a (CV, offer) pair leaves a task, nothing is collected but sizes, and what is broadcast is the slice of CVs being
scored with its candidates, bounded by ``broadcast_rows`` values. A batch with more CVs is cut into slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions.memory import give_back
from offerlake.operators.ranking import global_rank
from offerlake.operators.search import (SCORE_DIGITS, SearchConfig, Terms, _add_up, _score_matrix, _whole_offers, batch_terms, cv_lexemes, matched_postings,
                                        round_half_up, searchable, text_scores)
from offerlake.session import scratch_path, ship_by_value

ship_by_value(__name__)

HELD = 64  # rows of a CV that a merge takes at a time
PAIRS_A_BLOCK = 500_000  # (CV, offer) pairs that a block can have: its task holds them as arrays
LEAST_BLOCK = 256  # ordinals
BATCH_BYTES = 4 << 20  # of wide rows that a worker is given at a time
SPARK_BYTES = "67108864b"  # what Spark gives it if nothing is set


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinals(corpus: DataFrame, key: str = "job_id") -> DataFrame:
    """``(key, embedding, ord)`` of the searchable offers: ``ord`` counts from 1 in key order. Keys are unique."""
    usable = corpus.filter(searchable("embedding") & F.col(key).isNotNull()).select(key, "embedding")
    return global_rank(usable, [F.col(key).asc()], "ord")


# ----------------------------------------------------------------------------------------------
# arrays in tasks


def _in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the batches of each partition. Rows hold blocks and lists, and a CV has more of them in a larger corpus: a
    batch ends at ``BATCH_BYTES`` too, since rows alone would let it hold as much as Spark's 64 MB in every worker of a task."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, SPARK_BYTES) == SPARK_BYTES:  # a session's own limit stays
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def _lists(column: pa.Array, dtype) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    return np.split(flat, ends[:-1]) if len(column) else []


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))


def _longs(rows: list) -> pa.Array:
    return pa.array([np.asarray(r, dtype=np.int64) for r in rows], pa.list_(pa.int64()))


def _doubles(rows: list) -> pa.Array:
    return pa.array([np.asarray(r, dtype=np.float64) for r in rows], pa.list_(pa.float64()))


def _first(scores: np.ndarray, ords: np.ndarray, m: int) -> np.ndarray:
    """Places of the first ``m`` by score descending, ordinal ascending."""
    if len(scores) > 4 * m:  # what lies below the m-th score cannot be among them
        least = np.partition(scores, len(scores) - m)[len(scores) - m]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ords[near], -scores[near]))[:m]]
    return np.lexsort((ords, -scores))[:m]


def _before(scores: np.ndarray, ords: np.ndarray, cand_scores: np.ndarray, cand_ords: np.ndarray) -> np.ndarray:
    """For each offer, the place of the first candidate behind it (candidates by score descending, ordinal ascending)."""
    left = np.searchsorted(-cand_scores, -scores, side="left")
    right = np.searchsorted(-cand_scores, -scores, side="right")
    for i in np.flatnonzero(left < right):
        left[i] += np.searchsorted(cand_ords[left[i]:right[i]], ords[i], side="right")
    return left


def _merged(df: DataFrame, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row for each CV from the rows that tasks gave for it, ``HELD`` at a time; ``merge`` takes and gives rows of one CV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            ids = batch.column("cv_id").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if ids[a] != now:
                    if held:
                        yield from merge(pa.Table.from_batches(held)).to_batches()
                    now, held = ids[a], []
                for k in range(a, b, HELD):
                    held.append(batch.slice(k, min(HELD, b - k)))
                    if sum(map(len, held)) > HELD:
                        held = merge(pa.Table.from_batches(held)).combine_chunks().to_batches()
        if held:
            yield from merge(pa.Table.from_batches(held)).to_batches()

    return _in_tasks(df.repartition("cv_id").sortWithinPartitions("cv_id"), run, schema)


# ----------------------------------------------------------------------------------------------
# text lists


HIT_TOPS = "cv_id long, n_f long, n_t long, f_ords array<long>, f_scores array<double>, t_ords array<long>, t_scores array<double>, low_f array<long>, low_t array<long>"


def hit_blocks(hits: DataFrame, block: int) -> DataFrame:
    """``(cv_id, block, ords, fts, title)``: a CV's hits within ``block`` consecutive ordinals, sorted."""
    rows = hits.groupBy("cv_id", F.floor(F.col("ord") / block).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "fts_score", "title_score"))).alias("h"))
    return rows.select("cv_id", "block", F.col("h.ord").alias("ords"), F.col("h.fts_score").alias("fts"), F.col("h.title_score").alias("title"))


HIT_BLOCKS = "cv_id long, block long, ords array<long>, fts array<double>, title array<double>"


def _score_blocks(batches: Iterator[pa.RecordBatch], starts: np.ndarray, cvs: np.ndarray, cv_ids: np.ndarray, n_terms: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Postings by ordinal -> the rows of ``hit_blocks``, one block at a time."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        cv, ords, fts, title = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(cv, kind="stable")  # ordinals rise already
        cv = cv[order]
        first = np.concatenate([[0], np.flatnonzero(cv[1:] != cv[:-1]) + 1])
        ends = pa.array(np.append(first, len(cv)).astype(np.int32))
        return _batch({"cv_id": pa.array(cv_ids[cv[first]]), "block": pa.array(np.full(len(first), now, dtype=np.int64)),
                       **{n: pa.ListArray.from_arrays(ends, pa.array(x[order])) for n, x in (("ords", ords), ("fts", fts), ("title", title))}})

    for rows in _whole_offers(batches, "ord"):
        places = rows.column("ord").to_numpy()
        for row, cv, fts, title in _add_up(rows, "ord", starts, cvs, n_terms):
            fts, title = round_half_up(fts), round_half_up(title)
            hit = np.flatnonzero((fts > 0) | (title > 0))
            found = (cv[hit], places[row[hit]], fts[hit], title[hit])
            block = found[1] // size
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if block[a] != now:
                    if held:
                        yield flush()
                    now, held = int(block[a]), []
                held.append(tuple(c[a:b] for c in found))
    if held:
        yield flush()


def scored_blocks(postings: DataFrame, terms: Terms, size: int) -> DataFrame:
    """``hit_blocks`` from ``(ord, term, title_len, w_f, w_t)``: a block's postings meet in one task, its pairs are never rows."""
    starts, cvs, cv_ids, n_terms = terms.starts, terms.cvs, terms.cv_ids.to_numpy(zero_copy_only=False), terms.n_terms
    dealt = postings.withColumn("block", F.floor(F.col("ord") / size)).repartition("block").sortWithinPartitions("ord").drop("block")
    return _in_tasks(dealt, lambda it: _score_blocks(it, starts, cvs, cv_ids, n_terms, size), HIT_BLOCKS)


def _hit_tops(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {c.split()[0]: [] for c in HIT_TOPS.split(", ")}
        columns = [_lists(batch.column(c), t) for c, t in (("ords", np.int64), ("fts", np.float64), ("title", np.float64))]
        for cv, ords, fts, title in zip(batch.column("cv_id").to_pylist(), *columns):
            out["cv_id"].append(cv)
            for name, scores in (("f", fts), ("t", title)):
                hit = np.flatnonzero(scores > 0)
                top = hit[_first(scores[hit], ords[hit], m)]
                out[f"n_{name}"].append(len(hit))
                out[f"{name}_ords"].append(ords[top])
                out[f"{name}_scores"].append(scores[top])
                out[f"low_{name}"].append(ords[hit][: np.searchsorted(ords[hit], 2 * m, side="right")])
        for c in ("f_ords", "t_ords", "low_f", "low_t"):
            out[c] = _longs(out[c])
        out["f_scores"], out["t_scores"] = _doubles(out["f_scores"]), _doubles(out["t_scores"])
        yield _batch(out)


def _merge_tops(table: pa.Table, m: int) -> pa.Table:
    row = {"cv_id": [table.column("cv_id")[0].as_py()]}
    for name in "ft":
        row[f"n_{name}"] = [int(np.sum(table.column(f"n_{name}").to_numpy()))]
    for name in "ft":
        ords = np.concatenate(_lists(table.column(f"{name}_ords"), np.int64))
        scores = np.concatenate(_lists(table.column(f"{name}_scores"), np.float64))
        top = _first(scores, ords, m)
        row[f"{name}_ords"], row[f"{name}_scores"] = _longs([ords[top]]), _doubles([scores[top]])
    for name in "ft":  # only a CV's first block has any
        row[f"low_{name}"] = _longs([np.concatenate(_lists(table.column(f"low_{name}"), np.int64))])
    return pa.Table.from_batches([_batch(row)])


def _with_zeros(batches: Iterator[pa.RecordBatch], m: int, n_corpus: int) -> Iterator[pa.RecordBatch]:
    """``(cv_id, ord)``: the first M of both text lists, zero-score offers in key order behind the hits."""
    for batch in batches:
        cols = {c: _lists(batch.column(c), np.int64) for c in ("f_ords", "t_ords", "low_f", "low_t")}
        for i, cv in enumerate(batch.column("cv_id").to_pylist()):
            found = []
            for name in "ft":
                top = cols[f"{name}_ords"][i]
                if len(top) < m:  # fewer than M hits in all: some zero-score offers of the first 2M are next
                    zero = np.setdiff1d(np.arange(1, min(n_corpus, 2 * m) + 1), cols[f"low_{name}"][i])
                    top = np.concatenate([top, zero[: m - len(top)]])
                found.append(top)
            ords = np.unique(np.concatenate(found))
            yield _batch({"cv_id": np.full(len(ords), cv, dtype=np.int64).tolist(), "ord": pa.array(ords.astype(np.int64))})


# ----------------------------------------------------------------------------------------------
# vector list


def _own_scores(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[pa.RecordBatch]:
    """Scores of single (CV, offer) pairs, offer and CV vector in one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a = np.stack(_lists(batch.column("embedding"), np.float64))
        c = np.stack(_lists(batch.column("cv_embedding"), np.float64))
        if metric == "cosine":
            a = a / np.where((n := np.linalg.norm(a, axis=1, keepdims=True)) == 0, 1.0, n)
            c = c / np.where((n := np.linalg.norm(c, axis=1, keepdims=True)) == 0, 1.0, n)
            score = np.einsum("ij,ij->i", a, c)
        else:
            diff = a - c
            score = 1.0 - np.sqrt(np.einsum("ij,ij->i", diff, diff))
        yield _batch({"cv_id": batch.column("cv_id"), "ord": batch.column("ord"), "score": pa.array(round_half_up(score))})


BLOCKS = "ords binary, vectors binary, dim int"


def _matrix_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Offers as few wide rows: what joins the scored CVs is one row for ``rows`` offers, and no more."""
    ords, vectors, held = [], [], 0

    def flush() -> pa.RecordBatch:
        o, v = np.concatenate(ords), np.concatenate(vectors)
        return _batch({"ords": pa.array([o.tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary()), "dim": pa.array([v.shape[1]], pa.int32())})

    for batch in batches:
        at = 0
        while at < batch.num_rows:  # a block is as large as it may be, whatever the batch
            part = batch.slice(at, rows - held)
            ords.append(part.column("ord").to_numpy().astype("<i8"))
            vectors.append(np.stack(_lists(part.column("embedding"), "<f8")))
            at, held = at + part.num_rows, held + part.num_rows
            if held == rows:
                yield flush()
                ords, vectors, held = [], [], 0
    if held:
        yield flush()


VECTOR_TOPS = "cv_id long, ords array<long>, scores array<double>, counts array<long>"


def _scan_vectors(batches: Iterator[pa.RecordBatch], m: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Running top M of each CV and, for its candidates, how many of this task's offers come before each."""
    ids = None
    for batch in batches:
        for row in range(batch.num_rows):
            if ids is None:
                probe = batch.column("probe")[row].values
                ids = probe.field("cv_id").to_pylist()
                cvs = np.stack(_lists(probe.field("cv_embedding"), np.float64))
                cand_ords, cand_scores = _lists(probe.field("cand_ords"), np.int64), _lists(probe.field("cand_scores"), np.float64)
                counts = [np.zeros(len(c) + 1, dtype=np.int64) for c in cand_ords]
                best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
                floor = np.full(len(ids), -np.inf)
            ords = np.frombuffer(batch.column("ords")[row].as_py(), "<i8")
            mat = np.frombuffer(batch.column("vectors")[row].as_py(), "<f8").reshape(len(ords), batch.column("dim")[row].as_py())
            scores = _score_matrix(mat, cvs, metric)
            scores = round_half_up(scores.ravel()).reshape(scores.shape)
            for j in range(len(ids)):
                s = np.ascontiguousarray(scores[:, j])
                counts[j] += np.bincount(_before(s, ords, cand_scores[j], cand_ords[j]), minlength=len(counts[j]))
                near = np.flatnonzero(s >= floor[j])
                if len(near):
                    o, s = np.concatenate([best[j][0], ords[near]]), np.concatenate([best[j][1], s[near]])
                    top = _first(s, o, m)
                    best[j] = (o[top], s[top])
                    if len(top) == m:
                        floor[j] = s[top[-1]]
    if ids is not None:
        yield _batch({"cv_id": pa.array(ids, pa.int64()), "ords": _longs([b[0] for b in best]), "scores": _doubles([b[1] for b in best]), "counts": _longs(counts)})


def _merge_vector_tops(table: pa.Table, m: int) -> pa.Table:
    ords = np.concatenate(_lists(table.column("ords"), np.int64))
    scores = np.concatenate(_lists(table.column("scores"), np.float64))
    top = _first(scores, ords, m)
    counts = np.sum(_lists(table.column("counts"), np.int64), axis=0)
    return pa.Table.from_batches([_batch({"cv_id": [table.column("cv_id")[0].as_py()], "ords": _longs([ords[top]]), "scores": _doubles([scores[top]]), "counts": _longs([counts])})])


CANDIDATES = "cv_id long, cands array<long>, embed_scores array<double>, embed_ranks array<long>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates of a CV, by ordinal, with score and rank in the vector list."""
    for batch in batches:
        lists = [_lists(batch.column(c), t) for c, t in (("ords", np.int64), ("scores", np.float64), ("counts", np.int64), ("cand_ords", np.int64), ("cand_scores", np.float64))]
        out = [[], [], []]
        for ords, scores, counts, cand_ords, cand_scores in zip(*lists):
            more = np.flatnonzero(~np.isin(cand_ords, ords))
            ranks = np.concatenate([np.arange(1, len(ords) + 1), np.cumsum(counts[:-1])[more] + 1])
            both, values = np.concatenate([ords, cand_ords[more]]), np.concatenate([scores, cand_scores[more]])
            order = np.argsort(both)
            for column, x in zip(out, (both, values, ranks)):
                column.append(x[order])
        yield _batch({"cv_id": batch.column("cv_id"), "cands": _longs(out[0]), "embed_scores": _doubles(out[1]), "embed_ranks": _longs(out[2])})


# ----------------------------------------------------------------------------------------------
# text ranks of candidates

IN_BLOCK = "cv_id long, block array<long>, n_f array<long>, n_t array<long>, at array<long>, fts array<double>, title array<double>, before_f array<long>, before_t array<long>"


def _own_hits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For a block of hits and the candidates in it: their own text scores, and the hits before them (``rank`` on the block)."""
    for batch in batches:
        columns = [_lists(batch.column(c), t) for c, t in (("cands", np.int64), ("ords", np.int64), ("fts", np.float64), ("title", np.float64))]
        out = {c.split()[0]: [] for c in IN_BLOCK.split(", ")}
        for cv, block, cands, ords, fts, title in zip(batch.column("cv_id").to_pylist(), batch.column("block").to_pylist(), *columns):
            here = np.arange(*np.searchsorted(cands, [block * size, (block + 1) * size]))
            want = cands[here]
            at = np.searchsorted(ords, want)
            held = np.flatnonzero(at < len(ords))
            held = held[ords[at[held]] == want[held]]
            out["cv_id"].append(cv)
            out["block"].append([block])
            out["at"].append(here)
            for name, x, scores in (("fts", "f", fts), ("title", "t", title)):
                own = np.zeros(len(want))
                own[held] = scores[at[held]]
                past = np.concatenate([[0], np.cumsum(scores > 0)])
                out[name].append(own)
                out[f"n_{x}"].append(past[-1:])
                out[f"before_{x}"].append(past[at])
        yield _batch({c: out[c] if c == "cv_id" else (_doubles if c in ("fts", "title") else _longs)(out[c]) for c in out})


def _join_lists(table: pa.Table) -> pa.Table:
    """The lists of a CV's blocks behind each other."""
    row = {"cv_id": [table.column("cv_id")[0].as_py()]}
    for c in table.column_names[1:]:
        real = c in ("fts", "title")
        row[c] = (_doubles if real else _longs)([np.concatenate(_lists(table.column(c), np.float64 if real else np.int64))])
    return pa.Table.from_batches([_batch(row)])


TEXT = ("cv_id long, fts array<double>, title array<double>, zero_f array<long>, zero_t array<long>, f_ords array<long>, f_scores array<double>, t_ords array<long>, "
        "t_scores array<double>")


def _with_directory(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A CV's candidates with their text scores, the ranks they have in each list if their score is zero (sums over the
    directory of blocks), and those with a hit in list order."""
    for batch in batches:
        names = [c.split()[0] for c in IN_BLOCK.split(", ")[1:]]
        cols = {c: _lists(batch.column(c), np.float64 if c in ("fts", "title") else np.int64) for c in [*names, "cands"]}
        out = {c.split()[0]: [] for c in TEXT.split(", ")}
        for i, cv in enumerate(batch.column("cv_id").to_pylist()):
            row = {c: cols[c][i] for c in cols}
            cands, order = row["cands"], np.argsort(row["block"])
            out["cv_id"].append(cv)
            for name, x in (("fts", "f"), ("title", "t")):
                past = np.concatenate([[0], np.cumsum(row[f"n_{x}"][order])])
                before = past[np.searchsorted(row["block"][order], cands // size)]
                own = np.zeros(len(cands))
                own[row["at"]] = row[name]
                before[row["at"]] += row[f"before_{x}"]
                hit = np.flatnonzero(own > 0)
                hit = hit[np.lexsort((cands[hit], -own[hit]))]
                out[name].append(own)
                out[f"zero_{x}"].append(past[-1] + cands - before)
                out[f"{x}_ords"].append(cands[hit])
                out[f"{x}_scores"].append(own[hit])
        yield _batch({c: out[c] if c == "cv_id" else (_doubles if c in ("fts", "title", "f_scores", "t_scores") else _longs)(out[c]) for c in out})


HIT_COUNTS = "cv_id long, counts_f array<long>, counts_t array<long>"


def _count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a CV's candidates with a hit, how many hits of a block come before each, in both lists."""
    for batch in batches:
        columns = [_lists(batch.column(c), t) for c, t in (("ords", np.int64), ("fts", np.float64), ("title", np.float64), ("f_ords", np.int64),
                                                          ("f_scores", np.float64), ("t_ords", np.int64), ("t_scores", np.float64))]
        out_f, out_t = [], []
        for ords, fts, title, fo, fs, to, ts in zip(*columns):
            for scores, cand_ords, cand_scores, out in ((fts, fo, fs, out_f), (title, to, ts, out_t)):
                hit = np.flatnonzero(scores > 0)
                out.append(np.bincount(_before(scores[hit], ords[hit], cand_scores, cand_ords), minlength=len(cand_ords) + 1))
        yield _batch({"cv_id": batch.column("cv_id"), "counts_f": _longs(out_f), "counts_t": _longs(out_t)})


def _add_counts(table: pa.Table) -> pa.Table:
    sums = {c: _longs([np.sum(_lists(table.column(c), np.int64), axis=0)]) for c in ("counts_f", "counts_t")}
    return pa.Table.from_batches([_batch({"cv_id": [table.column("cv_id")[0].as_py()], **sums})])


RANKED = "cv_id long, ord long, embedding_score double, fts_score double, title_score double, embed_rank long, fts_rank long, title_rank long"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of a CV with their scores and ranks in the three lists."""
    longs = ("cands", "embed_ranks", "zero_f", "zero_t", "f_ords", "t_ords", "counts_f", "counts_t")
    for batch in batches:
        cols = {c: _lists(batch.column(c), np.int64 if c in longs else np.float64) for c in (*longs, "embed_scores", "fts", "title")}
        for i, cv in enumerate(batch.column("cv_id").to_pylist()):
            row = {c: cols[c][i] for c in cols}
            cands, ranks = row["cands"], {}
            for x in "ft":
                rank = row[f"zero_{x}"].copy()
                rank[np.searchsorted(cands, row[f"{x}_ords"])] = np.cumsum(row[f"counts_{x}"][:-1])[: len(row[f"{x}_ords"])] + 1
                ranks[x] = pa.array(rank)
            yield _batch({"cv_id": [cv] * len(cands), "ord": pa.array(cands), "embedding_score": pa.array(row["embed_scores"]), "fts_score": pa.array(row["fts"]),
                          "title_score": pa.array(row["title"]), "embed_rank": pa.array(row["embed_ranks"]), "fts_rank": ranks["f"], "title_rank": ranks["t"]})


# ----------------------------------------------------------------------------------------------
# plan


def _blank(cvs: DataFrame, schema: str) -> DataFrame:
    """A row without content for each CV, for those that have no hit."""
    empty = [F.lit(0).cast(t).alias(n) if t == "long" else F.array().cast(t).alias(n) for n, t in (c.split() for c in schema.split(", ")[1:])]
    return cvs.select("cv_id", *empty)


def rrf_search(corpus: DataFrame, index: DataFrame, cvs: DataFrame, cfg: SearchConfig | None = None, key: str = "job_id",
               cvs_per_slice: int | None = None) -> DataFrame:
    """The top K offers of every CV: ``(cv_id, rank, key, embedding_score, fts_score, title_score, combined_score, embed_rank,
    fts_rank, title_rank)``. ``cvs`` has ``cv_id``, ``cv_text`` and ``cv_embedding``; a CV whose vector is missing or holds a
    null or NaN element has no result."""
    cfg = cfg or SearchConfig()
    m, dim = cfg.candidate_depth, F.max(F.size("cv_embedding"))
    cvs = cvs.filter(searchable("cv_embedding")).withColumn("cv_id", F.col("cv_id").cast("long"))
    offers = _stored(ordinals(corpus, key), "offers-by-key")  # read by column several times
    n_corpus = offers.count()
    cvs = _stored(cvs.select("cv_id", "cv_text", F.col("cv_embedding").cast("array<double>").alias("cv_embedding")), "cvs")
    n_cvs, values = cvs.agg(F.count(F.lit(1)), dim).first()
    # what a task is sent for a CV: its vector, and at most 2M candidates with their scores
    per_slice = cvs_per_slice or max(1, cfg.broadcast_rows // ((values or 0) + 4 * m))
    n_slices = max(1, -(-n_cvs // per_slice))

    near, queries = offers.select(key, "ord"), cv_lexemes(cvs, cfg)
    size = min(cfg.hit_block, max(LEAST_BLOCK, PAIRS_A_BLOCK // max(n_cvs, 1)))
    terms = batch_terms(queries, cfg)
    if terms is not None:
        found = matched_postings(index, queries, cfg, key).join(F.broadcast(terms.of), "lexeme").drop("lexeme")
        found = found.join(F.broadcast(near) if n_corpus <= cfg.broadcast_rows else near, key)
        blocks = _stored(scored_blocks(found.select("ord", "term", "title_len", "w_f", "w_t"), terms, size), "hit-blocks")
    else:  # many CVs: their lexemes are joined row by row
        if n_corpus <= cfg.broadcast_rows:  # postings of other offers go before they are added up
            hits = text_scores(index.join(F.broadcast(near), key).drop(key), queries, cfg, "ord")
        else:  # the lexeme join leaves few postings, and only their sums meet the corpus
            hits = text_scores(index, queries, cfg, key).join(near, key)
        hits = hits.select(
            F.col("cv_id").cast("long").alias("cv_id"), "ord", F.round("fts_score", SCORE_DIGITS).alias("fts_score"), F.round("title_score", SCORE_DIGITS).alias("title_score"))
        blocks = _stored(hit_blocks(hits.where("fts_score > 0 or title_score > 0"), size), "hit-blocks")

    tops = _in_tasks(blocks, lambda it: _hit_tops(it, m), HIT_TOPS)
    tops = _merged(tops.unionByName(_blank(cvs, HIT_TOPS)), lambda t: _merge_tops(t, m), HIT_TOPS)
    text_cands = _in_tasks(tops, lambda it: _with_zeros(it, m, n_corpus), "cv_id long, ord long")

    metric = cfg.metric
    vectors = cvs.select("cv_id", "cv_embedding")
    own = _in_tasks(text_cands.join(offers.select("ord", "embedding"), "ord").join(vectors, "cv_id").select("cv_id", "ord", "embedding", "cv_embedding"),
                    lambda it: _own_scores(it, metric), "cv_id long, ord long, score double")
    listed = own.groupBy("cv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord"))).alias("c"))
    empty = F.array().cast("array<long>")
    probes = vectors.join(listed, "cv_id", "left").select(
        "cv_id", F.pmod(F.xxhash64("cv_id"), F.lit(n_slices)).cast("int").alias("slice"), "cv_embedding", F.coalesce("c.ord", empty).alias("cand_ords"),
        F.coalesce(F.transform("c.s", lambda s: -s), empty.cast("array<double>")).alias("cand_scores"))
    probes = _stored(probes, "cv-probes")

    rows = cfg.vector_block
    matrix = _in_tasks(offers.select("ord", "embedding"), lambda it: _matrix_blocks(it, rows), BLOCKS)
    scanned = None
    for s in range(n_slices):
        probe = probes.where(F.col("slice") == s).groupBy("slice").agg(F.collect_list(F.struct("cv_id", "cv_embedding", "cand_ords", "cand_scores")).alias("probe"))
        part = _in_tasks(matrix.withColumn("slice", F.lit(s)).join(F.broadcast(probe), "slice").drop("slice"), lambda it: _scan_vectors(it, m, metric), VECTOR_TOPS)
        scanned = part if scanned is None else scanned.unionByName(part)
    ranked = _merged(scanned, lambda t: _merge_vector_tops(t, m), VECTOR_TOPS)
    cands = _stored(_in_tasks(ranked.join(probes.select("cv_id", "cand_ords", "cand_scores"), "cv_id"), _candidates, CANDIDATES), "candidates")

    inside = _in_tasks(blocks.join(cands.select("cv_id", "cands"), "cv_id"), lambda it: _own_hits(it, size), IN_BLOCK)
    inside = _merged(inside.unionByName(_blank(cvs, IN_BLOCK)), _join_lists, IN_BLOCK)
    text = _stored(_in_tasks(inside.join(cands.select("cv_id", "cands"), "cv_id"), lambda it: _with_directory(it, size), TEXT), "candidate-hits")

    wanted = text.select("cv_id", "f_ords", "f_scores", "t_ords", "t_scores")
    counted = _in_tasks(blocks.select("cv_id", "ords", "fts", "title").join(wanted, "cv_id"), _count_hits, HIT_COUNTS)
    counted = _merged(counted, _add_counts, HIT_COUNTS)
    state = cands.join(text, "cv_id").join(counted, "cv_id", "left")  # no count for a CV without a hit
    full = _in_tasks(state.select(*cands.columns, *text.columns[1:], *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in counted.columns[1:]]), _ranked, RANKED)
    we, wf, wt = cfg.weights
    k = float(cfg.rrf_k)
    full = full.withColumn("combined_score", F.lit(we) / (F.lit(k) + F.col("embed_rank")) + F.lit(wf) / (F.lit(k) + F.col("fts_rank")) + F.lit(wt) / (F.lit(k) + F.col("title_rank")))
    # at most 3M rows a CV
    best = Window.partitionBy("cv_id").orderBy(F.col("combined_score").desc(), F.col("ord").asc())
    top = full.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.top_k)
    return top.join(offers.select("ord", key), "ord").select(
        "cv_id", key, "embedding_score", "fts_score", "title_score", "embed_rank", "fts_rank", "title_rank", "combined_score", "rank")
