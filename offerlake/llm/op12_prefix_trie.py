"""Prefix trie of conversations in balanced parentheses, and what sharing prefixes would save.

1. Equal conversations become one sequence with its number of members, so a third of all conversations being copies is one
   sequence. A turn is a 16-byte digest of (role, text) and its length; texts travel no further than that.
2. Sequences are range partitioned and sorted by their digests: a shard holds neighbours in depth-first order, and the
   only nodes that two shards can share are prefixes of a shard's first or last sequence, its spine.
3. Each shard writes its trie as balanced parentheses, one pair a node in preorder. ``Parentheses`` keeps minima of the
   excess for blocks and, above them, for powers of two of blocks; ``close`` finds the end of every subtree, the
   number of pairs ``()`` inside counts its leaves, and cumulative arrays over the opens give members and savings.
4. Spines merge: every shard gives, for each spine node, what hangs from it outside the spine. One task joins these few
   paths (two for each shard, their lengths apart independent of the rows) into the trie above the shards.

Memory: a task holds one shard (``Config.shard_turns`` turns and one sequence more at most) at about 100 bytes a turn; a
conversation of more turns is held whole as 24 bytes a turn. Ids of members are joined in blocks of ids in parallel; the
one task that a digest of a hot node needs reads these blocks in order and keeps none.

Defined results: rows without conv_id belong to no conversation; turns are ordered by turn (null first), ties by the first
64 characters of role and text and then by digest, so repeated rows have one order; null role or text is empty; an empty table has no node, also no root;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import give_back, saved, table
from offerlake.operators.ranking import rank_within
from offerlake.session import ship_by_value

ship_by_value(__name__)

DIGEST = 16  # bytes of a turn's digest


@dataclass(frozen=True)
class Config:
    shard_turns: int = 100_000  # turns of distinct sequences in a shard, on average
    shared_key: int = 64  # turns that the range partitioner compares (whole sequences sort inside a shard)
    id_block: int = 1 << 16  # width of a block of member ids


# ---- balanced parentheses


class Parentheses:
    """A trie's parentheses (True: open) with a range min-max structure over the excess."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        n_blocks = max(1, -(-len(bits) // self.BLOCK))
        padded = np.full(n_blocks * self.BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(n_blocks, self.BLOCK)
        self.minima = [self.blocks.min(axis=1)]  # level k: the least excess of 2**k blocks
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.append(low, np.iinfo(np.int32).max) if len(low) % 2 else low
            self.minima.append(low.reshape(-1, 2).min(axis=1))
        # rank structures: opens before a place, and leaves ``()`` that start before a place
        self.rank_open = np.concatenate([[0], np.cumsum(bits)])
        leaf = np.zeros(len(bits), dtype=bool)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.rank_leaf = np.concatenate([[0], np.cumsum(leaf)])

    def close(self, at: np.ndarray) -> np.ndarray:
        """The place of the parenthesis that closes the open one at each place: the next with an excess below."""
        target = self.excess[at] - 1
        found = np.full(len(at), -1, dtype=np.int64)
        block = at // self.BLOCK
        for s in range(0, len(at), 4096):  # inside the own block
            part = slice(s, s + 4096)
            behind = np.arange(self.BLOCK)[None, :] > (at[part] % self.BLOCK)[:, None]
            hit = behind & (self.blocks[block[part]] <= target[part, None])
            found[part] = np.where(hit.any(axis=1), block[part] * self.BLOCK + hit.argmax(axis=1), -1)
        open_at = np.flatnonzero(found < 0)
        node, level = block[open_at], np.zeros(len(open_at), dtype=np.int64)
        going_up = np.ones(len(open_at), dtype=bool)
        want = target[open_at]
        # up until a right neighbour holds a smaller excess, then down to its first block that does
        for k in range(len(self.minima)):
            now = np.flatnonzero(going_up)
            right = node[now] + 1
            low = np.append(self.minima[k], np.iinfo(np.int32).max)
            ok = (node[now] % 2 == 0) & (low[np.minimum(right, len(low) - 1)] <= want[now])
            node[now[ok]], level[now[ok]], going_up[now[ok]] = right[ok], k, False
            node[now[~ok]] //= 2
        for k in range(len(self.minima) - 1, 0, -1):
            now = np.flatnonzero(level == k)
            left = node[now] * 2
            node[now] = np.where(self.minima[k - 1][left] <= want[now], left, left + 1)
            level[now] = k - 1
        for s in range(0, len(open_at), 4096):
            part = slice(s, s + 4096)
            hit = self.blocks[node[part]] <= want[part, None]
            found[open_at[part]] = node[part] * self.BLOCK + hit.argmax(axis=1)
        return found


@dataclass
class Shard:
    """The trie of sorted distinct sequences, as arrays over its nodes in preorder."""

    depth: np.ndarray
    parent: np.ndarray
    n_convs: np.ndarray
    n_leaves: np.ndarray
    n_children: np.ndarray
    saved: np.ndarray
    least: np.ndarray
    end_row: np.ndarray  # the sequence that ends at the node, or -1
    first_path: np.ndarray  # nodes of the first and the last sequence, root included
    last_path: np.ndarray
    size: np.ndarray  # nodes of the subtree
    own: np.ndarray  # members that end at the node
    length: np.ndarray  # bytes of the last text
    local_least: np.ndarray  # the least member that ends at the node


def build(seqs: list[bytes], lengths: list[np.ndarray], members: np.ndarray, least: np.ndarray) -> Shard:
    """The shard's trie. Sequences come sorted and distinct; a prefix sorts before what extends it."""
    bits, above, depth, length, end_row = [True], [-1], [0], [0], [-1]
    path = [0]
    first_path = last_path = [0]
    before = b""
    for row, seq in enumerate(seqs):
        n = len(seq) // DIGEST
        m = min(len(before), len(seq)) // DIGEST
        if before[: m * DIGEST] == seq[: m * DIGEST]:
            shared = m
        else:
            a = np.frombuffer(before, np.uint8, m * DIGEST).reshape(m, DIGEST)
            b = np.frombuffer(seq, np.uint8, m * DIGEST).reshape(m, DIGEST)
            shared = int((a != b).any(axis=1).argmax())
        bits.extend([False] * (len(path) - 1 - shared))
        del path[shared + 1 :]
        for d in range(shared, n):
            above.append(path[-1])
            path.append(len(depth))
            bits.append(True)
            depth.append(d + 1)
            length.append(int(lengths[row][d]))
            end_row.append(-1)
        end_row[path[-1]] = row
        last_path = list(path)
        if not row:
            first_path = last_path
        before = seq
    bits.extend([False] * len(path))
    tree = Parentheses(np.array(bits, dtype=bool))
    opens = tree.opens
    closes = tree.close(opens)
    n = len(opens)
    depth, end_row, length = np.array(depth), np.array(end_row), np.array(length, dtype=np.int64)
    size = tree.rank_open[closes] - np.arange(n)
    ends = end_row >= 0
    own = np.where(ends, members[end_row], 0)
    end = np.arange(n) + size
    total = np.concatenate([[0], np.cumsum(own)])
    n_convs = total[end] - total[:-1]
    saving = np.concatenate([[0], np.cumsum((n_convs - 1) * length)])
    top = np.iinfo(np.int64).max
    local_least = np.where(ends, least[end_row], top)
    # sequences that end inside a subtree are neighbours: the least member is a range minimum over preorder
    low = local_least.copy()
    parent = np.array(above)
    for i in range(n - 1, 0, -1):
        if low[i] < low[parent[i]]:
            low[parent[i]] = low[i]
    return Shard(depth, parent, n_convs, tree.rank_leaf[closes] - tree.rank_leaf[opens], np.bincount(parent[1:], minlength=n), saving[end] - saving[:-1],
                 low, end_row, np.array(first_path), np.array(last_path), size, own, length, local_least)


NODES = ("kind int, shard long, side int, depth int, seq binary, lengths binary, conv_id long, parent_id long, above_side int, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, end_key string, partial binary")
INNER, PATH = 0, 1
PARTIAL = np.dtype([("own", "<i8"), ("least", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("convs", "<i8"), ("saved", "<i8")])


def _hanging(trie: Shard, path: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each node of a path: its own members, and what hangs from it by children outside the spine ``others``."""
    out = np.zeros(len(path), dtype=PARTIAL)
    spine = np.zeros(len(trie.depth), dtype=bool)
    spine[others] = True
    place = np.full(len(trie.depth), -1)
    place[path] = np.arange(len(path))
    loose = np.flatnonzero(~spine & (place[trie.parent] >= 0) & (trie.parent >= 0))
    at = place[trie.parent[loose]]
    out["own"], out["least"] = trie.own[path], trie.local_least[path]
    np.minimum.at(out["least"], at, trie.least[loose])
    for name, values in (("children", np.ones(len(loose), dtype=np.int64)), ("leaves", trie.n_leaves[loose]), ("convs", trie.n_convs[loose]), ("saved", trie.saved[loose])):
        np.add.at(out[name], at, values)
    return out


def _shard_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    seqs, lengths, members, least, keys = [], [], [], [], []
    for batch in batches:
        seqs.extend(batch.column("seq").to_pylist())
        lengths.extend([np.frombuffer(x, "<i8") for x in batch.column("lengths").to_pylist()])
        members.append(batch.column("members").to_numpy())
        least.append(batch.column("least").to_numpy())
        keys.extend(batch.column("key").to_pylist())
    if not seqs:
        return
    shard = TaskContext.get().partitionId()
    trie = build(seqs, lengths, np.concatenate(members), np.concatenate(least))
    spine = np.unique(np.concatenate([trie.first_path, trie.last_path]))
    top = np.iinfo(np.int64).max
    common = int((np.minimum(len(trie.first_path), len(trie.last_path))))
    fork = int((trie.first_path[:common] == trie.last_path[:common]).sum())
    rows = []
    for side, path, row in ((0, trie.first_path, 0), (1, trie.last_path, len(seqs) - 1)):
        partial = _hanging(trie, path, spine)
        if side:  # what both paths hold is counted with the first
            partial[:fork] = np.array([(0, top, 0, 0, 0, 0)], dtype=PARTIAL)
        ends = [keys[trie.end_row[i]] if trie.end_row[i] >= 0 else "" for i in path]
        rows.append((PATH, shard, side, len(path) - 1, seqs[row], lengths[row].tobytes(), "\n".join(ends), partial.tobytes()))
    names = schema.names
    blank = {n: [None] * len(rows) for n in names}
    for n, values in zip(("kind", "shard", "side", "depth", "seq", "lengths", "end_key", "partial"), zip(*rows)):
        blank[n] = list(values)
    yield pa.RecordBatch.from_arrays([pa.array(blank[n], schema.field(n).type) for n in names], schema=schema)
    side_of = np.full(len(trie.depth), -1)
    side_of[trie.last_path], side_of[trie.first_path] = 1, 0
    inner = np.flatnonzero(side_of < 0)
    for s in range(0, len(inner), 20_000):
        at = inner[s : s + 20_000]
        up = trie.parent[at]
        above = side_of[up]
        k = len(at)
        fields = {"kind": np.full(k, INNER, np.int32), "shard": np.full(k, shard), "depth": trie.depth[at].astype(np.int32), "conv_id": trie.least[at],
                  "parent_id": pa.array(trie.least[up], mask=above >= 0), "above_side": pa.array(above.astype(np.int32), mask=above < 0),
                  "n_convs": trie.n_convs[at], "n_children": trie.n_children[at], "n_leaves": trie.n_leaves[at], "saved_tokens": trie.saved[at],
                  "end_key": [keys[r] if r >= 0 else None for r in trie.end_row[at]]}
        yield pa.RecordBatch.from_arrays([pa.array(fields[n], schema.field(n).type) if n in fields else pa.nulls(k, schema.field(n).type) for n in names], schema=schema)
    give_back()


SPINE = ("shard long, side int, first boolean, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, end_key string")


def _merge_spines(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The spine nodes of all shards, each given once (``first``) and named for every path that holds it."""
    index: dict[tuple[int, bytes], int] = {}
    own, least, children, leaves, saving, length, parent, depth, end = [0], [np.iinfo(np.int64).max], [0], [0], [0], [0], [-1], [0], [""]
    hung = [0]
    paths = []
    for batch in batches:
        for shard, side, seq, lengths, ends, partial in zip(*[batch.column(c).to_pylist() for c in ("shard", "side", "seq", "lengths", "end_key", "partial")]):
            sizes, part, names = np.frombuffer(lengths, "<i8"), np.frombuffer(partial, PARTIAL), ends.split("\n")
            nodes, at = [0], 0
            for d in range(len(sizes)):
                turn = seq[d * DIGEST : (d + 1) * DIGEST]
                new = index.get((at, turn))
                if new is None:
                    new = index[(at, turn)] = len(parent)
                    for column, value in ((own, 0), (least, np.iinfo(np.int64).max), (children, 0), (leaves, 0), (saving, 0), (hung, 0),
                                          (length, int(sizes[d])), (parent, at), (depth, d + 1), (end, "")):
                        column.append(value)
                at = new
                nodes.append(at)
            for i, p, name in zip(nodes, part.tolist(), names):
                own[i] += p[0]
                least[i] = min(least[i], p[1])
                children[i] += p[2]
                leaves[i] += p[3]
                hung[i] += p[4]
                saving[i] += p[5]
                end[i] = end[i] or name
            paths.append((shard, side, nodes))
    if not paths:
        return
    convs = [a + b for a, b in zip(own, hung)]
    for i in range(1, len(parent)):
        children[parent[i]] += 1
    for i in range(len(parent) - 1, -1, -1):  # a node comes after its parent
        if not children[i]:
            leaves[i] = 1
        saving[i] += (convs[i] - 1) * length[i]
        if i:
            up = parent[i]
            convs[up] += convs[i]
            leaves[up] += leaves[i]
            saving[up] += saving[i]
            least[up] = min(least[up], least[i])
    given: set[int] = set()
    for shard, side, nodes in paths:
        first = [i not in given for i in nodes]
        given.update(nodes)
        up = [least[parent[i]] if i else None for i in nodes]
        columns = [[shard] * len(nodes), [side] * len(nodes), first, [depth[i] for i in nodes], [least[i] for i in nodes], up, [convs[i] for i in nodes],
                   [children[i] for i in nodes], [leaves[i] for i in nodes], [saving[i] for i in nodes], [end[i] or None for i in nodes]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    give_back()


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


# ---- sequences


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, length)``: the turns of each conversation in order, places from 1. Places come from a
    range partition, so a conversation that holds a third of the rows is spread over tasks."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("length"),
        F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"))
    order = [F.col("turn").asc_nulls_first(), F.col("r").asc(), F.col("t").asc(), F.col("digest").asc()]
    return rank_within(named, ["conv_id"], order, "place").select("conv_id", "place", "digest", "length")


def rebuilt(ordered: DataFrame, heads: Column, base: Column) -> DataFrame:
    """``(conv_id, place, digest, length)`` of rebuilt conversations: the first ``heads`` turns of conversation ``base``
    (all if fewer), then the own turns behind the first ``heads``. Both are columns over ``conv_id``."""
    convs = ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", heads.cast("long").alias("h"), base.alias("base"))
    from_base = (convs.join(ordered.withColumnRenamed("conv_id", "base"), "base").where(F.col("place") <= F.col("h"))
                 .select("conv_id", "place", "digest", "length"))
    base_size = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(base_size, "base", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("shift"))
    own = ordered.join(shift, "conv_id").where(F.col("place") > F.col("h")).select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "digest", "length")
    # a conversation may be rebuilt without any turn
    empty = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("length"))
    return from_base.unionByName(own).unionByName(empty)


def trie(sequences: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Nodes of the trie of ``sequences(conv_id, place, digest, length)``, places from 1, a row of place 0 for each
    conversation: the columns of ``op12_prefix_trie``."""
    cfg = cfg or Config()
    spark = sequences.sparkSession
    listed = F.sort_array(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "digest", "length"))))
    each = sequences.groupBy("conv_id").agg(listed.alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    lengths = F.unhex(F.array_join(F.transform("turns", lambda t: _little_endian(t["length"])), ""))
    each = each.select("conv_id", joined.alias("seq"), lengths.alias("lengths"))
    each = saved(each.withColumn("key", F.sha2("seq", 256)), "sequences")
    classes = each.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.first("seq").alias("seq"), F.first("lengths").alias("lengths"))
    classes = saved(classes, "distinct-sequences")
    total = classes.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()[0] // DIGEST
    shards = max(2, -(-total // cfg.shard_turns))
    near = classes.withColumn("head", F.substring("seq", 1, cfg.shared_key * DIGEST)).repartitionByRange(int(shards), "head").sortWithinPartitions("seq")
    nodes_schema, spine_schema = _arrow_schema(spark, NODES), _arrow_schema(spark, SPINE)
    nodes = saved(near.select("key", "members", "least", "seq", "lengths").mapInArrow(lambda it: _shard_rows(it, nodes_schema), NODES), "trie-nodes")
    paths = nodes.where(F.col("kind") == PATH).select("shard", "side", "seq", "lengths", "end_key", "partial")
    # two paths for each shard: what the merging task reads depends on the number of shards, not on the rows
    spine = saved(paths.repartition(1).sortWithinPartitions("shard", "side").mapInArrow(lambda it: _merge_spines(it, spine_schema), SPINE), "trie-spines")
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    above = spine.select("shard", F.col("side").alias("above_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above_id"))
    inner = nodes.where(F.col("kind") == INNER)
    below = inner.where(F.col("above_side").isNotNull()).join(above, ["shard", "above_side", "depth"]).withColumn("parent_conv_id", F.col("above_id"))
    deep = inner.where(F.col("above_side").isNull()).withColumn("parent_conv_id", F.col("parent_id"))
    found = spine.where("first").select(*columns).unionByName(below.select(*columns)).unionByName(deep.select(*columns))
    none = found.where(F.col("end_key").isNull()).withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    some = found.where(F.col("end_key").isNotNull()).join(_end_digests(each, cfg).withColumnRenamed("key", "end_key"), "end_key")
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return none.select(*out).unionByName(some.select(*out))


def _little_endian(value: Column) -> Column:
    """Eight bytes of a long as hexadecimal text, lowest byte first."""
    h = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def _end_digests(each: DataFrame, cfg: Config) -> DataFrame:
    """``(key, ends_sha256)``: the digest of the ids of each sequence's members, ascending. Blocks of ids are joined to
    texts in parallel; a task then reads the blocks of a key one after the other."""
    blocks = (each.groupBy("key", F.floor(F.col("conv_id") / cfg.id_block).alias("block"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    spread = blocks.repartition("key").sortWithinPartitions("key", "block")
    return spread.mapInArrow(_digest_blocks, "key string, ends_sha256 string")


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, keys, sums = None, None, [], []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    sums.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(keys) > 10_000:
            yield flush()
            keys, sums = [], []
    if now is not None:
        keys.append(now)
        sums.append(state.hexdigest())
    yield flush()
    give_back()


HEADS = 9  # fixed value of the contract: a conversation takes fewer than this many turns from the first of its five
FAMILY = 5


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = saved(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "ordered-turns")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    return trie(rebuilt(ordered, heads, F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))))


ORACLE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
bits(i, v) AS (  -- table of the reflected CRC-32 polynomial 0xEDB88320
  SELECT i, list_reduce([i::BIGINT] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits),
convs AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
heads AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM convs, crc_table),
sized AS (SELECT a.*, coalesce(b.n, 0) AS base_n FROM heads a LEFT JOIN convs b ON a.base = b.conv_id),
rebuilt AS (
  SELECT s.conv_id, o.place, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.base AND o.place <= s.h
  UNION ALL
  SELECT s.conv_id, o.place - s.h + least(s.h, s.base_n), o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.place > s.h),
sequences AS (
  SELECT c.conv_id, coalesce(list({'r': r.role, 't': r.text} ORDER BY r.place) FILTER (r.place IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, d, seq[1:d] AS path, seq[1:d - 1] AS up, len(seq) AS n,
         CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS bytes
  FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT d, path, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
         count(*) FILTER (n > d) AS going_on
  FROM prefixes GROUP BY d, path),
children AS (SELECT up AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
below AS (  -- every node counts once for each node on its path
  SELECT a.d, a.path, count(*) FILTER (n.going_on = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n, LATERAL (SELECT unnest(range(n.d + 1)) AS d, n.path AS whole) w, LATERAL (SELECT w.d AS d, w.whole[1:w.d] AS path) a
  GROUP BY a.d, a.path)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.up
LEFT JOIN children c ON c.path = n.path AND n.going_on > 0 LEFT JOIN below b ON b.d = n.d AND b.path = n.path
"""
