import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from offerlake.llm import common, components
from offerlake.llm import op1_toxicity as tox
from offerlake.llm import op2_forest as forest
from offerlake.llm import op3_packing as packing
from offerlake.llm import op4_sharding as sharding
from offerlake.llm import op5_minhash as minhash
from offerlake.llm import op6_suffix_dedup as suffix
from offerlake.llm import op7_lattice as lattice
from offerlake.llm import op8_language as language
from offerlake.llm import op9_bpe as bpe
from offerlake.llm import op10_fingerprint as prints


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- toxicity


def test_toxicity_unseen_misspelling_and_edge_texts(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    plain = [" ".join(rng.choice(["tree", "house", "river", "green", "walk", "stone"], 20)) for _ in range(200)]
    bad = [t + " horrible" + " " + plain[(i * 7) % 200] for i, t in enumerate(plain)]
    model = tox.fit(plain + bad, [0] * 200 + [1] * 200, tox.Config(epochs=60))
    score = tox.Scorer(model)
    found = score([plain[0], bad[0], plain[1] + " horribble " + plain[2], plain[0] * 50 + " horrible"])
    assert found[0] < 0 < found[1] and found[2] > 0 and found[3] > 0
    out = {r.doc_id: r.p for r in odd_docs.where("doc_id is not null").select("doc_id", tox.toxicity(model).alias("p")).collect()}
    assert all(0 <= p <= 1 for p in out.values()) and out[0] == out[1] == out[2]
    assert no_docs.select(tox.toxicity(model)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 < tox._sigmoid(np.array([tox.train(odd_docs, labels).bias]))[0] < 0.5


def test_toxicity_labels_and_whole_texts_of_the_sample(spark):
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(None, "nobody"), (learned[0], None)], "doc_id long, text string")
    marks = [(i, 0) for i in range(60)] + [(learned[1], 1), (learned[2], None), (learned[3], 7), (None, 1), (999, 1)]
    found = tox.sample(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), tox.Config())
    assert dict(zip(found["_id"], found["_y"])) == {i: int(i == learned[1]) for i in learned}
    # the only bad word of a long text is learned from wherever it stands
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["tree", "house", "river", "green", "walk", "stone"], 3000)) for _ in range(60)]
    bad = [" ".join([*t.split()[: 97 * (i + 1) % 3000], "horrible", *t.split()[97 * (i + 1) % 3000 :]]) for i, t in enumerate(plain[:30])]
    score = tox.Scorer(tox.fit(plain[30:] + bad, [0] * 30 + [1] * 30, tox.Config(epochs=60)))(["a green horrible stone", "a green stone"])
    assert score[0] > 0 > score[1]


def test_toxicity_held_out(spark):
    got = tox.op1_toxicity(spark, "/root/testdata/sf0.01")
    y = common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic")
    r = got.join(y, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and r > 0.85


# ---- vectors


def vector_rows(spark, n=120, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(scale=0.12 * (1 + i % 3), size=16)], i % 2) for i in range(n)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, [2 * x for x in rows[0][1]], 0), (503, None, 0), (504, [0.0] * 16, 1), (505, [float("nan")] + [1.0] * 15, 1),
             (506, [None] + [1.0] * 15, 1), (507, rows[0][1], None), (508, [1.0, 2.0], 0), (509, [], 0), (510, [float("inf")] + [1.0] * 15, 0)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, copies string")


@pytest.mark.parametrize("cfg", [forest.Config(), forest.Config(leaf=20, block=15, sample=60, trees=20)])
def test_forest_against_brute_force(spark, cfg):
    rows, df = vector_rows(spark)
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {(i, j) for i, a, k in good for j, b, m in good if i != j and k == m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93}
    top = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, j in links:
            top[i] = min(top[i], top[j])
    want = {(i, sum(a == i for a, _ in links), top[i], top[i] == i) for i, _, _ in rows}
    got = {tuple(r) for r in forest.near_vectors(df, cfg).collect()}
    assert got == want and len(links) > 50
    assert forest.near_vectors(df.limit(0), cfg).count() == 0


def test_forest_keeps_a_dense_group_together(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = unit(np.sqrt(0.95) * unit(rng.normal(size=64)) + np.sqrt(0.05 / 64) * rng.normal(size=(2700, 64)))
    x = np.concatenate([group, unit(rng.normal(size=(5400, 64)))])
    x[-100:] = unit(x[-200:-100] + 0.03 * rng.normal(size=(100, 64)))
    assert np.ceil(np.log2(len(x) / forest.Config().leaf)) >= 5
    tree = forest.grow(x, 6, forest.Config(), 0)
    assert tree.whole and sum(len(rows) for _, rows in tree.leaves(group)) < 4 * len(group)
    links = x @ x.T >= 0.93
    np.fill_diagonal(links, False)
    top = np.arange(len(x))
    while (low := np.minimum(top, np.where(links, top, len(x)).min(axis=1))).tolist() != top.tolist():
        top = low
    want = {(i, int(n), int(t), i == t) for i, (n, t) in enumerate(zip(links.sum(axis=1), top))}
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {tuple(r) for r in forest.near_vectors(df).collect()}
    assert links.sum() > 5_000_000 and got == want


# ---- packing


def test_packing_holds_every_id_once(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    got = packing.pack(odd_docs, path).collect()
    ids = collections.Counter()
    for i, t in rows_of(odd_docs):
        ids[(i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, want in collections.Counter(k for k, n in ids.items() for _ in range(n)).items():
        doc, data = i
        mine = [r for r in pieces[doc] if r.doc_tokens == len(data) // 4]
        assert sum(r.length for r in mine) == want * len(data) // 4
        assert all(bytes(r.ids) == data[4 * r.start : 4 * (r.start + r.length)] for r in mine)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(no_docs, path).count() == 0


def test_differencing_is_near_equal_and_raises_windows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 300).tolist()
    sets = packing.difference(sizes, 40)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(300)) and max(sums) - min(sums) <= 20  # one per cent
    assert len(packing.windows_for([1500, 1500, 1000], 2048)) == 3


def test_segment_ids_equal_the_tokenizer(spark):
    import random

    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.TextEncoder(bpe.Encoder(ranks), public_tokenizers.PATTERN)
    r = random.Random(3)
    letters = "ab AB \n\t\x0b\x1c\x85\xa0 éß漢字😀01²½'s're!?--  \r\n.,"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["a" * 3000, " " * 500, "=-" * 900, " a", "a ", "<|endoftext|>"]
    ours = coder.encode_many(texts)
    for t, x in zip(texts, ours):
        ids = np.frombuffer(x, "<u4").tolist()
        assert ids == theirs.encode_ordinary(t) and coder.encoder.decode(ids) == t.encode()
    for _ in range(60):
        data = "".join(r.choice(letters) for _ in range(80)).encode()
        a = r.randint(0, len(data))
        b = r.randint(a, min(len(data), a + 6))
        assert bpe.Prefix(coder.encoder, data).edit(a, b, b"the").last == bpe.Prefix(coder.encoder, data[:a] + b"the" + data[b:]).last
        assert bpe.Prefix(coder.encoder, data[:a]).append(data[a:]).last == bpe.Prefix(coder.encoder, data).last


def test_packing_ids_equal_the_tokenizer():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    theirs, coder = Tokenizer.from_file(path), packing.tokenizer(path)
    coder.keep = 200  # generations change all the time
    r = random.Random(4)
    letters = "abS AB \n\t\x0b\x1c\x85\xa0 　 ᠎​ éßñ×÷ªдЖ漢字😀…—01²½'''s're'll!?--  \r\n.,"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 500, "=-" * 900, " a", "a ", "", "\n", "\nA\n", "a <|endoftext|> b", "été. Ça\nvà; don't, 1st\n\nЖд, x's"]
    held = pa.concat_arrays([pa.array(["left out"]), pa.array([*texts, None])]).slice(1)
    for _ in range(2):
        got = [x for at in range(0, len(held), 97) for x in coder(held.slice(at, 97))]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [theirs.encode(t or "", add_special_tokens=False).ids for t in [*texts, None]]


def test_packing_encodes_a_word_once():
    """Marks and line ends around a word, and batches that it comes back in, give the tokenizer nothing new."""
    import pyarrow as pa

    coder, seen = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY)), []
    inner = coder.encode_pieces
    coder.encode_pieces = lambda parts: (seen.extend(parts), inner(parts))[1]
    words = [a + b for a in ("bla", "nor", "kis") for b in ("ta", "mé", "ru")]
    text = " ".join(a + m + b for a in words for b in words for m in (" ", ", ", ".\n", "; ", "$$$ ", "\n"))
    coder(pa.array([text]))
    coder(pa.array([text + ".", text]))
    coder.young, coder.old = {}, coder.young  # an older generation is asked too
    coder(pa.array([text]))
    assert len(seen) == len(set(seen)) and len([p for p in seen if p.strip() in words]) <= 2 * len(words)
    assert all(p.strip() in words or not any(w in p for w in words) for p in seen)


def test_bpe_round_trip(spark, odd_docs, no_docs):
    path = public_tokenizers.path(bpe.VOCABULARY)
    got = bpe.decode(bpe.encode(odd_docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in got) == sorted((i or -1, (t or "").encode()) for i, t in rows_of(odd_docs))
    assert bpe.encode(no_docs, path, public_tokenizers.PATTERN).count() == 0


# ---- sharding


@pytest.mark.parametrize("cfg", [sharding.Config(), sharding.Config(shards=3, cells=4, fine=2, sub_rows=2)])
def test_sharding(spark, odd_docs, no_docs, cfg):
    got = sharding.shard(odd_docs, cfg).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(odd_docs))
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and max(by_shard) < cfg.shards
    where = {r.doc_id: r.shard for r in got}
    assert where[4] == where[5] == where[None] and where[8] == where[9]
    assert sharding.shard(no_docs, cfg).count() == 0


def test_sharding_against_plain_scheduling(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    sizes = collections.Counter()
    for _, t in rows_of(docs):
        sizes[t] += len((t or "").encode()) + 8
    loads = [0] * 24
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = collections.Counter()
    where = collections.defaultdict(set)
    for r in sharding.shard(docs).select("shard", "size", "text_crc32").collect():
        got[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert len(got) == 24 and sum(got.values()) == sum(loads) and max(map(len, where.values())) == 1
    assert max(got.values()) <= 1.01 * max(loads) and min(got.values()) >= 0.99 * min(loads)


# ---- near duplicates


def brute_components(docs, size, percent=80):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    top = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    return sorted((i if i is not None else -1, len(a), top[i] if i is not None else -1) for i, a in sets)


@pytest.mark.parametrize("cfg", [minhash.Config(words=2), minhash.Config(words=5, block=3, broadcast_ids=4)])
def test_minhash_against_brute_force(spark, odd_docs, no_docs, cfg):
    import random

    r = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    chain = []
    for k in range(40):  # neighbours are near, the ends are not
        if k % 2:
            words[r.randrange(150)] = f"n{k}"
        chain.append((100 + k, " ".join(words)))
    df = odd_docs.select("doc_id", "text", "set").union(spark.createDataFrame([(i, t, "z") for i, t in chain], "doc_id long, text string, set string"))
    got = minhash.near_duplicates(df, cfg).collect()
    have = sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id if x.doc_id is not None else -1) for x in got)
    assert have == brute_components(rows_of(df), cfg.words)
    assert minhash.near_duplicates(no_docs, cfg).count() == 0


@pytest.mark.parametrize("block", [1500, 40])
def test_minhash_family_of_like_texts_returns_rows_not_pairs(spark, block):
    """Texts at a similarity of about 0.7 share buckets without being near copies; one near copy hides among them."""
    import random

    r = random.Random(5)
    base = [f"w{k}" for k in range(300)]

    def like(i):
        words = list(base)
        for k in r.sample(range(300), 13):
            words[k] = f"x{i}_{k}"
        return words

    texts = [like(i) for i in range(160)]
    texts.append(texts[140][:-3])  # a near copy of one of them
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    cfg = minhash.Config(words=2, block=block)
    got = minhash.near_duplicates(df, cfg).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows_of(df), 2)
    sk = minhash.sketches(df, cfg).withColumn("c", F.col("id")).withColumn("comp", F.col("id"))
    rows = sk.select("c", "comp", "n_shingles", "sig", F.explode("bands").alias("bucket"), F.lit(minhash.UNIT // block).cast("long").alias("weight"))
    found = minhash.likely(minhash.dealt(rows, "bucket", cfg), cfg)
    assert found.select("c").distinct().count() > 150 and found.count() <= 26 * 161


def test_set_links_against_all_pairs():
    r = np.random.default_rng(3)
    for trial in range(20):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 40)).astype(np.uint64)) for _ in range(25)]
        comp, own = r.integers(0, 20, 25), r.integers(0, 2, 25)
        cross = bool(trial % 2)
        found = minhash.set_links([len(s) for s in sets], np.concatenate(sets), comp, own, cross, 60)
        want, have = np.arange(20), np.arange(20)
        pairs = [(a, b) for a in range(25) for b in range(a) if (not cross or own[a] != own[b])
                 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))]
        assert all((max(p), min(p)) in pairs for p in found) and len(found) < 20
        for label, links in ((want, pairs), (have, found)):
            minhash.join_labels(label, np.array([comp[a] for a, _ in links], dtype=int), np.array([comp[b] for _, b in links], dtype=int))
        assert (want == have).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)]
    got = {r.u: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 130))


# ---- repeated passages


def brute_removed(docs, length):
    seen = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_suffix_dedup_against_brute_force(spark, odd_docs, no_docs, block):
    docs = odd_docs.where("doc_id is null or doc_id != 3")
    cut = suffix.removed(docs, suffix.Config(block=block)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in cut)
    assert got == brute_removed(rows_of(docs), 400)
    assert suffix.removed(no_docs).count() == 0


# ---- lattice


def test_lattice_base_and_recursion(spark, odd_docs, no_docs):
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    index = {n: i for i, n in enumerate(pieces.names)}

    def slow(word):
        m = lattice.MARK + word
        a = [1.0] + [0.0] * len(m)
        for e in range(3, len(m) + 1):
            a[e] = sum(a[s] * math.exp(pieces.logp[index[m[s:e]]]) for s in [0, *range(3, e)] if m[s:e] in index)
        return math.log(a[-1])

    words = [b"the", b"hello", b"x", "été".encode(), b"\xff\x00a"]
    assert np.allclose(pieces.score(words), [slow(w) for w in words])
    # expected counts of pieces: the slope of the log-probability in a piece's own
    expected, weights = np.zeros(len(pieces.names)), np.array([2.0, 1.0, 3.0, 1.0, 1.0])
    pieces.score(words, weights, expected)
    for piece in np.flatnonzero(expected)[:12]:
        logp = pieces.logp.copy()
        logp[piece] += 1e-6
        more = lattice.Pieces(pieces.names, logp).score(words) - pieces.score(words)
        assert math.isclose((more * weights).sum() / 1e-6, expected[piece], rel_tol=1e-3, abs_tol=1e-6)
    cfg = lattice.Config(head=5)
    got = lattice.score_texts(odd_docs, pieces, cfg).collect()
    train = collections.Counter()
    docs = rows_of(odd_docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in docs:
        if not held(i):
            train.update(lattice.words_of(t) + [b""])
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, held(i), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6))
                  for i, t in docs for w in [lattice.words_of(t) + [b""]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score_texts(no_docs, pieces, cfg).count() == 0


def test_lattice_score_is_the_lattice_alone(spark):
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    cfg = lattice.Config(rounds=0, head=2)
    docs = spark.createDataFrame([(i, "the river the house" if i % 2 else "the") for i in range(12)], "doc_id long, text string")
    train = [i for i in range(12) if zlib.crc32(str(i).encode()) % 7 != 2]
    n = sum(5 if i % 2 else 2 for i in train)
    end = (len(train) + 1) / (n + 2)
    the, river, house = pieces.score([b"the", b"river", b"house"]) / math.log(10) + math.log10(1 - end)
    for r in lattice.score_texts(docs, pieces, cfg).collect():
        want = (2 * the + river + house if r.doc_id % 2 else the) + math.log10(end)
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.score < r.mixed_score


def test_lattice_of_words_of_one_length_needs_no_sorted_arcs(monkeypatch):
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinorst.é漢"), 1 + k % 12)).encode() for k in range(600)] + [b"", b"the", b"x" * 30]
    weights = rng.integers(1, 9, len(words)).astype(float)
    want, got = np.zeros(len(pieces.names)), np.zeros(len(pieces.names))
    sorted_arcs = pieces.forward(words, weights, want)
    monkeypatch.setattr(lattice.Pieces, "arcs", lambda *_: pytest.fail("arcs of short words were listed and sorted"))
    assert np.allclose(pieces.score(words, weights, got), sorted_arcs, rtol=1e-12) and np.allclose(got, want, rtol=1e-9)
    assert np.allclose(pieces.score(words), sorted_arcs, rtol=1e-12) and len(pieces.score([])) == 0
    monkeypatch.undo()
    monkeypatch.setattr(lattice, "SAFE", 100.0)  # longer words' paths are too unlikely for plain probabilities
    assert np.allclose(pieces.score(words), sorted_arcs, rtol=1e-12)


def test_lattice_words_of_arrays_and_small_batches():
    texts = [None, "", " ", "\t\n a\x0b b \x0c", "One\x1cTWO\u3000É\r\nx", "x"]
    begins, words = lattice.tokens_of(lattice.pa.array(["before", *texts]).slice(1))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(begins, begins[1:])] == [lattice.words_of(t) + [b""] for t in texts]
    # the words of many small batches are spelled together
    small = [lattice.pa.record_batch({"word": [f"{k}-{i}".encode() for i in range(100)], "c": list(range(100))}) for k in range(25)]
    made = list(common.gathered(iter(small), "word", 1000, 1 << 20))
    assert [b.num_rows for b in made] == [1000, 1000, 500] and lattice.pa.Table.from_batches(made).equals(lattice.pa.Table.from_batches(small).combine_chunks())
    assert [b.num_rows for b in common.gathered(iter(small), "word", 1000, 1)] == [1] * 2500
    text, word, n = common.first_pairs(np.array([0, 0, 0, 2, 2, 2]), np.array([7, 3, 7, 5, 0, 0]))
    assert (text.tolist(), word.tolist(), n.tolist()) == ([0, 0, 2, 2], [7, 3, 5, 0], [2, 1, 1, 2])


def test_lattice_scores_follow_the_length_of_a_run(spark):
    pieces = lattice.vocabulary(public_tokenizers.path(lattice.VOCABULARY))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    unit = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(500))
    texts = [(held[0], unit * 240), (held[1], unit * 480)] + [(i, "plain words") for i in range(20) if i not in held]
    got = {r.doc_id: r.score for r in lattice.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), pieces).collect()}
    assert got[held[0]] < -1e6 / math.log(10) and 1.99 < got[held[1]] / got[held[0]] < 2.01


# ---- language


def test_language_words_and_edges(spark, odd_docs, no_docs):
    runs = [("en", "the house and the river that was with them on this day".split()), ("de", "das haus und der fluss die wir nicht mit ihnen sehen".split())] * 12
    model = language.fit(runs, language.Config(epochs=40))
    labels = [x[1] for x in language.label_words(model, "the river and the house das haus und der fluss")]
    assert labels == ["en"] * 5 + ["de"] * 5
    out = {r.doc_id: r.p for r in odd_docs.where("doc_id is not null").select("doc_id", language.language(model).alias("p")).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 13)) and out[3].lang_pred in ("en", "de")
    assert no_docs.select(language.language(model)).count() == 0
    empty = language.train(no_docs)
    assert {r.p.lang_pred for r in odd_docs.select(language.language(empty).alias("p")).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    assert [language.words(t) for t in ("½ ²", "Ⅷ", "①②", "12 3", "a½b Ⅷc")] == [[], [], [], [], ["a", "b", "c"]]
    model = language.fit([("en", "the river".split()), ("de", "der fluss".split())], language.Config(epochs=5))
    docs = spark.createDataFrame([(0, "½ ²"), (1, "Ⅷ"), (2, "①②"), (3, "fluss")], "doc_id long, text string")
    assert [r.p.lang_pred for r in docs.orderBy("doc_id").select(language.language(model).alias("p")).collect()] == ["und"] * 3 + ["de"]


def test_language_bound_is_reported(spark):
    docs = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(1500)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_langs"):
        language.sample(docs, language.Config())


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    emit, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, post = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(sum(emit[0, i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, s in enumerate(path):
            post[i, s] += p
    mask = np.ones((1, 4), bool)
    assert np.allclose(language.forward_backward(emit, mask, moves)[0][0], post / total)
    ones = np.ones((1, 3))
    assert np.allclose(language._posteriors(emit.copy(), mask, moves, ones, ones)[0], post / total)


@pytest.mark.parametrize("chain", [1, 3, 7, 256])
def test_language_text_is_one_chain(chain):
    runs = [("en", "the house and the river that was with them on this day".split()), ("de", "das haus und der fluss die wir nicht mit ihnen sehen".split())] * 12
    model = language.fit(runs, language.Config(epochs=20, chain=chain))
    rng = np.random.default_rng(3)
    texts = [list(rng.choice(["the", "house", "haus", "und", "was", "mit", "unseen", "x"], n)) for n in (1, 3, 7, 8, 50, 701)]
    labeller = language.Labeller(model)
    for found, post in zip(texts, labeller.posteriors(texts)):
        emit = labeller.emit[[labeller.rows[w] for w in found]][None].astype(np.float64)
        want = language.forward_backward(emit, np.ones(emit.shape[:2], bool), model.moves)[0][0]
        assert post.shape == want.shape and np.allclose(post, want, atol=1e-4)


def test_language_held_out(spark):
    got = language.op8_language(spark, "/root/testdata/sf0.01")
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    assert got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# ---- fingerprints


@pytest.mark.parametrize("rows", [3, 4000])
def test_fingerprints(spark, odd_docs, no_docs, rows):
    cfg = prints.Config(rows=rows)
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = sorted(rows_of(docs))
    got = {r.doc_id: r for r in prints.compare(docs, cfg).collect()}
    sampler = prints.Sampler(cfg)
    assert len(got) == len(text)
    for k, (i, t) in enumerate(text):
        t, after = t or "", text[(k + 1) % len(text)][1] or ""
        edited = prints.edited_text(t, after)
        own, mine, other = sampler([t])[0], sampler([edited])[0], sampler([after])[0]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), mine.hex())
        assert r.near_edited == prints.likeness(own, mine) and r.near_next == prints.likeness(own, other)
    assert prints.compare(odd_docs, cfg).count() == odd_docs.count() and prints.compare(no_docs, cfg).count() == 0


def test_fingerprint_estimates_generalised_jaccard():
    sampler = prints.Sampler(prints.Config(samples=1024))
    a = collections.Counter({f"t{k}": 1 + k % 4 for k in range(80)})
    b = collections.Counter({f"t{k}": 1 + (k * 7) % 4 for k in range(30, 110)})
    x, y = sampler([" ".join(c.elements()) for c in (a, b)])
    assert abs(prints.likeness(x, y) - sum((a & b).values()) / sum((a | b).values())) < 0.06


def test_fingerprint_draws_of_frequent_terms_are_kept(monkeypatch):
    cfg = prints.Config(keep=60)
    drawn = []
    whole = prints.Sampler._draws
    monkeypatch.setattr(prints.Sampler, "_draws", lambda self, names: (drawn.append(len(names)), whole(self, names))[1])
    sampler = prints.Sampler(cfg)
    texts = [[" ".join([f"often{(i + k) % 20} often{i % 20} rare{10 * batch + i}" for k in range(20)]) for i in range(10)] for batch in range(30)]
    found = [sampler(batch) for batch in texts]
    # 20 frequent terms and the counts in which they occur are drawn once, 10 others and their count in each batch
    assert sum(drawn) <= 30 * 20 + 20 * 4
    fresh = [prints.Sampler(cfg)(batch[::-1])[::-1] for batch in texts]
    assert found == fresh and len({f for batch in found for f in batch}) == 300


def test_fingerprint_takes_the_first_arrival_of_all_terms(odd_docs):
    cfg = prints.Config(samples=16)
    sampler = prints.Sampler(cfg)
    texts = [t or "" for _, t in rows_of(odd_docs)] + [" a\u3000b\x1fa  c\n", "\x85b"]
    for text, got in zip(texts, sampler(texts)):
        counts = collections.Counter(text.split())
        if not counts:
            assert got == b""
            continue
        names = np.array([prints.xxhash.xxh64_intdigest(w.encode()) for w in counts], dtype=np.uint64)
        r, log_c, b = sampler._draws(names)
        n = np.array(list(counts.values()), dtype=np.float32)[:, None]
        step = np.where(n > 1, np.floor(np.log(n) / r + b), np.float32(0))
        first = np.where(n > 1, log_c - r * (step - b) - r, log_c + r * b - r).argmin(axis=0)
        taken = common.scramble(names[first] + step[first, np.arange(16)].astype(np.int32).astype(np.uint64))
        assert got == (taken >> np.uint64(32)).astype(">u4").tobytes()


# ---- pipeline


def test_pipeline_stages(spark, odd_docs):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").withColumn("label", F.lit(1))
    for name, stage in pipe.STAGES:
        before, docs = docs, common.saved(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    odd = odd_docs.withColumn("n_chars", F.length("text"))
    assert pipe.cut_repeats(spark, odd, sf).columns == odd.columns
    kept = [r.doc_id for r in pipe.drop_near_duplicates(spark, odd, sf).select("doc_id").collect()]
    assert 5 not in kept and 9 not in kept and kept.count(7) == 1 and kept.count(4) == 1


def test_passages_of_fifty_words_go_and_the_rest_stays(spark):
    import corpus_pipeline as pipe

    passage = " ".join(f"word{i:02d}" for i in range(52))  # 363 bytes, less than op6's own length
    assert pipe.REPEATED_BYTES < len(passage) < suffix.Config().length
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(60)) + chr(97 + i) + (f" {passage} " if i % 3 == 0 else " ") + f"{i} is the end") for i in range(12)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in pipe.cut_repeats(spark, docs, "").collect()}
    for i, t in rows:
        assert got[i].text == (t.replace(f" {passage} ", "") if i % 3 == 0 else t) and got[i].n_chars == len(got[i].text)


def test_near_duplicates_are_decided_by_row(spark):
    import corpus_pipeline as pipe

    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, a), (4, ""), (4, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in pipe.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (4, ""), (None, a)], key=str)
