import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import op11_collocation as phrases
from offerlake.llm import op12_prefix_trie as tries
from offerlake.llm import op13_disclosure as private

# ---- phrases


@pytest.mark.parametrize("high_bits, low_bits", [(3, 4), (12, 12), (24, 24), (40, 63)])
def test_quotient_filter_keeps_everything(high_bits, low_bits):
    rng = np.random.default_rng(high_bits)
    parts = []
    for n in (0, 1, 500, 3000):
        high = rng.integers(0, 2**high_bits, n).astype(np.uint64)
        low = rng.integers(0, 2**low_bits, n).astype(np.uint64)
        high, low, _ = phrases.sum_sorted(high, low, None)
        counts = np.where(rng.random(len(high)) < 0.6, 1, rng.integers(1, 2 ** rng.integers(1, 50, len(high)).clip(1)))
        kept = phrases.QuotientFilter.from_bytes(phrases.QuotientFilter.of(high, low, counts, high_bits, low_bits).to_bytes())
        got = kept.entries()
        assert all(a.tolist() == b.tolist() for a, b in zip(got, (high, low, counts)))
        parts.append((kept, dict(zip(zip(high.tolist(), low.tolist()), counts.tolist()))))
    want = collections.Counter()
    for _, entries in parts:
        want.update(entries)
    high, low, counts = phrases.merge([f for f, _ in parts])
    keys = list(zip(high.tolist(), low.tolist()))
    assert keys == sorted(want) and dict(zip(keys, counts.tolist())) == want


@pytest.mark.parametrize("width", [2, 5, 16, 21, 33, 42])
def test_packed_words_come_back(width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, 2**width, 400).astype(np.uint64) for _ in range(3)]
    packing = phrases.Packing(width, 1)
    high, low = packing.pack(*ids)
    assert max(high.max(), low.max()) < 2**packing.half
    assert all((a == b).all() for a, b in zip(packing.unpack(high, low), ids))
    assert len(set(zip(high.tolist(), low.tolist()))) == len(set(zip(*[i.tolist() for i in ids])))


def brute_phrases(rows, least, cover, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {c for c in f if len(c[1]) > 1 and f[c] >= least}
    out = collections.defaultdict(list)
    for lang, p in cands:
        a = f[lang, p]
        if any(m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(2)) and 100 * f[m, q] >= cover * a for m, q in cands):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])}


def test_phrases_against_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    words = ["a", "B", "b", "été", "ÉTÉ", "x\x85y", "\x1c", "c-d", "漢字", "word\xa0w"]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "! ?", ";"]
    rows = [(lang, "".join(w + g for w, g in zip(rng.choice(words, n), rng.choice(gaps, n)))) for n in (0, 3, 40, 400) for lang in ("fr", "de", "", None)]
    rows += [("fr", "one two three. one two three"), ("fr", None), (None, "")] + [("hot", "same copy of a text")] * 30
    df = spark.createDataFrame([(i, t, g, "clash") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, word string").repartition(3)
    for cfg in (phrases.Config(least=2, top=50, chunk=100, batch=300, part=64, groups=3), phrases.Config(least=5)):
        got = {tuple(r) for r in phrases.collocations(df, cfg).collect()}
        assert got == brute_phrases(rows, cfg.least, cfg.cover, cfg.top) and len(got) > 20
    assert phrases.collocations(odd_docs, phrases.Config(least=3)).count() > 0
    assert phrases.collocations(no_docs).count() == 0


# ---- conversations


def test_parentheses_close_like_a_stack():
    rng = np.random.default_rng(5)
    for n, up in ((1, 0.5), (40, 0.5), (3000, 0.6), (20_000, 0.52), (3000, 1.0)):
        bits, height = [True], 1
        while len(bits) < n or height:
            rise = (len(bits) < n and rng.random() < up) or (height == 1 and len(bits) < n)
            bits.append(rise)
            height += 1 if rise else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = tries.Parentheses(np.array(bits))
        assert dict(zip(tree.opens.tolist(), tree.close(tree.opens).tolist())) == want


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under),
                    sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in under) for q in under),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(90):
        for turn in range(int(rng.integers(1, 12))):
            rows.append((c + 3, turn, str(rng.choice(["user", "assistant"])), "été " * int(rng.integers(0, 3))))
    rows += [(c, t, "user", f"hot {t}") for c in range(200, 260) for t in range(12)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(400)] + [(c, 0, "user", "only") for c in (301, 302, 303, 1001)]
    rows += [(400, None, None, "null turn first"), (400, 0, "user", None), (400, 1, None, None), (None, 0, "user", "no id"), (401, 5, "b", "tie"), (401, 5, "a", "tie")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(5)
    return rows, df


@pytest.mark.parametrize("cfg", [tries.Config(), tries.Config(shard_turns=40, shared_key=3, id_block=16)])
def test_trie_against_brute_force(spark, cfg):
    rows, df = conversation_rows(spark)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sequences = tries.rebuilt(tries.turns(df), heads, F.col("conv_id") - F.pmod("conv_id", F.lit(5)))
    got = sorted([tuple(r) for r in tries.trie(sequences, cfg).collect()], key=str)
    assert got == brute_trie(rows)
    none = tries.rebuilt(tries.turns(df.limit(0)), heads, F.col("conv_id"))
    assert tries.trie(none, cfg).count() == 0


# ---- personal data

BASE = {  # the contract's patterns
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = sum(digits[::-1][::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::-1][1::2])
        return 16 <= len(digits) <= 19 and odd % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m.group())] for k, p in BASE.items()]


def test_base_spans_against_the_plain_patterns(spark):
    rng = np.random.default_rng(3)
    bits = ["a", "b.c", "@", "@@", ".", "..", "%", "-", " ", "  ", "+", "(", ")", "1", "22", "255", "256", "000255", "4111111111111111", "4111-1111 1111 1111",
            "+33 (0)1.22", "😀", "é", "x@y.z", "1.2.3.4", "\n", "٣", "12345678901234567890"]
    texts = ["".join(rng.choice(bits, int(n))) for n in rng.integers(0, 40, 400)]
    texts += [None, "", "a@b.c@d.e", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "a@" + "b." * 5 + "c", "+1234567890(", "4111 1111 1111 1111 4111 1111 1111 1111"]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = {r.doc_id: [[(s.start, s.end) for s in r[k]] for k in private.KINDS] for r in private.personal_data(df, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [base_spans(t) for t in texts]


def test_very_long_runs_neither_overflow_nor_stall(spark):
    texts = ["x" * 100_000, "1" * 100_000, "1 " * 50_000, "a@" + "b." * 50_000 + "c", "1.2." * 6_000, "+1" + "(" * 100_000, "a@b" * 60_000]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(7)
    found = {r.doc_id: [len(r[k]) for k in private.KINDS] for r in private.personal_data(df, keep=["doc_id"]).collect()}
    assert found[0] == found[1] == found[2] == found[5] == found[6] == [0, 0, 0, 0] and found[3] == [1, 0, 0, 0] and found[4][1] == 3_000


def test_telling_words_go_and_clean_texts_stay(spark, odd_docs, no_docs):
    hidden = "mail Zorbax of bay 77 at zx@corp.example.com today"
    rows = [hidden, "again zorbax: ZX@corp.example.com " + "filler " * 30 + "Zorbax signs", hidden] + [f"plain text {i} today of a day with words at work" for i in range(60)]
    rows += ["mail today"] * 4 + [None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, terms string").repartition(4)
    out = {r.doc_id: r for r in private.sanitise(df).collect()}
    assert out[0].sanitised == out[2].sanitised == "mail  of   at [EMAIL] today"
    assert out[1].sanitised == "again :  " .replace(":  ", ": ") + "[EMAIL] " + "filler " * 30 + " signs"
    assert all(out[i].sanitised == rows[i] for i in range(3, len(rows)))
    n = len(rows)
    told = private.disclosures(df, private._base_rows(df, private.Config(), "text", ["doc_id"]), private.Config(generalise=0.0), "text")
    share = {r.term: r.disclosure for r in told.collect()}
    assert share["bay"] == share["zorbax"] == 1 and share["mail"] == pytest.approx(np.log(n * 2 / (3 * 6)) / np.log(n / 3))
    assert "filler" not in share or share["filler"] <= 1
    general = private.sanitise(df, private.Config(remove=1.1)).where("doc_id = 0").first().sanitised
    assert general == "mail [NAME] of [WORD] [NUMBER] at [EMAIL] today"
    assert private.sanitise(odd_docs).count() == odd_docs.count() and private.sanitise(no_docs).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = private.personal_data(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
