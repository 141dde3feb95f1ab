"""Parity join, source divergence and conversation trie on small tables
against plain Python: awkward rows, hot keys, small blocks and queues."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from reviewlens.llm import conversation_trie as trie  # noqa: E402
from reviewlens.llm import divergence  # noqa: E402
from reviewlens.llm import parity_join as parity  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, key string, row int, label string, items string"


def texts():
    """Awkward texts, a group of near copies, links at the very threshold."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=160)
    out = [None, "", " \n\t", "one", "ONE", "two words", "two  Words ", "a b c d", "A b c d e", "x y z x y z x y z x"]
    for i in range(40):  # near copies of one text, and of each other
        t = list(base)
        for _ in range(i % 6):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    out += [" ".join(base[:k]) for k in (20, 21, 22, 23, 24, 25, 26, 140, 150)]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 50))) for _ in range(40)]
    out += ["long text " * 30_000, " ".join(f"v{i}" for i in range(15_000)), " ".join(f"v{i}" for i in range(14_000))]
    return out


def rows():
    made = [(i, t, ("en", "de", None)[i % 3], (None, "s1", "s2", "")[i % 4], 1, "k", 2, "l", "i")
            for i, t in enumerate(texts())]
    return made + [made[12], made[3], (None, "no id here at all", "en", "s9", 1, "k", 2, "l", "i"),
                   (7000, "", "none", "", 1, "k", 2, "l", "i")]


def link_classes(data, num=85, den=100):
    sets = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(data)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(data):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(data)]


def order(x):
    return sorted(x, key=str)


@pytest.mark.parametrize("small,block,batch", [(8, 2048, 10_000), (1, 3, 5), (2, 4, 1)])
def test_parity_join_equals_brute_force(spark, monkeypatch, small, block, batch):
    monkeypatch.setattr(parity, "SMALL", small)
    monkeypatch.setattr(parity, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = parity.jaccard_join(spark.createDataFrame(rows(), DOCS).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = link_classes([(r[0], r[1]) for r in rows()])
    assert order((r.id, r.n_shingles, r.component_id) for r in got) == order(want)
    assert len({c for _, _, c in want}) < len(want) - 30


def test_parity_join_of_nothing(spark):
    assert parity.jaccard_join(spark.createDataFrame([], DOCS)).collect() == []


def test_refuted_pairs_of_a_cell_lose_no_link(spark, monkeypatch):
    """Sketches of one bit allow every pair, so most told pairs fail."""
    monkeypatch.setattr(parity, "SMALL", 1)
    monkeypatch.setattr(parity, "small_sketch", lambda h, num, den: np.zeros(1, np.uint64))
    monkeypatch.setattr(parity, "segment_keys", lambda h, num, den: np.zeros(1, np.uint64))
    data = [(i, " ".join(f"{c}{k}" for k in range(30 + i % 3)), None, None, 1, "", 1, "", "")
            for i, c in enumerate("abcdefabcdefabcdef")]
    got = parity.jaccard_join(spark.createDataFrame(data, DOCS)).collect()
    assert order((r.id, r.n_shingles, r.component_id) for r in got) == order(link_classes([r[:2] for r in data]))


@pytest.mark.parametrize("num,den", [(85, 100), (1, 2), (1, 1), (95, 100)])
def test_linked_sets_share_a_key_and_differ_within_the_sketch_bound(num, den):
    rng = random.Random(5)
    for _ in range(300):
        size = rng.choice([1, 3, 7, 20, 100, 700])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        for _ in range(rng.randint(0, size // 3 + 1)):
            b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(64))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        u, v = (parity.small_sketch(s, num, den)[None, :] for s in (x, y))
        words = min(u.shape[1], v.shape[1])
        far = int(np.bitwise_count(parity.fold(u, words) ^ parity.fold(v, words)).sum())
        assert far <= len(a ^ b)
        if den * len(a & b) >= num * len(a | b):
            assert len(a ^ b) <= parity.most_different(len(a), len(b), num, den)
            assert set(parity.segment_keys(x, num, den)) & set(parity.segment_keys(y, num, den))


# ---- source divergence ----

def audit_plainly(data, min_docs=3, top=200):
    docs = [((l or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]+", lambda m: m[0].lower(), t or ""))) for t, l, s in data]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= min_docs)
        v = len(kept)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        def f(a, b):
            return (a - b) ** 2 // b

        for s, c in counts.items():
            pair = [(sum(f(p(c, t), p(o, t)) for t in kept), i) for i, o in counts.items() if i != s]
            term = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, value, k) for k, (value, i) in enumerate(found[:most], 1)]
    return out


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_divergence_equals_plain_sums(spark, monkeypatch, held):
    real = divergence.tree_corrections
    monkeypatch.setattr(divergence, "tree_corrections", lambda paths: real(paths, held))
    rng = random.Random(4)
    words = ["Apple", "apple", "bär", "Ärger", "a1b", "中文", "x", "y", "z"] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    data = [(" ".join(rng.choices(words, weights=[9] * 9 + [1] * 80, k=rng.randint(0, 40))),
             rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "é", None])) for _ in range(120)]
    data += [(None, "xx", "a"), ("only one", "xx", "b"), ("", "xx", None), ("long " * 20_000 + "short", "en", "a"),
             data[0], data[0]]
    df = spark.createDataFrame([(*r, 1, "k") for r in data], "text string, lang string, source string, value int, term string")
    got = divergence.audit(df.repartition(4), top_terms=20).collect()
    assert order(map(tuple, got)) == order(audit_plainly(data, top=20))


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).collect() == []


# ---- conversation trie ----

CONV = "conv_id bigint, turn int, role string, text string, depth string, key int"


def trie_plainly(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


def conversations():
    rng = random.Random(2)
    out = [(c, k, rng.choice(["user", "bot", None]), rng.choice(["hi", "ho", "héllo", None, "", "long " * 5000]))
           for c in list(range(60)) + [-3, -7, 10**12] for k in range(rng.randint(1, 9))]
    out += [(c, k, "user", f"same {k}") for c in range(100, 160, 5) for k in range(4)]
    out += [(9, None, "user", "first"), (200, 0, "u", "t"), (200, 0, "u", "t"), (None, 1, "u", "t"), (305, 3, "a", "b" * 9)]
    out += [(400, k, "u", f"turn {k % 7}") for k in range(300)]
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 2, "share": 0, "queue_limit": 4}, {"shard_rows": 30, "share": 0}])
def test_trie_equals_plain_trie(spark, monkeypatch, kw):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    df = spark.createDataFrame([(*r, "x", 1) for r in conversations()], CONV).repartition(3)
    got = trie.trie(df, **kw).collect()
    assert order(map(tuple, got)) == order(trie_plainly(conversations()))


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], CONV)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "u", "t", "x", 1)], CONV)).collect() == []


def test_queue_spills_and_gives_all_messages_in_key_order(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    keys = np.array([bytes(x) for x in rng.integers(0, 3, (500, 16), dtype=np.uint8)], "S16")
    keys[::2] = keys[0]
    values = rng.integers(0, 100, (500, 2))
    queue = trie.SpillingQueue(fs.LocalFileSystem(), str(tmp_path / "q"), 64, 2)
    for a in range(0, 500, 7):
        queue.push(keys[a:a + 7], values[a:a + 7])
    assert queue.spilled > 1
    queue.open()
    want = defaultdict(lambda: np.zeros(2, np.int64))
    for k, v in zip(keys, values):
        want[k] += v
    names = np.array(sorted(want), "S16")
    got = {}
    for last in (names[len(names) // 3], names[len(names) // 2], names[-1]):
        part = queue.pop(last)
        assert (np.sort(part[0]) == part[0]).all() and (part[0] <= last).all() and not set(part[0]) & set(got)
        got |= dict(zip(part[0], part[1].tolist()))
    assert got == {k: v.tolist() for k, v in want.items()}
    assert queue.pop(names[-1]) is None
