"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of
``shingle`` words joined by a blank (a shorter text: its whole sequence),
repeats counted; XXH64 (seed 42) of each; a bit is 1 when it is set in over
half of the hashes. No word: fingerprint 0, linked like any other.

Links at no more than 4 differing bits, whatever the pair, come from keys:

* The 64 bits are cut into segments of 22, 21 and 21 bits, each a word of the
  perfect [23,12] Golay code with leading zeros. ``near(x)`` lists the
  codewords within 4 bits of x: one within 3 bits always, and up to five more
  at 4. Two words that differ in at most 1 bit: the nearest codeword of
  either is in near() of the other. Two words that differ in 2 bits share a
  codeword in their near() lists (the Steiner system S(4,7,23)).
* Pigeonhole: with 4 errors over three segments, either two segments have at
  most 1 error each, or one has none and each other has 2.
* First case, for each pair (s, t) of segments: a left key (nearest(s),
  c in near(t)) and a right key (c in near(s), nearest(t)) meet. 24 bits.
* Second case, for each s and the segment t after it: s itself and c in
  near(t). 34 bits.

That is about 48 keys of 16 bytes for a *distinct* fingerprint; texts and
copies never enter the join. Rows of one key are compared in arrays, and only
a spanning forest of the verified links leaves a task, never all pairs of a
group: links inside a group of g near copies cost at most g - 1 edges a key.
Connected components of the forest edges are those of all links.

``max_bits`` below 4 is verified the same way; above 4 the pigeonhole fails
and ``near_dedup`` refuses. Ids: the smallest id of a component names it; null
ids come after all others. Repeated rows get the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, worker_cache, written
from .components import components

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the binary Golay code (fixed value)
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
SMALL = 24  # groups up to this size are compared by shifts of the whole batch


def simhash_digest(text: bytes, shingle: int) -> bytes:
    """The fingerprint as 8 bytes, highest first."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    xxh = xxhash.xxh64_digest
    hashes = b"".join([xxh(joined[a:b], 42) for a, b in spans])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for a in range(0, n, 4096):
        ones += np.unpackbits(rows[a:a + 4096], axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """64-bit fingerprint (as a signed bigint) of each whole text."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for batch in batches:
            out = b"".join([simhash_digest((t.as_py() or "").encode(), shingle) for t in batch])
            yield pa.array(np.frombuffer(out, ">i8").astype(np.int64))

    return simhash(text)


def golay():
    """(syndrome table over the high 12 bits, over the low 11, error patterns
    of weight up to 4 by syndrome, nearest first, -1 where there are fewer).
    Built from the generator polynomial; kept by the worker."""
    import itertools

    import numpy as np

    cache = worker_cache("golay")
    if not cache:
        single = []
        for i in range(23):  # x^i modulo the generator
            r = 1 << i
            for j in range(22, 10, -1):
                if r >> j & 1:
                    r ^= GENERATOR << (j - 11)
            single.append(r)
        patterns = [[] for _ in range(2048)]
        for weight in range(5):
            for places in itertools.combinations(range(23), weight):
                s = e = 0
                for p in places:
                    s, e = s ^ single[p], e | 1 << p
                patterns[s].append(e)
        size = max(map(len, patterns))
        errors = np.full((2048, size), -1, np.int64)
        for s, es in enumerate(patterns):
            errors[s, :len(es)] = es
        tables = []
        for low, bits in ((11, 12), (0, 11)):
            t = np.zeros(1 << bits, np.int64)
            for i in range(bits):
                t[1 << i:2 << i] = t[:1 << i] ^ single[low + i]
            tables.append(t)
        cache["tables"] = (*tables, errors)
    return cache["tables"]


def near(x):
    """Codeword indices (the 12 high bits) within 4 bits of each 23-bit word,
    nearest first; -1 where there are fewer."""
    import numpy as np

    high, low, errors = golay()
    e = errors[high[x >> 11] ^ low[x & 2047]]
    return np.where(e >= 0, (x[:, None] ^ e) >> 11, -1)


def keys_of(fps):
    """(key, index into fps, side) of every key of the fingerprints: side 1
    and 2 meet each other, side 3 meets its like."""
    import numpy as np

    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    codes = [near(s) for s in seg]
    out = []

    def add(kind, high, low, side):  # one row for each codeword in the lists
        key = (np.int64(kind) << 56) | (high << 12) | low
        ok = (high >= 0) & (low >= 0)
        at = np.broadcast_to(np.arange(len(fps))[:, None], key.shape)
        out.append((key[ok], at[ok], np.full(int(ok.sum()), side, np.int8)))

    for kind, (s, t) in enumerate(((0, 1), (1, 2), (0, 2))):
        add(kind, codes[s][:, :1], codes[t], 1)
        add(kind, codes[s], codes[t][:, :1], 2)
    for kind, s in enumerate((0, 1, 2), 3):
        add(kind, seg[s][:, None], codes[(s + 1) % 3], 3)
    return [np.concatenate(x) for x in zip(*out)]


class Forest:
    """Union-find that keeps the edges that joined something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def group_links(fps, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what the distinct fingerprints of one key connect:
    stars around pivots first, then one link for every two stars that touch.
    Near copies make few stars, so their square is not computed."""
    import numpy as np

    out, stars, rest = [], [], fps
    while len(rest):
        close = np.bitwise_count(rest ^ rest[0]) <= max_bits
        stars.append(rest[close])
        out += [(int(rest[0]), int(x)) for x in stars[-1][1:]]
        rest = rest[~close]
    pivots, forest = np.array([s[0] for s in stars]), Forest()
    for i in range(len(stars)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(pivots[i + 1:] ^ pivots[i]) <= 3 * max_bits):
            if forest.find(i) == forest.find(int(j)):
                continue
            small, large = sorted((stars[i], stars[j]), key=len)
            for x in small:
                hit = np.flatnonzero(np.bitwise_count(large ^ x) <= max_bits)
                if len(hit):
                    out.append((int(x), int(large[hit[0]])))
                    forest.join(i, int(j))
                    break
    return out


def batch_links(key, fp, side, max_bits: int):
    """Verified links of rows sorted by key."""
    import numpy as np

    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    sides = np.bitwise_or.reduceat(side, begin)
    live = (size > 1) & (sides == 3)
    small = np.repeat(live & (size <= SMALL), size)
    key_s, fp_s = key[small], fp[small]
    for lag in range(1, min(SMALL, len(key_s))):
        same = key_s[lag:] == key_s[:-lag]
        if not same.any():
            break
        a, b = fp_s[lag:][same], fp_s[:-lag][same]
        hit = (a != b) & (np.bitwise_count(a ^ b) <= max_bits)
        yield from zip(a[hit].tolist(), b[hit].tolist())
    for b, n in zip(begin[live & (size > SMALL)], size[live & (size > SMALL)]):
        yield from group_links(np.unique(fp[b:b + n]), max_bits)


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fps``: distinct fingerprints (column fp). Returns (a, b): edges whose
    components are those of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys are complete for at most 4 differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 5000):
                key, at, side = keys_of(fp[a:a + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[a:a + 5000][at]), pa.array(side)],
                                                 ["key", "fp", "side"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forest, held = Forest(), [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]

        def found(parts):
            pairs = [(a, b) for a, b in batch_links(*parts, max_bits) if forest.join(a, b)] if len(parts[0]) else []
            cols = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            parts = [np.concatenate(x) for x in zip(held, (new[0], new[1].view(np.uint64), new[2]))]
            cut = np.searchsorted(parts[0], parts[0][-1]) if len(parts[0]) else 0  # the last key may go on
            held = [p[cut:] for p in parts]
            yield found([p[:cut] for p in parts])
        yield found(held)

    keys = fps.select("fp").mapInArrow(expand, "key bigint, fp bigint, side tinyint")
    return (keys.repartition("key").sortWithinPartitions("key")
            .mapInArrow(verify, "a bigint, b bigint").distinct())


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               max_bits: int = 4) -> DataFrame:
    """(id, fp, component_id) of every row."""
    docs = written(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    groups = written(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    linked = written(components(links(groups, max_bits)), "components")
    total = docs.count()
    # the smallest id of each component, then of each linked fingerprint
    member = written(linked.join(groups, linked["node"] == groups["fp"]).select("fp", "root", "least", "n"), "members")
    roots = written(member.groupBy("root").agg(F.min("least").alias("component_id"),
                                               F.count(F.lit(1)).alias("members")), "roots")
    named = lookup(member, roots, "root", "members", total).select("fp", "n", "component_id")
    alone = groups.join(linked, linked["node"] == groups["fp"], "left_anti").select(
        "fp", "n", F.col("least").alias("component_id"))
    return lookup(docs, written(named.unionByName(alone), "named"), "fp", "n", total).select("id", "fp", "component_id")
