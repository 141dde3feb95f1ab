"""Exact n-gram Jaccard join with parity sketches.

A document's set holds the distinct ``shingle``-word shingles of its text (A-Z
lower-cased, words split at ASCII white space; a shorter text: its whole word
sequence), as XXH64 hashes. Two documents link when
``den * |A & B| >= num * |A | B|`` (85 of 100 unless told otherwise).

1. Texts become sets (written once); equal sets are one *class*.
2. A parity sketch XORs a one into a bit for each hash, so the Hamming distance
   of two sketches is at most the size of the sets' symmetric difference. A
   linked pair of sizes a, b differs in at most (a + b)(den - num) / (den + num)
   hashes.
3. Sizes are cut into bands so that linked sets lie in one band or in two
   neighbours. For each band a class is in, and the next, its sketch has g
   segments of LANE bits, g being the band's largest difference d, plus one,
   plus a slack. By the pigeonhole at least slack + 1 segments are equal in
   both sketches of a linked pair. Segments with at most one odd bit say
   little and are left out where a class has no more of them than the slack;
   then of the slack + 1 equal segments one is not such a segment, or both
   classes keep all. So no linked pair is lost.
4. A segment's odd bits, hashed, with band and place are a join key. Keys are
   shuffled and sorted; rows of one key stream by. Up to SMALL classes of a key
   give their pairs. More are dealt to blocks of BLOCK, and each two blocks of
   a key are compared in a cell, by sizes and by the Hamming distance of small
   sketches (the same bound); a cell tells only a spanning forest of the links
   that these allow, never all pairs of a group.
5. Told pairs are verified: the sets are fetched and their intersection is
   counted. If a verified pair of a cell fails, what the cell took as joined
   may not be, so the cells are compared again, telling all pairs that the
   bound allows between different components of the links verified so far.
   These are verified too, and the components are exact.

Only texts, never ids, decide links; copies are never paired. A key's rows are
held by no task, only one cell of 2 * BLOCK rows. A null, empty or blank text
has an empty set and links with nothing. Texts of any length are whole.
Repeated rows get the same component; a component without any id is named
null. An empty table gives no rows. Columns but id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.join import fits_broadcast
from .common import lookup, text_or_empty, written
from .components import components
from .simhash import Forest

LANE = 1 << 12          # bits of a segment
SMALL, BLOCK = 8, 2048  # classes of a key paired at once; classes of a block
SEEN = 1 << 20          # digests a task remembers, to send the keys of copies once
SETS = "doc {id}, n bigint, d1 bigint, d2 bigint, sketch binary, hashes array<bigint>"


def most_different(a, b, num: int, den: int):
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (den - num) // (den + num)


def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(lowest, highest) sizes of the bands up to the one that holds ``size``
    and the next. A band's lowest size is above den/num of the last one's."""
    out, low = [], 1
    while not out or out[-1][0] <= size:
        high = max(low, low * den // num)
        out.append((low, high))
        low = high + 1
    return out


def segments(high: int, num: int, den: int) -> tuple[int, int]:
    """(number of segments, slack) of the band with this highest size."""
    d = most_different(high, high, num, den)
    slack = d * 3 // 20
    return d + 1 + slack, slack


def shingle_hashes(text: bytes, shingle: int):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    xxh = xxhash.xxh64_digest
    spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    return np.unique(np.frombuffer(b"".join([xxh(joined[a:b]) for a, b in spans]), ">u8").astype(np.uint64))


def small_sketch(hashes, num: int, den: int):
    """Parity sketch of 64 to 4096 bits (as 64-bit words), sixteen times the
    difference that a link allows if that is less. Folding it in halves gives
    the sketch of half the size."""
    import numpy as np

    words = 1
    while words < 64 and 64 * words < 16 * most_different(len(hashes), len(hashes), num, den):
        words *= 2
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketches, words: int):
    """Rows of sketch words folded to ``words`` words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def mixed(x):
    import numpy as np

    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def segment_keys(hashes, num: int, den: int):
    """The join keys of a set: of its own band and of the next."""
    import numpy as np

    out = []
    all_bands = bands(len(hashes), num, den)
    spread = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15))  # the small sketch uses the hashes' low bits
    top, low = spread >> np.uint64(32), spread & np.uint64(LANE - 1)
    for band in (len(all_bands) - 2, len(all_bands) - 1):
        g, slack = segments(all_bands[band][1], num, den)
        place = np.sort(((top * np.uint64(g)) >> np.uint64(32)) * np.uint64(LANE) + low)
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        odd = place[at][np.diff(np.append(at, len(place))) & 1 == 1]  # an even number of ones is a zero
        seg = (odd // np.uint64(LANE)).astype(np.int64)
        bits = np.bincount(seg, minlength=g)
        sums = np.zeros(g, np.uint64)
        if len(odd):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            sums[seg[first]] = np.bitwise_xor.reduceat(mixed(odd + np.uint64(1)), first)
        keys = mixed(sums ^ mixed(np.arange(g, dtype=np.uint64) + np.uint64(band << 40)))
        light = bits <= 1
        out.append(keys[~light] if light.sum() <= slack else keys)
    return np.concatenate(out)


def sets_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """(row, doc, n, d1, d2, sketch, hashes) of every row; d1, d2 name the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # long texts: short batches
                part = batch.slice(a, 500)
                sets = [shingle_hashes(t, shingle) for t in part.column(1).to_pylist()]
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]),
                     pa.array(names[:, 1]), pa.array([small_sketch(s, num, den).tobytes() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc", "n", "d1", "d2", "sketch", "hashes"])

    made = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).cast("binary").alias("t")).mapInArrow(
        run, SETS.format(id=kind))
    return written(made.withColumn("row", F.monotonically_increasing_id()), "parity-sets")  # numbered once


def key_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, a, b, block): pairs of names (key null) of the keys that up
    to SMALL classes share, and members (b null) of the larger ones."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen: set = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            hashes = batch.column(1)
            ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
            keys, owners = [], []
            for i, name in enumerate(names):
                if name in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                k = segment_keys(np.sort(flat[ends[i]:ends[i + 1]]), num, den)
                keys.append(k)
                owners.append(np.full(len(k), name, np.int64))
                if sum(map(len, keys)) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                                      pa.array(np.concatenate(owners))], ["key", "d"])
                    keys, owners = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                                  pa.array(np.concatenate(owners))], ["key", "d"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kinds = [pa.int64()] * 3 + [pa.int32()]

        def made(key, a, b, block):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((key, a, b, block), kinds)], ["key", "a", "b", "block"])

        def members(key, names, at):
            n = len(names)
            return made(np.full(n, key), names, [None] * n, (np.arange(at, at + n) // BLOCK).astype(np.int32))

        held_key, held, sent = None, np.zeros(0, np.int64), 0  # the last key, which may go on; its rows told so far
        last = None                                            # its last name told, for copies
        for batch in batches:
            key, name = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            if held_key is not None:
                if sent == 0:
                    key, name = np.append(np.full(len(held), held_key), key), np.append(held, name)
            keep = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
            if sent and key[0] == held_key and name[0] == last:
                keep[0] = False
            key, name = key[keep], name[keep]
            if not len(key):
                continue
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            pairs = []
            for j in range(len(begin)):
                if size[j] == 1 and not (sent and key[begin[j]] == held_key) and j < len(begin) - 1:
                    continue
                lo, hi = begin[j], begin[j] + size[j]
                going = sent and key[lo] == held_key
                if going:
                    yield members(held_key, name[lo:hi], sent)
                    sent, last = sent + size[j], name[hi - 1]
                    if j < len(begin) - 1:
                        held_key, sent = None, 0
                elif j == len(begin) - 1:  # it may go on in the next batch
                    held_key, held, sent = key[lo], name[lo:hi], 0
                    if size[j] > SMALL:
                        yield members(held_key, held, 0)
                        sent, last = size[j], held[-1]
                elif size[j] <= SMALL:
                    up, low = np.triu_indices(size[j], 1)
                    pairs.append((name[lo + up], name[lo + low]))
                else:
                    yield members(key[lo], name[lo:hi], 0)
            if pairs:
                both = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)], axis=1), axis=0)
                yield made([None] * len(both), both[:, 0], both[:, 1], [None] * len(both))
        if held_key is not None and not sent and len(held) > 1:
            keep = np.append(True, held[1:] != held[:-1])
            up, low = np.triu_indices(int(keep.sum()), 1)
            names = held[keep]
            yield made([None] * len(up), names[up], names[low], [None] * len(up))

    keys = sets.filter("n > 0").select("d1", "hashes").mapInArrow(expand, "key bigint, d bigint")
    return written(keys.repartition("key").sortWithinPartitions("key", "d").mapInArrow(
        gather, "key bigint, a bigint, b bigint, block int"), "parity-groups")


def cell_pairs(n, sketches, label, left, num: int, den: int, forest: bool):
    """Index pairs of a cell that sizes and sketches allow to link, of
    different labels. With ``forest`` only a minimum spanning forest of them by
    Hamming distance (Prim's algorithm, rows of one label being joined from
    the start): the pairs surest to link are taken first. ``left`` marks the
    first block of two; without a mark all rows meet, else only rows of
    different blocks."""
    import numpy as np

    one = bool(left.all())
    size = len(n)
    no = np.iinfo(np.int64).max

    def far(i, others):
        d = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1, dtype=np.int64)
        ok = (d <= most_different(n[others], n[i], num, den)) & (
            np.minimum(n[others], n[i]) * den >= np.maximum(n[others], n[i]) * num)
        if not one:
            ok &= left[others] != left[i]
        return np.where(label[others] == label[i], -1, np.where(ok, d, no))

    if not forest:
        return [(i, int(j)) for i in range(size) for d, rest in [(far(i, np.arange(i + 1, size)), i + 1)]
                for j in rest + np.flatnonzero((d >= 0) & (d < no))]
    out = []
    rest = np.arange(size)                       # rows not yet in the forest, with their nearest row in it
    best, near = np.full(size, no), np.full(size, -1)
    while len(rest):
        k = int(np.argmin(best))
        i = int(rest[k])
        if 0 <= best[k] < no:
            out.append((int(near[k]), i))
        rest, best, near = np.delete(rest, k), np.delete(best, k), np.delete(near, k)
        d = far(i, rest)
        closer = d < best
        best[closer], near[closer] = d[closer], i
    return out


def cells(members: DataFrame, info: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """``members``: (key, a, block); ``info``: (d1, node, n, sketch, label).
    Returns the told pairs (a, b) of nodes."""
    blocks = members.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    placed = members.join(blocks, "key").join(info, F.col("a") == F.col("d1")).select(
        "key", "block", "node", "n", "sketch", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
                           (F.col("block") <= F.col("with")).alias("left"), "node", "n", "sketch", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        joined, sent = Forest(), set()  # what this task has told: joins, or else its last pairs

        def told(rows):
            node, n, label = (np.array(rows[k], np.int64) for k in ("node", "n", "label"))
            if forest:  # copies of a cell's links in other cells of the task are not told again
                label = np.array([joined.find(x) for x in rows["label"]], np.int64)
                if (label == label[0]).all():
                    node = node[:0]
            if not len(node):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            raw = rows["sketch"]
            words = min(len(s) for s in raw) // 8
            sketches = np.zeros((len(raw), words), np.uint64)
            for size in {len(s) for s in raw}:
                at = np.array([k for k, s in enumerate(raw) if len(s) == size])
                sketches[at] = fold(np.frombuffer(b"".join(raw[k] for k in at), np.uint64).reshape(len(at), -1), words)
            found = cell_pairs(n, sketches, label, np.array(rows["left"]), num, den, forest)
            pairs = {(int(min(node[x], node[y])), int(max(node[x], node[y]))) for x, y in found}
            if forest:
                for x, y in found:
                    joined.join(int(label[x]), int(label[y]))
            else:
                pairs -= sent
                if len(sent) < SEEN:
                    sent.update(pairs)
            a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        held: dict = {}
        cell = None
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            cols = {f: batch.column(k).to_pylist() for k, f in enumerate(("left", "node", "n", "sketch", "label"), 3)}
            at = 0
            for k in range(1, len(where) + 1):
                if k == len(where) or where[k] != where[at]:
                    if where[at] != cell:
                        if cell is not None:
                            yield told(held)
                        held, cell = {f: [] for f in cols}, where[at]
                    for f, v in cols.items():
                        held[f] += v[at:k]
                    at = k
        if cell is not None:
            yield told(held)

    return (placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("left"), "node")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of pairs of rows, from their whole sets."""
    nodes = written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(),
                    "parity-nodes")
    all_sets = sets.select("row", "hashes")
    needed = written(all_sets.join(F.broadcast(nodes) if fits_broadcast(nodes, max_bytes=16 << 20) else nodes, "row"),
                     "parity-needed")
    # a pivot may be in many pairs, so its set goes to the pairs last, skew split by AQE
    side = needed.select(F.col("row").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(side, "b").join(needed.select(F.col("row").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb")).cast("bigint")
    union = F.size("ha").cast("bigint") + F.size("hb") - common
    return written(both.select("a", "b", (common * den >= union * num).alias("linked")), "parity-verified")


def jaccard_links(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``classes``: (node, d1, ...), node being a row of the set. Returns
    (node, root) for the nodes that link with another."""
    groups = key_groups(sets, num, den)
    info = written(classes.select("node").join(sets, F.col("node") == F.col("row")).select(
        "d1", "node", "n", "sketch", F.col("node").alias("label")), "parity-info")

    # a name of 64 bits that two sets share stands for both: more candidates, none lost
    side = [info.select(F.col("d1").alias(x), F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"),
                        F.col("sketch").alias(f"{x}_sketch")) for x in "ab"]
    small = groups.filter("key IS NULL").select("a", "b").distinct().join(side[0], "a").join(side[1], "b").filter(
        (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num))

    @F.arrow_udf("boolean")
    def allowed(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for x, y, m, n in zip(a.to_pylist(), b.to_pylist(), na.to_pylist(), nb.to_pylist()):
            u, v = (np.frombuffer(s, np.uint64)[None, :] for s in (x, y))
            words = min(u.shape[1], v.shape[1])
            far = int(np.bitwise_count(fold(u, words) ^ fold(v, words)).sum())
            out.append(far <= most_different(m, n, num, den))
        return pa.array(out)

    small = small.filter(allowed("a_sketch", "b_sketch", "a_n", "b_n")).select(
        F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    members = groups.filter("key IS NOT NULL").select("key", "a", "block")
    told = written(small.unionByName(cells(members, info, num, den, True)).distinct(), "parity-told")
    checked = verify(told, sets, num, den)
    links = checked.filter("linked").select("a", "b")
    found = written(components(links), "parity-components")
    if checked.filter("NOT linked").isEmpty() or members.isEmpty():
        return found
    # a refuted link: between the components found, every pair that the bound allows
    named = info.drop("label").join(found.withColumnRenamed("root", "label"), "node", "left").select(
        "d1", "node", "n", "sketch", F.coalesce("label", "node").alias("label"))
    rest = cells(members, written(named, "parity-named"), num, den, False)
    rest = written(rest.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "parity-rest")
    if rest.isEmpty():
        return found
    more = verify(rest, sets, num, den).filter("linked").select("a", "b")
    return written(components(links.unionByName(more)), "parity-components")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, num: int = 85,
                 den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row; components of the exact
    links, named by their smallest id."""
    if not 0 < num <= den:
        raise ValueError("the threshold num / den lies in (0, 1]")
    sets = sets_of(docs, id_col, text_col, shingle, num, den)
    rows = sets.select("row", "doc", "n", F.struct("d1", "d2").alias("name"))
    classes = written(rows.filter("n > 0").groupBy("name").agg(
        F.min("row").alias("node"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("docs")), "parity-classes")
    found = jaccard_links(sets, classes, num, den)
    member = written(classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "parity-members")
    roots = written(member.groupBy("root").agg(F.min("least").alias("component_id"),
                                               F.count(F.lit(1)).alias("members")), "parity-roots")
    total = rows.count()
    named = written(lookup(member, roots, "root", "members", total).select("name", "docs", "component_id"), "parity-names")
    full = lookup(rows.filter("n > 0"), named, "name", "docs", total).select(
        F.col("doc").alias("id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select(F.col("doc").alias("id"), F.col("n").alias("n_shingles"),
                                                        F.col("doc").alias("component_id")))
