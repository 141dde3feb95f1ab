"""Line dedup with a sharded minimal perfect hash.

1. Each task counts, per Arrow batch, in how many documents a line key occurs
   (128-bit hashes, so texts never travel); the counts are summed per hash.
2. The hashes found in at least ``min_docs`` documents are dealt to shards of
   about ``shard_keys`` keys. Each shard becomes a minimal perfect hash
   (levels of bit arrays), a fingerprint array and a count array, stored as
   one Parquet file in the shared folder.
3. Documents are read again and probe the arrays: position by the first 64
   bits, membership by the other 64. Lines are never shuffled, so a line
   found in a third of all documents costs no task more than another line. A
   worker loads a shard when it first needs it and keeps at most
   ``cache_bytes``.

Keys: the line without ASCII white space at both ends, A-Z lower-cased. Keys
of less than ``min_chars`` code points are never dropped. A null or empty
text is one empty line. Two rows with one id count as two documents. With no
frequent line every text stays as it is; a text that loses all lines becomes
empty.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, scratch, text_or_empty, worker_cache, written

LEVELS = 32  # of a shard's hash; keys still colliding then are kept in a sorted list
RESULT = "n_lines:bigint,n_dropped:bigint,text:string"


def keys_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = text.split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n_docs) of every line key."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import numpy as np
        import xxhash

        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    found.update({xxhash.xxh3_128_digest(k) for k in set(keys_of(t.encode())[1])
                                  if _long_enough(k, min_chars)})
            pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                                              pa.array(list(found.values()), pa.int64())], ["h1", "h2", "n"])

    part = docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "h1 bigint, h2 bigint, n bigint")
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def mixed(keys, salt: int):
    """64-bit mix of uint64 keys, one of its own for each level."""
    import numpy as np

    x = keys ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class Shard:
    """Minimal perfect hash of distinct 64-bit keys with two arrays beside
    it. ``bits[l]`` marks the slots of level l that exactly one remaining key
    fell on; a key's index is the number of marks before its own."""

    def __init__(self, bits: list, rest, prints, counts):
        import numpy as np

        self.bits, self.rest, self.prints, self.counts = bits, rest, prints, counts
        self.ranks, at = [], 0
        for b in bits:
            self.ranks.append(at + np.concatenate([[0], np.cumsum(b)[:-1]]).astype(np.int64))
            at += int(b.sum())
        self.at = at

    @classmethod
    def build(cls, keys, prints, counts) -> Shard:
        import numpy as np

        bits, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = 2 * len(left) + 1
            slot = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            single = np.bincount(slot, minlength=size) == 1
            bits.append(single)
            left = left[~single[slot]]
        shard = cls(bits, np.sort(left), None, None)
        place = shard.index(keys)
        shard.prints, shard.counts = np.empty_like(prints), np.empty(len(counts), np.int64)
        shard.prints[place], shard.counts[place] = prints, counts
        return shard

    def index(self, keys):
        """Index of each key in 0..n-1; any number, or -1, for others."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (b, r) in enumerate(zip(self.bits, self.ranks)):
            slot = (mixed(keys[open_], level) % np.uint64(len(b))).astype(np.int64)
            hit = b[slot]
            out[open_[hit]] = r[slot[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            pos = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[pos] == keys[open_]
            out[open_[hit]] = self.at + pos[hit]
        return out

    def docs(self, keys, prints):
        """Document count of each (key, fingerprint), 0 if not held."""
        import numpy as np

        place = self.index(keys)
        ok = place >= 0
        ok[ok] = self.prints[place[ok]] == prints[ok]
        return np.where(ok, self.counts[np.where(ok, place, 0)] if len(self.counts) else 0, 0)

    def dump(self) -> bytes:
        import io

        import numpy as np

        out = io.BytesIO()
        np.savez(out, rest=self.rest, prints=self.prints, counts=self.counts,
                 sizes=np.array([len(b) for b in self.bits], np.int64),
                 **{f"b{i}": np.packbits(b) for i, b in enumerate(self.bits)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        import io

        import numpy as np

        with np.load(io.BytesIO(data)) as z:
            bits = [np.unpackbits(z[f"b{i}"], count=int(n)).astype(bool) for i, n in enumerate(z["sizes"])]
            return cls(bits, z["rest"], z["prints"], z["counts"])


class LineIndex:
    """The stored shards; ``shards`` is their number (0: no frequent line)."""

    def __init__(self, path: str, shards: int, cache_bytes: int = 256 << 20):
        self.path, self.shards, self.cache_bytes = path, shards, cache_bytes

    def shard(self, k: int) -> Shard:
        """Shard k, from the worker's cache or the shared folder."""
        cache = worker_cache("lines")
        held: OrderedDict = cache.setdefault(self.path, OrderedDict())
        if k in held:
            held.move_to_end(k)
            return held[k][0]
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") \
            else (fs.LocalFileSystem(), self.path)
        rows = dataset.dataset(f"{root}/shard={k}", filesystem=store, format="parquet").to_table(["data"])
        data = rows.column("data")[0].as_py()
        shard = Shard.load(data)
        held[k] = (shard, len(data) * 4)  # bit arrays and ranks are wider in memory
        while sum(n for _, n in held.values()) > self.cache_bytes and len(held) > 1:
            held.popitem(last=False)
        return shard

    def docs(self, pairs):
        """Document counts of (h1, h2) pairs; each shard is taken once."""
        import numpy as np

        out = np.zeros(len(pairs), np.int64)
        if not self.shards or not len(pairs):
            return out
        shard = (pairs[:, 0] % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            out[part] = self.shard(int(shard[part[0]])).docs(pairs[part, 0], pairs[part, 1])
        return out


def build_index(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                shard_keys: int = 1 << 17) -> LineIndex:
    """Counts the lines of all documents and stores the frequent ones."""
    spark = docs.sparkSession
    frequent = written(line_counts(docs, text_col, min_chars).filter(F.col("n_docs") >= min_docs), "lines")
    n = frequent.count()
    shards = -(-n // shard_keys)
    path = scratch(spark, "line-index")

    def build(key, part):
        import pandas as pd

        shard = Shard.build(part["h1"].to_numpy().view("uint64"), part["h2"].to_numpy().view("uint64"),
                            part["n_docs"].to_numpy())
        return pd.DataFrame({"shard": [int(key[0])], "data": [shard.dump()]})

    if shards:
        # h1 as an unsigned number modulo the number of shards
        low = F.pmod(F.pmod(F.col("h1"), F.lit(shards)) +
                     F.when(F.col("h1") < 0, F.lit(2**64 % shards)).otherwise(F.lit(0)), F.lit(shards))
        (frequent.withColumn("shard", low.cast("int")).groupBy("shard")
         .applyInPandas(build, "shard int, data binary").write.partitionBy("shard").parquet(path))
    return LineIndex(path, shards)


def drop_lines(text: Column, index: LineIndex, min_docs: int = 10, min_chars: int = 1) -> Column:
    """struct(n_lines, n_dropped, text) of each whole text after all lines
    whose key the index knows from ``min_docs`` documents are dropped."""
    @F.arrow_udf(RESULT)
    def kept_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import xxhash

        for batch in batches:
            split = [keys_of((t or "").encode()) for t in batch.to_pylist()]
            keys = list({k for _, ks in split for k in ks if _long_enough(k, min_chars)})
            pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
            drop = {k for k, n in zip(keys, index.docs(pairs)) if n >= min_docs}
            kept = [[x for x, k in zip(lines, ks) if k not in drop] for lines, ks in split]
            yield pa.StructArray.from_arrays(
                [pa.array([len(lines) for lines, _ in split], pa.int64()),
                 pa.array([len(s[0]) - len(x) for s, x in zip(split, kept)], pa.int64()),
                 pa.array([b"\n".join(x).decode() for x in kept], pa.string())], ["n_lines", "n_dropped", "text"])

    return kept_lines(text)
