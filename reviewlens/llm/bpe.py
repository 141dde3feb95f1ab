"""Byte-level BPE encoding and decoding.

The rank file is turned into a ``tokenizers`` BPE model over the usual
byte-to-character alphabet. Every pair of tokens whose concatenation is a
token becomes a merge, ordered by the rank of the result, which is the rule a
rank file implies; whole pieces found in the vocabulary are taken as they are.

Texts are cut by the pattern, and each *different* piece of an Arrow batch is
encoded once per Python worker (bounded cache), so cost follows the number of
pieces and not the length of merges.

The rank file is read on the driver and shipped with the function: its size is
that of one vocabulary file (under 1 MB), whatever the size of the corpus.

Defined results: a null or empty text has no ids; a null id list decodes to
empty bytes; an id outside the vocabulary raises ``KeyError``.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import worker_cache

#: Unicode White_Space, which ``\s`` means in the pattern (fixed values).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces a worker remembers, and the longest piece that it does.
CACHE_PIECES, CACHE_LENGTH = 100_000, 200
OFFSETS = "array<struct<byte_start:int,byte_end:int,char_start:int,char_end:int>>"


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte: a byte that prints
    stands for itself, the others follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(prints) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    """The rank file, compressed, as the functions below take it."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def token_ranks(ranks: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in zlib.decompress(ranks).splitlines() if line.strip())
    return {base64.b64decode(token): int(r) for token, r in lines}


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        import regex
        from tokenizers import models

        rank = token_ranks(ranks)
        self.sizes = {r: len(token) for token, r in rank.items()}
        self.table = dict(enumerate(byte_alphabet()))
        shown = {token: self._shown(token) for token in rank}
        pairs = [(shown[token[:i]], shown[token[i:]])
                 for token in sorted(rank, key=rank.get) for i in range(1, len(token))
                 if token[:i] in rank and token[i:] in rank]
        self.model = models.BPE(vocab={shown[t]: r for t, r in rank.items()}, merges=pairs, ignore_merges=True)
        self.pattern = regex.compile(self._explicit(pattern))
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _explicit(pattern: str) -> str:
        """``\\s`` and ``\\S`` spelled out, inside and outside of classes."""
        out, inside, i = [], False, 0
        while i < len(pattern):
            c = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
            if c == "[":
                inside = True
            elif c == "]":
                inside = False
            if c == "\\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif c == "\\S" and not inside:
                out.append(f"[^{SPACES}]")
            else:
                out.append(c)
            i += len(c)
        return "".join(out)

    def _shown(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.table)

    def ids(self, text: str) -> bytes:
        """Little-endian int32 ids of a text, joined."""
        pieces, known = self.pattern.findall(text), self.pieces
        new = set(pieces).difference(known)
        for p in new:
            known[p] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(self._shown(p.encode()))])
        out = b"".join([known[p] for p in pieces])
        for p in new:
            if len(p) > CACHE_LENGTH:
                del known[p]
        if len(known) > CACHE_PIECES:
            known.clear()
        return out

    def spans(self, text: str, ids: list[int]) -> list[dict]:
        """Byte and character extent of each token; a token that holds part
        of a character spans that whole character."""
        import numpy as np

        data = np.frombuffer(text.encode(), np.uint8)
        index = np.cumsum((data & 0xC0) != 0x80) - 1 if len(data) else np.zeros(0, np.int64)
        ends = np.cumsum([self.sizes[i] for i in ids]).astype(int)
        starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
        return [{"byte_start": int(s), "byte_end": int(e), "char_start": int(index[s]),
                 "char_end": int(index[e - 1]) + 1} for s, e in zip(starts, ends)]


class Decoder:
    def __init__(self, ranks: bytes):
        self.tokens = {r: token for token, r in token_ranks(ranks).items()}

    def data(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def held(kind, *args):
    """The encoder or decoder of these arguments, made once per worker."""
    cache = worker_cache("bpe")
    key = (kind.__name__, zlib.crc32(args[0]), *args[1:])
    if key not in cache:
        cache[key] = kind(*args)
    return cache[key]


def encode(text: Column, ranks: bytes, pattern: str) -> Column:
    """Token ids (``array<int>``) of each whole text."""
    @F.arrow_udf("array<int>")
    def bpe_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        c = held(Encoder, ranks, pattern)
        for batch in batches:
            found = [c.ids(t) if (t := text.as_py()) else b"" for text in batch]
            ends = np.cumsum([0] + [len(x) // 4 for x in found])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                           pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))

    return bpe_ids(text)


def offsets(text: Column, ids: Column, ranks: bytes, pattern: str) -> Column:
    """For each id its byte and character extent in the text."""
    @F.arrow_udf(OFFSETS)
    def bpe_offsets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = held(Encoder, ranks, pattern)
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in re.findall(r"(\w+):int", OFFSETS)]))
        for texts, lists in batches:
            yield pa.array([c.spans(t or "", i or []) for t, i in zip(texts.to_pylist(), lists.to_pylist())], kind)

    return bpe_offsets(text, ids)


def decode(ids: Column, ranks: bytes) -> Column:
    """The bytes that the ids stand for, joined before any decoding to text,
    so a character split over tokens is whole again."""
    @F.arrow_udf("binary")
    def bpe_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        c = held(Decoder, ranks)
        for batch in batches:
            flat, out, at = np.asarray(batch.flatten()), [], 0
            for n in batch.value_lengths().to_pylist():
                out.append(c.data(flat[at:at + (n or 0)].tolist()))
                at += n or 0
            yield pa.array(out, pa.binary())

    return bpe_bytes(ids)


def round_trip(text: Column, ranks: bytes, pattern: str) -> Column:
    """struct(ids, data): ``encode``, and ``decode`` of its ids, in one
    worker, so that ids do not go back to Python."""

    @F.arrow_udf("ids:array<int>,data:binary")
    def bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        e, d = held(Encoder, ranks, pattern), held(Decoder, ranks)
        for batch in batches:
            found = [np.frombuffer(e.ids(t), "<i4") if (t := text.as_py()) else np.zeros(0, "<i4") for text in batch]
            ends = np.cumsum([0] + [len(x) for x in found])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                           pa.array(np.concatenate([*found, np.zeros(0, "<i4")]), pa.int32()))
            yield pa.StructArray.from_arrays([ids, pa.array([d.data(x.tolist()) for x in found], pa.binary())],
                                             ["ids", "data"])

    return bpe_round_trip(text)


def decode_text(ids: Column, ranks: bytes) -> Column:
    """Decoded bytes as text; bytes that are no UTF-8 (ids cut inside a
    character) become U+FFFD."""
    return F.try_validate_utf8(F.decode(decode(ids, ranks), F.lit("UTF-8")))
