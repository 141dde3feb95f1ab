"""Toxicity scores from subword-bag embeddings.

A word is the mean of the embeddings of its byte n-grams (hashed to a fixed
number of rows, word edges included), a window of ``WINDOW`` words is the mean
of its words, and a linear softmax turns that mean into a probability. A text
scores as its most toxic window, so a few words count the same in a short
text and in one of 20,000 words. An unseen misspelling shares most of its
n-grams, and so its vector, with the word it comes from.

Training is joint, in numpy by Adam: each step takes the highest window of
every text. The first embedding dimension starts at the smoothed log odds of
the n-gram between the classes, the others at random. Classes are weighted to
their share among all labels, so scores are probabilities.

Learning is on a bounded sample: of the labelled texts that hold a word, at
most ``per_class`` toxic ones and twice as many others, those with the smallest
id hash. Texts of any length are in it. Where the sample holds more than
``3 * per_class * max_chars`` characters, its longest texts are learned from in
``PIECES`` seeded pieces spread over the whole text, all such texts at one size
that is never below ``max_chars`` (``room``). Scoring covers whole texts, by
array operations on blocks of about ``BLOCK`` bytes.

Defined results: a null, empty or wordless text scores 0; null labels are no
labels; an id labelled twice counts as toxic if one label says so; of rows
that repeat an id the smallest text is learned from, so the sample keeps its
bound; with no text of one of the classes every score is the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, BUCKETS, WIDTH, GRAMS, BLOCK, PIECES = 4, 1 << 16, 6, (3, 4, 5), 1 << 20, 20
BLANK_CHARS = " .,;:!?\"()[]{}|<>\t\n\x0b\x0c\r"
BLANKS = bytes.maketrans(BLANK_CHARS.encode(), b" " * len(BLANK_CHARS))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(BLANKS).split(b" ")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w] if text else []


def pieces_of(text: str | list[str]) -> list[list[bytes]]:
    """The words of a text, or of each piece cut out of one: the first and the
    last word of a piece may be cut too and are left out."""
    found = [words_of(text)] if isinstance(text, str) else [
        ws[1:-1] if len(ws) > 2 else ws for ws in map(words_of, text)]
    return [ws for ws in found if ws]


def features(data):
    """For bytes of words with one blank before, between and after them: for
    each n-gram width the bucket at every position and whether the n-gram
    lies in one word, and the positions where words begin (their blank)."""
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    blank = a == 32
    x = a.astype(np.uint32) + np.uint32(1)
    grams, h, inner = [], x * np.uint32(0x01000193), np.zeros(len(a), bool)
    for n in range(2, max(GRAMS) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        if n > 2:  # the bytes between the first and the last must not be blank
            inner = inner[:m] | blank[n - 2:n - 2 + m]
        h = (h[:m] ^ x[n - 1:]) * np.uint32(0x01000193)
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            grams.append(((mixed >> np.uint32(15)).astype(np.int32) % BUCKETS, ~inner))
    return grams, np.flatnonzero(blank)[:-1]


class Model:
    """Per-n-gram contributions to the log odds, which is all that a score
    needs of embeddings and softmax; ``constant`` is set when nothing could
    be learned."""

    def __init__(self, grams, bias: float, constant: float | None = None):
        self.grams, self.bias, self.constant = grams, bias, constant

    def word_odds(self, data: bytes):
        """Mean contribution of each word's n-grams."""
        import numpy as np

        grams, begins = features(data)
        total, count = np.zeros(len(data), np.float32), np.zeros(len(data), np.float32)
        for ids, ok in grams:
            total[:len(ids)] += np.where(ok, self.grams.take(ids), np.float32(0))
            count[:len(ids)] += ok
        return np.add.reduceat(total, begins).astype(float) / np.maximum(np.add.reduceat(count, begins), 1)

    def scores(self, texts: list[str | None]) -> list[float]:
        import numpy as np

        out = np.zeros(len(texts))
        if self.constant is not None:
            return [self.constant] * len(texts)
        lists = [words_of(t) for t in texts]
        at = 0
        while at < len(texts):
            part, used = [], 0
            while at < len(texts) and used < BLOCK:
                if lists[at]:
                    part.append(at)
                    used += sum(map(len, lists[at])) + len(lists[at])
                at += 1
            if not part:
                continue
            odds = self.word_odds(b" " + b" ".join(w for i in part for w in lists[i]) + b" ")
            counts = np.array([len(lists[i]) for i in part])
            stop, _, ok = windows(counts)
            best = np.maximum.reduceat(window_odds(odds, stop, ok), np.cumsum(counts) - counts) + self.bias
            out[part] = 1 / (1 + np.exp(-np.clip(best, -60, 60)))
        return out.tolist()


def windows(counts):
    """(end of the window that begins at each word, its text, whether it is
    one): windows do not leave their text, and only a text shorter than WINDOW
    has a shorter one."""
    import numpy as np

    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    i = np.arange(len(owner), dtype=np.int32)
    stop = np.minimum(i + WINDOW, ends[owner]).astype(np.int32)
    return stop, owner, (i == (ends - counts)[owner]) | (stop - i == WINDOW)


def window_odds(odds, stop, ok):
    """Mean over the window that begins at each word; -inf where there is none."""
    import numpy as np

    sums = np.concatenate([[0.0], np.cumsum(odds)])
    mean = sums[stop] - sums[:-1]
    mean /= stop - np.arange(len(stop), dtype=np.int32)
    mean[~ok] = -np.inf
    return mean


def fit(texts, toxic: list[int], share: float | None = None, steps: int = 60, seed: int = 7,
        rate: float = 0.03, hold: float = 1e-4) -> Model:
    """``texts``: whole texts, or lists of the pieces of one; windows do not
    leave their piece. ``share``: of toxic labels outside the sample (None: as
    sampled). ``hold`` draws embeddings back to their start."""
    import numpy as np

    index: dict[bytes, int] = {}
    lists, y, parts = [], [], []
    for t, label in zip(texts, toxic):
        if found := pieces_of(t):
            lists += [np.array([index.setdefault(w, len(index)) for w in ws], np.int32) for ws in found]
            y.append(label)
            parts.append(len(found))
    y = np.array(y, np.int64)
    if len(set(y.tolist())) < 2:
        return Model(None, 0.0, constant=share if share is not None else float(np.mean(toxic)) if len(toxic) else 0.0)
    flat, counts = np.concatenate(lists), np.array([len(x) for x in lists])
    lists.clear()
    n_words = len(index)
    data = b" " + b" ".join(index) + b" "
    grams, _ = features(data)
    table, held_by = np.zeros((len(data), len(GRAMS)), np.int32), np.zeros((len(data), len(GRAMS)), bool)
    for j, (g, one) in enumerate(grams):
        table[:len(g), j], held_by[:len(g), j] = g, one
    ids = table[held_by]  # by position, so by word
    word_at = np.cumsum(np.frombuffer(data, np.uint8) == 32, dtype=np.int32) - 1
    sizes = np.bincount(word_at, held_by.sum(1), n_words + 1)[:n_words].astype(np.int64)
    del grams, table, held_by, word_at, data
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    # texts of each class that hold an n-gram
    stop, part_of, ok = windows(counts)
    text_of = np.repeat(np.arange(len(y), dtype=np.int32), parts)[part_of]
    del part_of
    seen = np.unique(text_of * np.int64(n_words) + flat)
    t_of, w_of = seen // n_words, seen % n_words
    del seen
    held = np.zeros((2, BUCKETS))
    for a in range(0, len(t_of), 50_000):  # in blocks, to bound memory
        tw, ww = t_of[a:a + 50_000], w_of[a:a + 50_000]
        g = np.concatenate([ids[at[w]:at[w] + sizes[w]] for w in ww])
        c = y[np.repeat(tw, sizes[ww])]
        for k in (0, 1):
            held[k] += np.bincount(g[c == k], minlength=BUCKETS)
    del t_of, w_of
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    start = np.log((held[1] + 1) / (n1 + 2)) - np.log((held[0] + n0 / n1) / (n0 + 2 * n0 / n1))

    rng = np.random.default_rng(seed)
    emb = np.concatenate([start[:, None], rng.normal(0, 0.05, (BUCKETS, WIDTH - 1))], 1)
    begin_emb = emb.copy()
    out = rng.normal(0, 0.05, (WIDTH, 2))
    out[0] += (-1.0, 1.0)
    share = n1 / len(y) if share is None else min(max(share, 1e-3), 1 - 1e-3)
    bias = np.array([2.0, -2.0])
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    params = [emb, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = (np.cumsum(counts) - counts)[np.cumsum(parts) - parts]
    for step in range(1, steps + 1):
        by_word = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[ids], at) / sizes
        mean = window_odds(by_word[flat], stop, ok)
        top = np.maximum.reduceat(mean, starts)
        hit = np.flatnonzero(mean == top[text_of])
        chosen = hit[np.unique(text_of[hit], return_index=True)[1]]  # the first highest window of each text
        n = stop[chosen] - chosen
        rows = np.concatenate([flat[c:c + k] for c, k in zip(chosen, n)])
        row_text = np.repeat(np.arange(len(y)), n)
        used, inverse = np.unique(rows, return_inverse=True)
        part = np.concatenate([np.arange(at[u], at[u] + sizes[u]) for u in used])
        word_of = np.repeat(np.arange(len(used)), sizes[used])
        vec = np.stack([np.bincount(word_of, emb[ids[part], j], len(used)) for j in range(WIDTH)], 1)
        vec /= sizes[used][:, None]
        h = np.stack([np.bincount(row_text, vec[inverse, j], len(y)) for j in range(WIDTH)], 1) / n[:, None]
        z = h @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - np.eye(2)[y]) * weight[:, None]
        dh = dz @ out.T / n[:, None]
        dvec = np.stack([np.bincount(inverse, dh[row_text, j], len(used)) for j in range(WIDTH)], 1)
        dvec /= sizes[used][:, None]
        touched, place = np.unique(ids[part], return_inverse=True)
        demb = np.zeros_like(emb)
        demb[touched] = np.stack([np.bincount(place, dvec[word_of, j], len(touched)) for j in range(WIDTH)], 1)
        demb[touched] += hold * (emb[touched] - begin_emb[touched])
        for i, g in enumerate((demb, h.T @ dz, dz.sum(0))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def room(lengths: list[int], total: int) -> int:
    """The largest size such that texts of ``lengths``, the longer ones cut to
    it, come to at most ``total``."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def spread(text: Column, key: Column, size: int) -> Column:
    """``PIECES`` pieces, one from each equal part of the text at a place drawn
    from ``key``, together ``size`` characters of a text that has more."""
    n, piece = F.char_length(text).cast("long"), max(1, size // PIECES)

    def cut(j):
        begin = F.floor(n * j / PIECES)
        free = F.greatest(F.floor(n * (j + 1) / PIECES) - begin - piece, F.lit(0))
        return F.substring(text, (begin + F.pmod(F.xxhash64(key, j), free + 1) + 1).cast("int"), F.lit(piece))

    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), cut)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = 2000, max_chars: int = 10_000) -> Model:
    """Fits on a bounded sample of the labelled rows of ``labels``."""
    rows = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    share = rows.agg(F.avg("y")).collect()[0][0]
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(
        F.translate("t", BLANK_CHARS, "") != "")  # those that hold a word
    usable = written(rows.groupBy("i").agg(F.max("y").cast("int").alias("y"))
                     .join(texts.select("i").distinct(), "i", "left_semi"), "toxicity-labels")
    picked = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n)
              for y, n in ((0, 2 * per_class), (1, per_class))]
    sample = written(texts.join(F.broadcast(picked[0].unionByName(picked[1])), "i")  # at most 3 * per_class ids
                     .groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")),  # an id that repeats is one text
                     "toxicity-sample")
    size = room([r[0] for r in sample.select(F.char_length("t")).collect()], 3 * per_class * max_chars)
    long = F.char_length("t") > size
    found = sample.select("y", F.when(~long, F.col("t")).alias("whole"),
                          F.when(long, spread(F.col("t"), F.col("i"), size)).alias("pieces")).collect()
    found = [(r["y"], r["whole"] if r["pieces"] is None else r["pieces"]) for r in found]
    found.sort(key=lambda r: (r[0], r[1] if isinstance(r[1], str) else "".join(r[1])))
    return fit((t for _, t in found), [y for y, _ in found], share or 0.0)


def score(text: Column, model: Model) -> Column:
    """Probability of the toxic class for each whole text."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for a in range(0, len(texts), 1000):
                out += model.scores(texts[a:a + 1000])
            yield pa.array(out, pa.float64())

    return toxicity(text)
