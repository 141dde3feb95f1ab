"""Language identification with a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Filters of
several widths run over the bytes of a window, each filter keeps its maximum
(max pooling), and a linear softmax over the rectified maxima gives the
languages. A text gets the mean of its windows' scores before the softmax, so
whole texts count. Training is numpy and Adam; only the positions that won
the pooling carry a gradient.

For scoring, the filters are folded into tables over byte pairs, so that a
filter of width 4 costs two look-ups a byte; windows of a batch of texts are
scored together in blocks of fixed size.

Learning is on a bounded sample: at most ``max_windows`` windows in all (one
text of each language at the least), shared evenly by the languages, none of
which is left out, and at most ``per_lang`` texts of each. Texts are drawn by
the hash of their id, whatever their length; ``FIT_WINDOWS`` windows of each,
spread over the whole text by a seeded hash, are cut in Spark, so that no
whole text goes to the driver.

Defined results: ``und`` and score 0 for a null text or one without a letter,
and for all texts if nothing could be learned. Of rows that repeat an id the
smallest windows and language are learned from, so the sample keeps its bound;
rows without an id are predicted, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import lookup, written

WINDOW, WIDTHS, FILTERS, FIT_WINDOWS, BLOCK = 256, (2, 3, 4), 8, 3, 256
PAD = 0x20  # a short window is filled with blanks


def cut(data: bytes):
    """All windows of a text as rows of bytes, the last one filled up."""
    import numpy as np

    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, bytes([PAD])), np.uint8).reshape(n, WINDOW)


class Model:
    def __init__(self, langs: list[str], kernels: list, out, bias):
        import numpy as np

        self.langs, self.out, self.bias = langs, out, bias
        self.pairs = []  # for each width: tables over byte pairs or single bytes, with their distance
        for k in kernels:
            parts = []
            for j in range(0, len(k) - 1, 2):
                parts.append((j, True, (k[j][:, None, :] + k[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32)))
            if len(k) % 2:
                parts.append((len(k) - 1, False, k[-1].astype(np.float32)))
            self.pairs.append((len(k), parts))

    def logits(self, windows):
        import numpy as np

        out = np.empty((len(windows), len(self.langs)), np.float32)
        for a in range(0, len(windows), BLOCK):
            w = windows[a:a + BLOCK].astype(np.intp)
            two = w[:, :-1] * 256 + w[:, 1:]
            feats = []
            for width, parts in self.pairs:
                n = WINDOW - width + 1
                total = None
                for shift, pair, table in parts:
                    x = table.take((two if pair else w)[:, shift:shift + n], 0)
                    total = x if total is None else np.add(total, x, out=total)
                feats.append(total.max(1))
            out[a:a + BLOCK] = np.maximum(np.concatenate(feats, 1), 0) @ self.out + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs or not lettered:
            return langs, scores
        at = 0
        while at < len(lettered):  # texts whose windows are scored together, at most BLOCK * 16 or one text
            part, rows = [], 0
            while at < len(lettered) and (not part or rows < BLOCK * 16):
                part.append(cut(texts[lettered[at]].encode()))
                rows += len(part[-1])
                at += 1
            ends = np.cumsum([len(x) for x in part])
            z = np.add.reduceat(self.logits(np.concatenate(part)), ends - [len(x) for x in part], 0)
            z /= np.array([len(x) for x in part])[:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, row in zip(lettered[at - len(part):at], p):
                langs[i], scores[i] = self.langs[int(row.argmax())], float(row.max())
        return langs, scores


def fit(windows: list[bytes], langs: list[str], epochs: int = 8, batch: int = 64, seed: int = 11) -> Model:
    """Trains on windows of at most ``WINDOW`` bytes and their languages."""
    import numpy as np

    names = sorted(set(langs))
    if not names:
        return Model([], [], None, None)
    rng = np.random.default_rng(seed)
    x = np.concatenate([cut(w) for w in windows]).astype(np.intp)
    index = {name: i for i, name in enumerate(names)}
    y = np.array([index[lang] for lang in langs])
    share = np.bincount(y, minlength=len(names))
    weight = (len(y) / (len(names) * np.maximum(share, 1)))[y]
    params = [*(rng.normal(0, 0.2, (k, 256, FILTERS)) for k in WIDTHS),
              rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            sel, step = order[a:a + batch], step + 1
            w, feats, won = x[sel], [], []
            for i, k in enumerate(WIDTHS):
                n = WINDOW - k + 1
                act = sum(params[i][j][w[:, j:j + n]] for j in range(k))
                won.append(act.argmax(1))
                feats.append(np.take_along_axis(act, won[-1][:, None, :], 1)[:, 0])
            f = np.concatenate(feats, 1)
            r = np.maximum(f, 0)
            z = r @ params[-2] + params[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(sel)), y[sel]] -= 1
            dz = p * (weight[sel] / len(sel))[:, None]
            df = (dz @ params[-2].T) * (f > 0)
            grads = []
            for i, k in enumerate(WIDTHS):
                g, d = np.zeros_like(params[i]), df[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(k):
                    np.add.at(g[j], (np.take_along_axis(w, won[i] + j, 1), np.arange(FILTERS)[None, :]), d)
                grads.append(g)
            for i, g in enumerate([*grads, r.T @ dz, dz.sum(0)]):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                params[i] -= 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model(names, params[:len(WIDTHS)], params[-2].astype(np.float32), params[-1].astype(np.float32))


def fit_windows(text: Column, key: Column) -> Column:
    """array<binary>: the windows of a text to learn from, all of a short
    text, else one of each of ``FIT_WINDOWS`` equal stretches."""
    def places(n):
        spread = F.array(*[F.floor((n / FIT_WINDOWS) * (j + F.pmod(F.xxhash64(key, F.lit(j)), F.lit(1024)) / 1024))
                           for j in range(FIT_WINDOWS)])
        return F.when(n <= FIT_WINDOWS, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array_distinct(spread))

    def windows(data):
        n = F.greatest(F.ceil(F.octet_length(data) / WINDOW), F.lit(1))
        return F.transform(places(n), lambda i: F.substring(data, (i * WINDOW + 1).cast("int"), F.lit(WINDOW)))

    return let(F.encode(text, "UTF-8"), windows)


def drawn(rows: DataFrame, per_lang: int, max_windows: int) -> DataFrame:
    """``rows`` (i, l): ids and their languages. Returns (i, l), each id once:
    of each language the ids with the smallest hashes, at most ``per_lang``.

    A threshold taken from the language's count lets a little more than that
    through before anything is ranked, so no task reads a whole language."""
    rows = written(rows, "languages")
    counts = written(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    state = counts.agg(F.count(F.lit(1)).alias("langs"), F.sum("n").alias("rows")).collect()[0]
    each = max(1, min(per_lang, max_windows // FIT_WINDOWS // max(1, state["langs"])))
    slack = each + 8 * each**0.5 + 40  # fewer than each pass once in more than 10^12 samples
    chance = F.pmod(F.xxhash64(F.lit("language"), "i"), F.lit(2**40)) / 2.0**40 * F.col("n") < slack
    few = lookup(rows, counts, "l", "n", state["rows"] or 0).filter(chance).groupBy("i").agg(F.min("l").alias("l"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    return few.withColumn("r", rank).filter(F.col("r") <= each).drop("r")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = 500, max_windows: int = 300_000) -> Model:
    """Fits a model on the sample the module describes."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter(
        F.col("i").isNotNull() & F.col("l").isNotNull() & (F.col("t") != ""))
    sample = written(drawn(rows.select("i", "l"), per_lang, max_windows), "sample")
    found = (rows.select("i", "t").join(F.broadcast(sample), "i")  # ids of at most max_windows windows
             .select("i", "l", fit_windows(F.col("t"), F.col("i")).alias("w"))
             .groupBy("i").agg(F.min("w").alias("w"), F.min("l").alias("l")).select("l", "w").collect())
    pairs = sorted((r["l"], bytes(w)) for r in found for w in r["w"])
    return fit([w for _, w in pairs], [lang for lang, _ in pairs])


def identify(text: Column, model: Model) -> Column:
    """struct(lang, score) of each whole text."""

    @F.arrow_udf("lang:string,score:double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = model.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["lang", "score"])

    return language(text)
