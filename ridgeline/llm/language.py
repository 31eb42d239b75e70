"""Language identification by a byte convolutional network.

Text is cut into windows of a fixed number of bytes. Filters of several widths run
over a window's bytes, each filter keeps its maximum, and a softmax layer gives the
languages' probabilities; of equal ones the first in alphabetical order is predicted. A document's prediction is the mean of its windows'
log-probabilities, weighted by letters. Training (numpy, on the driver) sees a
bounded sample of windows; scoring covers whole texts in the tasks.

Null texts and texts without a letter get `und` and score 0. Without any training
row every document gets `und`. Nothing but the text is an input of a prediction: repeated
rows get equal results. All columns of the input are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._text import ranges, raw, slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Training rows by language, at most; the hash of the id orders them.
ROWS_BY_LANGUAGE = 1500
LEAST_STEPS = 500
UNKNOWN = "und"

# a symbol per byte: 0 padding, a-z without case, white space, digits, other ASCII, and each byte of longer characters
SYMBOL = np.full(256, 29, np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[[9, 10, 11, 12, 13, 32]] = 27
SYMBOL[48:58] = 28
SYMBOL[128:] = 30 + np.arange(128)
SYMBOLS = 158
LETTER = (np.arange(SYMBOLS) >= 1) & (np.arange(SYMBOLS) <= 26) | (np.arange(SYMBOLS) >= 30)


def windows(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols of each window, padded to WINDOW plus what the widest filter looks ahead."""
    at = np.arange(WINDOW)
    inside = at < lengths[:, None]
    out = np.zeros((len(starts), WINDOW + max(WIDTHS) - 1), np.int32)
    if len(body):
        out[:, :WINDOW] = np.where(inside, SYMBOL[body[np.minimum(starts[:, None] + at, len(body) - 1)]], 0)
    return out


class ByteNet:
    """The network. weights[w][j]: what symbol s at place j of a filter of width w adds to each filter."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {w: (rng.normal(size=(w, SYMBOLS, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.top = (rng.normal(size=(FILTERS * len(WIDTHS), len(languages))) * 0.1).astype(np.float32)
        self.top_bias = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 96, rate: float = 0.01) -> ByteNet:
        """Adam on the cross-entropy; only the byte places that won a filter's maximum get a gradient. Few rows are seen more often."""
        rng = np.random.default_rng(11)
        params = [*self.weights.values(), *self.bias.values(), self.top, self.top_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, rows = 0, np.arange(batch)[:, None]
        for _ in range(max(epochs, -(-LEAST_STEPS // -(-len(x) // batch)))):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                chosen = order[k : k + batch]
                xb, n = x[chosen], len(chosen)
                short = rng.random(n) < 0.4  # short texts occur too
                cut = np.where(short, rng.integers(12, WINDOW, n), WINDOW + max(WIDTHS))
                xb = np.where(np.arange(xb.shape[1]) < cut[:, None], xb, 0)
                pooled, won = [], []
                for w in WIDTHS:
                    act = sum(self.weights[w][j][xb[:, j : j + WINDOW]] for j in range(w))
                    at = act.argmax(1)
                    won.append(at)
                    pooled.append(np.take_along_axis(act, at[:, None], 1)[:, 0] + self.bias[w])
                h = np.maximum(np.hstack(pooled), 0)
                p = softmax(h @ self.top + self.top_bias)
                p[np.arange(n), y[chosen]] -= 1
                p /= n
                back = (p @ self.top.T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    d = back[:, i * FILTERS : (i + 1) * FILTERS]
                    g = np.zeros_like(self.weights[w])
                    for j in range(w):
                        np.add.at(g[j], (xb[rows[:n], won[i] + j], np.arange(FILTERS)), d)
                    grads.append(g)
                grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))] + [h.T @ p, p.sum(0)]
                step += 1
                for a, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def scorer(self, chunk: int = 192):
        """A function from windows to log-probabilities. Neighbouring symbols are looked up together."""
        pair = {w: [(self.weights[w][j][:, None] + self.weights[w][j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)] for w in WIDTHS}

        def score(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), len(self.languages)))
            for k in range(0, len(x), chunk):
                part = x[k : k + chunk]
                code = part[:, :-1] * SYMBOLS + part[:, 1:]
                pooled = []
                for w in WIDTHS:
                    act = np.take(pair[w][0], code[:, :WINDOW], axis=0, mode="clip")
                    if w > 3:
                        act += np.take(pair[w][1], code[:, 2 : 2 + WINDOW], axis=0, mode="clip")
                    if w % 2:
                        act += np.take(self.weights[w][w - 1], part[:, w - 1 : w - 1 + WINDOW], axis=0, mode="clip")
                    m = WINDOW
                    while m > 1:
                        m //= 2
                        act = np.maximum(act[:, :m], act[:, m:])
                    pooled.append(act[:, 0] + self.bias[w])
                out[k : k + chunk] = np.log(np.maximum(softmax(np.maximum(np.hstack(pooled), 0) @ self.top + self.top_bias), 1e-30))
            return out

        return score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def share_of_hashes(rows_in: DataFrame, rows: int) -> dict[str, float]:
    """By language, the share of the hashes below which its `rows` least lie, with six deviations to spare."""
    counts = rows_in.groupBy("lang").count().collect()
    return {r["lang"]: (rows + 6 * rows**0.5 + 16) / r["count"] for r in counts}


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_BY_LANGUAGE) -> ByteNet | None:
    """Fit on one window each of `rows` documents by language, those with the least hashes of their ids; null texts and labels take no part.

    None without rows. Few more rows than that leave the scan: a count by language tells which hashes may be among the least.
    """
    rows_in = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("byte net"), id_col).alias("h"))
    share = share_of_hashes(rows_in, rows)
    if not share:
        return None

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.DataFrame({"lang": pd.Series(dtype=str), "h": pd.Series(dtype="int64"), "bytes": pd.Series(dtype=object)})
        for b in slices(batches, "text"):
            body, off = raw(pc.fill_null(b.column("text"), ""))
            size = np.diff(off)
            at = (b.column("h").to_numpy().view(np.uint64) >> np.uint64(8)) % np.maximum(size - WINDOW + 1, 1).astype(np.uint64)
            view = body.tobytes()
            cut = [view[s : s + n] for s, n in zip((off[:-1] + at.astype(np.int64)).tolist(), np.minimum(size, WINDOW).tolist(), strict=True)]
            held = pd.concat([held, pd.DataFrame({"lang": b.column("lang").to_pylist(), "h": b.column("h").to_numpy(), "bytes": cut})])
            if len(held) > 4 * rows * len(share):  # equal ids have equal hashes
                held = held.assign(place=held["h"].astype("uint64")).sort_values(["place", "bytes"]).groupby("lang").head(rows).drop(columns="place")
        yield pa.RecordBatch.from_pandas(held, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("bytes", pa.binary())]), preserve_index=False)

    places = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    limit = F.element_at(F.create_map(*(F.lit(x) for item in share.items() for x in item)), F.col("lang"))
    cut = rows_in.where(places < limit).mapInArrow(pick, "lang string, h long, bytes binary")
    # in the order of places: of hashes without sign
    best = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(places, "h", "bytes"))).where(F.col("k") <= rows)
    got = best.select("lang", "h", "bytes").toPandas().sort_values(["h", "lang"], kind="stable")
    if got.empty:
        return None
    languages = sorted(set(got["lang"]))
    body, off = raw(pa.array(got["bytes"], pa.binary()))
    x = windows(body, off[:-1], np.diff(off))
    keep = LETTER[x].any(1)
    y = got["lang"].map({v: k for k, v in enumerate(languages)}).to_numpy()
    return ByteNet(languages).fit(x[keep], y[keep]) if keep.any() else None


def predict(texts: pa.Array, net: ByteNet | None, score) -> tuple[list[str], np.ndarray]:
    """A language and its probability for each text."""
    body, off = raw(pc.fill_null(texts, ""))
    n = len(off) - 1
    count = -(-np.diff(off) // WINDOW)
    doc = np.repeat(np.arange(n), count)
    start = np.repeat(off[:-1], count) + ranges(count) * WINDOW
    length = np.minimum(WINDOW, off[1:][doc] - start)
    sums, weight = np.zeros((n, len(net.languages) if net else 1)), np.zeros(n)
    for k in range(0, len(start) if net else 0, 2048):
        s = slice(k, k + 2048)
        x = windows(body, start[s], length[s])
        letters = LETTER[x].sum(1)
        some = letters > 0
        np.add.at(sums, doc[s][some], score(x[some]) * letters[some, None])
        np.add.at(weight, doc[s], letters)
    p = softmax(sums / np.maximum(weight, 1)[:, None])
    ascii_letters = np.zeros(256, bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True
    has = np.diff(np.r_[0, np.cumsum(ascii_letters[body])][off]) > 0
    for k in np.flatnonzero(~has & (weight > 0)):  # no ASCII letter, but longer characters
        has[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    best = p.argmax(1)
    ok = has & (weight > 0)
    return [net.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)], np.where(ok, p.max(1), 0.0)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and two by `names`: the language and its probability. learn: which rows' text and language are learnt.

    A column of docs that has one of the names is replaced.
    """
    net = train(docs, learn, id_col, text_col, lang_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for b in slices(batches, text_col):
            language, p = predict(b.column(text_col), net, score)
            kept = [c for c in b.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(language, pa.string()), pa.array(p)], names=[*kept, *names])

    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(apply, schema)


__all__ = ["ByteNet", "identify", "predict", "train"]
