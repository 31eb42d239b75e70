"""Quality score by a generalised additive model with pairwise interactions.

Features of the whole text are put into bins. Boosting goes over the features in
turn, many times; each step fits a shallow tree to one feature's bins and adds it to
that feature's lookup table. The pairs of features whose joint table promises most
are boosted the same way afterwards. A score is the sum of the looked-up values, put
through the logistic function.

Null texts count as empty. Without both labels in the sample all scores are the mean
label. Only the text is an input of a score: repeated rows get equal scores. All other
columns are returned; `score` and `predicted` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ._text import hash_spans, mix, powers, ranges, raw, slices, word_spans
from .labelled import labelled_sample

#: Labelled rows that the fit sees, at most.
SAMPLE_ROWS = 12_000

FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "bars", "stops", "distinct_words", "distinct_lines", "line_words", "beyond_ascii", "single_letters", "spaces")
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 exclaim, 6 bar, 7 stop, 8 beyond ASCII, 9 space, 10 line end
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 8
_KIND[list(b"#$%&*@^~<>{}[]\\/=+_")] = 4
_KIND[ord("!")], _KIND[ord("|")], _KIND[list(b".,;:?")], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 5, 6, 7, 9, 10
_KINDS = 11


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, from its whole bytes, words and lines."""
    texts = pc.fill_null(texts, "")
    body, off = raw(texts)
    docs = len(off) - 1
    size = np.diff(off)
    kinds = np.zeros((docs, _KINDS))
    step = 1 << 17
    doc_of = np.repeat(np.arange(docs, dtype=np.int32), size)
    for k in range(0, len(body), step):
        d = doc_of[k : k + step]
        got = np.bincount(_KIND[body[k : k + step]] + (d - d[0]).astype(np.int64) * _KINDS)
        kinds.reshape(-1)[d[0] * _KINDS : d[0] * _KINDS + len(got)] += got
    lowered, starts, lengths, of_doc = word_spans(texts)
    h = hash_spans(lowered, starts, lengths)
    n = np.diff(of_doc)
    doc = np.repeat(np.arange(docs), n)
    with np.errstate(over="ignore"):
        distinct = first_seen(h ^ mix(doc.astype(np.uint64) + np.uint64(1)), doc, docs)
        # lines that hold words: a line's hash is a polynomial of its words' hashes
        line = np.cumsum(lowered == 10)[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.r_[True, (np.diff(line) > 0) | (np.diff(doc) > 0)] if len(starts) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        place = ranges(np.diff(np.r_[at, len(h)])) if len(at) else np.zeros(0, np.int64)
        line_hash = np.add.reduceat(h * powers(1 << 16)[place & 0xFFFF], at) if len(at) else np.zeros(0, np.uint64)
        line_doc = doc[at]
        lines = np.bincount(line_doc, minlength=docs)
        distinct_lines = first_seen(mix(line_hash) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)), line_doc, docs)
    over = lambda a, b: a / np.maximum(b, 1)
    letters, solid = kinds[:, 1] + kinds[:, 2], size - kinds[:, 9] - kinds[:, 10]
    return np.column_stack(
        [np.log1p(n), over(np.bincount(doc, lengths, docs), n), over(kinds[:, 2], letters), over(kinds[:, 3], solid), over(kinds[:, 4], solid), over(kinds[:, 5], n), over(kinds[:, 6], n), over(kinds[:, 7], n), over(distinct, n), over(distinct_lines, lines), np.log1p(over(n, lines)), over(kinds[:, 8], size), over(np.bincount(doc, lengths == 1, docs), n), over(kinds[:, 9], size)]
    )


def first_seen(key: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The number of distinct keys by document (keys already tell documents apart)."""
    _, index = np.unique(key, return_index=True)
    return np.bincount(doc[index], minlength=docs)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.tables:
            fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
            for k, t in enumerate(self.tables):
                z += t[fine[:, k]]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[coarse[:, a], coarse[:, b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins, and where it is (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    found = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
    found[(left_h < 1) | (all_h - left_h < 1)] = 0
    k = int(found.argmax())
    return float(found[k]), k + 1 if found[k] > 0 else 0


def tree_on_bins(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """What a tree of the given depth over one feature's bins adds to each bin."""
    _, at = best_cut(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.r_[tree_on_bins(g[:at], h[:at], depth - 1), tree_on_bins(g[at:], h[at:], depth - 1)]


def tree_on_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The better tree of two: cut one feature, then the other on either side."""
    best, found = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = best_cut(a.sum(1), b.sum(1))
        out, got = np.zeros_like(a), 0.0
        for rows in (slice(0, at), slice(at, None)):
            if a[rows].size:
                out[rows] = tree_on_bins(a[rows].sum(0), b[rows].sum(0), 1)[None]
                got += best_cut(a[rows].sum(0), b[rows].sum(0))[0]
        if got > best:
            best, found = got, out.T if turned else out
    return found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15, most_bins: int = 32, coarse_bins: int = 8, pairs: int = 6) -> AdditiveModel:
    """Cyclic boosting on the logistic loss; first features alone, then the most promising pairs."""
    model = AdditiveModel()
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model.base = float(np.log(mean / (1 - mean)))
    if len(set(y.tolist())) < 2:
        return model
    cuts = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]
    model.edges, model.coarse = cuts(most_bins), cuts(coarse_bins)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            p = sigmoid(z)
            add = rate * tree_on_bins(np.bincount(fine[:, k], y - p, len(t)), np.bincount(fine[:, k], p * (1 - p), len(t)))
            t += add
            z += add[fine[:, k]]

    def joint(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        at = coarse[:, a] * shape[1] + coarse[:, b]
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape), at

    p = sigmoid(z)
    promise = {(a, b): float((gain(*joint(a, b, p)[:2])).sum()) for a in range(x.shape[1]) for b in range(a)}
    model.pairs = sorted(promise, key=lambda q: (-promise[q], q))[:pairs]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h, at = joint(a, b, sigmoid(z))
            add = rate * tree_on_pair(g, h)
            t += add
            z += add.reshape(-1)[at]
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", limit: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on `limit` labelled rows at most; only their features (some hundred bytes a row) reach the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), *map(pa.array, features(b.column("text")).T)], names=["_id", "y", *FEATURES])

    sample = labelled_sample(docs, labels, label_col, learn, limit, id_col, text_col)
    got = sample.mapInArrow(measure, "_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["_id", "y", "log_words"], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(), got["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, `score` (0 to 1) and `predicted` (1 from `threshold` on)."""
    model = train(docs, labels, learn, id_col=id_col, text_col=text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            p = model.score(features(b.column(text_col)))
            kept = [c for c in b.schema.names if c not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted")] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(apply, schema)


__all__ = ["AdditiveModel", "FEATURES", "classify", "features", "fit", "train"]
