"""Toxicity score by a support vector machine on a subsequence string kernel.

The kernel K(s, t) adds decay**(span in s + span in t) over all pairs of equal
subsequences of ORDER letters, gaps allowed, and is normalised to 1 for equal
strings; so an insult with inserted letters stays near the plain one. The parts of a
text that are compared ("units") are its words by their letters alone, runs of single
letters put together ("i d i o t"), and pieces of overlong words. K is taken as 0
where the longest common subsequence covers less than GATE of the landmark: most
words stop there, at a few machine operations each.

A sentence is a bag of units. Landmarks are words that toxic training documents hold
more often than chance explains, next to many different neighbours (a copied passage has
always the same), and the units of clean sentences that come closest to them.
Features are kernel values with the landmarks, put through K_landmarks**(-1/2)
(Nystroem); each labelled sentence trains with its strongest unit. A document's
score is its strongest unit's margin, calibrated on the training documents.

Null and empty texts hold no unit and get the lowest score. Without both labels in
the sample every score is the mean label. Only the text is an input of a score: repeated
rows get equal scores. All other columns are returned; `score` and `predicted` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import cut_spans, hash_spans, slices, word_spans
from .labelled import labelled_sample

#: Labelled rows that the fit sees, at most.
SAMPLE_ROWS = 20_000
ORDER, DECAY, GATE = 3, 0.8, 0.85
LANDMARKS, CLEAN_LANDMARKS = 96, 48
EVIDENCE = 12.0  # of a landmark's log-likelihood ratio against chance; a word in hundreds of thousands reaches it by chance
LONGEST = 16  # letters of a landmark
PIECE, STRIDE = 32, 16  # overlong units are cut into overlapping pieces

# letters a-z count as 1..26; digits and signs that stand for letters count as those; all else is dropped
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
for _sign, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _CODE[_sign] = _letter - 96
_CODE[0x80:0xC0] = 27 + np.arange(64) % 32  # the second byte of a Latin letter with a mark, in either case: a letter of its own
_CODES = 59


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units as rows of letter codes (0 pads), and for each occurrence its unit and its text."""
    body, starts, lengths, of_doc = word_spans(texts)
    doc = np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
    key = hash_spans(body, starts, lengths)
    _, pick, unit = np.unique(key, return_index=True, return_inverse=True)
    letters, off = cut_spans(body, starts[pick], lengths[pick])
    code = _CODE[letters]
    keep = code > 0
    off = np.r_[0, np.cumsum(keep)][off]
    code = code[keep]
    size = np.diff(off)
    # runs of at least three single letters form a unit of their own
    single = (size == 1)[unit]
    edge = np.r_[True, (np.diff(single.astype(np.int8)) != 0) | (np.diff(doc) != 0)] if len(unit) else np.zeros(0, bool)
    at = np.flatnonzero(edge)
    run = np.diff(np.r_[at, len(unit)])
    long_run = single[at] & (run >= 3) if len(at) else np.zeros(0, bool)
    more = [code[off[unit[a : a + n]]] for a, n in zip(at[long_run].tolist(), run[long_run].tolist(), strict=True)]
    all_codes = [*(code[off[k] : off[k + 1]] for k in np.flatnonzero(size > PIECE).tolist())]
    owners = np.flatnonzero(size > PIECE)
    rows = np.zeros((len(size), PIECE), np.uint8)
    short = np.minimum(size, PIECE)
    if len(code):
        at_code = np.minimum(off[:-1, None] + np.arange(PIECE), len(code) - 1)
        rows = np.where(np.arange(PIECE) < short[:, None], code[at_code], 0).astype(np.uint8)
    extra_rows, extra_unit, extra_doc = [], [], []
    by_unit: dict[int, list[int]] = {}
    for k, c in zip(owners.tolist(), all_codes, strict=True):
        for s in range(STRIDE, len(c), STRIDE):
            by_unit.setdefault(k, []).append(len(rows) + len(extra_rows))
            extra_rows.append(np.r_[c[s : s + PIECE], np.zeros(max(0, PIECE - len(c) + s), np.uint8)])
    if by_unit:
        for place in np.flatnonzero(np.isin(unit, owners)).tolist():
            for u in by_unit[int(unit[place])]:
                extra_unit.append(u)
                extra_doc.append(doc[place])
    for a, c in zip(at[long_run].tolist(), more, strict=True):
        for s in range(0, max(1, len(c) - STRIDE + 1), STRIDE):
            extra_unit.append(len(rows) + len(extra_rows))
            extra_doc.append(doc[a])
            extra_rows.append(np.r_[c[s : s + PIECE], np.zeros(max(0, PIECE - len(c) + s), np.uint8)])
    if extra_rows:
        rows = np.vstack([rows, np.array(extra_rows, np.uint8)])
        unit, doc = np.r_[unit, np.array(extra_unit, unit.dtype)], np.r_[doc, np.array(extra_doc, doc.dtype)]
    return rows, unit, doc


def common(rows: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row with the landmark, by bits of whole columns."""
    masks = np.zeros(_CODES, np.uint32)
    for k, c in enumerate(landmark):
        masks[c] |= np.uint32(1 << k)
    v = np.full(len(rows), (1 << len(landmark)) - 1, np.uint32)
    width = int((rows > 0).sum(1).max()) if len(rows) else 0
    for k in range(width):
        u = v & masks[rows[:, k]]
        v = (v + u) | (v - u)
    v &= np.uint32((1 << len(landmark)) - 1)
    return len(landmark) - np.bitwise_count(v).astype(np.int64)


def kernel(rows: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """The unnormalised kernel of each row with one string, by the usual dynamic program on columns of rows."""
    width = int((rows > 0).sum(1).max()) if len(rows) else 0
    before = np.ones((len(landmark) + 1, len(rows)))  # of order 0, at the current place of the row
    total = np.zeros(len(rows))
    tables = [np.zeros((len(landmark) + 1, len(rows))) for _ in range(ORDER)]
    for k in range(width):
        c, real = rows[:, k], rows[:, k] > 0
        same = [(c == letter) & real for letter in landmark]
        old = [before, *(t.copy() for t in tables[1:])]
        for order in range(1, ORDER + 1):
            below = old[order - 1]
            if order == ORDER:
                for j in range(len(landmark)):
                    total += np.where(same[j], below[j] * DECAY**2, 0)
                continue
            table, run = tables[order], np.zeros(len(rows))
            for j in range(len(landmark)):
                run = DECAY * run + np.where(same[j], DECAY**2 * below[j], 0)
                table[j + 1] = np.where(real, DECAY * old[order][j + 1] + run, old[order][j + 1])
    return total


def own(rows: np.ndarray) -> np.ndarray:
    """K of each row with itself."""
    return np.array([kernel(r[None, : (r > 0).sum()], r[: (r > 0).sum()])[0] for r in rows]) if len(rows) else np.zeros(0)


def own_many(rows: np.ndarray) -> np.ndarray:
    """K of each row with itself, all rows at once."""
    width = int((rows > 0).sum(1).max()) if len(rows) else 0
    real = rows[:, :width] > 0
    n = len(rows)
    total = np.zeros(n)
    tables = [np.ones((width + 1, n)), *(np.zeros((width + 1, n)) for _ in range(ORDER - 1))]
    for k in range(width):
        same = [(rows[:, k] == rows[:, j]) & real[:, k] & real[:, j] for j in range(width)]
        old = [t.copy() for t in tables]
        for order in range(1, ORDER + 1):
            if order == ORDER:
                for j in range(width):
                    total += np.where(same[j], old[order - 1][j] * DECAY**2, 0)
                continue
            run = np.zeros(n)
            for j in range(width):
                run = DECAY * run + np.where(same[j], DECAY**2 * old[order - 1][j], 0)
                tables[order][j + 1] = DECAY * old[order][j + 1] + run
    return total


def codes(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), PIECE), np.uint8)
    for k, w in enumerate(words):
        c = _CODE[np.frombuffer(w.encode(), np.uint8)]
        c = c[c > 0][:PIECE]
        out[k, : len(c)] = c
    return out


@dataclass
class StringKernelMachine:
    """Landmarks as code rows, K_landmarks**(-1/2), weights, and the calibration of margins."""

    landmarks: np.ndarray
    root: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def similarities(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that pass a landmark's gate, and their normalised kernels with all landmarks (0 below the gate)."""
        size = (rows > 0).sum(1)
        marks = [m[m > 0] for m in self.landmarks]
        passed = np.zeros((len(rows), len(marks)), bool)
        held = np.array([np.bincount(m, minlength=_CODES)[1:] for m in marks], np.float32).reshape(-1, _CODES - 1).T
        order = np.argsort(size)  # short rows need few steps
        for at in np.array_split(order, max(1, len(order) >> 13)):
            block = rows[at]
            present = np.zeros((len(block), _CODES), np.float32)
            present[np.arange(len(block))[:, None], block] = 1
            shared = present[:, 1:] @ held  # of a landmark's letters, those that occur in the row at all
            for k, m in enumerate(marks):
                need = np.ceil(GATE * len(m))
                some = np.flatnonzero((shared[:, k] >= need) & (size[at] >= need))
                passed[at[some], k] = common(block[some], m) >= need
        live = np.flatnonzero(passed.any(1))
        if not len(live):
            return live, np.zeros((0, len(marks)))
        sub, gate = rows[live], passed[live]
        live_size = size[live]
        norm = np.zeros(len(live))
        for a, b in ((0, 8), (8, 16), (16, PIECE)):
            some = (live_size > a) & (live_size <= b)
            norm[some] = own_many(sub[some])
        out = np.zeros((len(live), len(marks)))
        self_norm = own_many(self.landmarks)
        for k, m in enumerate(marks):
            some = gate[:, k]
            if some.any():
                out[some, k] = kernel(sub[some], m) / np.sqrt(np.maximum(norm[some] * self_norm[k], 1e-12))
        return live, out

    def margins(self, k: np.ndarray) -> np.ndarray:
        return k @ self.root @ self.weights + self.bias

    def documents(self, texts: pa.Array) -> np.ndarray:
        """A score from 0 to 1 for each text: its strongest unit's."""
        top = np.full(len(texts), self.bias if self.root is not None else 0.0)
        if self.root is not None:
            rows, unit, doc = units(texts)
            live, k = self.similarities(rows)
            if len(live):
                value = np.full(len(rows), -np.inf)
                value[live] = self.margins(k)
                found = value[unit]
                some = np.isfinite(found)
                np.maximum.at(top, doc[some], found[some])
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -60, 60)))


def hinge(x: np.ndarray, y: np.ndarray, cost: float = 200.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights of a linear machine with squared hinge loss, classes weighted evenly, by Newton steps on its active rows."""
    z = np.c_[x, np.ones(len(x))]
    sign = 2 * y - 1
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(z.shape[1])
    keep = np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(steps):
        active = sign * (z @ w) < 1
        za = z[active] * weight[active, None]
        new = np.linalg.solve(np.diag(keep) + cost / len(y) * (za.T @ z[active]), cost / len(y) * (za.T @ sign[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - y) * margin).sum() + 1e-3 * a, (p - y).sum()])
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(m + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.05)), float(b)


def landmark_words(sample: DataFrame, most: int, share: float) -> list[tuple[str, int, int]]:
    """Words (4 to LONGEST bytes) of toxic documents by strength of association; support counts distinct left neighbours.

    share: of toxic documents. A word that has nothing to do with the label has that share of its support in them.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            y = b.column("y").to_numpy()
            body, starts, lengths, of_doc = word_spans(b.column("text"))
            doc = np.repeat(np.arange(len(y)), np.diff(of_doc))
            key = hash_spans(body, starts, lengths)
            before = np.r_[np.uint64(0), key[:-1]] if len(key) else key
            first = np.r_[True, np.diff(doc) > 0] if len(key) else np.zeros(0, bool)
            before[first] = 0
            fit_size = (lengths >= 4) & (lengths <= LONGEST)
            for toxic in (True, False):
                some = np.flatnonzero(fit_size & ((y[doc] == 1) == toxic))
                if not len(some):
                    continue
                # a toxic document's words count by neighbour, a clean document's once by document
                second = before[some] if toxic else doc[some].astype(np.uint64)
                pairs = np.unique(np.rec.fromarrays([key[some], second]), return_index=True)[1]
                some = some[pairs]
                if not toxic:
                    _, at, n = np.unique(key[some], return_index=True, return_counts=True)
                    some = some[at]
                letters, off = cut_spans(body, starts[some], lengths[some])
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(before[some].view(np.int64) if toxic else np.zeros(len(some), np.int64)), pa.array(np.full(len(some), 0) if toxic else n.astype(np.int64))], names=["word", "neighbour", "clean"])

    rows = sample.select("text", "y").mapInArrow(seen, "word binary, neighbour long, clean long")
    by_pair = rows.groupBy("word", "neighbour").agg(F.sum("clean").alias("clean"), F.max(F.when(F.col("clean") == 0, 1).otherwise(0)).alias("near"))
    by_word = by_pair.groupBy("word").agg(F.sum("near").alias("near"), F.sum("clean").alias("clean")).where(F.col("near") >= 3)
    n = F.col("near") + F.col("clean")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(F.lit(0.0))
    strength = part("near", share) + part("clean", 1 - share)
    best = by_word.where((F.col("near") > n * (share + 1) / 2) & (strength >= EVIDENCE)).orderBy(strength.desc(), "word").limit(most).collect()
    return [(bytes(r["word"]).decode("utf-8", "replace"), r["near"], r["clean"]) for r in best]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", limit: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> StringKernelMachine:
    """Fit on the sentences of `limit` labelled documents at most; a few kernel rows a document reach the driver."""
    from ._text import kept

    sample = kept(labelled_sample(docs, labels, label_col, learn, limit, id_col, text_col))
    share = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n, mean = sum(share.values()), share.get(1, 0) / max(1, sum(share.values()))
    words = landmark_words(sample, LANDMARKS, mean) if 0 < mean < 1 else []
    mean = min(max(mean, 1e-3), 1 - 1e-3) if n else 0.5
    marks = codes([w for w, _, _ in words])
    marks = marks[(marks > 0).sum(1) >= ORDER + 1] if len(marks) else marks
    machine = StringKernelMachine(marks, shift=float(np.log(mean / (1 - mean))))
    if not len(marks):
        return machine
    probe = StringKernelMachine(marks)

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each sentence's unit that is closest to any landmark, the best four of a document, and its letters."""
        for b in slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            parts = pc.split_pattern_regex(texts, r"[.!?\n]+")
            sentence_doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            rows, unit, sentence = units(parts.flatten())
            live, k = probe.similarities(rows)
            near = np.zeros(len(rows))
            near[live] = k.max(1) if len(live) else 0
            got = near[unit]
            some = np.flatnonzero(got > 0.05)
            some = some[np.lexsort((some, -got[some], sentence[some]))]
            some = some[np.r_[True, np.diff(sentence[some]) > 0]] if len(some) else some
            doc = sentence_doc[sentence[some]] if len(some) else some
            order = np.lexsort((some, -got[some], doc))
            some, doc = some[order], doc[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            some, doc = some[rank < 4], doc[rank < 4]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(doc, pa.int64())), b.column("y").take(pa.array(doc, pa.int64())), pa.array([rows[u].tobytes() for u in unit[some]], pa.binary()), pa.array(got[some], pa.float64())], names=["_id", "y", "unit", "near"])

    got = sample.mapInArrow(strongest, "_id long, y int, unit binary, near double").toPandas()
    if got.empty or got["y"].nunique() < 2:
        return machine
    got = got.sort_values(["_id", "near", "unit"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    clean = got[got["y"] == 0].drop_duplicates("unit").sort_values(["near", "unit"], ascending=[False, True])["unit"].head(CLEAN_LANDMARKS)
    clean_rows = np.array([np.frombuffer(u, np.uint8) for u in clean], np.uint8).reshape(-1, PIECE)
    clean_rows = clean_rows[((clean_rows > 0).sum(1) >= ORDER + 1) & ((clean_rows > 0).sum(1) <= LONGEST)]
    machine.landmarks = np.vstack([marks, clean_rows])
    _, gram = StringKernelMachine(machine.landmarks).similarities(machine.landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    safe = values > 1e-6 * values.max()
    machine.root = vectors[:, safe] @ np.diag(values[safe] ** -0.5) @ vectors[:, safe].T
    distinct, back = np.unique(np.array(got["unit"]), return_inverse=True)
    rows = np.array([np.frombuffer(u, np.uint8) for u in distinct], np.uint8)
    k = np.zeros((len(rows), len(machine.landmarks)))
    live, found = machine.similarities(rows)
    k[live] = found
    # a toxic document's weaker sentences may be clean: only its strongest ones count as toxic
    use = ((got["y"] == 0) | (got["near"] >= got.groupby("_id")["near"].transform("max") - 1e-9)).to_numpy()
    phi = (k @ machine.root)[back][use]
    y, close = got["y"].to_numpy(float)[use], got["near"].to_numpy()[use]
    for _ in range(3):
        machine.weights, machine.bias = hinge(phi, y)
        # toxic labels on sentences without any insult are noise to the machine; leave them out of the next fit
        margin = phi @ machine.weights + machine.bias
        noise = (y > 0) & (margin < 0) & (close < 0.9)
        if not noise.any() or noise.all() or (y[~noise] > 0).sum() < 5:
            break
        phi, y, close = phi[~noise], y[~noise], close[~noise]
    top = got.assign(m=machine.margins(k)[back]).groupby("_id").agg(m=("m", "max"), y=("y", "first"))
    rest = {v: share.get(v, 0) - int((top["y"] == v).sum()) for v in (0, 1)}
    floor = machine.bias
    m = np.r_[np.maximum(top["m"].to_numpy(), floor), np.full(max(0, rest[0]), floor), np.full(max(0, rest[1]), floor)]
    label = np.r_[top["y"].to_numpy(float), np.zeros(max(0, rest[0])), np.ones(max(0, rest[1]))]
    machine.slope, machine.shift = platt(m, label)
    return machine


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, `score` (0 to 1) and `predicted` (1 from `threshold` on)."""
    machine = train(docs, labels, learn, id_col=id_col, text_col=text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            p = machine.documents(b.column(text_col))
            kept_columns = [c for c in b.schema.names if c not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept_columns), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept_columns, "score", "predicted"])

    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted")] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(apply, schema)
