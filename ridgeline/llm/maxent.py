"""Language-model scores of whole texts by a hashed maximum-entropy model.

Tokens are lower-cased words and one end per text. P(token | history) is factored:
a softmax over CLASSES classes, whose features are the classes of the four tokens
before (near and skipped), the pair of the two before and the word before, both
hashed; times a second softmax, of the word within its class, from the same features.
The most frequent words are classes of their own, the others belong to a class by their
last two bytes. The second softmax tells the NAMED most frequent words of a class apart,
hashes its other frequent words into TAILS - 1 outcomes, and has one for rare and
unknown words; so the chance of every word depends on the history. Within such an
outcome a word has its share of the outcome's count, that of rare words discounted to
leave room for unknown ones. Rare are words seen once, and those beyond the COMMON ones.

Counts cover all training texts. The softmax is trained by gradient updates in the
tasks, each over its own texts; the tasks' weights are averaged by how often each
feature was seen, twice over disjoint parts of the texts; so is the second one. So scores
depend a little on how the rows are partitioned; the same partitions give the same scores.
Words are known by a 64-bit hash. Counts of the most frequent words (a fixed number) go to the tasks; all other
words of the texts meet their counts in a join.

Repeated rows are learnt and scored as rows of their own, with equal scores; other columns
than id and text are not returned. Null texts count as empty (one token, the end). Without training texts all classes
are equally likely and every word is unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import hash_spans, kept, mix, ranges, segment_sum, slices, word_spans

CLASSES, TOP_WORDS, TOP_ENDINGS = 64, 24, 36
BUCKETS = 2048  # of each hashed feature
BEFORE = 4
FEATURES = 1 + BEFORE * CLASSES + 2 * BUCKETS
OWN = 1 + TOP_WORDS  # classes of one word, the first ones
SHARED, OUTCOMES = CLASSES - OWN, 32
TAIL_BITS = 20  # of a word's hash that are left out
TAILS = 8  # the first outcomes: rare and unknown words, and hashed ones
NAMED = OUTCOMES - TAILS
INNER_BUCKETS = 512  # of each hashed feature of the second softmax; its rows are counted by 16 bits
INNER_FEATURES = 1 + BEFORE * CLASSES + 2 * INNER_BUCKETS
NEVER = -1000.0  # the log odds of an outcome that no word has
COMMON = 1 << 17  # words whose counts every task gets, at most
BATCH, RATE = 8192, 0.2
MOST_ODDS = 60.0  # whose exponentials are added up as they are
FEW_ROWS = 600  # that are added up at once
FIRST = 1 << 16  # ranges of hashes whose most frequent word is found at once
FIRST_BITS = np.uint64(48)
FAN_IN = 64  # tasks whose weights are added at a time
PARTS = (4, 1)  # a quarter of the texts trains first, the others start from its average
END = np.uint64(0x5EED0E0D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending (last two bytes) of every token, ends included, and n + 1 offsets by text."""
    body, starts, lengths, of_doc = word_spans(texts)
    key = hash_spans(body, starts, lengths)
    last = starts + lengths - 1
    ending = body[last].astype(np.int32) + np.where(lengths > 1, body[last - 1].astype(np.int32) << 8, 0) if len(starts) else np.zeros(0, np.int32)
    return np.insert(key, of_doc[1:], END), np.insert(ending, of_doc[1:], 0), of_doc + np.arange(len(of_doc))


@dataclass
class Known:
    """Words that tasks know, in the order of their hashes. Most tokens are found without a search: `first` tells where the
    most frequent word of each of FIRST ranges of hashes is."""

    key: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    n: np.ndarray = field(default_factory=lambda: np.zeros(1))
    outcome: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    first: np.ndarray = field(default_factory=lambda: np.zeros(FIRST, np.int32))

    @classmethod
    def of(cls, key: np.ndarray, n: np.ndarray, outcome: np.ndarray) -> Known:
        """key: distinct hashes in order."""
        if not len(key):
            return cls()
        first, by_count = np.zeros(FIRST, np.int32), np.argsort(n, kind="stable")
        first[key[by_count] >> FIRST_BITS] = by_count
        return cls(key, n, outcome.astype(np.uint8), first)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is held at all."""
        at = self.first.take(key >> FIRST_BITS)
        hit = self.key.take(at) == key
        others = np.flatnonzero(~hit)
        wanted = key[others]
        place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        at[others], hit[others] = place, self.key.take(place) == wanted
        # a table without words has one that no token is
        return (at, hit) if self.n.any() else (at, np.zeros(len(key), bool))


@dataclass
class Classes:
    """Which class a token has, and what is known of each class."""

    words: np.ndarray = field(default_factory=lambda: np.array([END]))  # sorted hashes of the words with classes of their own
    word_class: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    ending_class: np.ndarray = field(default_factory=lambda: (1 + TOP_WORDS + TOP_ENDINGS + np.arange(1 << 16) % (CLASSES - 1 - TOP_WORDS - TOP_ENDINGS)).astype(np.uint8))
    total: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    discount: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    unknown: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # log10 of the share of unknown words in outcome 0
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the words that are not rare
    named: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the words with outcomes of their own
    named_n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    outcome: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    outcome_n: np.ndarray = field(default_factory=lambda: np.zeros((SHARED, OUTCOMES)))
    rest: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, TAILS)))  # counts of the words of an outcome without words of its own
    known: Known = field(default_factory=Known)
    tokens: int = 0
    distinct: int = 0

    def of(self, key: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.word_class[at], self.ending_class[ending])

    def outcomes(self, key: np.ndarray) -> np.ndarray:
        """Which outcome a token has within its class."""
        out = np.where(held(self.frequent, key), hashed(key), 0)
        if not len(self.named):
            return out
        at = np.minimum(np.searchsorted(self.named, key), len(self.named) - 1)
        return np.where(self.named[at] == key, self.outcome[at], out).astype(np.int64)


def held(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are in order."""
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)


def hashed(key: np.ndarray) -> np.ndarray:
    """The outcome of a frequent word without one of its own."""
    return 1 + (key >> np.uint64(TAIL_BITS)).astype(np.int64) % (TAILS - 1)


def count_words(docs: DataFrame) -> DataFrame:
    """h, ending, n of every distinct token of column `text`. A task adds up its slices before it hands on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, ending, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            u, at, back = np.unique(key, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(ending[at].astype(np.int32)), pa.array(np.bincount(back, n, len(u)).astype(np.int64))], names=["h", "ending", "n"])

        for b in slices(batches, "text"):
            key, ending, _ = tokens(b.column("text"))
            u, at, n = np.unique(key, return_index=True, return_counts=True)
            held.append((u, ending[at], n))
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "h long, ending int, n long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def classes_of(counts: DataFrame, frequent: Column, known: np.ndarray) -> Classes:
    """From the counts: the top words, and sums by ending (65,536 rows at most, by their number of values).

    frequent: the words that are not rare; known: their hashes, in order.
    """
    top = [(r["h"], r["n"]) for r in counts.where(F.col("h") != int(END.view(np.int64))).orderBy(F.col("n").desc(), "h").limit(TOP_WORDS).collect()]
    own = {h for h, _ in top} | {int(END.view(np.int64))}
    rest = counts.where(~F.col("h").isin(*own))
    sums = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).toPandas().sort_values(["n", "ending"], ascending=[False, True])
    ends = counts.where(F.col("h") == int(END.view(np.int64))).select("n").collect()
    found = Classes(frequent=known)
    for k, e in enumerate(sums["ending"].head(TOP_ENDINGS)):
        found.ending_class[e] = 1 + TOP_WORDS + k
    words = np.array([END, *(np.int64(h).view(np.uint64) for h, _ in top)], np.uint64)
    order = np.argsort(words)
    found.words, found.word_class = words[order], np.arange(len(words), dtype=np.uint8)[order]
    of = found.ending_class[sums["ending"].to_numpy(int)] if len(sums) else np.zeros(0, np.uint8)
    by = lambda c: np.bincount(of, sums[c].to_numpy(float), CLASSES) if len(sums) else np.zeros(CLASSES)
    n, v, once, twice = by("n"), by("v"), by("once"), by("twice")
    found.total = n.copy()
    found.total[: len(words)] = [ends[0]["n"] if ends else 0, *(n for _, n in top)]
    # of each class the most frequent words; those seen once or twice stay with the others, whose discount they tell
    place = F.array_position(F.array(*(F.lit(int(e)) for e in sums["ending"].head(TOP_ENDINGS))).cast("array<int>"), F.col("ending"))
    cls = F.when(place > 0, place + TOP_WORDS).otherwise(OWN + TOP_ENDINGS + F.col("ending") % (CLASSES - OWN - TOP_ENDINGS)).cast("int")
    by_class = Window.partitionBy("class").orderBy(F.col("n").desc(), "h")
    first = rest.where("n > 2").select("h", "n", cls.alias("class")).withColumn("outcome", F.row_number().over(by_class)).where(F.col("outcome") <= NAMED).collect()
    found.outcome_n = np.zeros((SHARED, OUTCOMES))
    if first:
        named = np.array([r["h"] for r in first], np.int64).view(np.uint64)
        order = np.argsort(named)
        found.named, found.named_n, found.outcome = named[order], np.array([r["n"] for r in first], float)[order], np.array([TAILS - 1 + r["outcome"] for r in first], np.uint8)[order]
    # counts and distinct words by class and outcome, words with outcomes of their own included
    place = F.when(frequent, 1 + F.shiftrightunsigned("h", TAIL_BITS) % (TAILS - 1)).otherwise(0).cast("int")
    found.rest = np.repeat(found.total[:, None], TAILS, axis=1)
    found.rest[OWN:], others = 0.0, np.zeros((CLASSES, TAILS))
    for r in rest.groupBy(cls.alias("class"), place.alias("outcome")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        found.rest[r["class"], r["outcome"]], others[r["class"], r["outcome"]] = r["n"], r["v"]
    for r in first:
        key = np.array([r["h"]], np.int64).view(np.uint64)
        of = (r["class"], int(hashed(key)[0]) if held(known, key)[0] else 0)
        found.rest[of], others[of] = found.rest[of] - r["n"], others[of] - 1
        found.outcome_n[r["class"] - OWN, TAILS - 1 + r["outcome"]] = r["n"]
    found.outcome_n[:, :TAILS] = found.rest[OWN:]
    shared = np.arange(CLASSES) >= OWN
    found.discount = np.where(shared, np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9), 0.0)
    left = np.where(found.rest[:, 0] > 0, found.discount * others[:, 0] / np.maximum(found.rest[:, 0], 1), 1.0)
    found.unknown = np.log10(np.maximum(left, 1e-300))
    found.tokens = int(found.total.sum())
    found.distinct = int(v.sum()) + len(top) + bool(ends)
    return found


def features(key: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each token, the rows of the weights that its history switches on (besides row 0, the bias)."""
    at = ranges(np.diff(offsets))
    before = [np.where(at >= k, np.r_[np.zeros(k, cls.dtype), cls[:-k]][: len(cls)], 0).astype(np.int64) for k in range(1, BEFORE + 1)]
    word = np.where(at >= 1, np.r_[np.zeros(1, np.uint64), key[:-1]], np.uint64(0))
    base = 1 + BEFORE * CLASSES
    pair = (mix((before[0] * CLASSES + before[1] + 1).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    return [*(1 + k * CLASSES + c for k, c in enumerate(before)), base + pair, base + BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64)]


def inner_features(rows: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    """The rows of the second softmax's weights for tokens of shared classes; the last one is the class's bias."""
    base, own = 1 + BEFORE * CLASSES, cls.astype(np.int64) - OWN
    pair, word = ((r - base) % INNER_BUCKETS for r in rows[BEFORE:])
    return [*(r * SHARED + own for r in (*rows[:BEFORE], base + pair, base + INNER_BUCKETS + word)), own]


def log_odds(weights: np.ndarray, rows: list[np.ndarray], bias: bool = True) -> np.ndarray:
    z = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    if bias:
        z += weights[0]
    return z


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """e to the power of z less each row's highest value, the rows' sums, and these values: 0 where nothing is too large or too small as it is."""
    if len(z) and z.max() < MOST_ODDS:
        e = np.exp(z)
        sums = np.einsum("ij->i", e)
        if sums.min() > math.exp(-MOST_ODDS):
            return e, sums, 0.0
    highest = z.max(1)
    e = np.exp(z - highest[:, None])
    return e, np.einsum("ij->i", e), highest


def log_chance(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10 of the chance of outcome y."""
    _, sums, highest = exponentials(z)
    return (z[np.arange(len(y)), y] - highest - np.log(sums)) / math.log(10)


#: Codes of the tokens (below 65,536), and the features whose rows each code tells.
Groups = list[tuple[np.ndarray, tuple[int, ...]]]


def outer_groups(rows: list[np.ndarray]) -> Groups:
    """The two classes before tell their pair's bucket too."""
    place = lambda k: rows[k] - 1 - k * CLASSES
    return [(place(0) * CLASSES + place(1), (0, 1, 4)), (place(2) * CLASSES + place(3), (2, 3)), (rows[5], (5,))]


def inner_groups(rows: list[np.ndarray]) -> Groups:
    """The first feature's row tells the class."""
    return [(rows[0], (0, 6)), *((rows[k], (k,)) for k in range(1, 6))]


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the codes, where each one begins in it, and how often it occurs."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    at = code[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    return order, cuts, np.diff(np.r_[cuts, len(at)])


def run_sums(x: np.ndarray, order: np.ndarray, cuts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows x[order] by runs. Many short runs are halved, row by row; a sum of each column by run costs far more."""
    if len(order) > 16 * len(cuts):
        return np.add.reduceat(x.take(order, 0), cuts, axis=0)
    total = np.zeros((len(cuts), x.shape[1]), x.dtype)
    at, begin, n, run = order, cuts, count, np.arange(len(cuts))
    while len(at) > FEW_ROWS:
        odd = np.flatnonzero(n & 1)
        total[run[odd]] += x.take(at[begin[odd] + n[odd] - 1], 0)
        more = np.flatnonzero(n > 1)
        run, begin, n = run[more], begin[more], n[more] >> 1
        left = np.repeat(begin - 2 * (np.cumsum(n) - n), n)
        left += np.arange(0, 2 * len(left), 2)
        pairs = x.take(at[left], 0)
        pairs += x.take(at[left + 1], 0)
        x, at, begin = pairs, np.arange(len(pairs)), np.cumsum(n) - n
    if len(run):
        total[run] += np.add.reduceat(x.take(at, 0), begin, axis=0)
    return total


class Updates:
    """Adagrad on the cross-entropy of classes, or of outcomes within them, in batches of tokens."""

    def __init__(self, weights: np.ndarray, bias: bool = True):
        self.bias = bias
        self.weights, self.square = weights.copy(), np.full_like(weights, 1e-2)
        self.seen = np.zeros(len(weights))

    def step(self, rows: list[np.ndarray], y: np.ndarray, groups: Groups) -> None:
        """One batch. groups: each token's code, and the features whose rows the code tells; gradients are added up by code first."""
        p, sums, _ = exponentials(log_odds(self.weights, rows, self.bias))
        p /= sums[:, None]
        p[np.arange(len(y)), y] -= 1
        for code, of in groups:
            order, cuts, count = grouped(code)
            total, tokens_of = run_sums(p, order, cuts, count), order[cuts]
            for f in of:
                at = rows[f][tokens_of]
                if len(of) == 1:
                    self.move(at, total, len(y))
                    self.seen[at] += count
                    continue
                again, edges, n = grouped(at)
                at = at[again[edges]]
                self.move(at, run_sums(total, again, edges, n), len(y))
                self.seen[at] += np.add.reduceat(count[again], edges)
        if self.bias:
            self.move(np.array([0]), np.einsum("ij->j", p)[None], len(y))
            self.seen[0] += len(y)

    def move(self, at: np.ndarray, gradient: np.ndarray, n: int) -> None:
        """One step for the rows `at`, each named once; the gradient's array is used up."""
        gradient *= np.float32(1 / n)
        square = gradient * gradient
        square *= np.float32(n)
        square += self.square.take(at, 0)
        self.square[at] = square
        gradient *= np.float32(RATE * math.sqrt(n))
        gradient /= np.sqrt(square, out=square)
        moved = self.weights.take(at, 0)
        moved -= gradient
        self.weights[at] = moved


def train(docs: DataFrame, classes: Classes, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The averaged weights of gradient updates over all of docs: FEATURES x CLASSES (1 MB), and INNER_FEATURES * SHARED x OUTCOMES (6 MB)."""
    outer = np.zeros((FEATURES, CLASSES), np.float32)
    outer[0] = np.log(np.maximum(classes.total, 0.5) / max(classes.total.sum(), 1))
    inner = np.zeros((INNER_FEATURES * SHARED, OUTCOMES), np.float32)
    inner[:SHARED] = np.where(classes.outcome_n > 0, np.log(np.maximum(classes.outcome_n, 0.5)), NEVER)
    inner[:SHARED, :TAILS] = np.log(np.maximum(classes.outcome_n[:, :TAILS], 0.5))
    start = (outer, inner)
    steps = (64, 1024)  # rows of the weights that are averaged together
    pieces = [(k, a) for k, w in enumerate(start) for a in range(0, len(w), steps[k])]
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(PARTS[0]))
    for k in range(len(PARTS)):
        share = docs.where(part == 0 if k == 0 else part != 0)

        def update(batches: Iterator[pa.RecordBatch], begin: tuple[np.ndarray, np.ndarray] = start) -> Iterator[pa.RecordBatch]:
            own = (Updates(begin[0]), Updates(begin[1], bias=False))
            for b in slices(batches, "text"):
                key, ending, offsets = tokens(b.column("text"))
                cls = classes.of(key, ending)
                rows = features(key, cls, offsets)
                for a in range(0, len(cls), BATCH):
                    part = [r[a : a + BATCH] for r in rows]
                    own[0].step(part, cls[a : a + BATCH], outer_groups(part))
                shared = np.flatnonzero(cls >= OWN)
                at, hit = classes.known.find(key[shared])
                outcome = np.where(hit, classes.known.outcome[at], 0).astype(np.int64)
                for a in range(0, len(shared), BATCH):
                    some = shared[a : a + BATCH]
                    part = inner_features([r[some] for r in rows], cls[some])
                    own[1].step(part, outcome[a : a + BATCH], inner_groups(part))
            for n, (m, a) in enumerate(pieces):
                seen = own[m].seen[a : a + steps[m]]
                if seen.any():
                    # only the rows that moved, and how far: there are as many of these as there are tasks
                    moved = (own[m].weights[a : a + steps[m]] - begin[m][a : a + steps[m]])[seen > 0].astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], names=["piece", "seen", "weights"])

        def weigh(rows: pd.DataFrame) -> pd.DataFrame:
            seen, total = 0, 0
            for s, w in zip(rows["seen"], rows["weights"], strict=True):
                n = np.frombuffer(s, np.float64)
                some = n > 0
                moved = np.frombuffer(w, np.float16).reshape(some.sum(), -1)
                weighted = np.zeros((len(n), moved.shape[1]))
                weighted[some] = moved * n[some, None]
                seen, total = seen + n, total + weighted
            return pd.DataFrame({"piece": rows["piece"].head(1), "seen": [seen.tobytes()], "weights": [total.astype(np.float32).tobytes()], "branch": rows["task"].head(1) // FAN_IN})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            seen, total = 0, 0
            for s, w in zip(rows["seen"], rows["weights"], strict=True):
                seen, total = seen + np.frombuffer(s, np.float64), total + np.frombuffer(w, np.float32).astype(np.float64)
            return pd.DataFrame({"piece": rows["piece"].head(1), "seen": [seen.tobytes()], "weights": [total.astype(np.float32).tobytes()]})

        shape = "piece int, seen binary, weights binary"
        sums = share.select("text").mapInArrow(update, shape)
        # added as a tree, FAN_IN tasks at a time, so that no task holds the weights of more
        branch = lambda k: F.floor(F.col("task") / FAN_IN**k).cast("int")
        sums = sums.withColumn("task", F.spark_partition_id()).groupBy("piece", branch(1).alias("branch")).applyInPandas(weigh, shape + ", branch int")
        sums = sums.groupBy("piece", F.floor(F.col("branch") / FAN_IN).alias("above")).applyInPandas(add, shape).groupBy("piece").applyInPandas(add, shape)
        average = tuple(w.copy() for w in start)
        for r in sums.collect():
            m, a = pieces[r["piece"]]
            seen = np.frombuffer(bytes(r["seen"]), np.float64)
            some = seen > 0
            average[m][a : a + len(seen)][some] += np.frombuffer(bytes(r["weights"]), np.float32).reshape(len(seen), -1)[some] / seen[some, None]
        start = tuple(w.astype(np.float32) for w in average)
    return start


def common_from(binned: DataFrame) -> int:
    """The least `bin` of counts from which on there are COMMON words at most; a thousand bins hold any counts."""
    found = sorted(((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)
    least, words = 1 + max((b for b, _ in found), default=0), 0
    for b, n in found:
        words += n
        if words > COMMON:
            break
        least = b
    return least


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; `learn` names the training rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    learnt = rows.where("learn")
    counts = kept(count_words(learnt))
    binned = counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))
    least = common_from(binned)
    common = binned.where(F.col("bin") >= least).select("h", "n").toPandas()
    frequent = np.sort(common["h"].to_numpy(np.int64)[common["n"].to_numpy() > 1].view(np.uint64))
    classes = classes_of(binned, (F.col("bin") >= least) & (F.col("n") > 1), frequent)
    # words with outcomes of their own go along, whatever their counts
    common_key, at = np.unique(np.r_[common["h"].to_numpy(np.int64).view(np.uint64), classes.named], return_index=True)
    common_n = np.r_[common["n"].to_numpy(np.float64), classes.named_n][at]
    classes.known = Known.of(common_key, common_n, classes.outcomes(common_key))
    weights = train(learnt, classes, "id")
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    rest = binned.where(F.col("bin") < least).select("h", F.col("n").alias("count"))
    log_rest = np.log10(np.maximum(classes.rest, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with sums for each text, and one for each of its distinct words that is not common."""
        w, inner_w = shipped.value
        for b in slices(batches, "text", 4 << 20):
            key, ending, offsets = tokens(b.column("text"))
            cls = classes.of(key, ending)
            rows_on = features(key, cls, offsets)
            class_part = np.zeros(len(cls))
            for a in range(0, len(cls), BATCH):
                class_part[a : a + BATCH] = log_chance(log_odds(w, [r[a : a + BATCH] for r in rows_on]), cls[a : a + BATCH])
            at, hit = classes.known.find(key)
            outcome, shared = np.where(hit, classes.known.outcome[at], 0).astype(np.int64), np.flatnonzero(cls >= OWN)
            for a in range(0, len(shared), BATCH):
                some = shared[a : a + BATCH]
                class_part[some] += log_chance(log_odds(inner_w, inner_features([r[some] for r in rows_on], cls[some]), bias=False), outcome[some])
            n = np.where(hit, classes.known.n[at], 1.0)
            base = np.where(hit, np.log10(n + 0.1), 0.0)
            inner = np.where(hit & (outcome < TAILS), np.log10(np.maximum(n - np.where(outcome == 0, classes.discount[cls], 0.0), 1e-9)) - log_rest[cls, np.minimum(outcome, TAILS - 1)], 0.0)
            row = b.column("row").to_numpy()
            doc = np.repeat(np.arange(len(row)), np.diff(offsets))
            lost = np.flatnonzero(~hit)
            _, first, back = np.unique(mix(key[lost] ^ mix(doc[lost].astype(np.uint64))), return_index=True, return_inverse=True)
            times = np.bincount(back, minlength=len(first)) if len(lost) else np.zeros(0, np.int64)
            lost = lost[first] if len(first) else lost
            heads, pairs = len(row), len(lost)
            none = lambda k, t: pa.nulls(k, t)
            join = lambda a, b_: pa.concat_arrays([a, b_])
            sums = [segment_sum(x, offsets) for x in (hit.astype(np.int64), base, class_part + inner)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[row, row[doc[lost]]]),
                    # heads need no partner: their key only spreads them
                    pa.array(np.r_[mix(row.astype(np.uint64)), key[lost]].view(np.int64)),
                    pa.array(np.r_[np.zeros(heads, np.int32), times.astype(np.int32)]),
                    pa.array(np.r_[np.zeros(heads, np.int32), cls[lost].astype(np.int32)]),
                    join(b.column("id"), none(pairs, pa.int64())),
                    join(pa.array(np.diff(offsets)), none(pairs, pa.int64())),
                    *(join(pa.array(s), none(pairs, pa.array(s).type)) for s in sums),
                ],
                names=["row", "h", "times", "class", "id", "n_tokens", "n_known", "base", "inner"],
            )

    stream = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(measure, "row long, h long, times int, class int, id long, n_tokens long, n_known long, base double, inner double")
    met = stream.join(rest, "h", "left")
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("class") + 1)
    found = F.col("count").isNotNull()
    pair = F.col("times") > 0
    inner = F.when(found, F.log10(F.col("count") - pick(classes.discount)) - pick(log_rest[:, 0])).otherwise(pick(classes.unknown))
    sums = met.select(
        "row",
        "id",
        "n_tokens",
        F.when(pair, F.col("times") * found.cast("int")).otherwise(F.col("n_known")).cast("long").alias("n_known"),
        F.when(pair, F.col("times") * F.log10(F.coalesce(F.col("count"), F.lit(0)) + F.lit(0.1))).otherwise(F.col("base")).alias("base"),
        F.when(pair, F.col("times") * inner).otherwise(F.col("inner")).alias("inner"),
    )
    by_text = sums.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("inner").alias("score"))
    norm = math.log10(classes.tokens + 0.1 * (classes.distinct + 1))
    return by_text.select(id_col, "n_tokens", "n_known", F.lit(classes.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
