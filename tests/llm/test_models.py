"""Trained models against plain versions of what they compute."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from ridgeline.llm import entries, language, maxent, quality, toxicity
from ridgeline.llm._bpe import WordTokens

from .test_brute_force import slow_kernel

RNG = np.random.default_rng(12)


@pytest.fixture(scope="module")
def net():
    found = language.ByteNet(["a", "b", "c"])
    for p in (*found.bias.values(), found.top_bias):
        p += RNG.normal(size=p.shape).astype(np.float32)
    return found


def forward(net, window):
    """One window's log-probabilities: every filter at every place, its maximum, and the softmax."""
    pooled = []
    for w in language.WIDTHS:
        for f in range(language.FILTERS):
            at = [sum(float(net.weights[w][j][window[k + j], f]) for j in range(w)) for k in range(language.WINDOW)]
            pooled.append(max(0.0, max(at) + float(net.bias[w][f])))
    z = [sum(p * float(net.top[k, c]) for k, p in enumerate(pooled)) + float(net.top_bias[c]) for c in range(len(net.languages))]
    total = sum(math.exp(v - max(z)) for v in z)
    return [v - max(z) - math.log(total) for v in z]


def test_network_s_forward_pass(net):
    texts = ["the quick brown fox " * 20, "ñandú 12 x", "a"]
    for t in texts:
        body = np.frombuffer(t.encode(), np.uint8)
        x = language.windows(body, np.array([0]), np.array([min(len(body), language.WINDOW)]))
        assert net.scorer()(x)[0].tolist() == pytest.approx(forward(net, x[0].tolist()), abs=2e-4)


def test_documents_are_means_of_windows(net):
    text = "some words of a text, " * 40
    got, p = language.predict(pa.array([text, None, "1 2 3"]), net, net.scorer())
    body = np.frombuffer(text.encode(), np.uint8)
    parts = [body[k : k + language.WINDOW] for k in range(0, len(body), language.WINDOW)]
    logs = [forward(net, language.windows(b, np.array([0]), np.array([len(b)]))[0].tolist()) for b in parts]
    letters = [sum(chr(c).isalpha() for c in b) for b in parts]
    z = [sum(n * v[c] for n, v in zip(letters, logs, strict=True)) / sum(letters) for c in range(3)]
    chance = [math.exp(v) / sum(math.exp(u) for u in z) for v in z]
    assert got == [net.languages[int(np.argmax(chance))], "und", "und"] and p.tolist() == pytest.approx([max(chance), 0, 0], abs=2e-4)


def test_quality_features():
    texts = ["One two TWO, three.\nline | two\nline | two\n", "", None, "é 12 &! a"]
    for row, t in zip(quality.features(pa.array(texts)).tolist(), texts, strict=True):
        b = (t or "").encode()
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", b)]
        n, lines = len(w), [tuple(line.lower().split()) for line in b.split(b"\n") if line.split()]
        count = lambda p: len(re.findall(p, b))  # noqa: B023, E731
        over = lambda x, y: x / max(y, 1)
        solid = len(b) - count(rb"[\t\x0b\x0c\r \n]")
        want = [math.log1p(n), over(sum(map(len, w)), n), over(count(rb"[A-Z]"), count(rb"[A-Za-z]")), over(count(rb"[0-9]"), solid), over(count(rb"[#$%&*@^~<>{}\[\]\\/=+_]"), solid), over(count(rb"!"), n), over(count(rb"\|"), n), over(count(rb"[.,;:?]"), n), over(len(set(w)), n), over(len(set(lines)), len(lines)), math.log1p(over(n, len(lines))), over(count(rb"[\x80-\xff]"), len(b)), over(sum(len(x) == 1 for x in w), n), over(count(rb"[\t\x0b\x0c\r ]"), len(b))]
        assert row == pytest.approx(want), t


def test_a_tree_takes_the_best_cuts():
    g, h = RNG.normal(size=9), RNG.uniform(1, 3, 9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)

    def best(a, b):
        k = max(range(a + 1, b), key=lambda k: gain(a, k) + gain(k, b))
        return k if gain(a, k) + gain(k, b) > gain(a, b) else 0

    def tree(a, b, depth):
        k = best(a, b) if depth and b - a > 1 else 0
        return tree(a, k, depth - 1) + tree(k, b, depth - 1) if k else [g[a:b].sum() / (h[a:b].sum() + 1)] * (b - a)

    assert quality.tree_on_bins(g, h).tolist() == pytest.approx(tree(0, 9, 2))


def test_additive_scores_are_sums_of_looked_up_values():
    x = RNG.normal(size=(300, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=20, pairs=2)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.85
    for row, got in zip(x[:20].tolist(), model.score(x[:20]).tolist(), strict=True):
        at = lambda edges, k: sum(e <= row[k] for e in edges[k])  # noqa: B023, E731
        z = model.base + sum(model.tables[k][at(model.edges, k)] for k in range(3)) + sum(t[at(model.coarse, a), at(model.coarse, b)] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def subsequence(s, t):
    table = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
    for i, a in enumerate(s):
        for j, b in enumerate(t):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_documents_get_their_strongest_unit_s_margin():
    """Gate, normalised kernel, Nystroem features, margin and calibration, one word at a time."""
    marks = ["scumbag", "rotten", "garden"]
    codes = toxicity.codes(marks)
    plain = [[ord(c) - 96 for c in w] for w in marks]
    norm = lambda s: slow_kernel(s, s)

    def similar(s):
        return [slow_kernel(s, m) / math.sqrt(norm(s) * norm(m)) if subsequence(s, m) >= math.ceil(toxicity.GATE * len(m)) else 0.0 for m in plain]

    gram = np.array([similar(m) for m in plain])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    machine = toxicity.StringKernelMachine(codes, root, np.array([2.0, 1.5, -1.0]), -1.0, 1.7, 0.2)
    for text in ("you scumbag", "a scu.mxbag in the garden", "rottten wood", "nothing", ""):
        margins = [float(np.array(similar(s)) @ root @ machine.weights) - 1.0 for w in text.split() if (s := [ord(c) - 96 for c in w if c.isalpha()]) and any(similar(s))]
        want = 1 / (1 + math.exp(-(1.7 * max([-1.0, *margins]) + 0.2)))
        assert machine.documents(pa.array([text]))[0] == pytest.approx(want), text


def test_hinge_and_platt_reach_their_minima():
    x = RNG.normal(size=(80, 4))
    y = (x[:, 0] + 0.3 * RNG.normal(size=80) > 0.2).astype(float)
    w, b = toxicity.hinge(x, y)
    sign, weight = 2 * y - 1, np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)

    def loss(w, b):
        return 0.5 * (w @ w + 1e-3 * b * b) + 200.0 / len(y) / 2 * (weight * np.maximum(0, 1 - sign * (x @ w + b)) ** 2).sum()

    assert all(loss(w, b) <= loss(w + d[:4], b + d[4]) + 1e-9 for d in RNG.normal(size=(200, 5)) * 0.01)
    margin = x @ w + b
    slope, shift = toxicity.platt(margin, y)
    p = lambda a, c: 1 / (1 + np.exp(-(a * margin + c)))
    deviance = lambda a, c: -(y * np.log(p(a, c)) + (1 - y) * np.log(1 - p(a, c))).sum() + 0.5e-3 * a * a
    assert all(deviance(slope, shift) <= deviance(slope + d[0], shift + d[1]) + 1e-6 for d in RNG.normal(size=(100, 2)) * 0.05)


def test_tokens_of_bytes_that_are_no_text():
    words = WordTokens(entries.tokenizer_definition())
    raw = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 9], np.int32).tobytes()), pa.py_buffer(b"ab \xc3( cde")])
    ids, off = words.ids(raw, 2)
    assert ids.tolist() == [*words.tokenizer.encode("ab �( cde", add_special_tokens=False).ids, 2] and off.tolist() == [0, len(ids)]


def test_gradients_added_up_by_group_are_those_of_each_feature():
    n = 500
    cls = RNG.integers(0, maxent.CLASSES, n).astype(np.uint8)
    rows = maxent.features(RNG.integers(0, 2**62, n).astype(np.uint64), cls, np.array([0, 200, n]))
    shared = np.flatnonzero(cls >= maxent.OWN)
    inner = maxent.inner_features([r[shared] for r in rows], cls[shared])
    for shape, x, y, groups, bias in (((maxent.FEATURES, maxent.CLASSES), rows, cls, maxent.outer_groups(rows), True), ((maxent.INNER_FEATURES * maxent.SHARED, maxent.OUTCOMES), inner, cls[shared] % maxent.OUTCOMES, maxent.inner_groups(inner), False)):
        fast, plain = (maxent.Updates(np.zeros(shape, np.float32), bias) for _ in range(2))
        for _ in range(3):
            fast.step(x, y, groups)
            plain.step(x, y, [(r, (k,)) for k, r in enumerate(x)])
        assert np.allclose(fast.weights, plain.weights, atol=1e-5) and (fast.seen == plain.seen).all() and fast.seen.sum() == 3 * len(y) * (len(x) + bias)


@pytest.mark.parametrize("codes", [1, 3, 40, 700, 5000])
def test_sums_of_runs(codes):
    rng = np.random.default_rng(codes)
    code, x = rng.zipf(1.2, 6000) % codes, rng.normal(size=(6000, 5))
    order, cuts, count = maxent.grouped(code)
    got = maxent.run_sums(x, order, cuts, count)
    for c, s in zip(code[order[cuts]], got, strict=True):
        assert s == pytest.approx(x[code == c].sum(0), abs=1e-9)


def test_known_words_are_found():
    rng = np.random.default_rng(7)
    # many hashes share the range of another one
    key = np.unique(np.r_[rng.integers(0, 1 << 63, 500, np.uint64), np.uint64(5) << np.uint64(50) | rng.integers(0, 1 << 40, 300, np.uint64)])
    known = maxent.Known.of(key, rng.integers(1, 50, len(key)).astype(float), np.arange(len(key)) % 200)
    asked = np.r_[key, key + np.uint64(1), np.uint64(0), ~np.uint64(0)]
    at, hit = known.find(asked)
    assert (hit == np.isin(asked, key)).all() and (key[at[hit]] == asked[hit]).all()
    assert not maxent.Known.of(key[:0], key[:0], key[:0]).find(asked)[1].any() and len(known.find(key[:0])[0]) == 0


@pytest.mark.parametrize("shift", [0.0, 500.0, -500.0])
def test_chances_of_large_and_small_odds(shift):
    z = np.random.default_rng(1).normal(size=(9, 4)) * 3
    z[:, 2] = maxent.NEVER
    want = [(r[k % 2] - np.log(np.exp(r).sum())) / np.log(10) for k, r in enumerate(z)]
    z[::2] += shift
    assert maxent.log_chance(z, np.arange(9) % 2) == pytest.approx(want)
