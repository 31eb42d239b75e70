"""The gate of the string kernel: words that lack a landmark's letters are not walked through."""

import numpy as np
from ridgeline.llm import toxicity


def test_gate_is_the_common_subsequence(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 20)))) for _ in range(3000)]
    rows, marks = toxicity.codes(words), toxicity.codes(["abcdefg", "gabbaj", "iicdej", words[7], words[11]])
    walked, common = [], toxicity.common
    want = np.array([common(rows, m[m > 0]) >= np.ceil(toxicity.GATE * (m > 0).sum()) for m in marks])
    monkeypatch.setattr(toxicity, "common", lambda r, m: walked.append(len(r)) or common(r, m))
    live, _ = toxicity.StringKernelMachine(marks).similarities(rows)
    assert live.tolist() == np.flatnonzero(want.any(0)).tolist() and len(live) > 5
    assert sum(walked) < 0.6 * len(rows) * len(marks)
