"""The quality classifier learns a harmful word from the few documents that hold it."""

from __future__ import annotations

import random

import numpy as np

from corpusjobs.llm import quality


def test_rare_harmful_word():
    rng = random.Random(8)
    common = [f"word{k}" for k in range(300)]
    text = lambda *more: " ".join([*rng.sample(common, 40), *more])
    for n_good, n_bad in ((60, 5), (2000, 12)):
        texts = [text() for _ in range(n_good)] + [text("zzvile") for _ in range(n_bad)]
        grades = np.array([2] * n_good + [0] * n_bad)
        model = quality.fit([np.array(quality.features(t), np.int32) for t in texts], grades)
        new = [quality.features(text(*more)) for more in [("zzvile",)] * 20 + [()] * 20]
        good = model.tails(new)[:, 1] >= quality.TAIL
        assert good[:20].mean() < 0.2 and good[20:].mean() > 0.8
