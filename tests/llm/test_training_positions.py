"""The network of pseudo_likelihood learns from every word of every text; long texts are hashed in parts."""

import numpy as np
import pyarrow as pa

from quillspark.llm import pseudo_likelihood, words

from .helpers import edge_rows


def test_every_position_trains_once():
    texts = [(r[1] or "").encode().split() for r in edge_rows()]
    offsets = np.cumsum([0, *map(len, texts)])
    cells = np.arange(offsets[-1]) % pseudo_likelihood.CELLS
    for rounds in (1, pseudo_likelihood.ROUNDS, 5):
        seen = 0
        for turn in range(rounds):
            trainer = pseudo_likelihood._Trainer(pseudo_likelihood.Network.start(), turn, rounds)
            trainer.take(cells, offsets)
            trainer.row(0)
            seen += trainer.seen
        assert seen == offsets[-1]
    offsets = np.array([0, 0, 1, 6, 6, 40])
    every = np.concatenate([pseudo_likelihood.training_positions(offsets, k, 3) for k in range(3)])
    assert sorted(every.tolist()) == list(range(40))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["ab cd\nEf  " * 900 + "x" * 5_000 + " end\nword", "y" * 3_000, " " * 3_000, "a b " * 500]
    whole = [words.hashed_words(pa.array([t])) for t in texts]
    monkeypatch.setattr(words, "HASH_BYTES", 700)
    for t, want in zip(texts, whole, strict=True):
        got = words.hashed_words(pa.array([t]))
        for name in ("hashes", "offsets", "begin", "end", "line", "data"):
            assert np.array_equal(getattr(got, name), getattr(want, name)), name


def test_rows_far_below_the_others_still_sum_to_one():
    z = np.random.default_rng(0).standard_normal((6, 50)).astype(np.float32)
    z[1] -= 60
    z[2] -= 80
    z[3] -= 1e4
    want = z.astype(np.float64) - z.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    got = pseudo_likelihood._log_softmax(z)
    assert np.allclose(np.exp(got).sum(1), 1, atol=1e-4) and np.allclose(got[[0, 1, 4, 5]], want[[0, 1, 4, 5]], atol=1e-3)
