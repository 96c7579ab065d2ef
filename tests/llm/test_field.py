"""The random field: chains of any length, and exact slopes."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from inspectlake.llm import toxicity

FIELD = toxicity.Field({}, 0.0, -1.0, 0.3, 0.7, -0.5)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_pieces_of_a_chain_give_the_whole_chain(monkeypatch, piece):
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 23, 8, 40])
    evidence = rng.normal(scale=3, size=sizes.sum())
    whole = FIELD.marginals(evidence, sizes)
    monkeypatch.setattr(toxicity, "CHAIN", piece)
    assert np.allclose(FIELD.marginals(evidence, sizes), whole, atol=1e-12)


def test_words_on_both_sides_of_a_cut_count_together():
    """Bad words around the 4096th token score as they do anywhere else."""
    field = toxicity.Field({"wbad": 4.0}, -2.5, -3.0, -1.0, 1.5, -3.0)
    text = lambda n: " ".join(["fine"] * n + ["bad"] * 4 + ["fine"] * 5000)
    scores, spans = toxicity.score_texts([text(3000), text(toxicity.CHAIN - 2)], field)
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)
    assert len(spans[0].split(",")) == len(spans[1].split(",")) == 4


def log_likelihood(field, evidence, sizes, y):
    """By the sum over all label sequences."""
    total, at = 0.0, 0

    def weight(labels, values):
        w = values[0] + field.start if labels[0] else 0.0
        for k in range(1, len(labels)):
            w += (values[k] if labels[k] else 0.0) + {(0, 0): 0.0, (0, 1): field.into, (1, 0): field.out, (1, 1): field.stay}[labels[k - 1], labels[k]]
        return w

    for n in sizes:
        values, own = evidence[at : at + n], tuple(y[at : at + n].astype(int))
        total += weight(own, values) - np.logaddexp.reduce([weight(p, values) for p in itertools.product((0, 1), repeat=int(n))])
        at += n
    return total


def test_slopes_against_differences():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 1, 6])
    evidence, y = rng.normal(size=11), rng.integers(0, 2, 11).astype(float)
    by_token, by_move = toxicity.gradient(FIELD, evidence, sizes, y)
    step = 1e-5
    for k in range(11):
        up, down = evidence.copy(), evidence.copy()
        up[k] += step
        down[k] -= step
        slope = (log_likelihood(FIELD, up, sizes, y) - log_likelihood(FIELD, down, sizes, y)) / (2 * step)
        assert by_token[k] == pytest.approx(slope, abs=1e-6)
    for k, name in enumerate(("into", "out", "stay", "start")):
        sides = []
        for sign in (1, -1):
            moved = toxicity.Field({}, 0.0, FIELD.into, FIELD.out, FIELD.stay, FIELD.start)
            setattr(moved, name, getattr(moved, name) + sign * step)
            sides.append(log_likelihood(moved, evidence, sizes, y))
        assert by_move[k] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-6)
