"""Marginals of long texts against a full forward-backward."""

import numpy as np

from tradeweave.llm import toxicity


def test_marginals_of_long_texts_that_begin_or_end_with_a_weighted_word():
    steps = (((0.0, -3.0), (0.0, -1.0)), ((0.0, -3.0), (-2.0, 1.5)), ((0.5, -1.0), (1.0, 2.0)))
    worst = 0.0
    for step in steps:
        for bias in (-6.0, -2.0, 0.5):
            chain = toxicity.Chain(step=step, bias=bias)
            for n, places in ((400, (0,)), (400, (399,)), (400, (0, 399)), (401, (0, 200, 400)), (400, (200, 398)), (300, ()), (1, (0,))):
                weights = [(i, 6.0) for i in places]
                e = np.full((1, n), bias)
                for i, w in weights:
                    e[0, i] += w
                full, _ = toxicity._forward_backward(e, np.array([n]), np.array(step))
                near = dict(chain.marginals(weights, n))
                worst = max([worst, *(abs(full[0, i] - p) for i, p in near.items())])
                assert set(places) <= near.keys()
                if bias == -6.0 and n == 401:
                    assert len(near) < n  # gaps are still skipped
    assert worst < 1e-7, worst
