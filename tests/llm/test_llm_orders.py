"""Orders and distinct values that op12 takes at every step, in less time than a plain stable sort."""

from __future__ import annotations

import time

import numpy as np
import pytest

from vectable.llm.packed import distinct, stable_order


@pytest.mark.parametrize("most", [0, 9, (1 << 16) - 1, 1 << 16, 1 << 40, (1 << 63) - 1])
def test_order_is_the_stable_one(most):
    drawn = np.random.default_rng(3)
    keys = drawn.integers(0, most, 5000, endpoint=True)
    keys[::3] = keys[0]
    keys[7] = most
    assert stable_order(keys, most).tolist() == np.argsort(keys, kind="stable").tolist()
    assert not len(stable_order(keys[:0], most))
    assert distinct(keys).tolist() == sorted(set(keys.tolist()))
    assert not len(distinct(keys[:0]))


def test_order_costs_less_than_a_stable_sort():
    keys = np.random.default_rng(4).integers(0, 1 << 34, 400_000)

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: stable_order(keys, 1 << 34)) < least(lambda: np.argsort(keys, kind="stable"))
