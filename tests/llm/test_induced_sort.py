import random

import numpy as np
import pytest

from tillroll.llm import induced_sort
from tillroll.llm.induced_sort import common_prefixes, suffix_arrays


def batch(strings):
    parts = [np.append(np.array(s, np.int64), 0) for s in strings]
    size = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.cumsum(size) - size, size


def strings():
    rng = random.Random(4)
    out = [[], [1], [2, 2, 2, 2], [3, 2, 1], [1, 2, 3], [1, 2] * 20, [2, 1] * 20, [1, 1, 2] * 15 + [1], [5] * 300]
    out += [[rng.randint(1, k) for _ in range(rng.randint(0, 200))] for k in (1, 2, 3, 9, 200) for _ in range(12)]
    unit = [rng.randint(1, 4) for _ in range(30)]
    return out + [unit * 6, unit * 3 + [1] + unit * 3]


@pytest.mark.parametrize("few", [0, 24, 1 << 20])
def test_orders_and_prefixes_against_sorting(monkeypatch, few):
    monkeypatch.setattr(induced_sort, "FEW", few)
    some = strings()
    t, start, size = batch(some)
    sa = suffix_arrays(t, start, size, np.full(len(size), 201))
    begins = np.zeros(len(t), bool)
    begins[start] = True
    lcp = common_prefixes(t, sa, start, 1)
    for s, n, string in zip(start.tolist(), size.tolist(), some):
        x = string + [0]
        want = sorted(range(n), key=lambda i: x[i:])
        assert (sa[s:s + n] - s).tolist() == want
        for a, b in zip(want, want[1:]):
            k = 0
            while x[b + k] > 1 and x[b + k] == x[a + k]:
                k += 1
            assert lcp[s + b] == k, (string, a, b)
        assert lcp[s + want[0]] == 0
