"""Counts of contacts by products of matrices, against the exact predicates."""

from collections import Counter

import numpy as np
import pytest

from quarryline.operators import contacts, tiles


def odd_faces(n: int) -> np.ndarray:
    """A strip over random points and a flat sheet, with faces that are equal, without area, thin, tiny, huge, in one plane or just touch."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(n + 2, 3)).astype(np.float32).astype(float)
    t = np.stack([v[:-2], v[1:-1], v[2:]], 1)
    t[3], t[4], t[5] = t[9], t[8][[1, 2, 0]], t[7] * 0.5 + t[7].mean(0) * 0.5
    t[10, 2], t[11, 1:], t[12, 2] = t[10, 1], t[11, 0], t[12, 0] / 2 + t[12, 1] / 2
    t[13, 2] = t[13, 0] + (t[13, 1] - t[13, 0]) * 0.3 + 1e-9
    t[14], t[15] = t[16] * 1e-4 + t[17].mean(0), t[18] * 20
    t[19, 0], t[20, 0] = t[21].mean(0), t[22, 0] * 0.4 + t[22, 1] * 0.6
    grid = np.stack(np.meshgrid(np.arange(4.0), np.arange(4.0), [0.25]), -1).reshape(4, 4, 3) / 2
    flat = [x for i in range(3) for j in range(3) for x in (grid[[i, i + 1, i], [j, j, j + 1]], grid[[i + 1, i + 1, i], [j, j + 1, j + 1]])]
    upright = [[0.125, 0.125, 0.125], [0.125, 0.2, 1.0], [0.3, 0.125, 1.0]]
    return np.r_[t, flat, [flat[0] + [0.2, 0.1, 0.0]], [upright]]


def slow(t: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict:
    met = ((t.min(1)[i] <= t.max(1)[j]) & (t.max(1)[i] >= t.min(1)[j])).all(1)
    return dict(Counter(contacts.classify_all(t[np.minimum(i, j)[met]], t[np.maximum(i, j)[met]])))


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0.0), (0.125, 0.0), (1e-3, 0.0), (1e6, 0.0), (1.0, 1e6)])
def test_all_classes(monkeypatch, scale, shift):
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "OPEN", 50)
    monkeypatch.setattr(tiles, "GROUP", 2)
    t = odd_faces(100) * scale + shift
    n, ids = len(t), np.arange(len(t))
    exact = lambda a, b: Counter(contacts.classify_all(a, b))
    got = tiles.count_pairs(t, ids, np.zeros(n, bool), exact)
    assert {k: c for k, c in got.items() if c} == slow(t, *np.triu_indices(n, 1))
    if scale == 1.0 and not shift:
        assert set(got) == set(contacts.ALLOWED + contacts.BLOCKING)
    second = np.random.default_rng(7).random(n) < 0.4
    got = tiles.count_pairs(t, ids, second, exact)
    i, j = (x.ravel() for x in np.meshgrid(ids[~second], ids[second]))
    assert {k: c for k, c in got.items() if c} == slow(t, i, j)


def test_few_pairs_are_left_open():
    v = np.random.default_rng(8).normal(0, 0.125, (902, 3))
    t, left = np.stack([v[:-2], v[1:-1], v[2:]], 1), []
    got = tiles.count_pairs(t, np.arange(900), np.zeros(900, bool), lambda a, b: left.append(len(a)) or contacts.count_all(a, b))
    i, j = np.triu_indices(900, 1)
    met = ((t.min(1)[i] <= t.max(1)[j]) & (t.max(1)[i] >= t.min(1)[j])).all(1)
    assert {k: c for k, c in got.items() if c} == {k: c for k, c in contacts.count_all(t[i[met]], t[j[met]]).items() if c}
    assert sum(left) < 900 * 2 + met.sum() * 0.002
