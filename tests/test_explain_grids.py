"""Shapley values looked up in grids of cells are those worked out leaf by leaf."""

import numpy as np
import pytest

from plumbline.operators import explain


def _tree(r, t, depth, features):
    rows = []

    def grow(node, d, cover):
        if d == depth or cover < 2:
            rows.append((t, node, -1, 0.0, -1, -1, float(r.normal()), cover))
            return
        left = float(r.integers(1, int(cover)))
        rows.append((t, node, int(r.integers(0, features)), round(float(r.normal()), 1), 2 * node + 1, 2 * node + 2, 0.0, cover))
        grow(2 * node + 1, d + 1, left)
        grow(2 * node + 2, d + 1, cover - left)

    grow(0, 0, 1000.0)
    return rows


@pytest.mark.parametrize("cells", [4, 60, 1 << 17])
def test_grids(monkeypatch, cells):
    r = np.random.default_rng(3)
    nodes = [n for t in range(6) for n in _tree(r, t, 4, 3)] + [(6, 0, -1, 0.0, -1, -1, 0.5, 10.0)]
    x = r.normal(size=(500, 3)).round(1)  # values on the cuts as well
    x[::7, 0], x[::11, 1], x[::13, 2], x[::17, 2] = np.nan, np.inf, -np.inf, np.nan
    want = explain.tree_shares(explain.paths(nodes), x)
    monkeypatch.setattr(explain, "CELLS", cells)
    tables, left = explain.grids(explain.by_tree(nodes), 3)
    assert all(len(g.values) <= cells for g in tables) and bool(left) == (cells < 100)
    seen = []
    monkeypatch.setattr(explain, "shares_of", lambda *a: seen.append(1) or pytest.fail("worked out again") if not left else shares_of(*a))
    got = sum((g.of(x) for g in tables), explain.tree_shares(left, x))
    assert np.allclose(got, want, rtol=0, atol=1e-12)


shares_of = explain.shares_of
