"""Tabulated shares of leaves against the quadrature along paths, on hand-made trees."""

import numpy as np
import pytest

from flowtally.operators import treepaths
from flowtally.operators.treepaths import add_attributions, keep_tables, path_tree


def grown(rng, depth, n_features, ragged):
    nodes = {}

    def grow(left, count):
        i = len(nodes)
        nodes[i] = {"left": -1, "right": -1, "prediction": rng.normal(), "count": count, "feature": -1, "threshold": None}
        if left and count > 1 and not (ragged and left < depth and rng.random() < 0.3):
            some = max(1, int(count * rng.uniform(0.1, 0.9)))
            nodes[i] |= {"left": grow(left - 1, some), "right": grow(left - 1, max(1, count - some)), "feature": int(rng.integers(n_features)), "threshold": rng.normal()}
        return i

    grow(depth, 10_000)
    return nodes


@pytest.mark.parametrize("depth, n_features, ragged", [(7, 7, False), (7, 2, True), (10, 40, True), (1, 3, False), (4, 5, True)])
def test_tables_agree_with_quadrature(monkeypatch, depth, n_features, ragged):
    rng = np.random.default_rng(depth)
    tree, x = path_tree(grown(rng, depth, n_features, ragged), 0.3), rng.normal(size=(n_features, 5000))
    kept, built, plain = (np.zeros_like(x) for _ in range(3))
    add_attributions(tree, x, built)
    keep_tables([tree])
    assert "tables" in tree
    add_attributions(tree, x, kept)
    monkeypatch.setattr(treepaths, "TABLE_CELLS", -1)
    add_attributions(tree, x, plain)
    assert np.abs(kept).max() > 0 and np.array_equal(kept, built)
    np.testing.assert_allclose(kept, plain, atol=1e-12)


def test_tables_kept_are_bounded(monkeypatch):
    trees = [path_tree(grown(np.random.default_rng(i), 4, 5, False), 1.0) for i in range(3)]
    monkeypatch.setattr(treepaths, "KEPT_CELLS", trees[0]["table_cells"] + trees[1]["table_cells"])
    keep_tables(trees)
    assert ["tables" in t for t in trees] == [True, True, False]
