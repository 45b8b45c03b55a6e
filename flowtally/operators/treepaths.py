"""Shapley values of trees over batches of rows, along the paths of each tree.

What a leaf adds to a row depends on the features of its path: a row that meets all conditions on a feature counts the
feature in full, and without the feature it goes down the path with the share of training rows that did. So a leaf's
part is its value times a product over the path's features, and the Shapley value of feature j is

    value * (met_j - cover_j) * integral over t in [0, 1] of prod_{i != j} (cover_i (1 - t) + met_i t).

A tree is gone through once for all rows of a block. On the way down each node gets the product of its path at a few
quadrature points (exact for these polynomials); a condition on a feature met before replaces that feature's factor.
On the way up the products, times the leaves' values, are summed, and at each edge the sum without the edge's own
factor, less what deeper edges on the same feature take over, is the feature's share. The work grows with nodes times
rows times half the depth, memory with one tree and one block of rows.

A leaf's shares follow from which of its path's features are met, so for paths of few features they are tabulated first:
a row then costs one bit per edge and one look-up for each pair of sibling leaves. Trees with larger tables than
``TABLE_CELLS`` go the way above.
"""

from __future__ import annotations

import numpy as np

#: Products of a block of rows and the edges of a tree that are held at once: they stay in a core's cache.
CELLS = 1 << 16
#: Numbers in the tables of one tree, and in those of all trees that a worker keeps between batches (8 bytes each).
TABLE_CELLS = 1 << 20
KEPT_CELLS = 1 << 23
#: Rows that are looked up at once.
LOOKED_UP = 2048


def path_tree(nodes: dict[int, dict], weight: float) -> dict:
    """A tree as arrays, level by level, from its nodes (left and right below 0 for leaves; feature, threshold,
    prediction, count). Edges are numbered by level; ``prev`` is the edge above on the same feature."""
    feature, threshold, right, cover, prev, bit, levels = [], [], [], [], [], [], []
    above, longest, mean, ends = [(0, {}, 1.0)], 0, 0.0, []
    if nodes[0]["left"] < 0:
        mean = weight * nodes[0]["prediction"]
    while any(nodes[i]["left"] >= 0 for i, _, _ in above):
        start, below, inner, leaves, values = len(feature), [], [], [], []
        for i, last, share in above:
            node = nodes[i]
            if node["left"] < 0:
                continue
            j = node["feature"]
            for child, is_right in ((node["left"], False), (node["right"], True)):
                ratio = nodes[child]["count"] / node["count"]
                edge, before = len(feature), last.get(j, -1)
                feature.append(j)
                threshold.append(node["threshold"])
                right.append(is_right)
                cover.append(ratio * (cover[before] if before >= 0 else 1.0))
                prev.append(before)
                path = {**last, j: edge}
                bit.append(list(path).index(j))
                if nodes[child]["left"] < 0:
                    leaves.append(edge - start)
                    values.append(weight * nodes[child]["prediction"])
                    mean += values[-1] * share * ratio
                    longest = max(longest, len(path))
                    ends.append((edge, list(path), [cover[e] for e in path.values()], values[-1]))
                else:
                    inner.append(edge - start)
                    below.append((child, path, share * ratio))
        levels.append((start, len(feature), np.array(inner, int), np.array(leaves, int), np.array(values)))
        above = below
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-longest // 2)))
    t, w = (points + 1) / 2, weights / 2
    z = np.array(cover, float)
    order = np.argsort(feature, kind="stable")
    names, starts = np.unique(np.array(feature, int)[order], return_index=True)
    return {"feature": np.array(feature, int), "threshold": np.array(threshold, float), "right": np.array(right, bool), "prev": np.array(prev, int),
            "levels": levels, "mean": mean, "bit": np.array(bit, int), "ends": ends, "table_cells": sum(len(path) << len(path) for _, path, _, _ in ends),
            # the factor at each point: what it is anyway, and what a met condition adds
            "factor": np.stack([z[:, None] * (1 - t), np.broadcast_to(t, (len(z), len(t)))], axis=2),
            "replaced": {int(p): k for k, p in enumerate(sorted({p for p in prev if p >= 0}))},
            # sums at an edge to its share: where the condition is not met, and what a met one adds
            "share": np.stack([np.broadcast_to(-w / (1 - t), (len(z), len(t))), (1 - z)[:, None] * w / (z[:, None] * (1 - t) + t) + w / (1 - t)], axis=1),
            "order": order, "names": names, "starts": starts}


def _leaf_table(covers: list[float], value: float) -> np.ndarray:
    """A leaf's shares (features of its path, sets of met features): bit k of a set is the k-th feature of the path."""
    m = len(covers)
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-m // 2)))
    t, w = (points + 1) / 2, weights / 2
    met = (np.arange(1 << m) >> np.arange(m)[:, None]) & 1
    z = np.array(covers)[:, None]
    factor = (z[:, :, None] * (1 - t)) + met[:, :, None] * t
    return value * (met - z) * ((factor.prod(axis=0) / factor) @ w)


def shares_tables(tree: dict) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Look-up units of a tree: (edge of a leaf, -1, 0) or (left edge, right edge, features above them) of two sibling
    leaves, with the path's features and the table (features, sets). The table of siblings is by the set met above
    them, and above its bits whether the row goes left."""
    tables = {edge: (path, _leaf_table(covers, value)) for edge, path, covers, value in tree["ends"]}
    units = []
    for edge, (path, table) in tables.items():
        start = next(a for a, b, *_ in tree["levels"] if a <= edge < b)
        left = edge - (edge - start) % 2
        if left not in tables or left + 1 not in tables:
            units.append((edge, -1, 0, np.array(path), table))
        elif edge == left:
            bit, new = int(tree["bit"][edge]), tree["prev"][edge] < 0
            above = len(path) - new
            code = np.arange(1 << above)
            if new:
                on, off = code | 1 << bit, code
            else:
                on, off = code, code & ~(1 << bit)
            other = tables[left + 1][1]
            units.append((left, left + 1, above, np.array(path), np.concatenate([table[:, off] + other[:, on], table[:, on] + other[:, off]], axis=1)))
    return units


def keep_tables(trees: list[dict]) -> None:
    """Put the tables beside the trees, up to ``KEPT_CELLS`` numbers."""
    held = 0
    for tree in trees:
        if tree["table_cells"] <= TABLE_CELLS and held + tree["table_cells"] <= KEPT_CELLS:
            held += tree["table_cells"]
            tree["tables"] = shares_tables(tree)


def _add_looked_up(tree: dict, units: list, x: np.ndarray, phi: np.ndarray) -> None:
    """Add the shares of all leaves from their tables: on the way down each edge gets the set of its path's features
    that a row meets, as bits."""
    n_edges, again = len(tree["feature"]), tree["prev"] >= 0
    longest = max(len(path) for _, path, _, _ in tree["ends"])
    kind = np.uint8 if longest <= 8 else np.uint16 if longest <= 16 else np.uint32
    bits = (1 << tree["bit"]).astype(kind)[:, None]
    new = np.where(again[:, None], kind(0), bits)
    for at in range(0, x.shape[1], LOOKED_UP):
        block = x[:, at:at + LOOKED_UP]
        n = block.shape[1]
        codes, goes_left = np.empty((n_edges, n), kind), np.empty((n_edges // 2, n), bool)
        above = np.zeros((1, n), kind)
        for a, b, inner, _, _ in tree["levels"]:
            left = goes_left[a // 2:b // 2]  # siblings share a condition
            np.less_equal(block[tree["feature"][a:b:2]], tree["threshold"][a:b:2, None], out=left)
            # a feature met for the first time sets its bit, one met before keeps it only if met again
            for first, missed in ((a, ~left), (a + 1, left)):
                out = codes[first:b:2]
                np.multiply(missed.view(np.uint8), bits[first:b:2], out=out, dtype=kind)
                np.invert(out, out=out)
                out &= above | new[first:b:2]
            above = codes[a + inner]
        for edge, other, held, features, table in units:
            code = codes[edge].astype(np.intp)
            if other >= 0:  # the set above the siblings, of which a row meets one, and whether it goes left
                code = code | codes[other] if again[edge] else code & ~(1 << int(tree["bit"][edge]))
                code |= np.left_shift(goes_left[edge // 2], held, dtype=np.intp)
            for k, j in enumerate(features.tolist()):
                phi[j, at:at + n] += table[k].take(code, mode="clip")


def add_attributions(tree: dict, x: np.ndarray, phi: np.ndarray) -> None:
    """Add a tree's signed attributions to ``phi``; both are (features, rows)."""
    if not tree["levels"]:
        return
    if tree["table_cells"] <= TABLE_CELLS:
        _add_looked_up(tree, tree["tables"] if "tables" in tree else shares_tables(tree), x, phi)
        return
    n_edges, points, _ = tree["factor"].shape
    kept = np.array(list(tree["replaced"]), int)
    rows = max(64, CELLS // n_edges)
    for at in range(0, x.shape[1], rows):
        block = x[:, at:at + rows]
        n = block.shape[1]
        met, sums = np.empty((n_edges, n), bool), np.empty((n_edges, points, n))
        pair = np.ones((n_edges, 2, n))  # one and whether the condition is met, for each edge
        factors, above = np.empty((len(kept), points, n)), np.ones((1, points, n))
        for a, b, inner, leaves, values in tree["levels"]:
            met[a:b] = (block[tree["feature"][a:b]] <= tree["threshold"][a:b, None]) ^ tree["right"][a:b, None]
            again = a + np.flatnonzero(tree["prev"][a:b] >= 0)
            met[again] &= met[tree["prev"][again]]
            pair[a:b, 1] = met[a:b]
            factor = np.matmul(tree["factor"][a:b], pair[a:b])
            # the edges of a level are pairs, in the order of the inner nodes above
            np.multiply(above[:, None], factor.reshape(-1, 2, points, n), out=sums[a:b].reshape(-1, 2, points, n))
            for edge in again.tolist():
                sums[edge] /= factors[tree["replaced"][tree["prev"][edge]]]
            for edge in kept[(kept >= a) & (kept < b)].tolist():
                factors[tree["replaced"][edge]] = factor[edge - a]
            above = sums[a + inner]
            sums[a + leaves] *= values[:, None, None]
        for (a, _, inner, _, _), (c, d, _, _, _) in zip(tree["levels"][-2::-1], tree["levels"][:0:-1]):
            sums[a + inner] = sums[c:d:2] + sums[c + 1:d:2]
        again = np.flatnonzero(tree["prev"] >= 0)
        taken = sums[again]
        for k, p in enumerate(tree["prev"][again].tolist()):
            sums[p] -= taken[k]
        both = np.matmul(tree["share"], sums)
        both[:, 1] *= pair[:, 1]
        share = both[:, 0] + both[:, 1]
        phi[tree["names"], at:at + n] += np.add.reduceat(share[tree["order"]], tree["starts"], axis=0)


def margins_mean(trees: list[dict]) -> float:
    """The mean output of trees over their training rows, which attributions are added to."""
    return sum(t["mean"] for t in trees)
