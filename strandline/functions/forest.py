"""Regression trees over one series, all trees of a block grown level by level together.

A level is a handful of sorts: rows in the bag are ordered by (tree, node, bin), running sums give every cut of every node, and
each node takes the best one. Rows to be predicted walk along with weight 0, so a level also yields their values, and shallower trees are
read off as the levels before: one deep forest holds all depth limits. The input is one series, whose length the calendar bounds.
"""

from __future__ import annotations

import numpy as np

BINS = 256  # cuts of a feature; exact where it takes no more values


def binned(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Bin numbers per feature; edges are values (or quantiles of them) of the train rows."""
    out = np.zeros(x.shape, np.int64)
    for j in range(x.shape[1]):
        values = np.unique(x[train, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[train, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        middle = (values[1:] + values[:-1]) / 2 if len(values) <= BINS else values
        out[:, j] = np.searchsorted(middle, x[:, j], side="left")
    return out


def starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))


def best_cuts(node: np.ndarray, row: np.ndarray, w: np.ndarray, y: np.ndarray, bins: np.ndarray, nodes: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gain, feature and last bin of the left side for each node; gain 0 where no cut leaves `leaf` rows on both sides."""
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    size, mass, total = np.bincount(node, minlength=nodes), np.bincount(node, w, nodes), np.bincount(node, w * y, nodes)
    base = total ** 2 / mass
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    for j in range(bins.shape[1]):
        b = bins[row, j]
        order = np.argsort(node * (b.max(initial=0) + 1) + b, kind="stable")
        n, b, wo, so = node[order], b[order], np.cumsum(w[order]), np.cumsum((w * y)[order])
        end = np.flatnonzero((n[1:] == n[:-1]) & (b[1:] != b[:-1]))  # last row of the left side
        if not len(end):
            continue
        at = n[end]
        before = first[at]
        w_before, s_before = np.where(before > 0, wo[before - 1], 0.0), np.where(before > 0, so[before - 1], 0.0)
        left, wl, sl = end + 1 - before, wo[end] - w_before, so[end] - s_before
        fits = (left >= leaf) & (size[at] - left >= leaf)
        end, at, wl, sl = end[fits], at[fits], wl[fits], sl[fits]
        if not len(end):
            continue
        g = sl ** 2 / wl + (total[at] - sl) ** 2 / (mass[at] - wl) - base[at]
        begin = starts(at)
        top = np.maximum.reduceat(g, begin)
        hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(begin, len(g)))))
        hit = hit[starts(at[hit])]  # the first of equal cuts
        better = g[hit] > gain[at[hit]] + 1e-12 * np.abs(base[at[hit]])
        k = at[hit[better]]
        gain[k], feature[k], cut[k] = g[hit[better]], j, b[end[hit[better]]]
    return gain, feature, cut


def grow(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, leaf: int, depths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over trees of the values of all rows, per depth limit (depth, row); importances by feature (depth, feature).

    weights: (tree, row), 0 outside the bag.
    """
    trees, n = weights.shape
    p = bins.shape[1]
    node, value = np.repeat(np.arange(trees), n), np.zeros(trees * n)
    w, row = weights.ravel().astype(float), np.tile(np.arange(n), trees)
    values, shares = np.zeros((len(depths), n)), np.zeros((len(depths), p))
    gains, live, done = np.zeros((trees, p)), np.arange(trees * n), 0
    nodes, tree_of = trees, np.arange(trees)
    for depth in range(max(depths) + 1):
        bag = live[w[live] > 0]
        mass = np.bincount(node[bag], w[bag], nodes)
        mean = np.bincount(node[bag], w[bag] * y[row[bag]], nodes) / np.where(mass > 0, mass, 1)
        value[live] = mean[node[live]]
        gain = np.zeros(0)
        if depth < max(depths):
            order = np.argsort(node[bag], kind="stable")
            bag = bag[order]
            gain, feature, cut = best_cuts(node[bag], row[bag], w[bag], y[row[bag]], bins, nodes, leaf)
        last = not (gain > 0).any()
        while done < len(depths) and (depths[done] == depth or last):
            values[done] = value.reshape(trees, n).sum(axis=0)
            total = gains.sum(axis=1, keepdims=True)
            shares[done] = (gains / np.where(total > 0, total, 1)).sum(axis=0)
            done += 1
        if last or done == len(depths):
            break
        split = gain > 0
        np.add.at(gains, (tree_of[split], feature[split]), gain[split])
        live = live[split[node[live]]]
        at = node[live]
        number = np.cumsum(split) - 1
        node[live] = 2 * number[at] + (bins[row[live], feature[at]] > cut[at])
        tree_of = np.repeat(tree_of[split], 2)
        nodes = 2 * int(split.sum())
    return values, shares


def bags(trees: range, n: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (tree, row); a tree's draws depend on its number alone."""
    return np.stack([np.random.default_rng([seed, t]).poisson(1.0, n) for t in trees]).astype(float)


def boost(bins: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int, rate: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows after gradient boosting of squared errors on the train rows, and importances by feature."""
    weight = train.astype(float)[None, :]
    value = np.full(len(y), y[train].mean())
    shares = np.zeros(bins.shape[1])
    for _ in range(rounds):
        step, share = grow(bins, np.where(train, y - value, 0.0), weight, 1, (depth,))
        value = value + rate * step[0]
        shares += share[0]
    return value, shares / rounds
