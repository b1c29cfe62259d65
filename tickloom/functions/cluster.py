"""Clusterings of small tables, in numpy: mixtures by BIC, density, hierarchy."""

from __future__ import annotations

import numpy as np

NOISE = -1


def distances(x: np.ndarray) -> np.ndarray:
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return np.sqrt(np.maximum(d, 0))


def gaussian_mixture(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """(labels, BIC) of a full-covariance mixture fitted by EM from k-means++ centres."""
    n, d = x.shape
    labels = kmeans(x, k, seed)
    share = np.full((n, k), 1e-3 / k)
    share[np.arange(n), labels] += 1 - 1e-3
    before, log_p = -np.inf, np.zeros((n, k))
    for _ in range(rounds):
        weight = share.sum(axis=0) + 1e-12
        mean = share.T @ x / weight[:, None]
        for j in range(k):
            away = x - mean[j]
            cov = (share[:, j, None] * away).T @ away / weight[j] + ridge * np.eye(d)
            root = np.linalg.cholesky(cov)
            z = np.linalg.solve(root, away.T)
            log_p[:, j] = np.log(weight[j] / n) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - d / 2 * np.log(2 * np.pi)
        top = log_p.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
        share = np.exp(log_p - total[:, None])
        if total.sum() - before < 1e-3 * n * 1e-3:
            break
        before = total.sum()
    free = k - 1 + k * d + k * d * (d + 1) // 2
    return share.argmax(axis=1), float(-2 * total.sum() + free * np.log(n))


def best_mixture(x: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Labels of the mixture of 2 to ``most`` components with the lowest BIC; one cluster for too few points."""
    tries = [gaussian_mixture(x, k, seed) for k in range(2, min(most, len(x) - 1) + 1)]
    return min(tries, key=lambda t: t[1])[0] if tries else np.zeros(len(x), int)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    c = np.asarray(centres, float)
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(k):
            if (new == j).any():
                c[j] = x[new == j].mean(axis=0)
        if (new == labels).all():
            break
        labels = new
    return labels


def dbscan(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels by density over a distance matrix; -1 is noise."""
    near = d <= eps
    core = near.sum(axis=1) >= least
    labels, k = np.full(len(d), NOISE), 0
    for i in np.flatnonzero(core):
        if labels[i] != NOISE:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if labels[j] != NOISE:
                continue
            labels[j] = k
            if core[j]:
                todo.extend(np.flatnonzero(near[j] & (labels == NOISE)))
        k += 1
    return labels


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette over a distance matrix; a single member scores 0."""
    ks = np.unique(labels)
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in ks], axis=1)
    sizes = np.asarray([(labels == k).sum() for k in ks])
    own = np.searchsorted(ks, labels)
    rows = np.arange(len(d))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def knee(y: np.ndarray) -> float:
    """The value of an increasing convex curve where it lies furthest under its chord; its median if straight."""
    y = np.sort(y)
    if len(y) < 3 or np.ptp(y) == 0:
        return float(np.median(y))
    gap = np.linspace(0, 1, len(y)) - (y - y[0]) / np.ptp(y)
    return float(y[gap.argmax()]) if gap.max() > 1e-9 else float(np.median(y))


def best_dbscan(x: np.ndarray, neighbours: int = 7, grid: int = 10, least: tuple[int, int] = (2, 7)) -> np.ndarray:
    """The density clustering of a grid with the best silhouette over what is not noise.

    Radii lie between the 10th and 90th percentile of the distance to the k-th neighbour (itself
    included). Where no setting gives two clusters, the curve's knee is the radius, with two neighbours."""
    d = distances(x)
    kth = np.sort(d, axis=1)[:, min(neighbours, len(x)) - 1]
    best, score = None, -np.inf
    for eps in np.linspace(np.percentile(kth, 10), np.percentile(kth, 90), grid):
        for m in range(least[0], least[1] + 1):
            labels = dbscan(d, eps, m)
            keep = labels != NOISE
            if len(np.unique(labels[keep])) < 2:
                continue
            s = silhouette(d[np.ix_(keep, keep)], labels[keep])
            if s > score:
                best, score = labels, s
    return best if best is not None else dbscan(d, knee(kth), 2)


def hdbscan(x: np.ndarray, least: int = 8) -> np.ndarray:
    """Leaves of the condensed tree of mutual reachability; -1 is noise."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, NOISE)
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(least, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # spanning tree by Prim, then merges by rising distance
    inside, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], link[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], link[at], at))
    parent, members, kids = list(range(2 * n - 1)), {i: [i] for i in range(n)}, {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (_, a, b) in enumerate(sorted(edges, key=lambda e: e[0])):
        p, q, new = root(a), root(b), n + k
        members[new] = members[p] + members[q]
        kids[new] = (p, q)
        parent[p] = parent[q] = new
    labels, k, todo = np.full(n, NOISE), 0, [(2 * n - 2, False)]
    while todo:
        node, split = todo.pop()
        top, at = node, node
        # walk down while only one side is large enough
        while at in kids:
            big = [c for c in kids[at] if len(members[c]) >= least]
            if len(big) == 2:
                todo.extend((c, True) for c in big)
                break
            if not big:
                at = None
                break
            at = big[0]
        else:
            at = None
        if at is None and split:
            labels[members[top]] = k
            k += 1
    return labels


def ward_1d(x: np.ndarray, limit: float = 0.10) -> np.ndarray:
    """Agglomeration of values by Ward's distance up to ``limit``; labels in order of value."""
    order = np.argsort(x, kind="stable")
    groups = [[i] for i in order]
    while len(groups) > 1:
        means, sizes = np.asarray([x[g].mean() for g in groups]), np.asarray([len(g) for g in groups])
        cost = np.sqrt(2 * sizes[:-1] * sizes[1:] / (sizes[:-1] + sizes[1:])) * np.abs(np.diff(means))
        at = int(cost.argmin())
        if cost[at] >= limit:
            break
        groups[at : at + 2] = [groups[at] + groups[at + 1]]
    labels = np.zeros(len(x), int)
    for k, g in enumerate(groups):
        labels[g] = k
    return labels


def global_clusters(x: np.ndarray, least: int = 8, most: int = 12) -> np.ndarray:
    """Leaf clusters by density, or where all is noise the k-means clustering of the best silhouette."""
    labels = hdbscan(x, least)
    if (labels != NOISE).any() or len(x) < 3:
        return labels if (labels != NOISE).any() else np.zeros(len(x), int)
    d = distances(x)
    tries = [kmeans(x, k) for k in range(2, min(most, len(x) - 1) + 1)]
    good = [t for t in tries if len(np.unique(t)) > 1]
    return max(good, key=lambda t: silhouette(d, t)) if good else np.zeros(len(x), int)
