"""Louvain over one graph in plain Python: what the distributed moves are held against."""

import numpy as np


def louvain(a: np.ndarray, b: np.ndarray, resolution: float, seed: int) -> dict[int, int]:
    """node -> community (its smallest node).  The seed sets the order of visits only; ties go to the smaller community."""
    nodes = np.unique(np.concatenate([a, b]))
    index = {int(x): i for i, x in enumerate(nodes)}
    near: list[dict[int, float]] = [{} for _ in nodes]
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = index[x], index[y]
        near[i][j] = near[i].get(j, 0.0) + 1.0
        near[j][i] = near[j].get(i, 0.0) + 1.0
    members = [[i] for i in range(len(nodes))]
    total = sum(sum(n.values()) for n in near)
    rng = np.random.default_rng(seed)
    while True:
        n = len(near)
        own = list(range(n))
        weight = [sum(x.values()) for x in near]
        sums = weight[:]
        moved_any, moved = False, True
        order = rng.permutation(n).tolist()
        while moved:
            moved = False
            for i in order:
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        links[own[j]] = links.get(own[j], 0.0) + w
                old = own[i]
                sums[old] -= weight[i]
                best, gain = old, links.get(old, 0.0) - resolution * sums[old] * weight[i] / total
                for c in sorted(links):
                    g = links[c] - resolution * sums[c] * weight[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                sums[best] += weight[i]
                if best != old:
                    own[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(sorted(set(own)))}
        merged: list[list[int]] = [[] for _ in names]
        joined: list[dict[int, float]] = [{} for _ in names]
        for i in range(n):
            k = names[own[i]]
            merged[k] += members[i]
            for j, w in near[i].items():
                c = names[own[j]]
                joined[k][c] = joined[k].get(c, 0.0) + w
        members, near = merged, joined
    return {int(nodes[i]): int(nodes[min(m)]) for m in members for i in m}
