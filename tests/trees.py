"""Second-order boosting on one machine, written plainly: rows are split by
recursion on raw values and every cut of every feature is tried.  Gradients and
hessians are rounded to the same units as the library's."""

import numpy as np

UNIT = float(1 << 30)


class Tree:
    def __init__(self, x, g, h, cuts, eta, depth, lam, mcw, gamma):
        self.nodes, self.gains = {}, {}
        self.cuts, self.eta, self.depth, self.lam, self.mcw, self.gamma = cuts, eta, depth, lam, mcw, gamma
        self.grow(0, 0, x, g, h)

    def score(self, g, h):
        return (g / UNIT) ** 2 / (h / UNIT + self.lam)

    def grow(self, i, level, x, g, h):
        G, H = g.sum(), h.sum()
        best = None
        if level < self.depth and len(x):
            for f, cuts in enumerate(self.cuts):
                v = x[:, f]
                missing = np.isnan(v)
                for c in [*cuts, np.inf]:
                    for left_too in (True, False):
                        with np.errstate(invalid="ignore"):
                            left = np.where(missing, left_too, v <= c)
                        hl = h[left].sum()
                        if hl < self.mcw * UNIT or H - hl < self.mcw * UNIT:
                            continue
                        gl = g[left].sum()
                        gain = self.score(gl, hl) + self.score(G - gl, H - hl) - self.score(G, H)
                        if best is None or gain > best[0]:
                            best = gain, f, c, left_too, left
        if best is None or best[0] <= max(self.gamma, 1e-6):
            self.nodes[i] = (-1, None, None, -self.eta * (G / UNIT) / (H / UNIT + self.lam))
            return
        gain, f, c, left_too, left = best
        self.nodes[i] = (f, c, left_too, None)
        self.gains[i] = gain
        self.grow(2 * i + 1, level + 1, x[left], g[left], h[left])
        self.grow(2 * i + 2, level + 1, x[~left], g[~left], h[~left])

    def value(self, row):
        i = 0
        while True:
            f, c, left_too, w = self.nodes[i]
            if f < 0:
                return w
            v = row[f]
            left = left_too if np.isnan(v) else v <= c
            i = 2 * i + (1 if left else 2)


def boost(x, y, cuts, rounds, eta, depth, lam=1.0, mcw=1.0, gamma=0.0):
    trees, margin = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g = np.rint((p - y) * UNIT).astype(np.int64)
        h = np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT).astype(np.int64)
        trees.append(Tree(x, g, h, cuts, eta, depth, lam, mcw, gamma))
        margin = margin + np.array([trees[-1].value(r) for r in x])
    return trees, margin
