"""Gradient-boosted trees on numpy arrays: small models, trained here, kept as JSON."""

from __future__ import annotations

import json

import numpy as np


class BoostedTrees:
    """Binary classifier: a sum of depth-limited trees on the log-odds scale.

    Each tree is five flat arrays (feature, threshold, left, right, value); a node with feature -1
    is a leaf.  Missing values are not expected: features are numbers by construction.
    """

    def __init__(self, base: float = 0.0, trees: list[dict] | None = None):
        self.base = base
        self.trees = trees or []
        self._arrays = [self._pack(t) for t in self.trees]

    @staticmethod
    def _pack(tree: dict):
        return (np.array(tree["f"], np.int64), np.array(tree["t"]), np.array(tree["l"], np.int64), np.array(tree["r"], np.int64), np.array(tree["v"]), tree["d"])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value, depth in self._arrays:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[at]
                goes_left = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            out += value[at]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0, least: int = 8) -> BoostedTrees:
        """Newton boosting of the logistic loss with exact splits over at most 24 cuts a feature."""
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        model = cls(float(np.log(share / (1 - share))))
        cuts = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            middles = (values[:-1] + values[1:]) / 2
            cuts.append(middles if len(middles) <= 24 else np.quantile(middles, np.linspace(0, 1, 24)))
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(x), model.base)
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = {"f": [], "t": [], "l": [], "r": [], "v": [], "d": depth}

            def grow(rows: np.ndarray, level: int) -> int:
                node = len(tree["f"])
                for key, blank in (("f", -1), ("t", 0.0), ("l", 0), ("r", 0), ("v", 0.0)):
                    tree[key].append(blank)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                tree["v"][node] = float(rate * total_g / (total_h + ridge))
                if level == depth or len(rows) < 2 * least:
                    return node
                best = (1e-6, None, None)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    bg = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1]
                    bh = np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                    n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                    gain = bg**2 / (bh + ridge) + (total_g - bg) ** 2 / (total_h - bh + ridge) - total_g**2 / (total_h + ridge)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] is None:
                    return node
                _, j, k = best
                mask = binned[rows, j] <= k
                tree["f"][node], tree["t"][node] = j, float(cuts[j][k])
                tree["l"][node] = grow(rows[mask], level + 1)
                tree["r"][node] = grow(rows[~mask], level + 1)
                return node

            grow(np.arange(len(x)), 0)
            model.trees.append(tree)
            model._arrays.append(cls._pack(tree))
            margin += BoostedTrees(0.0, [tree]).margins(x)
        return model

    def to_json(self) -> dict:
        def short(tree: dict) -> dict:
            return {k: [round(v, 5) for v in tree[k]] if k in "tv" else tree[k] for k in tree}

        return {"base": round(self.base, 6), "trees": [short(t) for t in self.trees]}

    @classmethod
    def from_json(cls, data: dict | str) -> BoostedTrees:
        data = json.loads(data) if isinstance(data, str) else data
        return cls(data["base"], data["trees"])
