"""Ridge classification of features that a subclass makes."""

from __future__ import annotations

import numpy as np


class Ridge:
    """One-against-all ridge regression on standardised features; the penalty with the least leave-one-out error."""

    def fit(self, x, y):
        f = self.features(x, True)
        self.mean, self.scale = f.mean(0), np.where(f.std(0) < 1e-9, 1, f.std(0))
        f = (f - self.mean) / self.scale
        self.classes = np.unique(y)
        target = np.where(y[:, None] == self.classes[None], 1.0, -1.0)
        self.bias = target.mean(0)
        u, s, v = np.linalg.svd(f, full_matrices=False)
        best = None
        for penalty in np.logspace(-3, 3, 10):
            shrink = s**2 / (s**2 + penalty)
            fitted = u @ (shrink[:, None] * (u.T @ (target - self.bias)))
            lever = np.clip((u**2 @ shrink) + 1 / len(f), None, 1 - 1e-6)
            error = (((target - self.bias - fitted) / (1 - lever[:, None])) ** 2).mean()
            if best is None or error < best[0]:
                best = error, v.T @ ((s / (s**2 + penalty))[:, None] * (u.T @ (target - self.bias)))
        self.weights = best[1]
        return self

    def predict(self, x):
        f = (self.features(x, False) - self.mean) / self.scale
        return self.classes[(f @ self.weights + self.bias).argmax(1)]

    @staticmethod
    def fit_predict_many(f: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray) -> np.ndarray:
        """What fit on the rows `train` and predict on `test` give for each of many feature tables (tables, rows, features) with the same labels."""
        g, h = np.ascontiguousarray(f[:, train]), np.ascontiguousarray(f[:, test])
        mean, std = g.mean(1, keepdims=True), g.std(1, keepdims=True)
        scale = np.where(std < 1e-9, 1, std)
        g, h = (g - mean) / scale, (h - mean) / scale
        classes = np.unique(y[train])
        target = np.where(y[train][:, None] == classes[None], 1.0, -1.0)
        bias = target.mean(0)
        u, s, v = np.linalg.svd(g, full_matrices=False)
        turned, squared = u.transpose(0, 2, 1) @ (target - bias), u**2
        penalties, least = np.logspace(-3, 3, 10), None
        for i, penalty in enumerate(penalties):
            shrink = s**2 / (s**2 + penalty)
            fitted = u @ (shrink[:, :, None] * turned)
            lever = np.clip((squared @ shrink[:, :, None])[:, :, 0] + 1 / g.shape[1], None, 1 - 1e-6)
            error = (((target - bias - fitted) / (1 - lever[:, :, None])) ** 2).reshape(len(g), -1).mean(1)
            if least is None:
                least, best = error, np.zeros(len(g), dtype=np.int64)
            better = error < least
            least, best = np.where(better, error, least), np.where(better, i, best)
        weights = v.transpose(0, 2, 1) @ ((s / (s**2 + penalties[best][:, None]))[:, :, None] * turned)
        return classes[(h @ weights + bias).argmax(2)]
