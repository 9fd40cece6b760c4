"""Window classification, cross-validation and the merging of confused states, for one series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernels import as_series, pick, segment, window_size_of
from .ridge import Ridge
from .window_classifiers import CompetingKernels, ConvolutionNet, DilatedShapelets, ProximityTrees, SummaryForest, SymbolicWords


#: Values of windows whose features are made at once.
MANY_VALUES = 65_536


def windows_of(x: np.ndarray, labels: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-overlapping windows (count, channels, w) and the state at their start; starts just before a change are left out."""
    stride, n = max(1, w // 2), len(x)
    closed = np.zeros(n, dtype=bool)
    for cp in np.flatnonzero(labels[1:] != labels[:-1]) + 1:
        closed[max(0, cp - w // 2 + 1) : cp] = True
    starts = [i for i in range(0, n - w + 1, stride) if not closed[i]]
    return np.array([x[i : i + w].T for i in starts]).reshape(len(starts), x.shape[1], w), labels[starts] if starts else labels[:0]


def capped(x: np.ndarray, y: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` windows of each state, shuffled."""
    rng = np.random.RandomState(seed)
    rows = [r if len(r) <= most else rng.choice(r, most, replace=False) for r in (np.flatnonzero(y == v) for v in np.unique(y))]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    at = at[rng.permutation(len(at))]
    return x[at], y[at]


class Dummy:
    """Uniform guesses among the classes."""

    def __init__(self, seed: int):
        self.rng = np.random.RandomState(seed)

    def fit(self, x, y):
        self.classes = np.unique(y)
        return self

    def predict(self, x):
        return self.rng.choice(self.classes, len(x))


class RandomKernels(Ridge):
    """Random dilated convolutions; the share above zero and the maximum of each go to a ridge classifier."""

    def __init__(self, seed: int, kernels: int = 500):
        self.seed, self.kernels = seed, kernels

    def features(self, x, fitting):
        x = (x - x.mean(2, keepdims=True)) / np.where(x.std(2, keepdims=True) < 1e-9, 1, x.std(2, keepdims=True))
        count, channels, w = x.shape
        if fitting:
            rng = np.random.RandomState(self.seed)
            self.table = []
            for _ in range(self.kernels):
                length = int(rng.choice([7, 9, 11]))
                length = min(length, w)
                dilation = int(2 ** rng.uniform(0, np.log2(max(1, (w - 1) / max(1, length - 1)))))
                weights = rng.normal(size=(rng.randint(1, channels + 1), length))
                self.table.append((weights - weights.mean(1, keepdims=True), rng.choice(channels, len(weights), replace=False), dilation, rng.uniform(-1, 1), bool(rng.randint(2)) and w > 1))
        out = np.empty((count, 2 * len(self.table)))
        for i, (weights, which, dilation, bias, pad) in enumerate(self.table):
            reach = (weights.shape[1] - 1) * dilation
            v = np.pad(x[:, which], ((0, 0), (0, 0), (reach // 2, reach // 2))) if pad else x[:, which]
            m = max(1, v.shape[2] - reach)
            total = np.full((count, m), bias)
            for j in range(weights.shape[1]):
                total += np.einsum("c,ncm->nm", weights[:, j], v[:, :, j * dilation : j * dilation + m])
            out[:, 2 * i], out[:, 2 * i + 1] = (total > 0).mean(1), total.max(1)
        return out


class Quantiles(Ridge):
    """Quantiles of halves, quarters and eighths of windows, of their first and second steps and of their spectra, into a ridge classifier."""

    def __init__(self, seed: int):
        self.seed = seed

    def features(self, x, fitting=True):
        out = []
        for v in (x, np.diff(x, axis=2), np.diff(x, n=min(2, x.shape[2] - 1), axis=2), np.abs(np.fft.rfft(x, axis=2))):
            for parts in (1, 2, 4, 8):
                for piece in np.array_split(v, parts, axis=2):
                    if piece.shape[2]:
                        out.append(np.quantile(piece, [0, 0.25, 0.5, 0.75, 1], axis=2).transpose(1, 2, 0).reshape(len(x), -1))
        return np.concatenate(out, axis=1)


CLASSIFIERS = {
    "dummy": Dummy, "rocket": RandomKernels, "quant": Quantiles, "mrhydra": CompetingKernels, "weasel": SymbolicWords, "rdst": DilatedShapelets,
    "freshprince": SummaryForest, "proximityforest": ProximityTrees, "inception": ConvolutionNet,
}


def cross_validated(x: np.ndarray, y: np.ndarray, classifier: str, folds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Truth and out-of-fold predictions over shuffled folds; with fewer than two folds the truth itself."""
    make, folds = pick(CLASSIFIERS, classifier, "classifier"), min(len(x), folds)
    if folds < 2:
        return y.copy(), y.copy()
    out = y.copy()
    for test in np.array_split(np.random.RandomState(seed).permutation(len(x)), folds):
        train = np.setdiff1d(np.arange(len(x)), test)
        out[test] = make(seed).fit(x[train], y[train]).predict(x[test])
    return y.copy(), out


def cross_validated_many(x: np.ndarray, y: np.ndarray, classifier: str, folds: int, seed: int) -> np.ndarray:
    """The out-of-fold predictions (series, count) that cross_validated makes for each of many series of windows (series, count, channels, w) with the same labels.

    Where features don't depend on the windows that are learned, those of all series are made at once, for
    all folds, and so are the fits.
    """
    make, folds = pick(CLASSIFIERS, classifier, "classifier"), min(x.shape[1], folds)
    out = np.repeat(y[None], len(x), axis=0)
    if folds < 2:
        return out
    if make not in (Quantiles, SummaryForest) or x.shape[1] > SummaryForest.MANY:
        for i, one in enumerate(x):
            out[i] = cross_validated(one, y, classifier, folds, seed)[1]
        return out
    model = make(seed)
    step = max(1, MANY_VALUES // x[0].size)
    for at in range(0, len(x), step):
        part = np.ascontiguousarray(x[at : at + step])
        f = model.features(part.reshape(-1, *part.shape[2:])).reshape(*part.shape[:2], -1)
        for test in np.array_split(np.random.RandomState(seed).permutation(x.shape[1]), folds):
            train = np.setdiff1d(np.arange(x.shape[1]), test)
            out[at : at + step, test] = model.fit_predict_many(f, y, train, test)
    return out


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    scores = []
    for c in np.union1d(y, p):
        hit, wrong = ((y == c) & (p == c)).sum(), ((y == c) != (p == c)).sum()
        scores.append(2 * hit / (2 * hit + wrong) if hit or wrong else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def gain(y: np.ndarray, p: np.ndarray) -> float:
    """Macro F1 less what guesses in proportion to the classes' shares would reach: of a class, precision and recall are then both its share."""
    shares = np.unique(y, return_counts=True)[1] / max(1, len(y))
    return macro_f1(y, p) - (float(shares.mean()) if len(shares) else 0.0)


def merge_states(labels: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges states that the classifier confuses, most confused first, while the gain doesn't fall; states are numbered from 1."""
    labels, y, p = labels.copy(), y.copy(), p.copy()
    refused: set[tuple[int, ...]] = set()
    merged = True
    while merged and len(np.unique(labels)) > 1:
        merged = False
        rows = []
        for a in np.unique(labels):
            mine = p[y == a]
            others = {int(b): int((mine == b).sum()) for b in np.unique(labels) if b != a}
            b = max(others, key=lambda c: (others[c], -c))
            rows.append((others[b] / len(mine) if len(mine) else 0.0, int(a), b))
        for _, a, b in sorted(rows, key=lambda r: (-r[0], -r[1])):
            key = tuple(np.flatnonzero((y == a) | (y == b)).tolist())
            if key in refused:
                continue
            y2, p2 = np.where(y == b, a, y), np.where(p == b, a, p)
            if gain(y, p) > gain(y2, p2):
                refused.add(key)
                continue
            keep, gone = max(a, b), min(a, b)
            labels, y, p = (np.where(v == gone, keep, v) for v in (labels, y, p))
            merged = True
            break
    kept = np.unique(labels)
    return np.searchsorted(kept, labels) + 1, y, p


@dataclass
class States:
    change_points: list[int]
    segment_states: list[int]
    window_size: int
    score: float

    def dense(self, n: int) -> np.ndarray:
        return dense_states(self.change_points, self.segment_states, n)


def dense_states(cps, states, n: int) -> np.ndarray:
    """The state of every point."""
    bounds = [0, *cps, n]
    return np.repeat(np.asarray(states), np.diff(bounds))


def detect_states(values, change_points=None, window_size: int | str = "suss", classifier: str = "rocket", n_splits: int = 5, sample_size: int = 1000, random_state: int = 2357) -> States:
    """States of the segments of one series; neighbouring segments of one state become one."""
    x = as_series(values)
    cps = segment(x).change_points if change_points is None else [int(c) for c in change_points]
    if isinstance(window_size, str):
        window_size = int(np.mean([max(1, window_size_of(x[:, d], window_size)) for d in range(x.shape[1])]))
    w = max(1, min(window_size, len(x)))
    labels = np.arange(len(cps) + 1)
    features, y = capped(*windows_of(x, dense_states(cps, labels, len(x)), w), sample_size, random_state)
    y, p = cross_validated(features, y, classifier, n_splits, random_state)
    labels, y, p = merge_states(labels, y, p)
    keep = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
    return States([cps[i - 1] for i in keep], [int(labels[0]), *(int(labels[i]) for i in keep)], w, macro_f1(y, p))


def predicted_many(x: np.ndarray, cps: list[int], window_size: int, classifier: str, n_splits: int, sample_size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Truth (count) and out-of-fold predictions (series, count) of the windows of many series (series, n, channels) with the same change points."""
    labels = dense_states(cps, np.arange(len(cps) + 1), x.shape[1])
    at, _ = windows_of(np.arange(x.shape[1], dtype=np.float64)[:, None], labels, window_size)  # the places of each window's points
    rows, y = capped(at[:, 0].astype(np.int64), windows_of(x[0], labels, window_size)[1], sample_size, seed)
    return y, cross_validated_many(np.ascontiguousarray(x[:, rows].transpose(0, 1, 3, 2)), y, classifier, n_splits, seed)


def detect_states_many(x: np.ndarray, change_points: list[int], window_size: int, classifier: str = "rocket", n_splits: int = 5, sample_size: int = 1000, random_state: int = 2357) -> list[tuple[list[int], list[int]]]:
    """(change points, states of segments) as detect_states gives them for each of many series (series, n, channels) with the same change points."""
    w = max(1, min(window_size, x.shape[1]))
    y, found = predicted_many(x, change_points, w, classifier, n_splits, sample_size, random_state)
    known: dict[bytes, tuple[list[int], list[int]]] = {}
    out = []
    for p in found:
        if (key := p.tobytes()) not in known:
            labels, _, _ = merge_states(np.arange(len(change_points) + 1), y, p)
            keep = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
            known[key] = [change_points[i - 1] for i in keep], [int(labels[0]), *(int(labels[i]) for i in keep)]
        out.append(known[key])
    return out
