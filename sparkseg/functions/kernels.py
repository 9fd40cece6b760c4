"""NumPy kernels for one series: neighbours, profile, validation, segmentation, window sizes.

They run inside grouped Arrow functions, one series a call, and hold a bounded block of distances.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

BLOCK = 2_000_000
#: Query length from which dot products go by Fourier transform, and rows after which the rolling ones start anew, so that errors do not add up.
FOURIER, RESTART = 512, 512


def as_series(values) -> np.ndarray:
    """(n, d) float64; anything that isn't numeric with one or two axes is a TypeError or ValueError."""
    x = np.asarray(values)
    if not np.issubdtype(x.dtype, np.number):
        raise TypeError("a series must be numeric")
    if x.ndim not in (1, 2):
        raise ValueError("a series has one or two axes")
    x = x.astype(np.float64).reshape(len(x), x.shape[1] if x.ndim == 2 else 1)
    if not np.isfinite(x).all():
        raise ValueError("a series must be finite")
    return x


def rolling_mean_std(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each window; a deviation below 0.001 counts as 1."""
    shift = x.mean() if len(x) else 0.0
    c, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x - shift, (x - shift) ** 2))
    mean = (c[w:] - c[:-w]) / w
    std = np.sqrt(np.maximum(0, (q[w:] - q[:-w]) / w - mean**2))
    return mean + shift, np.where(std < 1e-3, 1.0, std)


def rolling_energy(x: np.ndarray, w: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x * x, w).sum(1)


def rolling_complexity(x: np.ndarray, w: int) -> np.ndarray:
    """Squared steps of each window, the step into its first point included where there is one."""
    steps = np.concatenate([[0.0], np.diff(x) ** 2])
    return np.lib.stride_tricks.sliding_window_view(steps, w).sum(1) + 1e-5


def _znormed(x, w):
    mean, std = rolling_mean_std(x, w)
    return lambda rows, dot: 2 * w * (1 - (dot - w * np.outer(mean[rows], mean)) / (w * np.outer(std[rows], std)))


def _euclidean(x, w):
    energy = rolling_energy(x, w)
    return lambda rows, dot: energy[rows][:, None] + energy[None] - 2 * dot


def _complexity(x, w):
    energy, ce = rolling_energy(x, w), rolling_complexity(x, w)
    return lambda rows, dot: (energy[rows][:, None] + energy[None] - 2 * dot) * np.maximum(ce[rows][:, None], ce[None]) / np.minimum(ce[rows][:, None], ce[None])


DISTANCES = {"znormed_euclidean_distance": _znormed, "euclidean_distance": _euclidean, "cinvariant_euclidean_distance": _complexity}


def pick(registry: dict, name: str, what: str):
    if name not in registry:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(registry)}")
    return registry[name]


def smallest(distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each row, in order; equal ones by place."""
    d = np.array(distances, dtype=np.float64, ndmin=2)
    out = np.empty((len(d), k), dtype=np.int64)
    rows = np.arange(len(d))
    for j in range(k):
        out[:, j] = d.argmin(1)
        d[rows, out[:, j]] = np.inf
    return out


def sliding_dot(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dot products of a query with every window of its length; by Fourier transform if it is long, then exact for whole numbers too."""
    w, n = len(query), len(x)
    if w < FOURIER:
        return np.correlate(x, query, "valid")
    size = 1 << (n + w - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(query[::-1], size), size)[w - 1 : n]
    whole = (x == np.rint(x)).all() and np.abs(x).max() ** 2 * w < 2**40
    return np.rint(out) if whole else out


def rolling_dots(x: np.ndarray, w: int, first: int, stop: int, start: np.ndarray | None = None) -> np.ndarray:
    """Dot products of windows first .. stop - 1 with all windows: each row is the one before, a place on, with one product gone and one more.

    start holds the products of window 0, which begin every row.
    """
    l = len(x) - w + 1
    start = sliding_dot(x[:w], x) if start is None else start
    out = np.empty((stop - first, l))
    out[0] = start if first == 0 else sliding_dot(x[first : first + w], x)
    for r in range(1, stop - first):
        i = first + r
        out[r, 0] = start[i]
        np.add(out[r - 1, :-1], x[i + w - 1] * x[w:], out=out[r, 1:])
        out[r, 1:] -= x[i - 1] * x[: l - 1]
    return out


def neighbours(series: np.ndarray, w: int, k: int, distance: str = "znormed_euclidean_distance", constraints: list[tuple[int, int]] | None = None, rows: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and distances (windows, constraints, k) of every window's nearest windows beyond half a window; of windows rows[0] .. rows[1] - 1 if given."""
    x = as_series(series)
    n, dims = x.shape
    if n < w * k or n < w:
        raise ValueError("a series needs at least window size times neighbours points")
    constraints = [(0, n)] if constraints is None else constraints
    l, r = n - w + 1, w // 2
    begin, end = rows or (0, l)
    offsets, dists = np.zeros((end - begin, len(constraints), k), np.int64), np.zeros((end - begin, len(constraints), k))
    channels = [np.ascontiguousarray(x[:, d]) for d in range(dims)]
    starts = [sliding_dot(c[:w], c) for c in channels]
    rules = [pick(DISTANCES, distance, "distance")(c, w) for c in channels]
    step = max(1, min(RESTART, BLOCK // l))
    for at in range(begin, end, step):
        rows = np.arange(at, min(end, at + step))
        total = np.zeros((len(rows), l))
        near = np.abs(np.arange(l)[None] - rows[:, None]) <= r
        for channel, start, rule in zip(channels, starts, rules, strict=True):
            d = rule(rows, rolling_dots(channel, w, at, at + len(rows), start))
            d = np.where(near, d.max(1, keepdims=True), d)
            std = d.std(1, keepdims=True)
            total += (d - d.mean(1, keepdims=True)) / np.where(std == 0, 1, std) / dims
        for c, (low, high) in enumerate(constraints):
            mine = np.flatnonzero((rows >= low) & (rows < high))
            if len(mine) and high - w + 1 > low:
                part = total[mine, low : high - w + 1]
                found = smallest(part, min(k, part.shape[1]))
                offsets[rows[mine] - begin, c, : found.shape[1]] = found + low
                dists[rows[mine] - begin, c, : found.shape[1]] = np.take_along_axis(part, found, 1)
    return offsets, dists


def majority_threshold(offsets: np.ndarray) -> np.ndarray:
    """t with: most neighbours lie at or after split s if and only if t >= s."""
    k = offsets.shape[1]
    return offsets[:, 0] if k == 1 else np.sort(offsets, axis=1)[:, k - (k // 2 + 1)]


def _reverse_count(at: np.ndarray, l: int) -> np.ndarray:
    """How many values are s or more, for s in 0 .. l-1."""
    return np.bincount(np.minimum(np.maximum(at, 0), l), minlength=l + 1)[::-1].cumsum()[::-1][:l]


def f1_of(tp, fp, fn, tn):
    """Macro F1 of two classes; -inf where a class has no truth, no prediction or no hit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2
    return np.where((tp > 0) & (tn > 0), both, -np.inf)


def votes(offsets: np.ndarray, split: int, w: int) -> np.ndarray:
    """Predicted side of each window at a split; windows that reach over it count as right."""
    out = (majority_threshold(offsets) >= split).astype(np.int64)
    out[max(0, split - w) : split] = 1
    return out


SCORES = ("roc_auc", "f1")


def profile(offsets: np.ndarray, w: int, m: int, score: str = "roc_auc") -> np.ndarray:
    """Score of every split from counts over windows and their thresholds; -inf outside [m, l - m + w)."""
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}; known: {', '.join(SCORES)}")
    l = len(offsets)
    t, i, s = majority_threshold(offsets), np.arange(l), np.arange(l)
    right_hits = _reverse_count(np.minimum(i, t), l)
    change = np.zeros(l + w + 2, dtype=np.int64)
    low = np.maximum(i, t) + 1
    some = low <= i + w
    np.add.at(change, low[some], 1)
    np.add.at(change, i[some] + w + 1, -1)
    p1 = _reverse_count(t, l) + np.cumsum(change)[:l]
    p0, p0r = l - p1, (l - s) - right_hits
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (1 + right_hits / p1 - p0r / p0) / 2 if score == "roc_auc" else f1_of(p0 - p0r, p0r, p1 - right_hits, right_hits)
    out = np.full(l, -np.inf)
    inside = (s >= m) & (s < l - m + w) & np.isfinite(value)
    out[inside] = value[inside]
    return out


def stream_profile(offsets: np.ndarray, w: int, m: int, score: str = "f1") -> np.ndarray:
    """The online score of every split: windows that start in [s, s + w) are left out; -inf outside [m, l - m)."""
    l = len(offsets)
    t, i, s = majority_threshold(offsets), np.arange(l), np.arange(l)
    right, ones = i, t  # truth i >= s, vote t >= s; the zone s <= i < s + w is taken out
    tp = _reverse_count(np.minimum(right, ones), l)
    votes_right = _reverse_count(ones, l)
    zone = lambda flag: _zone(flag, l, w)
    in_zone_hit = zone(t)
    tn1 = tp - in_zone_hit
    size = np.minimum(s + w, l) - s
    fn_right = (l - s) - tp - (size - in_zone_hit)
    fp = votes_right - tp
    left_hit = s - fp
    value = f1_of(left_hit, fn_right, fp, tn1) if score == "f1" else (left_hit + tn1) / np.maximum(1, l - size)
    out = np.full(l, -np.inf)
    inside = (s >= m) & (s < l - m)
    out[inside] = value[inside]
    return out


def _zone(t: np.ndarray, l: int, w: int) -> np.ndarray:
    """For each s: windows i in [s, s + w) with t_i >= s."""
    i = np.arange(l)
    low, high = np.maximum(0, i - w + 1), np.minimum(i, t)  # i is counted for s in low .. min(i, t)
    some = high >= low
    return (np.bincount(low[some], minlength=l + 2) - np.bincount(high[some] + 1, minlength=l + 2)).cumsum()[:l]


def rank_sum_z(left0: float, left1: float, n1: float, zeros: float, n: float) -> float:
    """z of the rank sum of the left votes among all, average ranks, no tie correction."""
    n2 = n - n1
    if n1 <= 0 or n2 <= 0:
        return math.nan
    total = left0 * (zeros + 1) / 2 + left1 * (zeros + n + 1) / 2
    return (total - n1 * (n + 1) / 2) / math.sqrt(n1 * n2 * (n + 1) / 12)


def significant(y: np.ndarray, split: int, threshold: float) -> bool:
    left, n = y[:split], len(y)
    z = rank_sum_z(float((left == 0).sum()), float((left == 1).sum()), len(left), float((y == 0).sum()), n)
    return not math.isnan(z) and math.erfc(abs(z) / math.sqrt(2)) <= threshold


@dataclass
class Split:
    """A fitted profile over [low, high) of a range of n points."""

    profile: np.ndarray
    offsets: np.ndarray | None
    low: int
    high: int
    w: int

    def local(self, validation: str | None, threshold: float) -> bool:
        """Whether the best split validates, for a profile of this range alone."""
        return Split(self.profile, self.offsets, 0, self.high - self.low, self.w).cut(validation, threshold) is not None

    def cut(self, validation: str | None, threshold: float, strict: bool = False) -> int | None:
        """The best split if it validates.  Without strict, votes are cut at the place in the whole range, as published gates were set."""
        at = int(self.profile.argmax())
        if validation is None:
            return at
        if validation == "score_threshold":
            return at if self.profile[at] >= threshold else None
        if validation != "significance_test":
            raise ValueError(f"unknown validation {validation!r}; known: significance_test, score_threshold")
        if self.offsets is None:
            return None
        y = votes(self.offsets, at - self.low, self.w)
        return at if significant(y, at - self.low if strict else at, threshold) else None


def constraints_of(n: int, m: int, estimators: int, seed: int) -> list[tuple[int, int]]:
    """The whole range and random parts of it of at least 2 m points, longest first."""
    out, rng = [(0, n)], np.random.RandomState(seed)
    while len(out) < estimators and n > 3 * m:
        low, area = rng.choice(n, 2, replace=True)
        high = low + min(area, n - low)
        if high - low >= 2 * m:
            out.append((int(low), int(high)))
    return sorted(out, key=lambda c: c[1] - c[0], reverse=True)


def ensemble(x: np.ndarray, w: int, k: int, distance: str, score: str, radius: int, estimators: int, early: bool, validation: str | None, threshold: float, seed: int, parts: list[tuple[int, int]] | None = None) -> Split:
    """The best of the profiles of all parts, each averaged with its share of the range.

    The whole range comes first.  With early, the search ends with the first part that is no better than
    those before, or with the first best one that validates.
    """
    n, m = len(x), w * radius
    if n < 2 * m:
        raise ValueError("a series needs at least twice the smallest segment")
    parts = constraints_of(n, m, estimators, seed) if parts is None else parts

    def fits():
        """One fit after another; the neighbours of all parts but the first are found together, when the second is asked for."""
        for group in (parts[:1], parts[1:]):
            found = neighbours(x, w, k, distance, group)[0] if group else None
            for c, (low, high) in enumerate(group):
                offsets = found[low : high - w + 1, c] - low
                yield Split((profile(offsets, w, m, score) + (high - low) / n) / 2, offsets, low, high, w)

    best, top = None, -np.inf
    for fit in fits():
        better = fit.profile.max() > top
        if better:
            best, top = fit, fit.profile.max()
        if early and (not better or best.local(validation, threshold)):
            break
    whole = np.full(n - w + 1, -np.inf)
    if best is None:
        return Split(whole, None, 0, n, w)
    whole[best.low : best.high - w + 1] = best.profile
    return Split(whole, best.offsets, best.low, best.high, w)


@dataclass
class Segmentation:
    change_points: list[int] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    profile: np.ndarray = field(default_factory=lambda: np.zeros(0))
    window_size: int = 0


def segment(values, n_segments: int | str = "learn", n_estimators: int = 10, window_size: int | str = "suss", k_neighbours: int = 3, distance: str = "znormed_euclidean_distance", score: str = "roc_auc", early_stopping: bool = True, validation: str | None = "significance_test", threshold: float | str = "default", excl_radius: int = 5, random_state: int = 2357, strict: bool = False) -> Segmentation:
    """Best-first binary segmentation of one series; both halves of an accepted split are fitted anew."""
    if excl_radius <= k_neighbours:
        raise ValueError("the exclusion radius must be larger than the number of neighbours")
    x = as_series(values)
    n = len(x)
    if n < 2:
        return Segmentation([], [], np.full(n, np.nan), n)
    if isinstance(window_size, str):
        window_size = min(max(3, window_size_of(x[:, d], window_size) // 2) for d in range(x.shape[1]))
    w, m = int(window_size), int(window_size) * excl_radius
    if n < 2 * m:
        n_segments, w = 1, max(1, min(w, n // 2))
    if threshold == "default":
        threshold = 0.75 if validation == "score_threshold" else 1e-15 if x.shape[1] == 1 else 1e-30
    if n_segments == "learn":
        n_segments = n // m
    curve = np.full(n - w + 1, -np.inf)
    cps, scores, queue, order = [], [], [], 0

    def consider(low: int, high: int) -> np.ndarray | None:
        nonlocal order
        if high - low < 2 * m:
            return None
        fit = ensemble(x[low:high], w, k_neighbours, distance, score, excl_radius, n_estimators, early_stopping, validation, threshold, random_state)
        at = fit.cut(validation, threshold, strict)
        if at is not None and np.isfinite(fit.profile[at]) and not any(max(0, c - m) <= low + at < min(n, c + m) for c in [0, *cps, n]):
            heapq.heappush(queue, (-fit.profile[at], order, low, high, at, fit.profile))
            order += 1
        return fit.profile

    if n_segments > 1 and (whole := consider(0, n)) is not None:
        curve = whole.copy()
    while queue and len(cps) < n_segments - 1:
        negative, _, low, high, at, p = heapq.heappop(queue)
        curve[low : high - w + 1] = np.maximum(curve[low : high - w + 1], p)
        cps.append(low + at)
        scores.append(-negative)
        if len(cps) < n_segments - 1:
            consider(low, low + at)
            consider(low + at, high)
    by = np.argsort(cps, kind="stable")
    return Segmentation([cps[i] for i in by], [float(scores[i]) for i in by], interpolate(curve), w)


def interpolate(curve: np.ndarray) -> np.ndarray:
    """Linear between finite values, constant beyond them; all NaN if none is finite."""
    fine = np.flatnonzero(np.isfinite(curve))
    return np.interp(np.arange(len(curve)), fine, curve[fine]) if len(fine) else np.full(len(curve), np.nan)


def suss_score(x: np.ndarray, w: int) -> float:
    """Mean distance of windows' mean, deviation and range from the whole series', without the first full window."""
    v = np.lib.stride_tricks.sliding_window_view(x, w)[1:] if w < len(x) else np.zeros((0, w))
    if not len(v):
        return math.nan
    d = np.sqrt((v.mean(1) - x.mean()) ** 2 + (v.std(1) - x.std()) ** 2 + (v.max(1) - v.min(1) - (x.max() - x.min())) ** 2)
    return float((d / math.sqrt(w)).mean())


def suss(x: np.ndarray, lbound: int = 10, threshold: float = 0.89) -> int:
    n = len(x)
    if n < lbound:
        return n
    if x.min() == x.max():
        return lbound
    x = (x - x.min()) / (x.max() - x.min())
    top, bottom = suss_score(x, 1), suss_score(x, n - 1)
    if top == bottom:
        return lbound
    value = lambda w: 1 - (suss_score(x, w) - bottom) / (top - bottom)
    e = 0
    while 2**e < n and (2**e < lbound or not value(2**e) > threshold):  # ends at n, which the score doesn't reach
        e += 1
    low, end = max(lbound, 2 ** (e - 1) if e else 1), min(2**e + 1, n - 1) + 1
    while low < end:  # the first window of low .. end - 1 that reaches the threshold
        w = (low + end - 1) // 2
        if value(w) < threshold:
            low = w + 1
        else:
            end = w
    return 2 * low


def dominant_period(x: np.ndarray, lbound: int = 10, ubound: int = 1000) -> int:
    """The period of the largest Fourier coefficient with a period in range."""
    n = len(x)
    if n < 2 * lbound:
        return n
    if x.min() == x.max():
        return lbound
    size = np.abs(np.fft.rfft(x))[1:]
    period = (1 / np.fft.rfftfreq(n)[1:]).astype(np.int64)
    fine = (period >= lbound) & (period < ubound)
    return int(period[fine][size[fine].argmax()]) if fine.any() else lbound


def highest_autocorrelation(x: np.ndarray, lbound: int = 10, ubound: int = 1000) -> int:
    """The lag of the highest local peak of the autocorrelation in range."""
    n = len(x)
    if n < lbound:
        return n
    c = x - x.mean()
    f = np.fft.rfft(c, 2 * n)
    acf = np.fft.irfft(f * np.conj(f))[: n // 2 + 1]
    if acf[0] <= 1e-12:
        return lbound
    acf = acf / acf[0]
    rise, i, peaks = np.diff(acf), 1, []
    while i < len(acf) - 1:
        j = i
        while j < len(acf) - 1 and rise[j] == 0:
            j += 1
        if rise[i - 1] > 0 and j < len(acf) - 1 and rise[j] < 0:
            peaks.append((i + j) // 2)
        i = j + 1
    peaks = [p for p in peaks if lbound <= p < ubound]
    return max(peaks, key=lambda p: (acf[p], -p)) if peaks else lbound


WINDOW_METHODS = {"suss": suss, "fft": dominant_period, "acf": highest_autocorrelation}


def window_size_of(x: np.ndarray, method: str = "suss") -> int:
    return int(pick(WINDOW_METHODS, method, "window size method")(np.asarray(x, dtype=np.float64)))
