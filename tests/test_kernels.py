import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseg.functions import classify, kernels
from sparkseg.operators import metrics
from sparkseg.streaming import online
from sparkseg.streaming.online import OnlineNeighbours, OnlineSegmentation


def planted(seed=0):
    rng, t = np.random.default_rng(seed), np.arange(2000)
    return np.concatenate([np.sin(t[:700] * 2 * np.pi / 25), np.sign(np.sin(t[:700] * 2 * np.pi / 40)), np.abs(np.sin(t[:600] * 2 * np.pi / 60))]) + rng.normal(0, 0.05, 2000)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from(["roc_auc", "f1", "stream"]))
def test_profile_is_the_naive_one(seed, k, score):
    rng = np.random.default_rng(seed)
    l, w = int(rng.integers(30, 80)), int(rng.integers(2, 6))
    m = int(rng.integers(w, 12))
    offsets = rng.integers(0, l, (l, k))
    want = np.full(l, -np.inf)
    for s in range(m, l - m if score == "stream" else min(l, l - m + w)):
        truth, vote = np.arange(l) >= s, (offsets >= s).sum(1) > k / 2
        if score == "stream":
            keep = np.ones(l, dtype=bool)
            keep[s : s + w] = False
            truth, vote = truth[keep], vote[keep]
        else:
            vote[max(0, s - w) : s] = True
        if score == "roc_auc":
            if vote.any() and not vote.all():
                want[s] = (1 + truth[vote].mean() - truth[~vote].mean()) / 2
        else:
            hits = [((truth == c) & (vote == c)).sum() for c in (False, True)]
            if all(hits):
                want[s] = np.mean([2 * h / ((truth == c).sum() + (vote == c).sum()) for h, c in zip(hits, (False, True), strict=True)])
    got = kernels.stream_profile(offsets, w, m) if score == "stream" else kernels.profile(offsets, w, m, score)
    assert np.allclose(got, want)


@pytest.mark.parametrize("distance", kernels.DISTANCES)
@pytest.mark.parametrize("channels", [1, 3])
def test_neighbours_against_brute_force(distance, channels):
    rng = np.random.default_rng(5)
    x, w, k = rng.normal(size=(90, channels)), 8, 3
    l = 90 - w + 1
    offsets, dists = kernels.neighbours(x, w, k, distance, [(0, 90), (20, 70)])
    for i in range(l):
        total = np.zeros(l)
        for c in range(channels):
            v = np.array([x[j : j + w, c] for j in range(l)])
            if distance.startswith("znormed"):
                z = (v - v.mean(1, keepdims=True)) / v.std(1, keepdims=True)
                d = ((z - z[i]) ** 2).sum(1)
            else:
                d = ((v - v[i]) ** 2).sum(1)
                if distance.startswith("cinvariant"):
                    steps = np.concatenate([[0], np.diff(x[:, c])]) ** 2
                    ce = np.array([steps[j : j + w].sum() for j in range(l)]) + 1e-5
                    d = d * np.maximum(ce, ce[i]) / np.minimum(ce, ce[i])
            d[np.abs(np.arange(l) - i) <= w // 2] = d.max()
            total += (d - d.mean()) / d.std() / channels
        assert offsets[i, 0].tolist() == np.argsort(total, kind="stable")[:k].tolist()
        assert np.allclose(dists[i, 0], np.sort(total)[:k])
        if 20 <= i < 70:
            assert offsets[i, 1].tolist() == (20 + np.argsort(total[20 : 70 - w + 1], kind="stable")[:k]).tolist()


def test_ranking_order():
    assert kernels.smallest(np.array([3, 2, 1, 4, 5]), 3).tolist() == [[2, 1, 0]]
    assert kernels.smallest(np.array([1, 1, 0, 1]), 3).tolist() == [[2, 0, 1]]


def test_rank_sum_has_average_ranks():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 60)
    ranks = np.array([(y < v).sum() + ((y == v).sum() + 1) / 2 for v in y])
    for s in (10, 30, 50):
        want = (ranks[:s].sum() - s * 61 / 2) / math.sqrt(s * (60 - s) * 61 / 12)
        assert math.isclose(kernels.rank_sum_z((y[:s] == 0).sum(), (y[:s] == 1).sum(), s, (y == 0).sum(), 60), want, abs_tol=1e-9)


def test_segmentation_finds_planted_changes():
    found = kernels.segment(planted())
    assert len(found.change_points) == 2 and all(abs(a - b) < 40 for a, b in zip(found.change_points, (700, 1400), strict=True))
    assert np.isfinite(found.profile).all() and all(s > 0.75 for s in found.scores)
    stacked = np.stack([planted(), planted(1)], axis=1)
    assert len(kernels.segment(stacked).change_points) == 2


@pytest.mark.parametrize("n_segments", [1, "learn"])
@pytest.mark.parametrize("window_size", [10, "suss", "fft", "acf"])
@pytest.mark.parametrize("validation", [None, "significance_test", "score_threshold"])
def test_parameters(n_segments, window_size, validation):
    found = kernels.segment(planted()[::2], n_segments=n_segments, window_size=window_size, validation=validation)
    assert n_segments != 1 or found.change_points == []
    assert sorted(found.change_points) == found.change_points


def test_edges():
    for x in (np.zeros(0), np.zeros(1), np.zeros(1000)):
        assert kernels.segment(x).change_points == []
    for method in kernels.WINDOW_METHODS:
        assert kernels.window_size_of(np.zeros(1), method) == 1 and kernels.window_size_of(np.zeros(1000), method) == 10
    for bad in (lambda: kernels.segment(np.zeros(50), excl_radius=3), lambda: kernels.window_size_of(np.zeros(50), "x"), lambda: kernels.neighbours(np.zeros(20), 5, 3, "x"), lambda: kernels.as_series([[[1]]]), lambda: kernels.as_series([np.nan]), lambda: kernels.profile(np.zeros((9, 1), int), 2, 2, "x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        kernels.as_series(["a"])
    assert kernels.interpolate(np.array([-np.inf, 1, -np.inf, 3, -np.inf])).tolist() == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("classifier", ["rocket", "quant"])
def test_states(classifier):
    t = np.arange(600)
    x = np.concatenate([np.sin(t * 2 * np.pi / 25), np.sign(np.sin(t * 2 * np.pi / 40)), np.sin(t * 2 * np.pi / 25)]) + np.random.default_rng(0).normal(0, 0.05, 1800)
    found = classify.detect_states(x, [600, 1200], classifier=classifier, sample_size=200)
    assert found.segment_states in ([2, 1, 2], [1, 2, 1]) and found.change_points == [600, 1200] and found.score > 0.9
    with pytest.raises(ValueError):
        classify.detect_states(x, [600], classifier="x")
    assert classify.detect_states(x, []).segment_states == [1]


@pytest.mark.parametrize("classifier", sorted(set(classify.CLASSIFIERS) - {"dummy"}))
def test_window_classifiers(classifier):
    t, rng = np.arange(600), np.random.default_rng(1)
    x = np.concatenate([np.sin(t / 4), np.sign(np.sin(t / 7)), np.sin(t / 4) + 0.5 * np.sin(t / 1.7)]) + rng.normal(0, 0.1, 1800)
    windows, labels = classify.windows_of(kernels.as_series(x), np.repeat([0, 1, 2], 600), 30)
    truth, found = classify.cross_validated(windows, labels, classifier, 3, 1)
    assert classify.macro_f1(truth, found) > 0.9
    assert (classify.cross_validated(windows, labels, classifier, 3, 1)[1] == found).all()
    two = np.concatenate([windows, rng.normal(size=windows.shape)], axis=1)[::4]
    for odd in (two, two[:, :, :1], two[:, :, :2], two[:, :, :5], two * 0):  # two channels, windows below a kernel's length, constant ones
        assert set(classify.cross_validated(odd, labels[::4], classifier, 2, 1)[1]) <= {0, 1, 2}


def test_metric_examples():
    assert metrics.true_positives({1, 10, 20, 23}, {3, 8, 20}) == [1, 10, 20]
    assert metrics.true_positives({1, 10, 20, 23}, {1, 3, 5, 8, 20}) == [1, 10, 20]
    assert metrics.true_positives(set(), {1, 2}) == [] == metrics.true_positives({1, 2}, set())
    assert metrics.adjusted_mutual_information([(1, 1, 5), (2, 2, 5)]) == pytest.approx(1.0)
    assert abs(metrics.adjusted_mutual_information([(1, 1, 50), (1, 2, 50), (2, 1, 50), (2, 2, 50)])) < 0.02
    assert metrics.f_of([[10, 20]], [10, 20]) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("distance", OnlineNeighbours.DISTANCES)
def test_online_neighbours_while_the_buffer_fills(distance):
    """Each inserted window's first ranks are the nearest among the windows seen when it was inserted, or offered later."""
    rng = np.random.default_rng(4)
    x, w, k, n = rng.normal(size=80), 6, 3, 100
    stream = OnlineNeighbours(n, w, k, distance)
    for v in x:
        stream.update(v)
    assert stream.filled == 80 - (w + w // 2 + k) + 1
    views = np.array([x[i : i + w] for i in range(80 - w + 1)])
    if distance.startswith("znormed"):
        views = (views - views.mean(1, keepdims=True)) / views.std(1, keepdims=True)
    shift = stream.seen - n
    steps = np.concatenate([[0.0], np.diff(x) ** 2])
    ce = np.array([steps[i : i + w].sum() for i in range(80 - w + 1)]) + 1e-5
    for i in range(stream.filled):
        row = i % stream.windows
        for d, j in zip(stream.dists[row], stream.places[row], strict=True):
            if np.isfinite(d) and 0 <= j < len(views) and abs(i - j) > w // 2:
                real = ((views[i] - views[j]) ** 2).sum()
                if distance.startswith("cinvariant"):
                    real *= max(ce[i], ce[j]) / min(ce[i], ce[j])
                assert math.isclose(d, real, rel_tol=1e-6, abs_tol=1e-6)
    assert shift == -20


def test_online_segmentation_and_its_state():
    t = np.arange(1500)
    x = np.concatenate([np.sin(t * 2 * np.pi / 25), np.sign(np.sin(t * 2 * np.pi / 40))]) + np.random.default_rng(0).normal(0, 0.05, 3000)
    one, two = OnlineSegmentation(1000), OnlineSegmentation(1000)
    for i, v in enumerate(x):
        one.update(v)
        two.update(v)
        if i % 611 == 0:
            two = OnlineSegmentation.load(two.dump())
    assert len(one.change_points) == 1 and abs(one.change_points[0] - 1500) < 60
    assert (one.change_points, one.scores, one.last_cp) == (two.change_points, two.scores, two.last_cp)


def naive_gain(y, p):
    """Mean over classes of 2PR / (P + R), less that of guesses with precision and recall of a class both its share."""
    f1 = lambda y, p: np.mean([(lambda a, b: 2 * a * b / (a + b) if a + b else 0.0)(*(((y == c) & (p == c)).sum() / max(1, (v == c).sum()) for v in (p, y))) for c in sorted(set(y) | set(p))])
    return f1(y, p) - np.mean([(y == c).mean() for c in set(y)])


def naive_merge(labels, y, p):
    labels, y, p, refused = list(labels), y.copy(), p.copy(), set()
    while len(set(labels)) > 1:
        table = {a: {b: int(((y == a) & (p == b)).sum()) for b in set(labels)} for a in set(labels)}
        worst = []
        for a in sorted(set(labels)):
            rest = [(n, -b) for b, n in table[a].items() if b != a]
            n, b = max(rest)
            worst.append((n / max(1, (y == a).sum()), a, -b))
        for _, a, b in sorted(worst, key=lambda r: (r[0], r[1]), reverse=True):
            rows = frozenset(np.flatnonzero(np.isin(y, [a, b])).tolist())
            if rows in refused:
                continue
            merged = [np.where(v == b, a, v) for v in (y, p)]
            if naive_gain(y, p) > naive_gain(*merged):
                refused.add(rows)
                continue
            labels = [max(a, b) if v in (a, b) else v for v in labels]
            y, p = (np.where(np.isin(v, [a, b]), max(a, b), v) for v in (y, p))
            break
        else:
            break
    return [sorted(set(labels)).index(v) + 1 for v in labels]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6))
def test_merging_of_states_is_the_naive_one(seed, k):
    rng = np.random.default_rng(seed)
    y = np.concatenate([np.arange(k), rng.choice(k, 120, p=rng.dirichlet(np.ones(k)))])
    p = np.where(rng.random(len(y)) < rng.random(), y, rng.integers(0, k, len(y)))
    labels = rng.integers(0, k, 9)
    labels = np.concatenate([np.arange(k), labels])
    assert math.isclose(classify.gain(y, p), naive_gain(y, p), abs_tol=1e-12)
    assert classify.merge_states(labels, y, p)[0].tolist() == naive_merge(labels, y, p)


def test_gain_of_unequal_shares():
    y = np.repeat([0, 1], [9, 1])
    assert classify.gain(y, y) == pytest.approx(0.5)


def test_merging_keeps_and_joins_planted_states():
    """Labels 0 and 2 are one state cut in two, as a classifier would confuse them."""
    y = np.repeat([0, 1, 2], [40, 50, 30])
    p = np.where(np.arange(120) % 2 == 0, np.where(y == 0, 2, np.where(y == 2, 0, y)), y)
    assert classify.merge_states(np.array([0, 1, 2, 1]), y, p)[0].tolist() == [2, 1, 2, 1]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.booleans(), st.integers(1, 600))
def test_rolling_dots(seed, whole, w):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, 700).astype(float) if whole else rng.normal(size=700)
    v = np.lib.stride_tricks.sliding_window_view(x, w)
    first = int(rng.integers(0, len(v)))
    stop = min(len(v), first + 60)
    found, want = kernels.rolling_dots(x, w, first, stop), v[first:stop] @ v.T
    assert (found == want).all() if whole else np.allclose(found, want, atol=1e-9)
    assert np.allclose(kernels.sliding_dot(x[:w], x), v @ x[:w])


def test_neighbours_by_rows():
    x = np.random.default_rng(3).normal(size=(300, 2))
    whole = kernels.neighbours(x, 20, 3, constraints=[(0, 300), (50, 250)])
    parts = [kernels.neighbours(x, 20, 3, constraints=[(0, 300), (50, 250)], rows=r) for r in ((0, 100), (100, 101), (101, 281))]
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all() and np.allclose(np.concatenate([p[1] for p in parts]), whole[1])


def test_online_profile_holds_the_best_scores_until_they_leave_the_buffer(monkeypatch):
    t = np.arange(700)
    x = np.concatenate([np.sin(t * 2 * np.pi / 25), np.sign(np.sin(t * 2 * np.pi / 40))]) + np.random.default_rng(0).normal(0, 0.05, 1400)
    model = OnlineSegmentation(600, window_size=20)
    for v in x:
        if model.update(v):
            break
    held = model.profile()
    assert len(held) == 581 and held.max() == model.scores[-1]
    place = int(held.argmax())
    assert abs(place + model.seen - 600 + 20 - model.change_points[-1]) <= 20 + 20 // 2 + 3
    for v in x[:place]:
        model.update(v)
    assert model.profile()[0] == held.max()
    model.update(0.0)
    assert model.profile()[0] != held.max() or np.isinf(held[place + 1])
    old = OnlineSegmentation(50).dump()
    monkeypatch.setattr(online, "FORMAT", 9)
    with pytest.raises(ValueError):
        OnlineSegmentation.load(old)


@pytest.mark.parametrize("distance", OnlineNeighbours.DISTANCES)
def test_online_dot_products_do_not_drift(distance):
    x = np.random.default_rng(6).normal(size=900).cumsum()
    stream = OnlineNeighbours(200, 15, 3, distance)
    for i, v in enumerate(x):
        stream.update(v)
        if i % 97 == 0 and len(stream.dots):
            values = x[max(0, i + 1 - 200) : i + 1]
            view = np.lib.stride_tricks.sliding_window_view(values, 15)
            q = stream.insert - max(0, 200 - i - 1)
            assert np.allclose(stream.dots, view @ view[q], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("distance", OnlineNeighbours.DISTANCES)
@pytest.mark.parametrize("change", [0, 7])
def test_online_neighbours_step_by_step(distance, change):
    """Every table entry after every point, against distances of whole windows and lists that take offers one by one."""
    n, w, k = 60, 6, 3
    r, windows = w // 2, n - w + 1
    x = np.random.default_rng(4).normal(size=150)
    stream, insert = OnlineNeighbours(n, w, k, distance), windows - w // 2 - k - 1
    rows: dict[int, list[tuple[float, int]]] = {}
    filled = 0

    def far(a, b):
        u, v = x[a : a + w], x[b : b + w]
        if distance.startswith("znormed"):
            u, v = ((z - z.mean()) / (z.std() if z.std() >= 1e-3 else 1) for z in (u, v))
        d = ((u - v) ** 2).sum()
        if distance.startswith("cinvariant"):
            ce = [sum((x[j] - x[j - 1]) ** 2 for j in range(max(1, i), i + w)) + 1e-5 for i in (a, b)]
            d *= max(ce) / min(ce)
        return d

    for seen in range(1, len(x) + 1):
        stream.update(x[seen - 1], change if seen > 90 else 0)
        shift, bound = seen - n, insert - filled + 1 + (change if seen > 90 else 0)
        if min(seen, windows) < w + r + k:
            continue
        first = max(bound - 1, -shift, 0)
        d = {a: far(a + shift, insert + shift) for a in range(first, windows)}
        top = np.inf if first > 0 else max(d.values())
        d |= {a: top for a in range(max(0, insert - r), min(insert + r, windows))}
        near = sorted(((d.get(a, np.inf), a) for a in range(bound, windows)))[:k]
        rows[insert + shift] = [(v, a + shift) for v, a in near]
        for a in range(bound, insert):
            held = rows.setdefault(a + shift, [(np.inf, -1)] * k)
            at = next((i for i in range(k - 1) if d.get(a, np.inf) < held[i][0]), None)
            if at is not None and insert + shift not in [p for _, p in held]:
                rows[a + shift] = held[:at] + [(d[a], insert + shift)] + held[at : k - 1]
        filled = min(filled + 1, insert)
        for a in range(max(0, bound - 1), insert + 1):
            row = (a + shift) % windows
            if a + shift in rows:
                assert [p for p, v in zip(stream.places[row].tolist(), stream.dists[row], strict=True) if np.isfinite(v)] == [p for v, p in rows[a + shift] if np.isfinite(v)]
                assert np.allclose(stream.dists[row], [v for v, _ in rows[a + shift]], rtol=1e-6, atol=1e-8)


def test_capped_and_cross_validated():
    x, y = np.arange(300).reshape(300, 1, 1).astype(float), np.repeat([0, 1, 2], [200, 90, 10])
    some, of = classify.capped(x, y, 50, 7)
    assert np.unique(of, return_counts=True)[1].tolist() == [50, 50, 10] and len(np.unique(some)) == 110
    assert (y[some.ravel().astype(int)] == of).all() and not (np.diff(some.ravel()) > 0).all()
    assert (classify.capped(x, y, 50, 7)[0] == some).all()

    class Told:
        """Remembers what it was fitted on, and answers what it was not told."""

        def __init__(self, seed):
            pass

        def fit(self, x, y):
            self.seen = set(x.ravel().tolist())
            return self

        def predict(self, x):
            return np.array([v in self.seen for v in x.ravel().tolist()], dtype=int)

    classify.CLASSIFIERS["told"] = Told
    try:
        truth, found = classify.cross_validated(some, of, "told", 5, 1)
        assert (truth == of).all() and not found.any()
        assert (classify.cross_validated(some[:1], of[:1], "told", 5, 1)[1] == of[:1]).all()
    finally:
        del classify.CLASSIFIERS["told"]


def naive_segment(x, w, k, distance, score, radius, parts_of, early, validation, threshold, most):
    """Best-first segmentation by plain loops over windows, splits and parts."""
    n, m = len(x), w * radius

    def knn(y):
        l, out = len(y) - w + 1, []
        for i in range(l):
            row = []
            for j in range(l):
                u, v = y[i : i + w], y[j : j + w]
                if distance.startswith("znormed"):
                    u, v = ((z - z.mean()) / (z.std() if z.std() >= 1e-3 else 1) for z in (u, v))
                row.append(((u - v) ** 2).sum())
            row = np.array(row)
            row[max(0, i - w // 2) : i + w // 2 + 1] = row.max()
            out.append(row)
        return np.array(out)

    def curve(d, low, high):
        rows, l = range(low, high - w + 1), high - low - w + 1
        near = np.array([np.argsort(np.round(d[i, low : high - w + 1], 9), kind="stable")[:k] for i in rows])
        out, votes = np.full(l, -np.inf), {}
        for s in range(m, min(l, l - m + w)):
            truth, vote = np.arange(l) >= s, (near >= s).sum(1) * 2 > k
            votes[s] = vote | ((np.arange(l) >= s - w) & (np.arange(l) < s))
            hit = [(truth == c) & (votes[s] == c) for c in (False, True)]
            if score == "f1":
                if all(h.any() for h in hit):
                    out[s] = np.mean([2 * h.sum() / ((truth == c).sum() + (votes[s] == c).sum()) for h, c in zip(hit, (False, True), strict=True)])
            elif votes[s].any() and not votes[s].all():
                out[s] = (1 + truth[votes[s]].mean() - truth[~votes[s]].mean()) / 2
        return out, votes

    def valid(profile, votes, at, cut):
        if validation is None:
            return True
        if validation == "score_threshold":
            return profile.max() >= threshold
        y = votes[at].astype(int)
        ranks = np.array([(y < v).sum() + ((y == v).sum() + 1) / 2 for v in y])
        a, b = cut, len(y) - cut
        if a <= 0 or b <= 0:
            return False
        z = (ranks[:a].sum() - a * (len(y) + 1) / 2) / math.sqrt(a * b * (len(y) + 1) / 12)
        return math.erfc(abs(z) / math.sqrt(2)) <= threshold

    def best_of(low, high):
        y = x[low:high]
        d, best = knn(y), None
        for a, b in parts_of(len(y), m):
            p, votes = curve(d, a, b)
            p = (p + (b - a) / len(y)) / 2
            better = best is None and np.isfinite(p.max()) or best is not None and p.max() > best[0].max()
            if better:
                best = p, votes, a
            if early and (not better or valid(best[0], best[1], int(best[0].argmax()), int(best[0].argmax()))):
                break
        if best is None:
            return None
        p, votes, a = best
        at = int(p.argmax())
        return (p[at], low + a + at) if valid(p, votes, at, a + at) else None

    cps, queue = [], []

    def consider(low, high):
        found = best_of(low, high) if high - low >= 2 * m else None
        if found and all(not max(0, c - m) <= found[1] < min(n, c + m) for c in [0, *cps, n]):
            queue.append((-found[0], len(queue) + len(cps) * 100, low, high, found[1]))

    consider(0, n)
    while queue and len(cps) < most - 1:
        queue.sort()
        top = queue.pop(0)
        cps.append(top[4])
        if len(cps) < most - 1:
            consider(top[2], top[4])
            consider(top[4], top[3])
    return sorted(cps)


@pytest.mark.parametrize("validation", [None, "score_threshold", "significance_test"])
@pytest.mark.parametrize("score", ["roc_auc", "f1"])
@pytest.mark.parametrize("early", [True, False])
def test_segmentation_is_the_naive_one(validation, score, early):
    """Parts, early end, validation, distance to other change points, order and number of segments, on short whole-number series."""
    threshold = {"score_threshold": 0.7, "significance_test": 1e-4}.get(validation, 0)
    found = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        pieces = [rng.integers(-3, 4, int(rng.integers(40, 70))) + shift for shift in rng.permutation([0, 9, -7])]
        x = np.concatenate(pieces).astype(float)
        settings = {"window_size": 5, "k_neighbours": 3, "distance": "euclidean_distance", "score": score, "early_stopping": early, "validation": validation, "threshold": threshold, "excl_radius": 4, "n_estimators": 4, "random_state": 11}
        got = kernels.segment(x, **settings).change_points
        want = naive_segment(x, 5, 3, "euclidean_distance", score, 4, lambda n, m: kernels.constraints_of(n, m, 4, 11), early, validation, threshold, len(x) // 20)
        assert got == want
        found += len(got)
    assert found > 3


@pytest.mark.parametrize("classifier", ["quant", "freshprince", "dummy"])
@pytest.mark.parametrize("n, cuts", [(64, [32]), (90, [30, 61]), (61, []), (600, [100])])
def test_many_series_are_classified_as_each_by_itself(classifier, n, cuts):
    if classifier == "freshprince" and n == 600:
        pytest.skip("more windows than are grown together go the plain way, which is slow")
    rng = np.random.default_rng(n)
    x = rng.normal(size=(3, n, 2 if n == 90 else 1)).round(1 if n == 61 else 9) + (np.arange(n) >= n // 2)[None, :, None]
    y, found = classify.predicted_many(x, cuts, 8, classifier, 5, 1000, 3)
    for one, p in zip(x, found, strict=True):
        windows = classify.capped(*classify.windows_of(one, classify.dense_states(cuts, range(len(cuts) + 1), n), 8), 1000, 3)
        truth, want = classify.cross_validated(*windows, classifier, 5, 3)
        assert truth.tolist() == y.tolist() and want.tolist() == p.tolist()
    for one, states in zip(x, classify.detect_states_many(x, cuts, 8, classifier, random_state=3), strict=True):
        want = classify.detect_states(one, cuts, 8, classifier, random_state=3)
        assert states == (want.change_points, want.segment_states)


def test_features_of_many_series_are_made_at_once(monkeypatch):
    """Once for all series and folds: a call a series and fold was most of the time."""
    calls = []
    quant, forest = classify.Quantiles.features, classify.SummaryForest.features
    monkeypatch.setattr(classify.Quantiles, "features", lambda *a: calls.append(1) or quant(*a))
    monkeypatch.setattr(classify.SummaryForest, "features", staticmethod(lambda x: calls.append(1) or forest(x)))
    x = np.random.default_rng(0).normal(size=(40, 64, 1))
    for classifier in ("quant", "freshprince"):
        classify.predicted_many(x, [32], 8, classifier, 5, 1000, 3)
    assert len(calls) == 2


def test_online_state_is_plain_arrays_behind_a_head():
    """No archive of files in each state: packing and reading one took longer than 15 points of the stream."""
    import io

    model = OnlineSegmentation(n_timepoints=48, window_size=5)
    for v in np.random.default_rng(0).normal(size=100):
        model.update(v)
    blob = model.dump()
    arrays = sum(v.nbytes for v in model.stream.arrays().values()) + model._best.nbytes
    assert arrays < len(blob) < arrays + 1200 and OnlineSegmentation.load(blob).dump() == blob
    old = io.BytesIO()
    np.savez(old, head=np.frombuffer(b'{"format": 1}', np.uint8))
    with pytest.raises(ValueError):
        OnlineSegmentation.load(old.getvalue())


@pytest.mark.parametrize("n, w, k", [(64, 5, 3), (300, 20, 3), (400, 9, 1), (130, 8, 2)])
def test_series_without_a_change_take_the_steps_of_one(n, w, k):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 3, (3, n)).astype(float) if n == 130 else rng.normal(size=(3, n))
    each = [online.OnlineNeighbours(n, w, k) for _ in x]
    for seen, offsets in online._quiet_offsets(x, w, k):
        for i, one in enumerate(each):
            one.update(x[i, seen - 1])
            assert offsets is None or offsets[i].tolist() == one.offsets().tolist()


def test_replay_of_many_series_is_the_one_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    quiet, t = rng.normal(size=(30, 600)), np.arange(300)
    loud = np.concatenate([np.sin(t / 4), np.sign(np.sin(t / 7))]) + rng.normal(0, 0.05, (2, 600))
    x, want, made = np.concatenate([quiet, loud]), [], []
    for v in x[[0, 30, 31]]:
        model = OnlineSegmentation(n_timepoints=600, window_size=20)
        want.append((sum(model.update(a) for a in v), model.last_cp))
    update = OnlineSegmentation.update
    monkeypatch.setattr(OnlineSegmentation, "update", lambda self, v: made.append(1) or update(self, v))
    found = online.replayed(x, n_timepoints=600, window_size=20)
    assert [found[0], *found[30:]] == want and want[1][0] == 1 and found[:30] == [(0, 0)] * 30
    assert len(made) == 2 * 600  # point by point only where there is a change
