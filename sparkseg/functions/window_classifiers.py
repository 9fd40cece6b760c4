"""More classifiers of windows (count, channels, w), in NumPy, after the published descriptions of their methods.

They are smaller than the libraries' forms (fewer kernels, trees and layers), and say so in their parameters.
"""

from __future__ import annotations

import numpy as np

from .ridge import Ridge


def znormed(x: np.ndarray) -> np.ndarray:
    std = x.std(2, keepdims=True)
    return (x - x.mean(2, keepdims=True)) / np.where(std < 1e-9, 1, std)


def dilated(x: np.ndarray, length: int, dilation: int) -> np.ndarray:
    """Views (..., places, length) of every run of `length` values that lie `dilation` apart."""
    reach = (length - 1) * dilation + 1
    return np.lib.stride_tricks.sliding_window_view(x, reach, axis=-1)[..., ::dilation]


def _dilation(rng: np.random.RandomState, w: int, length: int) -> int:
    return int(2 ** rng.uniform(0, np.log2(max(1, (w - 1) / max(1, length - 1)))))


class CompetingKernels(Ridge):
    """Groups of dilated kernels compete at each place: how often (and how strongly) each wins, with four poolings of single kernels."""

    def __init__(self, seed: int, groups: int = 24, per_group: int = 8, pooled: int = 150):
        self.seed, self.groups, self.per_group, self.pooled = seed, groups, per_group, pooled

    def _draw(self, channels: int, w: int, n: int) -> list:
        rng = np.random.RandomState(self.seed + n)
        out = []
        for _ in range(n):
            length = min(9, w)
            out.append((rng.normal(size=(self.per_group, length)), _dilation(rng, w, length), rng.randint(channels), rng.uniform(-1, 1)))
        return out

    def features(self, x, fitting):
        x = znormed(x)
        if fitting:
            self.table = self._draw(x.shape[1], x.shape[2], self.groups), self._draw(x.shape[1], x.shape[2], self.pooled)
        out = []
        for weights, dilation, channel, _ in self.table[0]:
            answer = dilated(x[:, channel], weights.shape[1], dilation) @ (weights - weights.mean(1, keepdims=True)).T
            best, least = answer.argmax(2), answer.argmin(2)
            top = answer.max(2)
            for k in range(self.per_group):
                won = best == k
                out += [np.sqrt((won * np.maximum(top, 0)).sum(1)), np.sqrt((least == k).sum(1))]
        for weights, dilation, channel, bias in self.table[1]:
            one = weights[0] - weights[0].mean()
            answer = dilated(x[:, channel], len(one), dilation) @ one + bias
            up, places = answer > 0, np.arange(answer.shape[1])
            n = np.maximum(1, up.sum(1))
            since = places - np.maximum.accumulate(np.where(up, -1, places), axis=1)
            out += [up.mean(1), (answer * up).sum(1) / n, (up * places).sum(1) / n, since.max(1)]
        return np.stack(out, axis=1)


class DilatedShapelets(Ridge):
    """Random dilated pieces of training windows: the nearest distance, its place, and how often a distance is small."""

    def __init__(self, seed: int, shapelets: int = 300):
        self.seed, self.shapelets = seed, shapelets

    @staticmethod
    def _distances(runs: np.ndarray, piece: np.ndarray, normed: bool) -> np.ndarray:
        if normed:
            std = runs.std(-1, keepdims=True)
            runs = (runs - runs.mean(-1, keepdims=True)) / np.where(std < 1e-9, 1, std)
        return np.abs(runs - piece).sum(-1)

    def features(self, x, fitting):
        count, channels, w = x.shape
        if fitting:
            rng = np.random.RandomState(self.seed)
            self.table = []
            for _ in range(self.shapelets):
                length = min(int(rng.choice([7, 9, 11])), w)
                dilation, channel, normed = _dilation(rng, w, length), rng.randint(channels), bool(rng.randint(2))
                runs = dilated(x[rng.randint(count), channel], length, dilation)
                piece = runs[rng.randint(len(runs))].copy()
                if normed:
                    piece = (piece - piece.mean()) / (piece.std() if piece.std() >= 1e-9 else 1)
                sample = self._distances(dilated(x[rng.choice(count, min(count, 10), replace=False), channel], length, dilation), piece, normed)
                self.table.append((piece, dilation, channel, normed, np.quantile(sample, rng.uniform(0.05, 0.1))))
        out = []
        for piece, dilation, channel, normed, small in self.table:
            d = self._distances(dilated(x[:, channel], len(piece), dilation), piece, normed)
            out += [d.min(1), d.argmin(1), (d <= small).sum(1)]
        return np.stack(out, axis=1)


class SymbolicWords(Ridge):
    """Words of quantised Fourier coefficients of dilated runs, in several random configurations; their counts are the features."""

    def __init__(self, seed: int, configurations: int = 12, letters: int = 4, symbols: int = 2):
        self.seed, self.configurations, self.letters, self.symbols = seed, configurations, letters, symbols

    def features(self, x, fitting):
        count, channels, w = x.shape
        if fitting:
            rng, self.table = np.random.RandomState(self.seed), []
            for _ in range(self.configurations):
                length = int(rng.randint(min(4, w), max(min(4, w), min(w, 24)) + 1))
                self.table.append([length, _dilation(rng, w, length), rng.randint(channels), bool(rng.randint(2)), None, None])
        out = []
        for row in self.table:
            length, dilation, channel, steps, picked, edges = row
            v = x[:, channel]
            v = np.diff(v, axis=1, prepend=v[:, :1]) if steps else v
            runs = dilated(v, length, dilation)
            scale = runs.std(-1, keepdims=True)
            turned = np.fft.rfft((runs - runs.mean(-1, keepdims=True)) / np.where(scale < 1e-9, 1, scale), axis=-1)[..., 1:]
            parts = np.concatenate([turned.real, turned.imag], axis=-1) if turned.shape[-1] else np.zeros((*runs.shape[:2], 1))
            if fitting:  # the coefficients that vary most, cut at equal shares
                picked = row[4] = np.argsort(-parts.reshape(-1, parts.shape[-1]).var(0), kind="stable")[: self.letters]
                edges = row[5] = np.quantile(parts[..., picked].reshape(-1, len(picked)), np.arange(1, self.symbols) / self.symbols, axis=0)
            word = np.zeros(parts.shape[:2], dtype=np.int64)
            for j, c in enumerate(picked):
                word = word * self.symbols + np.searchsorted(edges[:, j], parts[..., c])
            kinds = self.symbols ** len(picked)
            counts = np.bincount((np.arange(count)[:, None] * kinds + word).ravel(), minlength=count * kinds)
            out.append(np.sqrt(counts.reshape(count, kinds)))
        return np.concatenate(out, axis=1)


def _grow(f: np.ndarray, y: np.ndarray, classes: int, rng: np.random.RandomState):
    """A tree: a class, or (feature, threshold, left, right) of the least Gini impurity among a random share of features."""
    have = np.bincount(y, minlength=classes)
    if have.max() == len(y) or len(y) < 2:
        return int(have.argmax())
    best = None
    for c in rng.choice(f.shape[1], _tried(f.shape[1]), replace=False):
        order = np.argsort(f[:, c], kind="stable")
        v, left = f[order, c], np.cumsum(np.eye(classes)[y[order]], axis=0)[:-1]
        n = np.arange(1, len(y))
        impurity = len(y) - (left**2).sum(1) / n - ((have - left) ** 2).sum(1) / (len(y) - n)
        impurity[v[1:] == v[:-1]] = np.inf
        at = int(impurity.argmin())
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0]):
            best = impurity[at], int(c), (v[at] + v[at + 1]) / 2
    if best is None:
        return int(have.argmax())
    low = f[:, best[1]] <= best[2]
    if low.all() or not low.any():
        return int(have.argmax())
    return best[1], best[2], _grow(f[low], y[low], classes, rng), _grow(f[~low], y[~low], classes, rng)


def _leaves(tree, f: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if not len(rows):
        return
    if isinstance(tree, int):
        out[rows] = tree
        return
    low = f[rows, tree[0]] <= tree[1]
    _leaves(tree[2], f, rows[low], out)
    _leaves(tree[3], f, rows[~low], out)


def _tried(features: int) -> int:
    return max(1, int(np.sqrt(features) * 2) if features > 4 else features)


class _Draws:
    """What the forest's generator draws from every state it is met in: all forests begin with the same seed, so those of many series meet the same states."""

    def __init__(self, seed: int, n: int, features: int, parts: int):
        self.rng, self.n, self.parts = np.random.RandomState(seed), n, parts
        self.states, self.ids, self.blocks = [], {}, {}
        room = 1024
        self.after_tree, self.order, self.some, self.rows = np.full(room, -1), np.zeros((room, features), np.int32), np.zeros((room, parts, max(2, n * 3 // 4)), np.int32), np.zeros((room, n), np.int32)
        self.after_node, self.tried = np.full(room, -1), np.zeros((room, _tried(features)), np.int32)
        self._id()

    _TABLES = ("after_tree", "order", "some", "rows", "after_node", "tried")

    def _id(self) -> int:
        state = self.rng.get_state()
        block = self.blocks.setdefault(state[1].tobytes(), len(self.blocks))
        found = self.ids.setdefault((block, state[2]), len(self.states))
        if found == len(self.states):
            self.states.append((block, state[2]))
            if len(self.states) > len(self.after_tree):
                for name in self._TABLES:
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full_like(old, -1)]))
        return found

    def _at(self, state: int) -> None:
        if not hasattr(self, "_keys") or len(self._keys) < len(self.blocks):
            self._keys = [np.frombuffer(b, dtype=np.uint32) for b in self.blocks]
        block, place = self.states[state]
        self.rng.set_state(("MT19937", self._keys[block], place, 0, 0.0))

    def tree(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each state the order of features, the rows of each part's axes, the rows of the tree, and the state afterwards."""
        for state in np.unique(states[self.after_tree[states] < 0]).tolist():
            self._at(state)
            self.order[state] = self.rng.permutation(self.order.shape[1])
            for part in range(self.parts):
                self.some[state, part] = self.rng.choice(self.n, self.some.shape[2])
            self.rows[state] = self.rng.choice(self.n, self.n)
            after = self._id()  # may move the tables
            self.after_tree[state] = after
        return self.order[states], self.some[states], self.rows[states], self.after_tree[states]

    def node(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each state the features that a node tries, and the state afterwards."""
        for state in np.unique(states[self.after_node[states] < 0]).tolist():
            self._at(state)
            self.tried[state] = self.rng.choice(self.order.shape[1], self.tried.shape[1], replace=False)
            after = self._id()
            self.after_node[state] = after
        return self.tried[states], self.after_node[states]


class SummaryForest:
    """Summary figures of each window and a forest whose trees each see them rotated: principal axes of random groups of figures."""

    def __init__(self, seed: int, trees: int = 25, group: int = 8):
        self.seed, self.trees, self.group = seed, trees, group

    @staticmethod
    def features(x: np.ndarray) -> np.ndarray:
        out, z, w = [], znormed(x), x.shape[2]
        for v in (x, np.diff(x, axis=2, prepend=x[:, :, :1])):
            out += [v.mean(2), v.std(2), v.min(2), v.max(2), np.median(v, axis=2), np.quantile(v, 0.25, axis=2), np.quantile(v, 0.75, axis=2), np.abs(v).sum(2), (v**2).sum(2)]
        out += [(z**3).mean(2), (z**4).mean(2), (z > 0).mean(2), (np.diff(np.sign(z), axis=2) != 0).mean(2) if w > 1 else z[:, :, 0] * 0, z.argmax(2), z.argmin(2), (z * np.linspace(-1, 1, w)).mean(2)]
        out += [(z[:, :, lag:] * z[:, :, :-lag]).mean(2) for lag in range(1, min(11, w))]
        size = np.abs(np.fft.rfft(z, axis=2))[:, :, 1:11]
        out += [size[:, :, i] for i in range(size.shape[2])]
        return np.concatenate(out, axis=1)

    def fit(self, x, y):
        f, rng = self.features(x), np.random.RandomState(self.seed)
        self.classes, at = np.unique(y, return_inverse=True)
        self.mean, self.scale = f.mean(0), np.where(f.std(0) < 1e-9, 1, f.std(0))
        f, self.forest = (f - self.mean) / self.scale, []
        for _ in range(self.trees):
            turn, order = np.zeros((f.shape[1], f.shape[1])), rng.permutation(f.shape[1])
            for part in np.array_split(order, max(1, len(order) // self.group)):
                some = f[rng.choice(len(f), max(2, len(f) * 3 // 4))][:, part]
                turn[np.ix_(part, part)] = np.linalg.svd(some - some.mean(0), full_matrices=True)[2].T
            rows = rng.choice(len(f), len(f))
            self.forest.append((turn, _grow((f @ turn)[rows], at[rows], len(self.classes), rng)))
        return self

    def predict(self, x):
        f, votes = (self.features(x) - self.mean) / self.scale, np.zeros((len(x), len(self.classes)))
        for turn, tree in self.forest:
            out = np.zeros(len(x), dtype=np.int64)
            _leaves(tree, f @ turn, np.arange(len(x)), out)
            votes[np.arange(len(x)), out] += 1
        return self.classes[votes.argmax(1)]

    #: Training windows up to which the trees of many series are grown together; longer series keep a call of NumPy busy by themselves.
    MANY = 128

    def fit_predict_many(self, f: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray) -> np.ndarray:
        """What fit on the rows `train` and predict on `test` give for each of many feature tables (tables, rows, features) with the same labels.

        The forests grow in step, a node of each at once, and draw what each would draw by itself.
        """
        g, h = np.ascontiguousarray(f[:, train]), np.ascontiguousarray(f[:, test])
        classes, at = np.unique(y[train], return_inverse=True)
        mean, std = g.mean(1, keepdims=True), g.std(1, keepdims=True)
        scale = np.where(std < 1e-9, 1, std)
        g, h = (g - mean) / scale, (h - mean) / scale
        count, n, features = g.shape
        parts = max(1, features // self.group)
        widths = [len(part) for part in np.array_split(np.arange(features), parts)]
        key = (self.seed, n, features, parts)
        if getattr(SummaryForest, "_known", (None, None))[0] != key or len(SummaryForest._known[1].states) > 100_000:
            SummaryForest._known = key, _Draws(*key)
        draws, states, own = SummaryForest._known[1], np.zeros(count, dtype=np.int64), np.arange(count)
        votes = np.zeros((count, h.shape[1], len(classes)))
        for _ in range(self.trees):
            order, some, rows, states = draws.tree(states)
            turn, low = np.zeros((count, features, features)), 0
            for part, width in enumerate(widths):
                mine = order[:, low : low + width]
                low += width
                axes = np.ascontiguousarray(g[own[:, None, None], some[:, part][:, None, :], mine[:, :, None]]).transpose(0, 2, 1)
                turn[own[:, None, None], mine[:, :, None], mine[:, None, :]] = np.linalg.svd(axes - axes.mean(1, keepdims=True), full_matrices=True)[2].transpose(0, 2, 1)
            states = self._vote((g @ turn)[own[:, None], rows], at[rows], h @ turn, states, draws, votes)
        return classes[votes.argmax(2)]

    @staticmethod
    def _vote(f, y, h, states, draws, votes) -> np.ndarray:
        """Grows a tree a table, left before right, and counts the class that each test row ends in; the generator's states afterwards."""
        (count, n, _), classes = f.shape, votes.shape[2]
        kinds = np.eye(classes)[y]
        nodes, tests = np.zeros((count, n + 1, n), dtype=bool), np.zeros((count, n + 1, h.shape[1]), dtype=bool)
        nodes[:, 0], tests[:, 0], depth, states = True, True, np.ones(count, dtype=np.int64), states.copy()
        while len(live := np.flatnonzero(depth)):
            depth[live] -= 1
            mine, theirs = nodes[live, depth[live]], tests[live, depth[live]]
            have, size = (mine[:, :, None] * kinds[live]).sum(1), mine.sum(1)
            ends = (have.max(1) == size) | (size < 2)
            open_ = np.flatnonzero(~ends)
            if len(open_):
                at = live[open_]
                tried, states[at] = draws.node(states[at])
                v = np.where(mine[open_][:, :, None], f[at[:, None, None], np.arange(n)[None, :, None], tried[:, None, :]], np.inf)
                order = np.argsort(v, axis=1, kind="stable")
                v = np.take_along_axis(v, order, 1)
                left = np.cumsum((mine[open_][:, :, None] * kinds[at])[np.arange(len(at))[:, None, None], order], axis=1)[:, :-1]
                k, m = np.arange(1, n)[None, :, None], size[open_][:, None, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    impurity = m - (left**2).sum(3) / k - ((have[open_][:, None, None] - left) ** 2).sum(3) / (m - k)
                impurity[(v[:, 1:] == v[:, :-1]) | (k >= m)] = np.inf
                place = impurity.argmin(1)
                least = np.take_along_axis(impurity, place[:, None], 1)[:, 0]
                best, each = least.argmin(1), np.arange(len(at))
                place, column = place[each, best], tried[each, best]
                bar = (v[each, place, best] + v[each, np.minimum(place + 1, n - 1), best]) / 2
                low = f[at, :, column] <= bar[:, None]
                lows, highs = mine[open_] & low, mine[open_] & ~low
                fine = np.isfinite(least[each, best]) & lows.any(1) & highs.any(1)
                ends[open_[~fine]] = True
                at, right = at[fine], h[at[fine], :, column[fine]] > bar[fine][:, None]
                here = theirs[open_[fine]]
                for node, test in ((highs[fine], here & right), (lows[fine], here & ~right)):
                    nodes[at, depth[at]], tests[at, depth[at]] = node, test
                    depth[at] += 1
            done = np.flatnonzero(ends)
            which, row = np.nonzero(theirs[done])
            votes[live[done][which], row, have[done].argmax(1)[which]] += 1
        return states


def warped(x: np.ndarray, one: np.ndarray, band: int) -> np.ndarray:
    """Dynamic time warping distances of rows (count, channels, w) to one (channels, w) within a band; band 0 is Euclidean."""
    if band == 0:
        return ((x - one) ** 2).sum((1, 2))
    w = x.shape[2]
    before = np.full((len(x), w + 1), np.inf)
    before[:, 0] = 0
    for i in range(w):
        now = np.full_like(before, np.inf)
        for j in range(max(0, i - band), min(w, i + band + 1)):
            cost = ((x[:, :, i] - one[:, j]) ** 2).sum(1)
            now[:, j + 1] = cost + np.minimum(np.minimum(before[:, j], before[:, j + 1]), now[:, j])
        before = now
    return before[:, w]


class ProximityTrees:
    """Trees that send a window to the nearest of one random exemplar a class, by a random distance; the best of a few candidates."""

    def __init__(self, seed: int, trees: int = 10, candidates: int = 3):
        self.seed, self.trees, self.candidates = seed, trees, candidates

    @staticmethod
    def _branch(x, rule):
        steps, band, exemplars = rule
        v = np.diff(x, axis=2, prepend=x[:, :, :1]) if steps else x
        return np.stack([warped(v, e, band) for e in exemplars], axis=1).argmin(1)

    def _tree(self, x, y, rng, depth=0):
        have = np.bincount(y)
        if have.max() == len(y) or depth > 20:
            return int(have.argmax())
        best = None
        for _ in range(self.candidates):
            steps, band = bool(rng.randint(2)), int(rng.choice([0, 0, max(1, x.shape[2] // 20)]))
            v = np.diff(x, axis=2, prepend=x[:, :, :1]) if steps else x
            rule = steps, band, [v[rng.choice(np.flatnonzero(y == c))] for c in np.unique(y)]
            side = self._branch(x, rule)
            impurity = sum((side == s).sum() - (np.bincount(y[side == s]) ** 2).sum() / (side == s).sum() for s in np.unique(side))
            if best is None or impurity < best[0]:
                best = impurity, rule, side
        _, rule, side = best
        if len(np.unique(side)) == 1:
            return int(have.argmax())
        return rule, [self._tree(x[side == s], y[side == s], rng, depth + 1) if (side == s).any() else int(have.argmax()) for s in range(len(rule[2]))]

    def _walk(self, tree, x, rows, out):
        if isinstance(tree, int):
            out[rows] = tree
        elif len(rows):
            side = self._branch(x[rows], tree[0])
            for s, child in enumerate(tree[1]):
                self._walk(child, x, rows[side == s], out)

    def fit(self, x, y):
        self.classes, at = np.unique(y, return_inverse=True)
        x, rng = znormed(x), np.random.RandomState(self.seed)
        self.forest = [self._tree(x, at, rng) for _ in range(self.trees)]
        return self

    def predict(self, x):
        x, votes = znormed(x), np.zeros((len(x), len(self.classes)))
        for tree in self.forest:
            out = np.zeros(len(x), dtype=np.int64)
            self._walk(tree, x, np.arange(len(x)), out)
            votes[np.arange(len(x)), out] += 1
        return self.classes[votes.argmax(1)]


class ConvolutionNet:
    """Parallel convolutions of three lengths and a pooled branch, rectified and averaged over places, into a softmax; trained by Adam."""

    def __init__(self, seed: int, filters: int = 8, lengths: tuple[int, ...] = (5, 11, 21), epochs: int = 60, batch: int = 64, rate: float = 0.01):
        self.seed, self.filters, self.lengths, self.epochs, self.batch, self.rate = seed, filters, lengths, epochs, batch, rate

    def _runs(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each branch, (count, w, channels * length); each place sees as many values before as after it."""
        out = []
        for length in (*self.lengths, 1):
            v = x
            if length == 1:
                v = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1)), mode="edge"), 3, axis=2).max(3)
            runs = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (0, 0), (length // 2, length // 2))), length, axis=2)
            out.append(runs.transpose(0, 2, 1, 3).reshape(len(x), x.shape[2], -1))
        return out

    def _forward(self, runs: list[np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
        raw = [r @ w + b for r, w, b in zip(runs, self.weights[:-2:2], self.weights[1:-2:2], strict=True)]
        pooled = np.concatenate([np.maximum(v, 0).mean(1) for v in raw], axis=1)
        score = pooled @ self.weights[-2] + self.weights[-1]
        score = np.exp(score - score.max(1, keepdims=True))
        return raw, pooled, score / score.sum(1, keepdims=True)

    def fit(self, x, y):
        self.classes, at = np.unique(y, return_inverse=True)
        x, rng = znormed(x), np.random.RandomState(self.seed)
        sizes = [x.shape[1] * length for length in (*self.lengths, 1)]
        self.weights = [v for n in sizes for v in (rng.normal(0, np.sqrt(2 / n), (n, self.filters)), np.zeros(self.filters))]
        self.weights += [rng.normal(0, 0.1, (len(sizes) * self.filters, len(self.classes))), np.zeros(len(self.classes))]
        first, second, step = [np.zeros_like(v) for v in self.weights], [np.zeros_like(v) for v in self.weights], 0
        for _ in range(self.epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // self.batch)):
                runs = self._runs(x[rows])
                raw, pooled, p = self._forward(runs)
                p[np.arange(len(rows)), at[rows]] -= 1
                p /= len(rows)
                back, slopes = p @ self.weights[-2].T, []
                for i, (r, v) in enumerate(zip(runs, raw, strict=True)):
                    d = back[:, None, i * self.filters : (i + 1) * self.filters] * (v > 0) / v.shape[1]
                    slopes += [np.tensordot(r, d, ((0, 1), (0, 1))), d.sum((0, 1))]
                slopes += [pooled.T @ p, p.sum(0)]
                step += 1
                for v, m, s, g in zip(self.weights, first, second, slopes, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, x):
        return self.classes[self._forward(self._runs(znormed(x)))[2].argmax(1)]
