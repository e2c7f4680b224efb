"""Histogram boosting of many models at once on packed bins: folds and targets are keys, not loops."""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfseen.operators.lineage import cut, spread

BINS = 255                    # value bins of a feature; bin 0 is that of missing values
WIDTH = BINS + 1
ROUNDS, RATE, LEAVES, LEAST, L2 = 200, 0.07, 31, 30, 1.0
PACKED = 500_000              # packed rows up to which a model is grown in one task; beyond, every tree level is one aggregate
HELD = 1 << 22               # sums of a kind that a task holds at a time when levels are aggregated
PENDING = 8                   # rounds between two hand-overs of the margins when levels are aggregated
KNOWN = 1 << 16               # bins whose scores a worker keeps
KEYS = ["target", "fold", "inner"]
_SEEN: dict[str, dict[bytes, np.ndarray]] = {}


def seen(token: str) -> dict[bytes, np.ndarray]:
    """The scores this worker has already worked out for a set of models; those of the set before are dropped."""
    if token not in _SEEN:
        _SEEN.clear()
        _SEEN[token] = {}
    return _SEEN[token]


@dataclass
class Tree:
    """Nodes in order of creation; feature -1 marks a leaf. Bins up to `bin` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int) -> int:
        """Give a node two children, next to each other; returns the left one."""
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, at
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.value.append(0.0)
        return at

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.bin, np.int16), np.array(self.left, np.int32), np.array(self.value)


def leaves(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Leaf of each row of bins."""
    feature, bin_, left, _ = tree
    at, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
    open_ = feature[at] >= 0
    while open_.any():
        f = np.maximum(feature[at], 0)
        at = np.where(open_, left[at] + (bins[rows, f] > bin_[at]), at)
        open_ = feature[at] >= 0
    return at


def best_split(hist: np.ndarray, least: float, l2: float) -> tuple[float, int, int, float]:
    """(gain, feature, bin, value of the node) from sums of gradient, hessian and weight by feature and bin; no split: gain 0."""
    g, h, n = hist
    total = g[0].sum(), h[0].sum(), n[0].sum()
    value = -total[0] / (total[1] + l2)
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    gl, hl, nl = left
    gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
    gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - total[0] ** 2 / (total[1] + l2)
    gain = np.where((nl >= least) & (nr >= least) & (hl >= 1e-3) & (hr >= 1e-3), gain, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]) if gain[f, b] > 1e-9 else 0.0), int(f), int(b), float(value)


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of g, h and w: (3, nodes, features, WIDTH)."""
    d = bins.shape[1]
    at = ((node[:, None].astype(np.int64) * d + np.arange(d)) * WIDTH + bins).ravel()
    return np.stack([np.bincount(at, np.repeat(x, d), nodes * d * WIDTH) for x in (g, h, w)]).reshape(3, nodes, d, WIDTH)


def slopes(loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return w * (margin - y), w.copy()
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))
    return w * (p - y), w * p * (1.0 - p)


def start(loss: str, positive: float, total: float) -> float:
    mean = positive / total if total else 0.0
    if loss == "squared":
        return mean
    mean = min(max(mean, 1e-9), 1.0 - 1e-9)
    return float(np.log(mean / (1.0 - mean)))


@dataclass
class Settings:
    loss: str = "logistic"
    rounds: int = ROUNDS
    rate: float = RATE
    leaves: int = LEAVES
    least: int = LEAST
    l2: float = L2


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, s: Settings) -> tuple[Tree, np.ndarray]:
    """One tree, best gain first; and the leaf of each row."""
    tree, leaf = Tree(), np.zeros(len(bins), np.int32)
    zero = np.zeros(len(bins), np.int32)

    def sums(rows):
        return histograms(bins[rows], zero[:len(rows)], 1, g[rows], h[rows], w[rows])[:, 0]

    def offer(node, rows, hist):
        gain, f, b, tree.value[node] = best_split(hist, s.least, s.l2)
        if gain:
            heapq.heappush(heap, (-gain, node, f, b, rows, hist))

    heap: list[tuple] = []
    offer(0, np.arange(len(bins)), sums(np.arange(len(bins))))
    count = 1
    while heap and count < s.leaves:
        _, node, f, b, rows, hist = heapq.heappop(heap)
        right = bins[rows, f] > b
        at = tree.split(node, f, b)
        own = rows[~right], rows[right]
        leaf[own[0]], leaf[own[1]] = at, at + 1
        few = int(len(own[1]) < len(own[0]))               # the larger side is what the smaller leaves of the parent's sums
        part = sums(own[few])
        parts = (part, hist - part) if few == 0 else (hist - part, part)
        for k in (0, 1):
            offer(at + k, own[k], parts[k])
        count += 1
    return tree, leaf


def fit_one(bins: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """(start, trees) of one model on packed rows."""
    base = start(s.loss, float((w * y).sum()), float(w.sum()))
    margin, trees = np.full(len(y), base), []
    for _ in range(s.rounds):
        g, h = slopes(s.loss, margin, y, w)
        tree, leaf = grow(bins, g, h, w, s)
        if tree.feature[0] < 0 and abs(tree.value[0]) < 1e-12:
            break
        made = tree.arrays()
        margin += s.rate * made[3][leaf]
        trees.append(made)
    return base, trees


def replay(tree: Tree, known: dict[int, tuple], most: int) -> list[int]:
    """Best-first growth over the nodes looked at so far: the nodes to split, in order."""
    order, heap = [], [(-known[0][0], 0)] if 0 in known and known[0][0] else []
    while heap and len(order) < most - 1:
        _, node = heapq.heappop(heap)
        order.append(node)
        for child in (tree.left[node], tree.left[node] + 1) if tree.left[node] >= 0 else ():
            if child in known and known[child][0]:
                heapq.heappush(heap, (-known[child][0], child))
    return order


def pruned(tree: Tree, known: dict[int, tuple], order: list[int]) -> Tree:
    """The tree with only these splits."""
    out, to = Tree(), {0: 0}
    out.value[0] = known[0][3]
    for node in order:
        _, f, b, _ = known[node]
        at = out.split(to[node], f, b)
        for k in (0, 1):
            to[tree.left[node] + k] = at + k
            out.value[at + k] = known[tree.left[node] + k][3]
    return out


def as_bins(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(-1, d).astype(np.int64)


def fit_levels(packed: DataFrame, d: int, models: Sequence[tuple[int, int, int]], bases: list[float], s: Settings):
    """All models together on packed rows of any number: one aggregate per level of the trees, and one row per node comes back."""
    trees: list[list] = [[] for _ in models]
    rows = packed.withColumn("margin", F.array(*[F.lit(float(b)) for b in bases]))
    pending: list[list] = [[] for _ in models]

    def margins(batch, recent, bins):
        out = np.stack(batch.column("margin").to_pylist())
        for m, own in enumerate(recent):
            for t in own:
                out[:, m] += s.rate * t[3][leaves(t, bins)]
        return out

    def train(batch, m):
        target, fold, inner = (batch.column(c).to_numpy() for c in KEYS)
        return (target == models[m][0]) & (fold != models[m][1]) & (inner != models[m][2])

    for _ in range(s.rounds):
        tree, known = [Tree() for _ in models], [{} for _ in models]
        while True:
            wanted = [(m, k) for m in range(len(models)) for k in range(len(tree[m].feature)) if k not in known[m]]
            if not wanted:
                break
            wanted = wanted[:max(1, HELD // (d * WIDTH))]
            place = {q: i for i, q in enumerate(wanted)}
            shape = [t.arrays() for t in tree]

            def partial(batches: Iterator[pa.RecordBatch], shape=shape, wanted=wanted, place=place, recent=pending):
                total = np.zeros((3, len(wanted), d, WIDTH))
                for batch in batches:
                    bins, w, y = as_bins(batch, d), batch.column("w").to_numpy(), batch.column("y").to_numpy()
                    margin = margins(batch, recent, bins)
                    for m in {m for m, _ in wanted}:
                        own = np.flatnonzero(train(batch, m))
                        at = leaves(shape[m], bins[own])
                        to = np.array([place.get((m, k), -1) for k in range(len(shape[m][0]))])[at]
                        own, to = own[to >= 0], to[to >= 0]
                        g, h = slopes(s.loss, margin[own, m], y[own], w[own])
                        total += histograms(bins[own], to, len(wanted), g, h, w[own])
                node, f, b = np.nonzero(total[2])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (node, f, b)] + [pa.array(total[k][node, f, b]) for k in range(3)],
                                                 ["node", "f", "b", "g", "h", "n"])

            def choose(key, pdf):
                hist = np.zeros((3, d, WIDTH))
                for k, c in enumerate("ghn"):
                    hist[k, pdf["f"], pdf["b"]] = pdf[c]
                return pd.DataFrame([(key[0], *best_split(hist, s.least, s.l2))], columns=["node", "gain", "f", "b", "value"])

            sums = rows.mapInArrow(partial, "node int, f int, b int, g double, h double, n double").groupBy("node", "f", "b").agg(
                *[F.sum(c).alias(c) for c in "ghn"])
            found = {r["node"]: (r["gain"], r["f"], r["b"], r["value"]) for r in sums.groupBy("node").applyInPandas(
                choose, "node int, gain double, f int, b int, value double").collect()}
            for i, (m, k) in enumerate(wanted):
                known[m][k] = found.get(i, (0.0, 0, 0, 0.0))
            for m in range(len(models)):
                for node in replay(tree[m], known[m], s.leaves):
                    if tree[m].left[node] < 0:
                        tree[m].split(node, known[m][node][1], known[m][node][2])
        for m in range(len(models)):
            made = pruned(tree[m], known[m], replay(tree[m], known[m], s.leaves)).arrays()
            trees[m].append(made)
            pending[m].append(made)
        if len(pending[0]) == PENDING:
            def moved(batches, recent=pending):
                for batch in batches:
                    new = margins(batch, recent, as_bins(batch, d))
                    at = batch.schema.get_field_index("margin")
                    yield batch.set_column(at, "margin", pa.array(list(new)))
            rows = cut(rows.mapInArrow(moved, rows.schema))
            pending = [[] for _ in models]
    return list(zip(bases, trees))


class Boosted:
    """Fitted models over common bins."""

    def __init__(self, features: Sequence[str], edges: list[np.ndarray], models: list[tuple[float, list]], s: Settings):
        self.features, self.edges, self.settings = list(features), edges, s
        self.models = [(base, self.stacked(trees)) for base, trees in models]

    @staticmethod
    def stacked(trees: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
        """All trees of a model in common arrays; the first entries are the roots."""
        if not trees:
            return None
        first = np.cumsum([0, *[len(t[0]) for t in trees[:-1]]])
        return (first, np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]),
                np.concatenate([np.where(t[2] >= 0, t[2] + o, -1) for t, o in zip(trees, first)]), np.concatenate([t[3] for t in trees]))

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return binned(columns, self.edges)

    def score(self, m: int, cells: np.ndarray) -> np.ndarray:
        """Probability of model m, or its value under squared loss."""
        base, packed = self.models[m]
        out = np.full(len(cells), base)
        if packed is not None:
            first, feature, bin_, left, value = packed
            flat, d = np.ascontiguousarray(cells).ravel(), cells.shape[1]
            for k in range(0, len(cells), 1024):
                n = min(1024, len(cells) - k)
                row = np.repeat((np.arange(k, k + n) * d), len(first))
                at = np.tile(first, n)
                open_ = np.flatnonzero(feature[at] >= 0)
                while len(open_):
                    node = at[open_]
                    at[open_] = node = left[node] + (flat[row[open_] + feature[node]] > bin_[node])
                    open_ = open_[feature[node] >= 0]
                out[k:k + n] += self.settings.rate * value[at].reshape(n, -1).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40))) if self.settings.loss == "logistic" else out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """(rows, models). Equal rows are scored once."""
        cells, back = np.unique(bins, axis=0, return_inverse=True)
        return np.column_stack([self.score(m, cells) for m in range(len(self.models))])[back.ravel()]

    def recalled(self, bins: np.ndarray, known: dict[bytes, np.ndarray], finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """What `finish` makes of the scores; bins in `known` are looked up, new ones scored and added."""
        cells, back = np.unique(bins.astype(np.uint8), axis=0, return_inverse=True)
        names = [c.tobytes() for c in cells]
        found = [known.get(n) for n in names]
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            made = self.scores(cells[new].astype(np.int64))
            if len(known) + len(new) > KNOWN:
                known.clear()
            for i, v in zip(new, made if finish is None else finish(made)):
                found[i] = known[names[i]] = v
        return np.stack(found)[back.ravel()] if len(found) else np.empty((0, len(self.models)))

    def column(self, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> Column:
        """An array column: the scores of all models in order, or what `finish` makes of them (row by row)."""
        own, token = self, uuid.uuid4().hex

        @F.pandas_udf("array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(list(own.recalled(own.binned([c.to_numpy(float) for c in columns]), seen(token), finish)))
        return score(*[F.col(f).cast("double") for f in self.features])


def binned(columns: Sequence[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, side="left")) for c, e in zip(columns, edges)], axis=1).astype(np.int64)


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the value bins of every feature: quantiles, in one pass."""
    marks = [k / BINS for k in range(1, BINS)]
    finite = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    got = rows.agg(*[F.percentile_approx(c, marks, 20_000).alias(f"q{i}") for i, c in enumerate(finite)]).first()
    return [np.unique(np.array(got[i] or [], float)) for i in range(len(features))]


def pack(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """Equal bins, keys and labels as one row with their weight: cell (one byte per feature), target, fold, inner, y, w."""
    d = len(features)

    def run(batches):
        for batch in batches:
            bins = binned([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(d)], edges).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *(batch.column(c) for c in [*KEYS, "y", "w"])],
                                             ["cell", *KEYS, "y", "w"])
    own = rows.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *[F.col(k).cast("int").alias(k) for k in KEYS],
                      F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    cells = own.mapInArrow(run, "cell binary, target int, fold int, inner int, y double, w double")
    return cut(cells.groupBy("cell", *KEYS, "y").agg(F.sum("w").alias("w")))


def boost(rows: DataFrame, features: Sequence[str], models: Sequence[tuple[int, int, int]], *, settings: Settings = Settings(),
          packed_limit: int = PACKED) -> tuple[Boosted, DataFrame]:
    """Fit models (target, fold, inner): each on the rows of its target outside its fold and its inner fold (-1 leaves nothing out).

    rows: the features and target, fold, inner, y, w; rows without label are left out,
    missing features have a bin of their own. Rows of equal bins are packed first. Up to
    `packed_limit` packed rows a model is grown in one task, models side by side; beyond,
    each level of the trees of all models is one aggregate over the rows. Both grow best
    gain first to 31 leaves. Returns the models and the packed rows.
    """
    rows = rows.where("y is not null and w > 0")
    edges = bin_edges(rows, features)
    packed = pack(rows, features, edges)
    d, s = len(features), settings
    wanted = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t"), F.lit(f).alias("f"), F.lit(i).alias("i"))
                       for m, (t, f, i) in enumerate(models)])
    mine = packed.withColumn("m", F.explode(F.transform(
        F.filter(wanted, lambda q: (q["t"] == F.col("target")) & (q["f"] != F.col("fold")) & (q["i"] != F.col("inner"))), lambda q: q["m"])))
    if packed.count() > packed_limit:
        sums = {r["m"]: r for r in mine.groupBy("m").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("n")).collect()}
        bases = [start(s.loss, sums[m]["p"], sums[m]["n"]) if m in sums else 0.0 for m in range(len(models))]
        return Boosted(features, edges, fit_levels(packed, d, models, bases, s), s), packed

    def train(key, table):
        table = table.sort_by([("cell", "ascending"), ("y", "ascending")])
        bins = np.frombuffer(b"".join(table.column("cell").to_pylist()), np.uint8).reshape(-1, d).astype(np.int64)
        made = fit_one(bins, table.column("y").to_numpy(), table.column("w").to_numpy(), s)
        return pa.table({"m": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(made)], pa.binary())})

    again = mine.groupBy("m", "cell", "y").agg(F.sum("w").alias("w")).repartition(8 * len(models), "m")     # models in tasks of their own
    found = {r["m"]: pickle.loads(r["model"]) for r in again.groupBy("m").applyInArrow(train, "m int, model binary").collect()}
    return Boosted(features, edges, [found.get(m, (0.0, [])) for m in range(len(models))], s), packed


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing weighted fit at rising x: ends of its level pieces and their values."""
    value, weight, first, last = [], [], [], []
    for a, b, c in zip(x, y, w):
        value.append(b)
        weight.append(c)
        first.append(a)
        last.append(a)
        while len(value) > 1 and value[-2] >= value[-1]:
            b2, c2, l2, _ = value.pop(), weight.pop(), last.pop(), first.pop()
            value[-1] = (value[-1] * weight[-1] + b2 * c2) / (weight[-1] + c2)
            weight[-1] += c2
            last[-1] = l2
    return np.ravel(np.column_stack([first, last])), np.repeat(value, 2)


def calibrate(fitted: Boosted, packed: DataFrame, models: Sequence[tuple[int, int, int]], digits: int = 4) -> dict[int, tuple]:
    """Isotonic map of each model that leaves an inner fold out, fitted to that inner fold's scores.

    Scores are rounded to `digits` decimals, so a model's task gets at most 10^digits + 1 points.
    """
    d = len(fitted.features)

    def held(batches):
        for batch in batches:
            bins = as_bins(batch, d)
            target, fold, inner = (batch.column(c).to_numpy() for c in KEYS)
            for m, (t, f, i) in enumerate(models):
                own = np.flatnonzero((target == t) & (fold != f) & (inner == i))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.int32)), pa.array(np.round(fitted.score(m, bins[own]), digits)),
                                                      pa.array(batch.column("y").to_numpy()[own]), pa.array(batch.column("w").to_numpy()[own])], ["m", "x", "y", "w"])
    points = spread(packed).mapInArrow(held, "m int, x double, y double, w double").groupBy("m", "x").agg(
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))

    def solve(key, table):
        table = table.sort_by("x")
        x, y = isotonic(*(table.column(c).to_numpy() for c in ("x", "y", "w")))
        return pa.table({"m": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([x]), "y": pa.array([y])})
    return {r["m"]: (np.array(r["x"]), np.array(r["y"])) for r in points.groupBy("m").applyInArrow(solve, "m int, x array<double>, y array<double>").collect()}
