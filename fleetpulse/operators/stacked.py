"""Linear models of many folds and settings, fitted together in the same passes over the rows.

Cross-validation fits the same kind of model on overlapping row sets with several penalties. Here all of them
take their Newton steps at once: in a pass every task adds up, for each model it has rows for, the loss, the
gradient and the curvature, and hands on one packed row per row set; these are added over groups of tasks, and
the driver, which receives a fixed number of rows, solves one small system per model. A fit takes about as many
jobs as the slowest model has Newton steps, whatever the number of folds and settings.

Rows carry a key (a fold, a split or a day), and each row set is a set of keys: a row that belongs to several
training sets is read once and not copied. What the passes read is packed: a row holds thousands of rows of one
key as matrix bytes, so no row is converted again in every pass. Missing values are filled with the mean of the row set and columns
scaled to unit deviation, as the pipelines of ``models`` do.

Penalties are sums over rows: ``loss + l2 / 2 * |w|^2 + l1 * |w|``, without the intercept. With ``l1`` the step
minimises the quadratic model by coordinate descent (a proximal Newton method), so weights become exactly zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import hash_number, stable_hash
from fleetpulse.session import staged

LABEL = "label"
GROUPS = 16  # of tasks whose packed rows are added before they go to the driver
BLOCK_BYTES = 1 << 18  # of values in a packed block, about
HELD_BLOCKS = 64  # unfinished blocks a packing task holds at most, in rows
MAX_PASSES = 80
TOLERANCE = 1e-9

Members = Mapping[int, Sequence[int]]  # key of a row -> the row sets it belongs to


@dataclass(frozen=True)
class Setting:
    """``loss`` is ``logistic``, ``hinge`` (squared) or ``squares`` (on targets -1 and 1)."""

    loss: str = "logistic"
    l1: float = 0.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        if self.loss not in ("logistic", "hinge", "squares"):
            raise ValueError(f"unknown loss {self.loss}")


def loss_terms(loss: str, sign: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, and its first and second derivative by the margin."""
    if loss == "squares":
        return (sign - margin) ** 2 / 2, margin - sign, np.ones(len(margin))
    along = sign * margin
    if loss == "hinge":
        short = np.maximum(1 - along, 0)
        return short**2, -2 * sign * short, 2.0 * (short > 0)
    p = 1 / (1 + np.exp(-np.clip(along, -500, 500)))
    return np.logaddexp(0, -along), -sign * (1 - p), p * (1 - p)


# ---- packed rows and sums ----


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, labels, values) of the rows, or packed blocks, of a batch of ``_key, _y, _v``."""
    if not batch.num_rows:
        return
    keys = batch.column(0).to_numpy()
    if pa.types.is_floating(batch.schema.field(1).type):
        y, values = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for key in np.unique(keys).tolist():
            mine = keys == key
            yield key, y[mine], values[mine]
        return
    for key, y, v in zip(keys.tolist(), batch.column(1), batch.column(2), strict=True):
        labels = np.frombuffer(y.as_buffer(), "<f8")
        yield key, labels, np.frombuffer(v.as_buffer(), "<f8").reshape(-1, len(labels)).T


def packed_rows(df: DataFrame) -> DataFrame:
    """Rows of ``_key, _y, _v`` as blocks of one key: labels, and values column after column, as bytes."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def blocks(keys: list[int]) -> pa.RecordBatch:
            made = [[np.concatenate(a) for a in zip(*held.pop(k), strict=True)] for k in keys]
            for k in keys:
                del count[k]
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([y.astype("<f8").tobytes() for y, _ in made], pa.binary()),
                pa.array([v.T.astype("<f8").tobytes() for _, v in made], pa.binary())], names=["_key", "_y", "_v"])

        for batch in batches:
            most = 1
            for key, y, values in _parts(batch):
                most = max(1, BLOCK_BYTES // (8 * values.shape[1]))
                held.setdefault(key, []).append((y, values))
                count[key] = count.get(key, 0) + len(y)
            crowded = sum(count.values()) >= HELD_BLOCKS * most
            if full := [k for k, n in count.items() if n >= most or crowded]:
                yield blocks(full)
        if held:
            yield blocks(list(held))

    return df.select("_key", "_y", "_v").mapInArrow(of_rows, "_key long, _y binary, _v binary")


def packed_sums(df: DataFrame, part: Callable[[int, np.ndarray, np.ndarray, dict[int, np.ndarray]], None], merge: Callable) -> dict[int, np.ndarray]:
    """What ``part(key, labels, values, sums)`` adds to ``sums`` (an array per row set) over all rows of ``_key, _y, _v``,
    plain or packed; it is called with rows of one key."""

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([a.astype("<f8").tobytes() for a in sums.values()], pa.binary())], names=["s", "a"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, y, values in _parts(batch):
                part(key, y, values, sums)
        yield packed(sums)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, a in zip(*batch.columns, strict=True):
                new = np.frombuffer(a.as_py(), "<f8")
                sums[s.as_py()] = merge(sums[s.as_py()], new) if s.as_py() in sums else new
        yield packed(sums)

    rows = df.select("_key", "_y", "_v").mapInArrow(of_rows, "s long, a binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    added: dict[int, np.ndarray] = {}
    for r in rows.repartition("s", "g").select("s", "a").mapInArrow(of_tasks, "s long, a binary").collect():  # at most row sets x tasks of one shuffle
        new = np.frombuffer(r.a, "<f8")
        added[r.s] = merge(added[r.s], new) if r.s in added else new
    return added


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and squared deviations per column, of two row sets together; the first entry counts rows."""
    (n, m, q), (k, o, r) = a[1:].reshape(3, -1), b[1:].reshape(3, -1)
    both = np.maximum(n + k, 1)
    step = o - m
    return np.concatenate([[a[0] + b[0]], n + k, m + step * k / both, q + r + step**2 * n * k / both])


@dataclass
class Scale:
    """Mean and deviation of the columns of one row set."""

    n: float
    mean: np.ndarray
    deviation: np.ndarray

    def ready(self, values: np.ndarray) -> np.ndarray:
        """Filled and scaled, with a last column of ones."""
        n, d = values.shape
        out = np.empty((d + 1, n)).T  # columns lie together, as in a packed block
        x = out[:, :d]
        np.subtract(values, self.mean, out=x)
        x /= self.deviation
        x[np.isnan(values)] = 0.0
        out[:, d] = 1.0
        return out


def _scales(df: DataFrame, members: Members, scale: bool) -> dict[int, Scale]:
    def part(key: int, _: np.ndarray, x: np.ndarray, sums: dict[int, np.ndarray]) -> None:
        there = ~np.isnan(x)
        n = there.sum(0)
        mean = np.where(there, x, 0).sum(0) / np.maximum(n, 1)
        squares = np.where(there, x - mean, 0) ** 2
        new = np.concatenate([[len(x)], n, mean, squares.sum(0)])
        for s in set(members.get(key, ())):
            sums[s] = _merged_moments(sums[s], new) if s in sums else new

    out = {}
    for s, a in packed_sums(df, part, _merged_moments).items():
        _, mean, squares = a[1:].reshape(3, -1)
        deviation = np.sqrt(squares / max(a[0] - 1, 1))  # filled values add nothing to the squares
        out[s] = Scale(a[0], mean, np.where(deviation > 0, deviation, 1.0) if scale else np.ones(len(mean)))
    return out


# ---- Newton steps ----


def _shrunk(x: float, by: float) -> float:
    return math.copysign(max(abs(x) - by, 0.0), x)


def newton_step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, setting: Setting) -> np.ndarray:
    """The step to the minimum of the quadratic model with the penalties; the last weight has none."""
    p = len(w)
    free = np.append(np.ones(p - 1), 0.0)
    h = curvature + np.diag(setting.l2 * free + 1e-10 * max(np.trace(curvature) / p, 1e-10))
    g = gradient + setting.l2 * free * w
    if not setting.l1:
        return -np.linalg.solve(h, g)
    step, slope = np.zeros(p), g.copy()  # slope of the smooth part at the step
    for _ in range(1000):
        largest = 0.0
        for j in range(p):
            at = w[j] + step[j]
            target = at - slope[j] / h[j, j]
            new = _shrunk(target, setting.l1 / h[j, j]) if j < p - 1 else target
            if new != at:
                slope += h[:, j] * (new - at)
                step[j] += new - at
                largest = max(largest, abs(new - at))
        if largest <= 1e-12 * (1 + np.abs(w + step).max()):
            break
    return step


@dataclass
class _Fit:
    """Where one model stands: accepted weights, their objective, and the step under trial."""

    setting: Setting
    w: np.ndarray
    objective: float = math.inf
    step: np.ndarray | None = None
    length: float = 1.0
    decrease: float = 0.0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.w if self.step is None else self.w + self.length * self.step

    def _penalty(self, w: np.ndarray) -> float:
        return self.setting.l2 / 2 * float(w[:-1] @ w[:-1]) + self.setting.l1 * float(np.abs(w[:-1]).sum())

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Loss and derivatives at the trial weights are known: accept them or shorten the step."""
        w = self.trial()
        objective = loss + self._penalty(w)
        slack = 1e-12 * (1 + abs(objective))
        if self.step is not None and objective > self.objective + 1e-4 * self.length * self.decrease + slack:
            self.length /= 2
            self.done = self.length < 1e-10
            return
        self.w, self.objective, self.length = w, objective, 1.0
        self.step = newton_step(w, gradient, curvature, self.setting)
        smooth = gradient + self.setting.l2 * np.append(w[:-1], 0.0)
        self.decrease = float(smooth @ self.step) + self.setting.l1 * float(np.abs((w + self.step)[:-1]).sum() - np.abs(w[:-1]).sum())
        self.done = np.abs(self.step).max() <= TOLERANCE * (1 + np.abs(w).max()) or -self.decrease <= slack
        if self.setting.loss == "squares" and not self.setting.l1:
            self.w, self.done = w + self.step, True  # the quadratic model is the objective


def _fitted(df: DataFrame, members: Members, settings: Sequence[Setting], scales: Mapping[int, Scale]) -> dict[int, np.ndarray]:
    """Weights (settings x columns, intercept last) of every row set."""
    fits = {s: [_Fit(c, np.zeros(len(z.mean) + 1)) for c in settings] for s, z in scales.items()}
    for _ in range(MAX_PASSES):
        trials = {s: [(k, settings[k].loss, f.trial()) for k, f in enumerate(of) if not f.done] for s, of in fits.items()}
        trials = {s: t for s, t in trials.items() if t}
        if not trials:
            break
        open_sets = {key: {s for s in sets if s in trials} for key, sets in members.items()}

        def part(key: int, y: np.ndarray, values: np.ndarray, sums: dict[int, np.ndarray]) -> None:
            sign = 2 * y - 1
            for s in open_sets.get(key, ()):
                x = scales[s].ready(values)
                new = []
                for _, loss, w in trials[s]:
                    value, first, second = loss_terms(loss, sign, x @ w)
                    new += [[value.sum()], x.T @ first, ((x * second[:, None]).T @ x).reshape(-1)]
                flat = np.concatenate(new)
                sums[s] = sums[s] + flat if s in sums else flat

        for s, a in packed_sums(df, part, np.add).items():
            for (k, _, w), one in zip(trials[s], a.reshape(len(trials[s]), -1), strict=True):
                p = len(w)
                fits[s][k].take(float(one[0]), one[1 : p + 1], one[p + 1 :].reshape(p, p))
    return {s: np.stack([f.w for f in of]) for s, of in fits.items()}


# ---- models ----


def margin_weights(df: DataFrame, vector: Column, label: Column, setting: Setting) -> np.ndarray:
    """Weights, intercept last, of one model on arrays of numbers as they are."""
    rows = staged(packed_rows(df.select(F.lit(0).cast("long").alias("_key"), label.cast("double").alias("_y"), vector.alias("_v"))), "stacked")
    members = {0: [0]}
    return _fitted(rows, members, [setting], _scales(rows, members, False))[0][0]


def _values(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    number = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    return df.select(key.cast("long").alias("_key"), F.col(LABEL).cast("double").alias("_y"), number.alias("_v"))


@dataclass(frozen=True)
class Stacked:
    """Settings to fit on every row set, over these columns. ``calibrated`` maps margins to probabilities by a
    sigmoid fitted on ``folds`` parts that the margins' models have not seen; ``ids`` deal the rows to them."""

    columns: Sequence[str]
    settings: Sequence[Setting]
    scale: bool = True
    calibrated: bool = False
    ids: Sequence[str] = ()
    folds: int = 3

    def fit(self, df: DataFrame, key: str = "split", members: Members | None = None) -> StackedModel:
        """Fit on the labelled rows of ``df``; by default each value of ``key`` is a row set of its own."""
        if members is None:
            members = {int(r[0]): [int(r[0])] for r in df.select(key).distinct().collect()}
        sets = sorted({s for of in members.values() for s in of})
        if not self.calibrated:
            rows = staged(packed_rows(_values(df, self.columns, F.col(key))), "stacked")
            scales = _scales(rows, members, self.scale)
            return StackedModel(self, scales, _fitted(rows, members, self.settings, scales))
        # each row set without each of its parts, and the whole of it, are row sets as well
        n = self.folds
        part = F.pmod(hash_number(stable_hash(*self.ids)), F.lit(n))
        parted = staged(df.withColumn("_part", F.col(key).cast("long") * n + part), "parted")
        inner = {k * n + j: [s * (n + 1) + i for s in of for i in range(n + 1) if i != j] for k, of in members.items() for j in range(n)}
        plain = replace(self, calibrated=False).fit(parted, "_part", inner)
        pairs = [(k * n + j, s * (n + 1) + j) for k, of in members.items() for s in of for j in range(n)]
        unseen = df.sparkSession.createDataFrame(pairs, "_part long, _set long")  # as many rows as keys have row sets
        held = parted.join(F.broadcast(unseen), "_part")
        c = len(self.settings)
        margins = plain.score(held, "_set", "margin", raw=True).select(
            (F.expr(f"(_set div {n + 1})") * c + F.col("setting")).alias("_model"), LABEL, "margin")
        sigmoid = Stacked(["margin"], (Setting(),), scale=False).fit(margins, "_model", {s * c + k: [s * c + k] for s in sets for k in range(c)})
        whole = {s: s * (n + 1) + n for s in sets}
        return StackedModel(self, {s: plain.scales[t] for s, t in whole.items()}, {s: plain.weights[t] for s, t in whole.items()}, sigmoid)


@dataclass
class StackedModel:
    """Fitted weights of every row set and setting."""

    maker: Stacked
    scales: dict[int, Scale]
    weights: dict[int, np.ndarray] = field(repr=False)
    sigmoid: StackedModel | None = None

    def plain_weights(self, row_set: int, setting: int = 0) -> tuple[np.ndarray, float]:
        """Weights for unscaled columns, and the intercept."""
        scale, w = self.scales[row_set], self.weights[row_set][setting]
        plain = w[:-1] / scale.deviation
        return plain, float(w[-1] - plain @ scale.mean)

    def score(self, df: DataFrame, key: str = "split", name: str = "score", raw: bool = False) -> DataFrame:
        """Adds ``setting`` and the score by the models of row set ``key``: a probability, or the margin if the
        model has none or ``raw`` is set. A row appears once per setting; rows of other keys do not appear."""
        data = []
        for s in self.weights:
            for k, setting in enumerate(self.maker.settings):
                w, b = self.plain_weights(s, k)
                slope, shift = 1.0, 0.0
                if self.sigmoid is not None:
                    (slope,), shift = self.sigmoid.plain_weights(s * len(self.maker.settings) + k)
                likely = not raw and (self.sigmoid is not None or setting.loss == "logistic")
                data.append((s, k, w.tolist(), b, self.scales[s].mean.tolist(), float(slope), float(shift), likely))
        schema = "_s long, setting int, _w array<double>, _b double, _m array<double>, _a double, _c double, _p boolean"
        models = df.sparkSession.createDataFrame(data, schema)  # as many rows as models
        value = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.maker.columns])
        filled = F.zip_with(value, "_m", lambda v, m: F.coalesce(v, m))
        margin = F.aggregate(F.zip_with(filled, "_w", lambda v, w: v * w), F.col("_b"), lambda a, v: a + v)
        linear = F.col("_margin") if raw else F.col("_a") * F.col("_margin") + F.col("_c")
        joined = df.join(F.broadcast(models), F.col(key).cast("long") == F.col("_s")).withColumn("_margin", margin)
        score = F.when(F.col("_p"), 1 / (1 + F.exp(-linear))).otherwise(linear)
        return joined.withColumn(name, score).drop("_s", "_w", "_b", "_m", "_a", "_c", "_p", "_margin")


# ---- sliding windows of least squares ----


def day_grams(df: DataFrame, columns: Sequence[str], key: Column) -> dict[int, np.ndarray]:
    """Per key, the Gram matrix of (values with 0 for missing, missing flags, one, target -1 or 1), in one pass.

    Filling with a mean that is known later is linear in values and flags, so that the matrix of any set of
    days, filled with its own means, follows from the sum of theirs.
    """
    rows = _values(df, columns, key)

    def part(k: int, y: np.ndarray, values: np.ndarray, sums: dict[int, np.ndarray]) -> None:
        gone = np.isnan(values)
        x = np.hstack([np.where(gone, 0, values), gone, np.ones((len(y), 1)), 2 * y[:, None] - 1])
        gram = (x.T @ x).reshape(-1)
        sums[k] = sums[k] + gram if k in sums else gram

    p = 2 * len(columns) + 2
    return {k: a.reshape(p, p) for k, a in packed_sums(rows, part, np.add).items()}


def ridge_of_gram(gram: np.ndarray, alpha: float, scale: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and intercept for unscaled columns, and the means that fill them, from one Gram matrix."""
    d = len(gram) // 2 - 1
    n = gram[-2, -2]
    there = n - gram[d : 2 * d, -2]
    mean = gram[:d, -2] / np.maximum(there, 1)
    # filled and centred columns and the target, out of values, flags, ones and the target
    t = np.zeros((d + 1, 2 * d + 2))
    t[:d, :d], t[:d, d : 2 * d], t[:d, -2], t[d, -1] = np.eye(d), np.diag(mean), -mean, 1.0
    centred = t @ gram @ t.T
    deviation = np.sqrt(np.maximum(np.diag(centred)[:d], 0) / max(n - 1, 1))
    deviation = np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, 1.0) if scale else np.ones(d)
    h = centred[:d, :d] / np.outer(deviation, deviation) + np.diag(np.full(d, alpha + 1e-10))
    w = np.linalg.solve(h, centred[:d, d] / deviation) / deviation
    return w, float(gram[-2, -1] / max(n, 1) - w @ mean), mean


def sliding_ridge(df: DataFrame, columns: Sequence[str], windows: Mapping[int, Sequence[int]], alpha: float, key: Column) -> StackedModel:
    """Ridge models of windows of days (numbers of ``key``), from one pass over the rows: the sum of Gram matrices
    gains the days that enter a window and loses those that leave it."""
    grams = day_grams(df, columns, key)
    total = np.zeros((2 * len(columns) + 2,) * 2)
    held: set[int] = set()
    scales, weights = {}, {}
    for number, days in sorted(windows.items()):
        now = set(days) & set(grams)
        if len(now ^ held) > len(now):  # far from the last window: start again
            total, held = np.zeros_like(total), set()
        for d in sorted(now - held):
            total = total + grams[d]
        for d in sorted(held - now):
            total = total - grams[d]
        held = now
        w, b, mean = ridge_of_gram(total, alpha)
        scales[number] = Scale(float(total[-2, -2]), mean, np.ones(len(mean)))
        weights[number] = np.append(w, b + float(w @ mean))[None]
    return StackedModel(Stacked(columns, (Setting("squares", l2=alpha),)), scales, weights)
