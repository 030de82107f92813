"""Training with the binary focal loss.

A logistic model of flat windows is fitted to the mean focal loss plus an L2
penalty. Each evaluation is one distributed pass: a task adds up its Arrow batches and
emits one row per coordinate, which are summed by coordinate, so what
reaches the driver is as long as the weights, whatever the number of windows.
The driver keeps the last few steps (limited-memory BFGS) and tries all step lengths of a
line search in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.operators import ml, ranking
from wardline.session import reliable_checkpoint

HISTORY = 6
STEPS = 0.5 ** np.arange(-1, 9)
ENOUGH = 1e-4  # share of the expected fall that a step must bring


@dataclass
class FocalModel:
    """Weights of a flat window and the intercept; called with windows (n, steps, channels) it gives probabilities."""

    weights: np.ndarray
    intercept: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x.reshape(len(x), -1) @ self.weights + self.intercept)))


def focal_rows(z: np.ndarray, y: np.ndarray, alpha: float, gamma: float, eps: float = vocab.FOCAL_EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its derivative by the score ``z``; 0 where the probability is clipped."""
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    clipped = np.clip(p, eps, 1 - eps)
    y = y.reshape(-1, *[1] * (z.ndim - 1))
    right = np.where(y == 1, clipped, 1 - clipped)
    share = np.where(y == 1, alpha, 1 - alpha)
    loss = -share * (1 - right) ** gamma * np.log(right)
    slope = share * (1 - right) ** gamma * (gamma * right * np.log(right) - (1 - right))
    return loss, np.where(p == clipped, np.where(y == 1, slope, -slope), 0.0)


def _totals(data: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all windows of ``of``(flat windows, labels), a vector of ``size`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("X").flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                total += of(x, b.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["j", "v"])

    out = np.zeros(size)
    for r in data.mapInArrow(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = r["v"]
    return out


def loss_and_gradient(data: DataFrame, w: np.ndarray, reg: float = 0.0, alpha: float = vocab.FOCAL_ALPHA,
                      gamma: float = vocab.FOCAL_GAMMA) -> tuple[float, np.ndarray]:
    """Mean focal loss of windows (X, y) plus penalty, and its gradient; the last of ``w`` is the intercept (not penalised)."""
    def of(x, y):
        loss, slope = focal_rows(x @ w[:-1] + w[-1], y, alpha, gamma)
        return np.concatenate([[len(y), loss.sum()], slope @ x, [slope.sum()]])

    n, loss, *gradient = _totals(data, of, len(w) + 2)
    if not n:
        raise ValueError("no training windows")
    kept = np.append(w[:-1], 0.0)
    return loss / n + reg / 2 * kept @ kept, np.array(gradient) / n + reg * kept


def losses(data: DataFrame, ws: np.ndarray, reg: float, alpha: float, gamma: float) -> np.ndarray:
    """Penalised mean loss at each of the weight vectors ``ws`` (k, weights), in one pass."""
    def of(x, y):
        return np.append(focal_rows(x @ ws[:, :-1].T + ws[:, -1], y, alpha, gamma)[0].sum(axis=0), len(y))

    *total, n = _totals(data, of, len(ws) + 1)
    return np.array(total) / n + reg / 2 * (ws[:, :-1] ** 2).sum(axis=1)


def _direction(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Descent direction from the gradient and the last (step, change of gradient) pairs."""
    q, used = gradient.copy(), []
    for s, g in reversed(moves):
        a = s @ q / (s @ g)
        q -= a * g
        used.append(a)
    if moves:
        s, g = moves[-1]
        q *= s @ g / (g @ g)
    for (s, g), a in zip(moves, reversed(used), strict=True):
        q += (a - g @ q / (s @ g)) * s
    return -q


def fit(data: DataFrame, size: int, reg: float = 0.0, max_iter: int = 25, alpha: float = vocab.FOCAL_ALPHA, gamma: float = vocab.FOCAL_GAMMA,
        tol: float = 1e-6) -> FocalModel:
    """Minimise the penalised mean loss over windows (X, y) of ``size`` values."""
    w, moves = np.zeros(size + 1), []
    loss, gradient = loss_and_gradient(data, w, reg, alpha, gamma)
    for _ in range(max_iter):
        if np.abs(gradient).max() < tol:
            break
        d = _direction(gradient, moves)
        tries = w + STEPS[:, None] * d
        found = losses(data, tries, reg, alpha, gamma)
        good = np.flatnonzero(found <= loss + ENOUGH * STEPS * (gradient @ d))
        if not len(good):
            break
        best = good[found[good].argmin()]
        new_loss, new_gradient = loss_and_gradient(data, tries[best], reg, alpha, gamma)
        s, g = tries[best] - w, new_gradient - gradient
        if s @ g > 1e-12:
            moves = [*moves, (s, g)][-HISTORY:]
        w, loss, gradient = tries[best], new_loss, new_gradient
    return FocalModel(w[:-1], float(w[-1]))


def train_focal_classifier(windows: DataFrame, label: str = "y", reg: Sequence[float] = (0.0, 0.001, 0.01), max_iter: int = 25,
                           alpha: float = vocab.FOCAL_ALPHA, gamma: float = vocab.FOCAL_GAMMA) -> tuple[FocalModel, DataFrame]:
    """K3: fit on train windows for each penalty, choose by AUROC on the validation windows; (model, table of candidates)."""
    data = reliable_checkpoint(windows.select("split", "X", F.col(label).alias("y")))
    train, val = data.filter("split = 'train'").select("X", "y"), data.filter("split = 'val'").select("X", "y")
    head = train.select(F.size(F.flatten("X")).alias("n")).first()
    if head is None:
        raise ValueError("no training windows")
    best, rows = None, []
    for r in reg:
        model = fit(train, head["n"], r, max_iter, alpha, gamma)
        scored = ml.score(val, model).select("y", F.col("probability").alias("score"))
        auc = ranking.auroc_auprc(ranking.cumulative_desc(ranking.score_histogram(scored))).first()["auroc"]
        rows.append((float(r), auc))
        if best is None or (auc is not None and (best[1] is None or auc > best[1])):
            best = (model, auc)
    return best[0], windows.sparkSession.createDataFrame(rows, "reg_param double, val_auroc double")
