"""L1 logistic regression at many strengths and folds, in shared passes over the rows.

A search over 7 strengths and 5 folds needs 35 fits. Fitted one by one, each reads the
rows once per iteration. Here all fits move together: one pass sums loss, slopes and
curvature of every (fold, strength) that is still open, a row counting for all folds but
its own, and the driver takes one proximal Newton step for each: it minimises the
penalised quadratic model, and halves a step that the next pass finds not to lower the
penalised loss. All strengths of a fold start from one point with one curvature, so the
first step gives each the solution of that model, a whole path. A fit leaves the passes
once its slopes meet the optimality conditions.

What passes the driver is (fits x features squared) numbers per pass, never rows.
Statistics are summed by Spark before they get there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stayline.session import stage

# Task functions travel with the job: executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How far slopes may be from the optimality conditions, as a part of the penalty, and the
#: least distance that rounding lets a pass tell.
TOLERANCE, ROUNDING = 1e-2, 1e-9
MOST_PASSES = 300


@dataclass
class PathFit:
    """One (fold, C): coefficients of the standardised features, how far the slopes are from
    optimal, and accuracy on the fold. ``fold`` is None where no row was held out."""

    fold: int | None
    c: float
    coefficients: np.ndarray
    intercept: float
    miss: float
    rows: int
    held: int = 0
    right: int = 0

    @property
    def solved(self) -> bool:
        return self.miss <= max(TOLERANCE / (self.c * self.rows), ROUNDING)


@dataclass
class Path:
    fits: list[PathFit] = field(default_factory=list)
    passes: int = 0

    def accuracy(self, c: float) -> float:
        """Mean over folds that hold somebody and leave two classes; 0 without any."""
        own = [f.right / f.held for f in self.fits if f.c == c and f.held]
        return float(np.mean(own)) if own else 0.0


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x")
    return (batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy(),
            x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))


def _summed(rows: DataFrame, add, size: int) -> np.ndarray:
    """Sum of what ``add(y, fold, x)`` gives per batch, a vector of ``size``: over each task
    there, over tasks by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(*_rows(batch))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _moments(centre: np.ndarray, folds: int):
    """Per fold: rows, positives, sums and products of the centred features."""
    d = len(centre)

    def add(y: np.ndarray, fold: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((folds, 2 + d + d * d))
        u = x - centre
        for f in np.unique(fold):
            own = fold == f
            out[f, 0], out[f, 1] = own.sum(), y[own].sum()
            out[f, 2:2 + d] = u[own].sum(axis=0)
            out[f, 2 + d:] = (u[own].T @ u[own]).ravel()
        return out.ravel()

    return add


def _margins(weights: np.ndarray, bias: np.ndarray, centre: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x - centre) @ weights.T + bias


def _slopes(weights: np.ndarray, bias: np.ndarray, of: np.ndarray, centre: np.ndarray):
    """Per fit the sums of losses, slopes and curvatures in (1, centred features)."""
    def add(y: np.ndarray, fold: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = []
        ones = np.concatenate([np.ones((len(x), 1)), x - centre], axis=1)
        margin = _margins(weights, bias, centre, x)
        counts = fold[:, None] != of[None, :]
        share = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        loss = np.logaddexp(0, np.where(y[:, None] > 0.5, -margin, margin))
        for k in range(len(of)):
            rows = counts[:, k]
            own, p = ones[rows], share[rows, k]
            out.append(np.concatenate([
                [loss[rows, k].sum()], own.T @ (p - y[rows]), ((own * (p * (1 - p))[:, None]).T @ own).ravel()]))
        return np.concatenate(out)

    return add


def _right(weights: np.ndarray, bias: np.ndarray, of: np.ndarray, centre: np.ndarray):
    """Per fit the rows of its fold that it gets right."""
    def add(y: np.ndarray, fold: np.ndarray, x: np.ndarray) -> np.ndarray:
        right = (_margins(weights, bias, centre, x) > 0) == (y[:, None] > 0.5)
        return (right & (fold[:, None] == of[None, :])).sum(axis=0).astype(float)

    return add


def _model_step(at: np.ndarray, slope: np.ndarray, curve: np.ndarray, penalty: float) -> np.ndarray:
    """Minimum of the penalised quadratic model around ``at`` for one fit, by active sets.

    The coefficients in play, with their signs, give a linear system. Where its solution
    would change a sign, the way there stops at the first zero and that one leaves; where
    all is solved, the coefficient that breaks its condition most comes in. Entry 0 is the
    intercept, which has no penalty and always plays.
    """
    new, cost = at.copy(), np.r_[0.0, np.full(len(at) - 1, penalty)]
    open_ = np.diag(curve) > 0
    sign = np.sign(new)
    playing = (sign != 0) & open_
    new[~playing], playing[0] = 0.0, open_[0]
    for _ in range(20 * len(at)):
        pull = slope + curve @ (new - at)
        own = np.nonzero(playing)[0]
        move = np.zeros_like(new)
        move[own] = np.linalg.lstsq(curve[np.ix_(own, own)], -(pull + cost * sign)[own], rcond=1e-15)[0]
        crossing = [j for j in own if j and (new[j] + move[j]) * sign[j] < 0]
        if crossing:
            reach = np.array([-new[j] / move[j] if move[j] else 0.0 for j in crossing])
            first = crossing[int(reach.argmin())]
            new += max(float(reach.min()), 0.0) * move
            new[first], sign[first], playing[first] = 0.0, 0.0, False
            continue
        new += move
        pull = slope + curve @ (new - at)
        excess = np.where(playing | ~open_, 0.0, np.abs(pull) - penalty)
        worst = int(excess.argmax())
        if excess[worst] <= 1e-4 * penalty:
            break
        playing[worst], sign[worst] = True, -np.sign(pull[worst])
    return new


def _penalised(at: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return penalty * np.abs(at[:, 1:]).sum(axis=1)


def _miss(at: np.ndarray, slope: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The greatest departure from the optimality conditions, per fit."""
    w, g = at[:, 1:], slope[:, 1:]
    still = np.maximum(np.abs(g) - penalty[:, None], 0)
    moving = np.abs(g + penalty[:, None] * np.sign(w))
    return np.maximum(np.where(w == 0, still, moving).max(axis=1, initial=0), np.abs(slope[:, 0]))


def lasso_path(
    df: DataFrame, features: Sequence[str], strengths: Sequence[float], folds: int, held_out: bool = True,
    most_passes: int = MOST_PASSES,
) -> Path:
    """All fits of ``strengths`` (inverse penalties on summed losses, as C) and folds.

    ``df`` has ``y`` (0 or 1), ``fold`` (0 to folds - 1) and the features. Without
    ``held_out`` there is one fit per strength, over all rows. A fold whose other rows are
    of one class has no fits. Features that do not vary get no coefficient.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = stage(df.select(F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), x.alias("x")), "path")
    d = len(features)
    means = rows.agg(*[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(d)]).first()
    centre = np.array([means[j] or 0.0 for j in range(d)])
    sums = _summed(rows, _moments(centre, folds), folds * (2 + d + d * d)).reshape(folds, -1)
    path = Path(passes=2)
    fits, turns = [], []
    for fold in range(folds) if held_out else [None]:
        own = sums.sum(axis=0) - (sums[fold] if fold is not None else 0)
        n, positives = own[0], own[1]
        if n < 2 or not 0 < positives < n:
            continue
        mean = own[2:2 + d] / n
        spread = np.sqrt(np.maximum(np.diag(own[2 + d:].reshape(d, d)) / n - mean**2, 0) * n / (n - 1))
        # The deviation has divisor n - 1, as in the saved model's scaler.
        scale = np.divide(1.0, spread, out=np.zeros(d), where=spread > 1e-12 * (1 + np.abs(centre + mean)))
        turn = np.zeros((d + 1, d + 1))
        turn[0, 0], turn[1:, 0], turn[1:, 1:] = 1, -mean * scale, np.diag(scale)
        for c in strengths:
            fits.append(PathFit(fold, c, np.zeros(d), np.log(positives / (n - positives)), np.inf, int(n)))
            turns.append(turn)
    if not fits:
        return path
    # (1, standardised features) = turn . (1, centred features), for the rows of each fit.
    turn = np.array(turns)
    n = np.array([f.rows for f in fits], float)
    penalty = 1 / (np.array([f.c for f in fits]) * n)
    of = np.array([-1 if f.fold is None else f.fold for f in fits])
    at = np.zeros((len(fits), d + 1))
    at[:, 0] = [f.intercept for f in fits]
    way, step, value, hope = np.zeros_like(at), np.ones(len(fits)), np.full(len(fits), np.inf), np.zeros(len(fits))

    def raw(rows_of: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercept for the centred features as they are in the rows."""
        both = np.einsum("kij,ki->kj", turn[rows_of], point)
        return both[:, 1:], both[:, 0]

    live = np.arange(len(fits))
    while len(live) and path.passes < most_passes:
        trial = at[live] + step[live, None] * way[live]
        size = 1 + (d + 1) * (d + 2)
        found = _summed(rows, _slopes(*raw(live, trial), of[live], centre), len(live) * size).reshape(len(live), size)
        path.passes += 1
        loss = found[:, 0] / n[live] + _penalised(trial, penalty[live])
        lower = loss <= value[live] + 1e-4 * step[live] * hope[live] + 1e-13 * np.abs(loss)
        step[live] = np.where(lower, 1.0, step[live] / 2)
        new = live[lower]
        at[new], value[new] = trial[lower], loss[lower]
        slope = np.einsum("kij,kj->ki", turn[new], found[lower, 1:d + 2]) / n[new, None]
        curve = turn[new] @ found[lower, d + 2:].reshape(-1, d + 1, d + 1) @ turn[new].transpose(0, 2, 1) / n[new, None, None]
        for k, m in zip(new, _miss(at[new], slope, penalty[new])):
            fits[k].miss = float(m)
        still = np.einsum("kjj->kj", curve) > 1e-14
        curve = curve + 1e-10 * np.eye(d + 1) * still[:, :, None]
        goal = np.array([_model_step(*k) for k in zip(at[new], slope, curve, penalty[new])]).reshape(len(new), d + 1)
        way[new] = goal - at[new]
        hope[new] = (slope * way[new]).sum(axis=1) + _penalised(goal, penalty[new]) - _penalised(at[new], penalty[new])
        live = np.array([k for k in live if not fits[k].solved and step[k] > 1e-9], int)
    for k, fit in enumerate(fits):
        fit.coefficients, fit.intercept = at[k, 1:].copy(), float(at[k, 0])
    if held_out:
        everyone = np.arange(len(fits))
        right = _summed(rows, _right(*raw(everyone, at), of, centre), len(fits))
        path.passes += 1
        for fit, r in zip(fits, right):
            fit.held, fit.right = int(sums[fit.fold, 0]), int(round(r))
    path.fits = fits
    return path
