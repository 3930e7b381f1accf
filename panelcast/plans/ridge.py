"""Ridge forecasters fitted from one Gram aggregation.

The data is read once: sums of products per fold.  Everything after that, five
folds, four penalties and twelve leads, is algebra on a few small matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import floor0, residual_forecast
from panelcast.schema import HORIZON, RIDGE_ALPHAS, RIDGE_FOLDS


def fold_of(idx: Column, n: int, folds: int = RIDGE_FOLDS) -> Column:
    """Contiguous folds over a dense index; the first n % folds are one longer."""
    small, extra = divmod(n, folds)
    head = extra * (small + 1)
    return F.when(idx < head, F.floor(idx / (small + 1))).otherwise(
        extra + F.floor((idx - head) / max(small, 1))).cast("int")


def _names(features, horizon):
    return ["one", *features], [f"y{k}" for k in range(1, horizon + 1)]


def gram(rows: DataFrame, features, targets: list[Column], by: str = "fold") -> DataFrame:
    """(fold, a, b, value): sums of a * b for inputs (with a constant) and targets.

    Products among inputs, of inputs with each target, and each target squared.
    """
    xs, ys = _names(features, len(targets))
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    pairs += [(a, y) for y in ys for a in xs] + [(y, y) for y in ys]
    inputs = rows.select(by, F.lit(1.0).alias("one"), *features, *[t.alias(y) for y, t in zip(ys, targets)])
    sums = inputs.groupBy(by).agg(*[F.expr(f"sum(`{a}` * `{b}`)").alias(f"{a}*{b}") for a, b in pairs])
    cells = ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'value', `{a}*{b}`)" for a, b in pairs)
    return sums.select(by, F.expr(f"inline(array({cells}))"))


@dataclass(frozen=True)
class RidgeFit:
    features: tuple[str, ...]
    alphas: tuple[float, ...]
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def linear(self, k: int) -> Column:
        """Linear predictor for lead k (1-based)."""
        out = F.lit(float(self.intercepts[k - 1]))
        for f, w in zip(self.features, self.weights[k - 1]):
            out = out + F.lit(float(w)) * F.col(f)
        return out

    def forecasts(self) -> list[Column]:
        return [F.greatest(self.linear(k + 1), F.lit(0.0)) for k in range(len(self.intercepts))]


def _solve(g: np.ndarray, gy: np.ndarray, alpha: float):
    """Intercept and weights from a Gram matrix with the constant first; intercept not penalised."""
    n, sx, sy = g[0, 0], g[0, 1:], gy[0]
    centred = g[1:, 1:] - np.outer(sx, sx) / n
    w = np.linalg.solve(centred + alpha * np.eye(len(sx)), gy[1:] - sx * sy / n)
    return (sy - w @ sx) / n, w


def _r2(g: np.ndarray, gy: np.ndarray, yy: float, b0: float, w: np.ndarray) -> float:
    c = np.concatenate([[b0], w])
    sse = yy - 2 * c @ gy + c @ g @ c
    sst = yy - gy[0] ** 2 / g[0, 0]
    return 1.0 - sse / sst if sst > 0 else (1.0 if sse <= 0 else 0.0)


def solve(folds: pd.DataFrame, features, horizon: int = HORIZON, alphas=RIDGE_ALPHAS, by: str = "fold") -> RidgeFit:
    """Pick the penalty per lead by mean fold score, then fit on all folds (first best wins).

    ``folds`` may hold sums of further features. What a fold leaves is the total less its own sums.
    """
    xs, ys = _names(features, horizon)
    at = {n: i for i, n in enumerate(xs)}
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for f, part in folds.groupby(by):
        g, gy, yy = np.zeros((len(xs),) * 2), np.zeros((len(xs), horizon)), np.zeros(horizon)
        for a, b, v in part[["a", "b", "value"]].itertuples(index=False):
            if a in at and b in at:
                g[at[a], at[b]] = g[at[b], at[a]] = v
            elif a in at and b in ys:
                gy[at[a], ys.index(b)] = v
            elif a in ys:
                yy[ys.index(b)] = v
        grams[f] = (g, gy, yy)
    total = [sum(x[i] for x in grams.values()) for i in range(3)]
    chosen, b0s, ws = [], [], []
    for k in range(horizon):
        best, best_score = alphas[0], -np.inf
        for alpha in alphas:
            scores = []
            for g, gy, yy in grams.values():
                b0, w = _solve(total[0] - g, total[1][:, k] - gy[:, k], alpha)
                scores.append(_r2(g, gy[:, k], yy[k], b0, w))
            score = float(np.mean(scores))
            if score > best_score:
                best, best_score = alpha, score
        b0, w = _solve(total[0], total[1][:, k], best)
        chosen.append(float(best)), b0s.append(float(b0)), ws.append(tuple(float(x) for x in w))
    return RidgeFit(tuple(features), tuple(chosen), tuple(b0s), tuple(ws))


def training_rows(indexed: DataFrame, split: str = "train", folds: int = RIDGE_FOLDS) -> DataFrame:
    """Training windows with their fold; training comes first in ``sample_idx``."""
    train = indexed.filter(F.col("split") == split)
    n, first = train.agg(F.count(F.lit(1)), F.min("sample_idx")).first()
    return train.withColumn("fold", fold_of(F.col("sample_idx") - F.lit(first or 0), n, folds))


def raw_targets(horizon: int = HORIZON) -> list[Column]:
    return [F.col("targets")[k] for k in range(horizon)]


def residual_targets(horizon: int = HORIZON, prior: str = "prior") -> list[Column]:
    return [F.log1p(F.col("targets")[k]) - F.log1p(F.col(prior)) for k in range(horizon)]


def fit_all(indexed: DataFrame, models: dict[str, tuple[str, ...]], targets: list[Column] | None = None) -> dict[str, RidgeFit]:
    """Several models on z-scored inputs of indexed training windows, from one pass: sums of all their features together."""
    targets = targets or raw_targets()
    features = list(dict.fromkeys(f for fs in models.values() for f in fs))
    folds = gram(training_rows(indexed), features, targets).toPandas()  # folds x a few hundred sums
    return {name: solve(folds, fs, len(targets)) for name, fs in models.items()}


def fit(indexed: DataFrame, features, targets: list[Column] | None = None) -> RidgeFit:
    return fit_all(indexed, {"": tuple(features)}, targets)[""]


def predict(windows: DataFrame, model: RidgeFit) -> DataFrame:
    return windows.withColumn("preds", F.array(*model.forecasts()))


def predict_residual(windows: DataFrame, model: RidgeFit, prior: str = "prior", scale: float = 0.5,
                     max_scale: float = 0.5) -> DataFrame:
    """Forecast from a fitted log residual on the prior."""
    out = [floor0(residual_forecast(F.col(prior), model.linear(k + 1), F.lit(scale), max_scale))
           for k in range(len(model.intercepts))]
    return windows.withColumn("preds", F.array(*out))


def long_predictions(windows: DataFrame, *keep: str) -> DataFrame:
    """(keep, lead, y, pred) from windows with ``targets`` and ``preds`` arrays."""
    return windows.select(*keep, F.posexplode(F.arrays_zip("targets", "preds")).alias("_i", "_z")).select(
        *keep, (F.col("_i") + 1).alias("lead"), F.col("_z.targets").alias("y"), F.col("_z.preds").alias("pred"))
