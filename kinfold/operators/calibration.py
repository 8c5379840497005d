"""Calibration of scores: fits from aggregates, application as expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped_logit(p: Column, eps: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def fit_logistic(scored: DataFrame, terms: list[Column], ridge: float = 1e-8, rounds: int = 100, positive: tuple[int, ...] = ()) -> list[float]:
    """Coefficients (terms, then offset) of a logistic model by Newton steps with halving.

    A step is one aggregation of gradient and Hessian over the data; only these few sums reach the
    driver.  ``positive`` lists terms whose coefficient must stay above zero.  ``scored`` has ``label``.
    """
    k = len(terms) + 1
    x = [*terms, F.lit(1.0)]
    beta = np.array([1.0 if i in positive else 0.0 for i in range(k - 1)] + [0.0])

    def sums(b: np.ndarray):
        eta = sum((float(c) * t for c, t in zip(b, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        loss = F.sum(F.log1p(F.exp(-F.abs(eta))) + F.greatest(eta, F.lit(0.0)) - F.col("label") * eta)
        g = [F.sum((F.col("label") - p) * t) for t in x]
        h = [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        row = scored.agg(loss, *g, *h).first()
        hess = np.zeros((k, k))
        for (i, j), v in zip([(i, j) for i in range(k) for j in range(i, k)], row[k + 1:]):
            hess[i, j] = hess[j, i] = v
        return row[0], np.array(row[1:k + 1]), hess

    loss, grad, hess = sums(beta)
    if loss is None:
        return [0.0] * k
    for _ in range(rounds):
        step = np.linalg.solve(hess + ridge * np.eye(k), grad - ridge * beta)
        size = 1.0
        while size > 1e-6:
            new = beta + size * step
            if all(new[i] > 0 for i in positive):
                loss2, grad2, hess2 = sums(new)
                if loss2 <= loss + 1e-12:
                    break
            size /= 2
        else:
            break
        done = abs(loss - loss2) <= 1e-10 * max(1.0, abs(loss))
        beta, loss, grad, hess = new, loss2, grad2, hess2
        if done:
            break
    return [float(b) for b in beta]


def sigmoid_apply(score: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(slope * clipped_logit(score) + offset)))


def fit_sigmoid(scored: DataFrame) -> tuple[float, float]:
    """Slope (above 0) and offset on the logit of ``score``."""
    a, b = fit_logistic(scored, [clipped_logit(F.col("score"))], positive=(0,))
    return a, b


def beta_apply(score: Column, alpha: float, beta: float, gamma: float, eps: float = 1e-9) -> Column:
    s = F.least(F.greatest(score, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-(alpha * F.log(s) - beta * F.log(1 - s) + gamma)))


def fit_beta(scored: DataFrame, eps: float = 1e-9) -> tuple[float, float, float]:
    s = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    a, b, g = fit_logistic(scored, [F.log(s), -F.log(1 - s)], positive=(0, 1))
    return a, b, g


def pool(rows) -> list[list[float]]:
    """Blocks (upper score, sum of labels, number) of rows in order of score, neighbours pooled until rates rise."""
    blocks: list[list[float]] = []
    for upper, y, n in rows:
        blocks.append([upper, float(y), float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            upper, y, n = blocks.pop()
            blocks[-1] = [upper, blocks[-1][1] + y, blocks[-1][2] + n]
    return blocks


def fit_isotonic(scored: DataFrame) -> list[tuple[float, float]]:
    """Steps (upper bound, value) of the pooled-adjacent-violators fit, exact at any size.

    Equal scores are merged first.  Ranges of scores are pooled by themselves, in parallel: what is
    pooled within a range is pooled in the whole fit too, so only the blocks left, far fewer than
    scores, reach the driver, which pools across ranges.
    """
    grouped = scored.groupBy("score").agg(F.sum("label").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))

    def within(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3))))
        blocks = pool(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in blocks], pa.float64()) for i in range(3)], names=["score", "y", "n"])

    parts = grouped.select(F.col("score").cast("double").alias("score"), "y", "n").filter("score is not null").repartitionByRange("score").sortWithinPartitions("score")
    found = parts.mapInArrow(within, "score double, y double, n double").collect()
    return [(b[0], b[1] / b[2]) for b in pool(sorted(tuple(r) for r in found))]


def isotonic_apply(score: Column, steps: list[tuple[float, float]]) -> Column:
    """Value of the first step whose upper bound is not below the score; the last step beyond all."""
    table = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in steps])
    hit = F.filter(table, lambda s: s["u"] >= score)
    return F.when(score.isNotNull(), F.coalesce(F.try_element_at(hit, F.lit(1))["v"], F.lit(float(steps[-1][1]))))


#: Upper ends of ten bins of equal width; a score on an end belongs to the bin it closes on the left.
EDGES = tuple(i / 10 for i in range(11))


def reliability_bin(p: Column) -> Column:
    out = F.when(p < EDGES[1], 0)
    for i in range(1, 9):
        out = out.when(p < EDGES[i + 1], i)
    return out.otherwise(9)


def reliability(scored: DataFrame) -> DataFrame:
    """(bin, pairs, mean_probability, observed_rate) over ten bins, the last closed; empty bins are absent."""
    return scored.groupBy(reliability_bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("score").alias("mean_probability"), F.avg("label").alias("observed_rate"))


def calibration_errors(scored: DataFrame) -> DataFrame:
    """One row: brier, ece, mce."""
    bins = reliability(scored)
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
    e = bins.agg((F.sum(F.col("pairs") * gap) / F.sum("pairs")).alias("ece"), F.max(gap).alias("mce"))
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier")).crossJoin(e)  # two single rows


def calibration_line(scored: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of labels on the logit of the score: 0 and 1 for calibrated scores."""
    slope, intercept = fit_logistic(scored, [clipped_logit(F.col("score"))])
    return intercept, slope


def calibration_diagnostics(scored: DataFrame) -> DataFrame:
    """One row: brier, ece, mce, mean_probability, observed_rate, intercept, slope."""
    intercept, slope = calibration_line(scored)
    mean = scored.agg(F.avg("score").alias("mean_probability"), F.avg("label").alias("observed_rate"))
    return calibration_errors(scored).crossJoin(mean).withColumns({"intercept": F.lit(intercept), "slope": F.lit(slope)})  # single rows


def select_calibrator(reports: list[tuple[str, float, float]], by: str = "brier") -> str:
    """Name of the best (name, brier, ece), ties by the other figure and then by name."""
    order = (1, 2) if by == "brier" else (2, 1)
    return min(reports, key=lambda r: (r[order[0]], r[order[1]], r[0]))[0]


def select_champion(reports: list[dict], by: str = "average_precision") -> dict:
    """Best of at least two models validated alike: higher average precision, lower Brier, then names."""
    if len(reports) < 2 or len({r["contract"] for r in reports}) != 1:
        raise ValueError("at least two models with one validation contract")
    first = (lambda r: (-r["average_precision"], r["brier"])) if by == "average_precision" else (lambda r: (r["brier"], -r["average_precision"]))
    return min(reports, key=lambda r: (*first(r), r["family"], r["id"], r["version"]))


@dataclass(frozen=True)
class Calibrator:
    """A fitted map from scores to probabilities; ``name`` is none where nothing could be fitted."""

    name: str = "none"
    parameters: tuple = ()

    def apply(self, score: Column) -> Column:
        if self.name == "sigmoid":
            return sigmoid_apply(score, *self.parameters)
        if self.name == "beta":
            return beta_apply(score, *self.parameters)
        if self.name == "isotonic":
            return isotonic_apply(score, list(self.parameters))
        return score


def choose_calibrator(calibration: DataFrame, validation: DataFrame, by: str = "brier") -> Calibrator:
    """The calibrator, fitted on the one, that does best on the other; rows are (score, label).

    Without both labels in the first nothing is fitted; without rows in the second the sigmoid is
    taken, which has the fewest parameters.
    """
    low, high = calibration.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return Calibrator()
    fitted = [Calibrator("sigmoid", fit_sigmoid(calibration)), Calibrator("beta", fit_beta(calibration)), Calibrator("isotonic", tuple(fit_isotonic(calibration)))]
    reports = []
    for c in fitted:
        r = calibration_errors(validation.select(c.apply(F.col("score")).alias("score"), "label")).first()
        if r["brier"] is None:
            return fitted[0]
        reports.append((c.name, r["brier"], r["ece"]))
    best = select_calibrator(reports, by)
    return next(c for c in fitted if c.name == best)
