"""Temperature scaling, calibration error and reliability bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.probability import argmax, cross_entropy, softmax
from vulnspark.functions.text import let

BINS = 15


def bin_edges(n_bins: int = BINS) -> list[float]:
    """Bin edges as multiples of the step; values on an edge belong to the bin below it."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def bin_of(confidence: Column, n_bins: int = BINS) -> Column:
    """1-based bin holding a confidence; 0 for a confidence of exactly 0."""
    below = [F.when(confidence > edge, 1).otherwise(0) for edge in bin_edges(n_bins)[:-1]]
    return sum(below[1:], below[0])


def scored(rows: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Adds `confidence` and `correct` to rows of (logits, y_true)."""
    probs = softmax(F.col("logits"), temperature)
    return rows.withColumn("_probs", probs).select(
        *rows.columns,
        F.array_max("_probs").alias("confidence"),
        (argmax(F.col("_probs")) == F.col("y_true")).cast("double").alias("correct"),
    )


def _binned(rows: DataFrame, by: list[str], n_bins: int) -> DataFrame:
    return (
        rows.withColumn("bin", bin_of(F.col("confidence"), n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("confidence").alias("mean_confidence"),
            F.avg("correct").alias("accuracy"),
        )
    )


def expected_calibration_error(
    rows: DataFrame, by: list[str] = (), n_bins: int = BINS
) -> DataFrame:
    """Confidence-accuracy gap weighted by bin share, from rows of `scored`."""
    gap = F.when(
        F.col("bin") > 0, F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    ).otherwise(0.0)
    return (
        _binned(rows, list(by), n_bins)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            (F.sum(gap) / F.sum("n")).alias("ece"),
        )
    )


def reliability_bins(rows: DataFrame, n_bins: int = BINS) -> DataFrame:
    """Every bin with its bounds and count; empty bins keep null means."""
    edges = F.lit(bin_edges(n_bins))
    dim = rows.sparkSession.range(1, n_bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        edges[F.col("id").cast("int") - 1].alias("bin_lower"),
        edges[F.col("id").cast("int")].alias("bin_upper"),
    )
    return (
        dim.join(_binned(rows, [], n_bins), "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("bin", "bin_lower", "bin_upper", "n", "mean_confidence", "accuracy")
    )


def temperature_grid(low: float = 0.05, high: float = 20.0, points: int = 48) -> list[float]:
    """Temperatures evenly spaced in log T."""
    step = (math.log(high) - math.log(low)) / (points - 1)
    return [math.exp(math.log(low) + i * step) for i in range(points)]


def fit_temperature(rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """The grid temperature with the least mean cross-entropy, in one pass.

    Every row meets every grid point, but averages combine inside the task, so a task sends
    one row per grid point whatever its input. Temperature 1 rides along as `nll_before`.
    """
    points = F.lit([1.0, *(grid or temperature_grid())])
    losses = (
        rows.select("logits", "y_true", F.posexplode(points).alias("point", "t"))
        .groupBy("point", "t")
        .agg(
            F.count("*").alias("n"),
            F.avg(cross_entropy(F.col("logits"), F.col("y_true"), F.col("t"))).alias("nll"),
        )
    )
    on_grid = F.when(F.col("point") > 0, F.struct("nll", "t"))
    return losses.agg(
        F.min(on_grid)["t"].alias("temperature"),
        F.max(F.when(F.col("point") == 0, F.col("nll"))).alias("nll_before"),
        F.min(on_grid)["nll"].alias("nll_after"),
        F.max("n").alias("n"),
    )


def fit_temperature_refined(rows: DataFrame, rounds: int = 4, widest: float = 1e6) -> float:
    """Repeat the grid pass around the minimum until its step is far below 1e-4.

    A minimum at an edge of the first grid widens that side until it lies inside. Losses that
    still fall at `widest` (or its inverse) have no minimum, which is an error."""
    low, high, points = 0.05, 20.0, 24
    best = fit_temperature(rows, temperature_grid(low, high, points)).first()["temperature"]
    while best is not None and (best <= low * 1.0001 or best >= high / 1.0001):
        if max(high, 1 / low) >= widest:
            raise ValueError(f"no temperature between {low:g} and {high:g} is the best one")
        low, high = (low / 20, low * 2) if best <= low * 1.0001 else (high / 2, high * 20)
        best = fit_temperature(rows, temperature_grid(low, high, points)).first()["temperature"]
    if best is None:
        raise ValueError("no rows to fit a temperature on")
    for _ in range(rounds - 1):
        width = (high / low) ** (1 / (points - 1))
        low, high = best / width, best * width
        best = fit_temperature(rows, temperature_grid(low, high, points)).first()["temperature"]
    return best


def calibration_transfer(
    rows: DataFrame, temperature: float, by: str = "set_name", gap_over: float = 0.1
) -> DataFrame:
    """Does a fitted temperature carry over to each test set? `rows`: by, logits, y_true."""
    # Both temperatures in one pass: every row is binned once under each of them.
    both = rows.withColumn("fitted", F.explode(F.array(F.lit(False), F.lit(True))))
    at = F.when(F.col("fitted"), F.lit(float(temperature))).otherwise(F.lit(1.0))
    cells = _binned(scored(both, at), [by, "fitted"], BINS)
    gap = F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).otherwise(0.0)
    of = lambda fitted, value: F.sum(F.when(F.col("fitted") == fitted, value))
    n = of(True, F.col("n"))
    sets = cells.groupBy(by).agg(
        n.alias("n"),
        (of(True, F.col("n") * F.col("accuracy")) / n).alias("accuracy"),
        (of(True, F.col("n") * F.col("mean_confidence")) / n).alias("mean_confidence"),
        (of(False, gap) / n).alias("ece_before"),
        (of(True, gap) / n).alias("ece_after"),
    )
    return sets.withColumn("overconfident", F.col("mean_confidence") - F.col("accuracy") > gap_over)


def _slopes(log_t: float) -> tuple[Column, Column, Column]:
    """Cross-entropy of a row at log T, and its first and second derivative by log T."""
    t = F.lit(math.exp(log_t))

    def of(v: Column) -> Column:
        p, s, own = v["p"], v["s"], v["s"][F.col("y_true")]
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        mean = dot(p, s)
        spread = dot(p, F.transform(s, lambda x: x * x)) - mean * mean
        return F.struct((own - mean).alias("first"), (spread - own + mean).alias("second"))

    scaled = F.struct(softmax(F.col("logits"), t).alias("p"), F.transform("logits", lambda x: x / t).alias("s"))
    slopes = let(scaled, of)
    return cross_entropy(F.col("logits"), F.col("y_true"), t), slopes["first"], slopes["second"]


def fit_temperature_newton(
    rows: DataFrame, tolerance: float = 1e-9, rounds: int = 60, widest: float = 1e6
) -> DataFrame:
    """The temperature where the mean cross-entropy has slope zero, by Newton steps on log T.

    A step is one aggregate to a single row: mean loss, slope and curvature. The slope's sign
    brackets the minimum, and a step that would leave the bracket halves it instead (or doubles
    the reach while one side is open). (temperature, nll_before, nll_after, gradient, n); a loss
    that still falls at `widest` or its inverse has no minimum, which is an error. No rows give a
    null temperature.
    """
    log_t, low, high = 0.0, None, None
    before = after = slope = None
    n = 0
    for _ in range(rounds):
        loss, first, second = _slopes(log_t)
        stats = rows.agg(
            F.avg(loss).alias("loss"), F.avg(first).alias("first"), F.avg(second).alias("second"), F.count("*").alias("n")
        ).first()
        n, after, slope = stats.n, stats.loss, stats.first
        before = after if before is None else before
        if not n or abs(slope) < tolerance:
            break
        low, high = (log_t, high) if slope < 0 else (low, log_t)
        step = log_t - slope / stats.second if stats.second > 0 else None
        inside = step is not None and (low is None or step > low) and (high is None or step < high) and abs(step - log_t) < 2
        if inside:
            log_t = step
        elif low is not None and high is not None:
            log_t = (low + high) / 2
        else:
            log_t += 1.0 if slope < 0 else -1.0
        if abs(log_t) > math.log(widest):
            raise ValueError(f"no temperature between {1 / widest:g} and {widest:g} is the best one")
    return rows.sparkSession.createDataFrame(
        [(math.exp(log_t) if n else None, before, after, slope, n)],
        "temperature double, nll_before double, nll_after double, gradient double, n bigint",
    )
