"""Confusion counts, detection scores, order statistics and comparisons of methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import constants as K


def confusion(decisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(…by, n, tp, tn, fp, fn) of rows (approved, expected); positive is fraud."""
    wrong = F.col("approved") != F.col("expected")
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~wrong & ~F.col("expected")).alias("tp"),
        F.count_if(~wrong & F.col("expected")).alias("tn"),
        F.count_if(wrong & ~F.col("approved")).alias("fp"),
        F.count_if(wrong & F.col("approved")).alias("fn"),
    )


def weighted_error(http_errors: Column | None = None) -> Column:
    e = F.col("fp") + K.FALSE_NEGATIVE_COST * F.col("fn")
    return e + 5 * http_errors if http_errors is not None else e


def fail_rate() -> Column:
    return F.coalesce(F.try_divide(F.col("fp") + F.col("fn"), F.col("n")), F.lit(0.0))


def accuracy() -> Column:
    return F.coalesce(F.try_divide(100.0 * (F.col("tp") + F.col("tn")), F.col("n")), F.lit(0.0))


def det_score() -> Column:
    """1000 log10(1/eps) - 300 log10(1+E), eps the error per row but 0.001 at least; -3000 beyond 15 % failures."""
    epsilon = F.greatest(F.coalesce(F.try_divide(weighted_error(), F.col("n")), F.lit(0.0)), F.lit(K.LEAST_EPSILON))
    score = 1000 * F.log10(1 / epsilon) - 300 * F.log10(1 + weighted_error())
    return F.when(fail_rate() > K.MOST_FAILURES, F.lit(K.FLOOR_SCORE)).otherwise(score)


def det_score_projected(size: int = K.TEST_SET_SIZE) -> Column:
    """The score with the error projected to a test set of ``size``; no cut-off, 3000 without errors."""
    epsilon = F.coalesce(F.try_divide(weighted_error(), F.col("n")), F.lit(0.0))
    bounded = F.greatest(epsilon, F.lit(K.LEAST_EPSILON))
    return F.when(epsilon <= 0, F.lit(3000.0)).otherwise(1000 * F.log10(1 / bounded) - 300 * F.log10(1 + epsilon * size))


def p99_score(p99_ms: Column) -> Column:
    score = 1000 * F.log10(1000 / F.greatest(p99_ms, F.lit(1.0)))
    return F.when(p99_ms > K.MOST_P99_MS, F.lit(K.FLOOR_SCORE)).otherwise(score)


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.select("*", weighted_error().alias("e"), F.round(fail_rate(), 6).alias("fail_rate"), F.round(accuracy(), 6).alias("accuracy"), F.round(det_score(), 6).alias("det_score"))


#: Values that are sorted in one task at most, and bins of a pass.
GATHER, BINS = 200_000, 1024


def order_statistics(df: DataFrame, column: str, indices: list[int]) -> list[float | None]:
    """The values at the given places (from 0) of the sorted column, exactly; NaN sorts last.

    Each pass counts the values between two bounds in bins of equal width, with the least and the greatest value of
    each, and goes on within the bin that holds the place. The least and the greatest value of all are in different
    bins, so every pass leaves fewer different values, and equal values need no pass at all. A few values that are left
    are sorted. At most ``BINS`` rows come to the driver, whatever the table.
    """
    infinity = float("inf")
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    finite = ~F.isnan("v") & (F.abs("v") != infinity)
    r = values.agg(F.count_if(F.col("v") == -infinity), F.count_if(finite), F.count_if(F.col("v") == infinity), F.count(F.lit(1)), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    below_all, n_finite, above, n, least, greatest = r
    inside = values.where(finite)
    out = []
    for index in indices:
        if not 0 <= index < n:
            out.append(None)
            continue
        if index < below_all or index >= below_all + n_finite:
            out.append(-infinity if index < below_all else infinity if index < below_all + n_finite + above else float("nan"))
            continue
        low, high, before, left = least, greatest, below_all, n_finite
        while low < high and left > GATHER:
            here = inside.where(F.col("v").between(low, high))
            width = high / 2 - low / 2  # halves, so that it can't overflow
            place = F.floor((F.col("v") / 2 - low / 2) / width * BINS) if width > 0 else (F.col("v") > low).cast("int")
            bins = here.groupBy(F.least(F.lit(BINS - 1), place).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            for b in sorted(bins.collect(), key=lambda b: b["bin"]):
                if index < before + b["n"]:
                    low, high, left = b["low"], b["high"], b["n"]
                    break
                before += b["n"]
        if low < high:
            ranked = inside.where(F.col("v").between(low, high)).withColumn("rn", F.row_number().over(Window.orderBy("v")))
            low = ranked.where(F.col("rn") == index - before + 1).first()["v"]
        out.append(low)
    return out


def percentiles(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """(p50, p99): the values at n/2 and at min(n-1, floor(0.99 n)) of the sorted column."""
    n = df.where(F.col(column).isNotNull()).count()
    return tuple(order_statistics(df, column, [n // 2, min(n - 1, math.floor(0.99 * n))])) if n else (None, None)
