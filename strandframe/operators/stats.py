"""Descriptive statistics, histograms, quantiles, distributions and autocorrelation as aggregates."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.state import ordered_rank


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


# --- moments --------------------------------------------------------------------------------


def moments(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, min, max, mean, population and sample variance, skewness and (not excess) kurtosis."""
    v = _d(x)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), F.var_samp(v).alias("var_samp"),
        F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis"),
    )


def covariance(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """mean_i, var_i (sample), min_i, max_i and cov_i_j (sample) for i <= j, in one aggregate."""
    out = [f(_d(c)).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("var", F.var_samp), ("min", F.min), ("max", F.max))]
    out += [F.covar_samp(_d(a), _d(b)).alias(f"cov_{a}_{b}") for a, b in combinations_with_replacement(columns, 2)]
    return df.groupBy(*keys).agg(*out)


def avg_weighted(x: Column | str, w: Column | str) -> Column:
    """Null where the weights sum to 0."""
    return F.try_divide(F.sum(_d(x) * _d(w)), F.sum(_d(w)))


def weighted_moments(df: DataFrame, columns: list[str], weight: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted means, variances and covariances over the total weight; weights below 1e-10 are left out.

    Sums are taken about each column's plain mean of its group, which keeps them from cancelling.
    """
    rows = df.where(_d(weight) >= 1e-10)
    centres = rows.groupBy(*keys).agg(*(F.avg(_d(c)).alias(f"__m_{c}") for c in columns))
    about = rows.join(F.broadcast(centres), list(keys)) if keys else rows.crossJoin(F.broadcast(centres))  # one row
    w = _d(weight)
    x = {c: _d(c) - F.col(f"__m_{c}") for c in columns}
    sums = [F.sum(w).alias("__w")] + [F.sum(w * x[c]).alias(f"__s_{c}") for c in columns] + [F.first(f"__m_{c}").alias(f"__c_{c}") for c in columns]
    sums += [F.sum(w * x[a] * x[b]).alias(f"__p_{a}_{b}") for a, b in combinations_with_replacement(columns, 2)]
    got = about.groupBy(*keys).agg(*sums)
    mean = lambda c: F.col(f"__s_{c}") / F.col("__w")
    out = [F.col("__w").alias("weight")] + [(F.col(f"__c_{c}") + mean(c)).alias(f"mean_{c}") for c in columns]
    out += [(F.col(f"__p_{a}_{b}") / F.col("__w") - mean(a) * mean(b)).alias(f"var_{a}" if a == b else f"cov_{a}_{b}") for a, b in combinations_with_replacement(columns, 2)]
    return got.select(*keys, *out)


def quantile(df: DataFrame, x: str, p: float, keys: tuple[str, ...] = (), exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """A quantile by a mergeable sketch; exact=True interpolates over all values."""
    q = F.percentile(_d(x), p) if exact else F.percentile_approx(_d(x), p, accuracy)
    return df.groupBy(*keys).agg(q.alias("quantile"))


# --- histograms -----------------------------------------------------------------------------


def which_bin(x: Column | str, width: float) -> Column:
    return F.floor(_d(x) / F.lit(float(width))).cast("int")


def histogram(df: DataFrame, x: str, width: float, weight: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, bin, bin_min, bin_max, weight: bin = floor(x / width), negative bins too."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(_d(weight))
    got = df.where(_d(x).isNotNull()).groupBy(*keys, which_bin(x, width).alias("bin")).agg(n.alias("weight"))
    return got.select(*keys, "bin", (F.col("bin") * width).alias("bin_min"), ((F.col("bin") + 1) * width).alias("bin_max"), "weight")


def histogram_nd(df: DataFrame, columns: list[str], widths: list[float], weight: str | None = None) -> DataFrame:
    """bin_<column>..., weight."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(_d(weight))
    return df.dropna(subset=columns).groupBy(*(which_bin(c, w).alias(f"bin_{c}") for c, w in zip(columns, widths, strict=True))).agg(n.alias("weight"))


def tallest(hist: DataFrame, bins: list[str]) -> DataFrame:
    """The bin of the greatest weight; ties go to the smallest bin."""
    order = F.struct("weight", *((-F.col(b)).alias(b) for b in bins))
    return hist.agg(F.max_by(F.struct(*bins, "weight"), order).alias("r")).select("r.*")


def mode(hist: DataFrame, bins: list[str], widths: list[float]) -> DataFrame:
    """Edges and weight of the tallest bin."""
    edges = [e for b, w in zip(bins, widths, strict=True) for e in ((F.col(b) * w).alias(f"{b}_min"), ((F.col(b) + 1) * w).alias(f"{b}_max"))]
    return tallest(hist, bins).select(*edges, "weight")


def dense(hist: DataFrame, low: float, high: float, width: float) -> DataFrame:
    """bin, weight for every bin from low's to high's, zeros filled in."""
    first, last = math.floor(low / width), math.floor(high / width)
    bins = hist.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(hist.select("bin", "weight"), "bin", "left").select("bin", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def dense_2d(hist: DataFrame, bins: tuple[str, str], low: tuple[float, float], high: tuple[float, float], widths: tuple[float, float]) -> DataFrame:
    """A full grid of two bins; its size follows from the ranges given, not from the data."""
    spark = hist.sparkSession
    grid = [spark.range(math.floor(lo / w), math.floor(hi / w) + 1).select(F.col("id").cast("int").alias(b)) for b, lo, hi, w in zip(bins, low, high, widths, strict=True)]
    return grid[0].crossJoin(F.broadcast(grid[1])).join(hist, list(bins), "left").select(*bins, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def bar_chart(hist: DataFrame, low: float, high: float, width: float, height: int = 10) -> str:
    """Bars as text. The range given bounds what comes to the driver."""
    rows = [r["weight"] for r in dense(hist, low, high, width).orderBy("bin").collect()]
    top = max(rows, default=0) or 1
    return "\n".join("".join("*" if r / top * height > h else " " for r in rows) for h in range(height - 1, -1, -1))


# --- distributions --------------------------------------------------------------------------


def normal_pdf(x: Column | str, mean: float | Column, sd: float | Column) -> Column:
    m, s = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd))
    return F.exp(-((_d(x) - m) * (_d(x) - m)) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))


def normal_fit(df: DataFrame, x: str, weight: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, sd: sample deviation, or over the total weight where weighted."""
    if weight is None:
        return df.groupBy(*keys).agg(F.avg(_d(x)).alias("mean"), F.stddev_samp(_d(x)).alias("sd"))
    got = weighted_moments(df, [x], weight, keys)
    return got.select(*keys, F.col(f"mean_{x}").alias("mean"), F.sqrt(f"var_{x}").alias("sd"))


def multinormal_logpdf(columns: list[str], mean: list[float], cov: list[list[float]]) -> Column:
    """Log density with the parameters as constants: a quadratic form that Spark compiles."""
    inverse, (sign, log_det) = np.linalg.inv(np.array(cov, float)), np.linalg.slogdet(np.array(cov, float))
    if sign <= 0:
        raise ValueError("the covariance is not positive definite")
    d = [_d(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    form = F.lit(0.0)
    for i, a in enumerate(d):
        for j, b in enumerate(d):
            form = form + F.lit(float(inverse[i, j])) * a * b
    return F.lit(-0.5 * (len(columns) * math.log(2 * math.pi) + float(log_det))) - form / 2


def multinormal_pdf(columns: list[str], mean: list[float], cov: list[list[float]]) -> Column:
    return F.exp(multinormal_logpdf(columns, mean, cov))


def normal_sample(mean: float, sd: float, seed: int) -> Column:
    return F.randn(seed) * sd + mean


def multinormal_sample(mean: list[float], cov: list[list[float]], seed: int) -> list[Column]:
    """One column for each dimension of a draw."""
    root = np.linalg.cholesky(np.array(cov, float))
    z = [F.randn(seed + i) for i in range(len(mean))]
    return [F.lit(float(m)) + sum((F.lit(float(root[i, j])) * z[j] for j in range(i + 1)), F.lit(0.0)) for i, m in enumerate(mean)]


def log_likelihood(df: DataFrame, densities: list[Column], weights: list[float]) -> DataFrame:
    """Sum over rows of the log of the weighted densities."""
    p = sum((F.lit(float(w)) * d for w, d in zip(weights, densities, strict=True)), F.lit(0.0))
    return df.agg(F.sum(F.log(p)).alias("log_likelihood"))


# --- series ---------------------------------------------------------------------------------


def autocorrelation(df: DataFrame, order: str, columns: list[str], max_lag: int) -> DataFrame:
    """lag, value for lags 0 to max_lag: circular, mean taken out, summed over columns, lag 0 = 1.

    Rows are numbered once; each lag is one equi-join row, so work is rows times lags.
    """
    means = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(_d(c)).alias(f"m_{c}") for c in columns))
    ranked = ordered_rank(df.select(order, *columns).withColumnRenamed(order, "__at"), ["__at"], "i").crossJoin(F.broadcast(means))
    points = ranked.select("i", "n", *((_d(c) - F.col(f"m_{c}")).alias(c) for c in columns))
    ahead = points.select((F.col("i")).alias("k"), *(F.col(c).alias(f"b_{c}") for c in columns))
    lags = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    paired = lags.where("lag < n").withColumn("k", ((F.col("i") + F.col("lag")) % F.col("n")).cast("long")).join(ahead, "k")
    dot = sum((F.col(c) * F.col(f"b_{c}") for c in columns), F.lit(0.0))
    sums = paired.groupBy("lag").agg(F.sum(dot).alias("s"))
    zero = sums.where("lag = 0").select(F.col("s").alias("s0"))
    return sums.crossJoin(F.broadcast(zero)).select("lag", F.try_divide("s", "s0").alias("value"))


def autocorrelation_fft(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, lag, value for all lags of each series; a series, being one trajectory, fits one task."""
    kinds = ", ".join(x for x in [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema), "lag long, value double"] if x)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        x = pdf[columns].to_numpy(float)
        x = x - x.mean(axis=0)
        power = (np.abs(np.fft.fft(x, axis=0)) ** 2).sum(axis=1)
        r = np.fft.ifft(power).real
        out = pd.DataFrame({"lag": np.arange(len(r)), "value": r / r[0] if r[0] else np.full(len(r), np.nan)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(one, kinds)
