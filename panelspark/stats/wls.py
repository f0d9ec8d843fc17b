"""Weighted least squares with plain or cluster-robust errors.

The data are only ever reduced to sums of column products, inside the tasks first; what
reaches the driver is the k x k matrix of sums, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .distributions import f_upper, t_quantile, t_two_sided
from .terms import Term, expand_terms

CONSTANT = "_cons"
# Products of columns above which they are added up in blocks instead of one aggregate.
WIDE_PRODUCTS = 40
# Groups whose models may come to the driver.
FEW_GROUPS = 10_000


@dataclass
class Fit:
    """A fitted model: coefficients, their covariance and the usual statistics."""

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    df_resid: float
    stats: dict[str, float] = field(default_factory=dict)
    group: tuple = ()

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def rows(self, model: str) -> list[tuple]:
        out = []
        crit = t_quantile(0.95, self.df_resid) if self.df_resid > 0 else math.nan
        for name, b, se in zip(self.names, self.coef, self.se):
            dropped = math.isnan(b)
            t = b / se if se > 0 else math.nan
            p = t_two_sided(t, self.df_resid)
            values = [None if dropped or math.isnan(v) else float(v) for v in (b, se, t, p, b - crit * se, b + crit * se)]
            out.append((model, name, *values))
        return out


COEF_SCHEMA = "model string, term string, coef double, se double, t double, p double, ci_low double, ci_high double"
STAT_SCHEMA = "model string, stat string, value double"


def coefficient_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """(model, term, coef, se, t, p, ci_low, ci_high)."""
    return spark.createDataFrame([r for m, f in fits.items() for r in f.rows(m)], COEF_SCHEMA)


def stat_table(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """(model, stat, value)."""
    rows = [(m, s, float(v)) for m, f in fits.items() for s, v in f.stats.items()]
    return spark.createDataFrame(rows, STAT_SCHEMA)


def solve(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverse and kept mask of the normal equations.

    Rows are scaled to a unit diagonal. A regressor that the ones before it explain entirely
    is left out: its coefficient is NaN and its rows of the inverse are zero.
    """
    k = len(rhs)
    scale = np.sqrt(np.diag(gram))
    kept = np.zeros(k, dtype=bool)
    safe = np.where(scale > 0, scale, 1.0)
    scaled = gram / np.outer(safe, safe)
    # Cholesky in the order given; what is left of a diagonal is the share the regressors before leave unexplained
    lower = np.zeros((k, k))
    for j in range(k):
        column = scaled[j:, j] - lower[j:, :j] @ lower[j, :j]
        if scale[j] > 0 and column[0] > 1e-11:
            kept[j] = True
            lower[j:, j] = column / math.sqrt(column[0])
    use = np.flatnonzero(kept)
    inverse = np.zeros((k, k))
    inverse[np.ix_(use, use)] = np.linalg.inv(scaled[np.ix_(use, use)]) / np.outer(safe[use], safe[use])
    coef = inverse @ rhs
    return np.where(kept, coef, np.nan), inverse, kept


def model_frame(
    df: DataFrame, y: str, terms: list[Term], w: str | None, cluster: str | None, by: list[str]
) -> DataFrame:
    """y, x0 ... xk, w (and cluster, groups) as doubles; rows with a missing value or no weight drop out."""
    xs = [t.column().alias(f"_x{i}") for i, t in enumerate(terms)]
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    frame = df.select(
        *by,
        *([F.col(cluster).alias("_g")] if cluster else []),
        F.col(y).cast("double").alias("_y"),
        weight.alias("_w"),
        *xs,
    )
    present = F.col("_w") > 0
    for c in ["_y", *[f"_x{i}" for i in range(len(terms))], *(["_g"] if cluster else [])]:
        present = present & F.col(c).isNotNull()
    return frame.where(present)


def _sums(frame: DataFrame, columns: list[Column], by: list[str]) -> dict[tuple, tuple[np.ndarray, int, float]]:
    """Weighted sums of all products of ``columns`` per group, in one aggregate: matrix, rows, weight."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col("_w")
    aggs = [F.sum(w * columns[i] * columns[j]).alias(f"_s{n}") for n, (i, j) in enumerate(pairs)]
    rows = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw"), *aggs).limit(FEW_GROUPS + 1).collect()
    if len(rows) > FEW_GROUPS:
        raise ValueError(f"more than {FEW_GROUPS} groups: use grouped_wls")
    out = {}
    for row in rows:
        matrix = np.zeros((k, k))
        for n, (i, j) in enumerate(pairs):
            matrix[i, j] = matrix[j, i] = row[f"_s{n}"] if row[f"_s{n}"] is not None else np.nan
        out[tuple(row[b] for b in by)] = (matrix, row["_n"], row["_sw"])
    return out


def gram(frame: DataFrame, columns: list[str], w: str | None = None) -> np.ndarray:
    """Sum over rows of w z z', z being (columns..., 1): block products inside the tasks, then one small sum."""
    k = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = np.column_stack([batch[columns].to_numpy(float), np.ones(len(batch))])
            total += z.T @ (z if w is None else z * batch[w].to_numpy(float)[:, None])
        i, j = np.triu_indices(k + 1)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    needed = frame.select(*columns, *([w] if w else []))
    parts = needed.mapInPandas(run, "i int, j int, v double")
    out = np.zeros((k + 1, k + 1))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def _model_sums(frame: DataFrame, terms: int, wide: int) -> tuple[np.ndarray, int, float]:
    """Sums of products of (x..., 1, y), row count and weight.

    A short model is one aggregate of column products. Beyond ``wide`` products the generated
    code for so many sums costs more than handing blocks of rows to numpy.
    """
    names = [f"_x{i}" for i in range(terms)]
    k = terms + 2
    if k * (k + 1) // 2 <= wide:
        columns = [*[F.col(c) for c in names], F.lit(1.0), F.col("_y")]
        return _sums(frame, columns, [])[()]
    counted = frame.withColumn("_n", 1 / F.col("_w"))
    # with z = (x, y, 1/w, 1) the sum of w * (1/w) * 1 counts the rows
    total = gram(counted, [*names, "_y", "_n"], "_w")
    at = [*range(terms), terms + 2, terms]
    return total[np.ix_(at, at)], round(total[terms + 1, terms + 2]), total[terms + 2, terms + 2]


def cluster_factor(clusters: int, n: int, k: int) -> float:
    """Small-sample factor G/(G-1) * (N-1)/(N-k)."""
    return clusters / (clusters - 1) * (n - 1) / (n - k)


def _cluster_meat(frame: DataFrame, xs: list[Column], residual: Column, wide: int) -> tuple[np.ndarray, int]:
    """Sum over clusters of score x score', and the number of clusters.

    Scores are added up per cluster by a partial aggregate, so a cluster's size does not
    matter; their products are added up on the executors, so neither does their number.
    """
    names = [f"_u{i}" for i in range(len(xs))]
    weighted = frame.withColumn("_we", F.col("_w") * residual)
    scores = weighted.groupBy("_g").agg(*[F.sum(x * F.col("_we")).alias(n) for n, x in zip(names, xs)])
    k = len(names)
    if k * (k + 1) // 2 <= wide:
        ones = scores.withColumn("_w", F.lit(1.0))
        meat, clusters, _ = _sums(ones, [F.col(n) for n in names], [])[()]
        return meat, clusters
    total = gram(scores, names)
    return total[:-1, :-1], round(total[-1, -1])


def wls(
    df: DataFrame,
    y: str,
    formula: str | list[Term],
    w: str | None = None,
    cluster: str | None = None,
    by: list[str] | None = None,
    wide: int = WIDE_PRODUCTS,
) -> Fit | dict[tuple, Fit]:
    """Fit y on the terms and a constant, weights rescaled to sum to N.

    With ``cluster`` the errors are cluster-robust and tests use G - 1 degrees of freedom.
    With ``by`` one model per group comes back (dict keyed by group), all from one pass; for
    more than ``FEW_GROUPS`` groups see ``grouped_wls``.
    """
    terms = expand_terms(formula) if isinstance(formula, str) else formula
    groups = list(by or [])
    if groups and cluster:
        raise ValueError("errors are clustered for a single model only")
    names = [t.name for t in terms] + [CONSTANT]
    frame = model_frame(df, y, terms, w, cluster, groups)
    frame, means, middle = _centred(frame, len(terms))
    xs = [F.col(f"_x{i}") for i in range(len(terms))] + [F.lit(1.0)]
    if groups:
        fits = {}
        for key, (sums, n, weight) in _sums(frame, [*xs, F.col("_y")], groups).items():
            fits[key] = _fit(sums * (n / weight), n, names)
            _moved_back(fits[key], means, middle)
            fits[key].group = key
        return fits
    sums, n, weight = _model_sums(frame, len(terms), wide)
    if n == 0:
        raise ValueError("no complete rows to fit")
    fit = _fit(sums * (n / weight), n, names)
    if cluster:
        _make_robust(fit, frame, xs, n / weight, wide)
    _moved_back(fit, means, middle)
    return fit


def recentred(cov: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Covariance of (slopes, constant) once the regressors have their ``means`` again."""
    move = np.eye(len(cov))
    move[-1, :-1] = -means
    return move @ cov @ move.T


def _moved_back(fit: Fit, means: np.ndarray, middle: float) -> None:
    """Turn a fit of centred columns into one of the columns themselves."""
    kept = ~np.isnan(fit.coef[:-1])
    fit.coef[-1] += middle - float(fit.coef[:-1][kept] @ means[kept])
    fit.cov = recentred(fit.cov, np.where(kept, means, 0.0))


def _centred(frame: DataFrame, terms: int) -> tuple[DataFrame, np.ndarray, float]:
    """The frame with its weighted means taken off, and the means of the regressors and of y.

    Sums of products of columns far from zero lose the digits that tell them apart.
    """
    names = [*[f"_x{i}" for i in range(terms)], "_y"]
    row = frame.agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in names]).first()
    means = np.array([row[c] if row[c] is not None else 0.0 for c in names])
    moved = frame.withColumns({c: F.col(c) - F.lit(float(m)) for c, m in zip(names, means)})
    return moved, means[:-1], float(means[-1])


def _fit(sums: np.ndarray, n: int, names: list[str]) -> Fit:
    k = len(names)
    gram, rhs, yy = sums[:k, :k], sums[:k, k], sums[k, k]
    coef, inverse, kept = solve(gram, rhs)
    used = np.where(kept, coef, 0.0)
    rank = int(kept.sum())
    # expanded with the gram matrix, which is exact also where a term was left out
    rss = max(float(yy - 2 * used @ rhs + used @ gram @ used), 0.0)
    mean = rhs[k - 1] / gram[k - 1, k - 1]
    tss = float(yy - gram[k - 1, k - 1] * mean * mean)
    df_resid = n - rank
    s2 = rss / df_resid if df_resid > 0 else math.nan
    r2 = 1 - rss / tss if tss > 0 else math.nan
    stats = {
        "n": n,
        "r2": r2,
        "r2_a": 1 - (1 - r2) * (n - 1) / df_resid if df_resid > 0 else math.nan,
        "rmse": math.sqrt(s2) if s2 == s2 else math.nan,
        "df_m": rank - 1,
    }
    fit = Fit(names, coef, inverse * s2, df_resid, stats)
    fit._inverse, fit._rank, fit._n = inverse, rank, n
    return fit


def _make_robust(fit: Fit, frame: DataFrame, xs: list[Column], scale: float, wide: int) -> None:
    predicted = F.lit(0.0)
    for x, b in zip(xs, fit.coef):
        if not math.isnan(b):
            predicted = predicted + x * F.lit(float(b))
    meat, clusters = _cluster_meat(frame, xs, F.col("_y") - predicted, wide)
    bread = fit._inverse
    fit.stats["clusters"] = clusters
    if clusters < 2:
        raise ValueError("cluster-robust errors need at least two clusters")
    fit.cov = cluster_factor(clusters, fit._n, fit._rank) * bread @ (meat * scale * scale) @ bread
    fit.df_resid = clusters - 1


def joint_test(fit: Fit, names: list[str], tolerance: float = 1e-9, dropped: bool = False) -> dict[str, float]:
    """Wald test that the named coefficients are all zero: F, its degrees of freedom and p.

    With few clusters the covariance has few independent directions; the numerator degrees of
    freedom are their number. By default all coefficients are tested along these directions. With
    ``dropped`` they are taken in the order given, and one is left out if those before it
    determine it or are as many as there can be.
    """
    at = [fit.names.index(n) for n in names]
    at = [i for i in at if not math.isnan(fit.coef[i])]
    b, v = fit.coef[at], fit.cov[np.ix_(at, at)]
    # never more directions than clusters less one
    most = int(fit.stats["clusters"]) - 1 if "clusters" in fit.stats else len(at)
    if dropped:
        use = np.flatnonzero(solve(v, b)[2])[:most]
        q = len(use)
        wald = float(b[use] @ np.linalg.solve(v[np.ix_(use, use)], b[use])) if q else math.nan
    else:
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        use = [i for i in np.argsort(values)[::-1][:most] if values[i] > tolerance * max(values.max(), 0.0)]
        q = len(use)
        wald = float(np.sum((vectors[:, use].T @ b) ** 2 / values[use])) if q else math.nan
    if q == 0:
        return {"f": math.nan, "df1": 0.0, "df2": float(fit.df_resid), "p": math.nan}
    f = wald / q
    return {"f": f, "df1": float(q), "df2": float(fit.df_resid), "p": f_upper(f, q, fit.df_resid)}
