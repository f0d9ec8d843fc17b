"""One weighted regression per group, for any number of groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import ship, written
from .distributions import t_quantile, t_two_sided
from .terms import Term, expand_terms
from .wls import CONSTANT, model_frame

RESULT = "term string, coef double, se double, t double, p double, ci_low double, ci_high double, n bigint, df_resid bigint, r2 double, rmse double"
# Share of a regressor the ones before it must leave unexplained.
UNEXPLAINED = 1e-11


def solve_batch(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverses and kept masks of many sets of normal equations at once.

    A regressor that the ones before it explain entirely is left out of its group: coefficient
    NaN, zeros in the inverse.
    """
    n, k = rhs.shape
    scale = np.sqrt(np.clip(np.diagonal(gram, axis1=1, axis2=2), 0, None))
    safe = np.where(scale > 0, scale, 1.0)
    scaled = gram / (safe[:, :, None] * safe[:, None, :])
    lower, kept = np.zeros_like(scaled), np.zeros((n, k), bool)
    for j in range(k):
        column = scaled[:, j:, j] - np.einsum("bij,bj->bi", lower[:, j:, :j], lower[:, j, :j])
        kept[:, j] = (scale[:, j] > 0) & (column[:, 0] > UNEXPLAINED)
        root = np.sqrt(np.where(kept[:, j], column[:, 0], 1.0))
        lower[:, j:, j] = np.where(kept[:, j, None], column / root[:, None], 0.0)
    both = kept[:, :, None] & kept[:, None, :]
    full = np.where(both, scaled, np.eye(k))
    inverse = np.where(both, np.linalg.inv(full), 0.0) / (safe[:, :, None] * safe[:, None, :])
    coef = np.einsum("bij,bj->bi", inverse, rhs)
    return np.where(kept, coef, np.nan), inverse, kept


@lru_cache(maxsize=100_000)
def _critical(df: int) -> float:
    return t_quantile(0.95, df)


def _solved(keys: int, names: list[str]):
    """Task function: rows of sums per group to one row per group and term."""
    k = len(names)
    at = np.triu_indices(k + 1)
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[keys:]]
            n, weight = numbers[:2]
            means = np.column_stack(numbers[2 : k + 3])
            sums = np.zeros((len(n), k + 1, k + 1))
            sums[:, at[0], at[1]] = sums[:, at[1], at[0]] = np.column_stack(numbers[k + 3 :]) * (n / weight)[:, None]
            gram, rhs, tss = sums[:, :k, :k], sums[:, :k, k], sums[:, k, k]
            slopes, inverse, kept = solve_batch(gram, rhs)
            used = np.where(kept, slopes, 0.0)
            rss = tss - 2 * (used * rhs).sum(axis=1) + np.einsum("bi,bij,bj->b", used, gram, used)
            rss = np.clip(rss, 0, None)
            df = n - 1 - kept.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s2 = np.where(df > 0, rss / df, np.nan)
                r2 = np.where(tss > 0, 1 - rss / tss, np.nan)
                middle = np.where(kept, means[:, :k], 0.0)
                spread = 1 / n + np.einsum("bi,bij,bj->b", middle, inverse, middle)
                var = np.column_stack([np.diagonal(inverse, axis1=1, axis2=2), spread]) * s2[:, None]
                coef = np.column_stack([slopes, means[:, k] - (used * middle).sum(axis=1)])
                se = np.where(np.isnan(coef), np.nan, np.sqrt(np.clip(var, 0, None)))
                t = np.where(se > 0, coef / se, np.nan)
            p = [[t_two_sided(x, d) for x in row] for row, d in zip(t.tolist(), df.tolist())]
            critical = np.array([_critical(int(d)) if d > 0 else np.nan for d in df])[:, None]
            columns = [coef, se, t, np.array(p).reshape(t.shape), coef - critical * se, coef + critical * se]
            each = np.repeat(np.arange(len(n)), k + 1)
            whole = [pa.array(np.repeat(c.astype(np.int64), k + 1)) for c in (n, df)]
            fit = [np.repeat(c, k + 1) for c in (r2, np.sqrt(s2))]
            doubles = [pa.array(c, pa.float64(), from_pandas=True) for c in [*[c.ravel() for c in columns], *fit]]
            terms = pa.array([*names, CONSTANT] * len(n), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(each)) for c in batch.columns[:keys]], terms, *doubles[:6], *whole, *doubles[6:]],
                [*batch.schema.names[:keys], *fields],
            )

    return work


def grouped_wls(df: DataFrame, y: str, formula: str | list[Term], by: list[str], w: str | None = None) -> DataFrame:
    """Fit y on the terms and a constant in every group: the group's columns, then ``term, coef,
    se, t, p, ci_low, ci_high, n, df_resid, r2, rmse``, one row per group and term.

    Weights are rescaled to sum to a group's rows. Rows with a missing value or without weight
    are left out, a group without any other row does not come back; null is a group like others.
    What a group cannot estimate (a regressor the ones before it explain, errors without degrees
    of freedom) is null. Means per group come first and are taken off, since sums of products of
    columns far from zero lose digits; sums are added up inside the tasks before the shuffle, and
    the equations of a batch of groups are solved together where the sums are. Nothing about a
    group reaches the driver, and the rows of a group are never in one task.
    """
    ship(df.sparkSession)
    terms = expand_terms(formula) if isinstance(formula, str) else formula
    names = [t.name for t in terms]
    columns = [*[f"_x{i}" for i in range(len(terms))], "_y"]
    frame = model_frame(df, y, terms, w, None, by)
    each = [(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"_m{i}") for i, c in enumerate(columns)]
    means = written(frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw"), *each), "group-means")
    keyed = means.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)], *[f"_m{i}" for i in range(len(columns))])
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    joined = frame.join(F.broadcast(keyed) if fits_broadcast(keyed) else keyed.hint("merge"), same)
    off = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)]
    products = [(i, j) for i in range(len(off)) for j in range(i, len(off))]
    sums = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_w").alias("_sw"),
        *[F.any_value(f"_m{i}").alias(f"_m{i}") for i in range(len(columns))],
        *[F.sum(F.col("_w") * off[i] * off[j]).alias(f"_s{i}_{j}") for i, j in products],
    )
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.schema.fields[: len(by)])
    return sums.mapInArrow(_solved(len(by), names), kinds + RESULT)
