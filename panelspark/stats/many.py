"""Many regressions from three scans of the data.

The columns of all models stand side by side once, and a bit per model says which rows it takes (its
sample, no missing value among its columns). The first scan gives common means, the second every
model's sums of products around them, the third its cluster scores. Rows of one pattern of bits are multiplied
once, whatever the number of models that take them; a task hands on sums per model only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .terms import Term, expand_terms
from .wls import CONSTANT, Fit, _fit, _moved_back, cluster_factor

# Models that share a scan (bits of one number), and patterns a task holds sums of.
TOGETHER, PATTERNS = 60, 32


@dataclass(frozen=True)
class Model:
    y: str
    formula: str
    sample: str | None = None


@dataclass(frozen=True)
class _Plan:
    """Where the columns of each model stand: its terms, then y."""

    names: list[list[str]]
    places: list[list[int]]
    columns: list[str]


def _sums_task(plan: _Plan, means: np.ndarray):
    """Per task: (model, i, j, v) over the model's (terms..., 1, y), and its rows as (model, -1, -1, n)."""
    width = len(plan.columns)
    spots = [[*p[:-1], width, p[-1]] for p in plan.places]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((len(s), len(s))) for s in spots]
        rows = np.zeros(len(spots), np.int64)
        held: dict[int, list] = {}

        def close() -> None:
            for bits, (products, n) in held.items():
                for m, s in enumerate(spots):
                    if bits >> m & 1:
                        total[m] += products[np.ix_(s, s)]
                        rows[m] += n
            held.clear()

        for batch in batches:
            z = np.column_stack([batch[plan.columns].to_numpy(float) - means, np.ones(len(batch))])
            w, pattern = batch["_w"].to_numpy(float), batch["_in"].to_numpy()
            for bits in np.unique(pattern):
                on = pattern == bits
                products = z[on].T @ (z[on] * w[on, None])
                if int(bits) in held:
                    held[int(bits)][0] += products
                    held[int(bits)][1] += int(on.sum())
                else:
                    held[int(bits)] = [products, int(on.sum())]
            if len(held) > PATTERNS:
                close()
        close()
        for m, sums in enumerate(total):
            i, j = np.triu_indices(len(sums))
            yield pd.DataFrame({"m": m, "i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(sums[i, j], rows[m])})

    return run


def _scores_task(plan: _Plan, means: list[np.ndarray], coefs: list[np.ndarray]):
    """Per task: cluster scores of every model's (terms..., 1), as (model, cluster, i, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, w, pattern = batch[plan.columns].to_numpy(float), batch["_w"].to_numpy(float), batch["_in"].to_numpy()
            names, g = np.unique(batch["_g"].to_numpy(), return_inverse=True)
            for m, places in enumerate(plan.places):
                on = (pattern >> m & 1).astype(bool)
                if not on.any():
                    continue
                own = z[on][:, places] - means[m]
                x = np.column_stack([own[:, :-1], np.ones(len(own))])
                residual = own[:, -1] - x @ coefs[m]
                sums = np.zeros((len(names), x.shape[1]))
                np.add.at(sums, g[on], x * (w[on] * residual)[:, None])
                some = np.unique(g[on])
                i, j = np.meshgrid(some, np.arange(x.shape[1]), indexing="ij")
                yield pd.DataFrame({"m": m, "g": names[i.ravel()], "i": j.ravel(), "v": sums[some].ravel()})

    return run


def _products_task(sizes: list[int]):
    """Per task: products of whole score vectors, added up per model; the clusters as (model, -1, -1, count)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, clusters = [np.zeros((k, k)) for k in sizes], np.zeros(len(sizes))
        for batch in batches:
            for m, at, values in zip(batch["m"], batch["i"], batch["v"]):
                u = np.zeros(sizes[m])
                u[np.asarray(at)] = values
                total[m] += np.outer(u, u)
                clusters[m] += 1
        for m, sums in enumerate(total):
            i, j = np.nonzero(sums)
            yield pd.DataFrame({"m": m, "i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(sums[i, j], clusters[m])})

    return run


def _gathered(parts: DataFrame, sizes: list[int]) -> tuple[list[np.ndarray], list[float]]:
    """Add (m, i, j, v) up over the tasks: as many numbers as the models have, not the data."""
    out, counts = [np.zeros((k, k)) for k in sizes], [0.0] * len(sizes)
    for r in parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            counts[r["m"]] = r["v"]
        else:
            out[r["m"]][r["i"], r["j"]] = r["v"]
    return out, counts


def wls_many(df: DataFrame, models: dict[str, Model], w: str | None = None, cluster: str | None = None) -> dict[str, Fit]:
    """Every model as :func:`panelspark.stats.wls.wls` fits it on its sample, from three scans of one narrow table.

    A model without complete rows raises, as it does alone.
    """
    names = list(models)
    if len(names) > TOGETHER:
        first = wls_many(df, {n: models[n] for n in names[:TOGETHER]}, w, cluster)
        return first | wls_many(df, {n: models[n] for n in names[TOGETHER:]}, w, cluster)
    terms: dict[str, Term] = {}
    wanted: list[tuple[list[str], str]] = []
    for model in models.values():
        own = expand_terms(model.formula)
        terms |= {t.name: t for t in own}
        wanted.append(([t.name for t in own], model.y))
    ys = list(dict.fromkeys(y for _, y in wanted))
    place = {("x", t): i for i, t in enumerate(terms)} | {("y", y): len(terms) + i for i, y in enumerate(ys)}
    columns = [f"_c{i}" for i in range(len(place))]
    plan = _Plan([t for t, _ in wanted], [[*[place["x", t] for t in own], place["y", y]] for own, y in wanted], columns)

    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    values: list[Column] = [*[t.column() for t in terms.values()], *[F.col(y).cast("double") for y in ys]]
    samples = [F.lit(True) if m.sample is None else F.coalesce(F.expr(m.sample), F.lit(False)) for m in models.values()]
    frame = df.select(
        weight.alias("_w"),
        *([F.col(cluster).alias("_g")] if cluster else []),
        *[v.alias(c) for v, c in zip(values, columns)],
        *[s.alias(f"_s{m}") for m, s in enumerate(samples)],
    ).where(F.col("_w") > 0)
    if cluster:
        frame = frame.where(F.col("_g").isNotNull())
    bits = F.lit(0).cast("bigint")
    for m, places in enumerate(plan.places):
        taken = F.col(f"_s{m}")
        for p in places:
            taken = taken & F.col(columns[p]).isNotNull()
        bits = bits + F.when(taken, F.lit(1 << m).cast("bigint")).otherwise(0)
    frame = frame.withColumn("_in", bits).where("_in <> 0").drop(*[f"_s{m}" for m in range(len(samples))])
    frame = written(frame, "models")
    middle = frame.agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(c) for c in columns]).first()
    common = np.array([middle[c] if middle[c] is not None else 0.0 for c in columns])
    filled = frame.fillna(0.0, subset=columns)  # a missing value is in no row its models take
    sizes = [len(p) + 1 for p in plan.places]
    sums, counts = _gathered(filled.mapInPandas(_sums_task(plan, common), "m int, i int, j int, v double"), sizes)
    fits, own_means, scales = {}, [], []
    for name, own, upper, n, places in zip(names, plan.names, sums, counts, plan.places):
        if not n:
            raise ValueError(f"no complete rows to fit {name}")
        s = upper + upper.T - np.diag(np.diag(upper))
        one = len(own)
        weight_sum, shift = s[one, one], s[one] / s[one, one]
        # around the model's own means
        s = s - np.outer(shift, shift) * weight_sum
        s[one, :] = s[:, one] = 0.0
        s[one, one] = weight_sum
        fits[name] = _fit(s * (n / weight_sum), round(n), [*own, CONSTANT])
        own_means.append(common[places] + np.delete(shift, one))
        scales.append(n / weight_sum)
    if cluster:
        kind = frame.schema["_g"].dataType.simpleString()
        coefs = [np.nan_to_num(fits[name].coef) for name in names]
        scores = filled.mapInPandas(_scores_task(plan, own_means, coefs), f"m int, g {kind}, i int, v double")
        entries = scores.groupBy("m", "g", "i").agg(F.sum("v").alias("v"))
        vectors = entries.groupBy("m", "g").agg(F.collect_list(F.struct("i", "v")).alias("u")).select("m", "u.i", "u.v")
        widths = [len(p) for p in plan.places]
        meats, clusters = _gathered(vectors.mapInPandas(_products_task(widths), "m int, i int, j int, v double"), widths)
        for name, meat, groups, scale in zip(names, meats, clusters, scales):
            fit = fits[name]
            if groups < 2:
                raise ValueError("cluster-robust errors need at least two clusters")
            fit.stats["clusters"] = round(groups)
            fit.cov = cluster_factor(groups, fit._n, fit._rank) * fit._inverse @ (meat * scale**2) @ fit._inverse
            fit.df_resid = round(groups) - 1
    for name, means in zip(names, own_means):
        _moved_back(fits[name], means[:-1], float(means[-1]))
    return fits
