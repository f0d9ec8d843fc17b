"""Regression with two absorbed fixed effects.

Exact route: rows collapse (in the JVM, before the shuffle) to one cell per combination of
the two effects, event time and cluster. The effect with many levels is then taken out by
demeaning within its groups, the one with few levels stays as dummies. Only cells meet in a
group, never rows, so a level that holds a third of all rows costs no more than any other.
Two effects that both have very many levels are taken out by conjugate gradients over the graph
of their cells (``effect_graph``); coefficients, errors and statistics are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import wmean
from ..operators.joins import sized_join
from ..session import checkpointed, written
from .effect_graph import parts, residual_effects
from .terms import Term, expand_terms
from .wls import CONSTANT, Fit, cluster_factor, recentred, solve, wls

# Levels an effect may have and still enter as dummies (they size the driver's matrix).
MAX_LEVELS = 2_000
# Numbers in one dense block inside a task.
BLOCK = 4_000_000


class TooManyLevels(ValueError):
    pass


def few_levels(cells: DataFrame, column: str, limit: int = MAX_LEVELS) -> dict:
    """Weight of each non-NULL level, sorted by level, refusing to collect more than ``limit``."""
    weights = cells.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("sw"))
    rows = weights.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyLevels(f"{column} has more than {limit} levels")
    return dict(sorted((r[0], r[1]) for r in rows))


def _cells(
    df: DataFrame, y: str, terms: list[Term], big: str, small: str, w: str | None, cluster: str | None, event: str | None
) -> DataFrame:
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    c = len(terms)
    rows = df.select(
        F.col(big).alias("_big"),
        F.col(small).alias("_small"),
        (F.col(event) if event else F.lit(None).cast("int")).alias("_event"),
        (F.col(cluster) if cluster else F.lit(0)).alias("_g"),
        F.col(y).cast("double").alias("_y"),
        weight.alias("_w"),
        *[t.column().alias(f"_x{i}") for i, t in enumerate(terms)],
    )
    present = F.col("_w") > 0
    for name in ["_big", "_small", "_g", "_y", *[f"_x{i}" for i in range(c)]]:
        present = present & F.col(name).isNotNull()
    wt, yv = F.col("_w"), F.col("_y")
    x = [F.col(f"_x{i}") for i in range(c)]
    return rows.where(present).groupBy("_big", "_small", "_event", "_g").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(wt).alias("sw"),
        F.sum(wt * yv).alias("my"),
        F.sum(wt * yv * yv).alias("myy"),
        *[F.sum(wt * x[i]).alias(f"mx{i}") for i in range(c)],
        *[F.sum(wt * x[i] * yv).alias(f"mxy{i}") for i in range(c)],
        *[F.sum(wt * x[i] * x[j]).alias(f"mxx{i}_{j}") for i in range(c) for j in range(i, c)],
    )


class _Layout:
    """Positions of the regressors: controls, event dummies, dummies of the small effect, y."""

    def __init__(self, controls: int, events: list, smalls: list):
        self.c = controls
        self.events = {v: controls + i for i, v in enumerate(events)}
        self.smalls = {v: controls + len(events) + i for i, v in enumerate(smalls)}
        self.k = controls + len(events) + len(smalls)

    def blocks(self, batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
        """Blocks of whole groups: cells, group number, event and small positions (-1 for none)."""
        tail = None
        per_block = max(1, BLOCK // max(width, 1))
        for pdf in batches:
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            if pdf.empty:
                continue
            start = pdf["_big"].ne(pdf["_big"].shift()).to_numpy().nonzero()[0]
            # the last group may go on in the next batch
            tail = pdf.iloc[start[-1]:]
            yield from self._cut(pdf.iloc[: start[-1]], start[:-1], per_block)
        if tail is not None:
            yield from self._cut(tail, np.array([0]), per_block)

    def _cut(self, pdf: pd.DataFrame, start: np.ndarray, per_block: int) -> Iterator[tuple]:
        for lo in range(0, len(start), per_block):
            hi = min(lo + per_block, len(start))
            end = start[hi] if hi < len(start) else len(pdf)
            part = pdf.iloc[start[lo]:end]
            group = np.zeros(len(part), dtype=int)
            group[(start[lo + 1:hi] - start[lo])] = 1
            event = part["_event"].map(self.events).fillna(-1).to_numpy().astype(int)
            small = part["_small"].map(self.smalls).fillna(-1).to_numpy().astype(int)
            yield part, np.cumsum(group), event, small

    def controls(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, n = self.c, len(part)
        mx = part[[f"mx{i}" for i in range(c)]].to_numpy(float).reshape(n, c)
        mxy = part[[f"mxy{i}" for i in range(c)]].to_numpy(float).reshape(n, c)
        mxx = np.zeros((n, c, c))
        for i in range(c):
            for j in range(i, c):
                mxx[:, i, j] = mxx[:, j, i] = part[f"mxx{i}_{j}"].to_numpy(float)
        return mx, mxy, mxx

    def group_sums(self, part, group, event, small, mx) -> tuple[np.ndarray, np.ndarray]:
        """Per group: weighted sums of every regressor and y, and the weight."""
        sw = part["sw"].to_numpy(float)
        groups = group[-1] + 1
        sums = np.zeros((groups, self.k + 1))
        np.add.at(sums[:, : self.c], group, mx)
        for at in (event, small):
            on = at >= 0
            np.add.at(sums, (group[on], at[on]), sw[on])
        np.add.at(sums[:, self.k], group, part["my"].to_numpy(float))
        return sums, np.bincount(group, sw, groups)


def _gram_task(layout: _Layout):
    """Per task: sums of products of the demeaned regressors and y, as (i, j, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, c = layout.k, layout.c
        acc = np.zeros((k + 1, k + 1))
        for part, group, event, small in layout.blocks(batches, k + 1):
            sw, my = part["sw"].to_numpy(float), part["my"].to_numpy(float)
            mx, mxy, mxx = layout.controls(part)
            acc[:c, :c] += mxx.sum(axis=0)
            acc[:c, k] += mxy.sum(axis=0)
            acc[k, k] += part["myy"].sum()
            for at in (event, small):
                on = at >= 0
                np.add.at(acc, (at[on], at[on]), sw[on])
                np.add.at(acc[:, k], at[on], my[on])
                for i in range(c):
                    np.add.at(acc[i], at[on], mx[on, i])
            both = (event >= 0) & (small >= 0)
            np.add.at(acc, (event[both], small[both]), sw[both])
            sums, weight = layout.group_sums(part, group, event, small, mx)
            acc -= np.triu(sums.T @ (sums / weight[:, None]))
            acc[:c, :c] = np.triu(acc[:c, :c])
        i, j = np.nonzero(np.triu(acc))
        yield pd.DataFrame({"i": i, "j": j, "v": acc[i, j]})

    return run


def _score_task(layout: _Layout, coef: np.ndarray):
    """Per task: cluster scores of the demeaned regressors, and of the constant (position k).

    Given as (cluster, i, v), so their number is bounded by the data a task has, not by a table
    of all clusters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, c = layout.k, layout.c
        padded = np.append(coef, 0.0)  # position -1: no dummy
        for part, group, event, small in layout.blocks(batches, k + 1):
            names, g = np.unique(part["_g"].to_numpy(), return_inverse=True)
            sw, my = part["sw"].to_numpy(float), part["my"].to_numpy(float)
            mx, mxy, mxx = layout.controls(part)
            sums, weight = layout.group_sums(part, group, event, small, mx)
            shift = padded[event] + padded[small]
            resid = my - mx @ coef[:c] - sw * shift
            mean = np.bincount(group, resid, len(weight)) / weight
            d = resid - mean[group] * sw
            raw = mxy - mxx @ coef[:c] - mx * (shift + mean[group])[:, None]
            # clusters are taken some at a time, so the table stays within a block
            step = max(1, BLOCK // (k + 1 + len(weight)))
            for low in range(0, len(names), step):
                on_step = (g >= low) & (g < low + step)
                own, width = g - low, min(step, len(names) - low)
                u = np.zeros((k + 1, width))
                for i in range(c):
                    np.add.at(u[i], own[on_step], raw[on_step, i])
                for at in (event, small):
                    on = on_step & (at >= 0)
                    np.add.at(u, (at[on], own[on]), d[on])
                np.add.at(u[k], own[on_step], d[on_step])
                per_group = np.zeros((len(weight), width))
                np.add.at(per_group, (group[on_step], own[on_step]), d[on_step])
                u[:k] -= (sums[:, :k] / weight[:, None]).T @ per_group
                i, j = np.nonzero(u)
                yield pd.DataFrame({"g": names[low + j], "i": i, "v": u[i, j]})

    return run


def _graph_gram_task(layout: _Layout):
    """Per task: sums of products of the regressors and y less both effects (``f``), as (i, j, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, c = layout.k, layout.c
        acc = np.zeros((k + 1, k + 1))
        for pdf in batches:
            for part, event, sw, m, f in _dense(layout, pdf):
                _, mxy, mxx = layout.controls(part)
                acc[:c, :c] += mxx.sum(axis=0)
                acc[:c, k] += mxy.sum(axis=0)
                acc[k, :c] += mxy.sum(axis=0)
                acc[k, k] += part["myy"].sum()
                on = event >= 0
                np.add.at(acc, (event[on], event[on]), sw[on])
                for i in [*range(c), k]:
                    np.add.at(acc[i], event[on], m[on, i])
                    np.add.at(acc[:, i], event[on], m[on, i])
                both = f.T @ m
                acc += f.T @ (f * sw[:, None]) - both - both.T
        i, j = np.nonzero(np.triu(acc))
        yield pd.DataFrame({"i": i, "j": j, "v": acc[i, j]})

    return run


def _graph_score_task(layout: _Layout, coef: np.ndarray):
    """Per task: cluster scores of the regressors less both effects, and of the constant, as (cluster, i, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, c = layout.k, layout.c
        padded = np.append(coef, 0.0)  # position -1: no dummy
        for pdf in batches:
            for part, event, sw, m, f in _dense(layout, pdf):
                mx, mxy, mxx = layout.controls(part)
                # what every row of a cell has besides its own y and controls
                shift = f[:, k] - f[:, :k] @ coef + padded[event]
                total = m[:, k] - mx @ coef[:c] - sw * shift
                score = np.zeros((len(part), k + 1))
                score[:, :c] = mxy - mxx @ coef[:c] - mx * shift[:, None]
                on = event >= 0
                score[on, event[on]] = total[on]
                score[:, :k] -= f[:, :k] * total[:, None]
                score[:, k] = total
                names, g = np.unique(part["_g"].to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), k + 1))
                np.add.at(sums, g, score)
                i, j = np.nonzero(sums)
                yield pd.DataFrame({"g": names[i], "i": j, "v": sums[i, j]})

    return run


def _dense(layout: _Layout, pdf: pd.DataFrame) -> Iterator[tuple]:
    """Blocks of cells: event positions, weights, weighted sums and effects of every regressor and y."""
    k, c = layout.k, layout.c
    step = max(1, BLOCK // (k + 1))
    for low in range(0, len(pdf), step):
        part = pdf.iloc[low : low + step]
        event = part["_event"].map(layout.events).fillna(-1).to_numpy().astype(int)
        sw = part["sw"].to_numpy(float)
        m = np.zeros((len(part), k + 1))
        m[:, :c] = layout.controls(part)[0]
        on = event >= 0
        m[on, event[on]] = sw[on]
        m[:, k] = part["my"].to_numpy(float)
        yield part, event, sw, m, np.stack(part["f"].to_numpy())


def _score_products(scores: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Sum over clusters of score x score', added up in the tasks; and the number of clusters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, clusters = np.zeros((size, size)), 0
        for batch in batches:
            for at, values in zip(batch["i"], batch["v"]):
                u = np.zeros(size)
                u[np.asarray(at)] = values
                total += np.outer(u, u)
            clusters += len(batch)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(total[i, j], clusters)})

    entries = scores.groupBy("g", "i").agg(F.sum("v").alias("v"))
    # a cluster has one entry per regressor at most
    vectors = entries.groupBy("g").agg(F.collect_list(F.struct("i", "v")).alias("u"))
    parts = vectors.select("u.i", "u.v").mapInPandas(run, "i int, j int, v double")
    out, clusters = np.zeros((size, size)), 0
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if row["i"] < 0:
            clusters = round(row["v"])
        else:
            out[row["i"], row["j"]] = row["v"]
    return out, clusters


def _matrix(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Add up (i, j, v) over the tasks; the result has as many entries as the model, not the data."""
    out = np.zeros(shape)
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def absorb(
    df: DataFrame,
    y: str,
    formula: str | list[Term],
    fes: tuple[str, str],
    w: str | None = None,
    cluster: str | None = None,
    event: str | None = None,
    base: int = -1,
    max_levels: int = MAX_LEVELS,
) -> Fit:
    """Fit y on the terms with the two effects ``fes`` absorbed.

    The constant is the weighted mean of y less the fitted part. ``event`` adds one dummy per
    distinct value but ``base`` (named lead1 ... / lag0 ...); rows without a value have none.
    An effect whose levels lie within clusters costs no degrees of freedom. A regressor that the
    effects explain entirely is left out. Effects that fall into parts without a common level have
    one more redundant level per part.

    An effect of at most ``max_levels`` levels is made of dummies; otherwise both are taken out by
    conjugate gradients. The results are the same.
    """
    terms = expand_terms(formula) if isinstance(formula, str) else list(formula)
    # the data are read once; everything after works on the cells
    cells = written(_cells(df, y, terms, *fes, w, cluster, event), "cells")
    whole = cells.agg(
        F.approx_count_distinct("_big").alias("first"),
        F.approx_count_distinct("_small").alias("second"),
        F.sum("n").alias("n"),
        F.sum("sw").alias("sw"),
        F.sum("my").alias("my"),
        F.sum("myy").alias("myy"),
        *[F.sum(f"mx{i}").alias(f"mx{i}") for i in range(len(terms))],
        *[F.sum(f"mxx{i}_{i}").alias(f"mxx{i}") for i in range(len(terms))],
    ).first()
    n, sw = whole["n"], whole["sw"]
    if whole["first"] < whole["second"]:
        cells = cells.withColumns({"_big": F.col("_small"), "_small": F.col("_big")})
    try:
        small_levels = list(few_levels(cells, "_small", max_levels))
        dummies = True
    except TooManyLevels:
        small_levels, dummies = [], False
    shares = few_levels(cells, "_event", MAX_LEVELS) if event else {}
    events = [v for v in shares if v != base]
    layout = _Layout(len(terms), events, small_levels)
    k, m_all = layout.k, len(terms) + len(events)
    if dummies:
        by_group = cells.repartition("_big").sortWithinPartitions("_big")
        upper = _matrix(by_group.mapInPandas(_gram_task(layout), "i int, j int, v double"), (k + 1, k + 1))
    else:
        sums_of = [F.col(f"mx{i}") for i in range(len(terms))]
        sums_of += [F.when(F.col("_event") == v, F.col("sw")).otherwise(0.0) for v in events]
        by_group = written(residual_effects(cells, [*sums_of, F.col("my")]), "effects")
        upper = _matrix(by_group.mapInPandas(_graph_gram_task(layout), "i int, j int, v double"), (k + 1, k + 1))
    sums = (upper + upper.T - np.diag(np.diag(upper))) * (n / sw)
    # what is left of a regressor that the effects explain is rounding
    raw = [whole[f"mxx{i}"] - whole[f"mx{i}"] ** 2 / sw for i in range(len(terms))]
    raw += [shares[v] - shares[v] ** 2 / sw for v in events]
    gone = np.flatnonzero(np.diag(sums)[:m_all] <= 1e-12 * (n / sw) * np.array(raw))
    sums[gone] = sums[:, gone] = 0.0
    # the effects first: what they explain is left out, not one of their levels
    turn = [*range(m_all, k), *range(m_all)]
    coef, inverse, kept = (np.empty(k), np.zeros((k, k)), np.zeros(k, bool))
    coef[turn], inverse[np.ix_(turn, turn)], kept[turn] = solve(sums[np.ix_(turn, turn)], sums[turn, k])
    used = np.where(kept, coef, 0.0)
    rhs, yy = sums[:k, k], sums[k, k]
    rss = max(float(yy - 2 * used @ rhs + used @ sums[:k, :k] @ used), 0.0)
    scale = n / sw
    tss = (whole["myy"] - whole["my"] ** 2 / sw) * scale

    visible = list(range(len(terms) + len(events)))
    means = np.zeros(k)
    means[: len(terms)] = [whole[f"mx{i}"] / sw for i in range(len(terms))]
    for value, at in layout.events.items():
        means[at] = shares[value] / sw
    constant = whole["my"] / sw - float(means[visible] @ used[visible])

    names = [t.name for t in terms] + [event_name(v) for v in events] + [CONSTANT]
    m = int(kept[visible].sum())
    if dummies:
        small_dof = int(kept[len(visible):].sum())
    else:
        small_dof = cells.select("_small").distinct().count() - parts(cells)
    bigs, big_nested = _levels_in_clusters(cells, "_big")
    small_nested = bool(cluster) and _levels_in_clusters(cells, "_small")[1]
    absorbed = (0 if small_nested else small_dof) + (0 if cluster and big_nested else bigs - 1)
    dof = n - m - 1 - absorbed
    full_dof = n - m - 1 - small_dof - (bigs - 1)
    s2 = rss / full_dof if full_dof > 0 else math.nan
    full = np.zeros((k + 1, k + 1))
    stats = {
        "n": n,
        "r2": 1 - rss / tss if tss > 0 else math.nan,
        "r2_a": 1 - (rss / full_dof) / (tss / (n - 1)) if tss > 0 and full_dof > 0 else math.nan,
        "rmse": math.sqrt(s2) if s2 == s2 else math.nan,
        "df_m": m,
        "absorbed": absorbed,
    }
    # within R2: y after both effects, before the regressors
    fe = list(range(len(visible), k))
    if fe:
        fe_coef, _, _ = solve(sums[np.ix_(fe, fe)], rhs[fe])
        left = yy - np.nansum(fe_coef * rhs[fe])
    else:
        left = yy
    if fe or not dummies:
        stats["r2_within"] = 1 - rss / left if left > 0 else math.nan
    if cluster:
        kind = cells.schema["_g"].dataType.simpleString()
        task = _score_task(layout, used) if dummies else _graph_score_task(layout, used)
        scores = by_group.mapInPandas(task, f"g {kind}, i int, v double")
        meat, clusters = _score_products(scores, k + 1)
        stats["clusters"] = clusters
        if clusters < 2:
            raise ValueError("cluster-robust errors need at least two clusters")
        # from scores to the influence on (coefficients, constant)
        reach = np.zeros((k + 1, k + 1))
        reach[:k, :k] = inverse
        reach[k, k] = 1 / n
        reach[k] -= means[visible] @ reach[visible]
        full = cluster_factor(clusters, n, n - dof) * reach @ (meat * scale * scale) @ reach.T
        df_resid = clusters - 1
    else:
        full[:k, :k] = inverse * s2
        cross = -full[:k, visible] @ means[visible]
        full[:k, k] = full[k, :k] = cross
        full[k, k] = s2 / n + means[visible] @ full[np.ix_(visible, visible)] @ means[visible]
        df_resid = full_dof
    show = [*visible, k]
    return Fit(names, np.append(coef[visible], constant), full[np.ix_(show, show)], df_resid, stats)


def event_name(value: int) -> str:
    return f"lead{-value}" if value < 0 else f"lag{value}"


def _levels_in_clusters(cells: DataFrame, level: str) -> tuple[int, bool]:
    """How many levels there are, and whether each lies within one cluster."""
    spread = cells.groupBy(level).agg((F.min("_g") != F.max("_g")).alias("_two"))
    count, crossing = spread.agg(F.count(F.lit(1)), F.max("_two")).first()
    return count, not crossing


def demean_in_turns(
    df: DataFrame, columns: list[str], fes: tuple[str, ...], w: str, tolerance: float = 1e-10, max_rounds: int = 200
) -> DataFrame:
    """Subtract weighted group means of each effect in turn until the largest mean is below ``tolerance``.

    Means are relative to each column's spread. Rows collapse to one cell per combination of the effects, and what
    has been subtracted is kept per cell: a round works on the cells and is written to the checkpoint folder, so
    the plan stays short; the rows are read once for the cells and meet them in one join at the end.
    """
    one = df.agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns]).first()
    size = {c: one[f"s_{c}"] or 1.0 for c in columns}
    # values are taken from their mean, so that sums of them hold no large common part
    start = {c: one[f"m_{c}"] or 0.0 for c in columns}
    sums = []
    for c in columns:
        held = F.when(F.col(c).isNotNull(), F.col(w))
        sums += [F.sum(held).alias(f"_w_{c}"), F.sum(held * (F.col(c) - F.lit(start[c]))).alias(f"_v_{c}")]
    cells = df.dropna(subset=list(fes)).groupBy(*fes).agg(*sums)
    current = checkpointed(cells.withColumns({f"_d_{c}": F.lit(0.0) for c in columns}))
    for _ in range(max_rounds):
        for fe in fes:
            left = {c: F.sum(F.col(f"_v_{c}") - F.col(f"_w_{c}") * F.col(f"_d_{c}")) for c in columns}
            means = current.groupBy(fe).agg(*[F.try_divide(left[c], F.sum(f"_w_{c}")).alias(f"_b_{fe}_{c}") for c in columns])
            current = sized_join(current, means, [fe])
            current = current.withColumns({f"_d_{c}": F.col(f"_d_{c}") + F.col(f"_b_{fe}_{c}") for c in columns})
        bounds = [
            F.max(F.abs(F.col(f"_b_{fe}_{c}")) / F.lit(size[c])) for fe in fes for c in columns
        ]
        current = checkpointed(current)
        worst = max(v or 0.0 for v in current.agg(*bounds).first())
        current = current.drop(*[f"_b_{fe}_{c}" for fe in fes for c in columns])
        if worst < tolerance:
            joined = sized_join(df, current.select(*fes, *[f"_d_{c}" for c in columns]), list(fes))
            return joined.select(*[
                (F.col(c) - F.lit(start[c]) - F.col(f"_d_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
            ])
    raise RuntimeError(f"demeaning did not settle within {max_rounds} rounds")


def absorb_in_turns(
    df: DataFrame,
    y: str,
    formula: str | list[Term],
    fes: tuple[str, ...],
    w: str | None = None,
    cluster: str | None = None,
    tolerance: float = 1e-10,
) -> Fit:
    """The same model by alternating projections, for any number of effects.

    Degrees of freedom and statistics are those of ``absorb``: every level of the effects
    but one each, none for an effect whose levels lie within clusters. Two effects that fall into
    parts without a common level have one more redundant level per part; among more than two
    effects such levels are not looked for.
    """
    terms = expand_terms(formula) if isinstance(formula, str) else list(formula)
    cols = ["_y", *[f"_x{i}" for i in range(len(terms))]]
    rows = df.select(
        *fes,
        *([F.col(cluster).alias("_g")] if cluster else []),
        (F.lit(1.0) if w is None else F.col(w).cast("double")).alias("_w"),
        F.col(y).cast("double").alias("_y"),
        *[t.column().alias(f"_x{i}") for i, t in enumerate(terms)],
    ).where(F.col("_w") > 0)
    rows = rows.dropna(subset=[*fes, *cols, *(["_g"] if cluster else [])])
    rows = checkpointed(rows)
    middle = [wmean(c, "_w").alias(c) for c in cols]
    levels = [F.count_distinct(f).alias(f"_n_{f}") for f in fes]
    raw = rows.agg(*middle, *levels, F.sum("_w").alias("_sw")).first()
    away = F.col("_y") - F.lit(raw["_y"])
    tss = rows.agg(F.sum(F.col("_w") * away * away)).first()[0]
    flat = demean_in_turns(rows, cols, fes, "_w", tolerance)
    plain = [Term(((f"_x{i}", 1),)) for i in range(len(terms))]
    fit = wls(flat, "_y", plain, "_w", "_g" if cluster else None)
    n, m = fit.stats["n"], fit._rank - 1
    tss *= n / raw["_sw"]
    rss = fit.stats["rmse"] ** 2 * (n - m - 1)
    costs = {f: raw[f"_n_{f}"] - 1 for f in fes}
    if len(fes) == 2:
        costs[min(fes, key=costs.__getitem__)] -= parts(rows.select(*[F.col(f).alias(c) for f, c in zip(fes, ("_big", "_small"))])) - 1
    every = sum(costs.values())
    absorbed = every
    if cluster:
        absorbed = sum(costs[f] for f in fes if not _levels_in_clusters(rows, f)[1])
    full_dof = n - m - 1 - every
    slopes = fit.coef[:-1]
    fit.names = [t.name for t in terms] + [CONSTANT]
    fit.coef = np.append(slopes, raw["_y"] - np.nansum(slopes * [raw[f"_x{i}"] for i in range(len(terms))]))
    if cluster:
        fit.cov = fit.cov * (n - m - 1) / (n - m - 1 - absorbed)
    else:
        fit.cov = fit.cov * fit.df_resid / full_dof
        fit.df_resid = full_dof
    kept = ~np.isnan(slopes)
    fit.cov = recentred(fit.cov, np.where(kept, [raw[f"_x{i}"] for i in range(len(terms))], 0.0))
    s2 = rss / full_dof if full_dof > 0 else math.nan
    fit.stats = {
        "n": n,
        "r2": 1 - rss / tss if tss > 0 else math.nan,
        "r2_a": 1 - s2 / (tss / (n - 1)) if tss > 0 else math.nan,
        "rmse": math.sqrt(s2) if s2 == s2 else math.nan,
        "df_m": m,
        "absorbed": absorbed,
        "r2_within": fit.stats["r2"],
    } | ({"clusters": fit.stats["clusters"]} if cluster else {})
    return fit
