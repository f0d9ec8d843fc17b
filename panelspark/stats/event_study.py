"""Event studies: effects by time to the event, with joint tests of leads and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .absorb import MAX_LEVELS, absorb
from .wls import Fit, joint_test


def event_study(
    df: DataFrame,
    y: str,
    controls: str,
    event: str | Column,
    fes: tuple[str, str],
    w: str | None = None,
    cluster: str | None = None,
    base: int = -1,
    max_levels: int = MAX_LEVELS,
    dropped: bool = False,
) -> Fit:
    """Two-way fixed effects with a dummy per value of ``event`` (NULL for rows never treated).

    The statistics hold the joint F tests of all leads and of all lags; ``dropped`` as in
    ``joint_test``.
    """
    if not isinstance(event, str):
        df, event = df.withColumn("_time", event.cast("int")), "_time"
    fit = absorb(df, y, controls, fes, w, cluster, event=event, base=base, max_levels=max_levels)
    for kind in ("lead", "lag"):
        names = [n for n in fit.names if n.startswith(kind) and n[len(kind):].isdigit()]
        if names:
            fit.stats |= {f"{kind}s_{k}": v for k, v in joint_test(fit, names, dropped=dropped).items()}
    return fit


def treated_time(days: str, treated: str) -> Column:
    """Event time of treated rows, NULL for the others."""
    return F.when(F.col(treated), F.col(days))
