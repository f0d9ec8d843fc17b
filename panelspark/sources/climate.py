"""Nested climate documents to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import pivot_wider

CLIMATE_SCHEMA = (
    "data struct<climateGraphs: map<string, struct<dataConfig: struct<series: struct<"
    "groups: array<struct<dateTime: string, points: array<struct<x: double, y: double>>>>>>>>>"
)


def metric_name(metric: Column) -> Column:
    """``avg-wind-speed`` -> ``avg_wind_speed_km_per_h``."""
    return F.concat(F.replace(metric, F.lit("-"), F.lit("_")), F.lit("_km_per_h"))


def flatten_climate(docs: DataFrame, json: str, keep: Sequence[str] = ("regionid",)) -> DataFrame:
    """(keep..., metric, date, t, value): one row per point of every metric of every document."""
    parsed = docs.select(*keep, F.from_json(json, CLIMATE_SCHEMA).alias("_doc"))
    metrics = parsed.select(*keep, F.explode("_doc.data.climateGraphs").alias("_metric", "_graph"))
    groups = metrics.select(*keep, "_metric", F.explode("_graph.dataConfig.series.groups").alias("_day"))
    points = groups.select(*keep, "_metric", "_day.dateTime", F.explode("_day.points").alias("_point"))
    return points.select(
        *keep,
        metric_name(F.col("_metric")).alias("metric"),
        F.to_date(F.to_timestamp("dateTime", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.col("_point.x").alias("t"),
        F.col("_point.y").alias("value"),
    )


def daily_metrics(points: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ("regionid",)) -> DataFrame:
    """Mean of each metric per key and day, one column per metric."""
    wide = pivot_wider(points, [*keep, "date"], "metric", list(metrics), {"v": F.avg("value")})
    return wide.withColumnsRenamed({f"v_{m}": m for m in metrics})


def flatten_map(docs: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., key, value) of a flat JSON object of numbers."""
    return docs.select(*keep, F.explode(F.from_json(json, "map<string, double>")).alias("key", "value"))
