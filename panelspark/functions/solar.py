"""Sunrise and sunset as column expressions (published NOAA solar equations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: at sunrise the sun's centre is this many degrees from the zenith
# (90 plus half its disc plus refraction).
HORIZON_ZENITH = 90.833


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def _event_minutes(df: DataFrame, guess: str, lat: str, lon: str, rising: bool, out: str) -> DataFrame:
    """Add ``out``: minutes after UTC midnight of the event, equations taken at ``guess``.

    Steps are separate columns so that each is worked out once per row.
    """
    t = F.col("_t")
    df = df.withColumn("_t", F.col("_century") + F.col(guess) / 1440.0 / 36525.0)
    df = df.withColumns(
        {
            "_long": F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0)),
            "_anom": 357.52911 + t * (35999.05029 - 0.0001537 * t),
            "_ecc": 0.016708634 - t * (0.000042037 + 0.0000001267 * t),
            "_node": 125.04 - 1934.136 * t,
        }
    )
    anom, ecc, node = F.col("_anom"), F.col("_ecc"), F.col("_node")
    df = df.withColumns(
        {
            "_apparent": F.col("_long")
            + _sin(anom) * (1.914602 - t * (0.004817 + 0.000014 * t))
            + _sin(2 * anom) * (0.019993 - 0.000101 * t)
            + _sin(3 * anom) * 0.000289
            - 0.00569
            - 0.00478 * _sin(node),
            "_obliq": 23.0
            + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0
            + 0.00256 * _cos(node),
        }
    )
    df = df.withColumns(
        {
            "_decl": F.asin(_sin(F.col("_obliq")) * _sin(F.col("_apparent"))),
            "_y": F.pow(F.tan(F.radians(F.col("_obliq") / 2)), F.lit(2.0)),
        }
    )
    y, long2 = F.col("_y"), 2 * F.col("_long")
    df = df.withColumns(
        {
            # equation of time, minutes
            "_eqt": 4
            * F.degrees(
                y * _sin(long2)
                - 2 * ecc * _sin(anom)
                + 4 * ecc * y * _sin(anom) * _cos(long2)
                - 0.5 * y * y * _sin(2 * long2)
                - 1.25 * ecc * ecc * _sin(2 * anom)
            ),
            "_cosha": _cos(F.lit(HORIZON_ZENITH)) / (_cos(F.col(lat)) * F.cos("_decl"))
            - F.tan(F.radians(F.col(lat))) * F.tan("_decl"),
        }
    )
    # |cos| > 1: the sun does not cross the horizon that day -> NULL
    angle = F.when(F.abs("_cosha") <= 1, F.degrees(F.acos("_cosha")))
    signed = angle if rising else -angle
    df = df.withColumn(out, 720.0 - 4.0 * (F.col(lon) + signed) - F.col("_eqt"))
    return df.drop("_t", "_long", "_anom", "_ecc", "_node", "_apparent", "_obliq", "_decl", "_y", "_eqt", "_cosha")


def add_sun_times(df: DataFrame, day: str, lat: str, lon: str) -> DataFrame:
    """Add ``sunrise_utc`` and ``sunset_utc`` (NTZ, whole seconds) for the local day ``day``.

    The equations are evaluated twice, the second time at the first estimate.
    """
    df = df.withColumns(
        {
            "_century": (F.datediff(F.col(day), F.lit("2000-01-01").cast("date")) - 0.5) / 36525.0,
            "_noon": 720.0 - 4.0 * F.col(lon),
        }
    )
    for rising, out in ((True, "sunrise_utc"), (False, "sunset_utc")):
        df = _event_minutes(df, "_noon", lat, lon, rising, "_first")
        df = _event_minutes(df, "_first", lat, lon, rising, "_minutes")
        seconds = F.unix_seconds(F.col(day).cast("timestamp")) + F.floor(F.col("_minutes") * 60.0)
        df = df.withColumn(out, F.timestamp_seconds(seconds).cast("timestamp_ntz")).drop("_first", "_minutes")
    return df.drop("_century", "_noon")
