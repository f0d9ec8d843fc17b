"""The estimated models of the study, each a row in a table of specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import with_labels
from ..session import written
from ..stats.event_study import event_study, treated_time
from ..stats.many import Model, wls_many
from ..stats.wls import Fit

# Scale of the cubed wind speed, so that its coefficient is readable.
WIND_SCALE = 10_000.0
# Model formulas.
DID = "dst_here_anytime*dst_now_anywhere"
DDD = "dst_here_anytime*dst_now_anywhere*not_midday"
CONTROLS = "weekend_local + public_holiday + temperature + temperature^2 + solar_exposure + wind_3"
EVENT_CONTROLS = "public_holiday + temperature + temperature^2 + solar_exposure + wind_3"
# The short sample starts in this year and leaves this transition out.
SHORT_SAMPLE_YEAR = 2019
SHORT_SAMPLE_DROP = "2018-start"

LABELS = {
    "dst_here_anytime": "Treatment region",
    "dst_now_anywhere": "Summer time in force",
    "not_midday": "Outside 12:00-14:30",
    "weekend_local": "Weekend",
    "public_holiday": "Public holiday",
    "temperature": "Daily maximum temperature (degrees C)",
    "solar_exposure": "Daily solar exposure (kWh per square metre)",
    "wind_3": "Wind speed cubed / 10000",
}


def model_frame(panel: DataFrame) -> DataFrame:
    """Panel with 0/1 flags, cubed wind, logs and event time, labelled."""
    flags = [
        "dst_start",
        "after_transition",
        "dst_now_anywhere",
        "dst_here_anytime",
        "dst_now_here",
        "weekend_local",
        "public_holiday",
    ]
    wind = F.col("wind_km_per_h")

    def log(c: str) -> Column:
        return F.when(F.col(c) > 0, F.ln(c))

    framed = panel.withColumns(
        {
            "timevar": treated_time("days_into_dst", "dst_here_anytime"),
            "not_midday": F.coalesce(F.col("not_midday_control_local"), F.lit(False)).cast("double"),
            "wind_3": wind * wind * wind / WIND_SCALE,
            "ln_co2": log("co2_kg_per_capita"),
            "ln_energy": log("energy_kwh_per_capita"),
            "ln_co2_vs_midday": log("co2_g_per_capita_vs_midday"),
            "date": F.col("date_local"),
        }
    )
    numeric = framed.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags})
    return with_labels(numeric, LABELS)


@dataclass(frozen=True)
class Spec:
    y: str
    formula: str
    kind: str = "wls"
    sample: str = "all"


SAMPLES = {
    "all": None,
    "start": "dst_start = 1",
    "stop": "dst_start = 0",
    "without_tas": "regionid <> 'TAS1'",
    "short": f"year(date) >= {SHORT_SAMPLE_YEAR} AND dst_transition_id <> '{SHORT_SAMPLE_DROP}'",
}

SPECS = {
    "co2_base": Spec("co2_kg_per_capita", DID),
    "co2_did": Spec("co2_kg_per_capita", f"{DID} + {CONTROLS}"),
    "energy_base": Spec("energy_kwh_per_capita", DID),
    "energy_did": Spec("energy_kwh_per_capita", f"{DID} + {CONTROLS}"),
    "co2_event": Spec("co2_kg_per_capita", EVENT_CONTROLS, "event"),
    "energy_event": Spec("energy_kwh_per_capita", EVENT_CONTROLS, "event"),
    "co2_ddd": Spec("co2_kg_per_capita", f"{DDD} + {CONTROLS}"),
    "energy_ddd": Spec("energy_kwh_per_capita", f"{DDD} + {CONTROLS}"),
    "co2_midday_event": Spec("co2_g_per_capita_vs_midday", EVENT_CONTROLS, "event"),
    "energy_midday_event": Spec("energy_wh_per_capita_vs_midday", EVENT_CONTROLS, "event"),
    "co2_midday_event_start": Spec("co2_g_per_capita_vs_midday", EVENT_CONTROLS, "event", "start"),
    "co2_midday_event_stop": Spec("co2_g_per_capita_vs_midday", EVENT_CONTROLS, "event", "stop"),
    "co2_midday_event_without_tas": Spec("co2_g_per_capita_vs_midday", EVENT_CONTROLS, "event", "without_tas"),
    "energy_midday_event_without_tas": Spec("energy_wh_per_capita_vs_midday", EVENT_CONTROLS, "event", "without_tas"),
    "ln_co2_midday_event_without_tas": Spec("ln_co2_vs_midday", EVENT_CONTROLS, "event", "without_tas"),
    "ln_co2_ddd": Spec("ln_co2", f"{DDD} + {CONTROLS}"),
    "ln_energy_ddd": Spec("ln_energy", f"{DDD} + {CONTROLS}"),
    "co2_ddd_base": Spec("co2_kg_per_capita", DDD),
    "energy_ddd_base": Spec("energy_kwh_per_capita", DDD),
    "co2_ddd_short": Spec("co2_kg_per_capita", f"{DDD} + {CONTROLS}", sample="short"),
    "energy_ddd_short": Spec("energy_kwh_per_capita", f"{DDD} + {CONTROLS}", sample="short"),
    "co2_midday_event_short": Spec("co2_g_per_capita_vs_midday", EVENT_CONTROLS, "event", "short"),
    "energy_midday_event_short": Spec("energy_wh_per_capita_vs_midday", EVENT_CONTROLS, "event", "short"),
}


def estimate(
    frame: DataFrame,
    specs: dict[str, Spec],
    w: str = "population",
    cluster: str = "regionid",
    fes: tuple[str, str] = ("regionid", "date"),
    samples: dict[str, str | None] | None = None,
) -> dict[str, Fit]:
    """Fit every specification on its sub-sample of the model frame.

    The plain regressions share three scans of their columns; an event study reads its sample once.
    """
    samples = SAMPLES if samples is None else samples
    plain = {n: Model(s.y, s.formula, samples[s.sample]) for n, s in specs.items() if s.kind == "wls"}
    events = {n: s for n, s in specs.items() if s.kind == "event"}
    if events:
        frame = written(frame, "model-frame")
    fits = wls_many(frame, plain, w, cluster) if plain else {}
    for name, spec in events.items():
        condition = samples[spec.sample]
        rows = frame if condition is None else frame.where(condition)
        fits[name] = event_study(rows, spec.y, spec.formula, "timevar", fes, w, cluster)
    return {name: fits[name] for name in specs}
