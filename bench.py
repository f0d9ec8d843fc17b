"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driver_queries import QUERIES  # noqa: E402
from panelspark.session import build_session  # noqa: E402

HEADLINE = [
    "keep_latest_lineitem",
    "unit_standing",
    "regional_energy",
    "interconnector_flows",
    "flow_attribution",
    "rooftop_left_join",
    "renewables_daily",
    "cost_concentration",
    "calendar_columns",
    "treatment_flags",
    "holiday_flag",
    "interpolate_hold",
    "fill_both_ways",
    "midday_baseline",
    "daily_downsample",
    "sun_labels",
    "cell_means",
    "intraday_profiles",
    "wls_cluster",
    "ddd_saturated",
    "absorb_two_way",
    "event_study",
    "section_split_roundtrip",
    "link_inventory",
    "typed_csv_scan",
    "study_panel",
    "study_base_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.log.level": "ERROR",
        },
    )
    # start the executor threads and the Python workers before the clock runs
    QUERIES["half_hour_bucket"](spark, folder).write.format("noop").mode("overwrite").save()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
