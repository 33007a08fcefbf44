"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (test tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs).
Each query is warmed up once, then run BENCH_RUNS times into the ``noop`` sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aulario import build_session, project_testdata  # noqa: E402
from aulario.catalog.queries import FILTER, QUERIES  # noqa: E402
from aulario.operators import reports  # noqa: E402

HEADLINE = [
    "rp01_top_rooms",
    "rp02_turno_demand",
    "rp03_avg_participants",
    "rp04_bookings_by_programme",
    "rp05_building_occupancy",
    "rp06_bookings_by_role",
    "rp07_sanctions_by_role",
    "rp08_state_share",
    "rp09_cancellation_rate",
    "rp10_top_participants",
    "rp11_mean_lead_days",
    "rp05_building_occupancy_filtered",
    "vw06_my_reservations",
    "wn3_island_summary",
    "sw2_sweep_blocks",
    "sn3_coalesce",
    "ad2_bookings_admin_snapshot",
    "ad2_bookings_admin_sequential",
    "ch02_cancel_notifications",
    "ch04_modify_reserva",
]


def all_reports_cached(spark, sf_dir: str) -> None:
    """The eleven reports over one persisted pair of reservation and participation tables."""
    t = project_testdata(spark, sf_dir).cached("reserva", "reserva_participante")
    for report in reports.REPORTS.values():
        report(t, FILTER).write.format("noop").mode("overwrite").save()
    t.release("reserva", "reserva_participante")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    jobs = {
        name: (lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
        for name in HEADLINE
    }
    jobs["rp_all_cached"] = lambda: all_reports_cached(spark, sf_dir)

    seconds: dict[str, float] = {}
    for name, job in jobs.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
