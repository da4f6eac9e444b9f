"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  The nine tables are written once (``load_tables``) and the
queries read them.  Each query is run once on the smallest data to load classes
and compile its code, then timed once to a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.fixture import LoadedFixture, store_tables  # noqa: E402
from checks.registry import BUILDERS  # noqa: E402
from matchspark.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
WARM_DIR = os.path.join(os.path.dirname(SF_DIR), "sf0.001")

HEADLINE = [
    "position_feed",
    "candidate_feed",
    "reaction_history",
    "match_feed",
    "dual_feed_page",
    "paginate_all",
    "ingest_reactions",
    "ingest_recommendations",
    "ingest_positions",
    "ingest_users",
    "adjudicate_reactions",
    "derive_matches",
    "cascade_delete",
    "audit_foreign_keys",
    "inner_product_topk",
    "recommend",
    "inner_product_topk_approx",
    "inner_product_topk_cells",
    "embed_pending",
    "signin_outcome",
    "clean_names",
    "assign_ulids",
]


def run(fixture: LoadedFixture, name: str) -> float:
    start = time.perf_counter()
    BUILDERS[name](fixture).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def load(spark, sf_dir: str) -> tuple[LoadedFixture, float]:
    start = time.perf_counter()
    fixture = LoadedFixture(spark, sf_dir, store_tables(spark, sf_dir))
    return fixture, time.perf_counter() - start


def main() -> None:
    spark = local_session("bench")
    warm = load(spark, WARM_DIR)[0] if os.path.isdir(WARM_DIR) else None
    fixture, took = load(spark, SF_DIR)
    times = {"load_tables": round(took, 3)}
    for name in sys.argv[1:] or HEADLINE:
        if warm is not None:
            run(warm, name)
        times[name] = round(run(fixture, name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
            }
        )
    )


if __name__ == "__main__":
    main()
