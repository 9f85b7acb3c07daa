"""Seconds per headline query, one JSON line on standard output.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (blank-separated) another choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import REGISTRY  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = """
match_view side_rows last_five_means last_results last_stats_flat head_to_head_results matchup_info
season_record season_rankings season_play_value player_season_average player_last_role_figures
opponent_allowed_points team_calendar_shares week_ranks volume_shares primary_so_far
lineup_ratings_by_role scoring_rules passer_rates running_standings standings_on_spine
passer_ratings_to_date play_types play_attributes person_names net_penalty_yards
match_attributes names_to_ids token_counts
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # The first query also pays for class loading; run a small one before.
    REGISTRY["match_view"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
