"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from faultlens.plans import registry  # noqa: E402
from faultlens.session import build_session  # noqa: E402

HEADLINE = (
    "inverted_index keyword_search owner_ranking locate_files rare_anchors vector_search vector_owner_ranking hybrid_search cascade_locate "
    "scorecard fault_records routing_fusion component_prior scrubbed_texts mining_outcomes resolved_calls dependency_order fix_scorecard "
    "run_scorecard fired_rules folded_tiers index_states stored_index_search owner_ranking_held_out"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = registry.queries()
    took = {}
    for name in names if names != ["all"] else list(queries):
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf else None}))


if __name__ == "__main__":
    main()
