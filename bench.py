"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from stratalog import catalogue
from stratalog.session import session

NAMES = ["dependency_package_summary", "game_catalog_stats", "missing_by_file", "current_edges", "indexed_coverage_game", "provider_coverage", "game_match_rank", "used_by", "duplicate_keepers", "access_summary", "top_ips", "event_promotion_15s", "file_page_deps", "search_merged", "provider_selection", "dependency_closure"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
