"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from perigee.plans.queries import QUERIES
from perigee.session import local_session, ship

HEADLINE = ("tokens_per_doc", "idf_top_terms", "tfidf_norms", "career_score", "authorship_score", "selectivity_cutoffs", "feed_balanced", "feed_bundle", "scope_filter", "upsert", "due_scans", "nearest_peer", "crowding", "phrase_rarity", "novelty_score", "entity_resolution")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 32)
    ship(spark)
    took = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't a query's
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
