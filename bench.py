"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tastemark.plans.catalog import QUERIES  # noqa: E402
from tastemark.session import get_session  # noqa: E402

HEADLINE = [
    "join_review_business", "rating_and_time_matrices", "density_sample", "split_by_user_time", "train_corpus_rows", "user_neighbours",
    "user_knn_lists", "item_knn_scores", "ranking_metrics", "k_sweep_users", "user_category_matrix", "clean_reviews", "item_tfidf",
    "item_text_neighbours", "top_bigrams", "highlight_phrases",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors before the clock
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
