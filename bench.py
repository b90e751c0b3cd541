"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the sample folder, BENCH_CPUS the local cores.  A query is
timed from building its plan to having computed every row and column (``noop``
sink), after one small warm-up.
"""

from __future__ import annotations

import json
import os
import re
import time

from creditloom.queries import all_queries, common
from creditloom.session import build_session

HEADLINE = [
    "app_features",
    "bureau_features",
    "previous_features",
    "installment_features",
    "pos_features",
    "card_features",
    "h1_variance",
    "h2_trajectory",
    "h3_recency",
    "h6_velocity",
    "experimental_winning",
    "feature_table_train",
    "stratified_folds",
    "target_encode_fold",
    "auc_exact",
    "threshold_table",
    "blend_2",
    "blend_4",
    "profile_all",
    "train_cv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    common.COMPARED = False  # the operators' own values: rounding belongs to the comparison
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    queries["bureau_features"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
