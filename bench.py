"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "clean_text", "norm_key", "quality_profile", "length_stats", "class_dist", "duplicate_audit",
    "clean_corpus", "filter_ledger", "stratified_split", "audited_splits", "split_overlap",
    "kfold", "phrase_hits", "passage_hits", "leak_verdict", "boilerplate", "ngrams", "vocab",
    "tfidf", "nb_params", "near_dups", "metrics", "skills", "screening_score", "catalogue_match",
    "nb_fit", "svc_fit", "lr_fit", "score_docs", "stream_screening",
]


def main() -> None:
    from docscreen.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          memory=os.environ.get("BENCH_MEMORY", "16g"))

    import docscreen.model_queries  # noqa: F401
    from docscreen.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    QUERIES["clean_text"](spark, sf_dir).limit(1).collect()  # start the executors
    for name in names:
        started = time.perf_counter()
        # The full result is computed; nothing is sent to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
