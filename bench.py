"""Headline queries, timed: one JSON line on stdout.

Each query is executed once to warm code paths at the same scale and then
timed; the result is written to Spark's no-op sink, so every row and column is
computed.
"""

from __future__ import annotations

import json
import os
import time

from replyforge.plans.catalog import QUERIES
from replyforge.session import local_session

HEADLINE = (
    "extract_brand", "pair_replies", "conversation_roots", "turn_index", "root_depth_cap",
    "clean_pairs", "clean_ledger", "null_profile", "top_brands", "conversation_stats",
    "clean_text", "word_topk", "bigram_topk", "doc_freq", "tfidf", "tfidf_sublinear",
    "weak_label", "auto_label", "keyword_baseline", "escalation_reason",
    "quota_sample", "golden_sample", "train_val_split", "class_report", "model_comparison",
    "route_batch", "judge_all", "rater_agreement", "train_score", "topic_clusters",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        build = QUERIES[name]
        run(build(spark, sf_dir))
        start = time.perf_counter()
        run(build(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "replyforge headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
