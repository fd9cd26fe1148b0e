"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each
query is written to the no-op sink, so all of its rows and columns are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

import loomwork.plans  # noqa: F401
from loomwork.plans.registry import QUERIES
from loomwork.session import build_session, release

HEADLINE = [
    "corpus_clean", "text_shards", "char_budget", "mixture_oversample", "hash_split", "chat_validate",
    "manifest_counts", "pretoken_counts", "pair_counts_first_merge", "bpe_train_k", "encode_roundtrip",
    "compression_by_class", "render_ids_mask", "instruction_record", "toolcall_parts", "toolcall_check",
    "chunk_fixed", "random_windows", "pack_crop", "pack_pad", "bits_per_byte", "option_choice",
    "categorical_eval", "pass_at_k", "pg_objective", "log_parse", "ema_loss", "throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's and Python's workers before the clock does.
    spark.range(1000).selectExpr("sum(id)").collect()
    QUERIES["toolcall_check"](spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")).collect()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
