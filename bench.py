"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = [
    "filter_and", "like", "text_fns", "round", "arith", "ts_cmp", "format_time", "group_stats", "count_distinct", "compound_key", "bucket", "window_text",
    "top_k", "having", "first_last", "lines_json_path", "lines_json_group", "lines_logfmt", "lines_pattern_group",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from logspark import catalogue

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = catalogue.queries()[name]
        times = []
        for k in range(4):  # the first warms up; slow ones are run twice only
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if k and sum(times) > 12:
                break
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
