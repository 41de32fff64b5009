"""Ordered operators on a log of which one user holds a third; prints one JSON line.

    python bench_skew.py [rows, default 10000000]

The log is made by Spark and written once. Each operator is timed beside a plain window per
user, and their results are compared.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, Window, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayline.operators.sessions import event_gaps, login_starts
from stayline.session import local_session, stage


def log(spark, rows: int) -> DataFrame:
    n = F.col("id")
    user = F.when(n % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(n), F.lit(max(rows // 66, 1))))
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64(n, F.lit(1)), F.lit(31 * 86400)))
    return stage(spark.range(rows).select(
        n.alias("event_id"), user.cast("long").alias("user_id"), at.alias("created"),
        F.lit("x").alias("event_name"), F.lit("y").alias("level")), "skewed-log")


def seconds(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stayline-skew")
    spark.sparkContext.setLogLevel("ERROR")
    events = log(spark, rows)
    order = Window.partitionBy("user_id").orderBy("created", "event_id")
    plain = events.withColumn("before", F.lag("created").over(order))
    gaps = event_gaps(events, ["event_id"], hot_rows=rows // 10)
    checksum = lambda c: F.sum(F.round(c * 3600).cast("long")).alias("s")
    hours = (F.unix_timestamp("created") - F.unix_timestamp("before")) / 3600
    same = plain.agg(checksum(hours)).first()["s"] == gaps.agg(checksum(F.col("gap_hours"))).first()["s"]
    found = {"plain_window": seconds(plain), "event_gaps": seconds(gaps), "login_starts": seconds(login_starts(events))}
    spark.stop()
    print(json.dumps({"rows": rows, "equal": same, "seconds": found}))


if __name__ == "__main__":
    main()
