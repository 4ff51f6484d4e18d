"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "orders_roundtrip_totals",
    "bgm_extract",
    "nad_qualified_supplier",
    "message_segment_count",
    "envelope_count_mismatch",
    "directory_issues",
    "profile_pack_issues",
    "report_severity_counts",
    "invoice_value_by_supplier_nation",
    "unescape_roundtrip",
)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tradewire.functions.syntax import DEFAULT
    from tradewire.operators.parse import parse
    from tradewire.operators.validate import ValidationContext, as_messages
    from tradewire.plans import build
    from tradewire.plans import queries as plans

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    run(plans.QUERIES["bgm_extract"](spark, SF_DIR))  # compiles and warms up
    for name in NAMES:
        t = time.time()
        run(plans.QUERIES[name](spark, SF_DIR))
        took[name] = round(time.time() - t, 3)

    # Throughput over text that is already built: parse alone, and parse with validation.
    texts = build.order_messages(spark, SF_DIR).repartition(int(CPUS)).cache()
    megabytes = texts.agg(F.sum(F.octet_length("content"))).first()[0] / 1e6
    rate: dict[str, float] = {}
    for name, df in (
        ("parse", parse(texts, chars=DEFAULT)),
        ("parse_spans", parse(texts, chars=DEFAULT, spans=True)),
        ("parse_validate", ValidationContext().with_validator("structure", plans.DIRECTORY).validate(as_messages(parse(texts, chars=DEFAULT)))),
    ):
        t = time.time()
        run(df)
        rate[name] = round(megabytes / (time.time() - t), 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "mb_per_s": rate, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
