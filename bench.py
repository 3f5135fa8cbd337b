"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import new_path
from tidemark.plans.news import news_run
from tidemark.plans.registry import QUERIES
from tidemark.session import local_session
from tidemark.sources import sinks

HEADLINE = [
    "event_index_topk", "retention_caps", "quarter_series", "growth_shift_join", "version_final_wins", "version_corrected_latest", "upsert_last_wins", "value_audit", "band_join_72h", "url_canonical", "two_key_dedupe", "similarity_clusters",
    "relevance_ladder", "importance_score", "keyword_categories", "event_signals", "pii_redact", "code_extract_route", "operation_rollup", "integrity_findings", "stream_cursor_upsert",
]


def by_companies(spark: SparkSession, count: int) -> float:
    """Seconds of a news run over so many companies, three items each that become one event, written by company and as an index."""
    code = F.lpad((F.col("id") + 1).cast("string"), 6, "0")
    name = F.concat(F.lit("테스트기업"), (F.col("id") + 1).cast("string"))
    companies = spark.range(count).select(code.alias("stock_code"), name.alias("company_name"), F.array(name).alias("aliases"), F.array(F.lit("material")).alias("important_keywords"))
    item = F.concat(F.lit("https://news.example.com/"), code, F.lit("/"))
    raw = spark.range(count).select(code.alias("stock_code"), F.concat(name, F.lit(" material supply contract")).alias("title"), item.alias("item"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    raw = raw.select("stock_code", "title", F.lit("").alias("description"), F.concat("item", F.col("k").cast("string")).alias("url"), F.when(F.col("k") < 2, "naver").otherwise("gdelt").alias("provider"), F.lit("2026-07-17T08:00:00Z").alias("published_at"), F.lit("Korean").alias("language"))
    path = new_path(spark, "bench")
    began = time.perf_counter()
    run = news_run(raw, companies, F.lit("2026-07-17 09:00:00").cast("timestamp"), "2026-07-17")
    sinks.write_if_changed(run["events"], f"{path}/events")
    run["index"].write.mode("overwrite").parquet(f"{path}/index")
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores), os.environ.get("BENCH_MEMORY", "8g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run = time.perf_counter() - began
            best = run if best is None else min(best, run)
        took[name] = round(best, 3)
    companies = {str(n): min(by_companies(spark, n) for _ in range(2)) for n in (100, 200)}  # the published run: 5.888 and 15.615 s
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "companies": companies, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
