"""Events as the log of model calls: users are runs, event types are models and phases, values are latencies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runlogs
from ..sources.shared import shared_path
from ..streaming import logs
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()

CALLS = "c AS (SELECT event_id, ts, user_id AS run_id, event_type AS model, value AS latency_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type <> 'error' AS ok FROM events)"
RATE = "CASE WHEN latency_ms > 0 THEN k / (latency_ms / 1000) END"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.struct((k * 2).alias("prompt_tokens"), k.alias("completion_tokens"), (k * 3).alias("total_tokens"))
    none = F.lit(None).cast("double")
    return events.select(
        "event_id", "ts", F.lit("inference").alias("metric_type"), F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), usage.alias("usage"),
        none.alias("prompt_tokens_per_second"), none.alias("output_tokens_per_second"), none.alias("total_tokens_per_second"), F.when(k % 2 == 0, F.col("value")).alias("gpu_memory_mb"), F.col("value").alias("host_memory_mb"),
        F.when(F.col("event_type") == "click", k / 100.0).alias("kv_cache_usage_pct"), F.when(F.col("event_type") == "view", k).alias("num_requests_running"), F.when(F.col("event_type") == "view", k % 5).alias("num_requests_waiting"), F.lit(0).alias("retry_count"), none.alias("duration_ms"), k.alias("k"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("task_name"), F.col("c_name").alias("model_name"), F.lit("done").alias("status"), F.col("c_acctbal").alias("total_wall_clock_seconds"), F.array(F.concat(F.lit(" Seg "), "c_mktsegment"), F.lit("All!"), F.lit("all")).alias("hardware_tags"))


@query(f"WITH {CALLS} SELECT event_id, round({RATE}, 4) AS output_rate, round(2 * {RATE}, 4) AS prompt_rate FROM c")
def mx3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.generation_rates(calls(spark, sf_dir)).select("event_id", "output_rate", "prompt_rate"))


@query(f"WITH {CALLS}, n AS (SELECT run_id, model, count(*) AS n, min(event_id) AS first FROM c GROUP BY 1, 2) SELECT run_id, arg_max(model, n * 1000000000 - first) AS run_model FROM n GROUP BY run_id")
def mx4_run_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlogs.most_frequent(calls(spark, sf_dir), "run_id", "model", "event_id", "run_model")


@query(
    f"WITH {CALLS}, r AS (SELECT c_custkey AS run_id, c_name AS name FROM customer), g AS (SELECT run_id, count(*) AS calls, count(*) FILTER (WHERE ok) AS good, sum(k) AS k, sum(latency_ms) AS ms, avg({RATE}) AS mean_rate, median({RATE}) AS median_rate, max(latency_ms) AS peak, count({RATE}) AS rated, max({RATE}) AS top_rate FROM c GROUP BY run_id) "
    "SELECT r.run_id, coalesce(calls, 0)::BIGINT AS calls, coalesce(good, 0)::BIGINT AS successful_calls, coalesce(k, 0)::BIGINT AS completion_tokens, round(coalesce(ms, 0.0), 3) AS latency_ms, round(coalesce(good / calls, 0.0), 4) AS success_rate, round(coalesce(k / nullif(ms / 1000, 0), 0), 3) AS output_throughput, round(coalesce(mean_rate, 0.0), 3) AS mean_output_rate, coalesce(calls, 0)::BIGINT - coalesce(good, 0)::BIGINT AS failed_calls, 3 * coalesce(k, 0)::BIGINT AS total_tokens, coalesce(rated, 0)::BIGINT AS generation_count, round(3 * top_rate, 3) AS peak_total_rate, round(median_rate, 3) AS median_output_rate, round(peak, 3) AS peak_host_memory_mb, coalesce((SELECT arg_min(model, n) FROM (SELECT model, -count(*) * 1000000000 + min(event_id) AS n FROM c WHERE c.run_id = r.run_id GROUP BY model)), r.name) AS model FROM r LEFT JOIN g ON r.run_id = g.run_id"
)
def mx5_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runlogs.run_summary(calls(spark, sf_dir), runs(spark, sf_dir), "event_id")
    return out.select("run_id", "model", "calls", "successful_calls", F.col("completion_tokens").cast("long").alias("completion_tokens"), F.round("latency_ms", 3).alias("latency_ms"), F.round("success_rate", 4).alias("success_rate"), *[F.round(c, 3).alias(c) for c in ("output_throughput", "mean_output_rate", "median_output_rate", "peak_host_memory_mb", "peak_total_rate")], "failed_calls", F.col("total_tokens").cast("long").alias("total_tokens"), "generation_count")


@query(f"WITH {CALLS} SELECT model, count(DISTINCT run_id)::BIGINT AS runs, count(*)::BIGINT AS calls, round(avg(latency_ms), 3) AS mean_latency_ms, round(median(latency_ms), 3) AS median_latency_ms, round(sum(k) / (sum(latency_ms) / 1000), 3) AS output_throughput, round(avg({RATE}), 3) AS mean_output_rate FROM c GROUP BY model")
def mx6_latency_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.latency_by_model(calls(spark, sf_dir)).select("model", "runs", "calls", "mean_latency_ms", "median_latency_ms", "output_throughput", "mean_output_rate"), 3)


@query(f"WITH {CALLS} SELECT model AS phase_name, count(*)::BIGINT AS occurrences, count(DISTINCT run_id)::BIGINT AS runs, count(DISTINCT run_id) FILTER (WHERE k % 10 = 0 AND k > 0)::BIGINT AS runs_with_retries, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 4) AS failure_rate FROM c GROUP BY model")
def mx7_retry_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = calls(spark, sf_dir).withColumnRenamed("model", "phase_name").withColumn("retry_count", F.when(F.col("k") % 10 == 0, F.col("k")).otherwise(0))
    return rounded(runlogs.retry_rates_by_phase(phases).drop("retries"))


@query(f"WITH {CALLS} SELECT model, round(avg(latency_ms) FILTER (WHERE k % 2 = 0), 3) AS mean_gpu, round(max(latency_ms) FILTER (WHERE k % 2 = 0), 3) AS peak_gpu, round(avg(latency_ms), 3) AS mean_host, round(max(latency_ms), 3) AS peak_host FROM c GROUP BY model")
def mx8_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.memory_by_model(calls(spark, sf_dir)).select("model", "mean_gpu", "peak_gpu", "mean_host", "peak_host"), 3)


@query(f"WITH {CALLS} SELECT model, round(avg(k / 100.0), 4) AS mean_kv_cache, round(max(k / 100.0), 4) AS peak_kv_cache, count(k)::BIGINT AS samples_kv_cache FROM c WHERE model = 'click' GROUP BY model")
def mx9_kv_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.kv_cache_by_model(calls(spark, sf_dir)).select("model", "mean_kv_cache", "peak_kv_cache", "samples_kv_cache"))


@query(f"WITH {CALLS} SELECT model, round(avg(k), 4) AS mean_running, max(k)::BIGINT AS peak_running, round(avg(k % 5), 4) AS mean_waiting, max(k % 5)::BIGINT AS peak_waiting, count(DISTINCT run_id)::BIGINT AS runs_running FROM c WHERE model = 'view' GROUP BY model")
def mx10_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.queue_depth_by_model(calls(spark, sf_dir)).select("model", "mean_running", "peak_running", "mean_waiting", "peak_waiting", "runs_running"))


@query(f"WITH {CALLS}, t AS (SELECT c.*, unnest(['seg-' || lower(c_mktsegment), 'all']) AS tag FROM c JOIN customer ON run_id = c_custkey) SELECT tag, count(DISTINCT run_id)::BIGINT AS run_count, count(*)::BIGINT AS calls, count(3 * ({RATE}))::BIGINT AS generation_count, round(coalesce(avg(latency_ms), 0), 3) AS mean_latency_ms, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS success_rate, round(median(latency_ms), 3) AS median_latency_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms, round(max({RATE}), 3) AS peak_output_rate FROM t GROUP BY tag")
def mx11_benchmarks_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = calls(spark, sf_dir).join(runs(spark, sf_dir).select("run_id", "hardware_tags"), "run_id")
    out = runlogs.benchmarks_by(tagged, [], F.col("hardware_tags"))
    return out.select("tag", "run_count", "calls", "generation_count", F.round("success_rate", 4).alias("success_rate"), *[F.round(c, 3).alias(c) for c in ("mean_latency_ms", "median_latency_ms", "p95_latency_ms", "peak_output_rate")])


@query("SELECT c_custkey AS run_id, ['seg-' || lower(c_mktsegment), 'all'] AS tags FROM customer")
def mx13_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", runlogs.normalise_tags(F.col("hardware_tags")).alias("tags"))


@query("SELECT o_custkey AS run_id, count(*)::BIGINT AS generations, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def mx1_selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"started_at": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "status": F.col("o_orderstatus")})
    chosen = runlogs.select_runs(orders, statuses=["F", "O"], since="1998-01-01", until="1999-01-01")
    return rounded(chosen.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("generations"), F.sum("o_totalprice").alias("total")), 2)


@query(f"WITH {CALLS} SELECT (SELECT count(*) FROM (SELECT DISTINCT run_id FROM c WHERE run_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)))::BIGINT AS runs_without_document")
def mx2_unmatched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlogs.unmatched_runs(calls(spark, sf_dir), runs(spark, sf_dir).where("run_id % 2 = 0"))


@query(f"WITH {CALLS} SELECT run_id AS episode_id, round(sum(latency_ms), 3) AS inference_ms, count(*)::BIGINT AS calls, coalesce(sum(2 * k), 0)::BIGINT AS prompt_tokens, coalesce(sum(k), 0)::BIGINT AS completion_tokens, max(2 * k)::BIGINT AS peak_context, round(avg(2 * k), 3) AS mean_context, round(median(2 * k), 3) AS median_context, round(sum(k) / nullif(sum(latency_ms) / 1000, 0), 3) AS output_rate FROM c GROUP BY run_id")
def mx16_episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runlogs.episode_metrics(calls(spark, sf_dir).withColumnRenamed("run_id", "episode_id"))
    return rounded(out.select("episode_id", "inference_ms", "calls", "prompt_tokens", "completion_tokens", "peak_context", "mean_context", "median_context", "output_rate"), 3)


@query("SELECT event_id, round(CASE WHEN value >= b THEN value - b WHEN b IS NOT NULL THEN value END, 4) AS delta FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)")
def mx21_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.counter_deltas(table(spark, sf_dir, "events"), ["user_id"]).select("event_id", "delta"))


@query("SELECT event_id, 'latency' AS name, NULL AS gauge, value FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'vllm:kv_cache_usage_perc' ELSE 'sglang:token_usage' END, 'kv_cache_usage', value * 100 FROM events UNION ALL SELECT event_id, 'sglang:num_queue_reqs', 'num_requests_waiting', 3 FROM events UNION ALL SELECT event_id, 'other_perc', NULL, 0.5 FROM events")
def mx20_parse_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('# HELP x\nlatency{model="'), "event_type", F.lit('",le="+Inf"} '), F.col("value").cast("string"), F.lit("\n\nbad line here too\nnovalue NaN\nother_perc 0.5\nsglang:num_queue_reqs 3\n"), F.when(F.col("event_id") % 2 == 0, "vllm:kv_cache_usage_perc ").otherwise("sglang:token_usage "), F.col("value").cast("string"), F.lit(" 1700000"))
    scrapes = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return runlogs.parse_scrapes(scrapes).select("event_id", "name", "gauge", "value")


@query("SELECT user_id AS uri, max(event_id)::BIGINT AS pos, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def st1_latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"))
    return logs.latest_records(log)


@query(f"WITH {CALLS} SELECT run_id, count(*)::BIGINT AS calls, count(*) FILTER (WHERE NOT ok)::BIGINT AS failures, sum(k)::BIGINT AS tokens, round(sum(latency_ms), 3) AS latency_ms FROM c GROUP BY run_id")
def st2_running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream of files, aggregated by micro-batches until all are read."""
    folder = shared_path(spark, f"stream-{uuid.uuid4().hex}")
    source = f"{folder}/in"
    rated = runlogs.generation_rates(calls(spark, sf_dir)).select("run_id", "success", F.col("k").alias("tokens"), "latency_ms", "output_rate")
    rated.write.parquet(source)
    stream = spark.readStream.schema(rated.schema).option("maxFilesPerTrigger", 8).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    run = logs.running_metrics(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    last = out.agg(F.max("batch")).first()[0]
    return rounded(out.where(F.col("batch") == last).select("run_id", "calls", "failures", "tokens", "latency_ms"), 3)


@query(f"WITH {CALLS} SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, model AS run_id, count(*)::BIGINT AS calls, round(sum(latency_ms), 3) AS latency_ms, round(max(latency_ms), 3) AS peak_ms FROM c GROUP BY 1, 2")
def st2_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).select("ts", F.col("model").alias("run_id"), "latency_ms")
    return rounded(logs.windowed_metrics(rows, "ts", "1 hour", "10 minutes"), 3)


@query("SELECT event_id AS pos, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 40 OFFSET 10")
def st3_query_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumnRenamed("event_id", "pos")
    return logs.query_actions(log, F.col("event_type") == "error", 40, 10).select("pos", "user_id", "event_type")


@query("WITH a AS (SELECT event_id, value FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, value FROM events WHERE event_id % 5 <> 0) SELECT coalesce(a.event_id, b.event_id) AS correlation_id, CASE WHEN b.event_id IS NULL THEN 'no_result' WHEN a.event_id IS NULL THEN 'no_call' ELSE 'paired' END AS state FROM a FULL JOIN b ON a.event_id = b.event_id")
def st4_pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("correlation_id"), F.col("event_id").alias("pos"), F.col("value").alias("payload"))
    return logs.pair_events(log.where("pos % 3 <> 0"), log.where("pos % 5 <> 0")).select("correlation_id", "state")


@query("WITH r AS (SELECT o_orderkey AS uri, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderstatus AS kind, o_orderkey % 4 = 0 AS pinned FROM orders), o AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY created_at, uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM r WHERE kind IN ('F', 'P') AND NOT pinned) SELECT uri, size_bytes FROM o WHERE freed < (SELECT sum(size_bytes) - CAST(sum(size_bytes) * 8 // 10 AS BIGINT) FROM r)")
def st5_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(key.alias("uri"), key.alias("pos"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").alias("size_bytes"), F.when(key % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("pinned_by"))
    total = records.agg(F.sum("size_bytes")).first()[0] or 0
    return logs.evict_candidates(records, ["F", "P"], "2030-01-01", 0, total * 8 // 10).select("uri", "size_bytes")


@query("SELECT o_orderkey AS uri, CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' THEN CASE WHEN o_orderkey % 4 >= 2 THEN 'failed' ELSE 'queued' END WHEN o_orderstatus = 'O' THEN 'claimed' ELSE 'done' END AS status, (o_orderkey % 4 + CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' AND o_orderkey % 4 < 2 THEN 1 ELSE 0 END)::BIGINT AS retry_count, CASE WHEN NOT (o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' AND o_orderkey % 4 < 2) THEN 'c' || o_custkey END AS claim_id FROM orders")
def st6_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uri"), F.when(F.col("o_orderstatus") == "O", "claimed").otherwise("done").alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("claim_id"), F.lit(2).alias("max_retries"), F.col("o_orderdate").alias("lease_expires_at"))
    return logs.expire_leases(records, F.lit("1998-01-01").cast("timestamp")).select("uri", "status", "retry_count", "claim_id")


@query("WITH m AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS bad, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id, island, count(*) FILTER (WHERE bad) AS n FROM m GROUP BY 1, 2) SELECT user_id, max(n)::BIGINT AS streak, max(n) >= 3 AS tripped FROM r GROUP BY user_id")
def st7_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.failure_streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"), 3)
