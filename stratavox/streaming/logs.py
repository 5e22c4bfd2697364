"""Registry, action and event logs: latest state, totals, pairing, eviction, leases and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_records(log: DataFrame, key: str = "uri", position: str = "pos") -> DataFrame:
    """The last appended row of each key: one aggregate, no sort of the log."""
    columns = [F.col(c) for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("r")).select(key, "r.*")


def merge_latest(batch: DataFrame, state: DataFrame | None, key: str = "uri", position: str = "pos") -> DataFrame:
    """State after a micro-batch; for ``foreachBatch``, which writes it as the next version."""
    rows = batch if state is None else state.unionByName(batch)
    return latest_records(rows, key, position)


def running_metrics(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """Calls, failures, tokens and rate means of each run; in a stream, an update-mode aggregate."""
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("latency_ms"), F.avg("output_rate").alias("mean_output_rate")
    )


def windowed_metrics(calls: DataFrame, ts: str, width: str, late: str, key: str = "run_id") -> DataFrame:
    """The same by tumbling windows, with a watermark that bounds the state of a stream."""
    rows = calls.withWatermark(ts, late) if calls.isStreaming else calls
    out = rows.groupBy(F.window(ts, width), key).agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("latency_ms"), F.max("latency_ms").alias("peak_ms"))
    return out.select(F.col("window.start").alias("window_start"), key, "calls", "latency_ms", "peak_ms")


def query_actions(log: DataFrame, condition: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Actions that meet the condition, in append order."""
    rows = (log if condition is None else log.where(condition)).orderBy("pos").offset(offset)
    return rows if limit is None else rows.limit(limit)


def pair_events(calls: DataFrame, results: DataFrame, ts: str | None = None, within: str = "10 minutes") -> DataFrame:
    """Calls with their results by ``correlation_id``; ``state`` names what has no partner.

    With ``ts`` both sides are watermarked streams and a partner must come within a time.
    """
    a = calls.select("correlation_id", F.col("pos").alias("call_pos"), F.col("payload").alias("call"), *([F.col(ts).alias("call_ts")] if ts else []))
    b = results.select(F.col("correlation_id").alias("result_id"), F.col("pos").alias("result_pos"), F.col("payload").alias("result"), *([F.col(ts).alias("result_ts")] if ts else []))
    same = F.col("correlation_id") == F.col("result_id")
    if ts:
        a, b = a.withWatermark("call_ts", within), b.withWatermark("result_ts", within)
        same = same & (F.col("result_ts") >= F.col("call_ts")) & (F.col("result_ts") <= F.col("call_ts") + F.expr(f"interval {within}"))
    state = F.when(F.col("result_id").isNull(), "no_result").when(F.col("correlation_id").isNull(), "no_call").otherwise("paired")
    out = a.join(b, same, "left_outer" if ts else "full_outer")
    return out.select(F.coalesce("correlation_id", "result_id").alias("correlation_id"), "call_pos", "result_pos", "call", "result", state.alias("state"))


def evict_candidates(registry: DataFrame, kinds: list[str], now: str, ttl_seconds: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Records to evict: unpinned, of an evictable kind, older than the time to live; oldest first until the size is met.

    Without a size limit all such records go. The running size is summed in two steps, by
    day and within the day, so that no task gets the whole log.
    """
    latest = latest_records(registry)
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    total = latest.agg(F.sum(size)).first()[0] or 0
    old = latest.where(F.col("kind").isin(kinds) & (F.coalesce(F.size("pinned_by"), F.lit(0)) <= 0))
    if ttl_seconds is not None:
        old = old.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at") > ttl_seconds)
    if max_bytes is None:
        return old.select("uri", "kind", "created_at", size.alias("size_bytes"))
    over = total - max_bytes
    dated = old.withColumn("day", F.to_date("created_at"))
    days = dated.groupBy("day").agg(F.sum(size).alias("day_bytes"))
    days = days.withColumn("before", F.coalesce(F.sum("day_bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("day").orderBy("created_at", "uri").rowsBetween(Window.unboundedPreceding, -1)
    run = dated.join(F.broadcast(days), "day").withColumn("freed_before", F.col("before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    return run.where(F.col("freed_before") < over).select("uri", "kind", "created_at", size.alias("size_bytes"))


def expire_leases(records: DataFrame, now: Column) -> DataFrame:
    """Claims whose lease is over go back to the queue with one more retry and without a claim; those without retries left fail as they are."""
    over = (F.col("status") == "claimed") & (F.col("lease_expires_at") < now)
    over = F.coalesce(over, F.lit(False))
    last = F.col("retry_count") >= F.col("max_retries")
    again = over & ~last
    return records.withColumns(
        {
            "status": F.when(over & last, "failed").when(again, "queued").otherwise(F.col("status")),
            "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            **{c: F.when(~again, F.col(c)) for c in ("claim_id", "lease_expires_at") if c in records.columns},
        }
    )


def failure_streaks(episodes: DataFrame, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """Longest run of failures of each key, and whether it reaches the limit."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = episodes.withColumn("bad", F.coalesce(failed, F.lit(False))).withColumn("island", F.count_if(~F.col("bad")).over(w))
    runs = marked.groupBy(key, "island").agg(F.count_if("bad").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("streak")).withColumn("tripped", F.col("streak") >= limit)


def cached_fields(specs: DataFrame, cache: DataFrame, registry: DataFrame) -> DataFrame:
    """For each spec (``spec_id, spec``), the last cache entry of the same content whose uri still exists."""
    alive = cache.join(registry.select("uri").distinct(), "uri", "left_semi")
    newest = alive.groupBy("spec_hash").agg(F.max_by("uri", "pos").alias("uri"))
    hashed = specs.select("spec_id", F.sha2(F.to_json("spec"), 256).alias("spec_hash"))
    return hashed.join(newest, "spec_hash", "left").select("spec_id", "spec_hash", "uri", F.col("uri").isNotNull().alias("hit"))
