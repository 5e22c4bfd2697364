"""Comparison tables from the logs of model calls, phases, episodes and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the rates and of the metrics of a generation.
RATES = ("prompt_rate", "output_rate", "total_rate")


def normalise_tags(tags: Column) -> Column:
    """Lower case, other characters than letters and digits as one dash, no dashes at the ends, no empty or repeated tags."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))


def select_runs(runs: DataFrame, run_ids: list[str] | None = None, tasks: list[str] | None = None, models: list[str] | None = None, statuses: list[str] | None = None, hardware: list[str] | None = None, load: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Runs that pass every filter given; a filter passes any of its values.

    A task matches the class or the name. ``since`` is inclusive, ``until`` exclusive, both
    on the UTC date of ``started_at``; a start without the UTC mark is an error.
    """
    for values, columns in ((run_ids, ["run_id"]), (tasks, ["task_class", "task_name"]), (models, ["model_name"]), (statuses, ["status"])):
        if values:
            hit = F.lit(False)
            for c in columns:
                hit = hit | F.coalesce(F.col(c).isin(values), F.lit(False))
            runs = runs.where(hit)
    for values, column in ((hardware, "hardware_tags"), (load, "load_tags")):
        if values:
            runs = runs.where(F.arrays_overlap(normalise_tags(F.col(column)), normalise_tags(F.array(*map(F.lit, values)))))
    if since or until:
        utc = F.when(F.col("started_at").rlike(r"(Z|\+00:?00)$"), F.to_date(F.left("started_at", F.lit(10)))).otherwise(F.raise_error(F.concat(F.lit("run does not start in UTC: "), F.coalesce("started_at", F.lit("null")))).cast("date"))
        if since:
            runs = runs.where(utc >= F.lit(since).cast("date"))
        if until:
            runs = runs.where(utc < F.lit(until).cast("date"))
    return runs


def join_metrics(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Metrics of the selected runs."""
    return metrics.join(runs.select("run_id").distinct(), "run_id", "left_semi")


def unmatched_runs(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: ``runs_without_document``, runs in the metrics that have no run document."""
    return metrics.where("run_id is not null").select("run_id").distinct().join(runs.select("run_id"), "run_id", "left_anti").agg(F.count("*").alias("runs_without_document"))


def generation_rates(metrics: DataFrame) -> DataFrame:
    """Adds the three token rates: as logged, else tokens over seconds where the latency is positive."""
    usage = F.col("usage")
    some = usage["prompt_tokens"].isNotNull() | usage["completion_tokens"].isNotNull()
    total = F.coalesce(usage["total_tokens"], F.when(some, F.coalesce(usage["prompt_tokens"], F.lit(0)) + F.coalesce(usage["completion_tokens"], F.lit(0))))
    seconds = F.when(F.col("latency_ms") > 0, F.col("latency_ms") / 1000)
    tokens = (usage["prompt_tokens"], usage["completion_tokens"], total)
    logged = ("prompt_tokens_per_second", "output_tokens_per_second", "total_tokens_per_second")
    return metrics.withColumns({name: F.coalesce(F.col(old), n / seconds) for name, old, n in zip(RATES, logged, tokens, strict=True)})


def most_frequent(rows: DataFrame, key: str, value: str, position: str, name: str) -> DataFrame:
    """``key, name``: each key's most frequent non-empty value, the first seen on ties, else ``unknown``."""
    counted = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = counted.groupBy(key).agg(F.min_by("v", F.struct(-F.col("n"), "first")).alias(name))
    return rows.select(key).distinct().join(best, key, "left").withColumn(name, F.coalesce(name, F.lit("unknown")))


#: Fields of a run document that a summary keeps.
RUN_FIELDS = ("status", "started_at", "ended_at", "harness_type", "harness_profile", "harness_class", "task_class", "task_name", "config_path", "model_name", "commit_id", "git_dirty", "total_wall_clock_seconds")


def run_summary(metrics: DataFrame, runs: DataFrame, position: str = "inference_id") -> DataFrame:
    """A row for each run, runs without metrics included: what its document says (null where it lacks a field), calls, success, phases, retries, tokens, latency, rates and memory.

    Throughput is the ratio of totals; mean and median rates are of single calls, and a mean
    rate or a throughput without samples is 0. A call's total tokens are those logged, else prompt and completion tokens.
    ``generation_count`` is the number of calls with a total rate. The model is the calls' most frequent one (their own,
    else that of their usage), else the document's; of equally frequent ones the first by ``position``.
    """
    rated = generation_rates(metrics)
    call = F.col("metric_type") == "inference"
    phase = F.col("metric_type") == "phase"
    of = lambda c: F.when(call, c)
    usage = F.col("usage")
    aggregates = [
        F.count_if(call).alias("calls"),
        F.count_if(call & F.col("success")).alias("successful_calls"),
        F.count_if(call & ~F.coalesce("success", F.lit(False))).alias("failed_calls"),
        F.count_if(phase).alias("phases"),
        F.coalesce(F.sum(F.when(phase, F.col("duration_ms"))), F.lit(0.0)).alias("phase_duration_ms"),
        F.coalesce(F.sum(F.when(phase, F.col("retry_count"))), F.lit(0)).alias("retries"),
        F.coalesce(F.sum(of(F.coalesce(usage["total_tokens"], F.coalesce(usage["prompt_tokens"], F.lit(0)) + F.coalesce(usage["completion_tokens"], F.lit(0))))), F.lit(0)).alias("total_tokens"),
        F.count(of(F.col("total_rate"))).alias("generation_count"),
        F.max(of(F.col("total_rate"))).alias("peak_total_rate"),
        F.coalesce(F.sum(of(usage["prompt_tokens"])), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(of(usage["completion_tokens"])), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(of(F.coalesce(F.col("latency_ms"), F.lit(0.0)))), F.lit(0.0)).alias("latency_ms"),
        *[f(of(F.col(r))).alias(f"{n}_{r}") for r in RATES for n, f in (("mean", F.avg), ("median", F.median))],
        *[f(of(F.col(c))).alias(f"{n}_{c}") for c in ("gpu_memory_mb", "host_memory_mb") for n, f in (("mean", F.avg), ("peak", F.max))],
    ]
    by_run = rated.groupBy("run_id").agg(*aggregates)
    tags = [normalise_tags(F.col(c)).alias(c) for c in ("hardware_tags", "load_tags") if c in runs.columns]
    out = runs.select("run_id", *[F.col(c) if c in runs.columns else F.lit(None).alias(c) for c in RUN_FIELDS], *tags).join(by_run, "run_id", "left")
    seen = rated.where(call)
    if "model" in dict(seen.select("usage.*").dtypes):
        seen = seen.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), "usage.model"))
    for name in [c for c in ("model", "backend") if c in rated.columns]:
        out = out.join(most_frequent(seen, "run_id", name, position, name), "run_id", "left").withColumn(name, F.coalesce(name, F.lit("unknown")))
    if "model" in rated.columns:
        out = out.withColumn("model", F.when((F.col("model") == "unknown") & (F.col("model_name") != ""), F.col("model_name")).otherwise(F.col("model")))
    counts = ["calls", "successful_calls", "failed_calls", "phases", "phase_duration_ms", "retries", "total_tokens", "generation_count", "prompt_tokens", "completion_tokens", "latency_ms", *[f"mean_{r}" for r in RATES]]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    seconds = F.nullif(F.col("latency_ms") / 1000, F.lit(0.0))
    return out.withColumns(
        {
            "success_rate": F.coalesce(F.try_divide("successful_calls", "calls"), F.lit(0.0)),
            "mean_latency_ms": F.coalesce(F.try_divide("latency_ms", "calls"), F.lit(0.0)),
            "output_throughput": F.coalesce(F.col("completion_tokens") / seconds, F.lit(0.0)),
            "total_throughput": F.coalesce((F.col("prompt_tokens") + F.col("completion_tokens")) / seconds, F.lit(0.0)),
        }
    )


def latency_by_model(calls: DataFrame) -> DataFrame:
    """``model``: runs, calls, tokens and throughput by totals, and statistics of single calls."""
    rated = generation_rates(calls)
    usage = F.col("usage")
    grouped = rated.groupBy("model").agg(
        F.count_distinct("run_id").alias("runs"), F.count("*").alias("calls"), F.sum(usage["completion_tokens"]).alias("completion_tokens"), F.sum("latency_ms").alias("latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.median("latency_ms").alias("median_latency_ms"), F.avg("output_rate").alias("mean_output_rate"), F.median("output_rate").alias("median_output_rate"),
    )
    return grouped.withColumn("output_throughput", F.try_divide("completion_tokens", F.col("latency_ms") / 1000))


def retry_rates_by_phase(phases: DataFrame) -> DataFrame:
    """``phase_name``: occurrences, runs, runs with retries, retries and failure rate."""
    return phases.groupBy("phase_name").agg(
        F.count("*").alias("occurrences"), F.count_distinct("run_id").alias("runs"), F.count_distinct(F.when(F.col("retry_count") > 0, F.col("run_id"))).alias("runs_with_retries"),
        F.sum("retry_count").alias("retries"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("failure_rate"),
    )


def gauge_by_model(calls: DataFrame, gauges: dict[str, str], all_models: bool = False) -> DataFrame:
    """``model`` with mean, peak and number of samples of each gauge; models without a sample only on request."""
    aggregates = [f(c).alias(f"{n}_{name}") for name, c in gauges.items() for n, f in (("mean", F.avg), ("peak", F.max), ("samples", F.count))]
    aggregates += [F.count_distinct(F.when(F.col(c).isNotNull(), F.col("run_id"))).alias(f"runs_{name}") for name, c in gauges.items()]
    out = calls.groupBy("model").agg(*aggregates)
    if all_models:
        return out
    some = F.lit(False)
    for name in gauges:
        some = some | (F.col(f"samples_{name}") > 0)
    return out.where(some)


def memory_by_model(calls: DataFrame) -> DataFrame:
    """Mean and peak memory of each model, null without samples."""
    return gauge_by_model(calls, {"gpu": "gpu_memory_mb", "host": "host_memory_mb"}, all_models=True)


def kv_cache_by_model(calls: DataFrame) -> DataFrame:
    return gauge_by_model(calls, {"kv_cache": "kv_cache_usage_pct"})


def queue_depth_by_model(calls: DataFrame) -> DataFrame:
    return gauge_by_model(calls, {"running": "num_requests_running", "waiting": "num_requests_waiting"})


def benchmarks_by(calls: DataFrame, keys: list[Column], tags: Column | None = None) -> DataFrame:
    """Counts, success rate, latency and rates by keys; with ``tags``, a call counts once for each of its tags.

    ``generation_count`` is the number of calls with a total rate. Means without samples are 0, medians, percentiles and peaks
    null. Percentiles are exact and interpolate between neighbours.
    """
    rated = generation_rates(calls)
    if tags is not None:
        rated = rated.withColumn("tag", F.explode(normalise_tags(tags)))
        keys = [*keys, F.col("tag")]
    return rated.groupBy(*keys).agg(
        F.count_distinct(F.nullif(F.col("run_id").cast("string"), F.lit(""))).alias("run_count"), F.count("*").alias("calls"), F.count("total_rate").alias("generation_count"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"), F.median("latency_ms").alias("median_latency_ms"), F.percentile("latency_ms", 0.95).alias("p95_latency_ms"),
        *[f(r).alias(f"{n}_{r}") for r in RATES for n, f in (("mean", lambda c: F.coalesce(F.avg(c), F.lit(0.0))), ("median", F.median), ("peak", F.max))],
    )


def generation_comparison(runs: DataFrame) -> DataFrame:
    """A row for each run and generation with the generation's metrics as columns."""
    return runs.select("run_id", F.posexplode("generations").alias("generation", "g")).select("run_id", "generation", "g.metrics.*")


def run_pivot(generations: DataFrame, metrics: list[str], totals: dict[str, str], most: int | None = None) -> DataFrame:
    """Metric rows by generation, with a total (``sum``, ``mean``, ``max`` or none) and the coverage.

    ``values`` is a map by generation; with ``most`` the generations are columns ``g0 ..``
    instead, and one beyond them is an error. A run's generations are few.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = generations.select("run_id", "generation", F.inline(values))
    if most is None:
        cells = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("generation", "value")))).alias("values")]
    else:
        known = F.when(F.col("generation") < most, F.col("value")).otherwise(F.raise_error(F.lit(f"more than {most} generations")).cast("double"))
        rows = rows.withColumn("value", known)
        cells = [F.max(F.when(F.col("generation") == k, F.col("value"))).alias(f"g{k}") for k in range(most)]
    kind = F.create_map(*[F.lit(x) for m, t in totals.items() for x in (m, t)]) if totals else F.create_map().cast("map<string,string>")
    grouped = rows.groupBy("run_id", "metric").agg(*cells, F.sum("value").alias("s"), F.avg("value").alias("a"), F.max("value").alias("m"), F.count("value").alias("k"), F.count("*").alias("n"))
    how = F.try_element_at(kind, F.col("metric"))
    total = F.when(how == "sum", F.col("s")).when(how == "mean", F.col("a")).when(how == "max", F.col("m"))
    return grouped.select("run_id", "metric", *(["values"] if most is None else [f"g{k}" for k in range(most)]), total.alias("total"), F.concat(F.col("k"), F.lit(" of "), F.col("n")).alias("coverage"))


def episode_metrics(calls: DataFrame) -> DataFrame:
    """``episode_id``: time, calls, tokens, output rate, and peak, mean and median context."""
    usage = F.col("usage")
    grouped = calls.groupBy("episode_id").agg(
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("inference_ms"), F.count("*").alias("calls"), F.coalesce(F.sum(usage["prompt_tokens"]), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(usage["completion_tokens"]), F.lit(0)).alias("completion_tokens"),
        F.max(usage["prompt_tokens"]).alias("peak_context"), F.avg(usage["prompt_tokens"]).alias("mean_context"), F.median(usage["prompt_tokens"]).alias("median_context"),
    )
    return grouped.withColumn("output_rate", F.try_divide("completion_tokens", F.nullif(F.col("inference_ms") / 1000, F.lit(0.0))))


#: What a generation takes from its episodes, by how; null where no episode has it.
ROLLUP = {
    "average_output_tokens_per_second": ("average_output_tokens_per_second", "mean"), "average_inference_duty_cycle": ("inference_duty_cycle", "mean"), "peak_gpu_utilization_pct": ("peak_gpu_utilization_pct", "max"),
    "peak_cpu_utilization_pct": ("peak_cpu_utilization_pct", "max"), "average_gpu_utilization_pct": ("avg_gpu_utilization_pct", "mean"), "average_cpu_utilization_pct": ("avg_cpu_utilization_pct", "mean"),
    "peak_kv_cache_usage_pct": ("peak_kv_cache_usage_pct", "max"), "avg_kv_cache_usage_pct": ("avg_kv_cache_usage_pct", "mean"), "peak_num_requests_running": ("peak_num_requests_running", "max"),
    "peak_num_requests_waiting": ("peak_num_requests_waiting", "max"), "total_container_overhead_seconds": ("container_overhead_seconds", "sum"), "total_inference_seconds": ("total_inference_ms", "seconds"),
    "total_episode_execution_seconds": ("episode_execution_seconds", "sum"), "peak_context_tokens": ("peak_context_tokens", "max"), "avg_context_tokens": ("avg_context_tokens", "mean"), "median_context_tokens": ("median_context_tokens", "median"),
}


def generation_rollup(generations: DataFrame, episodes: DataFrame) -> DataFrame:
    """A row for each of ``generations (generation_id, started_at, completed_at)`` from its episodes.

    Wall clock and rates are of the generation's own start and end, null without both; rates are null where no time went by.
    Episodes have ``success, score, duration_seconds, training_rows`` (a number), ``total_input_tokens, total_output_tokens`` and
    columns of ``ROLLUP``; absent columns and inputs stay null. Tokens a success divide input and output tokens of all episodes.
    """
    how = {"mean": F.avg, "max": F.max, "sum": F.sum, "median": F.median, "seconds": lambda c: F.sum(F.col(c) / 1000)}
    has = lambda c: c in episodes.columns
    tokens = [F.sum(c).alias(c) if has(c) else F.lit(None).cast("long").alias(c) for c in ("total_input_tokens", "total_output_tokens")]
    grouped = episodes.groupBy("generation_id").agg(
        F.count("*").alias("total_episodes_run"), F.count_if("success").alias("total_successful"), F.sum(F.coalesce("training_rows", F.lit(0))).alias("training_row_count"), F.sum(F.when(F.col("success"), F.coalesce("score", F.lit(0.0)))).alias("total_score"),
        F.sum("duration_seconds").alias("total_agent_seconds"), *[how[kind](source).alias(name) for name, (source, kind) in ROLLUP.items() if has(source)], *tokens,
    )
    out = generations.select("generation_id", "started_at", "completed_at").join(grouped, "generation_id", "left").fillna(0, ["total_episodes_run", "total_successful", "training_row_count", "total_score", "total_agent_seconds"])
    out = out.withColumns({name: F.lit(None).cast("double") for name, (source, _) in ROLLUP.items() if not has(source)})
    seconds = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c).cast("string"))) / 1e6
    out = out.withColumn("generation_wall_clock_seconds", seconds("completed_at") - seconds("started_at"))
    spent = F.when(F.col("generation_wall_clock_seconds") > 0, F.col("generation_wall_clock_seconds"))
    some = F.col("total_input_tokens").isNotNull() | F.col("total_output_tokens").isNotNull()
    total = F.when(some, F.coalesce("total_input_tokens", F.lit(0)) + F.coalesce("total_output_tokens", F.lit(0)))
    rate = lambda c, unit: F.col(c) * unit / spent
    return out.withColumns(
        {
            "success_rate": F.coalesce(F.try_divide("total_successful", "total_episodes_run"), F.lit(0.0)), "episodes_per_hour": rate("total_episodes_run", 3600), "training_rows_per_hour": rate("training_row_count", 3600),
            "episodes_per_minute": rate("total_episodes_run", 60), "training_rows_per_minute": rate("training_row_count", 60), "total_tokens": total, "tokens_per_successful_episode": F.try_divide(total, "total_successful"),
            **{c: F.when(some, F.coalesce(c, F.lit(0))) for c in ("total_input_tokens", "total_output_tokens")},
        }
    )


def space_freed(measurements: DataFrame) -> DataFrame:
    """``episode_id, freed_kb``: mean before less mean after of each file system, added up."""
    by_fs = measurements.groupBy("episode_id", "filesystem").agg((F.avg("before_kb") - F.avg("after_kb")).alias("freed"))
    return by_fs.groupBy("episode_id").agg(F.sum("freed").alias("freed_kb"))


def utilisation_summary(samples: DataFrame, gauges: list[str]) -> DataFrame:
    """``episode_id`` with mean, peak and number of samples of each gauge."""
    return samples.groupBy("episode_id").agg(*[f(g).alias(f"{n}_{g}") for g in gauges for n, f in (("mean", F.avg), ("peak", F.max), ("samples", F.count))])


#: Names of the gauges and counters of each backend.
GAUGES = {
    "vllm": {"vllm:kv_cache_usage_perc": "kv_cache_usage", "vllm:num_requests_running": "num_requests_running", "vllm:num_requests_waiting": "num_requests_waiting", "vllm:prompt_tokens_total": "total_prompt_tokens", "vllm:generation_tokens_total": "total_generation_tokens"},
    "sglang": {"sglang:token_usage": "kv_cache_usage", "sglang:num_running_reqs": "num_requests_running", "sglang:num_queue_reqs": "num_requests_waiting", "sglang:prompt_tokens_total": "total_prompt_tokens", "sglang:gen_throughput_total": "total_generation_tokens"},
}


def parse_scrapes(scrapes: DataFrame, text: str = "body", gauges: dict[str, str] | None = None) -> DataFrame:
    """A row for each sample of a scrape: ``name, labels, value``, and ``gauge`` for names of ``gauges`` (those of both backends).

    Comments, blank lines and lines without a number are left out. The cache's usage is a
    share and becomes a percentage, whatever the backend calls it.
    """
    gauges = GAUGES["vllm"] | GAUGES["sglang"] if gauges is None else gauges
    line = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\S+)?$"
    keep = [c for c in scrapes.columns if c != text]
    rows = scrapes.select(*keep, F.explode(F.split(F.col(text), r"\r?\n")).alias("line")).withColumn("line", F.trim("line")).where(~F.col("line").startswith("#") & F.col("line").rlike(line))
    pairs = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\\\]|\\\\.)*)"'
    inner = F.regexp_extract("line", line, 2)
    labels = F.map_from_arrays(F.regexp_extract_all(inner, F.lit(pairs), F.lit(1)), F.regexp_extract_all(inner, F.lit(pairs), F.lit(2)))
    out = rows.select(*keep, F.regexp_extract("line", line, 1).alias("name"), labels.alias("labels"), F.expr(r"try_cast(regexp_extract(line, '" + line.replace("\\", "\\\\") + "', 3) as double)").alias("value")).where("value is not null and not isnan(value)")
    known = F.create_map(*[F.lit(x) for pair in gauges.items() for x in pair]) if gauges else F.create_map().cast("map<string,string>")
    out = out.withColumn("gauge", F.try_element_at(known, F.col("name")))
    return out.withColumn("value", F.when(F.coalesce(F.col("gauge") == "kv_cache_usage", F.lit(False)), F.col("value") * 100).otherwise(F.col("value")))


def counter_deltas(samples: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Adds ``delta``: the counter's growth since the scrape before; after a reset, its value."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(ts))
    return samples.withColumn("delta", F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")))


def run_totals(generations: DataFrame) -> DataFrame:
    """``run_id``: agent seconds and tokens over all generations; absent ones count 0."""
    return generations.groupBy("run_id").agg(F.sum(F.coalesce("agent_seconds", F.lit(0.0))).alias("agent_seconds"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"))


#: Categories of an early end.
EARLY_ENDS = ("context_overflow", "repetition_collapse", "wall_clock", "harness_error")


def termination_flags(episodes: DataFrame) -> DataFrame:
    """Adds ``partial, category, reason`` by ``termination_category``; without an early end both are null."""
    early = F.coalesce(F.col("termination_category").isin(*EARLY_ENDS), F.lit(False))
    return episodes.withColumns({"partial": early, "category": F.when(early, F.col("termination_category")), "reason": F.when(early, F.col("termination_reason"))})
