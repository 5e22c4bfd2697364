"""Orders as generations of a customer's run, customers as pools and candidates, vectors as layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import experiments, refine, runlogs, training
from ..sources import files
from ..streaming import logs
from . import rows as rows_queries
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first orders of each customer by key, numbered as generations."""
    o = table(spark, sf_dir, "orders")
    metrics = F.struct(F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 10).cast("double").alias("digit"))
    runs = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", metrics.alias("metrics")))), lambda x: F.struct(x["metrics"].alias("metrics"))).alias("generations"))
    return runlogs.generation_comparison(runs)


NUMBERED = "n AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS generation, o_totalprice AS price, (o_orderkey % 10)::DOUBLE AS digit FROM orders)"


@query(f"WITH {NUMBERED} SELECT run_id, generation::INT AS generation, round(price, 2) AS price, digit FROM n")
def mx14_generation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generations(spark, sf_dir), 2)


@query(
    f"WITH {NUMBERED}, m AS (SELECT run_id, 'price' AS metric, generation, price AS value FROM n UNION ALL SELECT run_id, 'digit', generation, digit FROM n) "
    "SELECT run_id, metric, generation::INT AS generation, round(value, 2) AS value, round(CASE WHEN metric = 'price' THEN sum(value) OVER w ELSE max(value) OVER w END, 2) AS total, count(value) OVER w || ' of ' || count(*) OVER w AS coverage FROM m WINDOW w AS (PARTITION BY run_id, metric)"
)
def mx15_run_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runlogs.run_pivot(generations(spark, sf_dir), ["price", "digit"], {"price": "sum", "digit": "max"})
    return rounded(found.select("run_id", "metric", F.explode("values").alias("generation", "value"), "total", "coverage"), 2)


@query(
    "WITH e AS (SELECT (user_id % 9)::INT AS g, event_type <> 'error' AS ok, event_id, value, ts FROM events), t AS (SELECT (user_id % 9)::INT AS g, min(ts) AS a, max(ts) + INTERVAL 90 SECOND AS b FROM events GROUP BY 1), "
    "s AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE ok) AS good, sum(event_id % 3) AS rows, sum(value) AS secs, sum(value) FILTER (WHERE ok) AS score, sum(event_id % 50) AS i, sum(event_id % 7) FILTER (WHERE event_id % 2 = 0) AS o, avg(value) AS cpu, max(value) AS kv, median(value) AS med, sum(value) / 1000 AS inf FROM e GROUP BY g) "
    "SELECT s.g AS generation_id, n::BIGINT AS total_episodes_run, good::BIGINT AS total_successful, rows::BIGINT AS training_row_count, round(score, 3) AS total_score, round(secs, 3) AS total_agent_seconds, round(epoch_us(b) / 1e6 - epoch_us(a) / 1e6, 1) AS generation_wall_clock_seconds, "
    "round(n * 3600 / (epoch_us(b) / 1e6 - epoch_us(a) / 1e6), 4) AS episodes_per_hour, round(rows * 60 / (epoch_us(b) / 1e6 - epoch_us(a) / 1e6), 4) AS training_rows_per_minute, (i + coalesce(o, 0))::BIGINT AS total_tokens, round((i + coalesce(o, 0)) / good, 3) AS tokens_per_successful_episode, round(cpu, 3) AS average_cpu_utilization_pct, "
    "round(kv, 3) AS peak_kv_cache_usage_pct, round(med, 3) AS median_context_tokens, round(inf, 3) AS total_inference_seconds FROM s JOIN t ON s.g = t.g"
)
def mx17_generation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("generation_id", (F.col("user_id") % 9).cast("int"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    generations = e.groupBy("generation_id").agg(text(F.min("ts")).alias("started_at"), text(F.max("ts") + F.expr("interval 90 seconds")).alias("completed_at"))
    value = {c: F.col("value") for c in ("score", "duration_seconds", "avg_cpu_utilization_pct", "peak_kv_cache_usage_pct", "median_context_tokens", "total_inference_ms")}
    k = F.col("event_id")
    episodes = e.select("generation_id", (F.col("event_type") != "error").alias("success"), (k % 3).alias("training_rows"), (k % 50).alias("total_input_tokens"), F.when(k % 2 == 0, k % 7).alias("total_output_tokens"), *[v.alias(c) for c, v in value.items()])
    out = runlogs.generation_rollup(generations, episodes)
    whole = ["generation_id", "total_episodes_run", "total_successful", "training_row_count", "total_tokens"]
    digits = {"total_score": 3, "total_agent_seconds": 3, "generation_wall_clock_seconds": 1, "episodes_per_hour": 4, "training_rows_per_minute": 4, "tokens_per_successful_episode": 3, "average_cpu_utilization_pct": 3, "peak_kv_cache_usage_pct": 3, "median_context_tokens": 3, "total_inference_seconds": 3}
    return out.select(*whole, *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("WITH f AS (SELECT user_id, event_type, avg(value) - avg(value / 2) AS freed FROM events GROUP BY 1, 2) SELECT user_id AS episode_id, round(sum(freed), 3) AS freed_kb FROM f GROUP BY user_id")
def mx18_space_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("filesystem"), F.col("value").alias("before_kb"), (F.col("value") / 2).alias("after_kb"))
    return rounded(runlogs.space_freed(e), 3)


@query("SELECT user_id AS episode_id, round(avg(value), 3) AS mean_gauge, round(max(value), 3) AS peak_gauge, count(value)::BIGINT AS samples_gauge FROM events GROUP BY user_id")
def mx19_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runlogs.utilisation_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("value").alias("gauge")), ["gauge"]), 3)


@query("SELECT o_custkey AS run_id, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END), 2) AS agent_seconds, sum(o_orderkey)::BIGINT AS total_tokens FROM orders GROUP BY o_custkey")
def mx22_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("agent_seconds"), F.col("o_orderkey").alias("total_tokens"))
    return rounded(runlogs.run_totals(g), 2)


@query("SELECT event_id, event_type IN ('error', 'view') AS partial, CASE event_type WHEN 'error' THEN 'harness_error' WHEN 'view' THEN 'repetition_collapse' END AS category, CASE WHEN event_type IN ('error', 'view') THEN props END AS reason FROM events")
def mx23_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") == "error", "harness_error").when(F.col("event_type") == "view", "repetition_collapse").when(F.col("event_type") == "click", "finished")
    episodes = table(spark, sf_dir, "events").withColumns({"termination_category": category, "termination_reason": F.col("props")})
    return runlogs.termination_flags(episodes).select("event_id", "partial", "category", "reason")


@query("SELECT o_orderkey AS spec_id, min(u.c_custkey) OVER (PARTITION BY o.o_custkey) IS NOT NULL AS hit FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) u ON o.o_custkey = u.c_custkey")
def st8_cached_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = lambda c: F.struct(F.col(c).alias("customer"))
    specs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_id"), spec("o_custkey").alias("spec"))
    c = table(spark, sf_dir, "customer")
    cache = c.select(F.sha2(F.to_json(spec("c_custkey")), 256).alias("spec_hash"), F.col("c_name").alias("uri"), F.col("c_custkey").alias("pos"))
    alive = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("uri"))
    return logs.cached_fields(specs, cache, alive).select("spec_id", "hit")


@query("SELECT s_suppkey, s_acctbal > 5000 AS admitted FROM supplier WHERE s_acctbal > 5000")
def kg2_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiments.admitted(rows_queries.records(spark, sf_dir))
    return found.select(F.substring("experiment_id", 2, 5).cast("long").alias("s_suppkey"), "admitted")


@query("SELECT conv_id || ':' || turn AS row_id, role, text FROM conversations WHERE text IS NOT NULL AND role = 'user'")
def tr8_sft_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    r = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), (F.col("role") == "user").alias("success"), F.col("role").alias("prompt"), F.col("text").alias("response"))
    return training.sft_texts(r).select("row_id", F.get("messages", F.lit(0))["content"].alias("role"), F.get("messages", F.lit(1))["content"].alias("text"))


@query("SELECT vec_id, (i - 1)::BIGINT AS voxel_id, ((i - 1) // 8)::INT AS ix, (((i - 1) // 4) % 2)::INT AS iy, ((i - 1) % 4)::INT AS iz, round(embedding[i]::DOUBLE, 4) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def io3_layer_from_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.col("embedding").cast("array<double>").alias("values"))
    cells = files.layer_from_array(v, Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1_000, 2, 4)), nested=False)
    return rounded(cells.select(F.col("layer").alias("vec_id"), "voxel_id", "ix", "iy", "iz", "value"))


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 1000 THEN 'coverage_a' END, CASE WHEN c_acctbal > 9000 THEN 'coverage_b' END, CASE WHEN c_nationkey = 3 THEN 'dedup' END, CASE WHEN c_custkey % 4 = 0 THEN 'schema_validity' END], lambda x: x IS NOT NULL) AS gates FROM customer")
def rf10_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    low = lambda bad: F.when(bad, 0.1).otherwise(0.9)
    checks = c.select("c_custkey", low(F.col("c_acctbal") < 1000).alias("coverage_a"), low(F.col("c_acctbal") > 9000).alias("coverage_b"), low(F.col("c_nationkey") == 3).alias("nearest"), (F.col("c_custkey") % 4 == 0).cast("int").alias("violations"), F.lit(True).alias("feasible_order"), F.lit(0).alias("open_cells"), F.lit(None).cast("int").alias("order_breaks"))
    return refine.gate_failures(checks, 0.75, 0.2).select("c_custkey", "gates")


@query(
    "WITH p AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, sha256(s_name) AS h FROM supplier), x AS (SELECT a.id AS left_id, b.id AS right_id, len(list_filter(range(1, 65), lambda i: a.h[i:i] <> b.h[i:i])) * 10000 + ('0x' || left(sha256('task:' || a.id || ':' || b.id), 6))::BIGINT AS score FROM p a JOIN p b ON a.id < b.id) SELECT left_id, right_id, score::BIGINT AS score FROM x ORDER BY score DESC, left_id, right_id LIMIT 1"
)
def rf15_reference_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("member_id"), F.sha2("s_name", 256).alias("content_hash"))
    return refine.reference_pair(pool, "task")



REWARDS = (
    "e AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS boot, o_orderkey % 3 > 0 AS passed, CASE WHEN o_orderkey % 31 = 0 THEN 'infinity'::DOUBLE ELSE o_totalprice / 1021 END AS score, 100.0 AS steady, CASE WHEN o_orderkey % 4 = 0 THEN 50.0 ELSE 250.0 END AS threshold, o_orderkey % 13 = 1 AS failed, o_orderkey % 17 = 2 AS spent, o_orderkey % 19 <> 3 AS reported, "
    "o_orderkey % 11 <> 4 AS submitted, o_orderkey % 7 <> 5 AS told, o_orderkey % 23 = 6 AS tampered, o_orderkey % 29 = 7 AS crashed FROM orders), "
    "v AS (SELECT *, CASE WHEN boot THEN passed ELSE passed AND score <= threshold END AS ok FROM e), "
    "w AS (SELECT *, CASE WHEN boot THEN CASE WHEN passed THEN 0.5 ELSE 0 END ELSE greatest(CASE WHEN NOT passed THEN 0 WHEN score <= steady THEN 1 ELSE greatest(0, 1 - (score - steady) / steady) END, CASE WHEN failed AND NOT ok THEN 0.1 ELSE 0 END) END AS worth, spent OR NOT reported OR NOT submitted OR NOT told OR tampered OR crashed AS void FROM v)"
)


@query(
    f"WITH {REWARDS} SELECT k AS episode, round(CASE WHEN void THEN 0 ELSE worth END, 6)::DOUBLE AS value, ok AND NOT void AS success, list_filter([CASE WHEN crashed THEN 'worker_crash' END, CASE WHEN NOT reported THEN 'missing_report_metric' END, CASE WHEN NOT boot AND NOT submitted THEN 'missing_candidate_submit' END, CASE WHEN boot AND NOT submitted THEN 'missing_seed_submit' END, "
    "CASE WHEN boot AND NOT told THEN 'missing_predicted_passed_gates' END, CASE WHEN NOT boot AND NOT told THEN 'missing_predicted_score_bits' END], lambda x: x IS NOT NULL) AS gate_failures, CASE WHEN reported AND told AND isfinite(score) THEN round(abs(90 - score), 4) END AS calibration_error_bits FROM w"
)
def rf16_graph_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: every rung of the ladder is hit."""
    k = F.col("o_orderkey")
    told = k % 7 != 5
    e = table(spark, sf_dir, "orders").select(
        k.alias("episode"), F.when(k % 5 == 0, "bootstrap").otherwise("regular").alias("workflow_kind"), (k % 3 > 0).alias("passed_gates"), F.when(k % 31 == 0, float("inf")).otherwise(F.col("o_totalprice") / 1021).alias("score_bits"), F.lit(100.0).alias("t_steady"),
        F.when(k % 4 == 0, 50.0).otherwise(250.0).alias("admission_threshold"), F.when(k % 13 == 1, "engine_failed").alias("execute_status"), F.when(k % 17 == 2, "plan").alias("budget_exhausted_step"), (k % 19 != 3).alias("reported"),
        (k % 11 != 4).alias("candidate_submitted"), (k % 11 != 4).alias("seed_submitted"), F.when(told, F.lit(True)).alias("predicted_passed_gates"), F.when(told, F.lit(90.0)).alias("predicted_score_bits"), F.when(k % 23 == 6, "dataset_tampered").alias("cheating_detected"),
        F.when(k % 29 == 7, F.array(F.lit("worker_crash"))).alias("gate_failures"), F.lit(1).alias("episode_count"), F.lit(5).alias("x_warmup_episodes"),
    )
    out = refine.graph_reward(e)
    return out.select("episode", F.round("value", 6).alias("value"), "success", "gate_failures", F.round("calibration_error_bits", 4).alias("calibration_error_bits"))


@query("SELECT c_custkey AS episode, round(CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_nationkey % 2 = 0 THEN least(1, greatest(0, c_acctbal / 4021)) ELSE 0.1 END, 6)::DOUBLE AS value, c_custkey % 5 <> 0 AND c_nationkey % 2 = 0 AS success FROM customer")
def rf16_feature_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    e = c.select(F.col("c_custkey").alias("episode"), F.when(F.col("c_custkey") % 5 != 0, -F.col("c_acctbal") / 4.021).alias("bic_delta"), (F.col("c_nationkey") % 2 == 0).alias("admitted"))
    return refine.feature_reward(e).select("episode", F.round("value", 6).alias("value"), "success")


def elements(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Suppliers of a nation as elements of three kinds, compared with those of the nations behind it."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(((F.col("s_nationkey") + 25 - shift) % 25).alias("pair_id"), F.concat(F.lit("e"), k.cast("string")).alias("element"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("kind"), F.lit("node").alias("role"), (F.col("s_acctbal") / 1000).alias("x"), (k % 10).cast("double").alias("y"), F.lit(0.0).alias("z"), F.create_map(F.lit("even"), (k % 2 == 0).cast("string")).alias("attrs"))


ELEMENTS = (
    "el AS (SELECT role, (s_nationkey + 25 - role) % 25 AS p, 'e' || s_suppkey AS e, s_suppkey % 3 AS kind, s_acctbal / 1000 AS x, (s_suppkey % 10)::DOUBLE AS y, s_suppkey % 2 AS odd FROM supplier, range(3) r(role)), "
    "d AS (SELECT a.p, a.role AS ra, b.role AS rb, a.e AS ea, b.e AS eb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2 + abs(a.odd - b.odd) AS d FROM el a JOIN el b ON a.p = b.p AND a.kind = b.kind AND a.role <> b.role), "
    "near AS (SELECT p, ra, ea, min(d) FILTER (WHERE (ra = 0 OR rb = 0) AND d <= 2) AS d FROM d GROUP BY ALL), "
    "c AS (SELECT el.p, count(*) AS elements, count(*) FILTER (WHERE near.d IS NULL) AS added, count(near.d) AS modified, coalesce(sum(near.d), 0) AS distance FROM el LEFT JOIN near ON near.p = el.p AND near.ra = 0 AND near.ea = el.e WHERE role = 0 GROUP BY el.p), "
    "n AS (SELECT p, kind, count(*) FILTER (WHERE role = 0) AS n, greatest(count(*) FILTER (WHERE role = 1), count(*) FILTER (WHERE role = 2)) AS m FROM el GROUP BY ALL), sm AS (SELECT p, sum(CASE WHEN m > 1 AND n = 1 THEN 1 WHEN m = 1 AND n > 1 THEN n - 1 ELSE 0 END) AS sm FROM n GROUP BY p), "
    # The references hold different suppliers far apart in number; greedy one-to-one matches by rounds of the best pair left.
    "g AS (WITH RECURSIVE r AS (SELECT p, kind, list({'d': d, 'a': ea, 'b': eb} ORDER BY d, ea, eb) AS todo, []::STRUCT(d DOUBLE, a VARCHAR, b VARCHAR)[] AS done FROM (SELECT d.*, kind FROM d JOIN el ON el.p = d.p AND el.e = d.ea AND el.role = 1 WHERE ra = 1 AND rb = 2 AND d <= 2) GROUP BY ALL UNION ALL SELECT p, kind, list_filter(todo, lambda x: x.a <> todo[1].a AND x.b <> todo[1].b), list_append(done, todo[1]) FROM r WHERE len(todo) > 0) SELECT p, unnest(done) AS m FROM r WHERE len(todo) = 0), "
    "lost AS (SELECT el.p, el.role, el.e FROM el LEFT JOIN near ON near.p = el.p AND near.ra = el.role AND near.ea = el.e WHERE el.role > 0 AND near.d IS NULL), del AS (SELECT g.p, count(*) AS del FROM g JOIN lost a ON a.p = g.p AND a.role = 1 AND a.e = g.m.a JOIN lost b ON b.p = g.p AND b.role = 2 AND b.e = g.m.b GROUP BY g.p), "
    "cost AS (SELECT sm.p, coalesce(elements, 0) AS elements, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(distance, 0) AS distance, coalesce(del, 0) AS deleted, sm AS split_merge, log2(20) * (0.1 * coalesce(elements, 0) + coalesce(added, 0) + coalesce(del, 0) + sm) + coalesce(distance, 0) AS bits FROM sm LEFT JOIN c ON c.p = sm.p LEFT JOIN del ON del.p = sm.p)"
)


@query(f"WITH {ELEMENTS} SELECT p AS pair_id, elements::BIGINT AS elements, added::BIGINT AS added, modified::BIGINT AS modified, deleted::BIGINT AS deleted, split_merge::BIGINT AS split_merge, round(bits, 4) AS loss_bits FROM cost")
def rf7_edit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = refine.structural_edit_cost(*[elements(spark, sf_dir, k) for k in range(3)], scale=2.0, threshold=2.0)
    return out.select("pair_id", "elements", "added", "modified", "deleted", "split_merge", F.round("loss_bits", 4).alias("loss_bits"))


CELL_FIELDS = (
    "vox AS (SELECT p.range AS p, vec_id AS v, role, list_transform(embedding[1 + 2 * role : 4 + 2 * role], lambda x: abs(x::DOUBLE)) AS raw, (vec_id + p.range + role) % CASE WHEN p.range % 6 = 5 AND role = 0 THEN 2 ELSE 9 END <> 0 AS inside FROM embeddings, range(25) p, range(3) r(role) WHERE vec_id % 25 = p.range), "
    "pr AS (SELECT *, list_transform(raw, lambda x: 0.99 * x / list_sum(raw) + 0.0025) AS s FROM vox), "
    "b AS (SELECT a.p, a.role, a.inside AS ia, c.inside AS ic, list_sum(list_transform(range(1, 5), lambda k: a.s[k] * log2(a.s[k] / c.s[k]))) AS fwd, list_sum(list_transform(range(1, 5), lambda k: c.s[k] * log2(c.s[k] / a.s[k]))) AS back, 1 + list_sum(list_transform(range(1, 5), lambda k: a.s[k] * log2(a.s[k]))) / 2 AS sure FROM pr a JOIN pr c ON a.p = c.p AND a.v = c.v AND c.role = 0 AND a.role > 0), "
    "f AS (SELECT p, role, count(*) FILTER (WHERE ia AND ic) / count(*) FILTER (WHERE ia) AS cover, avg(least(fwd * sure, log2(100))) FILTER (WHERE ia AND ic) AS fit, avg(back) FILTER (WHERE ia AND ic) AS back FROM b GROUP BY ALL), "
    "k AS (SELECT a.p, a.cover AS ca, b.cover AS cb, (a.fit + b.fit) / 2 AS fit, a.back AS ra, list_filter([CASE WHEN a.cover < 0.75 THEN 'coverage_a' END, CASE WHEN b.cover < 0.75 THEN 'coverage_b' END, CASE WHEN a.p % 7 = 3 THEN 'dedup' END], lambda x: x IS NOT NULL) AS gates FROM f a JOIN f b ON a.p = b.p AND a.role = 1 AND b.role = 2)"
)


@query(
    f"WITH {ELEMENTS}, {CELL_FIELDS} SELECT k.p AS pair_id, gates, round(ca, 4) AS coverage_a, round(cb, 4) AS coverage_b, CASE WHEN len(gates) > 0 THEN 'inf' ELSE printf('%.3f', coalesce(bits, 0) + fit) END AS score, CASE WHEN len(gates) = 0 THEN round(ra, 3) END AS reverse_kl_a_bits, len(gates) = 0 AND coalesce(added, 0) > 0 AS flagged FROM k LEFT JOIN cost ON cost.p = k.p"
)
def rf11_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their two references as elements and fields: vectors are cells, their dimensions units."""
    v = table(spark, sf_dir, "embeddings")
    parts = []
    for k, role in enumerate(("candidate", "a", "b")):
        every = F.when((F.col("pair_id") % 6 == 5) & F.lit(k == 0), 2).otherwise(9)
        cells = v.select((F.col("vec_id") % 25).cast("int").alias("pair_id"), F.col("vec_id").alias("voxel_id"), F.lit(role).alias("role"), F.transform(F.slice("embedding", 1 + 2 * k, 4), lambda x: F.abs(x.cast("double"))).alias("probs"))
        parts.append(cells.withColumn("in_domain", (F.col("voxel_id") + F.col("pair_id") + k) % every != 0))
    checks = v.select((F.col("vec_id") % 25).cast("int").alias("pair_id")).distinct()
    checks = checks.withColumns({"nearest": F.when(F.col("pair_id") % 7 == 3, 0.01).otherwise(0.5), "violations": F.lit(0), "feasible_order": F.lit(True), "open_cells": F.lit(0), "order_breaks": F.lit(0)})
    out = refine.score_candidates(*[elements(spark, sf_dir, k) for k in range(3)], parts[0].unionAll(parts[1]).unionAll(parts[2]), checks, scale=2.0, threshold=2.0)
    score = F.when(F.col("score_bits") == float("inf"), "inf").otherwise(F.format_string("%.3f", "score_bits"))
    return out.select("pair_id", "gates", F.round("coverage_a", 4).alias("coverage_a"), F.round("coverage_b", 4).alias("coverage_b"), score.alias("score"), F.round("reverse_kl_a_bits", 3).alias("reverse_kl_a_bits"), (F.size("flags") > 0).alias("flagged"))


@query(f"WITH {ELEMENTS} SELECT p AS pair_id, m.a AS element, m.b AS element2, round(m.d, 4) AS distance FROM g")
def rf6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(refine.greedy_match(elements(spark, sf_dir, 1), elements(spark, sf_dir, 2), 2.0, 2.0))


@query(f"WITH {ELEMENTS}, s AS (SELECT p, count(*) FILTER (WHERE role = 1) AS na, count(*) FILTER (WHERE role = 2) AS nb FROM el WHERE role > 0 GROUP BY p), t AS (SELECT p, sum(m.d) AS d, count(*) AS m FROM g GROUP BY p) SELECT s.p AS pair_id, round((coalesce(t.d, 0) + na + nb - 2 * coalesce(t.m, 0)) / greatest(na, nb), 4) AS distance FROM s LEFT JOIN t ON t.p = s.p")
def rf8_structural_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of one nation against those of the next as structural elements."""
    return rounded(refine.structural_distance(elements(spark, sf_dir, 1), elements(spark, sf_dir, 2), 2.0, 2.0))
