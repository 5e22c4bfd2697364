"""Conversations and documents as training rows and texts; parts and suppliers as experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts, uncertainty
from ..operators import experiments, training
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()


@query(
    "WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') SELECT a.conv_id || ':' || a.turn AS row_id, a.turn, a.text AS response, "
    "coalesce((SELECT string_agg('[' || b.role || ']' || chr(10) || coalesce(b.text, ''), chr(10) || chr(10) ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn), '') AS prompt FROM a"
)
def tr1_conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.conversation_rows(table(spark, sf_dir, "conversations")).drop("conv_id")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows: some ids repeated, some out of form, some without text, with unknown parents."""
    c = table(spark, sf_dir, "conversations")
    odd = F.col("conv_id") % 17
    row_id = F.when((odd == 3) & (F.col("turn") == 0), F.lit("")).when(odd == 3, F.concat(F.col("conv_id").cast("string"), F.lit("-x:1:"), F.col("turn").cast("string"))).when(odd == 5, F.concat(F.col("conv_id").cast("string"), F.lit(":0"))).otherwise(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    parent = F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    return c.select(row_id.alias("row_id"), F.col("conv_id").cast("string").alias("episode_id"), "turn", F.when(odd != 7, F.col("text")).alias("prompt"), F.when(F.col("role") == "user", "whole_episode").when(F.col("role") == "system", F.lit(None)).otherwise("turn").alias("episode_score_scope"), F.when(odd != 9, F.col("conv_id").cast("string")).otherwise("other").alias("group_episode_id"), F.when(odd != 11, parent).otherwise("").alias("parent_row_id"), F.col("role").alias("step"))


ROWS = "r AS (SELECT CASE WHEN conv_id % 17 = 3 AND turn = 0 THEN '' WHEN conv_id % 17 = 3 THEN conv_id || '-x:1:' || turn WHEN conv_id % 17 = 5 THEN conv_id || ':0' ELSE conv_id || ':' || turn END AS row_id, conv_id::VARCHAR AS episode_id, turn, CASE WHEN conv_id % 17 <> 7 THEN text END AS prompt, CASE WHEN role = 'user' THEN 'whole_episode' WHEN role <> 'system' THEN 'turn' END AS scope, CASE WHEN conv_id % 17 = 9 THEN 'other' ELSE conv_id::VARCHAR END AS grp, CASE WHEN conv_id % 17 = 11 THEN '' WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_row_id, role AS step FROM conversations)"


@query(
    f"WITH {ROWS}, v AS (SELECT row_id, 'missing_field' AS rule FROM r WHERE prompt IS NULL UNION ALL SELECT row_id, 'bad_row_id' FROM r WHERE row_id = '' UNION ALL SELECT row_id, 'duplicate_row_id' FROM r WHERE row_id <> '' GROUP BY row_id HAVING count(*) > 1 "
    "UNION ALL SELECT row_id, 'bad_scope' FROM r WHERE scope IS DISTINCT FROM 'whole_episode' UNION ALL SELECT row_id, 'episode_mismatch' FROM r WHERE grp <> episode_id UNION ALL SELECT row_id, 'bad_parent' FROM r WHERE parent_row_id = '' UNION ALL SELECT row_id, 'unknown_parent' FROM r WHERE parent_row_id <> '' AND parent_row_id NOT IN (SELECT row_id FROM r) AND parent_row_id NOT IN (SELECT conv_id || ':' || turn FROM conversations WHERE conv_id % 17 = 3 AND conv_id % 2 = 0)) SELECT rule, count(*)::BIGINT AS violations, count(DISTINCT row_id)::BIGINT AS rows FROM v GROUP BY rule"
)
def tr3_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").where("conv_id % 17 = 3 and conv_id % 2 = 0").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"))
    found = training.validate_rows(rows(spark, sf_dir), ["row_id", "episode_id", "prompt"], source)
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("row_id").alias("rows"))


@query(f"WITH r AS (SELECT conv_id || ':' || turn AS row_id, text, role FROM conversations), a AS (SELECT row_id, CASE WHEN length(text) % 3 = 0 THEN upper(text) ELSE text END AS t, text FROM r WHERE role = 'user') SELECT (SELECT count(*) FROM r)::BIGINT AS rows_in, count(*)::BIGINT AS rows_out, (SELECT count(*) FROM r WHERE role <> 'user')::BIGINT AS removed, 0::BIGINT AS added, count(*) FILTER (WHERE t <> text)::BIGINT AS modified FROM a")
def tr4_transform_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), "text", F.col("role").alias("step"))
    after = training.keep_workflow_steps(before, ["user"]).withColumn("text", F.when(F.length("text") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    return training.transform_delta(before, after)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes with their turns as prompt-response pairs."""
    c = table(spark, sf_dir, "conversations")
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("prompt"), F.col("text").alias("response"))))
    e = c.groupBy("conv_id").agg(pairs.alias("prompt_responses"))
    none = F.array().cast("array<struct<row_id:string,prompt:string,response:string,step:string>>")
    return e.select(F.col("conv_id").cast("string").alias("episode_id"), (F.col("conv_id") % 5).cast("int").alias("generation_id"), F.col("conv_id").cast("int").alias("episode_index"), (F.col("conv_id") % 7 / 7.0).alias("score"), (F.col("conv_id") % 3 != 0).alias("success"), "prompt_responses", none.alias("raw_training_rows"))


@query("SELECT conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS row_id, (conv_id % 5)::INT AS generation_id, role AS prompt, text AS response, round((conv_id % 7) / 7.0, 4) AS score FROM conversations WHERE conv_id % 3 <> 0")
def tr2_enrich_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.enrich_rows(episodes(spark, sf_dir)).select("row_id", "generation_id", "prompt", "response", "score"))


@query("SELECT conv_id::VARCHAR AS episode_id, count(*)::BIGINT AS pairs FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def tr10_sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.sft_rows(episodes(spark, sf_dir)).groupBy("episode_id").agg(F.count("*").alias("pairs"))


@query("SELECT o_custkey AS generation_id, max(o_orderkey)::BIGINT AS export_id FROM (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders WHERE o_custkey BETWEEN 41 AND 140) WHERE o_orderdate = m GROUP BY o_custkey")
def tr9_training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("generation_id"), F.col("o_orderkey").alias("export_id"), F.col("o_orderdate").alias("created_at"))
    return training.training_window(exports, 140, 100).select("generation_id", "export_id")


@query("WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS code FROM t")
def tx1_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document, without fences in the given tables, as the second of two fenced blocks."""
    answer = F.concat(F.lit("Text\n```json\n{}\n```\nmore\n```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.extract_code_block(answer, ["python", "py"]), 256).alias("code"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tx4_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Here: "), "props", F.lit(" done.")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(texts.first_json_object(answer), "$.k").cast("long").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tx2_balanced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Odd { brace, then "), "props", F.lit(" and } more"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(texts.first_balanced_object(answer), "$.k").cast("long").alias("k"))


@query()
def tx3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts.detect_repetition(F.regexp_replace("text", "\n", "\n\n"), run=2)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("r")).select("doc_id", "r.start", "r.kind", "r.preview").where("start is not null")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as experiments: the balance is the gain, the nation the layer."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.format_string("e%05d", key).alias("experiment_id"), F.col("s_name").alias("hypothesis"), F.lit("why").alias("rationale"), F.when(key % 2 == 0, F.lit('{"part": "all"}')).alias("data_spec"), F.lit("done").alias("result_summary"), F.when(key % 3 != 0, (key % 7 - 3) / 16).alias("cv_mse_delta"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("feature_layer_name"), (-F.col("s_acctbal")).alias("bic_delta"), (F.col("s_acctbal") / 1000).alias("predicted_value"), (F.col("s_acctbal") > 5000).alias("admitted"),
        F.create_map(F.concat(F.lit("n"), ((F.col("s_nationkey") + 1) % 25).cast("string")), F.lit(0.5)).alias("mutual_info"),
        F.when(key % 2 == 0, F.array(F.format_string("e%05d", key), F.format_string("e%05d", key + 1))).otherwise(F.array().cast("array<string>")).alias("parent_experiments"), F.lit("2024-01-01").alias("ts"),
    )


RECORDS = "x AS (SELECT s_suppkey AS k, printf('e%05d', s_suppkey) AS id, s_nationkey AS n, s_acctbal / 1000 AS v, -s_acctbal AS d, s_acctbal > 5000 AS ok, s_name AS name FROM supplier)"


@query(f"WITH {RECORDS}, p AS (SELECT a.id AS a, b.id AS b, ((CASE WHEN b.n = (a.n + 1) % 25 THEN 0.5 ELSE 0 END) + (CASE WHEN a.n = (b.n + 1) % 25 THEN 0.5 ELSE 0 END)) / 2 AS mi, a.v + b.v AS s, greatest(a.v, b.v) AS g, a.v AS va, b.v AS vb FROM x a JOIN x b ON a.k < b.k WHERE a.ok AND b.ok AND NOT (a.k % 2 = 0 AND b.k = a.k + 1)) SELECT CASE WHEN vb > va THEN b ELSE a END AS a, CASE WHEN vb > va THEN a ELSE b END AS b, round(mi, 4) AS mutual_info, round(s - mi, 4) AS score FROM (SELECT * FROM p ORDER BY s - mi DESC, g DESC, a, b LIMIT 5)")
def kg3_crossbreed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.crossbreed_pairs(records(spark, sf_dir)))


@query(f"WITH {RECORDS}, i AS (SELECT least(x.id, 'e00001') || '_' || greatest(x.id, 'e00001') AS pair_id, CASE WHEN x.n = (SELECT (n + 1) % 25 FROM x WHERE id = 'e00001') THEN 0.5 ELSE 0.0 END AS mi FROM x) SELECT a.id AS a, b.id AS b, round(abs(a.d) + abs(b.d) - coalesce(20000 * i.mi, 0), 4) AS score FROM x a JOIN x b ON a.id < b.id LEFT JOIN i ON i.pair_id = a.id || '_' || b.id WHERE a.d < 0 AND b.d < 0 ORDER BY score DESC, a, b LIMIT 1")
def kg4_crossbreed_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index holds the pairs of the first record, on the scale of the gains."""
    index = experiments.mi_index_for_new(records(spark, sf_dir), records(spark, sf_dir).where("experiment_id = 'e00001'")).withColumns({"mi": 20000 * F.col("mi"), "pos": F.lit(1)})
    return rounded(experiments.crossbreed_best(records(spark, sf_dir), index))


@query(f"WITH {RECORDS} SELECT least(x.id, 'e00001') || '_' || greatest(x.id, 'e00001') AS pair_id, CASE WHEN x.n = (SELECT (n + 1) % 25 FROM x WHERE id = 'e00001') THEN 0.5 ELSE 0.0 END::DOUBLE AS mi FROM x WHERE x.id <> 'e00001'")
def kg5_mi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_records = records(spark, sf_dir)
    return experiments.mi_index_for_new(all_records, all_records.where("experiment_id = 'e00001'"))


PAIR = (
    "'Hypothesis: ' || name || chr(10) || 'Rationale: why' || CASE WHEN k % 2 = 0 THEN chr(10) || 'Data specification: {\"part\": \"all\"}' ELSE '' END AS prompt, "
    "'Analysis result: done' || chr(10) || 'BIC: ' || CASE WHEN d < 0 THEN 'improved' ELSE 'worsened' END || printf(' by %.2f', abs(d)) || "
    "CASE WHEN k % 3 <> 0 THEN chr(10) || 'Depth CV-MSE: ' || CASE WHEN k % 7 < 3 THEN 'improved' ELSE 'worsened' END || printf(' by %.4f', abs((k % 7 - 3) / 16)) ELSE '' END || chr(10) || "
    "CASE WHEN ok THEN 'Conclusion: Hypothesis supported. Feature ' || chr(39) || 'n' || n || chr(39) || ' added to world model.' ELSE 'Conclusion: Hypothesis not supported or redundant. Feature not added.' END AS response"
)


@query(f"WITH {RECORDS} SELECT id AS experiment_id, {PAIR}, round(v, 6) AS score FROM x")
def kg1_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.training_pairs(records(spark, sf_dir)), 6)


@query(f"WITH {RECORDS}, p AS (SELECT a.id AS a, b.id AS b, a.d AS da, b.d AS db, a.name AS na, b.name AS nb, a.n AS la, b.n AS lb FROM x a JOIN x b ON b.k = a.k + 1) SELECT a, b, 'These experiments both improved the world model:' || chr(10) || chr(10) || 'Experiment 1: \"' || na || '\"' || chr(10) || '- Result: done' || chr(10) || printf('- BIC improvement: %.2f', abs(da)) || chr(10) || '- Feature: n' || la || chr(10) || chr(10) || 'Experiment 2: \"' || nb || '\"' || chr(10) || '- Result: done' || chr(10) || printf('- BIC improvement: %.2f', abs(db)) || chr(10) || '- Feature: n' || lb || chr(10) || chr(10) || 'Given that both of these patterns exist in the data, what new hypothesis ' || chr(10) || 'would you propose that combines or builds on these findings?' AS prompt FROM p")
def kg6_crossbreed_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").select(F.format_string("e%05d", key).alias("a"), F.format_string("e%05d", key + 1).alias("b"))
    return experiments.crossbreed_prompt(pairs, records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT id, {PAIR}, ok AS admitted, round(d, 4) AS mdl_delta, '2024-01-01' AS timestamp FROM x")
def kg7_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.export_experiments(records(spark, sf_dir)))


@query(f"WITH {RECORDS} SELECT count(*)::BIGINT AS experiments, count(*) FILTER (WHERE ok)::BIGINT AS admitted, round(sum(-d) FILTER (WHERE ok), 3) AS improvement, count(DISTINCT n)::BIGINT AS layers, round(count(*) FILTER (WHERE ok) / count(*), 3) AS admission_rate FROM x")
def kg8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.experiment_stats(records(spark, sf_dir)), 3)


@query(f"WITH {RECORDS}, y AS (SELECT *, {PAIR} FROM x) SELECT id AS experiment_id, response || printf(chr(10) || chr(10) || 'Result: %.4f BIC delta. ', d) || CASE WHEN ok THEN 'Admitted.' ELSE 'Not admitted.' END AS response, ok AND d < 0 AS as_knowledge FROM y")
def kg9_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.rewrite_record(records(spark, sf_dir)).select("experiment_id", "response", "as_knowledge")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'interval' WHEN 2 THEN 'point' ELSE 'distribution' END AS kind, p_size > 5 OR p_partkey % 4 > 1 AS valid, round(CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN (5 + p_size) / 2.0 WHEN 2 THEN p_retailprice ELSE (p_size + 2 * p_size) / 2.0 END, 4) AS nominal, round(CASE p_partkey % 4 WHEN 0 THEN pow(p_size - 5, 2) WHEN 2 THEN 0.0 WHEN 3 THEN pow(p_size, 2) / 12 END, 4) AS variance FROM part")
def un1_uncertain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, v = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"mean": '), v, F.lit(', "std": '), (F.col("p_size") - 5).cast("string"), F.lit("}"))).when(kind == 1, F.concat(F.lit('{"lo": 5, "hi": '), s, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"value": '), v, F.lit("}")))
        .otherwise(F.concat(F.lit('{"name": "uniform", "params": {"lo": '), s, F.lit(', "hi": '), (2 * F.col("p_size")).cast("string"), F.lit("}}")))
    )
    parsed = table(spark, sf_dir, "part").select("p_partkey", uncertainty.parse_uncertainty(text).alias("u"))
    return rounded(parsed.select("p_partkey", "u.kind", "u.valid", uncertainty.nominal(F.col("u")).alias("nominal"), uncertainty.variance(F.col("u")).alias("variance")))


