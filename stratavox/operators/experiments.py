"""Records of experiments: training pairs, verdicts, crossbreeding and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by(label: str, delta: str, digits: int) -> Column:
    """Line on a gain or loss, null without one."""
    moved = F.when(F.col(delta) < 0, F.lit("improved")).otherwise(F.lit("worsened"))
    return F.when(F.col(delta).isNotNull(), F.concat(F.lit(f"{label}: "), moved, F.format_string(f" by %.{digits}f", F.abs(F.col(delta)))))


def training_pairs(experiments: DataFrame) -> DataFrame:
    """``experiment_id, prompt, response, score``: the question that an experiment asked, what came out, and its predicted value.

    ``data_spec`` is JSON; lines whose value is null (or whose specification is empty) are left out.
    """
    # The lines of both texts.
    spec = F.when(~F.coalesce("data_spec", F.lit("")).isin("", "{}", "null"), F.concat(F.lit("Data specification: "), "data_spec"))
    prompt = F.concat_ws("\n", F.concat(F.lit("Hypothesis: "), "hypothesis"), F.concat(F.lit("Rationale: "), "rationale"), spec)
    kept = F.concat(F.lit("Conclusion: Hypothesis supported. Feature '"), F.coalesce("feature_layer_name", F.lit("None")), F.lit("' added to world model."))
    conclusion = F.when(F.col("admitted"), kept).otherwise(F.lit("Conclusion: Hypothesis not supported or redundant. Feature not added."))
    response = F.concat_ws("\n", F.concat(F.lit("Analysis result: "), "result_summary"), _by("BIC", "bic_delta", 2), _by("Depth CV-MSE", "cv_mse_delta", 4), conclusion)
    return experiments.select("experiment_id", prompt.alias("prompt"), response.alias("response"), F.col("predicted_value").alias("score"))


def admitted(experiments: DataFrame) -> DataFrame:
    return experiments.where("admitted")


def rejected(experiments: DataFrame) -> DataFrame:
    return experiments.where("not coalesce(admitted, false)")


def _tried(experiments: DataFrame) -> DataFrame:
    """Distinct unordered pairs that stand together among some record's parents."""
    parents = F.array_distinct("parent_experiments")
    first = experiments.select(parents.alias("p"), F.explode(parents).alias("a"))
    return first.select("a", F.explode("p").alias("b")).where("a < b").distinct()


def _reaching(values: DataFrame, value: str, most: int, slack: Column, scored) -> DataFrame:
    """Rows of ``values`` that can stand in one of the ``most`` best pairs, whose score is at most both values' sum and ``slack``.

    The pairs of the highest values give a score to reach; a row that misses it even with the
    highest value of all is left out. The first rows double until they give enough pairs.
    """
    taken, whole = 32 + most, values.count()
    while taken < whole:
        first = values.orderBy(F.desc(value)).limit(taken)
        found = scored(first).select("score").orderBy(F.desc("score")).limit(most).agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
        if found.n == most:
            top = values.agg(F.max(value).alias("top"), slack.alias("slack")).first()
            return values.where(F.col(value) + F.lit(top.top) + F.lit(top.slack) >= F.lit(found.least) - F.lit(1e-9 * (1 + abs(found.least))))
        taken *= 2
    return values


def crossbreed_pairs(experiments: DataFrame, most: int = 5, prefer_orthogonal: bool = True) -> DataFrame:
    """``a, b, mutual_info, score`` of the best pairs of admitted experiments that no record has combined, ``a`` the one of higher value (of lower id on ties).

    The score is the values' sum less the mean of the two look-ups of their mutual
    information. Only rows that can reach the last of the best scores are paired.
    """
    look = lambda info, layer: F.coalesce(F.try_element_at(info, layer), F.lit(0.0))
    shared = (look("info_a", F.col("layer_b")) + look("info_b", F.col("layer_a"))) / 2 if prefer_orthogonal else F.lit(0.0)
    tried = _tried(experiments).toDF("ta", "tb")
    kept = admitted(experiments).select("experiment_id", "feature_layer_name", F.coalesce("predicted_value", F.lit(0.0)).alias("value"), "mutual_info")
    lowest = F.coalesce(F.min(F.array_min(F.map_values("mutual_info"))), F.lit(0.0)) if prefer_orthogonal else F.lit(0.0)
    kept = _reaching(kept, "value", most, -F.least(lowest, F.lit(0.0)), lambda rows: _scored_pairs(rows, tried, shared))
    scored = _scored_pairs(kept, tried, shared)
    best = F.greatest("value_a", "value_b")
    first = scored.orderBy(F.desc("score"), best.desc(), "a", "b").limit(most)
    later = F.col("value_b") > F.col("value_a")
    return first.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("b"), "mutual_info", "score")


def _scored_pairs(kept: DataFrame, tried: DataFrame, shared: Column) -> DataFrame:
    """Pairs of rows that no record has combined, ``a < b``, with their score."""
    a = kept.select(F.col("experiment_id").alias("a"), F.col("feature_layer_name").alias("layer_a"), F.col("value").alias("value_a"), F.col("mutual_info").alias("info_a"))
    b = kept.select(F.col("experiment_id").alias("b"), F.col("feature_layer_name").alias("layer_b"), F.col("value").alias("value_b"), F.col("mutual_info").alias("info_b"))
    pairs = a.join(b, F.col("a") < F.col("b")).join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    return pairs.select("a", "b", "value_a", "value_b", shared.alias("mutual_info"), (F.col("value_a") + F.col("value_b") - shared).alias("score"))


def crossbreed_best(experiments: DataFrame, mi_index: DataFrame) -> DataFrame:
    """The best pair of successes by absolute gains less indexed mutual information (``pair_id, mi, pos``; the last row of a pair wins).

    Only rows that can reach the best score are paired.
    """
    good = experiments.where("bic_delta < 0").select("experiment_id", F.abs("bic_delta").alias("gain"))
    newest = mi_index.groupBy("pair_id").agg(F.max_by("mi", "pos").alias("mi"))

    def scored(rows: DataFrame) -> DataFrame:
        a, b = rows.toDF("a", "gain_a"), rows.toDF("b", "gain_b")
        pairs = a.join(b, F.col("a") < F.col("b")).withColumn("pair_id", F.concat_ws("_", "a", "b")).join(newest, "pair_id", "left")
        return pairs.select("a", "b", (F.col("gain_a") + F.col("gain_b") - F.coalesce("mi", F.lit(0.0))).alias("score"))

    lowest = newest.agg(F.min("mi").alias("mi")).first().mi
    reaching = _reaching(good, "gain", 1, F.lit(max(0.0, -(lowest or 0.0))), scored)
    return scored(reaching).orderBy(F.desc("score"), "a", "b").limit(1)


def mi_index_for_new(experiments: DataFrame, new: DataFrame) -> DataFrame:
    """``pair_id, mi`` of a new record (one row) with each earlier one."""
    fresh = new.select(F.col("experiment_id").alias("new_id"), F.col("mutual_info").alias("info")).limit(1)
    both = experiments.crossJoin(F.broadcast(fresh)).where("experiment_id <> new_id")
    return both.select(F.concat_ws("_", F.least("experiment_id", "new_id"), F.greatest("experiment_id", "new_id")).alias("pair_id"), F.coalesce(F.try_element_at("info", F.col("feature_layer_name")), F.lit(0.0)).alias("mi"))


def crossbreed_prompt(pairs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Adds ``prompt`` to pairs of ids ``a, b``: the request to build on both experiments."""
    # The lines of the request.
    def part(side: str, number: int) -> Column:
        return F.format_string(f'Experiment {number}: "%s"\n- Result: %s\n- BIC improvement: %.2f\n- Feature: %s\n\n', f"{side}.hypothesis", f"{side}.result_summary", F.abs(F.coalesce(f"{side}.bic_delta", F.lit(0.0))), f"{side}.feature_layer_name")

    one = experiments.select("experiment_id", F.struct("hypothesis", "result_summary", "bic_delta", "feature_layer_name").alias("x"))
    both = pairs.join(one.toDF("a", "of_a"), "a").join(one.toDF("b", "of_b"), "b")
    text = F.concat(F.lit("These experiments both improved the world model:\n\n"), part("of_a", 1), part("of_b", 2), F.lit("Given that both of these patterns exist in the data, what new hypothesis \nwould you propose that combines or builds on these findings?"))
    return both.select(*pairs.columns, text.alias("prompt"))


def export_experiments(experiments: DataFrame) -> DataFrame:
    """Rows for a JSON sink: ``id``, pair, verdict, gain and time; a missing text is empty."""
    pairs = training_pairs(experiments).select("experiment_id", "prompt", "response")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "response")]
    return experiments.select("experiment_id", "admitted", "bic_delta", "ts").join(pairs, "experiment_id").select(F.col("experiment_id").alias("id"), *texts, "admitted", F.col("bic_delta").alias("mdl_delta"), F.col("ts").alias("timestamp"))


def experiment_stats(experiments: DataFrame) -> DataFrame:
    """One row: totals, admission rate (0 if empty), improvement of the admitted, distinct layers."""
    row = experiments.agg(
        F.count("*").alias("experiments"), F.count_if("admitted").alias("admitted"), F.coalesce(F.sum(F.when(F.col("admitted"), -F.col("bic_delta"))), F.lit(0.0)).alias("improvement"), F.count_distinct("feature_layer_name").alias("layers")
    )
    return row.withColumn("admission_rate", F.coalesce(F.try_divide("admitted", "experiments"), F.lit(0.0)))


def rewrite_record(experiments: DataFrame) -> DataFrame:
    """``experiment_id, response, as_training, as_knowledge``: the verdict behind the response, if there is a gain or loss, and where the record is kept."""
    # The line of the verdict.
    verdict = F.format_string("\n\nResult: %.4f BIC delta. %s.", "bic_delta", F.when(F.col("admitted"), "Admitted").otherwise("Not admitted"))
    verdict = F.when(F.col("bic_delta").isNull(), F.lit("")).otherwise(verdict)
    pairs = training_pairs(experiments).select("experiment_id", "response")
    good = F.coalesce(F.col("admitted") & (F.col("bic_delta") < 0), F.lit(False))
    return experiments.select("experiment_id", verdict.alias("verdict"), good.alias("as_knowledge")).join(pairs, "experiment_id").select("experiment_id", F.concat("response", "verdict").alias("response"), F.lit(True).alias("as_training"), "as_knowledge")
