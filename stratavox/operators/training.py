"""Training rows from episodes and conversations: building, checking, transforming, publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Transform = tuple[str, Callable[[DataFrame], DataFrame]]
#: Fixed value: the scope that every row has.
SCOPE = "whole_episode"


def prompt_text(messages):  # noqa: ANN001, ANN201
    """``[role]`` and content of each message, joined by blank lines; tool calls as JSON where the content is null."""
    part = lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), F.coalesce(m["content"], m["tool_calls"], F.lit("")))
    return F.array_join(F.transform(messages, part), "\n\n")


def records_to_rows(records: DataFrame) -> DataFrame:
    """``row_id, episode_id, prompt, response`` of ``episode_id, index, messages, response``."""
    return records.select(F.concat_ws(":", "episode_id", F.col("index").cast("string")).alias("row_id"), "episode_id", "index", prompt_text(F.col("messages")).alias("prompt"), "response")


def conversation_rows(turns: DataFrame, answer: str = "assistant") -> DataFrame:
    """A row for each answer of each conversation, with all turns before it as the prompt.

    ``turns`` has ``conv_id, turn, role, text``. Turns are gathered by conversation.
    """
    part = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part"), "text"))).alias("t"))
    rows = talks.select("conv_id", "t", F.posexplode("t").alias("k", "a")).where(F.col("a.role") == answer)
    prompt = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("k")), lambda x: x["part"]), "\n\n")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("a.turn").cast("string")).alias("row_id"), "conv_id", F.col("a.turn").alias("turn"), prompt.alias("prompt"), F.col("a.text").alias("response"))


def enrich_rows(episodes: DataFrame) -> DataFrame:
    """Rows of successful episodes with the episode's score: raw rows, else the prompt-response pairs."""
    pairs = F.transform("prompt_responses", lambda p, k: F.struct(F.concat_ws(":", F.col("episode_id"), k.cast("string")).alias("row_id"), p["prompt"].alias("prompt"), p["response"].alias("response"), F.lit(None).cast("string").alias("step")))
    raw = F.transform("raw_training_rows", lambda p, k: F.struct(F.coalesce(p["row_id"], F.concat_ws(":", F.col("episode_id"), k.cast("string"))).alias("row_id"), p["prompt"].alias("prompt"), p["response"].alias("response"), p["step"].alias("step")))
    rows = F.when(F.size("raw_training_rows") > 0, raw).otherwise(pairs)
    out = episodes.where("success").select("episode_id", "generation_id", "episode_index", "score", F.posexplode(rows).alias("index", "row"))
    return out.select("row.row_id", "episode_id", "generation_id", "episode_index", "index", "row.prompt", "row.response", F.coalesce("row.step", F.lit("unknown")).alias("step"), "score")


def validate_rows(rows: DataFrame, required: list[str], source_row_ids: DataFrame | None = None) -> DataFrame:
    """``row_id, rule, detail``: a row for each violation.

    Rules: ``missing_field`` of ``required``; ``bad_row_id``, a null or empty id; ``duplicate_row_id``; ``bad_scope``, an
    ``episode_score_scope`` other than ``whole_episode``; ``episode_mismatch``, an ``episode_id`` other than its group's ``group_episode_id``; ``bad_parent``,
    an empty ``parent_row_id``; ``unknown_parent``, one that is no row's id and none of ``source_row_ids (row_id)``. A null parent is none.
    """
    found = [rows.where(F.col(c).isNull()).select("row_id", F.lit("missing_field").alias("rule"), F.lit(c).alias("detail")) for c in required]
    rule = lambda test, name, detail: rows.where(test).select("row_id", F.lit(name), F.col(detail).cast("string"))
    found.append(rule(F.coalesce(F.col("row_id") == "", F.lit(True)), "bad_row_id", "row_id"))
    found.append(rows.groupBy("row_id").agg(F.count("*").alias("n")).where("row_id <> '' and n > 1").select("row_id", F.lit("duplicate_row_id"), F.col("n").cast("string")))
    found.append(rule(~F.col("episode_score_scope").eqNullSafe(SCOPE), "bad_scope", "episode_score_scope"))
    found.append(rule(~F.col("episode_id").eqNullSafe(F.col("group_episode_id")), "episode_mismatch", "episode_id"))
    if "parent_row_id" in rows.columns:
        found.append(rule(F.col("parent_row_id") == "", "bad_parent", "parent_row_id"))
        known = rows.select(F.col("row_id").alias("parent_row_id"))
        if source_row_ids is not None:
            known = known.unionAll(source_row_ids.select(F.col("row_id").alias("parent_row_id")))
        found.append(rows.where("parent_row_id <> ''").join(known.distinct(), "parent_row_id", "left_anti").select("row_id", F.lit("unknown_parent"), F.col("parent_row_id")))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def row_hash(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, h``: digest of each row's canonical JSON."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))


def transform_delta(before: DataFrame, after: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: ``rows_in, rows_out, removed, added, modified``."""
    old, new = row_hash(before, key).withColumnRenamed("h", "a"), row_hash(after, key).withColumnRenamed("h", "b")
    both = old.join(new, key, "full_outer")
    return both.agg(F.count("a").alias("rows_in"), F.count("b").alias("rows_out"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("a") != F.col("b")).alias("modified"))


def keep_workflow_steps(rows: DataFrame, steps: list[str]) -> DataFrame:
    """Rows of the listed steps; a row without step is an error."""
    known = F.when(F.col("step").isNull(), F.raise_error(F.concat(F.lit("row without step: "), F.coalesce("row_id", F.lit("null")))).cast("boolean")).otherwise(F.col("step").isin(steps))
    return rows.where(known)


def export_rows(episodes: DataFrame, transforms: list[Transform]) -> tuple[DataFrame, DataFrame]:
    """Rows after an ordered chain of transforms, in source order, and the report of each step."""
    rows = enrich_rows(episodes)
    report = None
    recipe = F.sha2(F.lit("\n".join(name for name, _ in transforms)), 256)
    for k, (name, change) in enumerate(transforms):
        after = change(rows)
        step = transform_delta(rows, after).select(F.lit(k).alias("step_no"), F.lit(name).alias("transform"), recipe.alias("recipe"), "*")
        report = step if report is None else report.unionAll(step)
        rows = after
    if report is None:
        report = transform_delta(rows, rows).select(F.lit(-1).alias("step_no"), F.lit("none").alias("transform"), recipe.alias("recipe"), "*")
    return rows.orderBy("generation_id", "episode_index", "index"), report


def publish_rows(rows: DataFrame, folder: str) -> str:
    """Writes rows as a new export and then points ``latest`` to it; an export is never overwritten.

    The content hash is that of the number of rows and of sums of four 60-bit parts of their digests, so no task meets all rows.
    """
    export = f"export-{uuid.uuid4().hex}"
    rows.write.mode("error").json(f"{folder}/exports/{export}")
    piece = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = row_hash(rows).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(piece(k)), F.lit(0)).alias(f"s{k}") for k in range(4)])
    content = sums.withColumn("content_hash", F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("rows", "s0", "s1", "s2", "s3")]), 256))
    content.select(F.lit(export).alias("export_id"), "content_hash", "rows").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")
    return export


def sft_texts(rows: DataFrame) -> DataFrame:
    """Chat pairs of successful rows that have both texts."""
    kept = rows.where("success and prompt is not null and response is not null")
    chat = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    return kept.select("row_id", chat.alias("messages"))


def training_window(exports: DataFrame, end: int, size: int) -> DataFrame:
    """The latest export of each of the ``size`` generations up to ``end``."""
    newest = Window.partitionBy("generation_id").orderBy(F.desc("created_at"), F.desc("export_id"))
    inside = exports.where(F.col("generation_id").between(max(0, end - size + 1), end))
    return inside.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def sft_rows(episodes: DataFrame) -> DataFrame:
    """Prompt-response pairs of successful episodes with episode, generation and score."""
    return episodes.where("success").select("episode_id", "generation_id", "score", F.explode("prompt_responses").alias("p")).select("episode_id", "generation_id", "score", "p.prompt", "p.response")
