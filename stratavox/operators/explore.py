"""Assay exploration."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def describe_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``column_name, n, mean, std, min, q25, q50, q75, max`` of each column; quantiles are exact, between two values in proportion.

    Equal values are counted, distinct ones lie sorted in ranges, and only the ranges that hold a
    wanted rank are ranked value by value, so no task holds a column.
    """
    number = lambda c: F.col(c).cast("double")
    aggregates = [F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c) for c in names for x in [number(c)]]
    whole = stored(df.agg(F.array(*aggregates).alias("all")).select(F.inline("all")), "describe-columns")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), number(c).alias("value")) for c in names]))).where("value is not null")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("times")).repartitionByRange(ranges, "column_name", "value")
    counts = stored(counts.withColumn("range", F.spark_partition_id()), "describe-values")

    places = {f"q{int(100 * q)}": (F.col("n") - 1) * q for q in (0.25, 0.5, 0.75)}
    wanted = whole.select("column_name", F.explode(F.array_distinct(F.array(*[f(x) for x in places.values() for f in (F.floor, F.ceil)]))).alias("place"))
    by_range = Window.partitionBy("column_name").orderBy("range")  # a row for each range
    sizes = counts.groupBy("column_name", "range").agg(F.sum("times").alias("size")).withColumn("start", F.sum("size").over(by_range) - F.col("size"))
    held = wanted.join(sizes, "column_name").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("size"))).select("column_name", "range", "start").distinct()
    by_value = Window.partitionBy("column_name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(F.broadcast(held), ["column_name", "range"]).withColumn("end", F.col("start") + F.sum("times").over(by_value))
    met = ranked.join(F.broadcast(wanted), "column_name").where((F.col("place") >= F.col("end") - F.col("times")) & (F.col("place") < F.col("end")))
    values = met.groupBy("column_name").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))

    at = lambda place: F.try_element_at("at", place)
    between = lambda x: F.when(F.floor(x) == F.ceil(x), at(F.floor(x))).otherwise((F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x)))
    return whole.join(values, "column_name", "left").select("column_name", "n", "mean", "std", "min", *[between(x).alias(q) for q, x in places.items()], "max")


def aggregate_by_band(df: DataFrame, depth: str, width: float, measure: str) -> DataFrame:
    """``band, n, mean_value, max_value`` of fixed-width depth bands."""
    band = F.floor(F.col(depth) / width).alias("band")
    return df.groupBy(band).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean_value"), F.max(measure).alias("max_value"))


def count_by(df: DataFrame, keys: list[str], condition: str | None = None) -> DataFrame:
    """Counts of the rows that meet the condition, highest first."""
    rows = df.where(condition) if condition else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def top_k_per_group(df: DataFrame, key: str, measure: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows with the highest measure of each key; ``ties`` order equal measures."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(measure), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """``column_a, column_b, r`` for each pair, in one pass."""
    pairs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in combinations(names, 2)]
    return df.agg(F.array(*pairs).alias("all")).select(F.inline("all"))


def flag_keyword(df: DataFrame, text: str, words: list[str], flag: str) -> DataFrame:
    """Adds ``flag``: whether the text holds any of the words, in any case; null texts don't."""
    hits = [F.contains(F.lower(F.col(text)), F.lit(w.lower())) for w in words]
    return df.withColumn(flag, F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)))


def composite_score(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Adds the weighted sum of columns; missing values count as 0."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()]))
