"""Table access and registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, since sums in another order differ in the last digits; no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return add

    return queries, oracles, query


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
