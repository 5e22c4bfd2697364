"""The given tables written by the library's writers to the shared folder and read back by its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import graph
from ..sources import files
from ..sources.shared import shared_path
from . import geology
from .common import registry, table

QUERIES, ORACLES, query = registry()


def _folder(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("SELECT 'balance' AS layer, (c_custkey // 10)::INT AS ix, (c_custkey // 2 % 5)::INT AS iy, (c_custkey % 2)::INT AS iz, c_acctbal AS value FROM customer")
def io2_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the cells of a grid: one layer stays, another is written and dropped."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    store = files.LayerStore(spark, _folder(spark, "layers"), Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (c.count() // 10, 5, 2)))
    cells = c.select(F.expr("int(c_custkey div 10)").alias("ix"), F.expr("int(c_custkey div 2 % 5)").alias("iy"), (k % 2).cast("int").alias("iz"), F.col("c_acctbal").alias("value"))
    store.write_layer(cells, "balance")
    store.write_layer(cells, "other")
    store.drop_layer("other")
    kept = store.list_layers().select("layer")
    return store.read_layer("balance").join(kept, "layer", "left_semi").select("layer", "ix", "iy", "iz", "value")


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_orderkey * 0.5 END, 2) AS score, (o_orderkey % 9)::INT AS llm_turns, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100)::DOUBLE END AS gpu_util_peak FROM orders")
def io8_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episode lines, odd ones with the names of older logs."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lines = o.select("o_orderkey", F.when(k % 2 == 0, F.col("o_totalprice")).alias("score"), F.when(k % 2 == 1, k * 0.5).alias("space_freed_kb"), (k % 9).alias("action_count"), F.when(k % 3 == 0, (k % 100).cast("double")).alias("peak_gpu_utilization"))
    path = _folder(spark, "episodes")
    files.write_jsonl(lines, path, ["o_orderkey"])
    read = files.read_episodes(spark, path, lines.schema)
    return read.select("o_orderkey", F.round("score", 2).alias("score"), "llm_turns", "gpu_util_peak")


@query("SELECT conv_id, turn, role, text FROM conversations")
def io10_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = _folder(spark, "lines")
    files.write_jsonl(c, path, ["conv_id", "turn"])
    return spark.read.schema(c.schema).json(path)


@query(
    "WITH s AS (SELECT n_regionkey::VARCHAR AS g, s_suppkey AS k, s_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT g AS graph_id, 's' || k AS id, CASE WHEN k % 2 = 0 THEN 'observation_point' ELSE 'stratigraphic_unit' END AS kind, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS p_exists FROM s UNION ALL SELECT g, 'e' || k, 'at', 1.0 FROM s"
)
def io9_graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as graph documents, a file each; kinds by other names and absent probabilities."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("graph_id"))
    s, k = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey")
    node = F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "Point").otherwise("UNIT").alias("kind"), F.when(k % 3 != 0, 0.5).alias("p_exists"))
    edge = F.struct(F.concat(F.lit("e"), k.cast("string")).alias("edge_id"), F.lit("AT").alias("kind"), F.concat(F.lit("s"), k.cast("string")).alias("source"), F.lit("place").alias("target"))
    docs = s.groupBy("graph_id").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    path = _folder(spark, "graphs")
    docs.withColumn("file", F.col("graph_id")).write.partitionBy("file").json(path)
    nodes, edges = files.read_graph_docs(spark, f"{path}/*/*.json")
    return nodes.select("graph_id", F.col("node_id").alias("id"), "kind", "p_exists").unionAll(edges.select("graph_id", F.col("edge_id").alias("id"), "kind", "p_exists"))


@query(
    f"WITH {geology.SUPPLIERS} SELECT graph_id, 'loc__s' || k AS id, 'location' AS kind, NULL AS target FROM s WHERE k % 20 = 0 UNION ALL SELECT graph_id, 'at__s' || k, 'at', 'loc__s' || k FROM s WHERE k % 20 = 0 UNION ALL SELECT graph_id, 'lifted', count(*)::VARCHAR, NULL FROM s WHERE k % 20 = 0 GROUP BY graph_id"
)
def gr1_lift_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a place get one if they have a position (every fourth)."""
    nodes = geology.nodes(spark, sf_dir).withColumn("position", F.when((F.col("kind") == "sample") & (F.col("node_seq") % 4 == 0), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    n, e, count = graph.lift_sample_locations(nodes, geology.edges(spark, sf_dir))
    none = F.lit(None).cast("string")
    new = n.where("node_id like 'loc__s%'").select("graph_id", F.col("node_id").alias("id"), "kind", none.alias("target"))
    new = new.unionAll(e.where("edge_id like 'at__s%'").select("graph_id", F.col("edge_id").alias("id"), "kind", "target"))
    return new.unionAll(count.select("graph_id", F.lit("lifted").alias("id"), F.col("lifted").cast("string").alias("kind"), none.alias("target")))
