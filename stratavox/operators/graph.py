"""Geology graphs as node and edge tables, many graphs at once.

``nodes (graph_id, node_id, node_seq, kind, ...)``, ``edges (graph_id, edge_id, edge_seq,
kind, source, target, ...)``.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Other names of node kinds.
KIND_ALIASES = {"unit": "stratigraphic_unit", "observation": "observation_point", "point": "observation_point"}


def folded_kind(kind):  # noqa: ANN001, ANN201
    """A kind's own name, for any case and alias."""
    known = F.create_map(*[F.lit(x) for pair in KIND_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(kind)), F.lower(kind))


def lift_sample_locations(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges with a location for each sample that has a position and no ``at`` edge; and the count by graph."""
    at = edges.where("kind = 'at'").select("graph_id", F.col("source").alias("node_id")).distinct()
    loose = nodes.where("kind = 'sample' and position is not null").join(at, ["graph_id", "node_id"], "left_anti")
    made_nodes = loose.select("graph_id", F.concat(F.lit("loc__"), "node_id").alias("node_id"), "node_seq", F.lit("location").alias("kind"), "position", F.lit(1.0).alias("p_exists"))
    made_edges = loose.select("graph_id", F.concat(F.lit("at__"), "node_id").alias("edge_id"), F.col("node_seq").alias("edge_seq"), F.lit("at").alias("kind"), F.col("node_id").alias("source"), F.concat(F.lit("loc__"), "node_id").alias("target"), F.lit(1.0).alias("p_exists"))
    return nodes.unionByName(made_nodes, allowMissingColumns=True), edges.unionByName(made_edges, allowMissingColumns=True), loose.groupBy("graph_id").agg(F.count("*").alias("lifted"))


def validate_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, rule, item``: a row for each violation of the eight rules."""
    key = ["graph_id", "node_id"]
    ids = nodes.select(*key, F.col("kind").alias("node_kind")).dropDuplicates(key)
    units = nodes.where("kind = 'stratigraphic_unit'").select("graph_id", F.coalesce("unit_id", "node_id").alias("unit"))
    violation = lambda df, rule, item: df.select("graph_id", F.lit(rule).alias("rule"), F.col(item).alias("item"))
    found = [violation(units.groupBy("graph_id", "unit").count().where("count > 1"), "duplicate_unit_id", "unit")]
    ends = edges.select("graph_id", "edge_id", F.explode(F.array("source", "target")).alias("node_id"))
    found.append(violation(ends.join(ids, key, "left_anti").select("graph_id", "edge_id").distinct(), "missing_endpoint", "edge_id"))
    contact = nodes.where("kind = 'contact'").select("graph_id", "node_id", F.explode("between").alias("unit"))
    found.append(violation(contact.join(units.distinct(), ["graph_id", "unit"], "left_anti").select("graph_id", "node_id").distinct(), "contact_unit_missing", "node_id"))
    fault = nodes.where("kind = 'fault'").select("graph_id", F.col("node_id").alias("fault"), F.explode("surface_points").alias("node_id"))
    found.append(violation(fault.join(ids.where("node_kind = 'contact'"), key, "left_anti").select("graph_id", "fault").distinct(), "fault_point_missing", "fault"))
    typed = edges.join(ids.select("graph_id", F.col("node_id").alias("source"), F.col("node_kind").alias("source_kind")), ["graph_id", "source"]).join(ids.select("graph_id", F.col("node_id").alias("target"), F.col("node_kind").alias("target_kind")), ["graph_id", "target"])
    found.append(violation(typed.where("kind = 'within' and not (source_kind = 'sample' and target_kind = 'stratigraphic_unit')"), "within_types", "edge_id"))
    found.append(violation(typed.where("kind = 'at' and not (source_kind = 'sample' and target_kind = 'location')"), "at_types", "edge_id"))
    at = edges.where("kind = 'at'").groupBy("graph_id", F.col("source").alias("node_id")).agg(F.count("*").alias("n"))
    found.append(violation(nodes.where("kind = 'sample'").select(*key).join(at, key, "left").where("coalesce(n, 0) <> 1"), "sample_needs_one_at", "node_id"))
    series = edges.where("kind = 'member_of_series'").groupBy("graph_id", "source").agg(F.count_distinct("target").alias("n")).where("n > 1")
    found.append(violation(series, "unit_in_several_series", "source"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def overlies_cycles(edges: DataFrame, checkpoint_every: int = 5, most_rounds: int = 10_000) -> DataFrame:
    """``graph_id, node``: nodes on or between cycles of ``overlies`` (a self-loop is a cycle).

    Nodes without incoming or without outgoing edges are peeled off until none is left to
    peel; what stays lies on cycles or on paths between them. Each round is one
    anti-join of the edges that are left.
    """
    left = edges.where("kind = 'overlies'").select("graph_id", "source", "target").distinct()
    count = left.count()
    for turn in range(most_rounds):
        nodes_in = left.select("graph_id", F.col("target").alias("source")).distinct()
        nodes_out = left.select("graph_id", F.col("source").alias("target")).distinct()
        left = left.join(nodes_in, ["graph_id", "source"], "left_semi").join(nodes_out, ["graph_id", "target"], "left_semi")
        left = left.checkpoint() if turn % checkpoint_every == checkpoint_every - 1 and left.sparkSession.sparkContext.getCheckpointDir() else left.cache()
        now = left.count()
        if now == count:
            break
        count = now
    return left.select("graph_id", F.explode(F.array("source", "target")).alias("node")).distinct()


def stratigraphic_order(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, unit, rank``: from the top down, of free units the smallest (chronology_rank, unit) first; no rank is 0.

    ``units (graph_id, unit, chronology_rank, unit_seq)``. Without edges the catalogue's order
    stays. A graph with a cycle has no order and gives no rows. One graph's units are one group.
    """
    over = edges.where("kind = 'overlies'").groupBy("graph_id").agg(F.collect_list(F.struct("source", "target")).alias("pairs"))
    rows = units.groupBy("graph_id").agg(F.collect_list(F.struct("unit", "chronology_rank", "unit_seq")).alias("units")).join(over, "graph_id", "left")

    @F.pandas_udf("array<string>")
    def order(units: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for own, links in zip(units, pairs, strict=True):
            rank = {u["unit"]: (u["chronology_rank"] if u["chronology_rank"] is not None else 0, u["unit"]) for u in own}
            if links is None or not len(links):
                out.append([u["unit"] for u in sorted(own, key=lambda u: u["unit_seq"])])
                continue
            above, below = dict.fromkeys(rank, 0), {u: [] for u in rank}
            for x in {(x["source"], x["target"]) for x in links}:
                if x[0] in rank and x[1] in rank:
                    below[x[0]].append(x[1])
                    above[x[1]] += 1
            free = [rank[u] for u, n in above.items() if not n]
            heapq.heapify(free)
            made = []
            while free:
                u = heapq.heappop(free)[1]
                made.append(u)
                for v in below[u]:
                    above[v] -= 1
                    if not above[v]:
                        heapq.heappush(free, rank[v])
            out.append(made if len(made) == len(rank) else [])
        return pd.Series(out, dtype=object)

    return rows.select("graph_id", F.posexplode(order("units", "pairs")).alias("rank", "unit")).select("graph_id", "unit", "rank")


def query_nodes(nodes: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes of a kind in document order, up to ``limit`` a graph, with ``truncated``."""
    rows = nodes if kind is None else nodes.where(F.col("kind") == folded_kind(F.lit(kind)))
    w = Window.partitionBy("graph_id")
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy("node_seq")), "total": F.count("*").over(w)})
    rows = rows if limit is None else rows.where(F.col("rank") <= limit)
    return rows.withColumn("truncated", F.col("total") > (F.lit(limit) if limit is not None else F.col("total"))).drop("total")


def subgraph(edges: DataFrame, seeds: DataFrame, radius: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``radius`` undirected steps of ``seeds (graph_id, node_id)`` with their depth, and the edges among them."""
    links = edges.select("graph_id", F.col("source").alias("a"), F.col("target").alias("b"))
    links = links.unionAll(links.select("graph_id", "b", "a")).distinct()
    reached = seeds.select("graph_id", "node_id").distinct().withColumn("depth", F.lit(0))
    front = reached
    for depth in range(1, radius + 1):
        step = front.select("graph_id", F.col("node_id").alias("a")).join(links, ["graph_id", "a"]).select("graph_id", F.col("b").alias("node_id")).distinct()
        front = step.join(reached, ["graph_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionAll(front)
    if limit is not None:
        order = Window.partitionBy("graph_id").orderBy("depth", "node_id")
        reached = reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")
    ids = reached.select("graph_id", "node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
    return reached, inside


def graph_diff(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> DataFrame:
    """``item, key, change``: nodes added, removed and changed, edges added and removed."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select("node_id", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in ("graph_id", "node_seq")))), 256).alias(name))

    n = digest(nodes_a, "a").join(digest(nodes_b, "b"), "node_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    key = lambda df, name: df.select(F.coalesce("edge_id", F.concat_ws("|", "kind", "source", "target")).alias("key"), F.lit(1).alias(name)).distinct()
    e = key(edges_a, "a").join(key(edges_b, "b"), "key", "full_outer")
    nodes = n.select(F.lit("node").alias("item"), F.col("node_id").alias("key"), change.alias("change"))
    links = e.select(F.lit("edge").alias("item"), "key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").alias("change"))
    return nodes.unionAll(links).where("change is not null")


def samples_for_unit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, unit, sample`` along ``within`` edges."""
    within = edges.where("kind = 'within'").select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("unit"))
    return within.join(nodes.where("kind = 'sample'").select("graph_id", "node_id"), ["graph_id", "node_id"]).select("graph_id", "unit", F.col("node_id").alias("sample"))


def samples_at(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, location, sample`` along ``at`` edges; also each sample's location."""
    at = edges.where("kind = 'at'").select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("location"))
    return at.join(nodes.where("kind = 'sample'").select("graph_id", "node_id"), ["graph_id", "node_id"]).select("graph_id", "location", F.col("node_id").alias("sample"))


def provenance_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node_id", "provenance", "metadata")


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, digest`` of content, whatever the order of the rows: of the sums of four 60-bit parts of the rows' digests.

    Sums meet before the shuffle, so a graph of any size is one row of sums. Repeated rows count each.
    """
    part = lambda df, tag: df.select("graph_id", F.sha2(F.concat(F.lit(tag), F.to_json(F.struct(*sorted(c for c in df.columns if c != "graph_id")))), 256).alias("h"))
    rows = part(nodes, "n").unionAll(part(edges, "e"))
    piece = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy("graph_id").agg(F.count("*").alias("n"), *[F.sum(piece(k)).alias(f"s{k}") for k in range(4)])
    return sums.select("graph_id", F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256).alias("digest"))


def stratigraphic_constrain(contacts: DataFrame, order: DataFrame) -> DataFrame:
    """``graph_id, feasible``: mean contact heights of neighbouring units fall strictly from the top down.

    ``contacts (graph_id, upper, lower, z)``; neighbours without contacts are skipped.
    """
    means = contacts.groupBy("graph_id", "upper", "lower").agg(F.avg("z").alias("z"))
    a, b = order.select("graph_id", F.col("unit").alias("upper"), F.col("rank")), order.select("graph_id", F.col("unit").alias("lower"), (F.col("rank") - 1).alias("rank"))
    pairs = a.join(b, ["graph_id", "rank"]).join(means, ["graph_id", "upper", "lower"])
    before = F.lag("z").over(Window.partitionBy("graph_id").orderBy("rank"))
    falls = pairs.withColumn("ok", F.coalesce(F.col("z") < before, F.lit(True))).groupBy("graph_id").agg(F.bool_and("ok").alias("ok"))
    return order.select("graph_id").distinct().join(falls, "graph_id", "left").select("graph_id", F.coalesce("ok", F.lit(True)).alias("feasible"))
