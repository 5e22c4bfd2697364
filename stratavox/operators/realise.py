"""Realisations of uncertain graphs, and ensembles of feasible ones.

``nodes (graph_id, node_id, kind, unit_id, between, surface_points, position, value,
p_exists, ...)`` with parsed uncertain values in ``position`` (an array) and ``value``;
``edges (graph_id, edge_id, edge_seq, kind, source, target, p_exists)``. All realisations
of all graphs go through the same joins at once. Every draw is a function of the seed, the
graph, the realisation and the element, so it survives retries and new partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws, uncertainty
from ..sources.shared import stored
from . import graph

RUN = ["graph_id", "realisation"]
NODE = [*RUN, "node_id"]
#: The last part of the keys of a node's draws.
PLACES = ("position0", "position1", "position2", "value")


def drawn_values(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``numbers``: a draw for each axis of ``position`` and one of ``value``.

    Closed inverses are drawn in place; only nodes with a truncated normal or beta value
    are taken apart for the Arrow helper and joined back.
    """
    place = F.array(*map(F.lit, PLACES))
    values = F.array(*[F.get("position", F.lit(k)) for k in range(3)], "value")
    rows = rows.withColumns({"values": values, "numbers": F.transform(values, lambda u, k: uncertainty.sample_number(u, seed, *NODE, F.get(place, k)))})
    rare = rows.where(F.exists("values", lambda u: F.coalesce(u["name"].isin("truncnorm", "beta"), F.lit(False)))).select(*NODE, F.posexplode("values").alias("k", "u"))
    rare = rare.select(*NODE, "k", uncertainty.sample(F.col("u"), seed, *NODE, F.get(place, F.col("k")))["number"].alias("x"))
    rare = rare.groupBy(NODE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("rare"))
    return rows.drop("values").join(rare, NODE, "left").withColumn("numbers", F.coalesce("rare", "numbers")).drop("rare")


def realise(nodes: DataFrame, edges: DataFrame, attempts: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each of ``attempts (graph_id, realisation)``, with ``point`` (drawn position) and ``number`` (drawn value).

    An element is drawn if its number is at most ``p_exists`` (null: 1). Then go, in this
    order: whatever has an ``at`` edge to an absent place; contacts of an absent unit;
    faults with under three of their points (others keep the points left); edges without
    an end or not drawn themselves; samples left without an ``at`` edge. A sample takes
    the position of its place. An edge of a sample that goes last stays: such a realisation
    is infeasible.
    """
    exists = lambda kind, name: draws.uniform(seed, *RUN, F.lit(kind), name) <= F.coalesce("p_exists", F.lit(1.0))
    all_nodes = nodes.join(attempts, "graph_id").withColumn("drawn", exists("node", "node_id"))
    all_nodes = drawn_values(all_nodes, seed)
    placed = F.col("kind").isin("contact", "orientation", "location") & F.col("position").isNotNull()
    all_nodes = stored(all_nodes.withColumns({"point": F.when(placed, F.slice("numbers", 1, 3)), "number": F.when(F.col("kind") == "sample", F.get("numbers", F.lit(3)))}).drop("numbers"), "realised-nodes")
    links = edges.join(attempts, "graph_id").withColumn("drawn", exists("edge", "edge_id"))
    alive = all_nodes.where("drawn").drop("drawn")

    ids = alive.select(NODE)
    at = links.where("kind = 'at'").select(*RUN, F.col("source").alias("node_id"), "target")
    homeless = at.join(ids.withColumnRenamed("node_id", "target"), [*RUN, "target"], "left_anti").select(NODE)
    absent = all_nodes.where("kind = 'stratigraphic_unit' and not drawn").select(*RUN, F.coalesce("unit_id", "node_id").alias("unit"))
    cut = alive.where("kind = 'contact'").select(*NODE, F.explode("between").alias("unit")).join(absent, [*RUN, "unit"], "left_semi").select(NODE)
    alive = stored(alive.join(homeless.unionAll(cut), NODE, "left_anti"), "realised-left")

    points = alive.where("kind = 'fault'").select(*RUN, F.col("node_id").alias("fault"), F.posexplode("surface_points").alias("place", "node_id"))
    points = points.join(alive.select(NODE), NODE, "left_semi").groupBy(*RUN, F.col("fault").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]).alias("left"))
    alive = alive.join(points, NODE, "left").where("kind <> 'fault' or size(left) >= 3")
    alive = alive.withColumn("surface_points", F.when(F.col("kind") == "fault", F.col("left")).otherwise(F.col("surface_points"))).drop("left")

    ids = alive.select(NODE)
    kept = links.where("drawn").drop("drawn")
    for end in ("source", "target"):
        kept = kept.join(ids.withColumnRenamed("node_id", end), [*RUN, end], "left_semi")
    kept = stored(kept, "realised-edges")
    place = kept.where("kind = 'at'").groupBy(*RUN, F.col("source").alias("node_id")).agg(F.max_by("target", F.struct("edge_seq", "edge_id")).alias("place"))
    alive = alive.join(place, NODE, "left").where("kind <> 'sample' or place is not null")
    located = all_nodes.where("kind = 'location'").select(*RUN, F.col("node_id").alias("place"), F.col("point").alias("place_point"))
    alive = alive.join(located, [*RUN, "place"], "left").withColumn("point", F.when(F.col("kind") == "sample", F.col("place_point")).otherwise(F.col("point")))
    return stored(alive.drop("place", "place_point"), "realised"), kept


def feasible(nodes: DataFrame, edges: DataFrame, attempts: DataFrame) -> DataFrame:
    """``graph_id, realisation, feasible``: valid by the rules of graphs, units in an order, and layers that do not cross."""
    one = lambda df: df.withColumn("graph_id", F.struct(*RUN)).drop("realisation")
    n, e = one(nodes), one(edges)
    invalid = graph.validate_graphs(n, e).select("graph_id").distinct()
    key = lambda name: n.where("kind = 'stratigraphic_unit'").select("graph_id", F.col("node_id").alias(name), F.coalesce("unit_id", "node_id").alias(f"{name}_unit"))
    over = e.where("kind = 'overlies'").join(key("source"), ["graph_id", "source"]).join(key("target"), ["graph_id", "target"])
    over = over.select("graph_id", "kind", F.col("source_unit").alias("source"), F.col("target_unit").alias("target"))
    has = lambda name, default: F.col(name) if name in n.columns else F.lit(default)
    units = n.where("kind = 'stratigraphic_unit'").select("graph_id", F.coalesce("unit_id", "node_id").alias("unit"), has("chronology_rank", 0).cast("int").alias("chronology_rank"), "node_seq", F.coalesce(has("topology", "layer"), F.lit("layer")).alias("topology"))
    order = graph.stratigraphic_order(units.withColumnRenamed("node_seq", "unit_seq"), over)
    layers = order.join(units.where("topology = 'layer'").select("graph_id", "unit"), ["graph_id", "unit"])
    layers = layers.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy("rank")))
    z = n.where("kind = 'contact' and point is not null").select("graph_id", F.get("between", F.lit(0)).alias("a"), F.get("between", F.lit(1)).alias("b"), F.get("point", F.lit(2)).alias("z"))
    both = z.select("graph_id", F.col("a").alias("upper"), F.col("b").alias("lower"), "z").unionAll(z.select("graph_id", F.col("b").alias("upper"), F.col("a").alias("lower"), "z"))
    falls = graph.stratigraphic_constrain(both, layers).where("not feasible").select("graph_id")
    unordered = units.select("graph_id").distinct().join(order.select("graph_id").distinct(), "graph_id", "left_anti")
    bad = invalid.unionAll(falls).unionAll(unordered).distinct().select("graph_id.*").withColumn("feasible", F.lit(False))
    return attempts.join(bad, RUN, "left").withColumn("feasible", F.coalesce("feasible", F.lit(True)))


def ensemble(nodes: DataFrame, edges: DataFrame, n: int, seed: int, budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the first ``n`` feasible realisations of each graph, and ``graph_id, accepted, rejected``.

    Attempts are numbered from 0 and end at ``budget`` (twice ``n``). A wave makes, for each
    graph, as many as are still missing, so no attempt behind the n-th feasible one is ever
    made, and rejections are those before it. Graphs that are short of feasible attempts
    keep what they have.
    """
    budget = 2 * n if budget is None else budget
    state = stored(nodes.select("graph_id").distinct().select("graph_id", F.lit(0).alias("accepted"), F.lit(0).alias("tried")), "ensemble")
    found: list[tuple[DataFrame, DataFrame]] = []
    while True:
        missing = F.least(F.lit(n) - F.col("accepted"), F.lit(budget) - F.col("tried"))
        attempts = state.where(missing > 0).select("graph_id", F.explode(F.sequence(F.col("tried"), F.col("tried") + missing - 1)).alias("realisation"))
        if attempts.isEmpty():
            break
        wave = realise(nodes, edges, attempts, seed)
        verdict = stored(feasible(*wave, attempts), "ensemble-verdict")
        good = verdict.where("feasible").select(RUN)
        found.append((wave[0].join(good, RUN, "left_semi"), wave[1].join(good, RUN, "left_semi")))
        counts = verdict.groupBy("graph_id").agg(F.count_if("feasible").cast("int").alias("more"), F.count("*").cast("int").alias("made"))
        state = state.join(counts, "graph_id", "left").fillna(0, ["more", "made"])
        state = stored(state.select("graph_id", (F.col("accepted") + F.col("more")).alias("accepted"), (F.col("tried") + F.col("made")).alias("tried")), "ensemble")
    report = state.select("graph_id", "accepted", (F.col("tried") - F.col("accepted")).alias("rejected"))
    if not found:
        none = nodes.withColumn("realisation", F.lit(0)).where("false")
        return none, edges.withColumn("realisation", F.lit(0)).where("false"), report
    out = found[0]
    for more in found[1:]:
        out = out[0].unionByName(more[0]), out[1].unionByName(more[1])
    return *out, report
