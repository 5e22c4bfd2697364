"""Patches of graphs: ordered operations on nodes, edges and metadata, many graphs at once.

Operations of a graph apply in the order of ``op_seq``. Each node and each edge has a state
of its own: its operations are folded in order, and what the fold leaves is its content and
the spans of operations in which it exists. Nodes act on edges through the ends of their
spans, which cut incident edges. Only two kinds of operation look at other elements:
removals without cascade and new samples. They are tried as valid, checked against the
spans, and the folds repeated until no answer changes; an answer depends on earlier
operations alone, so that ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Operations on nodes and on edges.
NODE_OPS = ("add_node", "replace_node", "update_node", "remove_node", "add_sample")
EDGE_OPS = ("add_edge", "replace_edge", "remove_edge")
START, END = -1, 2**62


def _fold(events: Column, state: Column, payload: tuple[str, ...], bad, leaves) -> Column:  # noqa: ANN001
    """State after the events: ``alive, since, conflicts, spans`` and the payload; ``bad`` and ``leaves`` tell invalid and ending events."""

    def step(a: Column, e: Column) -> Column:
        wrong = F.coalesce(bad(a, e), F.lit(True))
        ends = ~wrong & leaves(a, e)
        starts = ~wrong & ~a["alive"]
        whole = e["op"].isin("add_node", "replace_node", "add_sample", "add_edge", "replace_edge")
        value = lambda c: F.when(wrong | ends | (e["op"] == "cut"), a[c]).when(whole, e[c]).otherwise(F.coalesce(e[c], a[c])).alias(c)
        # A replaced edge may have other ends, so its span ends and another begins.
        turns = ends | (~wrong & (e["op"] == "replace_edge"))
        span = F.struct(a["since"].alias("lo"), e["op_seq"].alias("hi"), *[a[c].alias(c) for c in ("source", "target") if c in payload])
        return F.struct(
            (F.when(ends, F.lit(False)).when(starts, F.lit(True)).otherwise(a["alive"])).alias("alive"), F.when(starts | turns, e["op_seq"]).otherwise(a["since"]).alias("since"),
            F.when(wrong & (e["op"] != "cut"), F.array_append(a["conflicts"], e["op_seq"])).otherwise(a["conflicts"]).alias("conflicts"), F.when(turns, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"), *[value(c) for c in payload],
        )

    return F.aggregate(events, state, step)


def _folded(base: DataFrame, events: DataFrame, name: str, payload: tuple[str, ...], bad, leaves) -> DataFrame:  # noqa: ANN001
    """``graph_id, <name>, s`` of every element that the graph has or an event names."""
    key = ["graph_id", name]
    kinds = dict(base.dtypes)
    ends = ", source: string, target: string" if "source" in payload else ""
    spans = f"array<struct<lo: bigint, hi: bigint{ends}>>"
    lists = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("op_seq", "op", "ok", "node", *payload)), lambda a, b: F.signum(a["op_seq"] - b["op_seq"]).cast("int")).alias("events"))
    joined = base.select(*key, *payload, F.lit(True).alias("alive")).join(lists, key, "full_outer")
    state = F.struct(
        F.coalesce("alive", F.lit(False)).alias("alive"), F.lit(START).cast("long").alias("since"), F.array().cast("array<bigint>").alias("conflicts"), F.array().cast(spans).alias("spans"), *[F.col(c).cast(kinds[c]).alias(c) for c in payload]
    )
    return joined.select(*key, F.coalesce(_fold(F.col("events"), state, payload, bad, leaves), state).alias("s"))


def _spans(folded: DataFrame, *names: str) -> DataFrame:
    """Spans of operations between which each element exists; the last ones are open."""
    open_ = F.when(F.col("s.alive"), F.array(F.struct(F.col("s.since").alias("lo"), F.lit(END).cast("long").alias("hi"), *[F.col(f"s.{c}").alias(c) for c in ("source", "target") if c in names])))
    kept = [c for c in names if c not in ("source", "target")]
    return folded.select("graph_id", *kept, F.explode(F.concat("s.spans", F.coalesce(open_, F.slice("s.spans", 1, 0)))).alias("x")).select("graph_id", *kept, "x.*")


def apply_patches(nodes: DataFrame, edges: DataFrame, ops: DataFrame, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and metadata after the operations, and ``graph_id, op_seq, op`` of those in conflict, which change nothing.

    ``nodes (graph_id, node_id, kind, p_exists, attrs)``, ``edges (graph_id, edge_id, kind, source, target, p_exists)``,
    ``ops (graph_id, op_seq, op, id, kind, p_exists, attrs, source, target, cascade, metadata)``, ``op_seq`` from 0 and unique in a graph.

    Conflicts: an add of an id that exists then; a change or removal of one that doesn't; a
    removal with ``cascade`` false of a node that has edges then; a sample (``source``: its unit, ``target``: its place) whose
    unit or place doesn't exist then; metadata that is null; an unknown operation. ``update_node`` keeps what it leaves
    null, ``replace_*`` does not. A removed node takes its edges along at that operation, and only those that
    it has then. Edges may be added before their ends. An edge without id gets ``op<op_seq>``; a sample's edges are
    ``at__<id>`` and ``within__<id>``.
    """
    ops = stored(ops.withColumn("op_seq", F.col("op_seq").cast("long")), "patch-ops")
    null = lambda kind: F.lit(None).cast(kind)
    looks = ((F.col("op") == "remove_node") & ~F.coalesce("cascade", F.lit(True))) | (F.col("op") == "add_sample")
    asked = ops.where(looks).select("graph_id", "op_seq", "op", "id", F.col("source").alias("unit"), F.col("target").alias("place"))
    answers = stored(asked.select("graph_id", "op_seq", F.lit(True).alias("ok")), "patch-answers")
    for _ in range(asked.count() + 1):
        told = ops.join(answers, ["graph_id", "op_seq"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
        own = told.where(F.col("op").isin(*NODE_OPS)).select("graph_id", F.col("id").alias("node_id"), "op_seq", "op", "ok", null("string").alias("node"), F.when(F.col("op") == "add_sample", "sample").otherwise(F.col("kind")).alias("kind"), "p_exists", "attrs")
        wrong = lambda a, e: F.when(e["op"].isin("add_node", "add_sample"), a["alive"] | ~e["ok"]).otherwise(~a["alive"] | ~e["ok"])
        node = stored(_folded(nodes, own, "node_id", ("kind", "p_exists", "attrs"), wrong, lambda a, e: e["op"] == "remove_node"), "patch-nodes")
        alive = _spans(node, "node_id")

        direct = told.where(F.col("op").isin(*EDGE_OPS)).select("graph_id", F.coalesce("id", F.concat(F.lit("op"), "op_seq")).alias("edge_id"), "op_seq", "op", "ok", null("string").alias("node"), "kind", "source", "target", "p_exists")
        made = told.where("op = 'add_sample'").join(node.select("graph_id", F.col("node_id").alias("id"), F.explode("s.conflicts").alias("op_seq")), ["graph_id", "id", "op_seq"], "left_anti")
        links = F.explode(F.array(F.struct(F.lit("at").alias("kind"), F.col("target").alias("to")), F.struct(F.lit("within").alias("kind"), F.col("source").alias("to"))))
        made = made.select("graph_id", "op_seq", "ok", "id", links.alias("x")).select("graph_id", F.concat("x.kind", F.lit("__"), "id").alias("edge_id"), "op_seq", F.lit("add_edge").alias("op"), "ok", null("string").alias("node"), F.col("x.kind").alias("kind"), F.col("id").alias("source"), F.col("x.to").alias("target"), F.lit(1.0).alias("p_exists"))
        changes = direct.unionAll(made)
        ever = edges.select("graph_id", "edge_id", "source", "target").unionAll(changes.where("source is not null or target is not null").select("graph_id", "edge_id", "source", "target"))
        ever = ever.select("graph_id", "edge_id", F.explode(F.array("source", "target")).alias("node")).distinct()
        removed = alive.where(F.col("hi") < END).select("graph_id", F.col("node_id").alias("node"), F.col("hi").alias("op_seq"))
        cuts = ever.join(removed, ["graph_id", "node"]).select("graph_id", "edge_id", "op_seq", F.lit("cut").alias("op"), F.lit(True).alias("ok"), "node", *[null("string").alias(c) for c in ("kind", "source", "target")], null("double").alias("p_exists"))
        meets = lambda a, e: a["alive"] & ((a["source"] == e["node"]) | (a["target"] == e["node"]))
        wrong = lambda a, e: F.when(e["op"] == "cut", ~meets(a, e)).when(e["op"] == "add_edge", a["alive"]).otherwise(~a["alive"])
        edge = stored(_folded(edges, changes.unionAll(cuts), "edge_id", ("kind", "source", "target", "p_exists"), wrong, lambda a, e: e["op"].isin("cut", "remove_edge")), "patch-edges")

        ends = _spans(edge, "edge_id", "source", "target").select("graph_id", "lo", "hi", F.explode(F.array("source", "target")).alias("id"))
        busy = asked.where("op = 'remove_node'").join(ends, ["graph_id", "id"]).where("lo < op_seq and op_seq <= hi").select("graph_id", "op_seq")
        needed = asked.where("op = 'add_sample'").select("graph_id", "op_seq", F.explode(F.array("unit", "place")).alias("node_id"))
        there = needed.join(alive, ["graph_id", "node_id"]).where("lo < op_seq and op_seq < hi").select("graph_id", "op_seq", "node_id")
        lacking = needed.join(there, ["graph_id", "op_seq", "node_id"], "left_anti").select("graph_id", "op_seq")
        no = busy.unionAll(lacking).distinct().withColumn("no", F.lit(True))
        now = stored(asked.select("graph_id", "op_seq").join(no, ["graph_id", "op_seq"], "left").select("graph_id", "op_seq", F.col("no").isNull().alias("ok")), "patch-answers")
        same = now.exceptAll(answers).isEmpty()
        answers = now
        if same:
            break
    content = lambda df, name, payload: df.where("s.alive").select("graph_id", name, *[F.col(f"s.{c}").alias(c) for c in payload])
    listed = node.select("graph_id", F.explode("s.conflicts").alias("op_seq")).unionAll(edge.select("graph_id", F.explode("s.conflicts").alias("op_seq"))).distinct()
    other = ops.where((~F.col("op").isin(*NODE_OPS, *EDGE_OPS, "set_metadata")) | ((F.col("op") == "set_metadata") & F.col("metadata").isNull())).select("graph_id", "op_seq")
    conflicts = ops.select("graph_id", "op_seq", "op").join(listed.unionAll(other), ["graph_id", "op_seq"], "left_semi")
    given = ops.where("op = 'set_metadata' and metadata is not null").groupBy("graph_id").agg(F.max_by("metadata", "op_seq").alias("metadata"))
    if metadata is not None:
        given = metadata.select("graph_id", F.col("metadata").alias("old")).join(given, "graph_id", "full_outer").select("graph_id", F.coalesce("metadata", "old").alias("metadata"))
    return content(node, "node_id", ("kind", "p_exists", "attrs")), content(edge, "edge_id", ("kind", "source", "target", "p_exists")), given, conflicts
