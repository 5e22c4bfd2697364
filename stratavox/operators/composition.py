"""From graphs to exclusive unit supports, many graphs at once: structural points, composition modes, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uncertainty

#: Modes of composition that an edge may state.
MODES = ("erode", "softmax")


def structural_points(nodes: DataFrame) -> DataFrame:
    """``graph_id, unit, role, node_id, x, y, z, val, gx, gy, gz, polarity, interface``: one typed relation of contacts, orientations and anchors.

    ``nodes`` has parsed values in ``position`` and ``dip``, and ``kind, unit_id, between, for_unit, polarity, anchor``. A contact
    stands for each of its units that the graph has, with value 0; an orientation's gradient is the unit vector of its
    nominal dip and azimuth; an anchor has value 1. Nodes of other kinds give no points.
    """
    has = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    at = [uncertainty.nominal(F.get("position", F.lit(k))).alias(c) for k, c in enumerate("xyz")]
    units = nodes.where("kind = 'stratigraphic_unit'").select("graph_id", F.coalesce("unit_id", "node_id").alias("unit"), "node_id", has("anchor", "array<double>").alias("anchor"))
    none = [F.lit(None).cast("double").alias(c) for c in ("gx", "gy", "gz")]
    row = lambda df, role, val, grad, polarity, interface: df.select("graph_id", "unit", F.lit(role).alias("role"), "node_id", "x", "y", "z", F.lit(val).alias("val"), *grad, polarity.cast("int").alias("polarity"), interface.cast("string").alias("interface"))
    nothing = F.lit(None)

    contacts = nodes.where("kind = 'contact'").select("graph_id", "node_id", F.explode(F.array_distinct("between")).alias("unit"), *at, has("polarity", "int").alias("polarity"), F.array_join(F.array_sort("between"), "__").alias("interface"))
    contacts = contacts.join(units.select("graph_id", "unit"), ["graph_id", "unit"], "left_semi")
    dip, azimuth = F.radians("dip.dip_mean"), F.radians("dip.azimuth_mean")
    grad = [(F.sin(dip) * F.cos(azimuth)).alias("gx"), (F.sin(dip) * F.sin(azimuth)).alias("gy"), F.cos(dip).alias("gz")]
    facing = nodes.where("kind = 'orientation'").select("graph_id", "node_id", F.col("for_unit").alias("unit"), *at, *grad) if "for_unit" in nodes.columns else None
    anchors = units.where("anchor is not null").select("graph_id", "unit", "node_id", *[F.get("anchor", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    out = row(contacts, "contact", 0.0, none, F.col("polarity"), F.col("interface"))
    if facing is not None:
        out = out.unionAll(row(facing.join(units.select("graph_id", "unit"), ["graph_id", "unit"], "left_semi"), "orientation", 0.0, [F.col(c) for c in ("gx", "gy", "gz")], nothing, nothing))
    return out.unionAll(row(anchors, "anchor", 1.0, none, nothing, nothing))


def composition_modes(edges: DataFrame, planes: DataFrame, least_spacing: float) -> DataFrame:
    """``graph_id, younger, older, edge_seq, mode, ambiguous`` of each pair of ``edges (graph_id, younger, older, edge_seq, composition, embedded)``.

    A stated mode wins. Else a pair is ``softmax`` if its plane's residuals ``(graph_id, younger, older, n, rms)``, measured along the
    plane's normal, stay below a fifth of the least spacing over three contacts or more, and ``erode`` otherwise, as are pairs of
    embedded units and pairs without a plane; the latter are ambiguous. Of several edges of a pair the last one's mode counts, in the
    place of the first.
    """
    pair = ["graph_id", "younger", "older"]
    once = edges.groupBy(pair).agg(F.min("edge_seq").alias("edge_seq"), F.max_by(F.struct("composition", "embedded"), "edge_seq").alias("last"))
    joined = once.join(planes.select(*pair, "n", "rms"), pair, "left")
    stated = F.lower("last.composition").isin(*MODES)
    flat = (F.col("n") >= 3) & (F.col("rms") < 0.2 * least_spacing) & ~F.coalesce("last.embedded", F.lit(False))
    mode = F.when(stated, F.lower("last.composition")).when(flat, "softmax").otherwise("erode")
    unknown = ~F.coalesce(stated, F.lit(False)) & F.col("n").isNull() & ~F.coalesce("last.embedded", F.lit(False))
    return joined.select(*pair, "edge_seq", mode.alias("mode"), unknown.alias("ambiguous"))


def composition_steps(modes: DataFrame, units: DataFrame) -> DataFrame:
    """``graph_id, steps``: what the composition of a graph does, in order, as places of units in the catalogue.

    ``units (graph_id, unit, place, chronology_rank)``, places from 0. Several units that erode the same older one are
    siblings, unless edges order them among themselves. Siblings of one rank share the
    union of their supports, which the older one loses; of differing ranks the higher one
    erodes the older and all siblings behind it. All other pairs follow by falling rank. A
    graph's steps are one array, of the size of its own edges.
    """
    known = units.select("graph_id", "unit", "place", F.coalesce("chronology_rank", F.lit(0)).alias("rank"))
    side = lambda name: known.select("graph_id", F.col("unit").alias(name), F.col("place").alias(f"{name}_place"), F.col("rank").alias(f"{name}_rank"))
    erode = modes.where("mode = 'erode'").join(side("younger"), ["graph_id", "younger"]).join(side("older"), ["graph_id", "older"])
    group = ["graph_id", "older", "older_place"]
    member = F.struct("younger_rank", "younger", F.col("younger_place").alias("place"))
    groups = erode.groupBy(group).agg(F.min("edge_seq").alias("turn"), F.collect_list(member).alias("own"), F.count_distinct("younger_rank").alias("ranks"))
    inner = erode.select("graph_id", "older", "younger").join(modes.select("graph_id", F.col("younger").alias("upper"), F.col("older").alias("younger")), ["graph_id", "younger"])
    inner = inner.join(erode.select("graph_id", "older", F.col("younger").alias("upper")), ["graph_id", "older", "upper"], "left_semi").select("graph_id", "older").distinct().withColumn("ordered", F.lit(True))
    groups = groups.join(inner, ["graph_id", "older"], "left").withColumn("family", (F.size("own") > 1) & F.col("ordered").isNull())

    shaped = "struct<phase:int,turn:bigint,k:int,target:int,by:int,members:array<int>>"
    none = F.array().cast("array<int>")
    step = lambda phase, turn, k, target, by, members: F.struct(F.lit(phase).alias("phase"), turn.cast("long").alias("turn"), k.cast("int").alias("k"), target.cast("int").alias("target"), by.cast("int").alias("by"), members.alias("members")).cast(shaped)
    siblings = groups.where("family")
    shared = siblings.where("ranks = 1").select("graph_id", step(0, F.col("turn"), F.lit(0), F.col("older_place"), F.lit(-1), F.transform(F.array_sort("own"), lambda m: m["place"].cast("int"))).alias("step"))
    # Falling rank, then name: the order of the siblings.
    down = siblings.where("ranks > 1").withColumn("own", F.array_sort(F.transform("own", lambda m: F.struct((-m["younger_rank"]).alias("rank"), m["younger"].alias("unit"), m["place"].alias("place")))))
    targets = F.transform("own", lambda m, i: F.struct(m["place"].alias("by"), F.concat(F.array(F.col("older_place").cast("int")), F.transform(F.slice(F.col("own"), i + 2, F.greatest(F.size("own") - i - 1, F.lit(0))), lambda x: x["place"].cast("int"))).alias("to"), i.alias("i")))
    cuts = down.select("graph_id", "turn", F.explode(targets).alias("c")).select("graph_id", "turn", "c.by", "c.i", F.posexplode("c.to").alias("j", "to"))
    ranked = cuts.select("graph_id", step(0, F.col("turn"), F.col("i") * 10_000 + F.col("j"), F.col("to"), F.col("by"), none).alias("step"))
    plain = erode.join(groups.where("not family").select("graph_id", "older"), ["graph_id", "older"], "left_semi")
    by = Window.partitionBy("graph_id").orderBy(F.desc("younger_rank"), "younger", "older")
    plain = plain.withColumn("turn", F.row_number().over(by)).select("graph_id", step(1, F.col("turn"), F.lit(0), F.col("older_place"), F.col("younger_place"), none).alias("step"))
    steps = shared.unionAll(ranked).unionAll(plain)
    return steps.groupBy("graph_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))


def composed(support: Column, steps: Column) -> Column:
    """Exclusive supports of one cell: its graph's steps folded over the array of supports; null steps change nothing."""

    def run(held: Column, s: Column) -> Column:
        own = F.transform(s["members"], lambda m: F.get(support, m))
        union = 1 - F.aggregate(own, F.lit(1.0), lambda a, x: a * (1 - x))
        summed = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        part = lambda i: F.when(summed > 1e-9, F.get(support, i) / summed).otherwise(1.0 / F.size(s["members"])) * union
        cut = F.when(s["by"] >= 0, F.get(support, s["by"])).otherwise(union)
        return F.transform(held, lambda x, i: F.when(F.array_contains(s["members"], i), part(i)).when(i == s["target"], x * (1 - cut)).otherwise(x))

    return F.coalesce(F.aggregate(steps, support, run), support)
