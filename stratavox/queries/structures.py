"""Bodies, structural points, composition and patches over suppliers, nations and regions as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import uncertainty
from ..operators import bodies, composition, fields, patches
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()

POINTS = "p AS (SELECT n_regionkey AS g, s_nationkey AS body, s_suppkey AS i, (s_suppkey * 7919 % 1009) / 10.0 AS x, (s_suppkey * 104729 % 997) / 12.0 AS y, s_acctbal / 100 AS z FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as contacts of the body of their nation, in the graph of its region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("graph_id"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    spread = lambda a, m, d: (F.col("s_suppkey").cast("long") * a % m) / F.lit(float(d))
    return s.select("graph_id", F.col("s_nationkey").alias("body"), F.col("s_suppkey").alias("contact"), spread(7919, 1009, 10).alias("x"), spread(104729, 997, 12).alias("y"), (F.col("s_acctbal") / 100).alias("z"))


@query(
    f"WITH {POINTS}, b AS (SELECT body FROM p GROUP BY body HAVING count(*) >= 4), a AS (SELECT body, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM p SEMI JOIN b USING (body) GROUP BY body), "
    "r AS (SELECT p.g, body, ax, ay, az, greatest(max(abs(x - ax)), 1.0) AS rx, greatest(max(abs(y - ay)), 1.0) AS ry, greatest(max(abs(z - az)), 1.0) AS rz FROM p JOIN a USING (body) GROUP BY ALL), "
    "c AS (SELECT n_regionkey AS g, c_custkey AS cell, (c_custkey % 211)::DOUBLE - 40 AS x, (c_custkey % 173)::DOUBLE - 30 AS y, c_acctbal / 100 AS z FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "d AS (SELECT c.g, r.body, c.cell, c.x, c.y, c.z, (1 - sqrt(((c.x - ax) / rx) ** 2 + ((c.y - ay) / ry) ** 2 + ((c.z - az) / rz) ** 2)) * (rx + ry + rz) / 3 AS approx FROM c JOIN r ON c.g = r.g) "
    "SELECT d.g AS graph_id, d.body, d.cell, round(sign(approx) * least(abs(approx), min(sqrt((d.x - p.x) ** 2 + (d.y - p.y) ** 2 + (d.z - p.z) ** 2))), 4) + 0.0 AS distance FROM d JOIN p ON p.body = d.body GROUP BY d.g, d.body, d.cell, approx"
)
def fb3_body_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells, distances to the bodies of their region that have four contacts or more."""
    p = points(spark, sf_dir)
    p = p.join(p.groupBy("body").count().where("count >= 4"), "body", "left_semi")
    anchors = p.groupBy("graph_id", "body").agg(*[F.avg(c).alias(f"a{c}") for c in "xyz"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("graph_id"))
    cells = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    at = lambda m, d: (F.col("c_custkey") % m).cast("double") - d
    cells = cells.select("graph_id", F.col("c_custkey").alias("cell"), at(211, 40).alias("x"), at(173, 30).alias("y"), (F.col("c_acctbal") / 100).alias("z"))
    return rounded(bodies.body_distance(cells, p, anchors, 1.0))


@query(
    f"WITH {POINTS}, d AS (SELECT a.body, a.i, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM p a LEFT JOIN p b ON a.body = b.body AND a.i <> b.i GROUP BY ALL), h AS (SELECT body, median(d) / 2 AS s, count(*) AS n FROM d GROUP BY body HAVING count(*) >= 4) "
    "SELECT body AS unit, round(s, 4) AS suggested, n::BIGINT AS n, round(greatest(s / 2.0, 2.0 / nullif(s, 0)), 4) AS ratio FROM h WHERE greatest(s / 2.0, 2.0 / nullif(s, 0)) > 4"
)
def fb10_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = points(spark, sf_dir).select(F.col("body").alias("unit"), F.col("contact").alias("contact_id"), *"xyz")
    return rounded(bodies.bandwidth_check(contacts, 2.0))


@query(
    # A corner of the hull lies on a plane through three points that has all others on one side; every third nation's points are flat.
    f"WITH {POINTS}, q AS (SELECT body, i, x, y, CASE WHEN body % 3 = 0 THEN x + 2 * y ELSE z END AS z FROM p WHERE body % 7 <> 5 OR i % 4 = 0), n AS (SELECT body, count(*) AS n FROM q GROUP BY body), "
    "t AS (SELECT a.body, a.i AS ai, b.i AS bi, c.i AS ci, a.x AS ax, a.y AS ay, a.z AS az, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz "
    "FROM q a JOIN q b ON a.body = b.body AND a.i < b.i JOIN q c ON c.body = b.body AND b.i < c.i WHERE a.body % 2 = 0 AND a.body % 3 <> 0), "
    "s AS (SELECT t.body, ai, bi, ci, min(nx * (d.x - ax) + ny * (d.y - ay) + nz * (d.z - az)) AS lo, max(nx * (d.x - ax) + ny * (d.y - ay) + nz * (d.z - az)) AS hi FROM t JOIN q d ON d.body = t.body AND d.i NOT IN (ai, bi, ci) GROUP BY ALL), "
    "f AS (SELECT body, unnest([ai, bi, ci]) AS i FROM s WHERE lo >= 0 OR hi <= 0), h AS (SELECT body, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM (SELECT DISTINCT body, i FROM f) SEMI JOIN (SELECT body FROM n WHERE n >= 4) USING (body) JOIN q USING (body, i) GROUP BY body), "
    "u AS (SELECT n_nationkey AS unit, n_nationkey % 4 < 3 AS embedded, n_nationkey % 2 = 1 AS anchored, coalesce(n, 0) AS contacts, coalesce(n, 0) >= 4 AND n_nationkey % 3 <> 0 AS closed FROM nation LEFT JOIN n ON body = n_nationkey) "
    "SELECT unit, contacts::BIGINT AS contacts, closed, CASE WHEN embedded AND NOT anchored AND NOT closed THEN 'without_anchor_or_closure' WHEN embedded AND NOT anchored THEN 'anchored' WHEN embedded AND NOT closed THEN 'open' WHEN NOT embedded AND closed THEN 'closed_layer' ELSE 'ok' END AS verdict, "
    "round(CASE WHEN anchored THEN 1.0 WHEN embedded THEN h.ax END, 4) AS ax, round(CASE WHEN anchored THEN 2.0 WHEN embedded THEN h.az END, 4) AS az FROM u LEFT JOIN h ON h.body = u.unit"
)
def fb11_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units: open, closed, flat and with few contacts; with and without an anchor."""
    flat = F.when(F.col("body") % 3 == 0, F.col("x") + 2 * F.col("y")).otherwise(F.col("z"))
    contacts = points(spark, sf_dir).where("body % 7 <> 5 or contact % 4 = 0").select(F.col("body").alias("unit"), "x", "y", flat.alias("z"))
    given = F.when(F.col("n_nationkey") % 2 == 1, F.lit(1.0))
    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.when(F.col("n_nationkey") % 4 < 3, "embedded").otherwise("layer").alias("topology"), given.alias("ax"), given.alias("ay"), (2 * given).alias("az"))
    return rounded(bodies.topology_check(contacts, units).select("unit", "contacts", "closed", "verdict", "ax", "az"))


UNITS = "u AS (SELECT n_regionkey AS g, n_nationkey AS k, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS place, CASE WHEN n_regionkey % 2 = 0 THEN 0 ELSE n_nationkey % 3 END AS rank FROM nation)"


@query(
    "WITH n AS (SELECT n_regionkey AS g, n_nationkey AS k, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx FROM nation), s AS (SELECT n.*, s_suppkey AS i, s_acctbal AS b FROM supplier JOIN n ON k = s_nationkey) "
    "SELECT g AS graph_id, 'u' || unit AS unit, 'contact' AS role, 'c' || i AS node_id, round(i + 0.5, 4) AS x, round(b, 4) AS z, 0.0::DOUBLE AS val, NULL::DOUBLE AS gx, NULL::DOUBLE AS gz, 'u' || least('' || k, '' || nx) || '__u' || greatest('' || k, '' || nx) AS interface FROM (SELECT *, unnest([k, nx]) AS unit FROM s WHERE i % 2 = 0 AND nx IS NOT NULL) "
    "UNION ALL SELECT g, 'u' || k, 'orientation', 'd' || i, round(i + 0.5, 4), round(b, 4), 0.0, round(sin(radians(i % 90)) * cos(radians(i % 360)), 4) + 0.0, round(cos(radians(i % 90)), 4) + 0.0, NULL FROM s WHERE i % 2 = 1 "
    "UNION ALL SELECT g, 'u' || k, 'anchor', 'u' || k, 1.0, k::DOUBLE, 1.0, NULL, NULL, NULL FROM n WHERE k % 3 = 0"
)
def fb15_structural_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units (every third with an anchor), suppliers as contacts and orientations."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("k"), F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("next"))
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("k")).join(F.broadcast(nation), "k")
    i, b = F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")
    at = F.array(F.format_string('{"lo": %s, "hi": %s}', i, (F.col("s_suppkey") + 1).cast("string")), F.lit('{"value": 0}'), F.format_string('{"mean": %s, "std": 1}', b))
    dip = F.format_string('{"dip_mean": %s, "dip_kappa": 5, "azimuth_mean": %s, "azimuth_kappa": 5}', (F.col("s_suppkey") % 90).cast("string"), (F.col("s_suppkey") % 360).cast("string"))
    odd = F.col("s_suppkey") % 2 == 1
    points_ = s.where(odd | F.col("next").isNotNull()).select(
        "graph_id", F.when(odd, name("d", "s_suppkey")).otherwise(name("c", "s_suppkey")).alias("node_id"), F.when(odd, "orientation").otherwise("contact").alias("kind"), F.lit(None).cast("string").alias("unit_id"), F.when(~odd, F.array(name("u", "k"), name("u", "next"))).alias("between"),
        F.when(odd, name("u", "k")).alias("for_unit"), F.lit(None).cast("array<double>").alias("anchor"), at.alias("position"), F.when(odd, dip).alias("dip"),
    )
    none = F.lit(None).cast("string")
    anchor = F.when(F.col("k") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.col("k").cast("double")))
    units = nation.select("graph_id", name("u", "k").alias("node_id"), F.lit("stratigraphic_unit").alias("kind"), name("u", "k").alias("unit_id"), F.array(none).alias("between"), none.alias("for_unit"), anchor.alias("anchor"), F.array(none).alias("position"), none.alias("dip"))
    nodes = points_.unionAll(units).withColumns({"position": F.transform("position", uncertainty.parse_uncertainty), "dip": uncertainty.parse_uncertainty(F.col("dip"))})
    found = composition.structural_points(nodes)
    return rounded(found.select("graph_id", "unit", "role", "node_id", "x", "z", "val", "gx", "gz", "interface"))


PAIRS = (
    f"{UNITS}, e AS (SELECT a.g, a.k AS younger, b.k AS older, a.place * 10 + b.place AS seq, CASE WHEN a.k % 6 = 1 THEN 'softmax' WHEN a.k % 6 = 2 THEN 'erode' END AS stated, a.k % 5 = 4 AS embedded FROM u a JOIN u b ON a.g = b.g AND (b.place = 3 AND a.place < 3 OR a.place = 3 AND b.place = 4 OR a.place = 0 AND b.place = 1 AND a.g = 3)), "
    "q AS (SELECT n_regionkey AS g, n_nationkey AS younger, s_suppkey % 13 AS x, s_suppkey % 7 AS y, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 * (s_suppkey % 13) + (s_suppkey % 7) ELSE s_acctbal END AS z FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 8 <> 7), "
    "c AS (SELECT g, younger, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM q GROUP BY ALL HAVING count(*) >= 3), "
    "pl AS (SELECT g, younger, n, (xz * yy - yz * xy) / nullif(xx * yy - xy * xy, 0) AS a, (yz * xx - xz * xy) / nullif(xx * yy - xy * xy, 0) AS b, xz, yz, zz FROM c), "
    "m AS (SELECT e.g, e.younger, e.older, e.seq, coalesce(stated, CASE WHEN NOT embedded AND sqrt(greatest(zz - a * xz - b * yz, 0) / (1 + a * a + b * b)) < 0.2 THEN 'softmax' ELSE 'erode' END) AS mode, stated IS NULL AND n IS NULL AND NOT embedded AS ambiguous FROM e LEFT JOIN pl ON pl.g = e.g AND pl.younger = e.younger)"
)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    rank = F.when(F.col("n_regionkey") % 2 == 0, F.lit(0)).otherwise(F.col("n_nationkey") % 3)
    return n.select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("unit"), place.alias("place"), rank.cast("int").alias("chronology_rank"))


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upper units of a region over a fourth, that over the fifth, in region 3 also the first over the second; planes through suppliers."""
    u = _units(spark, sf_dir)
    a, b = u.select("graph_id", F.col("unit").alias("younger"), F.col("place").alias("pa")), u.select("graph_id", F.col("unit").alias("older"), F.col("place").alias("pb"))
    stated = F.when(F.col("younger") % 6 == 1, "softmax").when(F.col("younger") % 6 == 2, "erode")
    e = a.join(b, "graph_id").where("(pb = 3 and pa < 3) or (pa = 3 and pb = 4) or (pa = 0 and pb = 1 and graph_id = 3)")
    e = e.select("graph_id", "younger", "older", (F.col("pa") * 10 + F.col("pb")).cast("long").alias("edge_seq"), stated.alias("composition"), (F.col("younger") % 5 == 4).alias("embedded"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 8 <> 7")
    x, y = (F.col("s_suppkey") % 13).cast("double"), (F.col("s_suppkey") % 7).cast("double")
    contacts = s.select(F.col("s_nationkey").alias("pair"), x.alias("x"), y.alias("y"), F.when(F.col("s_nationkey") % 2 == 0, 0.5 * x + y).otherwise(F.col("s_acctbal")).alias("z"))
    contacts = contacts.join(contacts.groupBy("pair").count().where("count >= 3"), "pair", "left_semi")
    fitted = fields.fit_planes(contacts).select(F.col("pair").alias("younger"), "n", (F.col("rms") / F.sqrt(1 + F.col("a") ** 2 + F.col("b") ** 2)).alias("rms"))
    return composition.composition_modes(e, e.select("graph_id", "younger", "older").join(fitted, "younger"), 1.0)


@query(f"WITH {PAIRS} SELECT g AS graph_id, younger, older, mode, ambiguous FROM m")
def fb5_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modes(spark, sf_dir).select("graph_id", "younger", "older", "mode", "ambiguous")


@query(
    f"WITH {PAIRS}, er AS (SELECT m.*, a.rank FROM m JOIN u a ON a.k = m.younger WHERE mode = 'erode'), fam AS (SELECT g, older, count(*) AS n, count(DISTINCT rank) AS ranks, bool_or(EXISTS (SELECT 1 FROM m x JOIN er y ON y.g = x.g AND y.older = er.older AND y.younger = x.older WHERE x.g = er.g AND x.younger = er.younger)) AS ordered FROM er GROUP BY ALL), "
    "cells AS (SELECT n_regionkey AS g, c_custkey AS cell, k, place, ((c_custkey * (k + 3)) % 101) / 101.0 AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN u ON u.g = n_regionkey), "
    "sib AS (SELECT er.g, er.older, er.younger, er.rank FROM er JOIN fam ON fam.g = er.g AND fam.older = er.older WHERE n > 1 AND NOT ordered), "
    "shared AS (SELECT c.cell, sib.g, sib.older, 1 - product(1 - c.s) AS un, sum(c.s) AS total, count(*) AS n FROM cells c JOIN sib ON sib.g = c.g AND sib.younger = c.k JOIN fam ON fam.g = sib.g AND fam.older = sib.older AND ranks = 1 GROUP BY ALL), "
    "base AS (SELECT c.*, CASE WHEN sh.un IS NULL THEN c.s WHEN sh.total > 1e-9 THEN c.s / sh.total * sh.un ELSE sh.un / sh.n END AS v FROM cells c LEFT JOIN sib ON sib.g = c.g AND sib.younger = c.k LEFT JOIN shared sh ON sh.cell = c.cell AND sh.g = sib.g AND sh.older = sib.older), "
    "cut AS (SELECT cell, older AS k, 1 - un AS f FROM shared UNION ALL "
    "SELECT c.cell, er.older, 1 - c.s FROM er JOIN fam ON fam.g = er.g AND fam.older = er.older JOIN cells c ON c.g = er.g AND c.k = er.younger WHERE NOT (n > 1 AND NOT ordered AND ranks = 1) UNION ALL "
    "SELECT c.cell, b.younger, 1 - c.s FROM sib a JOIN sib b ON a.g = b.g AND a.older = b.older AND (a.rank > b.rank OR a.rank = b.rank AND a.younger < b.younger) JOIN fam ON fam.g = a.g AND fam.older = a.older AND ranks > 1 JOIN cells c ON c.g = a.g AND c.k = a.younger) "
    "SELECT b.g AS graph_id, b.cell, b.k AS unit, round(b.v * coalesce((SELECT product(f) FROM cut WHERE cut.cell = b.cell AND cut.k = b.k), 1), 6) AS exclusive FROM base b"
)
def fb6_compose_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells of their region's graph: all regions composed in one job, each by its own modes."""
    units = _units(spark, sf_dir)
    steps = composition.composition_steps(_modes(spark, sf_dir), units)
    catalogue = units.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("place", "unit"))).alias("units"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("graph_id"))
    cells = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("graph_id", F.col("c_custkey").alias("cell"))
    cells = cells.join(catalogue, "graph_id").join(steps, "graph_id", "left")
    support = F.transform("units", lambda u: (F.col("cell").cast("long") * (u["unit"] + 3) % 101) / F.lit(101.0))
    found = cells.select("graph_id", "cell", "units", composition.composed(support, F.col("steps")).alias("e"))
    return rounded(found.select("graph_id", "cell", F.posexplode("e").alias("place", "exclusive"), "units").select("graph_id", "cell", F.get("units", F.col("place"))["unit"].alias("unit"), "exclusive"), 6)


OPS = ("add_node", "remove_node", "add_edge", "update_node", "add_sample", "replace_node", "remove_edge", "replace_edge", "set_metadata", "add_edge", "remove_node", "add_node", "fly")


@query(
    f"""WITH RECURSIVE o AS (
  SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS k, s_suppkey AS seq, {list(OPS)!r}[s_suppkey % 13 + 1] AS op, s_suppkey % 13 <> 10 AS cascade,
         CASE WHEN {list(OPS)!r}[s_suppkey % 13 + 1] LIKE '%edge' THEN CASE WHEN s_suppkey % 13 = 9 THEN 'op' || s_suppkey ELSE 'e' || s_suppkey % 5 END ELSE 'n' || s_suppkey % 7 END AS id,
         CASE WHEN s_suppkey % 13 <> 3 THEN 'k' || s_suppkey % 3 END AS kind, s_suppkey % 10 / 10.0 AS p, 'n' || s_suppkey % 4 AS a, 'n' || s_suppkey % 3 AS b, CASE WHEN s_suppkey % 5 > 0 THEN 'm' || s_suppkey END AS meta
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
), st AS (
  SELECT g, 0::BIGINT AS k, list({{'id': 'n' || r, 'kind': 'base', 'p': 1.0::DOUBLE}}) AS nodes, [{{'id': 'e0', 's': 'n0', 't': 'n1'}}, {{'id': 'e1', 's': 'n1', 't': 'n2'}}] AS edges, []::BIGINT[] AS bad, 'none' AS meta
  FROM (SELECT DISTINCT n_regionkey AS g FROM nation), (SELECT range AS r FROM range(4)) GROUP BY g
  UNION ALL
  SELECT g, k,
    CASE WHEN wrong THEN nodes WHEN op IN ('add_node', 'add_sample') THEN list_append(nodes, {{'id': id, 'kind': CASE WHEN op = 'add_sample' THEN 'sample' ELSE kind END, 'p': p::DOUBLE}}) WHEN op = 'remove_node' THEN list_filter(nodes, lambda x: x.id <> id)
      WHEN op IN ('replace_node', 'update_node') THEN list_transform(nodes, lambda x: CASE WHEN x.id = id THEN {{'id': id, 'kind': CASE WHEN op = 'update_node' THEN coalesce(kind, x.kind) ELSE kind END, 'p': p::DOUBLE}} ELSE x END) ELSE nodes END,
    CASE WHEN wrong THEN edges WHEN op = 'add_edge' THEN list_append(edges, {{'id': id, 's': a, 't': b}}) WHEN op = 'remove_edge' THEN list_filter(edges, lambda x: x.id <> id) WHEN op = 'remove_node' THEN list_filter(edges, lambda x: x.s <> id AND x.t <> id)
      WHEN op = 'replace_edge' THEN list_transform(edges, lambda x: CASE WHEN x.id = id THEN {{'id': id, 's': a, 't': b}} ELSE x END) WHEN op = 'add_sample' THEN list_concat(list_filter(edges, lambda x: x.id NOT IN ('at__' || id, 'within__' || id)), [{{'id': 'at__' || id, 's': id, 't': b}}, {{'id': 'within__' || id, 's': id, 't': a}}]) ELSE edges END,
    CASE WHEN wrong THEN list_append(bad, seq) ELSE bad END, CASE WHEN op = 'set_metadata' AND NOT wrong THEN new_meta ELSE meta END
  FROM (
    SELECT st.g, o.k, st.nodes, st.edges, st.bad, st.meta, o.op, o.id, o.kind, o.p, o.a, o.b, o.seq, o.meta AS new_meta,
      CASE op WHEN 'add_node' THEN has WHEN 'add_sample' THEN has OR NOT list_contains(ids, o.a) OR NOT list_contains(ids, o.b) WHEN 'remove_node' THEN NOT has OR NOT o.cascade AND len(list_filter(st.edges, lambda x: x.s = o.id OR x.t = o.id)) > 0
        WHEN 'update_node' THEN NOT has WHEN 'replace_node' THEN NOT has WHEN 'add_edge' THEN list_contains(eids, o.id) WHEN 'remove_edge' THEN NOT list_contains(eids, o.id) WHEN 'replace_edge' THEN NOT list_contains(eids, o.id) WHEN 'set_metadata' THEN o.meta IS NULL ELSE true END AS wrong
    FROM (SELECT *, list_transform(nodes, lambda x: x.id) AS ids, list_transform(edges, lambda x: x.id) AS eids FROM st) st JOIN o ON o.g = st.g AND o.k = st.k + 1, LATERAL (SELECT list_contains(st.ids, o.id) AS has)
  )
), last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)
SELECT g AS graph_id, 'node' AS item, n.id AS id, n.kind AS a, round(n.p, 4)::VARCHAR AS b FROM (SELECT g, unnest(nodes) AS n FROM last)
UNION ALL SELECT g, 'edge', e.id, e.s, e.t FROM (SELECT g, unnest(edges) AS e FROM last)
UNION ALL SELECT g, 'conflict', unnest(bad)::VARCHAR, NULL, NULL FROM last UNION ALL SELECT g, 'metadata', meta, NULL, NULL FROM last"""
)
def gr10_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as operations on the graph of their region, all kinds of them, many in conflict."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("graph_id"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    i = F.col("s_suppkey")
    name = lambda tag, m: F.concat(F.lit(tag), (i % m).cast("string"))
    op = F.get(F.array(*map(F.lit, OPS)), (i % 13).cast("int"))
    attrs = F.lit(None).cast("map<string,string>")
    ops = s.select(
        "graph_id", i.alias("op_seq"), op.alias("op"), F.when(op.like("%edge"), F.when(i % 13 != 9, name("e", 5))).otherwise(name("n", 7)).alias("id"), F.when(i % 13 != 3, name("k", 3)).alias("kind"), (i % 10 / F.lit(10.0)).alias("p_exists"), attrs.alias("attrs"),
        name("n", 4).alias("source"), name("n", 3).alias("target"), (i % 13 != 10).alias("cascade"), F.when(i % 5 > 0, F.concat(F.lit("m"), i.cast("string"))).alias("metadata"),
    )
    graphs = nation.select("graph_id").distinct()
    nodes = graphs.select("graph_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit("n"), k.cast("string")))).alias("node_id"), F.lit("base").alias("kind"), F.lit(1.0).alias("p_exists"), attrs.alias("attrs"))
    edges = graphs.select("graph_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("graph_id", F.concat(F.lit("e"), F.col("k").cast("string")).alias("edge_id"), F.lit("base").alias("kind"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("k") + 1).cast("string")).alias("target"), F.lit(1.0).alias("p_exists"))
    n, e, meta, bad = patches.apply_patches(nodes, edges, ops, graphs.withColumn("metadata", F.lit("none")))
    none = F.lit(None).cast("string")
    row = lambda df, item, key, a, b: df.select("graph_id", F.lit(item).alias("item"), key.cast("string").alias("id"), a.alias("a"), b.alias("b"))
    out = row(n, "node", F.col("node_id"), F.col("kind"), F.round("p_exists", 4).cast("string")).unionAll(row(e, "edge", F.col("edge_id"), F.col("source"), F.col("target")))
    return out.unionAll(row(bad, "conflict", F.col("op_seq"), none, none)).unionAll(row(meta, "metadata", F.col("metadata"), none, none))
