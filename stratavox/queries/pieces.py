"""Single formulas and graph steps over the given tables: parts of field construction, ordering, values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import uncertainty
from ..grid import Grid
from ..operators import fields, graph, scoring, spatial, training
from . import geology
from .common import registry, rounded, table
from .rows import ROWS, rows

QUERIES, ORACLES, query = registry()


@query("SELECT c_custkey, round(c_acctbal / (111320 * cos(radians(c_nationkey * 3))), 6) AS lon, round(c_acctbal / 111320, 6) AS lat FROM customer")
def sp4_metres_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = spatial.metres_to_degrees(F.col("c_acctbal"), F.col("c_nationkey") * 3)
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat")), 6)


@query(f"WITH {geology.F0} SELECT voxel_id, ix, iz, round(entropy, 4) AS entropy FROM f WHERE iy = 2")
def sp13_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.slice_field(geology.field(spark, sf_dir), geology.CELLS, "y").select("voxel_id", "ix", "iz", "entropy"))


@query("WITH e AS (SELECT var_pop(s_acctbal / 1000) AS e FROM supplier GROUP BY s_nationkey), t AS (SELECT sum(e) AS total_mse, avg(e) AS mean_mse, count(*) AS k, (SELECT count(*) FROM supplier) AS n FROM e) SELECT round(total_mse, 4) AS total_mse, round(mean_mse, 4) AS mean_mse, CASE WHEN mean_mse > 0 THEN round(n * ln(mean_mse) + k * k * ln(n), 4) ELSE 'Infinity'::DOUBLE END AS bic FROM t")
def sc9_joint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as layers, the spread of their suppliers' balances as errors: one number a layer for the driver."""
    s = table(spark, sf_dir, "supplier")
    errors = {str(r.s_nationkey): r.e for r in s.groupBy("s_nationkey").agg(F.var_pop(F.col("s_acctbal") / 1000).alias("e")).collect()}
    score = scoring.joint_prediction_score(errors, s.count())
    return rounded(spark.createDataFrame([tuple(score.values())], ", ".join(f"{k} double" for k in score)))


PLANES = [(0.1, 0.2, 1.0, 1), (0.0, -0.1, 9.0, -1)]


@query("SELECT c_custkey, round(least((z - (0.1 * x + 0.2 * y + 1)) / sqrt(1.05), -(z - (9 - 0.1 * y)) / sqrt(1.01)), 4) AS distance, round(1 / (1 + exp(-greatest(-60, least(60, least((z - (0.1 * x + 0.2 * y + 1)) / sqrt(1.05), -(z - (9 - 0.1 * y)) / sqrt(1.01)) / 0.5)))), 4) AS membership FROM (SELECT c_custkey, (c_custkey % 40)::DOUBLE AS x, c_nationkey::DOUBLE AS y, c_acctbal / 1000 AS z FROM customer)")
def fb2_distance_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to two planes, and with it FB4's membership, at customers as points."""
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_acctbal") / 1000).alias("z"))
    distance = fields.layer_distance(PLANES, Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (4, 4, 4)), 1.0)
    return rounded(points.select("c_custkey", distance.alias("distance"), fields.membership(distance, 0.5).alias("membership")))


COMPOSED = (
    "s AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS a, l_quantity / 50 AS b, l_tax * 10 AS c FROM lineitem), "
    "x AS (SELECT *, a AS ea, (1 - a) * (1 - (1 - b) * (1 - c)) * coalesce(b / nullif(b + c, 0), 0) AS eb, (1 - a) * (1 - (1 - b) * (1 - c)) * coalesce(c / nullif(b + c, 0), 0) AS ec FROM s)"
)


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = {"a": F.col("l_discount") * 5, "b": F.col("l_quantity") / 50, "c": F.col("l_tax") * 10}
    out = fields.compose(support, [["a"], ["b", "c"]], {})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[out[u].alias(f"e{u}") for u in "abc"], F.array(*support.values()).alias("support"))


@query(f"WITH {COMPOSED} SELECT l_orderkey, l_linenumber, round(ea, 9) AS ea, round(eb, 9) AS eb, round(ec, 9) AS ec FROM x")
def fb6_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_composed(spark, sf_dir).drop("support"), 9)


@query(f"WITH {COMPOSED}, y AS (SELECT *, (ea + eb + ec) + greatest(0, 1 - (ea + eb + ec)) AS w FROM x) SELECT l_orderkey, l_linenumber, round(ea / w, 9) AS pa, round(ec / w, 9) AS pc, (greatest(a, b, c) < 0.3) AS weak FROM y")
def fb7_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs, best = fields.normalise(F.array("ea", "eb", "ec"), F.col("support"), 0.3)
    return rounded(_composed(spark, sf_dir).select("l_orderkey", "l_linenumber", F.get(probs, F.lit(0)).alias("pa"), F.get(probs, F.lit(2)).alias("pc"), (best == -1).alias("weak")), 9)


@query("SELECT l_partkey AS voxel_id, (l_suppkey % 3)::INT AS unit, round(sum(l_discount * l_quantity), 4) AS membership, bool_and(l_quantity < 40) AS weak FROM lineitem GROUP BY 1, 2")
def fb8_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("voxel_id"), (F.col("l_suppkey") % 3).cast("int").alias("unit"), F.col("l_discount").alias("membership"), F.col("l_quantity").alias("weight"), (F.col("l_quantity") < 40).alias("weak"))
    return rounded(fields.integrate_subcells(samples))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the units of their region; every third without a rank."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").alias("graph_id"), F.format_string("u%02d", "n_nationkey").alias("unit"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 4).cast("int").alias("chronology_rank"), F.col("n_nationkey").alias("unit_seq"))


def _overlies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit over the next of its region, but in the first region, which has no order."""
    by = Window.partitionBy("graph_id").orderBy("unit_seq")
    u = _units(spark, sf_dir).withColumn("target", F.lead("unit").over(by)).where("target is not null and graph_id > 0")
    return u.select("graph_id", F.lit("overlies").alias("kind"), F.col("unit").alias("source"), "target")


@query("SELECT n_regionkey AS graph_id, printf('u%02d', n_nationkey) AS unit, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS rank FROM nation")
def gr4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stratigraphic_order(_units(spark, sf_dir), _overlies(spark, sf_dir))


@query("WITH u AS (SELECT n_regionkey AS graph_id, n_nationkey AS k, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM nation), m AS (SELECT graph_id, k, (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = k AND s_nationkey % 7 <> 5) AS z FROM u WHERE next IS NOT NULL), b AS (SELECT graph_id, z < lag(z) OVER (PARTITION BY graph_id ORDER BY k) AS ok FROM m WHERE z IS NOT NULL) SELECT DISTINCT u.graph_id, coalesce((SELECT bool_and(coalesce(ok, true)) FROM b WHERE b.graph_id = u.graph_id), true) AS feasible FROM u")
def gr13_constrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as contacts of their nation with the next: heights are balances."""
    order = graph.stratigraphic_order(_units(spark, sf_dir), _overlies(spark, sf_dir))
    pairs = _units(spark, sf_dir).withColumn("lower", F.lead("unit").over(Window.partitionBy("graph_id").orderBy("unit_seq"))).where("lower is not null")
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 7 <> 5")
    contacts = s.join(F.broadcast(pairs), F.col("s_nationkey") == F.col("unit_seq")).select("graph_id", F.col("unit").alias("upper"), "lower", F.col("s_acctbal").alias("z"))
    return graph.stratigraphic_constrain(contacts, order)


@query("SELECT n_regionkey AS graph_id, 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2")
def gr3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as a chain, closed to a ring in the third region."""
    by = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.lit("overlies").alias("kind"), F.col("n_nationkey").alias("k"), F.lead("n_nationkey").over(by).alias("next"), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("first"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    target = F.coalesce("next", F.when(F.col("graph_id") == 2, F.col("first")))
    return graph.overlies_cycles(n.where(target.isNotNull()).select("graph_id", "kind", name(F.col("k")).alias("source"), name(target).alias("target")))


@query("""SELECT p_partkey, 'triangular' AS name, p_size::DOUBLE AS "left", p_size * 2.0 AS "right", p_size * 1.5 AS mode FROM part""")
def un5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    u = uncertainty.interval_as_distribution(size, 2 * size, "triangular")
    part = table(spark, sf_dir, "part").select("p_partkey", u.alias("u"))
    return part.select("p_partkey", "u.name", *[F.element_at("u.params", F.lit(k)).alias(k) for k in ("left", "right", "mode")])


@query("SELECT p_partkey, round(p_retailprice, 4) AS x, p_size::DOUBLE AS std_x, round((p_size + 2 * p_size) / 2.0, 4) AS y, 0.0::DOUBLE AS std_y FROM part")
def un6_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, v = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    x = uncertainty.parse_uncertainty(F.concat(F.lit('{"mean": '), v, F.lit(', "std": '), s, F.lit("}")))
    y = uncertainty.parse_uncertainty(F.concat(F.lit('{"lo": '), s, F.lit(', "hi": '), (2 * F.col("p_size")).cast("string"), F.lit("}")))
    at = table(spark, sf_dir, "part").select("p_partkey", uncertainty.position_with_std(F.array(x, y)).alias("p"))
    axis = lambda k: F.get("p", F.lit(k))
    return rounded(at.select("p_partkey", axis(0)["value"].alias("x"), axis(0)["std"].alias("std_x"), axis(1)["value"].alias("y"), axis(1)["std"].alias("std_y")))


@query(f"WITH {ROWS} SELECT row_id, turn, step FROM r WHERE step IN ('assistant', 'system')")
def tr5_keep_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.keep_workflow_steps(rows(spark, sf_dir), ["assistant", "system"]).select("row_id", "turn", "step")
