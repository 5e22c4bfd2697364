"""Embeddings as a voxel field, nations and suppliers as geology graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import fields, graph
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()

UNITS = 6
#: Voxels are columns of eight cells; the grid is as wide as the ids reach.
CELLS = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (100_000, 5, 8))


def field(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """The first dimensions (from ``shift`` on) of each vector as unit probabilities."""
    v = table(spark, sf_dir, "embeddings")
    raw = F.transform(F.slice("embedding", 1 + shift, UNITS), lambda x: F.abs(x.cast("double")))
    v = v.select(F.col("vec_id").alias("voxel_id"), "label", raw.alias("raw"))
    probs = F.transform("raw", lambda x: x / fields.total(F.col("raw")))
    v = v.select("voxel_id", F.expr("int(voxel_id div 40)").alias("ix"), F.expr("int((voxel_id div 8) % 5)").alias("iy"), F.expr("int(voxel_id % 8)").alias("iz"), (F.col("voxel_id") % (7 + shift) != 0).alias("in_domain"), probs.alias("probs"))
    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return v.withColumns({"most_likely": F.when(F.array_max("probs") < 0.25, F.lit(-1)).otherwise(best), "entropy": fields.normalised_entropy(F.col("probs"), F.col("in_domain")), "support": F.col("probs")})


def _field_sql(name: str, shift: int = 0) -> str:
    return (
        f"{name}_r AS (SELECT vec_id AS voxel_id, list_transform(embedding[{1 + shift}:{UNITS + shift}], lambda x: abs(x::DOUBLE)) AS raw FROM embeddings), "
        f"{name}_p AS (SELECT voxel_id, list_transform(raw, lambda x: x / list_sum(raw)) AS probs, voxel_id % {7 + shift} <> 0 AS in_domain, (voxel_id // 40)::INT AS ix, ((voxel_id // 8) % 5)::INT AS iy, (voxel_id % 8)::INT AS iz FROM {name}_r), "
        f"{name} AS (SELECT *, CASE WHEN list_max(probs) < 0.25 THEN -1 ELSE list_position(probs, list_max(probs)) - 1 END AS unit, CASE WHEN in_domain THEN -list_sum(list_transform(probs, lambda p: CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)) / log2({UNITS}.0) ELSE 0.0 END AS entropy FROM {name}_p)"
    )


F0, F1 = _field_sql("f"), _field_sql("g", 2)


@query(f"WITH {F0} SELECT voxel_id, round(entropy, 4) AS entropy, unit::INT AS most_likely FROM f")
def fb9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(field(spark, sf_dir).select("voxel_id", "entropy", "most_likely"))


@query(f"WITH {F0}, {F1} SELECT f.voxel_id, round((f.probs[1] + g.probs[1]) / 2, 4) AS p0, round((f.probs[6] + g.probs[6]) / 2, 4) AS p5, f.in_domain OR g.in_domain AS in_domain FROM f JOIN g ON f.voxel_id = g.voxel_id")
def fb14_reduce_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = field(spark, sf_dir).unionAll(field(spark, sf_dir, 2)).select("voxel_id", "probs", "in_domain")
    out = fields.reduce_ensemble(runs, 2, UNITS, 0.25)
    return rounded(out.select("voxel_id", F.get("probs", F.lit(0)).alias("p0"), F.get("probs", F.lit(5)).alias("p5"), "in_domain"))


@query(f"WITH {F0}, {F1}, a AS (SELECT unit, count(*) AS n FROM f WHERE unit >= 0 GROUP BY unit), b AS (SELECT unit, count(*) AS n FROM g WHERE unit >= 0 GROUP BY unit) SELECT a.unit::INT AS most_likely, a.n::BIGINT AS before, b.n::BIGINT AS after FROM a JOIN b ON a.unit = b.unit WHERE (a.n - b.n) / a.n > 0.01")
def fb12_count_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.voxel_count_drop(field(spark, sf_dir, 2), field(spark, sf_dir), 0.01).select("most_likely", "before", "after")


@query(f"WITH {F0}, r AS (SELECT *, lag(unit) OVER (PARTITION BY ix, iy ORDER BY iz DESC) AS above FROM f WHERE unit >= 0) SELECT ix, iy, count(*)::BIGINT AS breaks FROM r WHERE unit < above GROUP BY ix, iy")
def ch1_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame([(k, k) for k in range(UNITS)], "unit int, rank int")
    return fields.check_column_order(field(spark, sf_dir), ranks)


@query(f"WITH {F0}, v AS (SELECT unit, count(*) * 2.0 AS volume, min(voxel_id) AS first_voxel FROM f GROUP BY unit) SELECT unit::INT AS unit, round(volume, 4)::DOUBLE AS volume, first_voxel FROM v WHERE unit >= 0 AND (volume < 10.0 OR volume > 60.0)")
def ch2_bulk_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([(k, 10.0, 60.0) for k in range(UNITS)], "unit int, lo double, hi double")
    return fields.check_bulk_volume(field(spark, sf_dir), bounds, 2.0).select("unit", "volume", "first_voxel")


@query(f"WITH {F0}, h AS (SELECT voxel_id FROM f WHERE in_domain AND unit < 0) SELECT (SELECT count(*) FROM h)::BIGINT AS open_cells, (SELECT list(voxel_id ORDER BY voxel_id) FROM (SELECT voxel_id FROM h ORDER BY voxel_id LIMIT 100)) AS first_voxels")
def ch3_domain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.check_domain_closure(field(spark, sf_dir))


@query(
    f"WITH RECURSIVE {F0}, c AS (SELECT voxel_id AS v, ix, iy, iz, unit FROM f WHERE unit >= 0), adj AS (SELECT a.v AS a, b.v AS b FROM c a JOIN c b ON a.unit = b.unit AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1), reach(a, b) AS (SELECT v, v FROM c UNION SELECT r.a, j.b FROM reach r JOIN adj j ON r.b = j.a), "
    "root AS (SELECT a, min(b) AS root FROM reach GROUP BY a) SELECT unit::INT AS unit, count(DISTINCT root)::BIGINT AS blobs FROM c JOIN root ON root.a = c.v GROUP BY unit HAVING count(DISTINCT root) > 1"
)
def ch4_orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.check_orphan_blobs(field(spark, sf_dir), CELLS)


@query(f"WITH {F0}, i AS (SELECT * FROM f WHERE in_domain), s AS (SELECT unit, count(*) / (SELECT count(*) FROM i) AS share FROM i GROUP BY unit) SELECT unit::INT AS unit, round(share, 4) AS share FROM s WHERE unit >= 0 AND share > 0.02 * unit + 0.05")
def ch5_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame([(k, 0.02 * k) for k in range(UNITS)], "unit int, p_exists double")
    return rounded(fields.check_existence(field(spark, sf_dir), units).select("unit", "share"))


@query(f"WITH {F0}, m AS (SELECT k.range AS unit, avg(probs[k.range + 1]) AS m FROM f, range({UNITS}) k WHERE in_domain GROUP BY 1) SELECT unit::INT AS unit, round(m / (SELECT sum(m) FROM m), 4) AS mean_prob, round((SELECT avg(entropy) FROM f WHERE in_domain), 4) AS mean_entropy, round((SELECT avg(in_domain::INT) FROM f), 4) AS domain_share FROM m")
def ch6_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.field_stats(field(spark, sf_dir)))


@query(f"WITH {F0}, {F1} SELECT round(count(*) FILTER (WHERE g.in_domain) / count(*), 4) AS coverage FROM f JOIN g ON f.voxel_id = g.voxel_id WHERE f.in_domain")
def rf1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.coverage(field(spark, sf_dir), field(spark, sf_dir, 2)))


def _kl(weighted: bool) -> str:
    bits = f"list_sum(list_transform(range(1, {UNITS} + 1), lambda k: (0.99 * a.probs[k] + 0.01 / {UNITS}) * log2((0.99 * a.probs[k] + 0.01 / {UNITS}) / (0.99 * b.probs[k] + 0.01 / {UNITS}))))"
    entropy = f"list_sum(list_transform(range(1, {UNITS} + 1), lambda k: -(0.99 * a.probs[k] + 0.01 / {UNITS}) * log2(0.99 * a.probs[k] + 0.01 / {UNITS}))) / log2({UNITS})"
    value = f"least({bits} * (1 - {entropy}), log2(100.0))" if weighted else bits
    return f"WITH {F0}, {F1} SELECT round(avg({value}), 4) AS loss FROM f a JOIN g b ON a.voxel_id = b.voxel_id WHERE a.in_domain AND b.in_domain"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"u{k}" for k in range(UNITS)]
    return fields.align_fields(field(spark, sf_dir), field(spark, sf_dir, 2), names, names)


@query(_kl(True))
def rf3_forward_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.divergence(_aligned(spark, sf_dir)))


@query(_kl(False))
def rf4_reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.divergence(_aligned(spark, sf_dir), weighted=False))


@query("WITH p AS (SELECT l_suppkey % 7 AS pair, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem), s AS (SELECT pair, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM p GROUP BY pair), q AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM s) SELECT pair, n::BIGINT AS n, round(a, 4) AS a, round(b, 4) + 0.0 AS b, round(mz - a * mx - b * my, 3) + 0.0 AS c, round(sqrt(zz - a * xz - b * yz), 4) AS rms FROM q")
def fb1_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("pair"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    return rounded(fields.fit_planes(points)).withColumn("c", F.round("c", 3))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as graphs: nations are locations, suppliers samples, the graph itself a unit."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey"))
    places = nation.select("graph_id", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_nationkey").cast("long").alias("node_seq"), F.lit("location").alias("kind"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    samples = suppliers.select("graph_id", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), (F.col("s_suppkey") + 1000).alias("node_seq"), F.lit("sample").alias("kind"))
    units = nation.select("graph_id").distinct().select("graph_id", F.lit("u").alias("node_id"), F.lit(-1).cast("long").alias("node_seq"), F.lit("stratigraphic_unit").alias("kind"))
    none = F.lit(None).cast("array<string>")
    return places.unionAll(samples).unionAll(units).withColumns({"unit_id": F.lit(None).cast("string"), "between": none, "surface_points": none, "p_exists": F.lit(0.9)})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at their nation (every tenth nowhere, every eleventh at a missing place) and within the unit."""
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("graph_id"), "s_suppkey", "s_nationkey")
    source = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    place = F.when(F.col("s_suppkey") % 11 == 0, "gone").otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    at = s.where("s_suppkey % 10 <> 0").select("graph_id", F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("edge_id"), F.col("s_suppkey").alias("edge_seq"), F.lit("at").alias("kind"), source.alias("source"), place.alias("target"))
    within = s.select("graph_id", F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("edge_id"), F.col("s_suppkey").alias("edge_seq"), F.lit("within").alias("kind"), source.alias("source"), F.lit("u").alias("target"))
    return at.unionAll(within)


SUPPLIERS = "s AS (SELECT n_regionkey AS graph_id, s_suppkey AS k, s_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"WITH {SUPPLIERS} SELECT graph_id, 'missing_endpoint' AS rule, 'a' || k AS item FROM s WHERE k % 10 <> 0 AND k % 11 = 0 UNION ALL SELECT graph_id, 'sample_needs_one_at', 's' || k FROM s WHERE k % 10 = 0")
def gr2_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.validate_graphs(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {SUPPLIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY k) AS rank, count(*) OVER (PARTITION BY graph_id) AS t FROM s) SELECT graph_id, 's' || k AS node_id, rank::INT AS rank, t > 5 AS truncated FROM r WHERE rank <= 5")
def gr5_query_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.query_nodes(nodes(spark, sf_dir), "Sample", 5).select("graph_id", "node_id", "rank", "truncated")


@query(f"WITH {SUPPLIERS} SELECT graph_id, 'u' AS node_id, 0 AS depth FROM s GROUP BY 1 UNION ALL SELECT graph_id, 's' || k, 1 FROM s UNION ALL SELECT DISTINCT graph_id, CASE WHEN k % 11 = 0 THEN 'gone' ELSE 'n' || n END, 2 FROM s WHERE k % 10 <> 0")
def gr6_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = nodes(spark, sf_dir).where("kind = 'stratigraphic_unit'")
    links = edges(spark, sf_dir)
    return graph.subgraph(links, seeds.join(links.select("graph_id").distinct(), "graph_id", "left_semi"), 2)[0]


@query(f"WITH {SUPPLIERS} SELECT graph_id, CASE WHEN k % 11 = 0 THEN 'gone' ELSE 'n' || n END AS location, 's' || k AS sample FROM s WHERE k % 10 <> 0")
def gr8_samples_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.samples_at(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(
    "SELECT 'node' AS item, c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0 OR c_custkey % 5 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 3 = 0) "
    "UNION ALL SELECT 'edge', CASE WHEN s_suppkey % 2 = 0 THEN 'within|s' || s_suppkey || '|u' ELSE 'w' || s_suppkey END, CASE WHEN s_suppkey % 4 = 0 THEN 'removed' ELSE 'added' END FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 6 <> 0 OR s_suppkey % 4 <> 0 AND s_suppkey % 6 = 0"
)
def gr7_graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node_id"), "c_custkey", F.col("c_name").alias("name"))
    a, b = c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 5 <> 0").withColumn("name", F.when(F.col("c_custkey") % 3 == 0, F.upper("name")).otherwise(F.col("name")))
    within = edges(spark, sf_dir).where("kind = 'within'").withColumn("edge_id", F.when(F.col("edge_seq") % 2 != 0, F.col("edge_id")))
    return graph.graph_diff(a.drop("c_custkey"), within.where("edge_seq % 6 <> 0"), b.drop("c_custkey"), within.where("edge_seq % 4 <> 0"))


@query(
    f"""WITH {SUPPLIERS}, j AS (
  SELECT n_regionkey AS graph_id, 'n{{"kind":"location","node_id":"n' || n_nationkey || '","node_seq":' || n_nationkey || ',"p_exists":0.9}}' AS j FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'n{{"kind":"stratigraphic_unit","node_id":"u","node_seq":-1,"p_exists":0.9}}' FROM nation
  UNION ALL SELECT graph_id, 'n{{"kind":"sample","node_id":"s' || k || '","node_seq":' || (k + 1000) || ',"p_exists":0.9}}' FROM s
  UNION ALL SELECT graph_id, 'e{{"edge_id":"a' || k || '","edge_seq":' || k || ',"kind":"at","source":"s' || k || '","target":"' || CASE WHEN k % 11 = 0 THEN 'gone' ELSE 'n' || n END || '"}}' FROM s WHERE k % 10 <> 0
  UNION ALL SELECT graph_id, 'e{{"edge_id":"w' || k || '","edge_seq":' || k || ',"kind":"within","source":"s' || k || '","target":"u"}}' FROM s
), h AS (SELECT graph_id, sha256(j) AS h FROM j)
SELECT graph_id, sha256(concat_ws(',', count(*), sum(('0x' || h[1:15])::HUGEINT), sum(('0x' || h[16:30])::HUGEINT), sum(('0x' || h[31:45])::HUGEINT), sum(('0x' || h[46:60])::HUGEINT))) AS digest FROM h GROUP BY graph_id"""
)
def gr12_graph_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_digest(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("SELECT c_nationkey AS pool_id, c_custkey AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer) WHERE r <= 10")
def rf14_pool_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pool_id"), F.col("c_custkey").alias("candidate_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("content_hash"))
    pool, new = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1 or seq % 6 = 0")
    return fields.pool_append(pool, new, 10).select("pool_id", "candidate_id")


@query("SELECT seq, CASE WHEN pool < 3 OR n < 2 THEN 'Infinity'::DOUBLE ELSE round(400000 - 200000 * least(1.0, a / 5), 2) END AS threshold, score <= CASE WHEN pool < 3 OR n < 2 THEN 'Infinity'::DOUBLE ELSE 400000 - 200000 * least(1.0, a / 5) END AS admitted FROM (SELECT o_orderkey AS seq, o_totalprice AS score, row_number() OVER w - 1 AS n, count(*) FILTER (WHERE o_totalprice < 150000) OVER w AS a, o_orderkey % 9 AS pool FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def rf12_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: a customer's earlier orders are episodes, its cheap ones up to now admissions.

    Orders without a key come last and their pool counts as full.
    """
    so_far = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("score"), (F.row_number().over(so_far) - 1).alias("episode_count"), F.count_if(F.col("o_totalprice") < 150000).over(so_far).alias("admission_count"), F.coalesce(F.col("o_orderkey") % 9, F.lit(3)).alias("pool_size"))
    out = fields.annealed_thresholds(rows, 400000.0, 200000.0, 5, 3, 2).select("seq", "threshold", "admitted")
    return out.withColumn("threshold", F.round("threshold", 2))
