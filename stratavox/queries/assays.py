"""Line items as assay points: quantity, discount and tax are the place, price the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, grid_cells
from ..operators import explore, scoring, spatial
from ..plans.layers import paint_and_score, wide_layers
from .common import long, registry, rounded, table

QUERIES, ORACLES, query = registry()

#: Cells of 5 units by 1 % by 1 %, with all values in the middle of a cell's range.
ASSAY_GRID = Grid((0.5, -0.005, -0.005), (50.5, 0.105, 0.085), (10, 11, 9))
#: The same points on a map: degrees and metres.
MAP_GRID = Grid((117.8, -27.5, 0.0), (117.9, -27.4, 80.0), (50, 50, 8))
LAYERS = ["price", "quantity", "items"]

CELL = "CAST(floor((l_quantity - 0.5) / 50.0 * 10) AS INT) AS ix, CAST(floor((l_discount + 0.005) / 0.11 * 11) AS INT) AS iy, CAST(floor((l_tax + 0.005) / 0.09 * 9) AS INT) AS iz"
PLACED = f"placed AS (SELECT *, (ix::BIGINT * 11 + iy) * 9 + iz AS voxel_id FROM (SELECT *, {CELL} FROM lineitem))"
WIDE = PLACED + ", w AS (SELECT voxel_id, any_value(iz) AS iz, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity, count(*)::DOUBLE AS items FROM placed GROUP BY voxel_id)"


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", F.col("l_quantity").alias("lon"), F.col("l_discount").alias("lat"), F.col("l_tax").alias("depth_m"), F.col("l_extendedprice").alias("value"))
    return spatial.coord_to_voxel(rows, ASSAY_GRID)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_layers(assays(spark, sf_dir).withColumnRenamed("lon", "quantity"), {"price": F.avg("value"), "quantity": F.avg("quantity"), "items": F.count("*").cast("double")})


@query(f"WITH {PLACED} SELECT ix, iy, iz, count(*)::BIGINT AS points, round(avg(l_extendedprice), 4) AS mean_value FROM placed GROUP BY ix, iy, iz")
def sp2_points_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assays(spark, sf_dir).where("in_range").groupBy("ix", "iy", "iz").agg(F.count("*").alias("points"), F.avg("value").alias("mean_value")))


@query(f"WITH {PLACED} SELECT voxel_id, round(0.5::DOUBLE + (any_value(ix) + 0.5) * 5.0::DOUBLE, 4) AS lon, round(-0.005::DOUBLE + (any_value(iy) + 0.5) * 0.01::DOUBLE, 4) AS lat, round(-0.005::DOUBLE + (any_value(iz) + 0.5) * 0.01::DOUBLE, 4) AS depth_m FROM placed GROUP BY voxel_id")
def sp3_cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = assays(spark, sf_dir).select("voxel_id", "ix", "iy", "iz").distinct()
    return rounded(spatial.voxel_to_coord(cells, ASSAY_GRID).select("voxel_id", "lon", "lat", "depth_m"))


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on the map; their key sets place and radius."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("op_id"), key.alias("seq"), F.lit("supply").alias("layer"), (F.lit(117.8) + (key * 37 % 1000) / 10000.0).alias("lon"), (F.lit(-27.5) + (key * 91 % 1000) / 10000.0).alias("lat"),
        (key * 13 % 800 / 10.0).alias("depth_m"), (F.col("s_acctbal") / 1000).alias("value"), (F.lit(150.0) + key % 7 * 60).alias("radius_m"),
    )


POINTS = "p AS (SELECT s_suppkey AS op_id, 117.8 + ((s_suppkey * 37) % 1000) / 10000.0 AS lon, -27.5 + ((s_suppkey * 91) % 1000) / 10000.0 AS lat, ((s_suppkey * 13) % 800) / 10.0 AS depth_m, s_acctbal / 1000 AS value, 150.0 + (s_suppkey % 7) * 60 AS radius_m FROM supplier)"
CENTRES = "c AS (SELECT i.range AS ix, j.range AS iy, k.range AS iz, 117.8 + (i.range + 0.5) * 0.002 AS x, -27.5 + (j.range + 0.5) * 0.002 AS y, (k.range + 0.5) * 10.0 AS z FROM range(50) i, range(50) j, range(8) k)"
BALLS = f"{POINTS}, {CENTRES}, b AS (SELECT op_id, value, (ix * 50 + iy) * 8 + iz AS voxel_id FROM p, c WHERE abs(y - lat) < 0.01 AND abs(x - lon) < 0.01 AND sqrt(pow((x - lon) * 111320.0 * cos(radians(lat)), 2) + pow((y - lat) * 111320.0, 2) + pow(z - depth_m, 2)) <= radius_m)"


@query(f"WITH {BALLS} SELECT op_id, count(*)::BIGINT AS voxels, min(voxel_id)::BIGINT AS first_voxel, max(voxel_id)::BIGINT AS last_voxel FROM b GROUP BY op_id")
def sp5_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rasterize_spheres(map_points(spark, sf_dir), MAP_GRID).groupBy("op_id").agg(F.count("*").alias("voxels"), F.min("voxel_id").alias("first_voxel"), F.max("voxel_id").alias("last_voxel"))


def _painted(rule: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        balls = spatial.rasterize_spheres(map_points(spark, sf_dir), MAP_GRID)
        return rounded(spatial.paint_layer(balls, rule).select("voxel_id", "value"), 6)

    run.__name__ = f"sp7_paint_{rule}"
    query(f"WITH {BALLS} {sql}")(run)


_painted("replace", "SELECT voxel_id::BIGINT AS voxel_id, round(arg_max(value, op_id), 6) AS value FROM b GROUP BY voxel_id")
_painted("max", "SELECT voxel_id::BIGINT AS voxel_id, round(greatest(0.0, max(value)), 6) AS value FROM b GROUP BY voxel_id")
_painted("add", "SELECT voxel_id::BIGINT AS voxel_id, round(sum(value), 6) AS value FROM b GROUP BY voxel_id")
_painted("mean", "SELECT voxel_id::BIGINT AS voxel_id, round(sum(value * pow(0.5, back)), 6) AS value FROM (SELECT voxel_id, value, row_number() OVER (PARTITION BY voxel_id ORDER BY op_id DESC) AS back FROM b) GROUP BY voxel_id")


@query()
def sp6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's point joined to the next key's point by a line."""
    a = map_points(spark, sf_dir).select("op_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("depth_m").alias("depth0"))
    b = map_points(spark, sf_dir).select((F.col("op_id") - 1).alias("op_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("depth_m").alias("depth1"))
    lines = a.join(b, "op_id").withColumn("width_m", F.lit(300.0))
    return spatial.rasterize_lines(lines, MAP_GRID).groupBy("op_id").agg(F.count("*").alias("voxels"))


@query(f"WITH {BALLS}, s AS (SELECT voxel_id, sum(value) AS value FROM b GROUP BY voxel_id), r AS (SELECT (ix * 50 + iy) * 8 + iz AS voxel_id, count(*) OVER () AS total_voxels FROM c WHERE sqrt(pow((x - 117.85) * 111320.0 * cos(radians(-27.45)), 2) + pow((y + 27.45) * 111320.0, 2) + pow(z - 40.0, 2)) <= 600.0 ORDER BY voxel_id LIMIT 50) SELECT s.voxel_id::BIGINT AS voxel_id, round(value, 4) AS value, total_voxels::BIGINT AS total_voxels FROM s JOIN r ON s.voxel_id = r.voxel_id WHERE value <> 0")
def sp8_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    painted = spatial.paint_layer(spatial.rasterize_spheres(map_points(spark, sf_dir), MAP_GRID), "add")
    return rounded(spatial.query_region(painted, MAP_GRID, 117.85, -27.45, 40.0, 600.0).select("voxel_id", "value", "total_voxels"))


@query("SELECT round(min(l_quantity) - greatest(0.05 * (max(l_quantity) - min(l_quantity)), 1.0), 4) AS lo_x, round(max(l_quantity) + greatest(0.05 * (max(l_quantity) - min(l_quantity)), 1.0), 4) AS hi_x, round(min(l_discount) - 1.0, 4) AS lo_y, round(max(l_discount) + 1.0, 4) AS hi_y, round(min(l_tax) - 1.0, 4) AS lo_z, round(max(l_tax) + 1.0, 4) AS hi_z FROM lineitem")
def sp14_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return rounded(spatial.padded_bounds(points))


@query(f"WITH {PLACED}, w AS (SELECT voxel_id, any_value(ix) AS ix, any_value(iy) AS iy, any_value(iz) AS iz FROM placed GROUP BY voxel_id), s AS (SELECT s_suppkey % 50 + 0.5 AS px, (s_suppkey % 11) * 0.01 AS py, (s_suppkey % 9) * 0.01 AS pz, s_acctbal AS v FROM supplier), d AS (SELECT voxel_id, v, pow(greatest(sqrt(pow(0.5 + (ix + 0.5) * 5.0 - px, 2) + pow(-0.005 + (iy + 0.5) * 0.01 - py, 2) + pow(-0.005 + (iz + 0.5) * 0.01 - pz, 2)), 1e-6), -2) AS g FROM w, s) SELECT voxel_id, round(sum(g * v) / sum(g), 3) AS estimate FROM d GROUP BY voxel_id")
def sp12_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spatial.voxel_to_coord(assays(spark, sf_dir).select("voxel_id", "ix", "iy", "iz").distinct(), ASSAY_GRID).toDF("voxel_id", "ix", "iy", "iz", "x", "y", "z")
    key = F.col("s_suppkey")
    samples = table(spark, sf_dir, "supplier").select((key % 50 + 0.5).alias("x"), (key % 11 * 0.01).alias("y"), (key % 9 * 0.01).alias("z"), F.col("s_acctbal").alias("value"))
    return rounded(spatial.idw_interpolate(cells, samples), 3)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c})::BIGINT AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")")
def an1_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.describe_columns(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT CAST(floor(l_quantity / 7.0) AS BIGINT) AS band, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean_value, round(max(l_extendedprice), 4) AS max_value FROM lineitem GROUP BY 1")
def an2_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.aggregate_by_band(table(spark, sf_dir, "lineitem"), "l_quantity", 7.0, "l_extendedprice"))


@query("SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
def an3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag = 'R'")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def an4_top_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = explore.top_k_per_group(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 3, ["l_orderkey", "l_linenumber"])
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) + 0.0 AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def an5_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT p_partkey, lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%bolt%' AS has_word FROM part")
def an6_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.flag_keyword(table(spark, sf_dir, "part"), "p_name", ["Small", "bolt"], "has_word").select("p_partkey", "has_word")


@query(f"WITH {PLACED} SELECT voxel_id, round(avg(0.5 * l_extendedprice / 1000 + 2.0 * l_tax), 4) AS score FROM placed GROUP BY voxel_id")
def an7_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assays(spark, sf_dir).withColumn("price", F.col("value") / 1000)
    return rounded(explore.composite_score(rows, {"price": 0.5, "depth_m": 2.0}).groupBy("voxel_id").agg(F.avg("score").alias("score")))


def _bin(v: str, lo: str, hi: str, n: int) -> str:
    first = f"least({n - 1}, floor(({v} - {lo}) * {n} / nullif({hi} - {lo}, 0)))"
    w = f"(({hi} - {lo}) / {n})"
    upper = f"CASE WHEN {first} + 1 >= {n} THEN {hi} ELSE {lo} + ({first} + 1) * {w} END"
    return f"coalesce(CASE WHEN {v} < {lo} + {first} * {w} THEN {first} - 1 WHEN {v} >= {upper} AND {first} < {n - 1} THEN {first} + 1 ELSE {first} END, 0)"


def _entropy_sql(names: list[str], bins: int = 50) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS layer, {n} AS value FROM w" for n in names)
    return (
        f"l AS ({union}), r AS (SELECT layer, min(value) AS lo, max(value) AS hi, count(*) AS n FROM l GROUP BY layer), "
        f"k AS (SELECT l.layer, {_bin('value', 'lo', 'hi', bins)} AS bin, count(*) AS c, any_value(n) AS n, any_value(hi - lo) / {bins} AS wd FROM l JOIN r ON l.layer = r.layer GROUP BY 1, 2), "
        "h AS (SELECT layer, greatest(0.0, sum(CASE WHEN wd > 0 AND n > 1 THEN -(c / (n * wd)) * log2(c / (n * wd) + 1e-10) * wd ELSE 0 END)) AS entropy FROM k GROUP BY layer)"
    )


@query(f"WITH {WIDE}, {_entropy_sql(LAYERS)} SELECT layer, round(entropy, 4) AS entropy FROM h")
def sc1_entropy_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.entropy_continuous(scoring.long_layers(layers(spark, sf_dir), LAYERS)))


@query("WITH l AS (SELECT 'quantity' AS layer, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem), k AS (SELECT layer, value, count(*) AS c FROM l GROUP BY 1, 2), t AS (SELECT layer, sum(c) AS n FROM k GROUP BY layer) SELECT k.layer, round(sum(-(c / n) * log2(c / n + 1e-10)), 4) AS entropy FROM k JOIN t ON k.layer = t.layer GROUP BY k.layer")
def sc2_entropy_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.inline(F.array(F.struct(F.lit("quantity").alias("layer"), F.col("l_quantity").alias("value")), F.struct(F.lit("discount").alias("layer"), F.col("l_discount").alias("value")))))
    return rounded(scoring.entropy_discrete(rows))


def _joint_sql(pairs: list[tuple[str, str]], bins: int = 30) -> str:
    union = " UNION ALL ".join(f"SELECT '{a}' AS layer_a, '{b}' AS layer_b, {a} AS a, {b} AS b FROM w" for a, b in pairs)
    return (
        f"j AS ({union}), jr AS (SELECT layer_a, layer_b, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, count(*) AS n FROM j GROUP BY 1, 2), "
        f"jk AS (SELECT j.layer_a, j.layer_b, {_bin('a', 'la', 'ha', bins)} AS ba, {_bin('b', 'lb', 'hb', bins)} AS bb, count(*) AS c, any_value(n) AS n, any_value((ha - la) * (hb - lb)) / {bins * bins} AS ar FROM j JOIN jr ON j.layer_a = jr.layer_a AND j.layer_b = jr.layer_b GROUP BY 1, 2, 3, 4), "
        "jh AS (SELECT layer_a, layer_b, greatest(0.0, sum(-(c / (n * ar)) * log2(c / (n * ar) + 1e-10) * ar)) AS entropy FROM jk GROUP BY 1, 2)"
    )


PAIRS = [("price", "quantity"), ("price", "items"), ("quantity", "items")]


@query(f"WITH {WIDE}, {_joint_sql(PAIRS)} SELECT layer_a, layer_b, round(entropy, 4) AS entropy FROM jh")
def sc4_joint_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.joint_entropy(layers(spark, sf_dir), PAIRS))


@query(f"WITH {WIDE}, {_entropy_sql(LAYERS)}, {_joint_sql(PAIRS)} SELECT jh.layer_a, jh.layer_b, round(greatest(0.0, a.entropy + b.entropy - jh.entropy), 4) AS mi FROM jh JOIN h a ON jh.layer_a = a.layer JOIN h b ON jh.layer_b = b.layer")
def sc5_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.mutual_information(layers(spark, sf_dir), PAIRS))


@query(f"WITH {WIDE}, {_entropy_sql(LAYERS)}, {_joint_sql(PAIRS)}, m AS (SELECT sum(greatest(0.0, a.entropy + b.entropy - jh.entropy)) AS mi FROM jh JOIN h a ON jh.layer_a = a.layer JOIN h b ON jh.layer_b = b.layer) SELECT 3::INT AS layers, round(2.0 * 3 + 96 + greatest(0.0, (SELECT sum(entropy) FROM h) - mi) * 990, 2) AS mdl FROM m")
def sc6_mdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = scoring.mdl(layers(spark, sf_dir), LAYERS, ASSAY_GRID.n_voxels)
    return rounded(spark.createDataFrame([(len(LAYERS), value)], "layers int, mdl double"), 2)


@query(f"WITH {PLACED} SELECT CASE WHEN iz < 8 THEN CAST(floor(iz / 2) AS INT) ELSE 4 END AS fold, count(*)::BIGINT AS points FROM placed GROUP BY 1")
def sc7_depth_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays(spark, sf_dir).groupBy(scoring.depth_fold(F.col("iz"), 9).alias("fold")).agg(F.count("*").alias("points"))


@query()
def sc8_ridge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = scoring.ridge_cv(layers(spark, sf_dir), {"all": LAYERS}, ASSAY_GRID.shape[2])["all"]
    return rounded(spark.createDataFrame(sorted(errors.items()), "layer string, mse double"))


@query()
def sc10_evaluate_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paint_and_score(layers(spark, sf_dir), ["price", "quantity"], "items", ASSAY_GRID))


@query()
def sc12_marginal_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.marginal_contributions(layers(spark, sf_dir), LAYERS, ASSAY_GRID.shape[2], ASSAY_GRID.n_voxels)
    return rounded(spark.createDataFrame(sorted(found.items()), "layer string, contribution double"))


@query()
def sc13_layer_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.createDataFrame([(n, "float") for n in LAYERS], "layer string, dtype string")
    return scoring.layer_digest(rounded(scoring.long_layers(layers(spark, sf_dir), LAYERS)), index)


@query(f"WITH {PLACED}, c AS (SELECT i.range AS ix, j.range AS iy, k.range AS iz, (i.range * 11 + j.range) * 9 + k.range AS voxel_id FROM range(10) i, range(11) j, range(9) k) SELECT c.voxel_id::BIGINT AS voxel_id, c.ix::INT AS ix, c.iy::INT AS iy, c.iz::INT AS iz, count(p.voxel_id)::BIGINT AS points FROM c LEFT JOIN placed p ON c.voxel_id = p.voxel_id GROUP BY 1, 2, 3, 4")
def sp1_cells_with_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = assays(spark, sf_dir).groupBy("voxel_id").agg(F.count("*").alias("points"))
    cells = grid_cells(spark, ASSAY_GRID).select("voxel_id", "ix", "iy", "iz")
    return cells.join(points, "voxel_id", "left").select("voxel_id", "ix", "iy", "iz", *long_or_zero("points"))


def long_or_zero(*names: str) -> list:
    return [F.coalesce(c, F.lit(0)).alias(n) for n, c in zip(names, long(*names), strict=True)]
