"""Suppliers, nations and regions as uncertain graphs: values, draws, realisations and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import uncertainty
from ..functions.draws import uniform_sql
from ..operators import realise
from .common import registry, rounded, table

QUERIES, ORACLES, query = registry()

SEED = 7
#: Uncertain values of parts by p_partkey % 14, with their texts: %(s)s is the size, %(v)s the price.
VALUES = [
    '{"value": %(v)s}', '{"mean": %(v)s, "std": %(s)s}', '{"lo": %(s)s, "hi": %(v)s}', '{"probs": {"a": 0.2, "b": 0.5, "c": 0.3}}', '{"name": "uniform", "params": {"loc": %(s)s, "scale": 4}}',
    '{"name": "uniform", "params": {"lo": %(s)s, "hi": 60}}', '{"name": "triangular", "params": {"left": 0, "c": %(s)s, "right": 60}}', '{"name": "triangular", "params": {"hi": 2}}', '{"name": "lognormal", "params": {"mean": 0.5, "s": 0.25}}',
    '{"name": "lognormal", "params": {"scale": %(s)s}}', '{"kind": "Interval", "value": 1, "lo": %(s)s, "hi": 100}', '{"kind": "Point", "value": %(s)s, "mean": 1, "std": 2}', '{"name": "beta", "params": {"alpha": 2, "beta": 3, "lo": 1, "hi": %(s)s}}', '{"name": "truncnorm", "params": {"loc": %(s)s}}',
]
S, V = "p_size::DOUBLE", "p_retailprice"
NOMINAL = [V, V, f"({S} + {V}) / 2", "NULL", f"{S} + 2", f"({S} + 60) / 2", S, "0.5", "exp(0.5) * exp(0.0625 / 2)", f"{S} * exp(0.5)", f"({S} + 100) / 2", S, f"1 + ({S} - 1) * 2 / 5.0", S]
#: The truncated normal ends two deviations off its mean: its variance is that of the standard one between -2 and 2.
VARIANCE = [
    "0", f"{S} * {S}", "NULL", "NULL", "16 / 12.0", f"(60 - {S}) * (60 - {S}) / 12", f"({S} * {S} + 3600 - 60 * {S}) / 18", "(0.25 + 4 - 1) / 18", "(exp(0.0625) - 1) * exp(1.0) * exp(0.0625)", f"(exp(1) - 1) * {S} * {S} * exp(1)",
    "NULL", "0", f"({S} - 1) * ({S} - 1) * 6 / (25 * 6.0)", "0.7737413",
]


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a parsed uncertain value ``u``."""
    text = F.get(F.array(*map(F.lit, VALUES)), (F.col("p_partkey") % len(VALUES)).cast("int"))
    for mark, name in (("%(s)s", "p_size"), ("%(v)s", "p_retailprice")):
        text = F.replace(text, F.lit(mark), F.col(name).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", uncertainty.parse_uncertainty(text).alias("u"))


def _case(parts: list[str]) -> str:
    return f"CASE p_partkey % {len(VALUES)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(parts)) + " END"


@query(f"SELECT p_partkey, round({_case(NOMINAL)}, 4) AS nominal FROM part")
def un2_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values(spark, sf_dir).select("p_partkey", uncertainty.nominal(F.col("u")).alias("nominal")))


@query(f"SELECT p_partkey, round({_case(VARIANCE)}, 4) AS variance FROM part")
def un3_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values(spark, sf_dir).select("p_partkey", uncertainty.variance(F.col("u")).alias("variance")))


def _normal(*key: str) -> str:
    return f"sqrt(-2 * ln(1 - {uniform_sql(SEED, *key, repr('0'))})) * cos(2 * pi() * {uniform_sql(SEED, *key, repr('1'))})"


TRIANGLE = "CASE WHEN x * (hi - lo) < mode - lo THEN lo + sqrt(x * (hi - lo) * (mode - lo)) ELSE hi - sqrt((1 - x) * (hi - lo) * (hi - mode)) END"
DRAWN = ["v", "v + s * z", "s + (v - s) * x", "NULL", "s + 4 * x", "s + (60 - s) * x", TRIANGLE, TRIANGLE, "exp(0.5 + 0.25 * z)", "exp(ln(s) + z)", "s + (100 - s) * x", "s"]


@query(
    f"WITH d AS (SELECT p_partkey, {S} AS s, {V} AS v, {uniform_sql(SEED, 'p_partkey', repr('0'))} AS x, {_normal('p_partkey')} AS z, CASE p_partkey % 14 WHEN 7 THEN 2.0 ELSE 60.0 END AS hi, 0.0 AS lo, CASE p_partkey % 14 WHEN 7 THEN 0.5 ELSE {S} END AS mode FROM part WHERE p_partkey % 14 < 12) "
    f"SELECT p_partkey, round({_case(DRAWN)}, 4) AS number, CASE WHEN p_partkey % 14 = 3 THEN CASE WHEN x < 0.2 THEN 'a' WHEN x < 0.7 THEN 'b' ELSE 'c' END END AS category FROM d"
)
def un4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of all kinds whose inverse has a closed form; the others are tested by their moments."""
    drawn = values(spark, sf_dir).where(f"p_partkey % {len(VALUES)} < 12").select("p_partkey", uncertainty.sample(F.col("u"), SEED, "p_partkey").alias("x"))
    return rounded(drawn.select("p_partkey", "x.number", "x.category"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as graphs: nations are places and units, suppliers samples (odd) and contacts (even), each nation has a fault through its contacts."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").cast("long").alias("k"))
    nation = nation.withColumn("next", F.lead("k").over(Window.partitionBy("graph_id").orderBy("k")))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("k"), F.round("s_acctbal", 2).cast("string").alias("b")).join(F.broadcast(nation), "k")
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    text = lambda pattern, *fields: F.format_string(pattern, *[F.col(f).cast("string") for f in fields]) if fields else F.lit(pattern)
    names = F.lit(None).cast("array<string>")
    at = F.array(text('{"mean": %s, "std": 2}', "k"), text('{"value": %s}', "k"), text('{"lo": 0, "hi": 4}'))
    high = F.array(text('{"value": %s}', "b"), text('{"value": 0}'), text('{"mean": %s, "std": 0.6}', "height"))
    chance = F.when(F.col("i") % 6 < 2, F.lit(0.0)).when(F.col("i") % 6 < 4, F.lit(1.0)).otherwise(0.8)

    def rows(df: DataFrame, node_id: Column, seq: str, kind: str, p: Column, unit: Column = F.lit(None), between: Column = names, points: Column = names, position: Column = names, value: Column = F.lit(None)) -> DataFrame:  # noqa: B008
        return df.select("graph_id", node_id.alias("node_id"), F.col(seq).cast("long").alias("node_seq"), F.lit(kind).alias("kind"), unit.cast("string").alias("unit_id"), between.alias("between"), points.alias("surface_points"), position.alias("position"), value.cast("string").alias("value"), p.cast("double").alias("p_exists"))

    contacts = s.where("i % 2 = 0 and next is not null").withColumn("height", 100 - F.col("k"))
    points = s.where("i % 2 = 0").groupBy("graph_id", "k").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: F.concat(F.lit("c"), x.cast("string"))).alias("points"))
    parts = [
        rows(nation, name("p", "k"), "k", "location", F.lit(0.9), position=at), rows(nation, name("u", "k"), "k", "stratigraphic_unit", F.when(F.col("k") % 5 == 3, 0.6).otherwise(1.0), unit=name("u", "k")),
        rows(s.where("i % 2 = 1"), name("s", "i"), "i", "sample", chance, value=text('{"value": %s}', "b")), rows(contacts, name("c", "i"), "i", "contact", F.when(F.col("i") % 6 == 4, 0.7).otherwise(1.0), between=F.array(name("u", "k"), name("u", "next")), position=high),
        rows(points, name("f", "k"), "k", "fault", F.lit(1.0), points=F.col("points")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.withColumns({"position": F.transform("position", uncertainty.parse_uncertainty), "value": uncertainty.parse_uncertainty(F.col("value"))})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples at their nation's place; units over the next one of their region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").cast("long").alias("k"))
    over = nation.withColumn("next", F.lead("k").over(Window.partitionBy("graph_id").orderBy("k"))).where("next is not null")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("k")).join(F.broadcast(nation), "k")
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    row = lambda df, edge, seq, kind, a, b, p: df.select("graph_id", edge.alias("edge_id"), F.col(seq).alias("edge_seq"), F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"), p.alias("p_exists"))
    at = row(s, name("a", "i"), "i", "at", name("s", "i"), name("p", "k"), F.when(F.col("i") % 7 == 0, 0.5).otherwise(1.0))
    return at.unionAll(row(over, name("o", "k"), "k", "overlies", name("u", "k"), name("u", "next"), F.lit(1.0)))


RUNS = 4
BASE = f"""
n AS (SELECT n_regionkey AS g, n_nationkey::BIGINT AS k, lead(n_nationkey::BIGINT) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx FROM nation),
r AS (SELECT range::INT AS r FROM range(@RUNS)),
s AS (SELECT s_suppkey::BIGINT AS i, s_nationkey::BIGINT AS k, round(s_acctbal, 2) AS b, g, nx FROM supplier JOIN n ON n.k = s_nationkey),
places AS (SELECT g, r, k, 'p' || k AS id FROM n, r WHERE {uniform_sql(SEED, 'g', 'r', repr('node'), "'p' || k")} <= 0.9),
units AS (SELECT g, r, k, 'u' || k AS id FROM n, r WHERE {uniform_sql(SEED, 'g', 'r', repr('node'), "'u' || k")} <= CASE WHEN k % 5 = 3 THEN 0.6 ELSE 1.0 END),
samples AS (SELECT s.*, r, 's' || i AS id FROM s, r WHERE i % 2 = 1 AND {uniform_sql(SEED, 'g', 'r', repr('node'), "'s' || i")} <= CASE WHEN i % 6 < 2 THEN 0 WHEN i % 6 < 4 THEN 1 ELSE 0.8 END),
contacts AS (
  SELECT c.g, c.r, c.i, c.k, c.b, c.id FROM (SELECT s.*, r, 'c' || i AS id FROM s, r WHERE i % 2 = 0 AND nx IS NOT NULL AND {uniform_sql(SEED, 'g', 'r', repr('node'), "'c' || i")} <= CASE WHEN i % 6 = 4 THEN 0.7 ELSE 1.0 END) c
  JOIN units a ON a.g = c.g AND a.r = c.r AND a.k = c.k JOIN units b ON b.g = c.g AND b.r = c.r AND b.k = c.nx),
faults AS (SELECT g, r, k, 'f' || k AS id, count(*) AS m FROM contacts GROUP BY ALL HAVING count(*) >= 3),
stays AS (SELECT s.g, s.r, s.i, s.k, s.b, s.id FROM samples s JOIN places p ON p.g = s.g AND p.r = s.r AND p.k = s.k WHERE {uniform_sql(SEED, 's.g', 's.r', repr('edge'), "'a' || s.i")} <= CASE WHEN i % 7 = 0 THEN 0.5 ELSE 1.0 END)
"""


@query(
    f"WITH {BASE.replace('@RUNS', str(RUNS))}, x AS (SELECT g, r, id, k + 2 * {_normal('g', 'r', 'id', repr('position0'))} AS x, k FROM places) "
    "SELECT g AS graph_id, r AS realisation, id, round(x, 4) AS x, 0::BIGINT AS points FROM x UNION ALL SELECT g, r, id, NULL, 0 FROM units UNION ALL SELECT g, r, id, NULL, m FROM faults UNION ALL SELECT g, r, id, round(b, 4), 0 FROM contacts "
    "UNION ALL SELECT a.g, a.r, a.id, round(x.x, 4), 0 FROM stays a JOIN x ON x.g = a.g AND x.r = a.r AND x.k = a.k UNION ALL SELECT g, r, 'a' || i, NULL, 0 FROM stays "
    "UNION ALL SELECT u.g, u.r, 'o' || u.k, NULL, 0 FROM units u JOIN n ON n.g = u.g AND n.k = u.k JOIN units v ON v.g = u.g AND v.r = u.r AND v.k = n.nx"
)
def gr11_realise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of four realisations of each region, with their drawn first coordinate; probabilities of 0, of 1 and between."""
    n = nodes(spark, sf_dir)
    attempts = n.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("realisation"))
    kept, links = realise.realise(n, edges(spark, sf_dir), attempts, SEED)
    points = F.when(F.col("kind") == "fault", F.size("surface_points")).otherwise(0).cast("long")
    out = kept.select("graph_id", "realisation", F.col("node_id").alias("id"), F.get("point", F.lit(0)).alias("x"), points.alias("points"))
    return rounded(out.unionAll(links.select("graph_id", "realisation", F.col("edge_id").alias("id"), F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("points"))))


FIRST = 5


@query(
    f"WITH {BASE.replace('@RUNS', str(2 * FIRST))}, z AS (SELECT c.g, c.r, c.k, avg(100 - c.k + 0.6 * {_normal('g', 'r', 'id', repr('position2'))}) AS z FROM contacts c GROUP BY ALL), "
    # A place in the order counts if its unit and the next unit left in the region are neighbours in the table.
    "falls AS (SELECT g, r, z < lag(z) OVER (PARTITION BY g, r ORDER BY k) AS ok FROM z), "
    "ok AS (SELECT n.g, r.r, coalesce((SELECT bool_and(coalesce(ok, true)) FROM falls f WHERE f.g = n.g AND f.r = r.r), true) AS ok FROM (SELECT DISTINCT g FROM n) n, r), "
    f"c AS (SELECT *, sum(ok::INT) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok), m AS (SELECT * FROM c WHERE coalesce(before, 0) < {FIRST}) "
    "SELECT g AS graph_id, count(*) FILTER (WHERE ok)::INT AS accepted, count(*) FILTER (WHERE NOT ok)::INT AS rejected, max(r)::INT FILTER (WHERE ok) AS last, (SELECT count(*) FROM contacts x SEMI JOIN m m2 ON m2.g = x.g AND m2.r = x.r AND m2.ok WHERE x.g = m.g)::BIGINT AS contacts FROM m GROUP BY g"
    .replace("max(r)::INT FILTER (WHERE ok)", "(max(r) FILTER (WHERE ok))::INT")
)
def fb13_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five feasible realisations of each region within ten attempts: accepted, rejected, the last accepted one, contacts in all."""
    kept, _, report = realise.ensemble(nodes(spark, sf_dir), edges(spark, sf_dir), FIRST, SEED)
    found = kept.groupBy("graph_id").agg(F.max("realisation").alias("last"), F.count_if(F.col("kind") == "contact").alias("contacts"))
    return report.join(found, "graph_id", "left").select("graph_id", "accepted", "rejected", "last", F.coalesce("contacts", F.lit(0)).alias("contacts"))
