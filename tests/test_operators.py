"""Operators on small hand-made tables against direct computations."""

import json
import math
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox import queries
from stratavox.functions import texts, uncertainty
from stratavox.grid import SURVEY_GRID, Grid, grid_cells
from stratavox.operators import experiments, explore, fields, graph, runlogs, scoring, spatial, training
from stratavox.queries import assays
from stratavox.streaming import logs

REPO = Path(__file__).resolve().parent.parent
GRID = Grid((0.0, 0.0, 0.0), (4.0, 3.0, 8.0), (4, 3, 8))


@pytest.fixture(scope="module")
def wide_rows():
    rng = np.random.default_rng(3)
    n = GRID.n_voxels
    a, b = rng.normal(size=n), rng.random(n)
    values = np.column_stack([a, b, 2 * a + 0.1 * rng.normal(size=n)])
    values[rng.random(values.shape) < 0.1] = np.nan
    return values


@pytest.fixture(scope="module")
def wide(spark, wide_rows):
    rows = [(k, k % 8, *[None if math.isnan(x) and k % 2 else float(x) for x in wide_rows[k]]) for k in range(len(wide_rows))]
    return spark.createDataFrame(rows, "voxel_id long, iz int, a double, b double, c double")


def direct_ridge(values, folds):
    done = ~np.isnan(values).any(axis=1)
    x, folds = values[done], folds[done]
    out = []
    for t in range(x.shape[1]):
        design = np.column_stack([np.ones(len(x)), np.delete(x, t, 1)])
        errors = []
        for f in range(5):
            train, test = folds != f, folds == f
            beta = np.linalg.solve(design[train].T @ design[train] + np.eye(design.shape[1]), design[train].T @ x[train, t])
            errors.append(((x[test, t] - design[test] @ beta) ** 2).mean())
        out.append(np.mean(errors))
    return out


def depth_folds(n):
    edges = [0, 0, 1, 1, 2, 2, 3, 4]
    return np.array([edges[k % 8] for k in range(n)])


def test_ridge_agrees_with_direct_fits(wide, wide_rows):
    names = ["a", "b", "c"]
    got = scoring.ridge_cv(wide, {"all": names, "two": ["a", "b"]}, 8)
    folds = depth_folds(len(wide_rows))
    assert np.allclose([got["all"][n] for n in names], direct_ridge(wide_rows, folds), rtol=1e-10)
    assert np.allclose([got["two"][n] for n in "ab"], direct_ridge(wide_rows[:, :2], folds), rtol=1e-10)


def test_layer_verdicts(wide, wide_rows):
    folds, n = depth_folds(len(wide_rows)), GRID.n_voxels
    bic = lambda v, k: n * math.log(sum(v) / k) + k * k * math.log(n)
    two, three = bic(direct_ridge(wide_rows[:, :2], folds), 2), bic(direct_ridge(wide_rows, folds), 3)
    verdict = scoring.evaluate_layer(wide, ["a", "b"], "c", 8, n)
    assert verdict["bic_delta"] == pytest.approx(three - two) and verdict["admitted"] == (three < two)
    assert scoring.evaluate_layer(wide, [], "a", 8, n)["admitted"]
    assert scoring.marginal_contributions(wide, ["a", "b", "c"], 8, n)["c"] == pytest.approx(two - three)
    assert scoring.joint_prediction_score({"a": 1.0}, n)["bic"] == 0.0
    assert scoring.joint_prediction_score({"a": 1.0, "b": math.inf}, n)["mean_mse"] == 0.5


def test_entropies_agree_with_numpy(spark, wide, wide_rows):
    def entropy(density, size):
        density = density[density > 0]
        return max(0.0, float(-(density * np.log2(density + 1e-10) * size).sum()))

    got = {r.layer: r.entropy for r in scoring.entropy_continuous(scoring.long_layers(wide, ["a", "b", "c"])).collect()}
    for k, name in enumerate("abc"):
        v = wide_rows[:, k][~np.isnan(wide_rows[:, k])]
        density, edges = np.histogram(v, 50, density=True)
        assert got[name] == pytest.approx(entropy(density, edges[1] - edges[0]))
    both = wide_rows[~np.isnan(wide_rows[:, [0, 2]]).any(axis=1)]
    density, x, y = np.histogram2d(both[:, 0], both[:, 2], 30, density=True)
    joint = scoring.joint_entropy(wide, [("a", "c")]).first().entropy
    assert joint == pytest.approx(entropy(density, (x[1] - x[0]) * (y[1] - y[0])))
    constant = spark.createDataFrame([("k", 1, 2.0), ("k", 2, 2.0), ("one", 1, 3.0)], "layer string, voxel_id long, value double")
    assert {r.entropy for r in scoring.entropy_continuous(constant).collect()} == {0.0}
    assert scoring.mdl(wide, [], 96) == 0.0 and scoring.mdl(wide, ["a"], 96) >= 33


def test_voxels(spark):
    rows = spark.createDataFrame([(117.9, -27.41, 40.0), (117.973493, -27.3, 80.0), (118.5, -27.4, 1.0), (None, -27.4, 1.0)], "lon double, lat double, depth_m double")
    got = spatial.coord_to_voxel(rows, SURVEY_GRID).collect()
    assert [r.in_range for r in got] == [True, True, False, False]
    assert (got[1].ix, got[1].iy, got[1].iz) == (199, 199, 7) and got[2].voxel_id is None
    assert grid_cells(spark, GRID).count() == 96
    back = spatial.voxel_to_coord(spatial.coord_to_voxel(rows, SURVEY_GRID).where("in_range").drop("lon", "lat", "depth_m"), SURVEY_GRID).first()
    assert abs(back.lon - 117.9) <= SURVEY_GRID.cell[0] / 2 + 1e-12


def test_spheres_and_lines(spark):
    point = spark.createDataFrame([(1, 117.92, -27.41, 45.0, 0.8, 100.0)], "op_id long, lon double, lat double, depth_m double, value double, radius_m double")
    got = {(r.ix, r.iy, r.iz) for r in spatial.rasterize_spheres(point, SURVEY_GRID).collect()}
    want, (cx, cy, cz) = set(), SURVEY_GRID.cell
    for ix in range(200):
        for iy in range(200):
            for iz in range(8):
                east = (117.832397 + (ix + 0.5) * cx - 117.92) * 111320 * math.cos(math.radians(-27.41))
                north = (-27.441096 + (iy + 0.5) * cy + 27.41) * 111320
                if math.sqrt(east**2 + north**2 + ((iz + 0.5) * cz - 45) ** 2) <= 100:
                    want.add((ix, iy, iz))
    assert got == want and got
    line = spark.createDataFrame([(1, 117.91, -27.407, 0.0, 117.911, -27.406, 0.1, 90.0), (2, 117.91, -27.4, 0.0, 119.0, -27.4, 1.0, 50.0)], "op_id long, lon0 double, lat0 double, depth0 double, lon1 double, lat1 double, depth1 double, width_m double")
    cells = spatial.rasterize_lines(line, SURVEY_GRID).collect()
    assert {r.op_id for r in cells} == {1} and len({r.voxel_id for r in cells}) == len(cells)


@pytest.mark.parametrize("rule", spatial.RULES)
def test_painting_in_order(spark, rule):
    rng = random.Random(5)
    ops = [("l", rng.randrange(6), k, rng.uniform(-2, 2)) for k in range(60)]
    base = {v: rng.uniform(-1, 1) for v in range(0, 8, 2)}
    step = {"replace": lambda a, x: x, "max": max, "add": lambda a, x: a + x, "mean": lambda a, x: (a + x) / 2}[rule]
    want = dict(base)
    for _, v, _, x in ops:
        want[v] = step(want.get(v, 0.0), x)
    frame = spark.createDataFrame(ops, "layer string, voxel_id long, seq long, value double")
    start = spark.createDataFrame([("l", v, x) for v, x in base.items()], "layer string, voxel_id long, value double")
    got = {r.voxel_id: r.value for r in spatial.paint_layer(frame, rule, start).collect()}
    mixed = {r.voxel_id: r.value for r in spatial.paint_mixed(frame.withColumn("rule", F.lit(rule)), start).collect()}
    assert got == pytest.approx(want) and mixed == pytest.approx(want)


def test_subcells(spark):
    cells = grid_cells(spark, GRID).limit(3)
    rows = spatial.subcell_samples(cells, GRID, 3).groupBy("voxel_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert all(r.n == 27 and r.w == pytest.approx(1.0) for r in rows)


def test_rates_and_tags(spark):
    calls = spark.createDataFrame([("m", "r", 1000.0, 500, True), ("m", "r", 10000.0, 100, True), ("m", "q", 0.0, 5, False)], "model string, run_id string, latency_ms double, completion int, success boolean")
    none = F.lit(None).cast("double")
    calls = calls.select("*", F.struct(F.lit(1).alias("prompt_tokens"), F.col("completion").alias("completion_tokens"), F.lit(None).cast("int").alias("total_tokens")).alias("usage"), none.alias("prompt_tokens_per_second"), none.alias("output_tokens_per_second"), none.alias("total_tokens_per_second"))
    got = runlogs.latency_by_model(calls.where("latency_ms > 0")).first()
    assert got.mean_output_rate == 255 and got.median_output_rate == 255 and got.output_throughput == pytest.approx(600 / 11)
    assert [r.output_rate for r in runlogs.generation_rates(calls).collect()] == [500, 10, None]
    tags = spark.createDataFrame([([" RTX 4090!", "rtx-4090", "--", None],)], "t array<string>").select(runlogs.normalise_tags(F.col("t")).alias("t")).first().t
    assert tags == ["rtx-4090"]


def test_scrapes(spark):
    body = '# HELP a\nvllm:kv_cache_usage_perc{model="x",note="a \\"b\\""} 0.42\nvllm:num_requests_running 2\n\nbad\nhist_bucket{le="+Inf"} 3 1700\nodd NaN\n'
    rows = runlogs.parse_scrapes(spark.createDataFrame([(1, body)], "id int, body string")).collect()
    assert [(r.name, r.value) for r in rows] == [("vllm:kv_cache_usage_perc", 42.0), ("vllm:num_requests_running", 2.0), ("hist_bucket", 3.0)]
    assert rows[0].labels["model"] == "x" and rows[1].gauge == "num_requests_running"


def test_texts(spark):
    rows = [("a ```json\n{}\n``` b ```Python\n x = 1 \n``` c",), ("no fence",), ("```\n\n```",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(texts.extract_code_block(F.col("t"), ["python"]).alias("n"), texts.extract_code_block(F.col("t"), ["python"], "no_fence").alias("f"), texts.extract_code_block(F.col("t"), ["python"], "raw").alias("r")).collect()
    assert [r.n for r in got] == ["x = 1", None, None, None] and got[1].f == got[1].r == "no fence" and got[2].f is None
    lists = spark.createDataFrame([('{"ideas": ["a", "b"]}', "- one\n* two\n 3. three\nnot", 'x {"a": "}"} y')], "j string, m string, o string")
    r = lists.select(texts.keyed_list(F.col("j"), "ideas").alias("j"), texts.markdown_items(F.col("m")).alias("m"), texts.first_balanced_object(F.col("o")).alias("o"), texts.first_json_object(F.col("o")).alias("f")).first()
    assert r.j == ["a", "b"] and r.m == ["one", "two", "three"] and json.loads(r.o) == json.loads(r.f) == {"a": "}"}
    para = lambda k: f"Paragraph {k} " + "word " * 30
    three = "\n\n".join([para(1), para(2), para(2), para(2)])
    apart = "\n\n".join([para("x" * 40), "y" * 150, para("x" * 40), "z" * 150, para("x" * 40)])
    got = spark.createDataFrame([(three,), (apart,), ("short\n\nshort\n\nshort",)], "t string").select(texts.detect_repetition(F.col("t")).alias("r"), texts.exact_repetition(F.col("t")).alias("e")).collect()
    assert (got[0].r.start, got[0].r.kind, got[0].e) == (0, "adjacent", 1) and got[1].r.kind == "window" and got[2].r.start is None


def test_rows_and_logs(spark):
    whole = "whole_episode"
    given = [("ep:1:0", "ep:1", "ep:1", None, whole), ("x", "e", "e", "ep:1:0", whole), ("x", "e", "e", "src", whole), ("y", "e", "f", "gone", None), ("", "e", "e", "", "turn"), ("z", None, None, None, whole)]
    rows = spark.createDataFrame(given, "row_id string, episode_id string, group_episode_id string, parent_row_id string, episode_score_scope string")
    rules = sorted((r.row_id, r.rule) for r in training.validate_rows(rows, ["episode_id"], spark.createDataFrame([("src",)], "row_id string")).collect())
    assert rules == [("", "bad_parent"), ("", "bad_row_id"), ("", "bad_scope"), ("x", "duplicate_row_id"), ("y", "bad_scope"), ("y", "episode_mismatch"), ("y", "unknown_parent"), ("z", "missing_field")]
    claims = spark.createDataFrame([(1, "claimed", 2, 3, "c"), (2, "claimed", 3, 3, "c"), (3, "queued", 0, 3, None)], "k int, status string, retry_count int, max_retries int, claim_id string").withColumn("lease_expires_at", F.lit("2020-01-01").cast("timestamp"))
    assert [(r.status, r.retry_count, r.claim_id) for r in logs.expire_leases(claims, F.lit("2021-01-01").cast("timestamp")).orderBy("k").collect()] == [("queued", 3, None), ("failed", 3, "c"), ("queued", 0, None)]
    with pytest.raises(Exception, match="row without step"):
        training.keep_workflow_steps(spark.createDataFrame([("a", None)], "row_id string, step string"), ["x"]).collect()
    log = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "pos long, uri string, status string")
    assert {r.uri: r.status for r in logs.latest_records(log).collect()} == {"a": "z", "b": "y"}
    merged = logs.merge_latest(log.where("pos = 3"), logs.merge_latest(log.where("pos < 3"), None))
    assert {r.uri: r.status for r in merged.collect()} == {"a": "z", "b": "y"}


def test_published_exports(spark, tmp_path):
    rows = spark.createDataFrame([("e:0", "p"), ("e:1", "q")], "row_id string, prompt string")
    first = training.publish_rows(rows, f"file://{tmp_path}")
    second = training.publish_rows(rows, f"file://{tmp_path}")
    latest = spark.read.json(f"file://{tmp_path}/latest").first()
    assert first != second == latest.export_id and latest.rows == 2
    hashes = {latest.content_hash}
    for change, new in ((rows.orderBy(F.desc("row_id")), 0), (rows.limit(1), 1), (rows.unionAll(rows), 1), (rows.limit(0), 1)):
        training.publish_rows(change, f"file://{tmp_path}")
        hashes.add(spark.read.json(f"file://{tmp_path}/latest").first().content_hash)
        assert new or len(hashes) == 1
    assert len(hashes) == 4
    assert spark.read.json(f"file://{tmp_path}/exports/{first}").count() == 2


def test_uncertainty(spark):
    rows = [('{"mean": 5, "std": 0.6}', "gaussian", True, 5.0, 0.36), ('{"mean": 5, "std": 0}', "gaussian", False, 5.0, 0.0), ('{"lo": 2, "hi": 4}', "interval", True, 3.0, None), ('{"probs": {"a": 0.4, "b": 0.6}}', "categorical", True, None, None), ('{"probs": {"a": 0.4}}', "categorical", False, None, None), ('{"dip_mean": 95, "dip_kappa": 2, "azimuth_mean": 1, "azimuth_kappa": 3}', "orientation", False, None, None), ('{"name": "beta", "params": {"a": 2, "b": 2}}', "distribution", True, 0.5, 0.05)]
    got = spark.createDataFrame(rows, "t string, k string, v boolean, n double, s double").select("*", uncertainty.parse_uncertainty(F.col("t")).alias("u")).select("*", uncertainty.nominal(F.col("u")).alias("n2"), uncertainty.variance(F.col("u")).alias("s2"), uncertainty.nominal_category(F.col("u")).alias("c")).collect()
    for r in got:
        assert (r.u.kind, r.u.valid) == (r.k, r.v) and r.n2 == r.n and (r.s is None and r.s2 is None or r.s2 == pytest.approx(r.s))
    assert got[3].c == "b"


def test_described_columns(spark):
    """Exact quantiles without a percentile over a whole column in one task."""
    rows = [(None if k % 11 == 0 else float(k * k % 97), k % 3, None) for k in range(400)]
    got = explore.describe_columns(spark.createDataFrame(rows, "a double, b int, c double").repartition(3), ["a", "b", "c"])
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r.column_name: r for r in got.collect()}
    for name, values in (("a", [r[0] for r in rows if r[0] is not None]), ("b", [r[1] for r in rows])):
        r = found[name]
        assert (r.n, r.min, r.max, r.mean, r.std) == (len(values), min(values), max(values), pytest.approx(np.mean(values)), pytest.approx(np.std(values, ddof=1)))
        assert [r.q25, r.q50, r.q75] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())
    assert (found["c"].n, found["c"].q50, found["c"].max) == (0, None, None)


def test_lines_are_dealt_out(spark):
    """All samples of a file's lines were made in the task that reads it."""
    line = spark.createDataFrame([(k, 117.85, -27.43, 5.0, 117.85 + k / 1000, -27.42, 9.0, 900.0) for k in range(12)], "op_id long, lon0 double, lat0 double, depth0 double, lon1 double, lat1 double, depth1 double, width_m double").coalesce(1)
    voxels = spatial.rasterize_lines(line, SURVEY_GRID)
    assert "Repartition" in voxels._jdf.queryExecution().optimizedPlan().toString()
    cells = voxels.collect()
    assert len({r.op_id for r in cells}) == 12 and len({(r.op_id, r.voxel_id) for r in cells}) == len(cells)
    assert all(r.voxel_id == (r.ix * 200 + r.iy) * 8 + r.iz for r in cells)


def sampled_voxels(start, end, radius, grid):
    """Voxels of a line, every sample in turn; none if a sample is out of range."""
    start, end = np.array(start), np.array(end)
    centres = [grid.origin[a] + (np.arange(grid.shape[a]) + 0.5) * grid.cell[a] for a in range(3)]
    n = max(10, int(np.linalg.norm(end - start) * 1000))
    at = start + (np.arange(n) / (n - 1))[:, None] * (end - start)
    found = set()
    if (at < grid.origin).any() or (at > grid.maximum).any():
        return found
    for p in np.array_split(at, n // 1000 + 1):
        east = (centres[0] - p[:, :1]) * 111320 * np.cos(np.radians(p[:, 1:2]))
        north, down = (centres[1] - p[:, 1:2]) * 111320, centres[2] - p[:, 2:]
        i, j, k = (np.flatnonzero((np.abs(x) <= radius).any(axis=0)) for x in (east, north, down))
        met = (np.sqrt(east[:, i, None, None] ** 2 + north[:, None, j, None] ** 2 + down[:, None, None, k] ** 2) <= radius).any(axis=0)
        found |= {int((i[a] * grid.shape[1] + j[b]) * grid.shape[2] + k[c]) for a, b, c in zip(*np.nonzero(met), strict=True)}
    return found


def test_lines_go_to_the_next_point(spark, tmp_path):
    """The query's lines ended after a hundredth of their fall."""
    spark.createDataFrame([(k, "s", 1, 1.0) for k in range(58, 64)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    place = {r.op_id: (r.lon, r.lat, r.depth_m) for r in assays.map_points(spark, str(tmp_path)).collect()}
    got = {r.op_id: r.voxels for r in assays.sp6_lines(spark, str(tmp_path)).collect()}
    assert got == {k: len(sampled_voxels(place[k], place[k + 1], 150.0, assays.MAP_GRID)) for k in range(58, 63)}


def test_lines_as_sampled(spark):
    """Voxels that only some of many samples reach, with cosines that change along a line, are those of all samples."""
    rng = np.random.default_rng(3)
    wide = Grid((-10.0, -60.0, 0.0), (10.0, 85.0, 50.0), (20, 30, 6))
    for grid, radii in ((SURVEY_GRID, (5.0, 60.0, 300.0)), (wide, (2000.0, 200000.0, 900000.0))):
        low, high = np.array(grid.origin), np.array(grid.maximum)
        start, end = (low + rng.random((12, 3)) * (high - low) for _ in range(2))
        end[0], end[1, :2], end[2, 2], end[3, 1], end[4] = start[0], start[1, :2], start[2, 2], start[3, 1], start[4] + 1e-6 * (end[4] - start[4])
        start[5], end[6] = low, high
        start[7], end[7] = low + np.array(grid.cell) / 2, low + np.array(grid.cell) * [3.5, 0.5, 0.5]
        width = 2 * rng.choice(radii, 12)
        width[7], width[8] = 2 * grid.cell[1] * 111320, 0.0
        lines = spark.createDataFrame([(f"l{k}", *map(float, start[k]), *map(float, end[k]), float(width[k])) for k in range(12)], "name string, lon0 double, lat0 double, depth0 double, lon1 double, lat1 double, depth1 double, width_m double")
        got = {}
        for r in spatial.rasterize_lines(lines, grid).collect():
            got.setdefault(r.name, []).append(r.voxel_id)
        assert {k: sorted(v) for k, v in got.items()} == {f"l{k}": sorted(v) for k in range(12) if (v := sampled_voxels(start[k], end[k], width[k] / 2, grid))}


def test_graphs(spark):
    links = [("g", "e1", 1, "overlies", "a", "b"), ("g", "e2", 2, "overlies", "b", "c"), ("h", "e3", 1, "overlies", "x", "y"), ("h", "e4", 2, "overlies", "y", "x"), ("h", "e5", 3, "overlies", "x", "z")]
    edges = spark.createDataFrame(links, "graph_id string, edge_id string, edge_seq int, kind string, source string, target string")
    assert {(r.graph_id, r.node) for r in graph.overlies_cycles(edges).collect()} == {("h", "x"), ("h", "y")}
    units = spark.createDataFrame([("g", u, None, k) for k, u in enumerate("cbad")] + [("f", "q", 2, 0), ("f", "p", 1, 1)], "graph_id string, unit string, chronology_rank int, unit_seq int")
    order = [(r.graph_id, r.unit) for r in graph.stratigraphic_order(units, edges).orderBy("graph_id", "rank").collect()]
    assert order == [("f", "q"), ("f", "p"), ("g", "a"), ("g", "b"), ("g", "c"), ("g", "d")]
    contacts = spark.createDataFrame([("g", "a", "b", 5.0), ("g", "b", "c", 6.0)], "graph_id string, upper string, lower string, z double")
    got = {r.graph_id: r.feasible for r in graph.stratigraphic_constrain(contacts, graph.stratigraphic_order(units, edges)).collect()}
    assert got == {"g": False, "f": True}


def test_fields(spark):
    def one(p, inside=True):
        return spark.createDataFrame([(0, inside, p)], "voxel_id long, in_domain boolean, probs array<double>")

    loss = lambda p, q, **k: fields.divergence(fields.align_fields(one(p), one(q), ["u", "v"], ["u", "v"]), **k).first().loss
    assert loss([0.5, 0.5], [1.0, 0.0]) == pytest.approx(0.0)
    assert loss([1.0, 0.0], [0.0, 1.0], epsilon=0.01) == pytest.approx(math.log2(100), rel=1e-2)
    half = spark.createDataFrame([(k, k < 2) for k in range(4)], "voxel_id long, in_domain boolean")
    assert fields.coverage(half.withColumn("in_domain", F.lit(True)), half).first().coverage == 0.5
    planes = spark.createDataFrame([("p", x, y, 2 * x - y + 3) for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0)] + [("flat", 1.0, 1.0, z) for z in (0.0, 1.0, 2.0)], "pair string, x double, y double, z double")
    got = {r.pair: r for r in fields.fit_planes(planes).collect()}
    assert (got["p"].a, got["p"].b, got["p"].c) == pytest.approx((2, -1, 3)) and got["flat"].a is None
    with pytest.raises(Exception, match="fewer than three contacts"):
        fields.fit_planes(planes.where("pair = 'flat'").limit(2)).collect()
    blob = [(x, y, z, 0 if (x, y) in ((0, 0), (0, 1), (3, 2)) and z < 3 else 1) for x in range(4) for y in range(3) for z in range(8)]
    frame = spark.createDataFrame(blob, "ix int, iy int, iz int, most_likely int")
    assert [(r.unit, r.blobs) for r in fields.check_orphan_blobs(frame, GRID).collect()] == [(0, 2)]


def test_thresholds_and_early_ends(spark):
    counters = [(1.0, 2, 9, 0), (5.0, 3, 1, 0), (5.0, 3, 2, 0), (5.0, 3, 2, 5), (5.0, 3, None, 5), (3.0, 9, 9, 50)]
    frame = spark.createDataFrame(counters, "score double, pool_size int, episode_count int, admission_count int")
    got = [(r.threshold, r.admitted) for r in fields.annealed_thresholds(frame, 8.0, 4.0, 10, 3, 2).collect()]
    inf = math.inf
    assert got == [(inf, True), (inf, True), (8.0, True), (6.0, True), (inf, True), (4.0, True)]
    assert fields.annealed_thresholds(frame, 8.0, 4.0, 0, 0, 0).first().threshold == 4.0
    ends = spark.createDataFrame([("wall_clock", "late"), ("wall_clock", None), ("done", "fine"), (None, "repetition_collapse")], "termination_category string, termination_reason string")
    assert [(r.partial, r.category, r.reason) for r in runlogs.termination_flags(ends).collect()] == [(True, "wall_clock", "late"), (True, "wall_clock", None), (False, None, None), (False, None, None)]


def test_training_pair_without_parts(spark):
    row = [("e", "h", None, "{}", "r", None, None, None, None, None)]
    frame = spark.createDataFrame(row, "experiment_id string, hypothesis string, rationale string, data_spec string, result_summary string, bic_delta double, cv_mse_delta double, feature_layer_name string, admitted boolean, predicted_value double")
    got = experiments.training_pairs(frame).first()
    assert got.prompt == "Hypothesis: h" and got.response == "Analysis result: r\nConclusion: Hypothesis not supported or redundant. Feature not added."
    assert experiments.rewrite_record(frame).first().response == got.response


def test_every_query_with_sql_matches_it(spark, sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def plain(x):
        if isinstance(x, float):
            return round(x, 2) + 0.0
        if isinstance(x, list):
            return tuple(map(plain, x))
        return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, sf_dir)
        names = sorted(found.columns)
        result = con.execute(sql)
        order = [[d[0] for d in result.description].index(n) for n in names]
        want = sorted((tuple(plain(row[k]) for k in order) for row in result.fetchall()), key=str)
        got = sorted((tuple(plain(row[n]) for n in names) for row in found.collect()), key=str)
        assert len(got) == len(want), name
        close = [all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 0.02) for a, b in zip(x, y, strict=True)) for x, y in zip(got, want, strict=True)]
        assert all(close), name


def test_entry_works_without_the_corpus_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()) > 60, 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "False"], out.stderr


@pytest.mark.parametrize("orthogonal", [True, False])
def test_best_pairs_equal_those_of_all_pairs(spark, orthogonal):
    """More rows than are paired at first, negative information, ties, tried pairs and nulls."""
    rng = random.Random(5)
    rows = []
    for k in range(160):
        info = {f"l{rng.randrange(160)}": rng.choice([-3.0, 0.5, 2.0]) for _ in range(4)}
        parents = [f"e{rng.randrange(8):03}" for _ in range(2)] if k % 3 == 0 else None
        rows.append((f"e{k:03}", f"l{k}", None if k % 11 == 0 else float(rng.randrange(30)), k % 7 > 0, -float(rng.randrange(1, 40)), info if k % 5 else None, parents))
    table = spark.createDataFrame(rows, "experiment_id string, feature_layer_name string, predicted_value double, admitted boolean, bic_delta double, mutual_info map<string, double>, parent_experiments array<string>")
    tried = {tuple(sorted(set(r[6]))) for r in rows if r[6] and len(set(r[6])) == 2}
    pairs = []
    good = [r for r in rows if r[3]]
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            shared = ((a[5] or {}).get(b[1], 0.0) + (b[5] or {}).get(a[1], 0.0)) / 2 if orthogonal else 0.0
            x, y = a[2] or 0.0, b[2] or 0.0
            if (a[0], b[0]) not in tried:
                pairs.append((-(x + y - shared), -max(x, y), *((b[0], a[0]) if y > x else (a[0], b[0])), a[0], b[0]))
    want = [(p[2], p[3], -p[0]) for p in sorted(pairs, key=lambda p: (p[0], p[1], p[4], p[5]))[:5]]
    assert [(r.a, r.b, r.score) for r in experiments.crossbreed_pairs(table, 5, orthogonal).collect()] == want
    index = spark.createDataFrame([("e001_e002", -90.0, 1), ("e003_e004", -200.0, 1), ("e003_e004", 5.0, 2)], "pair_id string, mi double, pos int")
    best = experiments.crossbreed_best(table, index).first()
    assert (best.a, best.b, best.score) == ("e001", "e002", 90 - rows[1][4] - rows[2][4])
    top = sorted((r[4], r[0]) for r in rows)[:2]
    best = experiments.crossbreed_best(table, index.where("mi > 0")).first()
    assert best.score == -top[0][0] - top[1][0]
    assert experiments.crossbreed_pairs(table.limit(0)).count() == 0 and experiments.crossbreed_best(table.limit(0), index.limit(0)).count() == 0
