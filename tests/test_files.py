"""Sources and sinks, and structural comparison, on small tables."""

import hashlib
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.grid import Grid, grid_cells
from stratavox.operators import refine, runlogs
from stratavox.queries import reports
from stratavox.sources import files

GRID = Grid((0.0, 0.0, 0.0), (2.0, 2.0, 3.0), (2, 2, 3))


def test_layer_store(spark, tmp_path):
    store = files.LayerStore(spark, f"file://{tmp_path}/store", GRID)
    cells = grid_cells(spark, GRID).select("ix", "iy", "iz", (F.col("voxel_id") * 0.5).alias("value"))
    assert store.list_layers().count() == 0
    store.write_layer(cells, "one")
    with pytest.raises(ValueError, match="exists"):
        store.write_layer(cells, "one")
    with pytest.raises(ValueError, match="fill"):
        store.write_layer(cells.limit(3), "two")
    assert [r.layer for r in store.list_layers().collect()] == ["one"]
    assert store.read_layer("one").agg(F.sum("value")).first()[0] == 33.0
    store.drop_layer("one")
    with pytest.raises(KeyError):
        store.read_layer("one")
    store.write_layer(cells, "one")
    assert store.read_layer("one").count() == 12


def test_arrays_there_and_back(spark):
    nested = [[[float(x * 100 + y * 10 + z) for z in range(3)] for y in range(2)] for x in range(2)]
    flat = [v for a in nested for b in a for v in b]
    cells = files.layer_from_array(spark.createDataFrame([("l", nested)], "layer string, values array<array<array<double>>>"), GRID)
    same = files.layer_from_array(spark.createDataFrame([("l", flat)], "layer string, values array<double>"), GRID, nested=False)
    key = lambda df: sorted((r.voxel_id, r.value) for r in df.collect())
    assert key(cells) == key(same) == list(enumerate(flat))
    assert [r["values"] for r in files.layer_to_array(cells).orderBy("ix").collect()] == nested


def test_logs_and_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "metrics_1.jsonl").write_text('{"metric_type": "inference", "run_id": "r", "usage": {"prompt_tokens": 3}}\n\n[1]\nnot json\n')
    (tmp_path / "a" / "other.jsonl").write_text('{"metric_type": "x"}\n')
    assert [r.usage.prompt_tokens for r in files.read_metrics(spark, f"file://{tmp_path}/a").collect()] == [3]
    for k in "12":
        (tmp_path / "runs" / k).mkdir(parents=True)
        (tmp_path / "runs" / k / "run.json").write_text(json.dumps({"run_id": "r", "status": f"s{k}"}, indent=1))
    assert [(r.run_id, r.status) for r in files.read_runs(spark, f"file://{tmp_path}/runs", "run_id string, status string").collect()] == [("r", "s2")]
    (tmp_path / "episodes.jsonl").write_text('{"episode_id": "e", "space_freed_kb": 4.5, "action_count": 2}\n')
    e = files.read_episodes(spark, f"file://{tmp_path}/episodes.jsonl", "episode_id string, score double, space_freed_kb double, action_count int").first()
    assert (e.score, e.llm_turns, e.gpu_util_peak) == (4.5, 2, None)
    (tmp_path / "g.json").write_text(json.dumps({"graph_id": "g", "nodes": [{"id": "u", "kind": "Unit"}], "edges": [{"id": "e", "kind": "OVERLIES", "source": "u", "target": "v"}]}))
    nodes, edges = files.read_graph_docs(spark, f"file://{tmp_path}/g.json")
    assert (nodes.first().node_id, nodes.first().kind, edges.first().kind, nodes.first().p_exists) == ("u", "stratigraphic_unit", "overlies", 1.0)


def test_manifests(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("a")
    (tmp_path / "x" / "b.txt").write_text("b")
    before = files.file_manifest(spark, f"file://{tmp_path}/x")
    old = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "x" / "b.txt").write_text("bb")
    (tmp_path / "x" / "c.txt").write_text("c")
    drift = files.dataset_drift(old, files.file_manifest(spark, f"file://{tmp_path}/x"))
    assert {(r.path, r.change) for r in drift.collect()} == {("b.txt", "changed"), ("c.txt", "added")}


def test_derived_scalars(spark):
    field = spark.createDataFrame([(0, {"a": 1.0}), (1, None)], "voxel_id long, derived map<string,double>")
    channels = spark.createDataFrame([(0, "a", 5.0), (1, "b", 2.0)], "voxel_id long, channel string, value double")
    got = {r.voxel_id: r.derived for r in files.with_derived_scalars(field, channels, ["f"]).collect()}
    assert got == {0: {"a": 5.0}, 1: {"b": 2.0}}
    with pytest.raises(ValueError, match="feature"):
        files.with_derived_scalars(field, channels, ["b"])


def test_structural_comparison(spark):
    schema = "pair_id string, element string, kind string, role string, x double, y double, z double, attrs map<string,string>"
    a = spark.createDataFrame([("p", "1", "k", "node", 0.0, 0.0, 5.0, {}), ("p", "2", "k", "node", 9.0, 0.0, 0.0, {"u": "x"})], schema)
    b = spark.createDataFrame([("p", "7", "k", "node", 0.0, 0.0, 5.5, {}), ("p", "8", "k", "node", 9.0, 0.0, 0.0, {"u": "y"}), ("p", "9", "other", "node", 9.0, 0.0, 0.0, {"u": "x"})], schema)
    assert [(r.element, r.element2, r.distance) for r in refine.greedy_match(a, b, 1.0, 0.9).collect()] == [("1", "7", 0.5)]
    assert refine.structural_distance(a, b, 1.0, 0.9).first().distance == pytest.approx((0.5 + 1 + 2) / 3)
    cost = refine.structural_edit_cost(a, b, b.where("element <> '8'"), 1.0, 0.9).first()
    assert (cost.elements, cost.added, cost.modified, cost.distance, cost.deleted, cost.split_merge) == (2, 1, 1, 0.5, 1, 0)
    assert cost.loss_bits == pytest.approx(4.321928 * (0.2 + 1 + 1) + 0.5)
    crowd = a.unionAll(a.withColumn("element", F.concat("element", F.lit("'"))))
    assert (lambda c: (c.modified, c.split_merge))(refine.structural_edit_cost(crowd, b.where("kind = 'other'"), b.where("element = '7'"), 1.0, 0.9).first()) == (2, 3)
    graph = a.withColumnRenamed("pair_id", "graph_id")
    near = graph.withColumn("z", F.col("z") + 0.01).withColumn("graph_id", F.lit("q"))
    far = graph.withColumn("z", F.col("z") + 8.0).withColumn("graph_id", F.lit("f"))
    assert [(r.candidate, r.member) for r in refine.near_duplicates(graph, near.unionAll(far), 1.0, 0.9, 0.1).collect()] == [("p", "q")]


def test_reference_pair_in_blocks(spark):
    """Pairs met in one task; blocks of members give the best of all pairs."""
    pool = [(f"m{k}", hashlib.md5(str(k).encode()).hexdigest()[: 20 + k % 13]) for k in range(90)]
    score = lambda a, b: (sum(x != y for x, y in zip(a[1], b[1], strict=False)) + abs(len(a[1]) - len(b[1]))) * 10_000 + int(hashlib.sha256(f"t:{a[0]}:{b[0]}".encode()).hexdigest()[:6], 16)
    best = min((-score(a, b), a[0], b[0]) for a in pool for b in pool if a[0] < b[0])
    frame = spark.createDataFrame(pool, "member_id string, content_hash string")
    for per_block in (20, 1_000):
        assert [tuple(r) for r in refine.reference_pair(frame, "t", per_block).collect()] == [(best[1], best[2], -best[0])]
    assert refine.reference_pair(frame.limit(1), "t").collect() == []


def test_reference_pair_makes_few_digests(spark, monkeypatch):
    """A digest was made for every pair, and again for later members when no score could be greater."""
    rng, made = random.Random(8), []
    pool = [(f"m{k}", None if k % 50 == 7 else "".join(rng.choices("0123456789abcdef\u00e9" if k % 9 else "\u4e00b", k=rng.choice([64, 64, 60, 0])))) for k in range(300)]
    differ = lambda a, b: 0 if a is None or b is None else sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    score = lambda a, b: differ(a[1], b[1]) * 10_000 + int(hashlib.sha256(f"t:{a[0]}:{b[0]}".encode()).hexdigest()[:6], 16)
    best = min((-score(a, b), a[0], b[0]) for a in pool for b in pool if a[0] < b[0])
    want = (best[1], best[2], -best[0])
    frame = spark.createDataFrame(pool, "member_id string, content_hash string")
    for rounds in ((), (3, 40), (299,)):
        assert [tuple(r) for r in refine.reference_pair(frame, "t", 100, rounds).collect()] == [want]
    digest = hashlib.sha256
    monkeypatch.setattr(refine.hashlib, "sha256", lambda text: made.append(text) or digest(text))
    rows = frame.toPandas()
    for at_once in (1, 5_000, 400_000):
        assert refine.best_pair(rows, rows, "t", 0, at_once) == want
    made.clear()
    assert refine.best_pair(rows, rows, "t", want[2]) == want and 0 < len(made) < 300 * 299 / 2 / 2
    assert refine.best_pair(rows, rows, "t", want[2] + 1) is None


def test_reference_pair_stops_at_the_greatest_score(spark, monkeypatch):
    """No later left member is met once a pair has the greatest score, for of equal pairs the first ids win."""
    pool, rounds = [(f"m{k:02}", f"{k:02}") for k in range(40)], []
    frame = spark.createDataFrame(pool, "member_id string, content_hash string")
    greatest = 20_000 + 16**6 - 1

    def found(name, least):
        rounds.append(least)
        best = lambda left, right: (left["member_id"].min(), right["member_id"].max(), greatest - int(left["member_id"].min() < "m05"))
        return lambda left, right: pd.DataFrame([best(left, right)] if len(left) and len(right) else [], columns=["left_id", "right_id", "score"])

    monkeypatch.setattr(refine, "_choice", found)
    got = refine.reference_pair(frame, "t", 10, (5, 10)).collect()
    assert rounds == [0, greatest] and [(r.left_id, r.score) for r in got] == [("m05", greatest)]


def test_reference_pair_as_in_the_sql(spark, tmp_path):
    """Suppliers without a name differ from none in characters, those without a key are in no pair."""
    rows = [(k if k != 5 else None, None if k < 30 else f"Supplier {k}", 1, 1.0) for k in range(33)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = [tuple(r) for r in reports.rf15_reference_pair(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == con.sql(reports.ORACLES["rf15_reference_pair"]).fetchall()
    spark.createDataFrame([r[:1] + (None,) + r[2:] for r in rows], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "none" / "supplier.parquet"))
    con.sql(f"CREATE OR REPLACE VIEW supplier AS SELECT * FROM '{tmp_path}/none/supplier.parquet/*.parquet'")
    assert [tuple(r) for r in reports.rf15_reference_pair(spark, str(tmp_path / "none")).collect()] == con.sql(reports.ORACLES["rf15_reference_pair"]).fetchall()


def test_greedy_matches_of_many_ties(spark):
    """Matches of crowded places equal those of all pairs in order, and no pairs are joined."""
    draw, schema = random.Random(5), "pair_id int, element string, kind string, role string, x double, y double, z double, attrs map<string,string>"
    side = lambda: [(0, f"e{k}", "k", "node", float(draw.randrange(4)), draw.choice([0.0, -0.0, 0.5]), 0.0, draw.choice([{}, {"u": "x"}, {"u": "y", "v": "x"}, {"v": "x", "u": "y"}, {"u": None}])) for k in draw.sample(range(200), 60)]
    left, right = side(), side() + [(1, "e1", "k", "node", 0.0, 0.0, 0.0, {})]
    apart = lambda a, b: ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5 / 2 + sum(a[7].get(k) != b[7].get(k) for k in {*a[7], *b[7]})
    want, used = [], set()
    for d, a, b in sorted((apart(a, b), a[1], b[1]) for a in left for b in right if a[0] == b[0]):
        if d <= 1.5 and not {("a", a), ("b", b)} & used:
            used |= {("a", a), ("b", b)}
            want.append((0, a, b, d))
    got = refine.greedy_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 2.0, 1.5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_of_crowds_compares_each_place_once(spark):
    schema = "pair_id int, element string, kind string, role string, x double, y double, z double, attrs map<string,string>"
    crowd = lambda x, n: spark.createDataFrame([(0, f"e{x}-{k}", "k", "node", x, 0.0, 0.0, {"u": "x"}) for k in range(n)] + [(0, f"far{x}", "k", "node", 50 + x, 0.0, 0.0, {})], schema)
    near = refine.best_distance(crowd(0.0, 30), crowd(0.5, 40), 1.0, 0.9, "d")
    assert sorted((r.element[:3], r.d) for r in near.collect()) == [("e0.", 0.5)] * 30 + [("far", 0.5)]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_summary_of_metrics_that_were_read(spark, tmp_path):
    """The reader's own columns are enough: fallbacks of tokens, model and throughput, and fields that a document lacks."""
    lines = [
        {"metric_type": "inference", "inference_id": "i2", "run_id": "r", "success": True, "latency_ms": 500.0, "usage": {"prompt_tokens": 3, "completion_tokens": 4, "model": "m2"}, "backend": "b"},
        {"metric_type": "inference", "inference_id": "i1", "run_id": "r", "success": False, "usage": {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 20, "model": "m1"}}, {"metric_type": "phase", "run_id": "r", "retry_count": 2, "duration_ms": 7.0},
        {"metric_type": "inference", "inference_id": "i3", "run_id": "s", "model": ""},
    ]
    (tmp_path / "metrics_1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    runs = spark.createDataFrame([("r", "named", True), ("s", "named", None), ("t", None, None)], "run_id string, model_name string, git_dirty boolean")
    got = {r.run_id: r for r in runlogs.run_summary(files.read_metrics(spark, f"file://{tmp_path}"), runs).collect()}
    r, s, t = (got[k] for k in "rst")
    assert (r.calls, r.successful_calls, r.total_tokens, r.prompt_tokens, r.completion_tokens, r.retries, r.phase_duration_ms, r.generation_count) == (2, 1, 27, 13, 9, 2, 7.0, 1)
    assert (r.model, r.backend, r.output_throughput, r.git_dirty, r.started_at) == ("m1", "b", 18.0, True, None)
    assert (s.model, s.backend, s.calls, s.total_tokens, s.output_throughput, s.mean_total_rate) == ("named", "unknown", 1, 0, 0.0, 0.0)
    assert (t.model, t.calls, t.success_rate, t.median_total_rate) == ("unknown", 0, 0.0, None)
