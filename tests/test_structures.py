"""Draws, realisations, bodies, composition and patches against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import draws, uncertainty
from stratavox.operators import bodies, composition, patches, realise
from stratavox.queries import geology

U = uncertainty.parse_uncertainty


def test_uncertain_values_as_stated(spark):
    rows = [
        ('{"kind": "Gaussian", "value": 3, "mean": 1, "std": 2}', "gaussian", True, 1.0, 4.0), ('{"value": 3, "mean": 1, "std": 2}', "point", True, 3.0, 0.0), ('{"dip_mean": 30, "dip_std": 2, "azimuth_mean": 1}', None, False, None, None),
        ('{"dip_mean": 30, "dip_kappa": 0, "azimuth_mean": 1, "azimuth_kappa": 1}', "orientation", False, None, None), ('{"name": "triangular", "params": {"left": 0, "c": 1, "right": 5}}', "distribution", True, 1.0, (1 + 25 - 5) / 18),
        ('{"name": "normal", "params": {}}', "distribution", False, None, None), ('{"name": "uniform", "params": {"loc": 2, "scale": 4}}', "distribution", True, 4.0, 16 / 12), (None, None, None, None, None), ('{"mean": 4}', None, False, None, None),
        ('{"name": "lognormal", "params": {"scale": 2, "s": 1}}', "distribution", True, 2 * np.exp(0.5), (np.e - 1) * 4 * np.e), ('{"name": "beta", "params": {"a": 2, "b": 6, "lo": 1, "hi": 3}}', "distribution", True, 1.5, 4 * 12 / (64 * 9)),
    ]
    got = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, t string").select("k", U(F.col("t")).alias("u")).select("k", "u", uncertainty.nominal(F.col("u")).alias("n"), uncertainty.variance(F.col("u")).alias("v")).collect()
    for r in got:
        _, kind, valid, n, v = rows[r.k]
        assert (r.u and r.u.kind, r.u and r.u.valid) == (kind, valid), rows[r.k]
        assert r.n == (None if n is None else pytest.approx(n)) and r.v == (None if v is None else pytest.approx(v)), rows[r.k]


def test_a_text_is_parsed_once_for_all_uses(spark):
    """Each use of a parsed value took its text apart anew, hundreds of times a row."""
    u = spark.range(3).select("id", U(F.concat(F.lit('{"value": '), F.col("id").cast("string"), F.lit("}"))).alias("u"))
    used = u.select(uncertainty.nominal(F.col("u")).alias("n"), uncertainty.variance(F.col("u")).alias("v"), uncertainty.sample(F.col("u"), 7, "id")["number"].alias("x"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted((r.n, r.v, r.x) for r in used.collect()) == [(k, 0.0, k) for k in (0.0, 1.0, 2.0)]


def test_draws_have_the_stated_moments(spark):
    texts = {
        "truncnorm": '{"name": "truncnorm", "params": {"mean": 0, "std": 1, "lo": -1, "hi": 2}}', "tail": '{"name": "truncnorm", "params": {"mean": 0, "std": 1, "lo": 5, "hi": 1e9}}', "beta": '{"name": "beta", "params": {"alpha": 0.5, "beta": 2}}',
        "orientation": '{"dip_mean": 40, "dip_kappa": 50, "azimuth_mean": 350, "azimuth_kappa": 20}', "gaussian": '{"mean": 3, "std": 2}', "bad": '{"name": "truncnorm", "params": {"std": -1}}',
    }
    def drawn(parts):
        t = spark.createDataFrame([*texts.items()], "name string, t string").crossJoin(spark.range(4000)).repartition(parts).select("name", "id", U(F.col("t")).alias("u"))
        return {(r.name, r.id): r.x for r in t.select("name", "id", uncertainty.sample(F.col("u"), 5, "name", "id").alias("x")).collect()}

    one = drawn(3)
    assert one == drawn(7)
    x = {n: np.array([one[n, k].number if one[n, k].number is not None else np.nan for k in range(4000)]) for n in texts}
    assert x["truncnorm"].min() >= -1 and x["truncnorm"].max() <= 2 and abs(x["truncnorm"].mean() - 0.2297) < 0.05 and x["tail"].min() >= 5 and abs(x["tail"].mean() - 5.187) < 0.02
    assert abs(x["beta"].mean() - 0.2) < 0.02 and abs(x["beta"].var() - 0.16 / 3.5) < 0.005 and abs(x["gaussian"].mean() - 3) < 0.1 and abs(x["gaussian"].std() - 2) < 0.1 and np.isnan(x["bad"]).all()
    dip, azimuth = (np.array([getattr(one["orientation", k], n) for k in range(4000)]) for n in ("dip", "azimuth"))
    assert abs(dip.mean() - 40) < 0.5 and abs(dip.std() - np.degrees(50**-0.5)) < 0.4 and ((azimuth > 250) | (azimuth < 90)).all()


def test_realise_cascade(spark):
    """Present and absent by probabilities of 0 and 1: each rule of the cascade once."""
    z, names = '{"mean": 5, "std": 1}', ["t1", "t2", "t3"]
    n = [
        ("u1", "stratigraphic_unit", None, None, 1.0), ("u2", "stratigraphic_unit", None, None, 0.0), ("u3", "stratigraphic_unit", None, None, 1.0), ("p1", "location", None, None, 1.0), ("p2", "location", None, None, 0.0), ("s1", "sample", None, None, 1.0), ("s2", "sample", None, None, 1.0),
        ("s3", "sample", None, None, 1.0), ("s4", "sample", None, None, 1.0), *[(t, "contact", ["u1", "u3"], None, 1.0) for t in names], ("t4", "contact", ["u1", "u2"], None, 1.0), ("f1", "fault", None, [*names, "t4"], 1.0), ("f2", "fault", None, ["t1", "t2", "t4"], 1.0),
    ]
    e = [("a1", "at", "s1", "p1", 1.0), ("a2", "at", "s2", "p2", 1.0), ("a3", "at", "s3", "p1", 0.0), ("w4", "within", "s4", "u1", 1.0), ("o1", "overlies", "u1", "u3", 1.0), ("o2", "overlies", "u1", "u2", 1.0)]
    for drop, infeasible in (({"s4", "w4"}, False), (set(), True)):
        nodes = spark.createDataFrame([("g", i, k, kind, i if kind.startswith("strat") else None, b, s, p) for k, (i, kind, b, s, p) in enumerate(n) if i not in drop], "graph_id string, node_id string, node_seq long, kind string, unit_id string, between array<string>, surface_points array<string>, p_exists double")
        position = F.when(F.col("kind").isin("location", "contact"), F.array(*[U(F.lit(z))] * 3))
        nodes = nodes.withColumns({"position": position, "value": F.when(F.col("kind") == "sample", U(F.lit(z)))})
        edges = spark.createDataFrame([("g", i, k, kind, a, b, p) for k, (i, kind, a, b, p) in enumerate(e) if i not in drop], "graph_id string, edge_id string, edge_seq long, kind string, source string, target string, p_exists double")
        attempts = spark.createDataFrame([("g", 0), ("g", 1)], "graph_id string, realisation int")
        kept, links = realise.realise(nodes, edges, attempts, 3)
        got = {(r.realisation, r.node_id): r for r in kept.collect()}
        assert {k for r, k in got if r == 0} == {"u1", "u3", "p1", "s1", *names, "f1"}
        assert got[0, "f1"].surface_points == names and got[0, "s1"].point == got[0, "p1"].point != got[1, "p1"].point and got[0, "s1"].number is not None
        assert {r.edge_id for r in links.collect()} == {"a1", "o1"} | ({"w4"} - drop)
        assert {r.feasible for r in realise.feasible(kept, links, attempts).collect()} == {not infeasible}
    *_, report = realise.ensemble(nodes, edges, 3, 3)
    assert [tuple(r) for r in report.collect()] == [("g", 0, 6)]


def test_ensemble_stops_at_the_last_one_needed(spark):
    """Two contacts whose heights cross about half the time: the first feasible attempts, and none after them."""
    rows = [("u1", "stratigraphic_unit", None, None), ("u2", "stratigraphic_unit", None, None), ("u3", "stratigraphic_unit", None, None), ("c1", "contact", ["u1", "u2"], 10.0), ("c2", "contact", ["u2", "u3"], 9.5)]
    nodes = spark.createDataFrame([(g, i, k, kind, None, b, None, z) for g in "gh" for k, (i, kind, b, z) in enumerate(rows)], "graph_id string, node_id string, node_seq long, kind string, unit_id string, between array<string>, surface_points array<string>, z double").withColumn("p_exists", F.lit(1.0))
    text = lambda x: U(F.format_string('{"mean": %s, "std": 1}', x.cast("string")))
    nodes = nodes.withColumns({"position": F.when(F.col("z").isNotNull(), F.array(U(F.lit('{"value": 0}')), U(F.lit('{"value": 0}')), text(F.col("z")))), "value": U(F.lit(None).cast("string"))})
    edges = spark.createDataFrame([(g, f"o{k}", k, "overlies", f"u{k}", f"u{k + 1}", 1.0) for g in "gh" for k in (1, 2)], "graph_id string, edge_id string, edge_seq long, kind string, source string, target string, p_exists double")
    kept, _, report = realise.ensemble(nodes, edges, 6, 11)
    heights = lambda g, k: [r.x for r in spark.createDataFrame([("c1", 10.0), ("c2", 9.5)], "c string, z double").select(uncertainty.sample_number(text(F.col("z")), 11, F.lit(g), F.lit(k), "c", F.lit("position2")).alias("x"), "c").orderBy("c").collect()]
    for g in "gh":
        feasible = [(h := heights(g, k))[1] < h[0] for k in range(12)]
        accepted = [k for k, ok in enumerate(feasible) if ok][:6]
        tried = accepted[-1] + 1 if len(accepted) == 6 else 12
        assert [(r.accepted, r.rejected) for r in report.where(F.col("graph_id") == g).collect()] == [(len(accepted), tried - len(accepted))]
        assert sorted({r.realisation for r in kept.where(F.col("graph_id") == g).collect()}) == accepted


def brute_hull(p):
    out = set()
    for t in itertools.combinations(range(len(p)), 3):
        side = (p - p[t[0]]) @ np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            out |= set(t)
    return sorted(out)


def test_hull_corners():
    rng = np.random.default_rng(0)
    for n in (4, 5, 12, 30):
        p = rng.normal(size=(n, 3))
        assert bodies.hull_vertices(p).tolist() == brute_hull(p)
    cube = np.array([*itertools.product((0.0, 1.0), repeat=3), (0.5, 0.5, 0.5), (0, 0, 0)])
    assert bodies.hull_vertices(cube).tolist() == list(range(8))
    assert bodies.hull_vertices(np.array([(0.0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)])).tolist() == [0, 1, 2, 3]


def test_topology(spark):
    cube = [(float(x), float(y), float(z)) for x, y, z in itertools.product((0, 2), repeat=3)] + [(1.0, 1.0, 1.0)] * 3
    flat = [(float(k), float(k * k), float(3 * k + 2 * k * k)) for k in range(9)]
    clouds = {"closed": cube, "flat": flat, "few": cube[:3], "same": cube[8:] * 2, "layer": cube, "sheet": flat, "given": cube, "open": flat}
    contacts = spark.createDataFrame([(u, *p) for u, own in clouds.items() for p in own], "unit string, x double, y double, z double")
    units = spark.createDataFrame([(u, "layer" if u in ("layer", "sheet") else "embedded", *([5.0] * 3 if u in ("given", "open") else [None] * 3)) for u in [*clouds, "none"]], "unit string, topology string, ax double, ay double, az double")
    got = {r.unit: (r.closed, r.verdict, r.ax) for r in bodies.topology_check(contacts.repartition(5), units).collect()}
    lost = (False, "without_anchor_or_closure", None)
    assert got == {"closed": (True, "anchored", 1.0), "flat": lost, "few": lost, "same": lost, "none": lost, "layer": (True, "closed_layer", None), "sheet": (False, "ok", None), "given": (True, "ok", 5.0), "open": (False, "open", 5.0)}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    targets = {g: np.concatenate([rng.normal(size=(150, 3)) * 10**g, np.ones((20, 3)), rng.normal(size=(3, 3)) * 1e4]) for g in range(3)} | {3: np.ones((1, 3))}
    points = {g: np.concatenate([rng.normal(size=(40, 3)) * 3 * 10**g, rng.normal(size=(3, 3)) * 1e6]) for g in range(5)}
    frame = lambda of: spark.createDataFrame([(g, k, *map(float, p)) for g, own in of.items() for k, p in enumerate(own)], "grp int, id int, x double, y double, z double")
    t = frame(targets)
    brute = {(g, k): np.sqrt(((targets[g] - p) ** 2).sum(axis=1)).min() if g in targets else None for g, own in points.items() for k, p in enumerate(own)}
    for reach in (None, 2.0):
        got = {(r.grp, r.id): r.nearest for r in bodies.nearest(frame(points).withColumns({"reach": F.lit(reach).cast("double"), "own": F.lit(False)}), t).collect()}
        assert got.keys() == brute.keys()
        for k, d in brute.items():
            assert got[k] == (pytest.approx(d) if d is not None and (reach is None or d <= reach) else None)
    got = {(r.grp, r.id): r.nearest for r in bodies.nearest(t.withColumns({"reach": F.lit(None).cast("double"), "own": F.lit(True)}), t).collect()}
    for g, own in targets.items():
        for k, p in enumerate(own):
            d = np.sqrt(((np.delete(own, k, axis=0) - p) ** 2).sum(axis=1))
            assert got[g, k] == (pytest.approx(d.min()) if len(d) else None)


def test_body_distance_has_no_cross_join(spark):
    contacts = spark.createDataFrame([("g", "b", k, float(k % 2), float(k % 3), float(k % 5)) for k in range(12)], "graph_id string, body string, contact int, x double, y double, z double")
    anchors = spark.createDataFrame([("g", "b", 0.5, 1.0, 2.0)], "graph_id string, body string, ax double, ay double, az double")
    cells = spark.createDataFrame([("g", k, 0.1 * k, 1.0, 2.0) for k in range(20)], "graph_id string, cell int, x double, y double, z double")
    out = bodies.body_distance(cells, contacts, anchors, 1.0)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.cell: r.distance for r in out.collect()}
    assert got[5] > 0 > got[19]
    with pytest.raises(Exception, match="at least 4 contacts"):
        bodies.body_distance(cells, contacts.limit(3), anchors, 1.0).collect()


def test_far_points_take_no_more_rounds(spark, monkeypatch):
    """A point is held against blocks in two passes however far it is; blocks and parts of few rows give the same distances."""
    rng = np.random.default_rng(9)
    targets, points = rng.uniform(size=(400, 3)) * [100, 80, 1], np.concatenate([rng.uniform(size=(60, 3)) * 100, rng.normal(size=(40, 3)) * 1e5])
    frame = lambda of: spark.createDataFrame([(k % 2, k, *map(float, p)) for k, p in enumerate(of)], "grp int, id int, x double, y double, z double")
    rounds, stored = [], bodies.stored
    monkeypatch.setattr(bodies, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    for few in ({}, {"per_block": 8, "points_per_task": 7}):
        rounds.clear()
        got = {r.id: r.nearest for r in bodies.nearest(frame(points).withColumns({"reach": F.lit(None).cast("double"), "own": F.lit(False)}), frame(targets), **few).collect()}
        assert got == {k: pytest.approx(np.sqrt(((targets[k % 2 :: 2] - p) ** 2).sum(axis=1)).min()) for k, p in enumerate(points)}
        assert len(rounds) == 4
    limit = np.where(np.arange(100) % 2, np.inf, 5.0)
    d = np.sqrt(((points[:, None] - targets) ** 2).sum(axis=2)).min(axis=1)
    assert bodies.nearest_places(points, targets, limit, leaf=4) == pytest.approx(np.where(d <= limit, d, np.inf))


def test_thresholds_of_orders_without_keys(spark, tmp_path):
    """As in the SQL: a null key comes last, and a pool of unknown size is not below three."""
    rows = [(9 * k, c, 100000.0 + 50000 * k) for c in (1, 2) for k in range(1, 4)] + [(None, 1, 390000.0), (14, 2, None), (13, None, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    inf = float("inf")
    got = {(r.seq, r.threshold, r.admitted) for r in geology.rf12_thresholds(spark, str(tmp_path)).collect()}
    assert got == {(9, inf, True), (18, inf, True), (27, inf, True), (None, 400000.0, True), (14, inf, None), (13, inf, True)}


def brute_compose(support, ranks, pairs, edges):
    """Composition written as loops over the pairs (younger, older) that erode."""
    out, handled, by_older = dict(support), set(), {}
    for younger, older in pairs:
        by_older.setdefault(older, []).append(younger)
    for older, own in by_older.items():
        if len(own) < 2 or any((a, b) in edges for a in own for b in own):
            continue
        if len({ranks[u] for u in own}) == 1:
            union, total = 1 - np.prod([1 - support[u] for u in own]), sum(support[u] for u in own)
            for u in own:
                out[u] = (support[u] / total if total > 1e-9 else 1 / len(own)) * union
            out[older] *= 1 - union
        else:
            down = sorted(own, key=lambda u: (-ranks[u], u))
            for k, u in enumerate(down):
                for v in [older, *down[k + 1 :]]:
                    out[v] *= 1 - support[u]
        handled |= {(u, older) for u in own}
    for younger, older in sorted(set(pairs) - handled, key=lambda p: (-ranks[p[0]], *p)):
        out[older] *= 1 - support[younger]
    return out


def test_composition_of_many_graphs(spark):
    rng = random.Random(2)
    names, modes, units, support, want = "abcdef", [], [], [], {}
    for g in range(40):
        ranks = {u: rng.choice([0, 0, 1, 2]) if g % 2 else 0 for u in names}
        pairs = rng.sample([(a, b) for a, b in itertools.combinations(names, 2)], rng.randrange(0, 9))
        soft = set(rng.sample(pairs, len(pairs) // 4))
        s = {u: rng.choice([0.0, 1.0, rng.random()]) for u in names}
        modes += [(g, a, b, k, "softmax" if (a, b) in soft else "erode") for k, (a, b) in enumerate(pairs)]
        units += [(g, u, k, ranks[u] or None) for k, u in enumerate(names)]
        support.append((g, list(s.values())))
        want[g] = brute_compose(s, ranks, [p for p in pairs if p not in soft], set(pairs))
    steps = composition.composition_steps(spark.createDataFrame(modes, "graph_id int, younger string, older string, edge_seq long, mode string"), spark.createDataFrame(units, "graph_id int, unit string, place int, chronology_rank int"))
    rows = spark.createDataFrame(support, "graph_id int, s array<double>").join(steps, "graph_id", "left")
    got = {r.graph_id: r.e for r in rows.select("graph_id", composition.composed(F.col("s"), F.col("steps")).alias("e")).collect()}
    for g, e in want.items():
        assert got[g] == pytest.approx(list(e.values()))


def replay(nodes, edges, ops):
    """Operations one after another; those in conflict are left out."""
    nodes, edges, bad = dict(nodes), dict(edges), set()
    for seq, op, i, kind, p, a, b, cascade in ops:
        incident = [e for e, (_, s, t, _) in edges.items() if i in (s, t)]
        name = i if i is not None else f"op{seq}"
        if op in ("add_node", "replace_node", "update_node") and (i in nodes) == (op != "add_node"):
            nodes[i] = (kind if kind is not None or op != "update_node" else nodes[i][0], p if p is not None or op != "update_node" else nodes[i][1])
        elif op == "remove_node" and i in nodes and (cascade or not incident):
            del nodes[i]
            edges = {e: x for e, x in edges.items() if e not in incident}
        elif op == "add_sample" and i not in nodes and a in nodes and b in nodes:
            nodes[i] = ("sample", p)
            for e, to in (("at", b), ("within", a)):
                edges.setdefault(f"{e}__{i}", (e, i, to, 1.0))
        elif op in ("add_edge", "replace_edge") and (name in edges) == (op == "replace_edge"):
            edges[name] = (kind, a, b, p)
        elif op == "remove_edge" and i in edges:
            del edges[i]
        else:
            bad.add(seq)
    return nodes, edges, bad


def test_patches_as_replayed(spark):
    rng = random.Random(6)
    kinds = ["add_node", "replace_node", "update_node", "remove_node", "add_sample", "add_edge", "replace_edge", "remove_edge"]
    rows, base_n, base_e, want = [], [], [], {}
    for g in range(12):
        nodes, edges = {f"n{k}": ("base", 1.0) for k in range(3)}, {"e0": ("k", "n0", "n1", 1.0), "e1": ("k", "n1", "n9", 1.0)}
        own = []
        for seq in range(40):
            op = rng.choice(kinds)
            i = rng.choice(["e0", "e1", "e2", None if op == "add_edge" else "e3"]) if op.endswith("edge") else f"n{rng.randrange(6)}"
            own.append((seq, op, i, rng.choice([None, "x", "y"]), rng.choice([None, 0.5]), f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.choice([None, True, False])))
        want[g] = replay(nodes, edges, [(*o[:7], o[7] is not False) for o in own])
        rows += [(g, *o[:5], None, *o[5:], None) for o in own]
        base_n += [(g, n, *x, None) for n, x in nodes.items()]
        base_e += [(g, e, *x) for e, x in edges.items()]
    ops = spark.createDataFrame([*rows, (0, 100, "set_metadata", *[None] * 7, "m"), (0, 99, "set_metadata", *[None] * 7, "old"), (1, 101, "set_metadata", *[None] * 8), (1, 102, "fly", *[None] * 8)], "graph_id int, op_seq int, op string, id string, kind string, p_exists double, attrs map<string,string>, source string, target string, cascade boolean, metadata string")
    n, e, meta, bad = patches.apply_patches(spark.createDataFrame(base_n, "graph_id int, node_id string, kind string, p_exists double, attrs map<string,string>"), spark.createDataFrame(base_e, "graph_id int, edge_id string, kind string, source string, target string, p_exists double"), ops)
    n, e, bad = n.collect(), e.collect(), bad.collect()
    for g, (nodes, edges, wrong) in want.items():
        assert {r.op_seq for r in bad if r.graph_id == g} == wrong | ({101, 102} if g == 1 else set())
        assert {r.node_id: (r.kind, r.p_exists) for r in n if r.graph_id == g} == nodes
        assert {r.edge_id: (r.kind, r.source, r.target, r.p_exists) for r in e if r.graph_id == g} == edges
    assert [tuple(r) for r in meta.collect()] == [(0, "m")]


def test_uniform_numbers(spark):
    x = np.array([r.u for r in spark.range(5000).select(draws.uniform(1, "id", F.lit("a")).alias("u")).collect()])
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02 and len(np.unique(x)) == 5000
