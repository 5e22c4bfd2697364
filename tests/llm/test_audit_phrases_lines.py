"""Source audit, collocations and the line field against plain versions, and their odd inputs."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratavox.llm import bpe, collocations, line_quality, quality_rules, queries, source_audit, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, term string, n long, id long, salt int, rank int, word binary, value double"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, 2, 3, 4, b"y", 0.5) for k, r in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def rows():
    """Copies within and across sources, nulls, empty and very long texts, ties, other scripts and odd bytes."""
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "of", "new", "york", "é", "日本", "x_y", "a\x0bb", "O'Neil", *(f"w{k}" for k in range(30))])
    out = [(None, None, None), ("", "en", "a"), (" \t\n", "fr", "only"), ("1 2 3 _ {", "de", "a"), ("one", "es", None), ("\x00odd\x00odd", "en", ""), ("rare " * 3, "de", "b")]
    for k in range(60):
        text = "".join(word() + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "!"]) for _ in range(rng.choice([1, 8, 60])))
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append((text, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c", None, ""])))
    return [*out, ("new york city. " * 40, "en", "b"), (" ".join(f"u{k}" for k in range(20_000)) + " new york" * 2000, "en", "c"), *[("same copy of one text", "en", "a")] * 40]


def brute_audit(rows):
    docs = [(text or "", lang or "", source or "") for text, lang, source in rows]
    found = defaultdict(Counter)
    held, groups = defaultdict(Counter), {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        terms = TERM.findall(lower(text))
        held[lang].update(set(terms))
        found[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in held[lang].items() if k >= 3]
        sources = sorted(s for k, s in groups if k == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(found[lang, s]) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t])[:200]
            out |= {(lang, s, part, item, -v, k) for part, ranked in (("pair", pair), ("term", term)) for k, (v, _, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("held", [7, 400_000])
def test_source_audit(spark, rows, held):
    found = source_audit.audit(frame(spark, rows).repartition(5), source_audit.AuditSettings(held_texts=held, held_terms=held)).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == brute_audit(rows)
    assert {(r.lang, r.value) for r in found if r.lang == "fr" and r.part == "pair"}


def test_source_audit_without_terms(spark):
    assert source_audit.audit(frame(spark, [("a", "en", "x")]).where("false")).count() == 0
    found = source_audit.audit(frame(spark, [("a", "en", "x"), (None, "en", None)])).collect()
    assert sorted((r.source, r.item, r.value, r.rank) for r in found) == [("", "x", 0, 1), ("x", "", 0, 1)]


def brute_collocations(rows, least=10, best=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        for phrase, a in count.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [c for p, c in count.items() if len(p) == 3 and c >= least and len(phrase) == 2 and phrase in (p[:2], p[1:])]
            if any(100 * c >= 50 * a for c in longer):
                continue
            cut = min((10**6 * a * a // (count[phrase[:k]] * count[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-cut[0], -a, " ".join(phrase).encode(), count[phrase[: cut[1]]], count[phrase[cut[1] :]]))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:best], 1)]
    return out


SMALL = dict(ranked=12, side=4, tiles=3, cells=2, buffered=300, bits=64, held_words=20)


@pytest.mark.parametrize("settings", [{}, SMALL, {"ranked": 0}, {"best": 5, "covered": 90}])
def test_collocations(spark, rows, settings):
    found = collocations.collocations(frame(spark, rows).repartition(3), collocations.CollocationSettings(**settings)).collect()
    if "covered" in settings:
        assert max(Counter(r.lang for r in found).values()) == 5
    else:
        assert sorted(map(tuple, found)) == sorted(brute_collocations(rows))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [("a b", "en", "x")]).where("false")).count() == 0
    assert collocations.collocations(frame(spark, [("a b", "en", "x"), (None, None, None)])).count() == 0


def test_tiles_count_ranked_and_other_pairs():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 40, 5000), rng.integers(0, 40, 5000)
    ranks = collocations.Ranks([np.arange(0, 40, 2)])
    tiles = collocations.Tiles(collocations.CollocationSettings(**SMALL), ranks, ranks)
    found = Counter()
    for k in range(0, 5000, 250):
        for part in itertools.chain(tiles.add(left[k : k + 250], right[k : k + 250]), tiles.rest() if k == 4750 else ()):
            for a, b, n in zip(*map(np.ndarray.tolist, part), strict=True):
                found[a, b] += n
    assert found == Counter(zip(left.tolist(), right.tolist(), strict=True))


def field_with(seed):
    rng = np.random.default_rng(seed)
    field = line_quality.LineField(line_quality.LineSettings(), np.sort(rng.random((line_quality.MEASURES, 7)), axis=1))
    field.weights, field.transition = rng.normal(size=len(field.weights)), rng.normal(size=(2, 2))
    return field


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 3, 1, 8])
    potential, field = rng.normal(size=sizes.sum()) * 3, field_with(4)
    good, expected, total = field.marginals(potential, sizes)
    brute_good, brute_expected, brute_total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        own, z, pairs = np.zeros(n), 0.0, np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(potential[at + k] for k in range(n) if states[k]) + sum(field.transition[a, b] for a, b in itertools.pairwise(states)))
            z += w
            own += w * np.array(states)
            for a, b in itertools.pairwise(states):
                pairs[a, b] += w
        brute_good += list(own / z)
        brute_expected += pairs / z
        brute_total += math.log(z)
        at += n
    assert np.allclose(good, brute_good) and np.allclose(expected, brute_expected) and abs(total - brute_total) < 1e-9


def test_fit_finds_the_likeliest_field():
    """At the optimum no small change of a weight or transition is better."""
    texts = [b"good line of words here\nanother one stands there", b"### $$$\n### $$$", b"a fine text\nwith some lines\nand an end", b"### ###"] * 3
    measures, per_text, _ = line_quality.measured(texts)
    field = line_quality.LineField(line_quality.LineSettings(steps=500), np.quantile(measures, np.arange(1, 8) / 8, axis=0).T)
    places, state = field.places(measures, per_text), np.repeat([1, 0, 1, 0] * 3, per_text)
    field.fit(places, per_text, state)

    def loss(weights, transition):
        field.weights, field.transition = weights, transition
        own = np.split(state, np.cumsum(per_text)[:-1])
        score = field.potentials(places) @ state + sum(transition[a, b] for s in own for a, b in itertools.pairwise(s))
        return field.marginals(field.potentials(places), per_text)[2] - score + field.settings.ridge / 2 * ((weights**2).sum() + (transition**2).sum())

    weights, transition = field.weights.copy(), field.transition.copy()
    best = loss(weights, transition)
    for k in [*np.unique(places)[::9], len(weights) - 1]:
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, transition) > best - 1e-6
    for k in itertools.product((0, 1), repeat=2):
        for step in (-0.05, 0.05):
            moved = transition.copy()
            moved[k] += step
            assert loss(weights, moved) > best - 1e-6


def test_line_measures():
    texts = [b"", b"The the the $$$ x!\n\nThe the the $$$ x!", "é b".encode(), b"a b c d e f a b c d e\n  "]
    found, per_text, length = line_quality.measured(texts)
    assert per_text.tolist() == [1, 3, 1, 2] and length.tolist() == [1, 18, 1, 18, 3, 21, 2]
    lines = [x for t in texts for x in t.decode().split("\n")]
    for row, line in zip(found, lines, strict=True):
        words = line.split()
        assert np.isclose(row[0], math.log1p(len(words))) and np.isclose(row[1], math.log1p(len(line)))
        assert np.isclose(row[13], sum(words.count(w) > 1 for w in words) / max(1, len(words)))
        assert np.isclose(row[10], sum(c in "#*$%&|<>" for c in line) / max(1, len(line)))
        assert np.isclose(row[15], sum(a == b for a, b in itertools.pairwise(words)) / max(1, len(words)))
    assert found[:, 18].tolist() == [0, 1, 0, 1, 0, 0, 0]
    assert found[5, 14] == 2 / 11 and found[1, 14] == 1 / 5  # the window of five words is met twice
    alone = [line_quality.measured([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), found)  # a text's measures do not depend on its batch


def test_line_quality_of_held_out_documents(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(300)]
    text = lambda bad: "\n".join(" ".join(rng.choice(words) + (rng.choice(["###", "$$$"]) if bad and rng.random() < 0.7 else "") for _ in range(12)) + "." for _ in range(rng.randrange(1, 7)))
    quality = [int(rng.random() < 0.8) for _ in range(400)]
    rows = [(text(not q), "en", "s") for q in quality] + [(None, None, None), ("", None, None), ("word1 " * 60_000, None, None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([*enumerate(quality), (401, 2), (None, 1), (9999, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in line_quality.score(docs, labels).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    held = [k for k in range(400) if found[k].held_out]
    assert 40 < len(held) < 130 and sum(found[k].predicted == quality[k] for k in held) >= 0.97 * len(held)
    turned = spark.createDataFrame([*((k, 1 - q if found[k].held_out else q) for k, q in enumerate(quality)), (401, 2), (9999, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in line_quality.score(docs, turned).collect()} == {k: r.score for k, r in found.items()}
    assert line_quality.score(docs.where("false"), labels).count() == 0
    assert {r.predicted for r in line_quality.score(docs, labels.where("quality = 1")).collect()} == {1}


def test_line_quality_on_the_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    found = [r for r in queries.QUERIES["op13_line_quality"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in found) >= 0.95 * len(found) > 50


def test_one_row_for_each_document_of_a_large_batch(spark):
    docs = frame(spark, [(f"text number {k} of many", "en", f"s{k % 3}") for k in range(1234)]).coalesce(1)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(50)], "doc_id long, toxic int, quality int")
    for found in (bpe.coded(docs, queries.bpe_settings()), quality_rules.judge(docs), toxicity.score(docs, labels), line_quality.score(docs, labels), substring_dedup.dedup_substrings(docs)):
        ids = [r.doc_id for r in found.select("doc_id").collect()]
        assert sorted(ids) == list(range(1234))
