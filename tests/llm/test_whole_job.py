"""Cases in which an operator once did less than its whole job."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stratavox.llm import ngram_join, pii
from stratavox.llm.common import map_batches


def word_source(rng, shingler):
    """Fresh words by the half of the hash range that they fall in."""
    seen = set()

    def fresh(high=None):
        while True:
            w = f"w{rng.randrange(10**9)}"
            if w not in seen and (high is None or (int(shingler.grams(w)[0]) < 0) == high):
                seen.add(w)
                return w

    return fresh


def test_join_orders_all_sets_alike(spark):
    """Linked sets with more and with fewer rare n-grams than they list: places must compare."""
    settings = ngram_join.JaccardSettings(words=1)
    rng = random.Random(12)
    fresh = word_source(rng, ngram_join.Shingler(settings))
    low, high, common = [fresh(False) for _ in range(17)], [fresh(True) for _ in range(17)], [fresh() for _ in range(182)]
    a = low + high[:14] + common[:169]
    b = low[:13] + high + common[:157] + common[169:]
    other = low[:13] + common[:100]
    sets = [a, b, other] + [common + [fresh() for _ in range(100)] for _ in range(6)]
    shared = len({*a} & {*b})
    assert len(a) == len(b) == 200 and 100 * shared >= 85 * (400 - shared)
    rows = [(k, " ".join(rng.sample(x, len(x)))) for k, x in enumerate(sets)]
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()}
    want = {}
    for k, x in enumerate(sets):
        want[k] = next((want[j] for j in range(k) if 100 * len({*x} & {*sets[j]}) >= 85 * len({*x} | {*sets[j]})), k)
    assert got == want and want[1] == 0


def test_pipeline_drops_copies_with_a_fifth_of_new_text(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:182] + [f"new{k}" for k in range(18)]))]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r.doc_id for r in left.collect()] == [1]


def test_texts_go_to_python_in_small_batches(spark):
    """A batch of whole texts is bounded by its bytes, not by 10,000 rows."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 4000) as text")
    sizes = map_batches(docs, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.size for r in sizes) < 8 << 20


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_the_pipeline_bound_their_batches(spark, sf_dir, name, stage):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "some words of a text", "en", "host")], "doc_id long, text string, lang string, source string")
    stage(spark, docs, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_keep_one_knows_rows_by_id_and_text(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    copied, bare, clean, twins = text(), text(), text(), text()
    rows = [(1, copied), (5, copied + " end"), (5, clean), (None, bare), (None, bare + " end"), (None, bare), (None, copied), (7, twins), (7, twins + " end"), (8, twins), (9, ""), (9, ""), (9, None)]
    left = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(d or 0 for d, _ in left) == [0, 1, 5, 7, 9, 9, 9]
    assert (1, copied) in left and (5, clean) in left and sum(d is None and t.startswith(bare) for d, t in left) == 1


def test_pii_terms_of_whole_documents(spark):
    """Terms far from the entity, short names and numbers are told, and marked wherever they stand."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"p{rng.randrange(300):03d}x" for _ in range(n))
    rows = [(k, f"Zebrafish 88123 {prose(40)} mail to ann@x.org now {prose(40)} yours, Wu and zebrafish") for k in range(4)]
    rows += [(4, f"zebrafish {prose(20)}")] + [(10 + k, f"yours now {prose(60)}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for r in pii.find(docs).collect():
        named = [text[r.doc_id][t.start : t.end] for t in r.terms]
        if r.doc_id < 4:
            assert [w for w in named if w.lower() in ("zebrafish", "88123", "wu")] == ["Zebrafish", "88123", "Wu", "zebrafish"]
            assert "yours" not in named and "now" not in named
        else:
            assert not named
    # Disclosures are those of counts over whole documents.
    base = pii.base_spans(docs).cache()
    told = {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, base, pii.DisclosureRules())[0].collect()}
    assert told == {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, base, pii.DisclosureRules(broadcast_terms=0))[0].collect()}
    words = [{*re.findall(r"[^\W_]+", t.lower())} for _, t in rows]
    want = {}
    for w in set().union(*words[:4]):
        both, n = sum(w in x for x in words[:4]), sum(w in x for x in words)
        d = math.log2(both * len(rows) / (n * 4)) / math.log2(len(rows) / 4)
        if both >= 2 and d >= 0.5:
            want["email:ann@x.org", w] = d
    assert told.keys() == want.keys() and all(abs(told[k] - want[k]) < 1e-9 for k in want)


def test_join_of_one_large_group_of_near_copies(spark):
    """2,000 variants of one text, most pairs near the limit: brute force by a matrix of shared n-grams."""
    rng, base = random.Random(15), [f"b{k}" for k in range(150)]
    rows = []
    for k in range(2000):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            at = rng.randrange(150)
            words[at] = rng.choice([f"n{k}x{at}", f"c{at}", f"c{at}"])
        rows.append((k, " ".join(words)))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    grams = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(grams)), np.float32)
    for k, s in enumerate(sets):
        held[k, [grams[g] for g in s]] = 1
    shared, size = held @ held.T, held.sum(1)
    linked = 100 * shared >= 85 * (size[:, None] + size[None, :] - shared)
    want, least = {}, np.arange(len(rows))
    while (new := np.where(linked, least[None, :], len(rows)).min(1)).tolist() != least.tolist():
        least = new
    want = dict(enumerate(least.tolist()))
    assert 0.02 < linked.mean() < 0.6 and len(set(want.values())) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in (ngram_join.JaccardSettings(), ngram_join.JaccardSettings(rounds=3, pairs_per_entry=0)):
        got = {r.doc_id: r.component_id for r in ngram_join.join_documents(docs, settings).collect()}
        assert got == want


def test_slices_never_hide_a_link():
    """The bound of a pair's overlap by a slice is at least the overlap, also where the slice is empty."""
    rng = np.random.default_rng(3)
    settings = ngram_join.JaccardSettings()
    for _ in range(300):
        both, own, other = (rng.integers(0, 2**64, rng.integers(0, n), np.uint64) for n in (60, 12, 12))
        x, y = (np.unique(np.concatenate([both, z])).view(np.int64) for z in (own, other))
        shared = len(np.intersect1d(x, y))
        bound = ngram_join.most_shared(ngram_join.slice_of(x, settings), len(x), ngram_join.slice_of(y, settings), len(y))
        assert shared <= bound <= min(len(x), len(y))
