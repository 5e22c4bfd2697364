"""Each operator against a plain brute-force version, and its odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash  # noqa: F401
from pyspark.sql import functions as F

from stratavox.llm import bpe, decontamination, html_extract, line_dedup, ngram_join, pii, quality_rules, queries, substring_dedup, token_counts, toxicity
from stratavox.llm.common import connected_components
from stratavox.llm.cuckoo import CuckooFilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, host string, id long, windows int"


def rows_of(texts):
    return [(k, t, "en", None if k % 5 == 0 else f"src{k % 3}", len(t or ""), "x", "y", 1, 2) for k, t in enumerate(texts)]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, short and empty texts, nulls, ties, odd white space and other scripts."""
    rng = random.Random(4)
    base = [prose(rng, rng.choice([3, 12, 60, 200])) for _ in range(25)]
    out = [None, "", " \n\t ", "a", "a a a a a a a a a a a a", "x " * 90, "é ü 日本語   x", "l\nL \n l", "9" * 500]
    for t in base:
        out.append(t)
        if rng.random() < 0.5:
            out.append(t)
        words = t.split()
        if len(words) > 20:
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            out.append("  ".join(near))
            out.append("\n".join([prose(rng, 9), " ".join(words[5:50]), "This Line stands in many texts.", prose(rng, 4)]))
            out.append("THIS line stands in many texts.  \n" + " ".join(words[:15]) + "\n" + prose(rng, 30))
    for n in (6, 7, 8, 13, 14, 20):
        words = [f"s{n}x{k}" for k in range(n + 3)]
        out += [" ".join(words), " ".join(words[:-1]), " ".join([*words[:-1], "other"]), " ".join(words).upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    frame = spark.createDataFrame(rows_of(texts), DOCS)
    return frame.unionAll(frame.where("doc_id in (4, 12)")).unionAll(spark.createDataFrame([(None, "no id here but some words stand here, twelve of them in all", None, None, None, None, None, None, None)], DOCS))


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(spark, docs, plain):
    def brute(t):
        t = t or ""
        words, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(5)}
        return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)

    got = quality_rules.judge(docs)
    rows = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert rows == Counter((d, *brute(t)) for d, t in plain)
    assert got.where("kept and base_failed").count() == 0
    kept = Counter(r.doc_id for r in got.where("kept").collect())
    left = quality_rules.filter_documents(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == kept
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.filter_documents(empty(spark)).count() == 0


def test_bad_host_rejects_its_soft_failures(spark):
    good = " ".join(f"word{k}" for k in range(40))
    soft = good + " # # # # # # # #"
    rows = [(k, soft, "en", "bad", 1) for k in range(60)] + [(100, good, "en", "bad", 1), (101, soft, "en", "rare", 1)] + [(200 + k, good, "en", f"h{k % 20}", 1) for k in range(400)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[0].kept and got[100].kept and all(got[200 + k].kept for k in range(400))
    assert got[0].host_bad and 0 < got[101].host_rate < 1


def test_html():
    from stratavox.llm.html_blocks import blocks

    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B&copy;</h1><p><b>One\n two.<br>three<p title='a>b'>Four &lt;x&gt;</article><script>var t='</p>';</script><footer>F</footer>"
    assert [b.text for b in blocks(page)] == ["Home", "A & B©", "One two. three", "Four <x>", "F"]
    assert blocks(None) == [] and blocks("<p") != [] and blocks("<!-- x") == []
    assert len(blocks("<div>" * 5000 + "deep")) == 1


def test_html_labeller(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages")
    out = {r.page_id: r for r in queries.op2_html_extraction(spark, sf_dir).collect()}
    for r in pages.collect():
        want = [b.text for b, y in zip(html_extract.blocks(r.html), html_extract.label_by_markup(html_extract.blocks(r.html)), strict=True) if y]
        assert out[r.page_id].text == "\n".join(want) and out[r.page_id].n_chars == len(out[r.page_id].text)
    model = html_extract.train([r.html for r in pages.collect()])
    body = "The long road to the north was closed for most of the winter, they said."
    other = f"<html><body><div class='sidebar'><p>Log in</p></div><div class='content'><h1>A title of words</h1><p>{body}</p><p>{body}</p><p>{body}</p></div><div class='comments'><p>Nice one</p></div></body></html>"
    found = html_extract.blocks(other)
    score = model.scores([html_extract.Vectors().page(found)])[0]
    assert [s > 0 for s in score[2:5]] == [True] * 3 and score[0] < 0 and score[-1] < 0
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", other), (2, "u", other)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in html_extract.extract(odd, labeller=model).collect()) == [(0, False), (1, False), (2, True), (2, True)]
    assert html_extract.extract(odd.limit(0)).count() == 0


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.choice([9, 20, 35, 50]), 3000)) for k in range(25)]
    settings = decontamination.LeakSettings()
    rows = []
    for k in range(120):
        words = items[k % 25][1].split()
        for _ in range(k % 4 * len(words) // 20):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, prose(rng, rng.randrange(40), 3000) + " " + " ".join(words).upper() + ", " + prose(rng, 15, 3000)))
    rows += [(1000 + k, prose(rng, 80, 3000)) for k in range(60)] + [(2000, None), (2001, ""), (2002, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (77, None), (None, "some text without id that is long enough"), (78, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(docs, bench).collect()}
    folded = lambda t: decontamination.folded(t).decode()
    want = {}
    for d, t in rows:
        for i, x in items:
            if d < 1000 and d % 25 == i or d >= 1000 and i < 3 and t:
                e = edit_distance_in(folded(x), folded(t))
                if e <= settings.distance * len(folded(x)):
                    want[d, i] = e
    assert len(want.keys() - got.keys()) <= 0.01 * len(want) and got.items() <= want.items() and len(want) > 90
    left = decontamination.filter_documents(docs, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    many = decontamination.LeakSettings(block_items=5)
    assert {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(docs, bench, many).collect()} == got


CLASHING = ["verdict", "Bad_Host", "holder", "GONE", "key_id", "key_text", "hashed_text", "__v", "__drop", "__doc", "__th", "count", "h1"]


def test_filters_carry_columns_of_any_name(spark):
    rng = random.Random(11)
    line, copy = "a line that three documents hold", prose(rng, 60, 3000)
    texts = [f"{prose(rng, 30, 3000)}\n{line}" for _ in range(3)] + [copy, copy, copy + " end", "short", "", None]
    plain = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    wide = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    bench = spark.createDataFrame([(1, copy)], "item_id long, text string")
    steps = [(quality_rules.filter_documents, {0, 1, 2, 3, 4, 5}), (line_dedup.rewrite_documents, set(range(9))), (ngram_join.keep_one, {0, 1, 2, 3, 6, 7, 8}), (lambda d: decontamination.filter_documents(d, bench), {0, 1, 2, 6, 7, 8})]
    for step, kept in steps:
        got = step(wide)
        assert got.columns == wide.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert rows.keys() == kept
        assert all(r[c] == f"{c}{k}" for k, r in rows.items() for c in CLASHING)
    lines = {r.doc_id: r.text for r in line_dedup.rewrite_documents(wide).collect()}
    assert [line in lines[k] for k in range(3)] == [False, False, True]


def test_stretch_distance():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(low, 25))) for low in (1, 0))
        want = edit_distance_in(a, b)
        assert decontamination.stretch_distance(a, b) == want
        assert (decontamination.stretch_distance(a, b, 3) <= 3) == (want <= 3)


@pytest.mark.parametrize(("words", "share", "least"), [(5, 10, 0.8), (8, 15, 0.9), (12, 15, 0.9), (20, 18, 0.9), (40, 18, 0.9)])
def test_decontamination_recall_of_edited_characters(words, share, least):
    """Characters replaced, doubled and dropped anywhere in the item; in one very long text and in short ones."""
    rng = random.Random(words)
    items = [(k, prose(rng, words, 3000)) for k in range(60)]
    finder = decontamination.LeakFinder(items, decontamination.LeakSettings())
    texts, allowed = [], []
    for _, item in items:
        letters = list(item)
        for k in rng.sample(range(len(letters)), len(letters) * share // 100):
            letters[k] = rng.choice(["", "ab", *"efghij"])
        texts.append(f"{prose(rng, 30, 3000)} {''.join(letters)} {prose(rng, 30, 3000)}")
        target = decontamination.folded(item).decode()
        allowed.append(decontamination.stretch_distance(target, decontamination.folded(texts[-1]).decode()) <= 0.2 * len(target))
    for found in (finder.find(texts), finder.find([" ".join(texts)]) * 60):
        hits = sum(k in [x[0] for x in f] for k, f in enumerate(found) if allowed[k])
        assert sum(allowed) >= 20 and hits >= least * sum(allowed)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    text = text or ""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


ODD_PII = ["a@b.c_d@e.f x@y", "1.2.3.4.5 256.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 then 4111-1111-1111-1112", "+1 (972) 555-7713 +12 3456 +1234567890123456 ++49 30 1234567", "日本 x@y.de 𝒳 10.0.0.1", "0" * 16 + " " + "1 2 " * 3000, "é" * 50 + "a.b+c%d@e-f.g.h.", "4111111111111111 4111111111111111"]


def test_pii(spark, docs, sf_dir):
    extra = spark.createDataFrame(rows_of(ODD_PII), DOCS).withColumn("doc_id", F.col("doc_id") + 9000)
    for frame in (docs.unionAll(extra), queries.table(spark, sf_dir, "documents")):
        kinds = [*pii.PATTERNS]
        got = pii.find(frame).select("doc_id", pii.joined_spans(kinds).alias("base"), pii.joined_spans([*kinds, "terms"]).alias("spans"))
        want = Counter((r.doc_id, ",".join(brute_spans(r.text))) for r in frame.collect())
        rows = got.collect()
        assert Counter((r.doc_id, r.base) for r in rows) == want
        assert all(r.spans.startswith(r.base) for r in rows)
    assert pii.find(empty(spark)).count() == 0


def test_pii_terms(spark):
    rng = random.Random(3)
    rows = [(k, f"{prose(rng, 40)} filler common zebrafish wrote to ann@x.org about common things {prose(rng, 40)}") for k in range(4)]
    rows += [(10 + k, f"common {prose(rng, 60)}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {d: t for d, t in rows}
    for r in pii.find(docs).where("doc_id < 4").collect():
        named = {text[r.doc_id][t.start : t.end]: t.removed for t in r.terms}
        assert named.get("zebrafish") is True and "common" not in named
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "zebrafish" not in clean[0] and "ann@" not in clean[0] and clean[10] == text[10]


def test_native_pii_has_no_python(spark, sf_dir):
    plan = queries.op4_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_toxicity(spark):
    from zlib import crc32

    rng = random.Random(2)
    insults = ["blockhead", "dunderpate", "scoundrel"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = [rng.choice("the of and in to a".split()) if rng.random() < 0.3 else "".join(rng.choice(["an", "er", "th", "ou", "in", "re", "ti"]) for _ in range(3)) for _ in range(50)]
        if toxic:
            words[rng.randrange(50)] = rng.choice(insults)
            words[rng.randrange(50)] = rng.choice(insults)
        rows.append((k, " ".join(words) + "."))
        labels.append((k, 1, int(toxic)))
    rows += [(5000, "He is a block.head and a dunder-pate in all."), (5001, None), (5002, " "), (None, "the thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [k for k in range(900) if crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (crc32(str(k).encode()) % 4 == 2) for k in range(900))
    right = sum(got[k].predicted == int(k % 3 == 0) for k in held)
    assert right >= 0.97 * len(held)
    assert got[5000].predicted == 1 and got[5001].score == got[5002].score == 0.0 and got[None].score < 0.3
    assert toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).where("score > 0.3").count() == 0
    assert toxicity.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxic_strings_tolerate_gaps_and_never_lower_a_score():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "in", "re", "ti"]) for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(12)) + ". "
    clean = ["".join(sentence() for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    # Each insult in sentences of its own; ten copies of one toxic text teach nothing more than one does.
    toxic = ["".join(sentence() for _ in range(rng.randrange(1, 6))) + f"Such a {rng.choice(['blockhead', 'scoundrel'])} and {word()} {rng.choice(['blockhead', 'scoundrel'])}." for _ in range(100)]
    copied = "quibblers " + sentence()
    texts = clean + toxic + [toxic[0] + copied] * 10
    machine = toxicity.fit([t.encode() for t in texts], [0] * 300 + [1] * 110)
    assert (machine.document[1:] >= 0).all()
    decide = lambda w: machine.decide([w])[0]
    assert decide(b"quibblers") < 0.5 < min(decide(w) for w in (b"blockhead", b"bl\x1fockhead", b"blockzhead", b"scoun\x1fdrel", b"scxoundrel"))
    for text in ["", *clean[:40], *toxic[:40]]:
        before, after = machine.scores([text.encode(), (text + " blockhead").encode()], {})
        assert after >= before


def test_collapsed_machine_is_the_kernel_expansion():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(20)) + (" zyxwv zyxwv" if k % 2 else "") for k in range(60)]
    machine = toxicity.fit([t.encode() for t in texts], [k % 2 for k in range(60)], toxicity.ToxicitySettings(landmarks=20))
    value = machine.decide([b"zyxwv"])[0]
    brute = machine.bias
    from itertools import combinations

    for order in toxicity.ORDERS:
        total = norm = 0.0
        for c in combinations(range(5), order):
            weight = 0.7 ** (c[-1] - c[0] + 1 - order)
            code = 0
            for p in c:
                code = code * 32 + b"zyxwv"[p] - 97
            total += weight * machine.tables[order][code]
            norm += weight**2
        brute += total / norm**0.5
    assert abs(value - brute) < 1e-5 and value > machine.decide([b"abcde"])[0]


def brute_lines(plain):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = defaultdict(set)
    for d, t in plain:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = Counter()
    for d, t in plain:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark, docs, plain):
    got = line_dedup.dedup_lines(docs)
    want = brute_lines(plain)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == want
    assert sum(k[2] for k in want) > 10
    texts = Counter((r.doc_id, r.kept_text) for r in got.collect())
    rewritten = line_dedup.rewrite_documents(docs)
    assert rewritten.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in rewritten.collect()) == texts
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_index_is_reversible(spark, docs):
    rules = line_dedup.LineRules(min_chars=1, min_docs=2)
    half = docs.where("doc_id % 2 = 0 or doc_id is null")
    once = line_dedup.LineIndex.empty(spark, 3).insert(line_dedup.line_refs(half, rules))
    twice = once.insert(line_dedup.line_refs(docs, rules))
    counts = lambda i: {(r.h1, r.h2): (r.n_docs, r.top_doc) for r in i.counts.collect()}
    whole = line_dedup.LineIndex.empty(spark, 3).insert(line_dedup.line_refs(docs, rules))
    assert counts(twice) == counts(whole) != counts(once)
    back = twice.delete(docs.where("doc_id % 2 = 1").select("doc_id"))
    assert counts(back) == counts(once)
    held = sum(np.count_nonzero(CuckooFilter.from_bytes(r.cuckoo).table) for r in back.filters.collect())
    assert held == len(counts(once))
    for index in (once, twice, back):
        assert index._probe(index.counts).where("not known").count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    f = CuckooFilter.build(keys[:15000])
    assert f.contains(keys[:15000]).all() and f.contains(keys[15000:]).mean() < 0.01
    f.delete(keys[:5000])
    assert np.count_nonzero(f.table) == 10000 and f.contains(keys[5000:15000]).all() and f.contains(keys[:5000]).mean() < 0.05
    assert not CuckooFilter.build(keys[:0]).contains(keys).any()


def brute_windows(plain, n=35):
    words = [WORD.findall(t or "") for _, t in plain]
    count = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = Counter()
    for (d, _), w in zip(plain, words, strict=True):
        gone = {k + j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def test_substring_dedup(spark, docs, plain):
    more = ["p q " * 60, "p q " * 17 + "p", "m " + "p q " * 16 + "p q n", " ".join(f"u{k}" for k in range(36)) + " " + " ".join(f"u{k}" for k in range(35))]
    frame = docs.unionAll(spark.createDataFrame(rows_of(more), DOCS).withColumn("doc_id", F.col("doc_id") + 500))
    plain = [*plain, *((500 + k, t) for k, t in enumerate(more))]
    want = brute_windows(plain)
    got = substring_dedup.dedup_substrings(frame)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert sum(k[2] > 0 for k in want) > 20
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_token_counts(spark, docs, plain):
    path = queries.vocabulary("piece_bpe_32k.model")
    v = token_counts.UnigramVocabulary.load(path)

    def brute(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            width = len(text[end - 1].encode())
            options = [(best[end - 1][0] + v.byte * width, best[end - 1][1] + width)]
            options += [(v.pieces[text[s:end]] + best[s][0], best[s][1] + 1) for s in range(end) if text[s:end] in v.pieces]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    got = token_counts.count_tokens(docs, path)
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in got.collect()) == Counter((d, len(WORD.findall(t or "")), sum(map(brute, WORD.findall(t or "")))) for d, t in plain)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_bpe(spark, docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    odd = ["<|endoftext|>x<|endoftext|> y" * 3, "日本語 " * 400 + "a b c " * 300, "x" * 5000, " " * 3000 + "a", "don't we'll " * 300, "é à ü x " * 500, "a\r\n" * 900, "a b<|endoftext|> c" * 200, "a  b\u0085 c " * 300, "tail  " * 500 + " ", " x" * 900]
    odd += ["".join(rng.choice(["a", " ", "\n", "é", "1", ".", "'s", "the ", " ", "word "]) for _ in range(4000)) for _ in range(20)]
    frame = docs.unionAll(spark.createDataFrame(rows_of(odd), DOCS).withColumn("doc_id", F.col("doc_id") + 700))
    plain = [*plain, *((700 + k, x) for k, x in enumerate(odd))]
    want = Counter()
    for d, x in plain:
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = bpe.coded(frame, queries.bpe_settings(), full=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((d, x or "") for d, x in plain)
    assert bpe.coded(empty(spark), queries.bpe_settings()).count() == 0


def test_bpe_small_chunks_agree():
    settings = bpe.BpeSettings(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken"), chunk=16)
    encoder = bpe.ChunkEncoder(settings)
    rng = random.Random(9)
    for _ in range(60):
        x = "".join(rng.choice(["the ", "word", " ", "\n", "é", "12", ",", "日本", " of"]) for _ in range(300))
        assert encoder.encode(x) == encoder.whole.encode(x, add_special_tokens=False).ids
    assert encoder.encode(x * 3) == encoder.whole.encode(x * 3, add_special_tokens=False).ids and encoder.reused > 0


def brute_join(plain):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for _, t in plain:
        w = WORD.findall(lower(t or ""))
        k = min(4, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(plain):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return Counter((d, len(s), least.get(root(k))) for k, ((d, _), s) in enumerate(zip(plain, sets, strict=True)))


@pytest.mark.parametrize("rounds", [0, 2])
def test_ngram_join(spark, docs, plain, rounds):
    got = ngram_join.join_documents(docs, ngram_join.JaccardSettings(rounds=rounds, pairs_per_entry=0))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(plain)


def test_ngram_join_chain_of_copies(spark):
    rng = random.Random(8)
    words = prose(rng, 120, 5000).split()
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[rng.randrange(120)] = f"new{k}"
    plain = rows + [(100 + k, prose(rng, 5 + k % 20, 5000)) for k in range(40)]
    got = ngram_join.join_documents(spark.createDataFrame(plain, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(plain)
    left = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    assert left == {c for _, _, c in brute_join(plain)}


def test_pivot_members_with_few_pairs_are_not_listed(spark):
    settings = ngram_join.JaccardSettings()
    of = lambda key, members, grams: [(key, 100 * key + k, 100 * key + k, 1000, 0, [*range(grams)]) for k in range(members)]
    named = spark.createDataFrame(of(1, 14, 100) + of(2, 14, 2) + of(3, 70, 200), "key long, id long, component long, reach long, excess long, grams array<long>")
    few, long = ngram_join.short_and_long(named, settings)
    assert few.count() == 14 * 13 // 2 and {r.key for r in long.collect()} == {2, 3}
    rng = random.Random(3)
    core, plain = prose(rng, 230, 5000).split(), []
    for k in range(20):
        words = list(core)
        for at in rng.sample(range(230), 2 + k % 7):
            words[at] = f"own{k}x{at}"
        plain.append((k, " ".join(words)))
    got = ngram_join.join_documents(spark.createDataFrame(plain, "doc_id long, text string"), settings)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(plain)


def test_ngram_join_empty(spark):
    assert ngram_join.join_documents(empty(spark)).count() == 0
    some = ngram_join.join_documents(spark.createDataFrame([(3, None), (4, " ")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in some) == [(3, 0, 3), (4, 0, 4)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)] + [(500, 500), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
