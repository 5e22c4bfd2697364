"""Toxicity scores from a subsequence string-kernel support vector machine.

The kernel of two strings adds up their common subsequences of 3 and of 4 characters, each
weighted by ``decay`` to the power of the stretch it spans, so that ``id.iot`` or
``idxiot`` stay close to ``idiot``. A Nyström map of landmark strings turns the kernel
into coordinates, in which a squared-hinge support vector machine is trained on strings of
labelled sentences. For scoring, landmarks and weights collapse, without loss, into one
table of weights by subsequence.

Sentences inherit the label of their document; one that a clean document holds too is
clean. Strings that stand mostly in toxic sentences are the positive examples, together with
virtual ones that hold a gap or one more letter; clean strings that come out high join the
negative ones, round by round. A document's score is a logistic function of its highest
string scores, fitted on a third of the training documents, whose strings the machine has
not met. Its weights are not negative: one more insult never lowers a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Symbols: 0-25 letters, 26-30 parts of other letters, 31 anything else, which only makes gaps.
SIZE, GAP = 32, 31
ORDERS = (3, 4)
PIECE, STRIDE = 12, 4
SENTENCE = re.compile(rb"[.!?\n]+")
SPACED = re.compile(rb"(?:(?<=\s)|^)(?:[^\s\x1f]\s){2,}[^\s\x1f](?=\s|$)")


def _symbols() -> tuple[bytes, np.ndarray]:
    """Bytes with case and look-alike digits folded, and the symbol of each byte."""
    fold = bytearray(range(256))
    for k in range(65, 91):
        fold[k] = k + 32
    for a, b in zip(b"013457@$", b"oieastas", strict=True):
        fold[a] = b
    for k in range(33, 127):
        if not chr(fold[k]).isalpha():
            fold[k] = GAP
    symbol = np.full(256, GAP, np.int64)
    symbol[97:123] = np.arange(26)
    symbol[128:192] = 26 + np.arange(64) % 5
    return bytes(fold), symbol


FOLD, SYMBOL = _symbols()
LEADS = bytes(range(192, 256))


@dataclass(frozen=True)
class ToxicitySettings:
    #: Bounds of the labelled rows that the machine is fitted on, and of their length.
    toxic_documents: int = 1500
    clean_documents: int = 3000
    document_chars: int = 30_000
    strings: int = 48_000
    landmarks: int = 384
    decay: float = 0.7
    span: int = 7
    ridge: float = 1e-5
    #: Toxic sentences that a string must stand in to count as an example: at least this
    #: many, and this share of the toxic documents.
    support: int = 5
    support_share: float = 0.025
    #: Log-odds of such a string, and the weight of its virtual examples against its own.
    odds: float = 3.0
    virtual: float = 0.3
    #: Rounds of fitting; each adds clean strings whose value is above ``margin``.
    turns: int = 3
    margin: float = -0.6
    #: Share of the toxic documents in the weights of the logistic function.
    toxic_share: float = 0.15
    threshold: float = 0.3
    #: One part of this many of the sample fits the logistic function, the others the machine.
    parts: int = 3
    seed: int = 11


def strings(text: bytes) -> list[bytes]:
    """Folded strings of a text: its words, and runs of single characters as one word."""
    folded = text.translate(FOLD, LEADS)
    if SPACED.search(folded):
        folded = SPACED.sub(lambda m: b"".join(m[0].split()), folded)
    return folded.split()


@lru_cache(maxsize=None)
def patterns(length: int, order: int, span: int, decay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of subsequences in a string of this length, their weights and the string's norm."""
    places = np.array([c for c in combinations(range(length), order) if c[-1] - c[0] < span], np.int64).reshape(-1, order)
    weights = (decay ** (places[:, -1] - places[:, 0] + 1 - order)).astype(np.float32)
    return places, weights, float(np.sqrt((weights**2).sum()))


def pieces(word: bytes) -> list[bytes]:
    """A string as pieces of bounded length that cover it."""
    word = word.strip(b"\x1f")
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE + STRIDE, STRIDE)]


def by_length(items: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Positions and symbols of the items of each length."""
    lengths = np.array([len(x) for x in items])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n >= min(ORDERS):
            yield int(n), at, SYMBOL[np.frombuffer(b"".join(items[k] for k in at), np.uint8)].reshape(len(at), n)


def codes(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of one subsequence in each row; subsequences with a gap symbol are number 0's complement, -1."""
    out, gap = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), bool)
    for p in places:
        out = out * SIZE + symbols[:, p]
        gap |= symbols[:, p] == GAP
    out[gap] = -1
    return out


class StringMachine:
    """The collapsed machine: a weight for each subsequence, and the document's logistic function."""

    def __init__(self, settings: ToxicitySettings, tables: dict[int, np.ndarray], bias: float) -> None:
        self.settings, self.tables, self.bias = settings, tables, bias
        self.document = np.array([-4.0, 4.0, 0.0, 0.0], np.float64)

    def decide(self, items: list[bytes]) -> np.ndarray:
        """Decision values; items too short for any subsequence get the bias."""
        out = np.full(len(items), self.bias, np.float64)
        s = self.settings
        for n, at, symbols in by_length(items):
            for order in ORDERS:
                places, weights, norm = patterns(n, order, s.span, s.decay)
                if norm:
                    table, total = self.tables[order], np.zeros(len(at))
                    for place, weight in zip(places, weights, strict=True):
                        total += weight * table[codes(symbols, place)]
                    out[at] += total / norm
        return out

    def highest(self, texts: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """Features of each text: 1, highest and third highest string score, and how many are high."""
        found = [Counter(strings(t)) for t in texts]
        new = [w for w in set().union(*found) if w not in known]
        if len(known) + len(new) > 1_000_000:
            known.clear()
            new = list(set().union(*found))
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            cut = [pieces(w) for w in part]
            score = self.decide([p for c in cut for p in c])
            ends = np.cumsum([len(c) for c in cut])
            known.update(zip(part, np.maximum.reduceat(score, ends - [len(c) for c in cut]).tolist(), strict=True))
        out = np.zeros((len(texts), 4))
        for row, words in zip(out, found, strict=True):
            top = sorted((known[w] for w in words), reverse=True)[:3]
            n = sum(words.values())
            high = sum(c for w, c in words.items() if known[w] > 0)
            row[:] = 1, (np.clip(top[0], -3, 1) if top else -3), (np.clip(top[-1], -3, 1) if len(top) == 3 else -3), high / np.sqrt(n + 1)
        return out

    def scores(self, texts: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        z = np.clip(self.highest(texts, known) @ self.document, -30, 30)
        return np.where([not t.split() for t in texts], 0.0, 1 / (1 + np.exp(-z)))


def fit(texts: list[bytes], toxic: list[int], settings: ToxicitySettings = ToxicitySettings()) -> StringMachine:
    """Machine from labelled texts. With labels of one class only, every score is low."""
    rng = np.random.default_rng(settings.seed)
    # Copies of a document hold the same sentences: each distinct one counts once, as toxic if no clean document holds it.
    sentences: dict[bytes, int] = {}
    aside = np.array([zlib.crc32(t) % settings.parts == 0 for t in texts], bool)
    target = np.array(toxic, np.float64)
    if len(set(target[aside])) < 2 or len(set(target[~aside])) < 2:
        aside[:] = False
    for text, label in zip((t for t, a in zip(texts, aside, strict=True) if not a), target[~aside].astype(int).tolist(), strict=True):
        for sentence in SENTENCE.split(text):
            words = b" ".join(strings(sentence))
            sentences[words] = min(label, sentences.get(words, 1))
    totals = Counter(), Counter()
    counts = [0, 0]
    for sentence, label in sentences.items():
        units = {p for w in sentence.split() for p in pieces(w) if len(p) >= min(ORDERS)}
        totals[label].update(units)
        counts[label] += bool(units)
    empty = {order: np.zeros(SIZE**order + 1, np.float32) for order in ORDERS}
    if not all(counts):
        return StringMachine(settings, empty, -1.0)

    odds = lambda w: np.log((totals[1][w] + 0.2) / counts[1]) - np.log((totals[0][w] + 0.2) / counts[0])
    vocabulary = sorted(set(totals[0]) | set(totals[1]))
    strength = np.array([abs(odds(w)) * np.log1p(totals[0][w] + totals[1][w]) for w in vocabulary])
    support = max(settings.support, settings.support_share * target[~aside].sum())
    # A string of few sentences tells little: without clean support it is left to its neighbours.
    label = np.array([1.0 if odds(w) > settings.odds and totals[1][w] >= support else -1.0 if totals[0][w] and odds(w) < 0.7 else 0.0 for w in vocabulary])
    vocabulary, strength, label = [w for w, k in zip(vocabulary, label, strict=True) if k], strength[label != 0], label[label != 0]
    if not (label > 0).any() or not (label < 0).any():
        return StringMachine(settings, empty, -1.0)
    order = np.argsort(-strength, kind="stable")
    half = settings.strings // 2
    chosen = np.concatenate([order[:half], rng.permutation(order[half:])[:half]])
    items, y, pull = [vocabulary[k] for k in chosen], label[chosen], np.minimum(strength[chosen], 8.0)

    positive = [k for k in np.argsort(-strength[chosen] * (y > 0), kind="stable")[: settings.landmarks * 2 // 3] if y[k] > 0]
    negative = [k for k in rng.permutation(len(items)) if y[k] < 0][: settings.landmarks - len(positive)]
    marks = [items[k] for k in [*positive, *negative]]

    columns_of, rows = {}, {}
    for size in ORDERS:
        entries: dict[int, dict[int, float]] = {}
        for n, at, symbols in by_length(marks):
            places, weights, norm = patterns(n, size, settings.span, settings.decay)
            for place, w in zip(places, weights, strict=True):
                for code, k in zip(codes(symbols, place), at, strict=True):
                    if code >= 0:
                        own = entries.setdefault(int(code), {})
                        own[int(k)] = own.get(int(k), 0.0) + float(w) / norm
        index = np.zeros(SIZE**size + 1, np.int64)
        matrix = np.zeros((len(entries) + 1, len(marks)), np.float32)
        for i, (code, own) in enumerate(sorted(entries.items()), 1):
            index[code] = i
            for k, v in own.items():
                matrix[i, k] = v
        columns_of[size], rows[size] = index, matrix

    def kernel(of: list[bytes]) -> np.ndarray:
        out = np.zeros((len(of), len(marks)), np.float32)
        for n, at, symbols in by_length(of):
            for size in ORDERS:
                places, weights, norm = patterns(n, size, settings.span, settings.decay)
                for place, w in zip(places, weights, strict=True):
                    i = columns_of[size][codes(symbols, place)]
                    hit = np.flatnonzero(i)
                    out[at[hit]] += (w / norm) * rows[size][i[hit]]
        return out

    values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])

    def coordinates(of: list[bytes]) -> np.ndarray:
        """Nyström coordinates and a 1, in blocks of bounded size."""
        out = np.ones((len(of), root.shape[1] + 1), np.float32)
        for k in range(0, len(of), 4096):
            out[k : k + 4096, :-1] = kernel(of[k : k + 4096]) @ root
        return out

    for k in np.flatnonzero(y > 0):  # virtual examples: the string with a gap or with one more letter at each inner place
        made = [items[k][:at] + more + items[k][at:] for at in range(1, len(items[k])) for more in (b"\x1f", bytes([97 + int(rng.integers(26))]))]
        items += made
        y, pull = np.append(y, np.ones(len(made))), np.append(pull, np.full(len(made), settings.virtual * pull[k] / max(1, len(made))))
    x = coordinates(items)
    others = [w for w, k in zip(vocabulary, label, strict=True) if k < 0]
    penalty = settings.ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-8
    for turn in range(settings.turns):
        weight = np.where(y > 0, pull / pull[y > 0].sum(), pull / max(1e-9, pull[y < 0].sum()))
        beta = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps of the squared hinge
            left, right = penalty.copy(), np.zeros(x.shape[1])
            for k in range(0, len(x), 4096):
                xi, yi = x[k : k + 4096].astype(np.float64), y[k : k + 4096]
                wi = np.where(yi * (xi @ beta) < 1, weight[k : k + 4096], 0.0)
                left += (xi * wi[:, None]).T @ xi
                right += xi.T @ (wi * yi)
            new = np.linalg.solve(left, right)
            if np.abs(new - beta).max() < 1e-8:
                break
            beta = new
        collapsed = root @ beta[:-1]
        tables = {size: empty[size].copy() for size in ORDERS}
        for size in ORDERS:
            tables[size][:-1] = (rows[size] @ collapsed)[columns_of[size][:-1]]
        machine = StringMachine(settings, tables, float(beta[-1]))
        if turn + 1 < settings.turns:  # clean strings that come out highest join the examples
            value = machine.decide(others)
            worst = [k for k in np.argsort(-value, kind="stable")[: settings.strings // 8] if value[k] > settings.margin]
            if not worst:
                break
            x = np.concatenate([x, coordinates([others[k] for k in worst])])
            y, pull = np.append(y, -np.ones(len(worst))), np.append(pull, np.full(len(worst), 8.0))

    if aside.any():  # documents whose strings the machine has not met weigh its values
        texts, target = [t for t, a in zip(texts, aside, strict=True) if a], target[aside]
    features = machine.highest(texts, {})
    share = np.where(target > 0, settings.toxic_share / max(1, target.sum()), (1 - settings.toxic_share) / max(1, (1 - target).sum()))
    used = np.ones(features.shape[1], bool)
    while True:  # a string may not lower a document's score: features with a negative weight go
        theta, f = np.zeros(features.shape[1]), features[:, used]
        for _ in range(50):  # Newton steps of the logistic function
            p = 1 / (1 + np.exp(-np.clip(f @ theta[used], -30, 30)))
            slope = f.T @ (share * (p - target)) + (2e-3 * theta * [0, 1, 1, 1])[used]
            curve = (f * (share * p * (1 - p))[:, None]).T @ f + 2e-3 * np.diag(np.array([1e-3, 1, 1, 1])[used])
            theta[used] -= np.linalg.solve(curve, slope)
        if (theta[1:] >= 0).all():
            break
        used &= np.append(True, theta[1:] >= 0)
    machine.document = theta
    return machine


def held_out(doc_id) -> F.Column:  # type: ignore[name-defined]
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings) -> tuple[list[bytes], list[int]]:
    """Texts and labels of a bounded sample outside the held-out rows, by smallest hash of doc_id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, settings.toxic_documents), (0, settings.clean_documents))]
    chosen = docs.join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id").where(F.length("text") <= settings.document_chars)
    rows = sorted((r.doc_id, r.text or "", r.toxic) for r in chosen.collect())
    return [t.encode() for _, t, _ in rows], [y for _, _, y in rows]


def score(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings(), machine: StringMachine | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts score 0. Labels other than 0 and 1 and labels without document are
    left out; a document with both labels counts as toxic. Repeated rows are scored each.
    Without usable labels every score is low. Only doc_id and text are read of ``docs``.
    """
    docs = columns(docs, "doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    model = machine or fit(*labelled_sample(docs, columns(labels, "doc_id", "toxic"), settings), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = model.scores([(t.as_py() or "").encode() for t in part.column(2)], known)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
