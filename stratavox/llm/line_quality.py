"""Document quality from a linear-chain conditional random field over lines.

Every line has a state, good or bad. Its potential adds up weights of binned measures of
the line itself and of the lines before and behind it, and neighbouring states share a
transition weight. The field is fitted by its conditional likelihood; lines inherit the
label of their document, and lines of bad documents that the fitted field takes for good
are relabelled before it is fitted again.

A document's quality is the mean of its lines' forward-backward marginals, weighted by line
length, through a logistic function fitted on labelled documents that the field has not
seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, columns

#: Classes of bytes: lower, upper, digit, blank, ``.,;:``, ``!?``, symbols, other marks, beyond ASCII (lead and following bytes).
CLASSES = 10
KIND = np.full(256, 7, np.int64)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c\n", b".,;:", b"!?", b"#*$%&|<>")):
    KIND[list(_set)] = _k
KIND[192:], KIND[128:192] = 8, 9
BLANK = 3
MEASURES = 22


@dataclass(frozen=True)
class LineSettings:
    #: Bounds of the labelled documents that the field is fitted on, and of their length.
    bad_documents: int = 1500
    good_documents: int = 3000
    document_chars: int = 30_000
    bins: int = 8
    ridge: float = 2.0
    steps: int = 120
    #: Rounds of relabelling, and the marginal from which a line of a bad document counts as good.
    rounds: int = 2
    relabel: float = 0.8
    threshold: float = 0.3
    seed: int = 5


HASHER = SpanHasher(17)


def measured(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line of every text, number of lines of each text, and length of each line.

    All lines are measured at once: by counts of byte classes, and by hashes of words and of
    5-word windows that are met again in the line or the text.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(line * CLASSES + KIND[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    counts[:, BLANK] -= 1
    length = counts.sum(axis=1) - counts[:, 9]

    blank = KIND[data] == BLANK
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    word_line, size = line[first], last - first
    prefix = HASHER.prefix(data)
    word = HASHER.spans(prefix, first, last)
    words = np.bincount(word_line, minlength=n)

    def again(keys: np.ndarray, group: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Number, by ``of``, of places whose key stands elsewhere in the group too."""
        if not len(keys):
            return np.zeros(n)
        order = np.lexsort((keys, group))
        same = (keys[order][1:] == keys[order][:-1]) & (group[order][1:] == group[order][:-1])
        met = np.zeros(len(keys), bool)
        met[order[1:]] |= same
        met[order[:-1]] |= same
        return np.bincount(of, weights=met, minlength=n)

    window = HASHER.runs(word, 5)
    whole = text_of[word_line]
    inside = whole[: len(window)] == whole[4:] if len(window) else np.zeros(0, bool)
    window, window_line = window[inside], word_line[: len(inside)][inside]
    alike = HASHER.spans(prefix, starts, ends)
    follows = np.bincount(word_line[1:], weights=(word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1]), minlength=n) if len(word) else np.zeros(n)
    marked = np.bincount(word_line, weights=(KIND[data[last - 1]] >= 5) & (KIND[data[last - 1]] <= 7), minlength=n)
    capital = np.bincount(word_line, weights=KIND[data[first]] == 1, minlength=n)
    final = np.where(ends > starts, KIND[data[np.maximum(ends - 1, 0)]], -1)
    some, chars = np.maximum(words, 1), np.maximum(length, 1)
    share = lambda k: counts[:, k] / chars
    out = np.stack(
        [
            np.log1p(words), np.log1p(length), np.bincount(word_line, weights=size, minlength=n) / some, np.bincount(word_line, weights=size <= 2, minlength=n) / some,
            np.bincount(word_line, weights=size >= 12, minlength=n) / some, share(0), share(1), share(2), share(4), share(5), share(6), share(7), share(8),
            again(word, word_line, word_line) / some, again(window, text_of[window_line], window_line) / some, follows / some, marked / some, capital / some,
            again(alike, text_of, np.arange(n)) * (length > 0), final == 4, final == 5, np.log1p(per_text)[text_of],
        ],
        axis=1,
    )
    return out, per_text, np.maximum(length, 1)


def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of about a megabyte, so that what is measured together has a bound beside the longest text."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > 1_000_000:
            yield held
            held, size = [], 0
    if held:
        yield held


class LineField:
    """A fitted field of two states, 0 bad and 1 good, and the logistic function of a document."""

    def __init__(self, settings: LineSettings, edges: np.ndarray) -> None:
        self.settings, self.edges = settings, edges
        self.width = MEASURES * settings.bins + 1  # the last place says that there is no such line
        self.weights = np.zeros(3 * self.width + 1)
        self.transition = np.zeros((2, 2))
        self.document = np.array([0.0, 1.0])

    def places(self, measures: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Places of the weights of each line: of its own bins and those of the lines before and behind."""
        own = np.stack([np.searchsorted(e, measures[:, k], side="right") + k * self.settings.bins for k, e in enumerate(self.edges)], axis=1)
        missing = np.full((1, MEASURES), self.width - 1)
        ends = np.cumsum(per_text)
        before, behind = np.concatenate([missing, own[:-1]]), np.concatenate([own[1:], missing])
        before[ends - per_text], behind[ends - 1] = missing, missing
        return np.concatenate([own, before + self.width, behind + 2 * self.width], axis=1)

    def potentials(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(axis=1) + self.weights[-1]

    def marginals(self, potential: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of the good state of each line, expected transitions, and the sum of the log partitions.

        Texts go in parallel, the longest first, so that those still open at a step are the first ones.
        """
        order = np.argsort(-per_text, kind="stable")
        sizes, begin = per_text[order], (np.cumsum(per_text) - per_text)[order]
        steps = sizes[0] if len(sizes) else 0
        open_at = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts of over t lines
        node = np.stack([np.zeros(len(potential)), potential], axis=1)
        ahead, back = np.zeros_like(node), np.zeros_like(node)
        total = 0.0
        for t in range(steps):
            at = begin[: open_at[t]] + t
            ahead[at] = node[at] if t == 0 else node[at] + np.logaddexp(ahead[at - 1, :1] + self.transition[0], ahead[at - 1, 1:] + self.transition[1])
        for t in range(steps - 2, -1, -1):
            at = begin[: open_at[t + 1]] + t
            next_ = node[at + 1] + back[at + 1]
            back[at] = np.logaddexp(next_[:, :1] + self.transition[:, 0], next_[:, 1:] + self.transition[:, 1])
        last = ahead[begin + sizes - 1]
        log_z = np.logaddexp(last[:, 0], last[:, 1])
        total = float(log_z.sum())
        z = np.empty(len(per_text))
        z[order] = log_z
        z = np.repeat(z, per_text)
        good = np.exp(np.clip(ahead[:, 1] + back[:, 1] - z, -60, 0))
        inner = np.ones(len(potential), bool)
        inner[np.cumsum(per_text) - 1] = False
        at = np.flatnonzero(inner)
        joint = ahead[at, :, None] + self.transition + (node + back)[at + 1, None, :] - z[at, None, None]
        return good, np.exp(joint).sum(axis=0), total

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each text."""
        return np.concatenate([self.quality_of_part(part) for part in parts(texts)]) if texts else np.zeros(0)

    def quality_of_part(self, texts: list[bytes]) -> np.ndarray:
        measures, per_text, length = measured(texts)
        good, _, _ = self.marginals(self.potentials(self.places(measures, per_text)), per_text)
        at = np.cumsum(per_text) - per_text
        mean = np.clip(np.add.reduceat(good * length, at) / np.add.reduceat(length, at), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.document[0] + self.document[1] * self.quality(texts), -30, 30)))

    def fit(self, places: np.ndarray, per_text: np.ndarray, state: np.ndarray) -> None:
        """Maximises the conditional likelihood, less a ridge, by L-BFGS."""
        inner = np.ones(len(state), bool)
        inner[np.cumsum(per_text) - 1] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(state[at] * 2 + state[at + 1], minlength=4).reshape(2, 2)
        size = len(self.weights)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            self.weights, self.transition = x[:size], x[size:].reshape(2, 2)
            potential = self.potentials(places)
            good, expected, total = self.marginals(potential, per_text)
            value = total - potential @ state - (self.transition * seen).sum() + 0.5 * self.settings.ridge * (x @ x)
            rest = good - state
            slope = np.bincount(places.ravel(), weights=np.repeat(rest, places.shape[1]), minlength=size)
            slope[-1] += rest.sum()
            return value, np.concatenate([slope, (expected - seen).ravel()]) + self.settings.ridge * x

        x = minimised(loss, np.concatenate([self.weights, self.transition.ravel()]), self.settings.steps)
        self.weights, self.transition = x[:size], x[size:].reshape(2, 2)


def minimised(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:  # type: ignore[no-untyped-def]
    """Smallest value of a convex function by L-BFGS with halved steps."""
    value, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way -= a * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        step = 1.0
        while True:
            new_value, new_slope = loss(x - step * way)
            if new_value <= value - 1e-4 * step * (slope @ way) or step < 1e-6:
                break
            step /= 2
        s, y = -step * way, new_slope - slope
        if s @ y > 1e-10:
            pairs = [*pairs[1 - memory :], (s, y)]
        done = abs(value - new_value) < 1e-5 * max(1.0, abs(value))
        x, value, slope = x - step * way, new_value, new_slope
        if done:
            break
    return x


def fit(texts: list[bytes], good: list[int], shares: tuple[float, float] = (1.0, 1.0), settings: LineSettings = LineSettings()) -> LineField:
    """Field from labelled texts; ``shares`` weigh bad and good texts in the logistic function.

    With texts of one class only, or none, every score is that class's side of one half.
    """
    label = np.array(good, np.int64)
    field = LineField(settings, np.zeros((MEASURES, settings.bins - 1)))
    if not len(label) or label.min() == label.max():
        field.document = np.array([0.0 if not len(label) else 2.0 if label[0] else -2.0, 0.0])
        return field
    for_field = np.random.default_rng(settings.seed).random(len(texts)) < 0.75
    if len(set(label[for_field].tolist())) < 2 or len(set(label[~for_field].tolist())) < 2:
        for_field[:] = True
    own = [t for t, k in zip(texts, for_field, strict=True) if k]
    measures, per_text = (np.concatenate(x) for x in list(zip(*map(measured, parts(own)), strict=True))[:2])
    steps = np.arange(1, settings.bins) / settings.bins
    for k in range(MEASURES):  # half of the bounds by rank, so that rare high values have bins of their own
        values = np.unique(measures[:, k])
        field.edges[k] = np.sort(np.where(np.arange(settings.bins - 1) % 2, np.quantile(measures[:, k], steps), np.quantile(values, steps)))
    places = field.places(measures, per_text)
    inherited = np.repeat(label[for_field], per_text)
    state = inherited.copy()
    for k in range(settings.rounds + 1):
        if k:
            marginal, _, _ = field.marginals(field.potentials(places), per_text)
            state = np.where((inherited == 0) & (marginal >= settings.relabel), 1, inherited)
            whole = np.add.reduceat(1 - state, np.cumsum(per_text) - per_text) == 0
            state = np.where(np.repeat(whole, per_text), inherited, state)
        field.fit(places, per_text, state)

    rest = ~for_field if not for_field.all() else for_field
    quality = field.quality([t for t, k in zip(texts, rest, strict=True) if k])
    target = label[rest].astype(float)
    weight = np.where(target > 0, shares[1], shares[0])
    weight = weight / weight.sum()
    x = np.stack([np.ones(len(quality)), quality], axis=1)
    theta = np.array([0.0, 0.5])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-3 * theta
        theta = theta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    field.document = np.array([theta[0], max(theta[1], 0.0)])
    return field


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: LineSettings) -> tuple[list[bytes], list[int], tuple[float, float]]:
    """Texts and labels of a bounded sample outside the held-out rows, by smallest hash of doc_id, and rows by label for each of them."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    parts = [usable.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, settings.bad_documents), (1, settings.good_documents))]
    chosen = docs.join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id").where(F.length("text") <= settings.document_chars)
    rows = sorted((r.doc_id, r.text, r.quality) for r in chosen.collect())
    found = [sum(q == k for _, _, q in rows) for k in (0, 1)]
    return [t.encode() for _, t, _ in rows], [q for _, _, q in rows], tuple(counts.get(k, 0) / max(1, found[k]) for k in (0, 1))


def score(docs: DataFrame, labels: DataFrame, settings: LineSettings = LineSettings(), field: LineField | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A null text is empty; an empty text is one empty line and gets that line's score.
    Labels other than 0 and 1 are left out; labels without document only count towards the
    share of their class; a document with both labels counts as bad. Repeated rows are scored each. Only doc_id and text are read
    of ``docs``. An empty table gives an empty table.
    """
    docs = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = field or fit(*labelled_sample(docs, columns(labels, "doc_id", "quality"), settings), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores([x or b"" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = out.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
