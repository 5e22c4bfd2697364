"""Benchmark passages in documents, found by CGK embedding and bit-sampling LSH.

The CGK random walk reads a window character by character: at each step it marks the current
character and moves on or stays, by a random bit of that character and step. Windows a few edits
apart fall back into step and so differ in few of the marks: edit distance becomes Hamming
distance. Repeated samples of a few steps, over several walks, are the LSH keys.

An item may differ in a fifth of its characters, and then no walk over the whole of it stays in
step. So its windows are short, by its size: every place of an item begins one, and every
``stride``-th place of a text. An item is a candidate where one of its many windows meets the
text and the bytes beside the window agree as well, and candidates are verified by the exact edit
distance of the item to the best matching stretch of the text. Items travel to the tasks in blocks of bounded size; documents are not
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, released, small_batches


def _folding() -> bytes:
    table = bytearray(range(256))
    for k in range(128):
        c = chr(k)
        table[k] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


FOLD = _folding()


@dataclass(frozen=True)
class LeakSettings:
    #: ``(least bytes of an item, steps of a walk, sampled steps, stride in the text, bytes that agree)``, by falling size; a walk reads about half as many bytes as it has steps.
    windows: tuple[tuple[int, int, int, int, int], ...] = ((96, 34, 14, 3, 11), (48, 22, 10, 2, 10), (0, 16, 8, 1, 8))
    walks: int = 1
    samples: int = 2
    #: A met window counts if of so many bytes on both sides of it, in step with the item's, enough agree.
    beside: int = 16
    #: A text holds an item if their edit distance is at most this share of the item's length.
    distance: float = 0.2
    #: Items of fewer words stand in many texts by chance and are not searched.
    least_words: int = 4
    block_items: int = 2_000
    seed: int = 23

    def window(self, size: int) -> int:
        """Which kind of window an item of ``size`` bytes takes."""
        return next(k for k, (least, *_) in enumerate(self.windows) if size >= least)


def folded(text: str | None) -> bytes:
    """Lower-case words without ASCII punctuation, joined by one space; a null text has none."""
    return b" ".join((text or "").encode().translate(FOLD).split())


class Walks:
    """LSH keys of windows of bytes."""

    BLOCK = 1 << 15

    def __init__(self, settings: LeakSettings) -> None:
        rng = np.random.default_rng(settings.seed)
        longest = max(steps for _, steps, *_ in settings.windows)
        self.pad = longest + settings.beside
        self.move = rng.integers(0, 2, (settings.walks, longest, 256), np.int64)
        self.mark = rng.integers(0, 2**64, (settings.walks, longest, 256), np.uint64)
        self.sampled = [[[set(rng.choice(steps, taken, replace=False).tolist()) for _ in range(settings.samples)] for _ in range(settings.walks)] for _, steps, taken, *_ in settings.windows]
        self.first = rng.integers(0, 2**64, (len(settings.windows), settings.walks, settings.samples), np.uint64)

    def joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of several texts with zeros around each, and where each text begins."""
        lengths = np.array([len(x) + self.pad for x in parts])
        return np.frombuffer(bytes(self.pad).join([b"", *parts, b""]), np.uint8), np.cumsum(lengths) - lengths + self.pad

    def keys(self, data: np.ndarray, start: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(k, keys of the windows from start[k] on)`` by blocks, for each sample of each walk."""
        for k in range(0, len(start), self.BLOCK):
            for walk, samples in enumerate(self.sampled[window]):
                at = start[k : k + self.BLOCK].copy()
                keys = [np.full(len(at), x, np.uint64) for x in self.first[window][walk]]
                for step in range(1 + max(map(max, samples))):
                    read = data.take(at).astype(np.intp)
                    wanted = [key for key, steps in zip(keys, samples, strict=True) if step in steps]
                    if wanted:
                        mark = self.mark[walk][step].take(read)
                        for key in wanted:
                            key ^= mark
                    at += self.move[walk][step].take(read)
                for key in keys:
                    yield k, key


def stretch_distance(item: str, text: str, most: float = np.inf) -> int:
    """Smallest edit distance of ``item`` to any stretch of ``text``, by bit vectors over the item's places (Myers, 1999).

    Once the rest of the text can't bring it to ``most`` any more, the least one so far.
    """
    n = len(item)
    places: dict[str, int] = {}
    for k, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << k
    whole, last = (1 << n) - 1, 1 << n - 1
    up, down, now = whole, 0, n
    least = now
    for left, c in zip(range(len(text), 0, -1), text, strict=True):
        if now - left > most:
            break
        same = places.get(c, 0)
        across = same | down
        level = ((same & up) + up & whole) ^ up | same
        rise = down | ~(level | up) & whole
        fall = up & level
        if rise & last:
            now += 1
        elif fall & last:
            now -= 1
            least = min(least, now)
        rise = rise << 1 & whole
        up = (fall << 1 | ~(across | rise)) & whole
        down = rise & across
    return least


class LeakFinder:
    """One block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], settings: LeakSettings) -> None:
        self.settings = settings
        self.walks = Walks(settings)
        kept = [(i, x) for i, x in ((i, folded(t)) for i, t in items) if x.count(b" ") + 1 >= settings.least_words]
        self.items = [(i, x.decode(errors="replace"), len(x)) for i, x in kept]
        self.data, begin = self.walks.joined([x for _, x in kept])
        self.begin = begin
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for window, (_, steps, *_) in enumerate(settings.windows):
            own = [k for k, (_, _, n) in enumerate(self.items) if settings.window(n) == window]
            if own:
                many = np.array([max(1, self.items[k][2] - steps // 2 + 1) for k in own])
                item = np.repeat(np.array(own), many)
                offset = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
                found = list(self.walks.keys(self.data, begin[item] + offset, window))
                keys = np.concatenate([x for _, x in found])
                place = np.concatenate([np.arange(k, k + len(x)) for k, x in found])
                order = np.argsort(keys, kind="stable")
                self.index[window] = keys[order], item[place[order]].astype(np.int32), offset[place[order]].astype(np.int32)
        self.shift, self.present = 0, None

    def filter(self) -> tuple[np.uint64, np.ndarray]:
        """Which leading bits of keys occur; made in the task, so that it does not travel."""
        if self.present is None:
            bits = max(16, int(sum(len(x) for x, _, _ in self.index.values())).bit_length() + 4)
            self.shift = np.uint64(64 - bits)
            self.present = np.zeros(1 << bits, bool)
            for keys, _, _ in self.index.values():
                self.present[(keys >> self.shift).astype(np.intp)] = True
        return self.shift, self.present

    def alike(self, data: np.ndarray, at: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
        """Whether enough of the bytes around windows at ``at`` agree with the items' around ``of``."""
        wide = self.settings.beside
        _, reach, _, _, agree = self.settings.windows[window]
        reach //= 2
        same = np.zeros(len(at), np.int8)
        for k in (*range(-wide, 0), *range(reach, reach + wide)):
            read = data.take(at + k)
            same += (read == self.data.take(of + k)) & (read > 0)
        return same >= agree

    def candidates(self, parts: list[bytes]) -> np.ndarray:
        """Distinct ``(text, item, eighth of the item's first byte in the text)`` of texts taken together."""
        data, begin = self.walks.joined(parts)
        lengths = np.array([len(x) for x in parts])
        shift, present = self.filter()
        met = [np.empty((0, 3), np.int64)]
        for window, (keys, item, offset) in self.index.items():
            stride = self.settings.windows[window][3]
            many = -(-lengths // stride)
            text = np.repeat(np.arange(len(parts)), many)
            place = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stride
            for k, found in self.walks.keys(data, begin[text] + place, window):
                at = np.flatnonzero(present.take((found >> shift).astype(np.intp)))
                low = np.searchsorted(keys, found[at])
                times = np.searchsorted(keys, found[at], side="right") - low
                total = int(times.sum())
                if total:
                    hit = np.repeat(low - np.cumsum(times) + times, times) + np.arange(total)
                    own = np.repeat(at + k, times)
                    alike = self.alike(data, begin[text[own]] + place[own], self.begin[item[hit]] + offset[hit], window)
                    own, hit = own[alike], hit[alike]
                    met.append(np.unique(np.stack([text[own], item[hit], (place[own] - offset[hit]) >> 3], axis=1), axis=0))
        return np.unique(np.concatenate(met), axis=0)

    def find(self, texts: list[str | None], group_bytes: int = 1_000_000) -> list[list[tuple[int, int, int]]]:
        """For each text its leaks ``(item_id, edit distance, item length)``, the best of each item."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        parts = [folded(t) for t in texts]
        at = 0
        while at < len(parts):
            to, total = at, 0
            while to < len(parts) and (to == at or total + len(parts[to]) <= group_bytes):
                total += len(parts[to])
                to += 1
            best: dict[tuple[int, int], int] = {}
            for text, item, eighth in self.candidates(parts[at:to]).tolist():
                if best.get((text, item)) == 0:
                    continue
                _, target, size = self.items[item]
                slack = 12 + size // 4
                stretch = parts[at + text][max(0, 8 * eighth - slack) : max(0, 8 * eighth + size + slack)]
                least = self.settings.distance * len(target)
                distance = stretch_distance(target, stretch.decode(errors="replace"), least)
                if distance <= least:
                    best[text, item] = min(distance, best.get((text, item), distance))
            for (text, item), distance in sorted(best.items()):
                out[at + text].append((self.items[item][0], distance, len(self.items[item][1])))
            at = to
        return out


def finders(benchmark: DataFrame, settings: LeakSettings, item_id: str = "item_id", text: str = "text") -> list[LeakFinder]:
    """Finders for blocks of at most about ``block_items`` items each; null texts have no words."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id is not null").distinct()
    blocks = -(-items.count() // settings.block_items)
    return [LeakFinder(sorted((r.item_id, r.text or "") for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()), settings) for k in range(blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, similarity`` of every item that a document holds.

    Null and empty texts hold nothing; repeated rows give repeated results; an item id with
    several texts counts by its best one. An empty table on either side gives no rows.
    """
    taken = columns(small_batches(docs), doc_id, text).toDF("doc_id", "text")
    schema = "doc_id long, item_id long, distance long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for finder in finders(benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], finder: LeakFinder = finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d.as_py(), *x) for d, found in zip(batch.column(0), finder.find(batch.column(1).to_pylist()), strict=True) for x in found]
                if rows:
                    d, i, e, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int64()), pa.array([1 - a / b for a, b in zip(e, n, strict=True)], pa.float64())], names=["doc_id", "item_id", "distance", "similarity"])

        out = out.unionAll(taken.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(released(run), schema))
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without leaks, with all their columns; nothing is shuffled.

    Null and empty texts hold no item and stay; texts of any length are searched whole;
    repeated rows stay or go together; an empty table on either side changes nothing.
    Other columns are carried and not read, whatever their names.
    """
    place = docs.columns.index(text)
    for finder in finders(benchmark, settings):

        def run(batches: Iterator[pa.RecordBatch], finder: LeakFinder = finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in finder.find(batch.column(place).to_pylist())], pa.bool_()))

        docs = small_batches(docs).mapInArrow(released(run), docs.schema)
    return docs
