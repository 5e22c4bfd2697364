"""Repeated passages, from a log-structured index of window fingerprints.

Windows of ``window`` words are sampled by content: of each window's sub-windows of
``probe`` words, the one of least hash is chosen, so equal windows choose equal probes and
few words are chosen at all. The index keeps the fingerprints of chosen probes in immutable
runs sorted by fingerprint (bucketed tables of the warehouse), each fingerprint once with its
count, so a very common one is one row; their places lie beside them in plain files. A new
batch of documents becomes a run, is merge-joined with the older runs, and the runs are
compacted into one when there are too many. Fingerprints found twice name the places that
may lie in a repeated window.

Those places are verified: all windows around a place are compared within its fingerprint by
a second 64-bit hash, independent of the first. First whole surroundings are counted, so that
any number of exact copies becomes one row; only differing surroundings are compared window by
window.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, map_batches, packed, partitions, unpacked, word_bounds, written


@dataclass(frozen=True)
class WindowSettings:
    window: int = 35
    probe: int = 8
    #: Runs that the index holds before it compacts them.
    runs: int = 2
    batches: int = 3
    seed: int = 17


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """Words, probes and window hashes of texts."""

    def __init__(self, settings: WindowSettings) -> None:
        self.s = settings
        self.word, self.probe, self.whole = (SpanHasher(settings.seed + k) for k in range(3))

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the probe, and of the window, that begins at each word."""
        data, start, end = word_bounds(words)
        own = self.word.spans(self.word.prefix(data), start, end)
        return self.probe.runs(own, self.s.probe), self.whole.runs(own, self.s.window)

    def chosen(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of chosen probes; of equal least hashes all are chosen. And each window's least hash."""
        width = self.s.window - self.s.probe + 1
        if len(probes) < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        least = sliding(probes, width, True)
        edge = np.zeros(width - 1, np.uint64)
        reach = sliding(np.concatenate([edge, least, edge]), width, False)
        return np.flatnonzero(probes == reach), least


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, th, text``: a row is known by its id and a hash of its text, so that rows with equal id don't mix."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))


def probes_of(docs: DataFrame, settings: WindowSettings) -> DataFrame:
    """``fp, doc_id, th, at`` of every chosen probe; only fingerprint and place, no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(settings)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows, fps, places = [], [], []
                for row, text in enumerate(part.column(2)):
                    hashes, _ = windows.hashes((text.as_py() or "").encode().split())
                    at, _ = windows.chosen(hashes)
                    rows.append(np.full(len(at), row))
                    fps.append(hashes[at].view(np.int64))
                    places.append(at.astype(np.int32))
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), part.column(0).take(taken), part.column(1).take(taken), pa.array(np.concatenate(places))], names=["fp", "doc_id", "th", "at"])

    return docs.mapInArrow(run, "fp long, doc_id long, th long, at int")


@dataclass
class FingerprintIndex:
    """Sorted immutable runs of distinct fingerprints with their counts, and the places of all."""

    spark: SparkSession
    settings: WindowSettings
    buckets: int
    runs: list[str] = field(default_factory=list)
    stored: list[DataFrame] = field(default_factory=list)

    def _write(self, counts: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def _drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")

    def places(self) -> DataFrame:
        """``fp, doc_id, th, at`` of all batches."""
        return reduce(DataFrame.unionAll, self.stored)

    def ingest(self, probes: DataFrame) -> DataFrame:
        """Adds a batch as a run; the fingerprints (``fp``) that it holds twice or shares with an older run."""
        self.stored.append(written(probes, "places"))
        new = self._write(self.stored[-1].groupBy("fp").agg(F.count("*").alias("n")))
        count = self.spark.table(new)
        found = count.where("n > 1").select("fp")
        for old in self.runs:
            found = found.unionAll(count.select("fp").join(self.spark.table(old).select("fp").hint("merge"), "fp", "left_semi"))
        found = written(found.distinct(), "shared")
        self.runs.append(new)
        if len(self.runs) > self.settings.runs:
            whole = reduce(DataFrame.unionAll, map(self.spark.table, self.runs))
            whole = self._write(whole.groupBy("fp").agg(F.sum("n").alias("n")))
            self._drop()
            self.runs = [whole]
        return found

    def close(self) -> None:
        """Drops the runs."""
        self._drop()
        self.runs = []


def surroundings(docs: DataFrame, hits: DataFrame, settings: WindowSettings) -> DataFrame:
    """``fp, around, windows, doc_id, th, first``: hashes of the windows that chose each hit, from window ``first`` on.

    ``around`` is a hash of them all. ``hits`` has ``doc_id, th, places``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(settings)
        width = settings.window - settings.probe
        names = ["fp", "around", "skip", "windows", "doc_id", "th", "first"]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                rows, fps, around, skips, packed, firsts = [], [], [], [], [], []
                for row, (text, places) in enumerate(zip(unpacked(part.column(2)), part.column(3), strict=True)):
                    probe, whole = windows.hashes(text.split())
                    _, least = windows.chosen(probe)
                    for at in places.values.to_numpy().tolist():
                        low, high = max(0, at - width), min(at, len(least) - 1)
                        # Windows whose first least hash is this probe's: each window has one such place.
                        before = np.flatnonzero(probe[low:at] == probe[at])
                        low += int(before[-1]) + 1 if len(before) else 0
                        own = np.flatnonzero(least[low : high + 1] == probe[at])
                        if not len(own):
                            continue
                        low, high = low + int(own[0]), low + int(own[-1])
                        data = whole[low : high + 1].tobytes()
                        rows.append(row)
                        fps.append(int(probe[at].view(np.int64)))
                        skips.append(at - low)
                        around.append(xxhash.xxh3_64_intdigest(data, at - low) - 2**63)
                        packed.append(data)
                        firsts.append(low)
                if rows:
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(around, pa.int64()), pa.array(skips, pa.int32()), pa.array(packed, pa.binary()), part.column(0).take(taken), part.column(1).take(taken), pa.array(firsts, pa.int32())], names=names)

    docs = packed(docs)
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (docs["th"] == hits["th"])).select(docs["doc_id"], docs["th"], "text", "places")
    return joined.mapInArrow(run, "fp long, around long, skip int, windows binary, doc_id long, th long, first int")


def repeated_windows(docs: DataFrame, settings: WindowSettings) -> DataFrame:
    """``doc_id, th, spans``: for each row with repeated windows, their numbers as ``(first, mask)``; bit k is window first + k."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, settings, partitions(spark))
    shared = None
    for k in range(settings.batches):
        part = docs.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(settings.batches)) == k)
        found = index.ingest(probes_of(part, settings))
        shared = found if shared is None else shared.unionAll(found)
    hits = index.places().join(shared.distinct(), "fp", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("at").alias("places"))
    around = written(surroundings(docs, hits, settings), "surroundings")
    index.close()

    classes = around.groupBy("fp", "around").agg(F.count("*").alias("n"), F.first("skip").alias("skip"), F.first("windows").alias("windows"))
    classes = written(classes, "surrounding-classes")

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        sizes = [len(x) for x in data]
        row = pa.array(np.repeat(np.arange(len(data)), sizes))
        bit = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row), pa.array(np.concatenate(data)), pa.array(bit)], names=["fp", "around", "n", "hash", "bit"])

    # Only fingerprints with differing surroundings need their windows compared.
    several = classes.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    single = map_batches(classes.join(several, "fp", "left_semi").select("fp", "around", "n", "windows"), unpack, "fp long, around long, n long, hash long, bit int")
    total = single.groupBy("fp", "hash").agg(F.sum("n").alias("total"))
    twice = total.where("total > 1")
    mask = single.join(twice.select("fp", "hash"), ["fp", "hash"], "left_semi").groupBy("fp", "around").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    alone = classes.join(several, "fp", "left_anti").where("n > 1").select("fp", "around", F.expr("shiftleft(1L, cast(octet_length(windows) div 8 as int)) - 1").alias("mask"))
    masks = mask.unionAll(alone)
    found = around.select("fp", "around", "doc_id", "th", "first").join(masks, ["fp", "around"])
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))


def _kept(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    if not spans:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        bits = np.flatnonzero(np.unpackbits(np.array([x["mask"]], "<i8").view(np.uint8), bitorder="little")) + x["first"]
        np.add.at(step, bits, 1)
        np.add.at(step, bits + window, -1)
    covered = np.cumsum(step)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def dedup_substrings(docs: DataFrame, settings: WindowSettings = WindowSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of every row.

    A word goes if a window of ``window`` words that covers it also starts anywhere else in
    the table, the same row included. Null and empty texts and texts shorter than a window
    keep all they have. A repeated row is a copy, so its windows are repeated. A null
    doc_id is an id like others. Other columns are not read.
    """
    docs = keyed(docs, doc_id, text)
    spans = repeated_windows(docs, settings)
    docs = packed(docs)
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["th"] == spans["th"]), "left").select(docs["doc_id"], "text", "spans")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, kept = [], []
        for t, s in zip(unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = t.split()
            left = _kept(words, s, settings.window)
            counts.append((len(words), len(words) - len(left)))
            kept.append(b" ".join(left))
        n = np.array(counts, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() for x in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    return map_batches(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
