"""Phrase collocations from directly addressed tiles of word pairs.

The most frequent words of all languages have ranks. A pair of ranks is a cell of a square
tile; a tile that gets many pairs is counted with numpy's ``bincount``, pairs of sparse
tiles and of words without a rank are sorted, and their runs counted (COO). Frequent pairs
are ranked in turn, and a ranked pair with the word behind it is counted in the same tiles:
that gives the phrases of three words.

What tasks hold for that has a fixed size: the ranks of at most ``ranked`` words and pairs,
and bit fields of words and pairs that may be frequent. The bit fields let some rare pairs
through and hold back no frequent one; exact counts are sums by Spark.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, partitions, written

#: Bytes that end a piece become ``!``, a tab becomes a space, A-Z are lower-cased.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(33 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Codes of a place where a piece ends or a word is surely rare.
BREAK, RARE = -2, -1


@dataclass(frozen=True)
class CollocationSettings:
    least: int = 10
    #: A phrase goes if a longer one around it has this share of its count, in hundredths.
    covered: int = 50
    best: int = 2000
    #: Words, and pairs, of all languages that have a rank; side of a tile; tiles that a task may hold.
    ranked: int = 65_536
    side: int = 1024
    tiles: int = 16
    #: A tile counts as dense if a buffer has a pair for so many of its cells.
    cells: int = 16
    buffered: int = 1_000_000
    #: Bits of a bit field, a power of two: 4 MB.
    bits: int = 1 << 25
    held_words: int = 400_000


def mixed(*codes: np.ndarray) -> np.ndarray:
    """64-bit hash of codes; equal hashes do not prove equal codes."""
    with np.errstate(over="ignore"):
        out = np.full(len(codes[0]), 0x9E3779B97F4A7C15, np.uint64)
        for c in codes:
            out ^= c.view(np.uint64)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(32)
    return out


def code_of(word: bytes, seed: int) -> int:
    """Number of a word from 0 to 2**63 - 1; that no other word of a language has that of a frequent word is checked."""
    return xxhash.xxh3_64_intdigest(word, seed) >> 1


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of each language of a batch as one, apart by the end of a piece, in parts of some megabytes."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        held[lang].append(text.as_py())
        size += len(held[lang][-1])
        if size > 4_000_000:
            for k, found in held.items():
                yield k, b"!".join(found).translate(FOLD)
            held.clear()
            size = 0
    for k, found in held.items():
        yield k, b"!".join(found).translate(FOLD)


def word_counts(docs: DataFrame, settings: CollocationSettings, seed: int) -> DataFrame:
    """``lang, code, word, n`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in by_lang(batch):
                held[lang].update(text.replace(b"!", b" ").split(b" "))
            if sum(map(len, held.values())) > settings.held_words:
                yield from emptied(held)
        yield from emptied(held)

    def emptied(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            found.pop(b"", None)
            codes = [code_of(w, seed) for w in found]
            arrays = [pa.array([lang] * len(found), pa.string()), pa.array(codes, pa.int64()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "code", "word", "n"])
        held.clear()

    counts = docs.mapInArrow(run, "lang string, code long, word binary, n long")
    return counts.groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Code of each word of one language; words that are surely rare have one code."""

    def __init__(self, seed: int, frequent: np.ndarray, most: int) -> None:
        super().__init__({b"!": BREAK})
        self.seed, self.frequent, self.most = seed, frequent, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self[b"!"] = BREAK
        code = code_of(word, self.seed)
        at = code & (len(self.frequent) * 8 - 1)
        self[word] = code = code if self.frequent[at >> 3] >> (at & 7) & 1 else RARE
        return code


def bit_field(frame: DataFrame, names: list[str], bits: int) -> np.ndarray:
    """Bits of the hashes of the rows, as bytes: each task gives the places it has set, Spark merges them by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            at = (values[0] if len(values) == 1 else mixed(*values).view(np.int64)) & (bits - 1)
            np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k in range(0, len(field), 65_536):
            part = field[k : k + 65_536]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(part, np.uint8)
                field[at] = field[at] | new if at in field else new
        for at, part in field.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    parts = frame.select(*names).mapInArrow(run, "at long, part binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition(partitions(frame.sparkSession), "at").mapInArrow(merge, "at long, part binary").collect():
        out[row.at : row.at + len(row.part)] = np.frombuffer(row.part, np.uint8)
    return out


def top(frame: DataFrame, names: list[str], most: int) -> dict[str, list[np.ndarray]]:
    """By language, the codes of the most frequent rows, most frequent first: in all at most ``most``.

    Eighths of powers of two part the counts, so that the least count comes from a table of
    fixed size and no task sends rows that others outdo.
    """
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in sorted(frame.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row.step
    held: dict[str, list[tuple]] = defaultdict(list)
    if least is not None:
        for row in sorted(frame.where(step >= least).select("n", "lang", *names).collect(), key=lambda r: (-r.n, *r[1:])):
            held[row.lang].append(tuple(row[c] for c in names))
    return {lang: [np.array(x, np.int64) for x in zip(*rows, strict=True)] for lang, rows in held.items()}


class Ranks:
    """Ranks of single codes or pairs of codes of one language, found by their sorted hashes."""

    def __init__(self, found: list[np.ndarray]) -> None:
        self.codes = found
        keys = found[0] if len(found) == 1 else mixed(*found).view(np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def of(self, *codes: np.ndarray) -> np.ndarray:
        """Rank of each, -1 without one."""
        if not len(self.keys):
            return np.full(len(codes[0]), -1)
        keys = codes[0] if len(codes) == 1 else mixed(*codes).view(np.int64)
        at = self.order[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
        same = np.ones(len(at), bool)
        for c, own in zip(codes, self.codes, strict=True):
            same &= own[at] == c
        return np.where(same, at, -1)


class Tiles:
    """Counts of (left, right) in one task: dense tiles of ranks, everything else sorted."""

    def __init__(self, settings: CollocationSettings, left: Ranks, right: Ranks) -> None:
        self.settings, self.left, self.right = settings, left, right
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, *codes: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Takes one pair for each place; gives counted pairs when a buffer is full."""
        if len(codes[0]):
            self.waiting.append([*codes])
            self.size += len(codes[0])
        if self.size >= self.settings.buffered:
            yield from self.counted()

    def counted(self) -> Iterator[list[np.ndarray]]:
        """Counts the buffer: dense tiles are added up and stay, sorted runs are given."""
        if not self.size:
            return
        codes = [np.concatenate(x) for x in zip(*self.waiting, strict=True)]
        self.waiting, self.size = [], 0
        side = self.settings.side
        i, j = self.left.of(*codes[:-1]), self.right.of(codes[-1])
        ranked = np.flatnonzero((i >= 0) & (j >= 0))
        tile = (i[ranked] // side) * (1 + len(self.right.keys) // side) + j[ranked] // side
        order = np.argsort(tile, kind="stable")
        starts = np.flatnonzero(np.diff(tile[order], prepend=-1))
        rest = np.ones(len(i), bool)
        for a, b in zip(starts, [*starts[1:], len(order)][: len(starts)], strict=True):
            own = ranked[order[a:b]]
            key = int(i[own[0]] // side), int(j[own[0]] // side)
            if key in self.dense or (b - a) * self.settings.cells >= side * side and len(self.dense) < self.settings.tiles:
                cells = np.bincount((i[own] % side) * side + j[own] % side, minlength=side * side)
                self.dense[key] = self.dense[key] + cells if key in self.dense else cells
                rest[own] = False
        codes = [c[rest] for c in codes]
        if len(codes[0]):
            order = np.argsort(mixed(*codes))
            codes = [c[order] for c in codes]
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in codes:  # equal hashes of different codes only part a run
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            yield [*(c[at] for c in codes), np.diff(at, append=len(order))]

    def rest(self) -> Iterator[list[np.ndarray]]:
        """What is left at the end of a task."""
        yield from self.counted()
        side = self.settings.side
        for (a, b), cells in self.dense.items():
            at = np.flatnonzero(cells)
            i, j = a * side + at // side, b * side + at % side
            yield [*(c[i] for c in self.left.codes), self.right.codes[0][j], cells[at]]
        self.dense = {}


def tiled(
    docs: DataFrame, names: str, settings: CollocationSettings, seed: int, frequent: np.ndarray, left: dict, right: dict, take: Callable[[np.ndarray], list[np.ndarray]]
) -> DataFrame:
    """``lang, <names>, n``: counts of what ``take`` finds in the codes of the texts, by tiles of the given ranks."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent, left, right))
    kinds = names.split()
    none = [np.empty(0, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, lefts, rights = shared.value
        codes: dict[str, Codes] = {}
        tiles: dict[str, Tiles] = {}
        for batch in batches:
            for lang, text in by_lang(batch):
                if lang not in codes:
                    if len(codes) >= 16:  # many languages: hand on what the others have
                        for k, own in tiles.items():
                            yield from rows(k, own.rest())
                        codes.clear()
                        tiles.clear()
                    codes[lang] = Codes(seed, field, settings.held_words // 4)
                    tiles[lang] = Tiles(settings, Ranks(lefts.get(lang, none * (len(kinds) - 1))), Ranks(rights.get(lang, none)))
                words = text.replace(b"!", b" ! ").split(b" ")
                found = np.fromiter(map(codes[lang].__getitem__, filter(None, words)), np.int64)
                yield from rows(lang, tiles[lang].add(*take(found)))
        for lang, own in tiles.items():
            yield from rows(lang, own.rest())

    def rows(lang: str, found: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for columns_ in found:
            for k in range(0, len(columns_[0]), 100_000):
                part = [pa.array(c[k : k + 100_000], pa.int64()) for c in columns_]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], names=["lang", *kinds, "n"])

    counts = docs.mapInArrow(run, ", ".join(["lang string", *(f"{c} long" for c in [*kinds, "n"])]))
    return counts.groupBy("lang", *kinds).agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)


def pairs_of(codes: np.ndarray) -> list[np.ndarray]:
    """Neighbouring words of a piece, both maybe frequent."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    return [codes[at], codes[at + 1]]


def score(a: Column, first: Column, rest: Column) -> Column:
    """``floor(10^6 a^2 / (first * rest))`` exactly, for counts under 10^14."""
    a, first, rest = (c.cast("decimal(14,0)") for c in (a, first, rest))
    return F.call_function("div", (a * a).cast("decimal(28,0)") * F.lit(1_000_000).cast("decimal(7,0)"), first * rest)


def collocations(docs: DataFrame, settings: CollocationSettings = CollocationSettings()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language.

    Null languages are ``und`` and share it with documents of that language; null texts are
    empty. Repeated rows count each. Phrases end at the ends of pieces and documents; words
    may hold any other byte. Without frequent phrases, or of an empty table, the result is
    empty. Other columns than lang and text are not read.
    """
    docs = columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    for seed in range(5):
        counts = written(word_counts(docs, settings, seed), "collocation-words")
        shared = counts.groupBy("lang", "code").agg(F.count("*").alias("words"), F.max("n").alias("most"))
        if shared.where((F.col("words") > 1) & (F.col("most") >= settings.least)).isEmpty():
            break
    else:
        raise RuntimeError("words share their 63-bit codes with every seed")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words = written(counts.where(F.col("n") >= settings.least), "collocation-frequent")

    word_bits = bit_field(words, ["code"], settings.bits)
    word_ranks = top(words, ["code"], settings.ranked)
    pairs = written(tiled(docs, "w1 w2", settings, seed, word_bits, word_ranks, word_ranks, pairs_of), "collocation-pairs")

    pair_bits = bit_field(pairs, ["w1", "w2"], settings.bits)
    shared_bits = docs.sparkSession.sparkContext.broadcast(pair_bits)

    def triples_of(codes: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        place = mixed(codes[at], codes[at + 1]).view(np.int64) & (settings.bits - 1)
        held = np.zeros(max(0, len(codes) - 1), bool)
        held[at] = shared_bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
        at = np.flatnonzero(held[:-1] & held[1:])
        return [codes[at], codes[at + 1], codes[at + 2]]

    triples = written(tiled(docs, "w1 w2 w3", settings, seed, word_bits, top(pairs, ["w1", "w2"], settings.ranked), word_ranks, triples_of), "collocation-triples")
    return ranked(words, pairs, triples, totals, settings)


def ranked(words: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, settings: CollocationSettings) -> DataFrame:
    """Scores of the candidates and the best of each language, from exact counts."""

    def with_word(frame: DataFrame, name: str) -> DataFrame:
        own = words.select("lang", F.col("code").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
        return frame.join(own, ["lang", name])

    around = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("x"), "n")
    around = around.groupBy("lang", "x.w1", "x.w2").agg(F.max("n").alias("longer"))
    two = pairs.join(around, ["lang", "w1", "w2"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(settings.covered) * F.col("n"), F.lit(True)))
    two = with_word(with_word(two, "w1"), "w2")
    a, n1, n2 = F.col("n"), F.col("w1_n"), F.col("w2_n")
    two = two.select("lang", F.concat("w1_word", F.lit(b" "), "w2_word").alias("phrase"), a.alias("a"), n1.alias("l"), n2.alias("r"), score(a, n1, n2).alias("score"))

    three = with_word(with_word(with_word(triples, "w1"), "w2"), "w3")
    three = three.join(pairs.select("lang", "w1", "w2", F.col("n").alias("first_n")), ["lang", "w1", "w2"])
    three = three.join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("last_n")), ["lang", "w2", "w3"])
    cuts = [F.struct(score(a, F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate((("w1_n", "last_n"), ("first_n", "w3_n")), 1)]
    three = three.select("lang", F.concat("w1_word", F.lit(b" "), "w2_word", F.lit(b" "), "w3_word").alias("phrase"), a.alias("a"), F.least(*cuts).alias("cut"))
    three = three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    found, parts = two.unionAll(three), partitions(words.sparkSession)
    for salts in (parts, math.isqrt(parts), 1):  # no task sorts all phrases of a language
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= settings.best)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
