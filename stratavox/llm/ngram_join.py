"""Exact Jaccard join of word n-gram sets: a size-aware heavy-light join.

Documents with equal sets are one class first. Classes are then split by set size:

* light (small) sets: for each pair of sizes that can link, all subsets of the overlap
  that a link needs are enumerated; two sets link exactly if they share such a subset.
* heavy (large) sets: each set's rarest n-grams, as many as a link can't miss, go to
  inverted lists; classes on one list are candidates, whose sets are then compared.

The boundary is the one of least estimated cost, from the histogram of all sizes.

A list may hold a third of all classes, so pairs within it are not enumerated. Each list
compares its members with one pivot, which is linear in the list. What the pivot leaves open
is settled by differences: let D(x) be the n-grams that x and the pivot p do not share. If
neither D(x) and D(y) meet nor x links with p, then x does not link with y, for x is at least
as similar to p as to y. More exactly, a link of x and y needs

    |D(x) & D(y)| >= (e(x) + e(y)) / 2,   e(z) = |D(z)| - c |z|,   c = (100 - percent) / (100 + percent)

so the members' differences go to inverted lists in their turn, each with as many n-grams as
a link can't miss, and the next round works on those. What copies have in common is no longer
in them, so few members meet again. Lists whose members are all of one component, and members
that can't hold the overlap from their place in a list on, are left out. When all pairs on the
open lists are a bounded number for each entry, or more pivots don't help, those pairs that can
hold the overlap are compared one by one, and that is all.

Short lists have no pivot in any round: their pairs are a bounded number for each entry (or for
each that a pivot's members would become), and most are texts that share a passage and no more.
Such pairs are told by a slice of the hash space: n-grams of one set that the other lacks there
bound the overlap from above, so sets are fetched in whole only for pairs that the bound leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHasher, connected_components, packed, released, small_batches, unpacked, unused, written


@dataclass(frozen=True)
class JaccardSettings:
    words: int = 4
    #: Two sets link when 100 * intersection >= percent * union.
    percent: int = 85
    #: Largest size that may be light.
    max_light: int = 24
    #: Rounds of pivots at most. After the first they end where the open lists have no more pairs for each
    #: entry than this, or where a round would compare nearly as many sets as the one before.
    rounds: int = 8
    pairs_per_entry: int = 64
    #: Lists of at most so many members are short; their pairs are met without a pivot.
    short_list: int = 8
    #: So are a pivot's open members up to this number, where they have at most half as many pairs as differing n-grams to list.
    short_group: int = 64
    #: Share of the hash space, as one of this many slices, that bounds a pair's overlap.
    slices: int = 4
    #: Classes whose sets are fetched are sent to all executors up to this number, else joined by shuffle.
    broadcast_classes: int = 100_000
    #: N-grams that tasks count at a time to find common ones, how many of the most common are ordered by count,
    #: and the bits of the filter that tells all common ones.
    counted: int = 4_000_000
    common: int = 1 << 17
    filter_bits: int = 26
    filter_slices: int = 64
    #: Classes that a task remembers having met, so that copies are counted and listed once a task.
    remembered: int = 100_000
    seed: int = 41

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def linkable(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def heavy_from(self, bound: int) -> int:
        """Least size of a set that can link with a heavy one; it is on the inverted lists."""
        return max(1, -(-self.percent * (bound + 1) // 100))

    def prefix(self, size: int) -> int:
        """A linked set shares at least ``ceil(percent * size / 100)`` n-grams; one of so many must be among them."""
        return size - -(-self.percent * size // 100) + 1


UPPER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


class Shingler:
    def __init__(self, settings: JaccardSettings) -> None:
        self.k = settings.words
        self.hasher = SpanHasher(settings.seed)

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's n-grams; with fewer words, of the whole sequence."""
        data = b" ".join((text or "").encode().translate(UPPER).split()) + b" "
        if len(data) == 1:
            return np.empty(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 32) + 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        k = min(self.k, len(ends))
        return np.unique(self.hasher.spans(self.hasher.prefix(raw), starts[: len(ends) - k + 1], ends[k - 1 :])).view(np.int64)


class Rarity:
    """The order of n-grams: 0 for most, 1 for common ones, above it by the logarithm of the number of sets that hold it.

    Common n-grams are told by a Bloom filter, the most common by an exact table. Both are
    functions of the n-gram alone, so all sets are ordered alike; they only decide which
    n-grams are listed, so an error costs time and never a link.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(grams.view(np.uint64))
        self.grams = grams.view(np.uint64)[order]
        self.level = (1 + np.ceil(np.log2(np.maximum(counts, 1)))).astype(np.uint8)[order]
        self.bits = bits

    @staticmethod
    def places(grams: np.ndarray, settings: JaccardSettings) -> list[np.ndarray]:
        """Two bits within the n-grams' slice of the filter; the slice is that of their highest bits."""
        h = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        size = np.uint64((1 << settings.filter_bits) // settings.filter_slices)
        return [((h >> np.uint64(shift)) % size).astype(np.int64) for shift in (40, 16)]

    def common(self, grams: np.ndarray, settings: JaccardSettings) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(grams), bool)
        own = (grams.view(np.uint64) >> np.uint64(65 - settings.filter_slices.bit_length())).astype(np.int64)
        own *= (1 << settings.filter_bits) // settings.filter_slices
        found = np.ones(len(grams), bool)
        for place in self.places(grams, settings):
            at = own + place
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def of(self, grams: np.ndarray, settings: JaccardSettings) -> np.ndarray:
        """Levels of sorted n-grams."""
        out = self.common(grams, settings).astype(np.uint8)
        if len(self.grams):
            own = grams.view(np.uint64)
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            out = np.where(self.grams[at] == own, self.level[at], out)
        return out


class Met:
    """Classes that a task has met lately."""

    def __init__(self, size: int) -> None:
        self.size, self.ids = size, set()

    def new(self, k: int) -> bool:
        if k in self.ids:
            return False
        if len(self.ids) >= self.size:
            self.ids.clear()
        self.ids.add(k)
        return True


def lists_of(arrays: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    """An Arrow list column; the arrays of one batch are bounded by the batch."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, kind)))


def slice_of(grams: np.ndarray, settings: JaccardSettings) -> np.ndarray:
    """Sorted 32-bit values of a set's n-grams in the first slice of the hash space; two n-grams may have one value."""
    g = grams.view(np.uint64)
    low = g[: np.searchsorted(g, np.uint64(2**64 // settings.slices - 1), side="right")] if settings.slices > 1 else g
    return np.sort((low & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)


def most_shared(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> int:
    """A bound of the overlap of sets of sizes ``nx`` and ``ny`` from their slices: what one lacks isn't shared."""
    x, y = x.view(np.uint32), y.view(np.uint32)
    lacks = lambda a, b: int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a).sum()) if len(b) else len(a)
    return min(nx - lacks(x, y), ny - lacks(y, x))


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def class_ids(h: np.ndarray, clashing: list[int]) -> np.ndarray:
    """Ids of classes: the first half of the hash, the second for the few classes that share a first half."""
    return np.where(np.isin(h[:, 0], clashing), h[:, 1], h[:, 0]) if clashing else h[:, 0]


def class_id(clashing: list[int]) -> Column:
    return F.when(F.col("h1").isin(clashing), F.col("h2")).otherwise(F.col("h1")) if clashing else F.col("h1")


def taken(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def described_sets(docs: DataFrame, settings: JaccardSettings) -> DataFrame:
    """Each row's set size and 128-bit hash, small sets in full, and n-grams that a task meets in several sets.

    The latter are more rows, the n-gram as ``h1`` with the number of sets in ``often``; they
    are counted among ``counted`` n-grams at a time. ``docs`` has ``doc_id, text, th``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(settings), Met(settings.remembered)
        names = ["doc_id", "th", "n_shingles", "h1", "h2", "grams", "often"]
        held: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            grams, counts = grams[counts > 1], counts[counts > 1]
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams), none, pa.nulls(len(grams), pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingler.grams(t.as_py()) for t in part.column(1)]
                h = set_hashes(sets)
                held += [s for s, k in zip(sets, h[:, 0].tolist(), strict=True) if met.new(k)]
                small = lists_of([s if len(s) <= settings.max_light else s[:0] for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), small, pa.nulls(len(sets), pa.int64())], names=names)
                if sum(map(len, held)) > settings.counted:
                    yield common()
        if held:
            yield common()

    return docs.mapInArrow(released(run), "doc_id long, th long, n_shingles long, h1 long, h2 long, grams array<long>, often long")


def rarity(described: DataFrame, settings: JaccardSettings) -> Rarity:
    """The order, from the counts of tasks: a table of at most ``common`` n-grams and a filter of fixed size.

    The filter holds all common n-grams, or, where they are more than a quarter of its bits,
    those of the highest counts. Its slices are made in tasks.
    """
    counts = described.where("often is not null").groupBy(F.col("h1").alias("gram")).agg(F.sum("often").alias("n"))
    counts = written(counts, "common-grams")
    top = counts.orderBy(F.desc("n"), "gram").limit(settings.common).toArrow()
    bits, slices = settings.filter_bits, settings.filter_slices
    least, held = 2, 0
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    for r in levels:
        held += r["count"]
        if held > 1 << (bits - 2):
            least = 2 << r.level
            break

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(1).to_numpy()
            for k in np.unique(own).tolist():
                bit = filled.setdefault(k, np.zeros((1 << bits) // slices, np.uint8))
                for place in Rarity.places(batch.column(0).to_numpy()[own == k], settings):
                    bit[place] = 1
        if filled:
            yield pa.RecordBatch.from_arrays([pa.array([*filled], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in filled.values()], pa.binary())], names=["slice", "bits"])

    # A slice is made in one task and is of fixed size.
    chosen = counts.where(F.col("n") >= least).select("gram", F.shiftrightunsigned("gram", 65 - slices.bit_length()).alias("slice"))
    out = np.zeros((slices, (1 << bits) // slices // 8), np.uint8)
    for row in chosen.repartition(slices, "slice").mapInArrow(fill, "slice long, bits binary").collect():
        out[row.slice] |= np.frombuffer(row.bits, np.uint8)
    return Rarity(top.column("gram").to_numpy(), top.column("n").to_numpy(), out.ravel() if levels else np.zeros(0, np.uint8))


def light_boundary(sizes: dict[int, int], settings: JaccardSettings) -> int:
    """The largest light size: least number of subsets of light sets and list entries of heavy sets.

    An entry of an inverted list is fetched and compared later and counts four times.
    """

    def subsets(a: int) -> int:
        return sum(math.comb(a, settings.overlap(a, b)) for b in range(1, 2 * a + 1) if settings.linkable(a, b) and settings.overlap(a, b) <= min(a, b))

    best, least = 0, None
    for bound in range(settings.max_light + 1):
        cost = sum(n * subsets(a) for a, n in sizes.items() if a <= bound)
        cost += sum(4 * n * settings.prefix(a) for a, n in sizes.items() if a >= settings.heavy_from(bound))
        if least is None or cost < least:
            best, least = bound, cost
    return best


def light_links(sets: DataFrame, bound: int, settings: JaccardSettings) -> DataFrame:
    """``a, b``: links that make the components of light sets (``id, n_shingles, grams``).

    A key is a subset together with a pair of sizes whose links need an overlap of the
    subset's size, so any two sets on it with these sizes link. A star from the least
    member therefore gives the components of all pairs, where both sizes are present.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, side = [], [], []
            for k, n, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for other in range(1, bound + 1):
                    a, b = min(n, other), max(n, other)
                    need = settings.overlap(a, b)
                    if not settings.linkable(a, b) or need > a or a == b == need:
                        continue
                    for chosen in combinations(grams, need):
                        keys.append(xxhash.xxh3_128_digest(np.array([a, b, *chosen], np.int64).tobytes()))
                        owner.append(k)
                        side.append(2 if a == b else int(n == b))
            if keys:
                h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(owner, pa.int64()), pa.array(side, pa.int32())], names=["k1", "k2", "id", "side"])

    rows = sets.where(F.col("n_shingles").between(1, bound)).select("id", "n_shingles", "grams").mapInArrow(released(run), "k1 long, k2 long, id long, side int")
    rows = written(rows, "light-subsets")
    star = rows.groupBy("k1", "k2").agg(F.min("id").alias("b"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.count("*").alias("n"))
    star = star.where("n > 1 and (lo = 2 or lo <> hi)").select("k1", "k2", "b")
    return rows.join(star, ["k1", "k2"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def heavy_lists(docs: DataFrame, least: int, order: Rarity, settings: JaccardSettings, clashing: list[int]) -> DataFrame:
    """``key, id, size, place, weight, common``: the rarest n-grams of each set of at least ``least``, with their place in the order.

    The order is by level, then by unsigned hash, as ``Shingler.grams`` sorts. ``weight`` is
    the share of common n-grams, in thousandths; ``common`` n-grams are surely held by several sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(settings), Met(settings.remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [s for t in batch.column(1).slice(at, 500) if len(s := shingler.grams(t.as_py())) >= least]
                grams, common, rows = [], [], []
                for g, k in zip(sets, class_ids(set_hashes(sets), clashing).tolist(), strict=True):
                    if not met.new(k):
                        continue
                    n, level = settings.prefix(len(g)), order.of(g, settings)
                    rare = np.flatnonzero(level == 0)
                    chosen = rare[:n] if len(rare) >= n else np.lexsort((g.view(np.uint64), level))[:n]
                    grams.append(g[chosen])
                    common.append(level[chosen] > 1)  # in the table, so that several sets do hold it
                    rows.append((k, len(g), 1000 * (len(g) - len(rare)) // len(g), n))
                if rows:
                    ids, sizes, weights, counts = np.array(rows, np.int64).T
                    columns = np.concatenate(grams), np.repeat(ids, counts), np.repeat(sizes, counts).astype(np.int32), np.concatenate([np.arange(n, dtype=np.int32) for n in counts]), np.repeat(weights, counts).astype(np.int32), np.concatenate(common)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "id", "size", "place", "weight", "common"])

    return docs.mapInArrow(released(run), "key long, id long, size int, place int, weight int, common boolean")


@dataclass(frozen=True)
class Classes:
    """Where the sets of classes are found: ``owners (id, d, t)`` names one row of each by doc_id and hash of the text."""

    docs: DataFrame
    owners: DataFrame
    #: Whether rows of ``docs`` repeat.
    repeated: bool
    clashing: list[int]

    def sets(self, wanted: DataFrame, settings: JaccardSettings, sliced: bool = False) -> DataFrame:
        """``pivot, id, size, grams`` of the wanted classes (``id, pivots``), once for each pivot.

        ``size`` is that of the whole set; ``sliced`` gives one slice of it, as 32 bits of each n-gram.
        """
        wanted = written(self.owners.join(wanted, "id"), "wanted-classes")
        small = (wanted.agg(F.sum(F.size("pivots"))).first()[0] or 0) <= settings.broadcast_classes

        kind = np.int32 if sliced else np.int64

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(settings)
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    sets = [shingler.grams(t) for t in (part.column(1).to_pylist() if small else map(bytes.decode, unpacked(part.column(1))))]
                    pivots = part.column(2).to_pylist()
                    row = np.repeat(np.arange(len(sets)), [len(x) for x in pivots])
                    sizes = np.array([len(s) for s in sets], np.int64)
                    if sliced:
                        sets = [slice_of(s, settings) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array([p for x in pivots for p in x], pa.int64()), part.column(0).take(pa.array(row)), pa.array(sizes[row]), lists_of([sets[k] for k in row], kind)], names=["pivot", "id", "size", "grams"])

        rows = self.docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
        if not small:
            rows = packed(rows)
        found = rows.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("id", "text", "pivots")
        if self.repeated:
            found = found.dropDuplicates(["id"])
        return found.mapInArrow(released(run), f"pivot long, id long, size long, grams array<{'int' if sliced else 'long'}>")


def compare(pairs: DataFrame, classes: Classes, order: Rarity, settings: JaccardSettings) -> DataFrame:
    """Exact comparison of the pairs ``id, pivot``: ``pivot, id, linked, delta, excess, grams``.

    ``delta`` is the size of the difference, ``excess`` is e of the module's text times
    ``100 + percent``, ``grams`` the n-grams of the difference that go to lists: those that
    the pivot lacks first, each part by level and hash.
    """
    more, less = 100 + settings.percent, 100 - settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, deltas, excesses, grams = [], [], [], []
            for x, p in zip(batch.column(2), batch.column(3), strict=True):
                x, p = x.values.to_numpy().view(np.uint64), p.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(p, x), len(p) - 1)
                hit = p[at] == x
                shared = int(hit.sum())
                other = np.ones(len(p), bool)
                other[at[hit]] = False
                delta = len(x) + len(p) - 2 * shared
                excess = more * delta - less * len(x)
                link = 100 * shared >= settings.percent * (len(x) + len(p) - shared)
                # The least excess of a partner: of one that the pivot does not link, or of any that is near enough.
                partner = less * len(p) + 1 if link else max(2 * settings.percent - less * len(p), excess + (-200 * less * len(x)) // settings.percent)
                need = max(1, -(-(excess + partner) // (2 * more)))
                parts = []
                for own in (x[~hit], p[other]):
                    level = order.of(own, settings)
                    parts.append(own[np.lexsort((own, level))] if level.any() else own)
                linked.append(link)
                deltas.append(delta)
                excesses.append(excess)
                grams.append(np.concatenate(parts)[: max(0, delta - need + 1)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(deltas, pa.int64()), pa.array(excesses, pa.int64()), lists_of(grams)], names=["pivot", "id", "linked", "delta", "excess", "grams"])

    # A set has as many pivots as lists at most.
    return met_sets(pairs, classes, settings).select("pivot", "id", F.col("grams").alias("gx"), "gp").mapInArrow(released(run), "pivot long, id long, linked boolean, delta long, excess long, grams array<long>")


def met_sets(pairs: DataFrame, classes: Classes, settings: JaccardSettings, sliced: bool = False) -> DataFrame:
    """``pivot, id, size, grams, np, gp``: both sets of each pair, or their slices."""
    left = classes.sets(pairs.groupBy("id").agg(F.collect_list("pivot").alias("pivots")), settings, sliced)
    leads = pairs.select(F.col("pivot").alias("id")).distinct().withColumn("pivots", F.array("id"))
    right = classes.sets(leads, settings, sliced).select("pivot", F.col("size").alias("np"), F.col("grams").alias("gp"))
    return left.join(right, "pivot")


def likely_pairs(pairs: DataFrame, classes: Classes, settings: JaccardSettings) -> DataFrame:
    """The pairs ``id, pivot`` that the bound by a slice leaves; no link is among the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for x, nx, p, n in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                stays.append(most_shared(x.values.to_numpy(), nx, p.values.to_numpy(), n) >= settings.overlap(nx, n))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "pivot"]).filter(pa.array(stays, pa.bool_()))

    met = met_sets(pairs, classes, settings, sliced=True)
    return met.select("id", "pivot", F.col("grams").alias("gx"), "size", "gp", "np").mapInArrow(released(run), "id long, pivot long")


def open_lists(lists: DataFrame) -> DataFrame:
    """The members that may link with one of another component on their list, with all columns.

    Two members may link if their excesses together are at most the reach of both.
    """
    whole = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("excess").alias("least"), F.max(F.col("reach") - F.col("excess")).alias("most")).where("lo <> hi")
    return lists.join(whole, "key").where("excess <= most and excess + least <= reach").select(*lists.columns)


def first_lists(docs: DataFrame, bound: int, order: Rarity, settings: JaccardSettings, clashing: list[int]) -> DataFrame:
    """Open lists of the sets' own n-grams.

    Most n-grams stand in one set alone and go first; common ones, that surely don't, are dealt
    out so that no task has all sets of one. Sets that link are of the same or of neighbouring
    classes of size, so a list of many sizes is split into one for each two of them.
    """
    entries = heavy_lists(docs, settings.heavy_from(bound), order, settings, clashing)
    same = Window.partitionBy("key", F.when(F.col("common"), F.pmod(F.col("id"), F.lit(256))).otherwise(0))
    entries = entries.withColumns({"lo": F.min("id").over(same), "hi": F.max("id").over(same), "small": F.min("size").over(same), "large": F.max("size").over(same)}).where("common or lo <> hi")
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(settings.percent / 100) + 1e-9)).cast("long")
    wide = F.col("common") | (100 * F.col("small").cast("long") < settings.percent * F.col("large").cast("long"))
    keys = F.explode(F.when(wide, F.array(F.xxhash64("key", step), F.xxhash64("key", step + 1))).otherwise(F.array("key")))
    reach = (F.col("size") - F.col("place")).cast("long") * F.lit(2 * (100 + settings.percent))
    lists = entries.select(keys.alias("key"), "id", F.col("id").alias("component"), reach.alias("reach"), (F.col("size").cast("long") * F.lit(2 * settings.percent)).alias("excess"), F.col("weight").cast("long").alias("weight"))
    return written(open_lists(written(lists, "heavy-entries")), "heavy-lists")


def open_pairs(lists: DataFrame) -> DataFrame:
    """All pairs ``id, pivot`` of different components that may link on a list."""
    a = lists.select("key", "id", F.col("component").alias("ca"), F.col("reach").alias("ra"), F.col("excess").alias("ea"))
    b = lists.select("key", F.col("id").alias("pivot"), F.col("component").alias("cb"), F.col("reach").alias("rb"), F.col("excess").alias("eb"))
    pairs = a.join(b, "key").where("ca < cb and ea + eb <= ra and ea + eb <= rb")
    return pairs.select("id", "pivot").distinct()


def short_and_long(lists: DataFrame, settings: JaccardSettings) -> tuple[DataFrame, DataFrame]:
    """Open pairs of the short lists, and the long lists.

    Members that still hold their ``grams`` would become an entry for each; where their pairs are
    fewer, the list is short as well.
    """
    n, entries = F.count("*"), F.sum(F.size("grams")) if "grams" in lists.columns else F.lit(0)
    sizes = lists.groupBy("key").agg(n.alias("n"), entries.alias("entries")).where(F.col("n") > settings.short_list)
    sizes = sizes.where((F.col("n") > settings.short_group) | (F.col("n") * (F.col("n") - 1) > F.col("entries"))).select("key")
    long = lists.join(sizes, "key", "left_semi")
    return written(open_pairs(lists.join(sizes, "key", "left_anti")), "heavy-short-pairs"), written(long, "heavy-long-lists")


def pairs_exceed(lists: DataFrame, settings: JaccardSettings) -> bool:
    """Whether the lists have more pairs than a round of pivots is there to avoid."""
    sizes = lists.groupBy("key").agg(F.count("*").cast("double").alias("n"))
    total = sizes.agg(F.sum("n").alias("entries"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    return (total.pairs or 0) > settings.pairs_per_entry * (total.entries or 0)


def heavy_links(classes: Classes, bound: int, order: Rarity, settings: JaccardSettings) -> DataFrame:
    """``a, b``: links that make the components of pairs with a heavy set."""
    lists = first_lists(classes.docs, bound, order, settings, classes.clashing)
    links = classes.docs.sparkSession.createDataFrame([], "a long, b long")
    short, lists = short_and_long(lists, settings)
    last = None
    for turn in range(settings.rounds):
        if turn and not pairs_exceed(lists, settings):
            break
        led = lists.groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot"))
        pairs = written(lists.join(led, "key").where("id <> pivot").select("id", "pivot").distinct(), "heavy-pairs")
        met = pairs.count()
        if not met or last is not None and met > 0.75 * last:
            break
        last = met
        compared = written(compare(pairs, classes, order, settings), "heavy-compared")
        parts = connected_components(links.unionAll(compared.where("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b"))))
        links = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
        more = F.lit(2 * (100 + settings.percent))
        named = compared.join(parts, "id", "left").select(F.col("pivot").alias("key"), "id", F.coalesce("component", "id").alias("component"), (F.col("delta") * more).alias("reach"), "excess", "grams")
        # A pivot's members without a possible partner go before their differences are listed; few members are met at once.
        few, named = short_and_long(open_lists(open_lists(named)), settings)
        named = named.select("key", "id", "component", "reach", "excess", F.posexplode("grams").alias("place", "gram"))
        # The member nearest to the last pivot leads.
        named = named.select(F.xxhash64("key", "gram").alias("key"), "id", "component", (F.col("reach") - F.col("place") * more).alias("reach"), "excess", (-F.col("excess")).alias("weight"))
        named = written(named, "heavy-differences")
        more_short, lists = short_and_long(written(open_lists(open_lists(named)), "heavy-lists"), settings)
        short = short.unionAll(few).unionAll(more_short)
    pairs = written(short.unionAll(open_pairs(lists)).select(F.least("id", "pivot").alias("id"), F.greatest("id", "pivot").alias("pivot")).distinct(), "heavy-pairs")
    likely = written(likely_pairs(pairs, classes, settings), "heavy-likely")
    found = compare(likely, classes, order, settings).where("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    return links.unionAll(written(found, "heavy-links"))


def joined_rows(docs: DataFrame, settings: JaccardSettings, doc_id: str, text: str) -> DataFrame:
    """``doc_id, th, n_shingles, first, class_id`` of every row.

    ``th`` is a hash of the text. ``first (no_id, doc_id, th)`` names the least row of the
    component, one without doc_id only where there is no other; it is null for an empty set.
    """
    docs = small_batches(taken(docs, doc_id, text))
    described = written(described_sets(docs.withColumn("th", F.xxhash64("text")), settings), "sets")
    rows = described.where("often is null").select("doc_id", "th", "n_shingles", "h1", "h2", "grams")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    classes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(least_row.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("grams").alias("grams"))
    classes = written(classes, "classes")
    clashing = [r.h1 for r in classes.groupBy("h1").count().where("count > 1").limit(1001).collect()]
    if len(clashing) > 1000:
        raise RuntimeError("too many sets share half of their hash")
    classes = classes.withColumn("id", class_id(clashing))
    small = F.col("n_shingles") <= 2 * settings.max_light
    sizes = {r.n_shingles: r.n for r in classes.where(small).groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    bound = light_boundary(sizes, settings)
    owners = classes.select("id", F.col("first.doc_id").alias("d"), F.col("first.th").alias("t"))
    repeated = bool(rows.groupBy("doc_id", "th").count().where("count > 1").take(1))
    links = light_links(classes, bound, settings).unionAll(heavy_links(Classes(docs, owners, repeated, clashing), bound, rarity(described, settings), settings))
    parts = connected_components(links)
    named = classes.join(parts, "id", "left").select("h1", "h2", "first", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = written(named.join(least, "component").select("h1", "h2", F.col("first.doc_id").alias("class_id"), F.col("least").alias("first")), "components")
    return rows.select("doc_id", "th", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "th", "n_shingles", "first", "class_id")


def join_documents(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row.

    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the smallest
    with the same set. Null and empty texts and texts without words have an empty set,
    link with nothing and are their own component. Rows with equal doc_id and different
    texts are nodes of their own; a null doc_id links its neighbours and has the ids of
    its component. Sets are told apart by 128-bit hashes, on lists by the
    first half of it, or the second where two sets share the first.
    Other columns are not read.
    """
    out = joined_rows(docs, settings, doc_id, text)
    return out.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id.

    Rows are known by doc_id and text, so another text under a dropped doc_id stays. Among
    texts with that smallest doc_id, and in a component without any doc_id, the one with
    the least hash stays; of rows with both equal one stays. Rows without words are
    components of their own and stay.
    """
    found = written(joined_rows(docs, settings, doc_id, text).where("n_shingles > 0"), "join")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    key_id, key_text, hashed_text = unused(docs, "key_id", "key_text", "hashed_text")
    key = [F.col("doc_id").alias(key_id), F.col("th").alias(key_text)]
    hashed = docs.withColumn(hashed_text, F.xxhash64(F.col(f"`{text}`")))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(key_id)) & (F.col(hashed_text) == F.col(key_text)), how)

    left = among(hashed, found.where(~first).select(*key).distinct(), "left_anti")
    again = found.where(first).groupBy(*key).count().where(F.col("count") > 1).select(key_id, key_text)
    if again.take(1):
        again = written(again, "repeated")
        left = among(left, again, "left_anti").unionAll(among(left, again, "left_semi").dropDuplicates([doc_id, hashed_text]))
    return left.drop(hashed_text)
