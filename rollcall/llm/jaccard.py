"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

The set of a text is its distinct word shingles, each a 64-bit hash. Sets are put into bands of
size; two sets over the threshold are in the same or in neighbouring bands, and differ in at
most H elements, H fixed by the band. All possible elements are hashed into segments, and each
segment is allowed so many differences, less than one (allotment 1) or less than two (allotment 2). The
allotments of a band sum to more than H, so two sets over the threshold keep within them on some segments, with the
excess to spare. A segment of allotment 1 is indexed by a hash of what the set has in it, one of allotment 2 also by its one-deletion
neighbourhood. Empty segments of allotment 1 would make unlike sets meet; but sets that keep to none but such
segments have as many of them in common as the excess, so only every choice of so many empty ones is indexed. Which segments get 2 is a matter of cost: deletions make more signatures, but longer segments make fewer
false candidates. Each set is indexed for its own band and for the band below.

Sets that share a signature are candidates. Candidates are gathered into groups (chains of shared
signatures, band by band). In a group, sets that agree on fewer segments than the excess demands
cannot be linked, whatever they share; that is seen from one number for each segment, and what is left falls
into families, each of one band. A family is verified exactly. Both steps go in blocks of bounded size: every two chunks of a group
or family meet in one task, which compares segments, or counts common elements by matrix products, and gives the links
that connect what it saw. So the work of F sets that are alike but not linked grows with F squared over the square of a chunk.

Equal sets are one class from the start, by a 64-bit hash of size and contents.

Defined results: null and empty texts, and texts without words, have an empty set and link with
nothing. A text of fewer words than a shingle has one element, its whole sequence. Rows that
repeat a doc_id are documents of their own with a common id; null ids take part, and a group's
id is its least id that is not null. Other columns play no part.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm.common import batches_of, broadcast_below, discard, let, lower_ascii, places, stored
from rollcall.llm.components import components

SHINGLE = 3
PERCENT = 90
# Rows of single ids that may be broadcast (16 MB); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
# Elements that a Python worker works on at a time.
SLICE = 150_000
# What a false candidate costs, in signatures shuffled, and the share of a family's elements that a copy keeps.
CANDIDATE_COST, KEPT = 400.0, 0.85
STRANGERS = 2e4  # sets of a band that a set must not meet for nothing
# Sets over the threshold agree on so many segments at most, by choice.
MOST_AGREE = 6
LONG = 9  # elements that a segment has to have on average for its deletions to be indexed
# A family is cut into chunks of so many sets or elements, a group into chunks of so many sketches or bytes of them.
CHUNK_SETS, CHUNK_ELEMENTS = 4096, 2_000_000
TILE_SETS, TILE_ELEMENTS = 512, 125_000  # of each chunk, what is multiplied at a time
CHUNK_SKETCHES, CHUNK_BYTES = 4096, 1 << 23
STRIP = 256  # sketches of one chunk that are held against those of another at a time
BATCH_ROWS = 1000  # sets handed to Python at a time, which JVM and Python both hold whole
COLUMNS = 2048  # elements that a matrix product takes at a time

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The set of a text, as distinct 64-bit hashes."""
    ws = F.array_remove(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), "")

    def of(ws: Column) -> Column:
        whole = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.lit("whole"), ws))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(places(F.size(ws) - size + 1), lambda i: F.xxhash64(*[F.get(ws, i - 1 + j) for j in range(size)]))
        return F.when(F.size(ws) >= size, F.array_distinct(each)).otherwise(whole)

    return let(ws, of)


def allotment(differ: int, size: int) -> tuple[int, int]:
    """Number of segments, and how many of them get 2: the cheapest choice for sets of a size.

    An allotment of 1 takes one signature and one of 2 one more for each element. A false
    candidate comes about where in any segment all elements of a family were kept, or all but
    one; and, between sets that have nothing to do with each other, where as many segments
    are empty in both as the sum exceeds ``differ``. A larger excess prevents that, but makes more segments,
    and more choices of empty ones to be indexed.
    """

    def cost(agree: int, twos: int) -> float:
        segments = differ + agree - twos
        length = size / segments
        whole = KEPT**length
        near = min(1.0, whole * (1 + length * (1 - KEPT) / KEPT))
        false = 1 - (1 - whole) ** (segments - twos) * (1 - near) ** twos
        ways = math.comb(segments - twos, agree)
        strangers = min(1.0, STRANGERS * ways * math.exp(-2 * length * agree))
        return segments + twos * length + ways * math.exp(-length * agree) + CANDIDATE_COST * (false + strangers)

    choices = [(agree, 0) for agree in range(1, MOST_AGREE + 1)]
    # Deletions are for long segments; in short ones they would only spend the excess.
    choices += [(agree, t) for agree in (1, 2) for t in range(1, (differ + agree) // 2 + 1) if size >= LONG * (differ + agree - t)]
    agree, twos = min(choices, key=lambda c: (cost(*c), c))
    return differ + agree - twos, twos


class Bands:
    """Size bands, and the segments and allotments of each, for a threshold in percent."""

    def __init__(self, percent: int, most: int = 1 << 31, allot: Callable[[int, int], tuple[int, int]] = allotment):
        low = [1]
        while low[-1] <= most:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, dtype=np.int64)
        top = self.low[1:] - 1  # largest size in each band
        self.partner = top * 100 // percent  # largest size that can link with it
        # |r| + |s| = A and 100 I >= percent (A - I) leave at most this many elements in one set only.
        self.differ = (top + self.partner) * (100 - percent) // (100 + percent)
        # Very long texts are few, and their choices of empty segments many: there every empty one is indexed.
        very = self.differ > 200
        chosen = [allot(int(h), int(n)) if 0 < h <= 200 else (int(h) + MOST_AGREE if h else 0, 0) for h, n in zip(self.differ, low)]
        self.count, self.twos = (np.array(x, dtype=np.int64) for x in zip(*chosen))
        # On how many segments, those of allotment 2 counted by what they have to spare, sets over the threshold agree.
        self.agree = np.where(self.count > 0, self.count + self.twos - self.differ, 1)
        self.choose = np.where(very, 1, self.agree)  # empty segments in one choice

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def segments(self, band: np.ndarray) -> np.ndarray:
        """None where only equal sets can link."""
        return np.where(band >= 0, self.count[np.maximum(band, 0)], 0)

    def roles(self, sizes: np.ndarray) -> list[np.ndarray]:
        """The bands under which sets are indexed: their own and the one below (-1: none)."""
        own = self.of(sizes)
        below = np.where((own > 0) & (sizes <= self.partner[np.maximum(own - 1, 0)]), own - 1, -1)
        return [np.where(sizes > 0, own, -1), np.where(sizes > 0, below, -1)]


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_sums(elements: np.ndarray, row: np.ndarray, bands: Bands, role: np.ndarray) -> tuple[np.ndarray, ...]:
    """For one role: the first slot of each row, each element's slot (-1: none), each slot's signature."""
    per = bands.segments(role)
    first = np.concatenate(([0], np.cumsum(per)))
    m = per[row].astype(np.uint64)
    used = m > 0
    slot = np.full(len(elements), -1, dtype=np.int64)
    slot[used] = first[row[used]] + ((mix(elements[used], 1) >> np.uint64(8)) % m[used]).astype(np.int64)
    sums = np.zeros(first[-1], dtype=np.uint64)
    np.add.at(sums, slot[used], mix(elements[used], 2))
    owner = np.repeat(np.arange(len(per)), per)
    name = (role[owner].astype(np.uint64) << np.uint64(40)) | (np.arange(first[-1]) - first[owner]).astype(np.uint64)
    return first, slot, sums, mix(name, 3)


def classes_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal sets."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    prints = np.zeros((2, len(sizes)), dtype=np.uint64)
    for k in range(2):
        np.add.at(prints[k], row, mix(elements, 4 + k))
    return mix(prints[0] ^ mix(prints[1] ^ mix(sizes.astype(np.uint64), 6), 7), 8)


def nodes_of(classes: np.ndarray, role: np.ndarray) -> np.ndarray:
    """One number for a class in a role: groups are kept apart by band."""
    return mix(classes + mix(role.astype(np.uint64), 12), 13)


def signatures(elements: np.ndarray, ends: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, signature) of every signature of every set in all roles."""
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    classes = classes_of(elements, sizes)
    rows, nodes, values = [], [], []
    for role in bands.roles(sizes):
        first, slot, sums, names = segment_sums(elements, row, bands, role)
        owner = np.repeat(np.arange(len(sizes)), np.diff(first))
        twos = bands.twos[np.maximum(role, 0)]
        single = np.arange(first[-1]) - first[owner] >= twos[owner]
        held = np.zeros(first[-1], dtype=bool)
        held[slot[slot >= 0]] = True
        exact = held | ~single
        # The one-deletion neighbourhoods of the first segments of a band, as many as have allotment 2.
        near = (slot >= 0) & (slot - first[row] < twos[row])
        who, choice = empty_choices(owner, names, single & ~held, bands.choose[np.maximum(role, 0)])
        mine = np.concatenate((owner[exact], row[near], who))
        rows.append(mine)
        nodes.append(nodes_of(classes, role)[mine])
        values += [mix(sums + names, 9)[exact], mix(sums[slot[near]] - mix(elements[near], 2) + names[slot[near]], 9), choice]
    return np.concatenate(rows), np.concatenate(nodes), np.concatenate(values)


def empty_choices(owner: np.ndarray, names: np.ndarray, empty: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of every choice of as many empty segments of a set as its band has to agree on."""
    at = np.flatnonzero(empty)
    rows, starts, counts = np.unique(owner[at], return_index=True, return_counts=True)
    who, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n, k in sorted(set(zip(counts.tolist(), agree[rows].tolist()))):
        if n >= k:
            same = (counts == n) & (agree[rows] == k)
            choices = np.array(list(combinations(range(n), k)))
            # One row for each set with n empty segments, one column for each choice.
            slots = at[starts[same][:, None] + np.arange(n)]
            value.append(mix(mix(names[slots], 10)[:, choices].sum(axis=2, dtype=np.uint64), 11).ravel())
            who.append(np.repeat(rows[same], len(choices)))
    return np.concatenate(who), np.concatenate(value)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets[1:] - offsets[0]


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some SLICE elements."""
    ends = batch.column(column).offsets.to_numpy()[1:].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else ends[0] - len(batch.column(column)[0])
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, with memory that is free already handed back to the system before and after it.

    Worker processes serve many tasks, and keep what their largest one needed, beside a JVM that does so too.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return held


def index(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n, cls): set size and class of each document; ``row`` stands for its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "set"):
                elements, ends = flat(batch.column("set"))
                sizes = np.diff(ends.astype(np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array(sizes), pa.array(classes_of(elements, sizes).view(np.int64))],
                    ["doc_id", "row", "n", "cls"],
                )

    sets = docs.select(F.col("doc_id").cast("long"), row_key(), shingles(F.col("text"), size).alias("set"))
    return sets.mapInArrow(lean(run), "doc_id long, row long, n long, cls long")


def signed(docs: DataFrame, bands: Bands, size: int) -> DataFrame:
    """(sig, node): every signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "set"):
                elements, ends = flat(batch.column("set"))
                _, nodes, values = signatures(elements, ends.astype(np.int64), bands)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(nodes.view(np.int64))], ["sig", "node"])

    return docs.select(shingles(F.col("text"), size).alias("set")).mapInArrow(lean(run), "sig long, node long")


def sketched(docs: DataFrame, bands: Bands, size: int) -> DataFrame:
    """(node, cls, band, sketch): for every document and role, one 32-bit number for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "set"):
                elements, ends = flat(batch.column("set"))
                sizes = np.diff(ends.astype(np.int64), prepend=0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                classes = classes_of(elements, sizes)
                for role in bands.roles(sizes):
                    first, _, sums, _ = segment_sums(elements, row, bands, role)
                    small = (mix(sums, 14) >> np.uint64(32)).astype("<u4")
                    some = np.flatnonzero(np.diff(first))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(nodes_of(classes, role)[some].view(np.int64)),
                            pa.array(classes[some].view(np.int64)),
                            pa.array(role[some]),
                            pa.array([small[first[i] : first[i + 1]].tobytes() for i in some], pa.binary()),
                        ],
                        ["node", "cls", "band", "sketch"],
                    )

    return docs.select(shingles(F.col("text"), size).alias("set")).mapInArrow(lean(run), "node long, cls long, band long, sketch binary")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def chunked(members: DataFrame, group: str, sets: Column, key: str) -> DataFrame:
    """``members`` with their ``chunk``, repeated for every other chunk of their group: a row for each block (``i``, ``j``) it is in."""
    sized = members.groupBy(group).agg(F.ceil(sets).cast("int").alias("chunks"))
    own = members.join(sized, group).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *members.columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )


def in_blocks(placed: DataFrame, group: str, found: Callable[[list[dict], list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``found`` says of the two chunks of every block. Blocks pass one by one; a task holds one at a time."""
    key = (group, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            first = [r for r in rows if r["chunk"] == now[1]]
            second = first if now[1] == now[2] else [r for r in rows if r["chunk"] == now[2]]
            pairs = found(first, second) if first and second and len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            lists = {c: flat(v) for c, v in columns.items() if pa.types.is_list(v.type)}
            plain = {c: v.to_pylist() for c, v in columns.items() if c not in lists}
            for k in range(batch.num_rows):
                row = {c: v[k] for c, v in plain.items()}
                for c, (values, ends) in lists.items():
                    row[c] = values[ends[k - 1] if k else 0 : ends[k]].copy()
                this = tuple(row[c] for c in key)
                if this != now:
                    if rows:
                        yield out()
                    now, rows = this, []
                rows.append(row)
        if rows:
            yield out()

    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(run), "a long, b long")


def families(docs: DataFrame, indexed: DataFrame, bands: Bands, size: int) -> DataFrame:
    """(cls, family) of the classes that may have links, joined with all they may be connected to under the same band.

    A class has a row for each of its bands; linked classes share a family in a band that both are indexed for.
    The sets are worked out again here rather than stored: they are larger than the texts.
    """
    # Copies are taken out before their signatures are: one row of each class goes on.
    first = indexed.groupBy("cls").agg(F.count_distinct("row").alias("c"), F.min("row").alias("first")).where("c > 1")
    skipped = stored(indexed.join(first, "cls").where("row <> first").select("row").distinct(), "skipped")
    rows = docs.select(row_key(), "text").join(broadcast_below(skipped, skipped.count(), BROADCAST_ROWS), "row", "left_anti")
    # One shuffle finds each signature's least node; all that share it link to that one only.
    least = F.min("node").over(Window.partitionBy("sig"))
    stars = signed(rows, bands, size).withColumn("least", least).where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    group = components(stars).select(F.col("id").alias("node"), F.col("component").alias("family"))
    members = stored(sketched(rows, bands, size).join(group, "node").dropDuplicates(["node"]), "sketches")
    needed = (bands.agree - bands.twos).tolist()

    def agreeing(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
        left, right = (np.array([np.frombuffer(r["sketch"], "<u4") for r in side]).T.copy() for side in (a, b))
        agreed = np.zeros((len(a), len(b)), dtype=bool)
        for at in range(0, len(a), STRIP):
            same = np.zeros((min(STRIP, len(a) - at), len(b)), dtype=np.int32)
            for x, y in zip(left[:, at : at + STRIP], right):
                same += x[:, None] == y[None, :]
            # A segment of allotment 2 that is not the same may still be near.
            agreed[at : at + STRIP] = same >= needed[a[0]["band"]]
        return spanning([r["node"] for r in a], [r["node"] for r in b], agreed)

    chunks = F.greatest(F.count(F.lit(1)) / CHUNK_SKETCHES, F.sum(F.length("sketch")) / CHUNK_BYTES)
    found = in_blocks(chunked(members, "family", chunks, "node"), "family", agreeing)
    family = components(found).select(F.col("id").alias("node"), F.col("component").alias("family"))
    out = stored(members.select("node", "cls").join(family, "node").select("cls", "family"), "families")
    discard(members, skipped)
    return out


def tiles(sizes: np.ndarray) -> list[slice]:
    """Runs of some TILE_SETS sets or TILE_ELEMENTS elements, one set at least."""
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        full = int(np.searchsorted(ends, ends[at] - sizes[at] + TILE_ELEMENTS, side="right"))
        out.append(slice(at, min(at + TILE_SETS, max(at + 1, full))))
        at = out[-1].stop
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    values = np.concatenate(a + b)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    _, code = np.unique(values, return_inverse=True)
    left = row < len(a)
    # Only elements that both sides have can be common.
    both = (np.bincount(code[left], minlength=code.max() + 1) > 0) & (np.bincount(code[~left], minlength=code.max() + 1) > 0)
    column = np.cumsum(both) - 1
    pick = both[code]
    row, code = row[pick], column[code[pick]]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(code, (start, start + COLUMNS))
        dense = np.zeros((len(a) + len(b), COLUMNS), dtype=np.float32)
        dense[row[lo:hi], code[lo:hi] - start] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return np.rint(out).astype(np.int64)


def spanning(a: list[int], b: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever the linked pairs connect, at most one for each set of either side.

    Sets are reached from one another; each row and each column of ``linked`` is looked at once.
    """
    across = np.ascontiguousarray(linked.T)
    new_a, new_b = linked.any(axis=1), linked.any(axis=0)
    out = []
    for start in np.flatnonzero(new_a):
        reached = [int(start)] if new_a[start] else []
        new_a[start] = False
        while reached:
            i = reached.pop()
            for j in np.flatnonzero(linked[i] & new_b):
                new_b[j] = False
                more = np.flatnonzero(across[j] & new_a)
                new_a[more] = False
                reached += more.tolist()
                out += [(a[k], b[j]) for k in (i, *more.tolist()) if a[k] != b[j]]
    return out


def links(docs: DataFrame, indexed: DataFrame, bands: Bands, percent: int, size: int) -> DataFrame:
    """(id, component) of the classes with links to others; joins all that are connected by links."""
    known = families(docs, indexed, bands, size)
    reps = indexed.groupBy("cls").agg(F.first("n").alias("n"), F.min("row").alias("row"))
    near = stored(reps.join(known, "cls"), "near")
    wanted = near.select("row", "cls").distinct()
    chunks = F.greatest(F.count(F.lit(1)) / CHUNK_SETS, F.sum("n") / CHUNK_ELEMENTS)
    texts = docs.select(row_key(), "text").join(broadcast_below(wanted, near.count(), BROADCAST_ROWS), "row").dropDuplicates(["cls"])
    sets = texts.select("cls", F.array_sort(shingles(F.col("text"), size)).alias("set"))
    placed = chunked(near.drop("row"), "family", chunks, "cls").join(sets, "cls")

    def over(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
        x, y = ([r["set"] for r in side] for side in (a, b))
        nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        linked = np.zeros((len(a), len(b)), dtype=bool)
        for i in tiles(nx):
            for j in tiles(ny):
                common = _common(x[i], y[j])
                linked[i, j] = common * 100 >= (nx[i, None] + ny[None, j] - common) * percent
        return spanning([r["cls"] for r in a], [r["cls"] for r in b], linked)

    return stored(components(in_blocks(placed, "family", over)), "components")


def grouped(docs: DataFrame, percent: int, size: int, allot: Callable[[int, int], tuple[int, int]]) -> DataFrame:
    """(doc_id, row, n, component): set size and group of every row; empty sets are in none."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        indexed = stored(index(docs, size), "index")
        known = links(docs, indexed, Bands(percent, allot=allot), percent, size)
    return indexed.join(known.withColumnRenamed("id", "cls"), "cls", "left").select(
        "doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("component")
    )


def groups(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, allot: Callable[[int, int], tuple[int, int]] = allotment
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: the least id reachable by links of ``percent`` or more."""
    named = grouped(docs, percent, size, allot)
    firsts = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    return named.join(firsts, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")
    )


def without_copies(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group, the one with its least id (none is the last); rows with an empty set all stay.

    Rows are told apart by id and text. Of rows that agree in both, one stays.
    """
    named = stored(grouped(docs, percent, size, allotment).where("component is not null"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = named.groupBy("component").agg(F.min(order).alias("first"))
    gone = named.join(firsts, "component").where(F.col("row") != F.col("first.row")).select(F.col("row").alias("_row")).distinct()
    gone = stored(gone, "copies")
    key = row_key()
    left = docs.join(broadcast_below(gone, gone.count(), BROADCAST_ROWS), key == F.col("_row"), "left_anti")
    twice = stored(named.groupBy("row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("row").alias("_row")), "twice")
    n = twice.count()
    if not n:
        return left.select(*docs.columns)
    again = broadcast_below(twice, n, BROADCAST_ROWS)
    once = left.join(again, key == F.col("_row"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, key == F.col("_row"), "left_anti").unionByName(once).select(*docs.columns)
