"""Near copies among embeddings: tiles compared along PCA-ordered dimensions.

Vectors of one label are compared by cosine. Equal vectors of a label are one class from the start, which counts
as often as it comes. A rotation fitted on a bounded sample puts the dimensions in order of variance; it changes no cosine, so the sample decides on
speed alone. Unit vectors that reach the threshold are so near that they differ by at most REACH in any
dimension: classes fall into cells of that width along the leading dimensions, and only cells side by side are compared. Cells
are cut into tiles of bounded size, and every two tiles meet in one task.

Two tiles accumulate their products a few dimensions at a time. What the remaining dimensions can still add is at
most the product of the norms of the two suffixes; when a pair cannot reach the threshold any more it is dropped, and rows and columns without a
pair go with it. A pair is settled by its cosine in double precision; within EDGE of the
threshold that of the vectors as given decides. A tile returns no pairs: each class's number of links, and
links that connect what it saw.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and those with a null
label link with nothing; vectors of different lengths never link. Rows that repeat a vec_id are
vectors of their own. A component's id is its least vec_id that is not null; a row without an id that
links with nothing has no component, and is kept. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math
import sys
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import stored
from rollcall.llm.components import components

THRESHOLD = 0.93
# Vectors of each length that the rotation is fitted on.
SAMPLE = 4096
TILE = 1024  # classes in a tile
LEADING = 2  # dimensions that make a cell
STEP = 16  # dimensions that are accumulated at a time
SPARSE = 0.02  # share of pairs left below which they go on one by one
PAIRS = 100_000  # of those at a time
EDGE = 1e-10

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable() -> Column:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def classed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, cls): ``cls`` names label and vector by 128 bits, and is null where the vector takes no part."""
    v = F.col("embedding").cast("array<double>")
    # 0.0 and -0.0 are equal, and hash alike once 0.0 is added.
    v = F.transform(v, lambda x: x + F.lit(0.0))
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col("label"), v)), 16, "0") for seed in (1, 2)])
    return vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"), F.when(usable(), name).alias("cls"))


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the directions in order of variance, of unit vectors in a sample that is the same in every run."""
    out = {}
    for (size,) in classes.select(F.size("v").alias("d")).distinct().collect():  # one row per length of vectors
        sample = classes.where(F.size("v") == size).orderBy("cls").limit(SAMPLE).select("v").toArrow()
        x = unit(matrix(sample["v"].combine_chunks(), size))
        _, directions = np.linalg.eigh(x.T @ x)
        out[size] = np.ascontiguousarray(directions[:, ::-1])
    return out


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    # By the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def celled(classes: DataFrame, directions: dict[int, np.ndarray], reach: float) -> DataFrame:
    """``classes`` with ``d``, their length, and ``cell``, where they stand along the leading dimensions."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")])
            cells = np.zeros((len(sizes), LEADING), dtype=np.int64)
            for size in set(sizes.tolist()):
                pick = np.flatnonzero(sizes == size)
                x = unit(matrix(batch.column("v").take(pa.array(pick)), size)) @ directions[size][:, :LEADING]
                cells[pick, : x.shape[1]] = np.floor(x / reach)
            cell = pa.array(cells.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cls", "label", "v", "n")] + [pa.array(sizes), cell], ["cls", "label", "v", "n", "d", "cell"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"cls string, label {label}, v array<double>, n long, d long, cell array<long>")


def side_by_side(cells: DataFrame) -> DataFrame:
    """(label, d, cell, other, tiles, others): each cell with itself and its neighbours, in both directions."""
    steps = product((-1, 0, 1), repeat=LEADING)
    near = F.array(*[F.array(*[F.get("cell", F.lit(k)) + by for k, by in enumerate(step)]) for step in steps])
    known = cells.select("label", "d", F.col("cell").alias("other"), F.col("tiles").alias("others"))
    return cells.withColumn("other", F.explode(near)).join(known, ["label", "d", "other"])


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, cosine) of the pairs of rotated unit vectors that come within EDGE of the threshold or above it."""
    dims = a.shape[1]
    left, right = (np.sqrt(np.maximum(0.0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])) for x in (a, b))
    rows, cols = np.arange(len(a)), np.arange(len(b))
    sums, at = np.zeros((len(a), len(b))), 0
    least = threshold - EDGE
    while at < dims:
        to = min(dims, at + STEP)
        sums += a[rows, at:to] @ b[cols, at:to].T
        at = to
        rest = np.outer(left[rows, at], right[cols, at]) if at < dims else 0.0
        alive = sums + rest >= least
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        if not keep_r.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if at < dims and alive.sum() < SPARSE * alive.size:
            return one_by_one(a, b, rows, cols, sums, alive, left, right, at, least)
        if not (keep_r.all() and keep_c.all()):
            rows, cols, sums, alive = rows[keep_r], cols[keep_c], sums[np.ix_(keep_r, keep_c)], alive[np.ix_(keep_r, keep_c)]
    i, j = np.nonzero(alive)
    return rows[i], cols[j], sums[i, j]


def one_by_one(a, b, rows, cols, sums, alive, left, right, at: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``alike``, from dimension ``at`` on, for pairs so few that products of whole tiles would be waste."""
    every_i, every_j = np.nonzero(alive)
    out = []
    for k in range(0, len(every_i), PAIRS):
        i, j = every_i[k : k + PAIRS], every_j[k : k + PAIRS]
        x, y, value, here = rows[i], cols[j], sums[i, j], at
        while here < a.shape[1] and len(x):
            to = min(a.shape[1], here + STEP)
            value = value + (a[x, here:to] * b[y, here:to]).sum(axis=1)
            here = to
            fine = value + (left[x, here] * right[y, here] if here < a.shape[1] else 0.0) >= least
            x, y, value = x[fine], y[fine], value[fine]
        out.append((x, y, value))
    return tuple(np.concatenate(c) for c in zip(*out))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): ``b`` null: vectors of other classes that a tile finds linked to class ``a``; else a link between classes."""
    directions = rotations(classes)
    sent = classes.sparkSession.sparkContext.broadcast(directions)  # squares of the vectors' lengths
    reach = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    placed = stored(celled(classes, directions, reach), "cells")
    cells = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    # A class is needed where its own tile meets another one, from either side; the lesser tile's cell comes first in the name of a block.
    own = placed.join(side_by_side(cells), ["label", "d", "cell"])
    own = own.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    here, there = F.struct("cell", F.col("tile").alias("tile")), F.struct(F.col("other").alias("cell"), F.col("met").alias("tile"))
    blocks = own.select("label", "d", F.least(here, there).alias("i"), F.greatest(here, there).alias("j"), (here > there).alias("second"), "cls", "n", "v")

    def run(table: pa.Table) -> pa.Table:
        size = table["d"][0].as_py()
        v = matrix(table["v"].combine_chunks(), size)
        names, n, second = table["cls"].to_pylist(), table["n"].to_numpy(), table["second"].to_numpy(zero_copy_only=False)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        first, other = (np.arange(len(v)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        edges, counts = [], np.zeros(len(v), dtype=np.int64)
        if len(first) and len(other):
            x = unit(v) @ sent.value[size]
            i, j, value = alike(x[first], x[other], threshold)
            i, j = first[i], other[j]
            near = np.flatnonzero(np.abs(value - threshold) <= EDGE)
            exact = [cosine(v[i[k]], v[j[k]]) for k in near]
            value[near] = exact
            fine = (value >= threshold) & (i != j)
            i, j = i[fine], j[fine]
            np.add.at(counts, i, n[j])
            if not same:
                np.add.at(counts, j, n[i])
            edges = spanning_of(names, i, j)
        some = np.flatnonzero(counts)
        return pa.table(
            {
                "a": pa.array([names[k] for k in some] + [x for x, _ in edges], pa.string()),
                "b": pa.array([None] * len(some) + [y for _, y in edges], pa.string()),
                "links": pa.array(counts[some].tolist() + [0] * len(edges), pa.int64()),
            }
        )

    return blocks.groupBy("label", "d", "i", "j").applyInArrow(run, "a string, b string, links long")


def spanning_of(names: list[str], i: np.ndarray, j: np.ndarray) -> list[tuple[str, str]]:
    """Links that connect whatever the pairs connect."""
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((names[x], names[y]))
    return out


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    named = stored(classed(vectors), "classes")
    classes = named.where("cls is not null").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")
    )
    classes = stored(classes, "vectors")
    found = stored(linked(classes.select("cls", "label", "v", "n"), threshold), "linked")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls")
    group = stored(components(found.where("b is not null").select("a", "b")), "components").withColumnRenamed("id", "cls")
    each = classes.select("cls", "n", "least").join(links, "cls", "left").join(group, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    told = each.join(least, "component").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.select("vec_id", "cls").join(told, "cls", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
