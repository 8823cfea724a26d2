"""Codes of vectors by product quantisation, with codebooks trained by filtering Lloyd rounds.

Components become integers, so every distance, tie and mean is exact. Vectors are cut into equal
parts, each with a codebook. The rows of a partition are dealt into blocks of at most ``BLOCK``
vectors, and each block has one kd-tree for each part: halves at the median of the widest side down to
about ``LEAF`` parts, every node with its bounding box, its count and the sum of its parts. The trees
are built once and written; each round goes down them level by level. At a node, the entry
nearest to the middle of the box stays, and every other one that is no nearer to any corner is
eliminated for the whole box; where a single entry is left, the subtree is its own by its cached sum
and count, and only leaves with several look at their parts.

A task sends one sum for each entry and component, whatever its rows, so a round moves as many
numbers as the codebooks have for each task, and the driver gets one codebook's worth.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import checked
from .shared import bounded_batches, dropped, written

SCALE, BLOCK, LEAF = 4096, 4096, 16


def integers(values: np.ndarray, dimension: int) -> np.ndarray:
    """floor(4096 * x) of each component; beyond what 64 bits can sum over a vector, an error."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    most = float(np.abs(scaled).max(initial=0))
    if 16 * dimension * most * most >= 2.0**62:
        raise OverflowError(f"a component of {most / SCALE:g} is too large for exact distances over {dimension} components")
    return scaled.astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Tree:
    """A kd-tree over the rows of points (n > 0 by d): its levels from the root, and the order of points in its leaves."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(n / LEAF))))
        self.order, self.levels, bounds = np.arange(n), [], np.array([0, n])
        for level in range(depth + 1):
            own, starts = points[self.order], bounds[:-1]
            low, high = np.minimum.reduceat(own, starts, axis=0), np.maximum.reduceat(own, starts, axis=0)
            self.levels.append((bounds, low, high, np.add.reduceat(own, starts, axis=0)))
            if level < depth:
                node = np.repeat(np.arange(len(starts)), np.diff(bounds))
                widest = (high - low).argmax(axis=1) if points.shape[1] else None
                side = own[np.arange(n), widest[node]] if widest is not None else node
                self.order = self.order[np.lexsort((side, node))]
                halves = np.empty(2 * len(bounds) - 1, np.int64)
                halves[::2], halves[1::2] = bounds, (bounds[:-1] + bounds[1:]) // 2
                bounds = halves
        self.points = points[self.order]

    def assign(self, entries: np.ndarray, coded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and counts of the parts of each entry, and each point's entry in the order of rows if ``coded``.

        Nearest is by squared Euclidean distance, ties to the lower index.
        """
        k, index = len(entries), np.arange(len(entries))
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
        codes = np.zeros(len(self.points), np.int64) if coded else None
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level, (bounds, lows, highs, totals) in enumerate(self.levels):
            low, high = lows[nodes], highs[nodes]
            middle = ((low + high)[:, None] - 2 * entries) ** 2
            best = np.where(alive, middle.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            nearest = entries[best][:, None]
            corner = np.where(entries > nearest, high[:, None], low[:, None])
            gap = ((entries - corner) ** 2 - (nearest - corner) ** 2).sum(axis=2)  # at the corner that favours each entry most
            alive &= (gap < 0) | ((gap == 0) & (index < best[:, None])) | (index == best[:, None])
            whole = alive.sum(axis=1) == 1
            starts, sizes = bounds[nodes], np.diff(bounds)[nodes]
            np.add.at(sums, best[whole], totals[nodes[whole]])
            np.add.at(counts, best[whole], sizes[whole])
            if coded:
                codes[_ranges(starts[whole], sizes[whole])] = np.repeat(best[whole], sizes[whole])
            nodes, alive, starts, sizes = nodes[~whole], alive[~whole], starts[~whole], sizes[~whole]
            if not len(nodes):
                break
            if level < len(self.levels) - 1:
                nodes, alive = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(alive, 2, axis=0)
                continue
            at = _ranges(starts, sizes)
            far = ((self.points[at][:, None] - entries) ** 2).sum(axis=2)
            own = np.where(np.repeat(alive, sizes, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)
            np.add.at(sums, own, self.points[at])
            counts += np.bincount(own, minlength=k)
            if coded:
                codes[at] = own
        if coded:
            out = np.empty_like(codes)
            out[self.order] = codes
            codes = out
        return sums, counts, codes


def _blocks(dimension: int, parts: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                vectors = integers(b["_vector"].flatten().to_numpy(zero_copy_only=False), dimension).reshape(b.num_rows, dimension)
                trees = [pickle.dumps(Tree(x)) for x in np.split(vectors, parts, axis=1)]
                ends = pa.array([0, b.num_rows], pa.int32())
                yield pa.RecordBatch.from_pydict({"_ids": pa.ListArray.from_arrays(ends, b["_id"]), "_labels": pa.ListArray.from_arrays(ends, b["_label"]), "_trees": pa.array([trees], pa.list_(pa.binary()))})

    return run


def _sums(books: list[np.ndarray]):
    """One round over a task's blocks: (part, entry, place, total, n)."""

    def run(batches):
        total, n = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for trees in batch["_trees"]:
                for i, tree in enumerate(trees):
                    s, c, _ = pickle.loads(tree.as_py()).assign(books[i])
                    total[i] += s
                    n[i] += c
        place = np.indices((len(books), *books[0].shape), np.int32).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*map(pa.array, place), pa.array(np.stack(total).ravel()), pa.array(np.repeat(np.stack(n).ravel(), books[0].shape[1]))], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for i, packed in enumerate(batch["_trees"][row]):
                    tree = pickle.loads(packed.as_py())
                    codes.append(tree.assign(books[i], coded=True)[2])
                    back = np.empty_like(tree.points)
                    back[tree.order] = tree.points
                    error = error + ((back - books[i][codes[-1]]) ** 2).sum(axis=1)
                text = [c.tobytes().hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_pydict({"_id": batch["_ids"][row].values, "_label": batch["_labels"][row].values, "code": pa.array(text, pa.string()), "error": pa.array(error, pa.int64())})

    return run


def kept_rows(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null and has neither null nor non-finite components."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: the id, the label, code (two hex digits a part), error, label_error and codebooks_sha256.

    Codebooks start with the ``entries`` vectors of the least ids (null ids last, equal ids in the order
    of their vectors), or with as many as there are; entries that no part is nearest to stay. The number of
    components is that of the first of them and must be a multiple of ``parts``; a vector with another
    number has a null code and error and counts in no sum. Repeated rows count each and have equal codes;
    ties of distances go to the lower index; null labels are one label; other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a codebook has 1 to 256 entries, and a vector 1 part or more")
    bounded_batches(vectors.sparkSession)
    base = kept_rows(vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector")), "_vector")
    first = [r[0] for r in base.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()]
    dimension = len(first[0]) if first else parts
    if dimension % parts:
        raise ValueError(f"{dimension} components can't be cut into {parts} equal parts")
    first = [x for x in first if len(x) == dimension]
    books = np.split(integers(np.array(first, np.float64).reshape(len(first), dimension), dimension), parts, axis=1)
    id_type, label_type = (base.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    like = F.size("_vector") == dimension
    trees = written(base.where(like).mapInArrow(_blocks(dimension, parts), f"_ids array<{id_type}>, _labels array<{label_type}>, _trees array<binary>"), "trees")
    for _ in range(rounds if first else 0):
        found = trees.select("_trees").mapInArrow(_sums(books), "part int, entry int, place int, total bigint, n bigint").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in found.where("n > 0").collect():
            books[r.part][r.entry, r.place] = r.total // r.n
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = written(trees.mapInArrow(_codes(books), f"_id {id_type}, _label {label_type}, code string, error bigint"), "codes")
    dropped(trees)
    sums = written(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors")
    other = base.where(~like).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    out = coded.unionByName(other).alias("c").join(checked(sums).alias("s"), F.col("c._label").eqNullSafe(F.col("s._label")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("c._label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
