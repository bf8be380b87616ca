"""Embedding near-dedup by an epsilon grid order join.

Equal vectors of one label form a class. Class vectors are scaled to length 1,
so cosine >= t is distance <= eps = sqrt(2 - 2t), and rotated onto their
principal axes (from the second moments of all vectors). The grid order sorts
by label and by the cells (side eps) on the leading axes; the sorted sequence
is cut into intervals. Two intervals can hold links only if their labels meet
and their boxes lie within eps; all pairs for which that cannot be excluded
are joined, each by halving both sides until a block is provably distant or
small, where one matrix product decides by cosine in double precision.

The sorted sequence is a written table, a file for each interval with row groups of about BLOCK vectors. A
task gets a pair of intervals and reads both files; a file of more than HELD blocks is kept as
boxes only and its blocks are read again as they are needed, so a task's memory does not grow with
the table, and no vector is copied per pair.

A joined pair reports link counts per class and a spanning forest of its
links, never the links themselves; large-star and small-star steps put the forests together.

Components are compared in double precision as they come. Labels of an integral type count as such,
others by a 64-bit hash. Vectors that are null, empty, zero or hold null or non-finite components, and
rows whose label is null, link with nothing: n_links 0, component their own
id. Vectors of different dimension don't link. Repeated rows are linked to
each other. A null id gives a row without links and a null component. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import least_members
from .common import discard, files_of, opened, partitions, written

AXES = 8
#: Vectors in an interval, and intervals at most (their boxes and pairs are all the driver sees): beyond, intervals hold more blocks.
INTERVAL, MOST_INTERVALS = 4096, 1024
#: Vectors in a block, and blocks of a file that a task holds.
BLOCK, HELD = 4096, 32
LEAF = 256
SLACK = 1e-9  # widens boxes against rounding


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """dim x AXES orthonormal directions of greatest second moment about the mean, over all rows."""

    def sums(batches):
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s], "m": [m.reshape(-1)]})

    rows = classes.select("vec").mapInArrow(sums, "n long, s array<double>, m array<double>")
    # one row per partition, added up in a tree of groups
    n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
    for r in rows.toLocalIterator():
        n, s, m = n + r.n, s + np.array(r.s), m + np.array(r.m).reshape(dim, dim)
    mean = s / max(n, 1)
    _, vectors = np.linalg.eigh(m / max(n, 1) - np.outer(mean, mean))
    return vectors[:, ::-1][:, : min(AXES, dim)]


class Interval:
    """Sorted vectors of a piece of the sequence, with the boxes of its halves on demand."""

    def __init__(self, label, rep, count, unit, low):
        order = np.lexsort((*low.T[::-1], label))
        self.label, self.rep, self.count, self.unit, self.low = label[order], rep[order], count[order], unit[order], low[order]
        self.boxes: dict[tuple[int, int], tuple] = {}

    def box(self, a: int, b: int):
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.label[a], self.label[b - 1], self.low[a:b].min(axis=0), self.low[a:b].max(axis=0)
        return self.boxes[a, b]


def distant(p, q, eps: float) -> bool:
    """Whether boxes (least label, greatest label, low corner, high corner) hold no link for certain."""
    if p[1] < q[0] or q[1] < p[0]:
        return True
    gap = np.maximum(0, np.maximum(p[2] - q[3], q[2] - p[3]) - SLACK)
    return float(gap @ gap) > eps * eps + SLACK


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def join_pair(x: Interval, y: Interval, least: float, eps: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Links between x and y (or within x, if they are one): counts for x and y, and the forest over x then y."""
    same = x is y
    nx = np.zeros(len(x.rep), np.int64)
    ny = nx if same else np.zeros(len(y.rep), np.int64)
    forest = Forest(len(x.rep) + (0 if same else len(y.rep)))
    shift = 0 if same else len(x.rep)
    todo = [(0, len(x.rep), 0, len(y.rep))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and c >= b and (c, d) < (a, b) or same and d <= a:
            continue
        if distant(x.box(a, b), y.box(c, d), eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            if same and (a, b) == (c, d):
                m = (a + b) // 2
                todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
            elif b - a >= d - c:
                todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        hit = (x.unit[a:b] @ y.unit[c:d].T >= least) & (x.label[a:b, None] == y.label[None, c:d])
        if same and (a, b) == (c, d):
            hit = np.triu(hit, 1)
        nx[a:b] += hit @ y.count[c:d]
        ny[c:d] += x.count[a:b] @ hit
        # a forest needs only one link for each row and, of each column, one to each distinct first row
        for i in np.flatnonzero(hit.any(axis=1)):
            cols = np.flatnonzero(hit[i])
            if same or len(cols):
                r = forest.root(a + i)
                for j in cols:
                    if forest.up[shift + c + j] != r:
                        forest.join(r, shift + c + j)
                        r = forest.root(r)
    return nx, ny, forest


def interval_pairs(boxes: list[tuple], eps: float) -> list[tuple[int, int]]:
    """Pairs of intervals that may hold links, by halving the sequence of intervals."""
    n = len(boxes)
    whole: dict[tuple[int, int], tuple] = {}

    def box(a, b):
        if b - a == 1:
            return boxes[a]
        if (a, b) not in whole:
            p, q = box(a, (a + b) // 2), box((a + b) // 2, b)
            whole[a, b] = min(p[0], q[0]), max(p[1], q[1]), np.minimum(p[2], q[2]), np.maximum(p[3], q[3])
        return whole[a, b]

    out, todo = [], [(0, n, 0, n)] if n else []
    while todo:
        a, b, c, d = todo.pop()
        if distant(box(a, b), box(c, d), eps):
            continue
        if (a, b) == (c, d):
            if b - a == 1:
                out.append((a, a))
            else:
                m = (a + b) // 2
                todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a == 1 and d - c == 1:
            out.append((a, c))
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
    return sorted(out)


class Stretch:
    """A file of the sorted sequence: the box of each row group, and the row groups as intervals."""

    def __init__(self, uri: str, axes: np.ndarray):
        fs, path = opened(uri)
        self.file, self.axes = pq.ParquetFile(fs.open_input_file(path)), axes
        self.held: dict[int, Interval] = {}
        self.boxes = []
        for k in range(self.file.num_row_groups):
            own = self.block(k)
            self.boxes.append((int(own.label.min()), int(own.label.max()), own.low.min(axis=0), own.low.max(axis=0)) if len(own.rep) else None)

    def block(self, k: int) -> Interval:
        if k not in self.held:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            t = self.file.read_row_group(k).combine_chunks()
            unit = _unit(_matrix(t["vec"].chunk(0))) if len(t) else np.zeros((0, len(self.axes)))
            self.held[k] = Interval(t["label"].to_numpy(), t["rep"].to_numpy(), t["n"].to_numpy(), unit, unit @ self.axes)
        return self.held[k]


def grid_join(classes: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links of the classes (label, rep, n, vec, all of one dimension): rows (rep, links, root), root null in count rows; and the table that they are read from."""
    spark = classes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    axes = principal_axes(classes, dim)
    cut = max(1, min(MOST_INTERVALS, -(-classes.count() // INTERVAL)))
    names = [f"c{i}" for i in range(axes.shape[1])]

    def place(batches):
        for batch in batches:
            cells = np.floor(_unit(_matrix(batch.column(3))) @ axes / max(eps, 1e-6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells.T)], [*batch.schema.names, *names])

    kinds = "label long, rep long, n long, vec array<double>"
    placed = classes.select("label", "rep", "n", "vec").mapInArrow(place, f"{kinds}, " + ", ".join(f"{c} int" for c in names))
    ordered = placed.repartitionByRange(cut, "label", *names, F.xxhash64("rep")).sortWithinPartitions("label", *names).select("label", "rep", "n", "vec")
    # compression would make row groups of a size in bytes vary in vectors
    held = written(ordered, "grid-order", **{"parquet.block.size": str(BLOCK * (8 * dim + 24)), "compression": "none"})
    files = files_of(held)

    def each(rows: DataFrame, kinds: str, of) -> DataFrame:
        """``of`` (a number) over the numbers in the only column of ``rows``."""

        def go(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from of(k)

        return rows.mapInArrow(go, kinds)

    def boxes(k: int):
        stretch = Stretch(files[k], axes)
        found = [x for x in stretch.boxes if x is not None]
        if found:
            lo, hi = np.min([x[2] for x in found], axis=0), np.max([x[3] for x in found], axis=0)
            yield pa.RecordBatch.from_pydict({"part": [k], "a": [min(x[0] for x in found)], "b": [max(x[1] for x in found)], "lo": [lo], "hi": [hi]}, schema=pa.schema([("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    numbers = spark.range(0, len(files), 1, max(1, min(len(files), 4 * partitions(spark))))
    found = sorted(each(numbers, "part int, a long, b long, lo array<double>, hi array<double>", boxes).collect())  # a row for each of MOST_INTERVALS
    near = interval_pairs([(r.a, r.b, np.array(r.lo), np.array(r.hi)) for r in found], eps)
    pairs = [(found[i].part, found[j].part) for i, j in near]

    def solve(k: int):
        i, j = pairs[k]
        x = Stretch(files[i], axes)
        y = x if i == j else Stretch(files[j], axes)
        for g, p in enumerate(x.boxes):
            for h in range(g if i == j else 0, len(y.boxes)):
                if p is None or y.boxes[h] is None or distant(p, y.boxes[h], eps):
                    continue
                u = x.block(g)
                v = u if i == j and g == h else y.block(h)
                nu, nv, forest = join_pair(u, v, least, eps)
                reps = u.rep if u is v else np.concatenate([u.rep, v.rep])
                counts = nu if u is v else np.concatenate([nu, nv])
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                yield pa.RecordBatch.from_pydict({"rep": reps[some], "links": counts[some], "root": pa.nulls(len(some), pa.int64())})
                roots = np.array([forest.root(i) for i in range(len(reps))], np.int64)
                some = np.flatnonzero(roots != np.arange(len(reps)))
                yield pa.RecordBatch.from_pydict({"rep": reps[some], "links": pa.nulls(len(some), pa.int64()), "root": reps[roots[some]]})

    # neighbouring pairs share an interval, but so do their costs: they are dealt in turn
    tasks = max(1, min(len(pairs), 4 * partitions(spark)))
    return each(spark.range(0, len(pairs), 1, tasks), "rep long, links long, root long", solve), held


def near_dedup(vectors: DataFrame, *, least: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, n_links, component_id, kept: one row per row of ``vectors``."""
    spark = vectors.sparkSession
    fine = F.expr("label is not null and id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x <> 0)")
    label = F.col(label_column)
    whole = isinstance(vectors.schema[label_column].dataType, T.IntegralType)
    label = label.cast("long") if whole else F.when(label.isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.select("id", "label", "v", F.coalesce(fine, F.lit(False)).alias("fine"), F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    classes = written(rows.filter("fine").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("v").alias("vec")), "vector-classes")
    found, sorted_ = None, []
    for (dim,) in sorted(classes.select(F.size("vec")).distinct().collect()):  # a row per dimension
        part, held = grid_join(classes.filter(F.size("vec") == dim), dim, least)
        sorted_.append(held)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    found = written(found, "grid-links")
    discard(spark, *sorted_)
    named = written(least_members(found.filter("root is not null").select(F.col("rep").alias("u"), F.col("root").alias("v"))), "vector-components")
    links = found.filter("root is null").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = written(
        classes.select("label", "h1", "h2", "rep", "n")
        .join(links, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")),
        "vector-results",
    )
    yes = rows.filter("fine").select("id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    no = rows.filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return yes.union(no).select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
