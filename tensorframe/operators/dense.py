"""Contraction of two operands in blocks: numpy products where a join would form a row for every product.

Both operands are numbered along batch, row (or column) and inner letters. Cells are gathered into
blocks of at least SIDE rows and at most SIDE * INNER cells, packed in as few bytes as their values need; every pair of a row block and
a column block of one batch is a task's work, for which the blocks of both sides are sent in order of the inner place. The task adds up one
result block at a time and holds two blocks, so its memory is bounded whatever the tensors' sizes, and
no product leaves it.

A block is sent once for each block that it meets, so many small blocks mean much traffic. Where there are more pairs than tasks
blocks are made wider, up to WIDER times SIDE rows, and span as many places as it takes to hold that many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.semiring import Semiring
from ..sources.storage import partitions

SIDE, INNER = 256, 2048
#: Rows of a block at most, in multiples of SIDE; cells of a result that a task gives at once.
WIDER, GIVEN = 8, 1 << 18
#: Products from which blocks pay, and multiplications in blocks that one product of a join is worth.
LEAST, WORTH = 1_000_000, 2_000
EXACT = float(2**53)
#: Cells that a task packs at once (and bytes of blocks that it gives at once), and the columns of a block's cells.
PIECE, DATA = 1 << 19, ["kind", "own", "inner", "at", "cells"]


def worthwhile(node, sizes: dict[str, int], ring: Semiring) -> bool:
    """Whether a pair of the contraction tree is dense enough, by its estimated number of cells."""
    inner = node.joined - node.letters
    letters = node.left.letters | node.right.letters
    products = node.left.rows * node.right.rows / max(1, prod(sizes[x] for x in node.joined))
    work = float(prod(sizes[x] for x in letters))
    return bool(inner) and letters - inner == node.letters and ring.plain and ring.type in ("bigint", "double") and products >= LEAST and work <= WORTH * products and work < 2**62


def _number(letters: list[str], sizes: dict[str, int]):
    return scalars.linear_index([F.col(c) for c in letters], tuple(sizes[c] for c in letters))


def _widths(size: int) -> list[int]:
    """Multiples of SIDE, each up to an eighth more than the last, that a block of so many places may span."""
    most = min(WIDER * SIDE, -(-size // SIDE))
    return sorted({x << k for k in range(most.bit_length()) for x in range(1, 16) if x << k < most} | {most})


def rows_held(df: DataFrame, batch: list[str], own: list[str], sizes: dict[str, int]) -> tuple[int, int, dict[int, int]]:
    """Numbers of rows that have cells and of batches that have, and by width the most such rows of a batch in that many times SIDE places."""
    rows = df.select(_number(batch, sizes).alias("g"), _number(own, sizes).alias("r")).distinct()
    full = rows.groupBy("g", F.expr(f"r div {SIDE}").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    widths = F.explode(F.array(*(F.lit(x).cast("bigint") for x in _widths(prod(sizes[x] for x in own)))))
    wider = full.select("g", "block", "n", widths.alias("width")).groupBy("g", "width", F.expr("block div width").alias("block")).agg(F.sum("n").alias("n"))
    by = wider.groupBy("g", "width").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    found = by.groupBy("width").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.max("m").alias("m")).collect()
    return (found[0].n, found[0].g, {x.width: x.m for x in found}) if found else (0, 0, {1: 0})


def spans(a: DataFrame, b: DataFrame, batch: list[str], rows: list[str], columns: list[str], sizes: dict[str, int], tasks: int) -> tuple[int, int, int]:
    """Places that a row block and a column block span, and inner places of both: more rows to a block while that leaves a pair for every task."""
    pairs = prod(sizes[x] for x in batch) * prod(-(-prod(sizes[x] for x in own) // SIDE) for own in (rows, columns))
    if pairs <= 4 * tasks:  # for fewer the counts do not pay
        return SIDE, SIDE, INNER
    (n, g, full), (m, h, fuller) = (rows_held(x, batch, own, sizes) for x, own in ((a, rows), (b, columns)))
    wide = 1
    while wide < WIDER and n * m >= 4 * tasks * max(1, min(g, h)) * (wide * SIDE) ** 2:
        wide *= 2
    return (*(SIDE * max(w for w, held in x.items() if held <= wide * SIDE) for x in (full, fuller)), max(1, INNER // wide))


def _wanted(df: DataFrame, batch: list[str], own: list[str], inner: list[str], sizes: dict[str, int], kind: str) -> DataFrame:
    """g (if there is a batch), r (row), c (inner place) and v of the cells that can meet another."""
    names = ["g"] * bool(batch) + ["c", "v"]
    cells = df.select(*(_number(batch, sizes).alias(c) for c in names if c == "g"), _number(own, sizes).alias("r"), _number(inner, sizes).alias("c"), F.col("v").cast(kind).alias("v"))
    return cells.filter(" and ".join(f"{c} is not null" for c in names))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold all of them; other values as they are."""
    if len(x) and x.dtype == np.int64:
        for kind in (np.int8, np.int16, np.int32):
            if np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
                return x.astype(kind)
    return x


def gathered(batches: Iterator[pa.RecordBatch], span: int, deep: int, piece: int) -> Iterator[pa.RecordBatch]:
    """The cells of a task by g, block and k (the inner block), side by side in few bytes: a row for each of these and ``piece`` cells."""
    held, n = [], 0

    def packed() -> pa.RecordBatch:
        *g, r, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
        keys = [*g, r // span, c // deep]
        order = np.lexsort(keys[::-1])
        keys = [x[order] for x in keys]
        starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
        r, c, v = (_narrow(x[order]) for x in (r % span, c % deep, v))
        cells = np.empty(len(order), [("r", r.dtype), ("c", c.dtype), ("v", v.dtype)])
        cells["r"], cells["c"], cells["v"] = r, c, v
        ends = (np.append(starts, len(order)) * cells.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())])
        kinds = pa.array([" ".join(x.dtype.str for x in (r, c, v))] * len(starts))
        return pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in keys), kinds, data], [*["g"] * len(g), "block", "k", "kinds", "cells"])

    for batch in batches:
        if batch.column(batch.num_columns - 3).null_count:
            raise ValueError("a cell without an index")
        if batch.num_rows:
            held.append([x.to_numpy() for x in batch.columns])
            n += batch.num_rows
        if n >= piece:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def merged(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each block of the sorted pieces: its rows, inner places and values, all between them or (where these take more) those ``at`` some places."""
    now, held, ready, size = None, [], [], 0

    def block() -> tuple:
        r, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
        (own, i), (inner, j), v = _places(r, int(r.max()) + 1), _places(c, int(c.max()) + 1), _narrow(v)
        at = i * len(inner) + j
        if len(own) * len(inner) * v.itemsize <= len(v) * (4 + v.itemsize):
            full = np.zeros(len(own) * len(inner), v.dtype)
            full[at] = v
            at, v = at[:0], full
        return (*now, v.dtype.str, *(x.tobytes() for x in (own.astype(np.uint32), inner.astype(np.uint32), at.astype(np.uint32), v)))

    def given() -> pa.RecordBatch:
        kinds = [pa.int64()] * len(names) + [pa.string()] + [pa.binary()] * (len(DATA) - 1)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*ready, strict=True), kinds, strict=True)], [*names, *DATA])

    for batch in batches:
        *keys, kinds, pieces = batch.columns
        for key, kind, piece in zip(zip(*(x.to_pylist() for x in keys), strict=True), kinds.to_pylist(), pieces, strict=True):
            if key != now:
                if held:
                    ready.append(block())
                    size += sum(map(len, ready[-1][-4:]))
                if size >= PIECE or len(ready) >= 1000:
                    yield given()
                    ready, size = [], 0
                now, held = key, []
            cells = np.frombuffer(piece.as_buffer(), [(n, x) for n, x in zip("rcv", kind.split(), strict=True)])
            held.append([cells["r"].astype(np.int64), cells["c"].astype(np.int64), cells["v"].astype(np.float64 if cells["v"].dtype.kind == "f" else np.int64)])
    if held:
        ready.append(block())
        yield given()


def blocks(cells: DataFrame, g: list[str], span: int, deep: int, tasks: int) -> DataFrame:
    """g, block, k (the inner block) and the block's cells. Cells are packed before they are sent, as a row of a table takes many times their bytes."""
    keys, piece = [*g, "block", "k"], PIECE
    kinds = ", ".join(f"{c} bigint" for c in keys)
    sent = cells.mapInArrow(lambda batches: gathered(batches, span, deep, piece), f"{kinds}, kinds string, cells binary")
    held = sent.repartition(tasks, *keys).sortWithinPartitions(*keys)
    return held.mapInArrow(lambda batches: merged(batches, keys), f"{kinds}, kind string, own binary, inner binary, at binary, cells binary")


def paired(left: DataFrame, right: DataFrame, g: list[str], data: list[str], tasks: int, grid: tuple[int, int], held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Columns g, i, j (the blocks that meet), k, side and data, sorted so that each pair's blocks come by k, left before right.

    With batch columns g a block goes to the blocks that its batch holds on the other side (``held``, if these are
    at hand, has the g and block of both sides); without, to all of the ``grid``.
    """
    if g:
        there, here = (x.select(*g, "block").distinct() for x in held or (left, right))
        a = left.join(here.withColumnRenamed("block", "j"), g)
        b = right.join(there.withColumnRenamed("block", "i"), g)
        place = ((F.pmod(F.xxhash64(*g), F.lit(tasks)) + F.col("i") * grid[1] + F.col("j")) % tasks).cast("int")  # a batch's pairs go to different tasks
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        a, b = left.withColumn("j", every(grid[1])), right.withColumn("i", every(grid[0]))
        place = F.pmod(F.col("i") * grid[1] + F.col("j"), F.lit(tasks)).cast("int")
    a = a.select(*g, F.col("block").alias("i"), "j", "k", F.lit(0).alias("side"), *data)
    b = b.select(*g, "i", F.col("block").alias("j"), "k", F.lit(1).alias("side"), *data)
    return a.unionByName(b).repartitionById(tasks, place).sortWithinPartitions(*g, "i", "j", "k", "side")


def streamed(batches: Iterator[pa.RecordBatch], keys: int, read: Callable, add: Callable, done: Callable) -> Iterator[pa.RecordBatch]:
    """Runs over the sorted rows: ``read`` turns the rows of a block into a matrix, ``add`` takes a pair of them, ``done`` gives a pair's result."""
    now, k, left, right = None, None, [], []

    def flush() -> None:
        if left and right:
            add(read(left), read(right))
        left.clear()
        right.clear()

    for batch in batches:
        heads = list(zip(*(batch.column(c).to_pylist() for c in range(keys + 2)), strict=True))
        for row, head in enumerate(heads):
            key, side = head[:keys], head[keys + 1]
            if key != now or head[keys] != k:
                flush()
                k = head[keys]
            if key != now:
                if now is not None:
                    yield from done(now)
                now = key
            (right if side else left).append((batch, row))
    flush()
    if now is not None:
        yield from done(now)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers held as int64: in floating point while sums stay below 2**53, else exactly; an overflow is an error."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    x, y = a.astype(np.float64), b.astype(np.float64)
    about = x @ y.T
    if most < EXACT:
        return about.astype(np.int64)
    if np.abs(about).max(initial=0) >= 2.0**62:
        out = a.astype(object) @ b.astype(object).T
        if max(map(abs, out.reshape(-1).tolist()), default=0) >= 2**63:
            raise OverflowError("a sum of products exceeds 64 bits")
        return out.astype(np.int64)
    return a @ b.T  # modulo 2**64, and known to fit


def float_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T where absent cells (0) take no part, whatever they meet."""
    if np.isfinite(a).all() and np.isfinite(b).all():
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(a.shape[1]):
            i, j = np.flatnonzero(a[:, k]), np.flatnonzero(b[:, k])
            out[np.ix_(i, j)] += np.outer(a[i, k], b[j, k])
    return out


def _places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers below n of x, sorted, and for each of x its place among them."""
    held = np.zeros(n, bool)
    held[x] = True
    return np.flatnonzero(held), (np.cumsum(held) - 1)[x]


def _matrix(rows: list[tuple[pa.RecordBatch, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, inner places and the values between them of a block (one row of the table)."""
    (batch, row), = rows
    kind, *data = (batch.column(c)[row] for c in range(batch.num_columns - len(DATA), batch.num_columns))
    own, inner, at, v = (np.frombuffer(x.as_buffer(), t) for x, t in zip(data, (np.uint32, np.uint32, np.uint32, kind.as_py()), strict=True))
    wide = v.astype(np.float64 if v.dtype.kind == "f" else np.int64)
    if len(at):
        out = np.zeros(len(own) * len(inner), wide.dtype)
        out[at] = wide
        wide = out
    return own.astype(np.int64), inner.astype(np.int64), wide.reshape(len(own), len(inner))


class _Sum:
    """A block of the result: the rows and columns that have occurred, and the sums between them."""

    def __init__(self) -> None:
        self.rows = None

    def add(self, rows: np.ndarray, columns: np.ndarray, more: np.ndarray) -> None:
        if self.rows is None:
            self.rows, self.columns, self.v = rows, columns, more
            return
        every, across = np.union1d(self.rows, rows), np.union1d(self.columns, columns)
        if len(every) > len(self.rows) or len(across) > len(self.columns):
            wider = np.zeros((len(every), len(across)), self.v.dtype)
            wider[np.ix_(np.searchsorted(every, self.rows), np.searchsorted(across, self.columns))] = self.v
            self.rows, self.columns, self.v = every, across, wider
        at = np.ix_(np.searchsorted(every, rows), np.searchsorted(across, columns))
        before = self.v[at]
        after = before + more
        if self.v.dtype == np.int64 and ((before > 0) & (more > 0) & (after < 0) | (before < 0) & (more < 0) & (after >= 0)).any():
            raise OverflowError("a sum of products exceeds 64 bits")
        self.v[at] = after

    def given(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, columns and values that are not zero, some rows at a time."""
        if self.rows is None:
            return
        step = max(1, GIVEN // max(1, len(self.columns)))
        for first in range(0, len(self.rows), step):
            part = self.v[first : first + step]
            i, j = np.nonzero(part)
            yield self.rows[first + i], self.columns[j], part[i, j]


def contract(a: DataFrame, la: frozenset[str], b: DataFrame, lb: frozenset[str], keep: frozenset[str], sizes: dict[str, int], ring: Semiring) -> DataFrame:
    """The sum over the letters that both have and nobody keeps: the kept letters and v."""
    batch, inner = sorted(la & lb & keep), sorted((la & lb) - keep)
    g = ["g"] if batch else []
    rows, columns = sorted(la - lb), sorted(lb - la)
    tasks = 4 * partitions(a.sparkSession)
    high, wide, deep = spans(a, b, batch, rows, columns, sizes, tasks)
    cells = [_wanted(x, batch, own, inner, sizes, ring.type) for x, own in ((a, rows), (b, columns))]
    left, right = (blocks(x, g, span, deep, partitions(a.sparkSession)) for x, span in zip(cells, (high, wide), strict=True))
    held = tuple(x.select(*g, F.expr(f"r div {span}").alias("block")) for x, span in zip(cells, (high, wide), strict=True))
    multiply = exact_product if ring.type == "bigint" else float_product

    def run(batches):
        held = _Sum()

        def add(x, y) -> None:
            _, i, j = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
            if len(i):
                held.add(x[0], y[0], multiply(x[2][:, i], y[2][:, j]))

        def done(key):
            nonlocal held
            *own, i, j = key
            for r, c, v in held.given():
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(v), x, np.int64)) for x in own), pa.array(r + i * high), pa.array(c + j * wide), pa.array(v)], [*g, "r", "c", "v"])
            held = _Sum()

        yield from streamed(batches, len(g) + 2, _matrix, add, done)

    grid = tuple(-(-prod(sizes[x] for x in letters) // span) for letters, span in ((rows, high), (columns, wide)))
    sent = paired(left, right, g, DATA, tasks, grid, held)
    found = sent.mapInArrow(run, "".join(f"{c} bigint, " for c in g) + f"r bigint, c bigint, v {ring.type}")
    out = []
    for column, letters in (("g", batch), ("r", rows), ("c", columns)):
        shape = tuple(sizes[x] for x in letters)
        out += [p.cast("bigint").alias(x) for p, x in zip(scalars.coordinates(F.col(column), shape), letters, strict=True)]
    return found.select(*out, "v")
