"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words, lower case (a shorter text is one
shingle). Their weight is tf * idf with idf = 1 + log(1 + N / df) / log(1 + N), between 1 and 2 for
any number N of documents, so that passages of a large group of copies still count. df, the documents that
hold a shingle, is counted by its 48-bit hash over all documents: groups of documents ask for the counts
of their shingles, each part of the hash's range counts what all groups ask, and answers them. BANDS x
ROWS consistent weighted samples (Ioffe 2010) make a document's band keys; two
documents agree in one sample with probability equal to their weighted Jaccard similarity.

The rows are first written as a table; its files never change, so a group is a stretch of a file, whichever task reads
it. Exact copies (equal words, by 128 bits) form a class first, numbered as a node; the class's text is that of
its first row by (doc_id, hash of the text). Nodes that share a band key form a piece. Similarities are exact,
and a piece is not turned into pairs of rows:

* first every member is compared with the piece's leader (the member of least hash);
* a piece that then holds several components is cut into blocks of about BLOCK members, those of its
  largest component apart from the others. The shingles of each block are written once. Every pair of blocks, but for two
  of the largest component, is read from there: a product of their weight matrices gives all similarities, and
  what is passed on is a spanning forest of the links.

Texts are compared where a piece's leader or block is, and come there straight from the files: what is sent ahead are places of rows.
A leader's members are dealt to as many tasks as they need. So no pair that shares a band key is left out unless both documents are already in one class.

Result: one row per row of the input with class_id, the least doc_id of its class, text_hash, class_hash (the hash of the
text of the class's first row, which tells classes apart where several texts have one doc_id) and kept
(whether the row's doc_id and text are those of the first row; repeated rows of it are all marked).
Classes rest on the texts alone: rows of one doc_id and different texts are compared like any others. Null, empty
and blank texts are no copies of each other: each is its own class. Rows with a null doc_id have a null
class and are kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import least_members
from .common import bytes_of, discard, few, file_groups, files_of, lean, opened, partitions, row_slices, written, written_small
from .textwords import U, grams, mix, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
BLOCK = 256
#: Bytes of text that one step works on, and of a group of documents that asks for the counts of its shingles.
SLICE, GROUP = 2_000_000, 4_000_000
#: Bytes of the written table for each part of the counts.
PART = 16_000_000
#: Blocks of one row that a task compares with another, and blocks it holds.
ACROSS, HELD = 32, 4
#: Members that are compared with their leader in one task.
MEMBERS = 512
_KEPT = 48  # bits of a shingle's hash


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text number, hash, times; and two hashes of each text's word sequence (0: no words)."""
    hashes, counts = words_of([t.lower() for t in texts])
    firsts = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    five = grams(hashes, WORDS)
    whole = np.arange(len(five)) + WORDS <= (firsts + counts)[doc[: len(five)]]
    parts, owner = [five[whole]], [doc[: len(five)][whole]]
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts.append(grams(hashes, n, n)[firsts[short]])
            owner.append(short)
    owner, sh = np.concatenate(owner), np.concatenate(parts)
    digests = []
    place = (np.arange(len(hashes)) - firsts[doc]).astype(np.uint64)
    for seed in (3, 5):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place + U(seed << 40))), dtype=np.uint64)])
        digests.append(mix(total[firsts + counts] - total[firsts] + counts.astype(np.uint64)) * (counts > 0).astype(np.uint64))
    key = np.sort((owner.astype(np.uint64) << U(_KEPT)) | (sh >> U(64 - _KEPT)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(_KEPT)).astype(np.int64), key & U((1 << _KEPT) - 1), times, *digests


_gamma: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms, at 2**16 even steps."""
    if not _gamma:
        x = np.linspace(0, 40, 4_000_001)
        r = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)
        _gamma.extend([r.astype(np.float32), np.log(r).astype(np.float32)])
    return _gamma[0], _gamma[1]


def samples(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k consistent weighted samples; rows of documents without shingles are 0. `doc` ascends."""
    out = np.zeros((n_docs, k), np.uint64)
    if not len(doc):
        return out
    gamma, log_gamma = _tables()
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(head, len(doc)))
    log_w = np.log(weight).astype(np.float32)
    for j in range(k):
        x = mix(sh + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = gamma[(x & U(65535)).astype(np.int64)]
        beta = (x >> U(32)).astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_w / r + beta)
        a = log_gamma[((x >> U(16)) & U(65535)).astype(np.int64)] - r * (t - beta + 1)
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, head), sizes))
        first = at[np.searchsorted(at, head)]
        out[doc[head], j] = mix(sh[first] + mix(t[first].astype(np.int64).astype(np.uint64) + U(j)))
    return out


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold each, after the number of these."""
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _hashes(sh: np.ndarray) -> bytes:
    return sh.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEPT // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // _KEPT, 8), np.uint8)
    out[:, : _KEPT // 8] = np.frombuffer(data, np.uint8).reshape(len(out), _KEPT // 8)
    return out.reshape(-1).view("<u8")


def document_frequencies(files: list[str], numbers: DataFrame, parts: int, tasks: int) -> DataFrame:
    """file, group, part, data: how many documents hold each distinct shingle of a group, by hash. ``numbers``: those of the files."""

    def ask(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for group, (_, _, texts) in enumerate(file_groups(files[file], "text", GROUP, ["text"])):
                    sh, counts = np.unique(shingles(texts)[1], return_counts=True)
                    cut = np.searchsorted((sh * U(parts)) >> U(_KEPT), np.arange(parts + 1))
                    some = [p for p in range(parts) if p == 0 or cut[p] < cut[p + 1]]
                    columns = [
                        pa.array(some, pa.int32()),
                        pa.array([file] * len(some), pa.int32()),
                        pa.array([group] * len(some), pa.int32()),
                        pa.array([_hashes(sh[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                        pa.array([narrow(counts[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "file", "group", "data", "counts"])

    def answer(batches):
        keys, asks, counts = [], [], []
        for batch in batches:
            for part, file, group, data, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append((file, group, part))
                asks.append(_unpacked(data))
                counts.append(wide(count))
        if not keys:
            return
        ends = np.cumsum([len(x) for x in asks])
        _, place = np.unique(np.concatenate(asks), return_inverse=True)
        asks.clear()
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)  # exact below 2**53
        for a in range(0, len(keys), 256):
            some = range(a, min(a + 256, len(keys)))
            data = [narrow(total[place[ends[i - 1] if i else 0 : ends[i]]]) for i in some]
            columns = zip(*keys[a : a + 256], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(data, pa.binary())], ["file", "group", "part", "data"])

    asks = numbers.mapInArrow(lean(ask), "part int, file int, group int, data binary, counts binary").repartitionById(parts, "part")
    return asks.mapInArrow(lean(answer), "file int, group int, part int, data binary").repartitionById(tasks, F.col("file") % tasks).sortWithinPartitions("file", "group", "part")


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log1p(max(n, 1) / np.maximum(df, 1)) / np.log1p(max(n, 1))


class Weights:
    """The weight of a shingle from its times and a table of document frequencies."""

    def __init__(self, table: np.ndarray, n: int):
        self.idf = idf(table, n)

    def __call__(self, sh: np.ndarray, times: np.ndarray, texts: list[str] | None = None) -> np.ndarray:
        return times * self.idf[(sh % U(len(self.idf))).astype(np.int64)]


class Counted:
    """The same from the document frequencies of each text's shingles."""

    def __init__(self, n: int, texts: list[str], frequencies: list[bytes]):
        self.n, self.held = n, dict(zip(texts, frequencies, strict=True))

    def __call__(self, sh: np.ndarray, times: np.ndarray, texts: list[str]) -> np.ndarray:
        return times * idf(np.concatenate([wide(self.held[t]) for t in texts]), self.n)


def weighted_sets(texts: list[str], weights: Weights | Counted) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text its shingles in order, their weights and their times."""
    sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, first = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SLICE or i == len(texts) - 1:
            doc, sh, times, _, _ = shingles(texts[first : i + 1])
            w = weights(sh, times, texts[first : i + 1])
            cut = np.searchsorted(doc, np.arange(i + 2 - first))
            sets += [(sh[x:y], w[x:y], times[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
            held, first = 0, i + 1
    return sets


def similarities(left: list[str], right: list[str], weights: Weights | Counted) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(t, len(number)) for t in side]) for side in (left, right))
    sets = weighted_sets(list(number), weights)
    out = np.zeros(len(a))
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        (x, wx, _), (y, wy, _) = sets[i], sets[j]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = y[at] == x
            both = np.minimum(wx[same], wy[at[same]]).sum()
            out[k] = both / (wx.sum() + wy.sum() - both)
    return out


def all_similarities(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of every two sets.

    A shingle that occurs k times counts as k columns, so a product of 0/1 matrices with the
    columns' weights sums the smaller of two weights.
    """
    total = np.array([w.sum() for _, w, _ in sets])
    doc = np.repeat(np.arange(len(sets)), [int(n.sum()) for _, _, n in sets])
    times = np.concatenate([n for _, _, n in sets])
    sh = np.repeat(np.concatenate([s for s, _, _ in sets]), times)
    w = np.repeat(np.concatenate([x for _, x, _ in sets]) / times, times)
    level = np.arange(len(sh)) - np.repeat(np.cumsum(times) - times, times)
    _, column, count = np.unique(mix(sh + mix(level.astype(np.uint64))), return_inverse=True, return_counts=True)
    used = count[column] > 1  # others are in no intersection
    _, column = np.unique(column[used], return_inverse=True)
    doc, w = doc[used], w[used]
    order = np.argsort(column, kind="stable")
    doc, w, column = doc[order], w[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for a in range(0, int(column.max(initial=-1)) + 1, columns):
        own = slice(*np.searchsorted(column, [a, a + columns]))
        x = np.zeros((len(sets), columns))
        x[doc[own], column[own] - a] = np.sqrt(w[own])
        both += x @ x.T
    return both / np.maximum(total[:, None] + total[None, :] - both, 1e-300)


def forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what the matrix joins."""
    todo = set(range(len(near)))
    while todo:
        queue = [todo.pop()]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(near[i]).tolist():
                if j in todo:
                    todo.remove(j)
                    queue.append(j)
                    yield i, j


def _components(links: DataFrame) -> DataFrame:
    return least_members(links).withColumnRenamed("least", "component")


def signatures(held: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (the text's hash), two hashes of the word sequence (0: no words), band keys, df of the shingles in order, file and row; ``held`` is a written table (doc_id, text, h)."""
    spark, files = held.sparkSession, files_of(held)
    parts = max(partitions(spark), -(-bytes_of(held) // PART))
    tasks = max(1, min(len(files), 4 * parts))
    numbers = spark.range(0, len(files), 1, tasks)

    def sign(batches):
        now, told = None, []
        for batch in batches:
            for file, group, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if file != now:
                    yield from signed(now, told)
                    now, told = file, []
                while len(told) <= group:
                    told.append([])
                told[group].append(wide(data))
        yield from signed(now, told)

    def signed(file: int | None, told: list[list[np.ndarray]]):
        if file is None:
            return
        for group, (row, part, texts) in enumerate(file_groups(files[file], "text", GROUP, ["doc_id", "h", "text"])):
            doc, sh, times, d1, d2 = shingles(texts)
            known, counts = np.unique(sh), np.concatenate(told[group])
            if len(known) != len(counts):
                raise ValueError(f"{len(counts)} counts for {len(known)} shingles")
            df = counts[np.searchsorted(known, sh)]
            got = samples(doc, sh, times * idf(df, n), len(d1), bands * rows)
            keys = np.zeros((len(d1), bands), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    keys[:, b] = mix(keys[:, b] + got[:, b * rows + r] + U(b + 1))
            offsets = pa.array(np.arange(0, (len(d1) + 1) * bands, bands, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
            cut = np.searchsorted(doc, np.arange(len(d1) + 1))
            own = pa.array([narrow(df[x:y]) for x, y in zip(cut, cut[1:], strict=False)], pa.binary())
            at = [pa.array(np.full(len(d1), file, np.int32)), pa.array(np.arange(row, row + len(d1), dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, own, *at], ["doc_id", "h", "d1", "d2", "bands", "df", "file", "row"])

    schema = "doc_id long, h long, d1 long, d2 long, bands array<long>, df binary, file int, row long"
    if not files:
        return spark.createDataFrame([], schema)
    return document_frequencies(files, numbers, parts, tasks).mapInArrow(lean(sign), schema)


def with_texts(rows: DataFrame, files: list[str]) -> DataFrame:
    """``rows`` (file, row, ...) with text: sent to where the files are read, one task for all rows of a file."""
    spark = rows.sparkSession
    tasks = max(1, min(len(files), 4 * partitions(spark)))
    names = rows.columns
    file_at, row_at = names.index("file"), names.index("row")

    def read(batches):
        now, held = None, []
        for batch in batches:
            number = batch.column(file_at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if number[a] != now:
                    yield from found(now, held)
                    now, held = number[a], []
                held.append(batch.slice(a, b - a))
        yield from found(now, held)

    def found(file, held):
        if file is None:
            return
        wanted = pa.Table.from_batches(held).combine_chunks().to_batches()[0]  # sorted by row; places and df, no texts
        rows = wanted.column(row_at).to_numpy()
        for first, part, _ in file_groups(files[file], "text", SLICE, ["text"]):
            a, b = np.searchsorted(rows, [first, first + part.num_rows])
            if a < b:
                texts = part.column(0).take(pa.array(rows[a:b] - first))
                yield pa.RecordBatch.from_arrays([*wanted.slice(a, b - a).columns, texts], [*names, "text"])

    sent = rows.repartitionById(tasks, F.col("file") % tasks).sortWithinPartitions("file", "row")
    return sent.mapInArrow(lean(read), rows.withColumn("text", F.lit("")).schema)


def verified(pairs: DataFrame, located: DataFrame, files: list[str], n: int, least: float) -> DataFrame:
    """Of the pairs (u, v) those whose texts are similar enough; ``located``: node, file, row, df."""
    spark = pairs.sparkSession
    crowds = written_small(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")), "near-crowds")
    members = pairs.join(crowds, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    heads = crowds.select(F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    rows = members.unionByName(heads).join(located, "node").select("v", "part", "kind", "node", "df", "file", "row")
    dealt = with_texts(rows, files).select("v", "part", "kind", "node", "df", "text").repartition(partitions(spark), "v", "part").sortWithinPartitions("v", "part", "kind")

    def compare(batches):
        head = None
        for batch in (part for x in batches for part in row_slices(x, "text")):
            v, kind, node, df, text = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            left, right, p, q, at = [], [], [], [], []
            for k in range(len(v)):
                if kind[k] == 0:
                    head = text[k], df[k]
                else:
                    left.append(text[k])
                    p.append(df[k])
                    right.append(head[0])
                    q.append(head[1])
                    at.append(k)
            if at:
                near = np.flatnonzero(similarities(left, right, Counted(n, left + right, p + q)) >= least)
                yield pa.RecordBatch.from_arrays([pa.array([node[at[k]] for k in near], pa.int64()), pa.array([v[at[k]] for k in near], pa.int64())], ["u", "v"])

    return written(dealt.mapInArrow(lean(compare), "u long, v long").repartition(few(spark)), "near-links")


class Blocks:
    """Blocks (nodes and their weighted sets) by piece and number, read from a written table of a file for each part."""

    def __init__(self, files: dict[int, str], n: int):
        self.files, self.n = files, n
        self.open: OrderedDict[int, tuple] = OrderedDict()
        self.held: OrderedDict[tuple[int, int], tuple] = OrderedDict()

    def _file(self, part: int) -> tuple[pq.ParquetFile, dict[tuple[int, int], int], np.ndarray]:
        if part not in self.open:
            if len(self.open) >= 8:
                self.open.popitem(last=False)
            fs, path = opened(self.files[part])
            source = pq.ParquetFile(fs.open_input_file(path))
            keys = source.read(columns=["piece", "block"])
            ends = np.cumsum([source.metadata.row_group(g).num_rows for g in range(source.num_row_groups)])
            self.open[part] = source, {k: i for i, k in enumerate(zip(keys["piece"].to_pylist(), keys["block"].to_pylist(), strict=True))}, ends
        return self.open[part]

    def __call__(self, part: int, piece: int, block: int) -> tuple[np.ndarray, list] | None:
        """None for a block without members."""
        key = piece, block
        if key not in self.held:
            found = None
            if part in self.files:
                source, at, ends = self._file(part)
                if key in at:
                    g = int(np.searchsorted(ends, at[key], "right"))
                    rows = source.read_row_group(g, columns=["nodes", "sets"])
                    i = at[key] - (int(ends[g - 1]) if g else 0)
                    found = np.frombuffer(rows["nodes"][i].as_py(), "<i8"), unpacked_sets(rows["sets"][i].as_py(), self.n)
            if len(self.held) >= HELD:
                self.held.popitem(last=False)
            self.held[key] = found
        self.held.move_to_end(key)
        return self.held[key]


def packed_sets(texts: list[str], df: list[bytes]) -> bytes:
    """The shingles of some texts: hashes, times and document frequencies, in few bytes."""
    out = []
    for sh, _, times in weighted_sets(texts, lambda sh, times, _: times):
        out += [_hashes(sh), narrow(times)]
    parts = [x for i, d in enumerate(df) for x in (out[2 * i], out[2 * i + 1], d)]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpacked_sets(data: bytes, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The weighted sets; ``n``: number of documents."""
    count = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (count + 1) + np.cumsum([0, *np.frombuffer(data, "<u4", count, 4).tolist()])
    parts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    out = []
    for sh, times, df in zip(parts[0::3], parts[1::3], parts[2::3], strict=True):
        k = wide(times)
        out.append((_unpacked(sh), k * idf(wide(df), n), k))
    return out


def in_blocks(own: DataFrame, located: DataFrame, texts: list[str], n_docs: int, least: float) -> DataFrame:
    """Links (a spanning forest of each block pair) within the pieces that hold several components."""
    spark = own.sparkSession
    sizes = own.groupBy("piece", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    open_ = sizes.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
    open_ = open_.filter("n > most and n > 2")  # of two members, both have met as leader and member
    open_ = open_.groupBy("n", "h", "most", "main").agg(F.min("piece").alias("piece"))  # bands often give the same piece
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = written_small(open_.select("piece", "main", count(F.col("most")).alias("a"), count(F.col("n") - F.col("most")).alias("b")), "near-open")
    main = F.col("component") == F.col("main")
    block = F.when(main, F.pmod(F.xxhash64("node"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("node"), F.col("b"))).cast("int")
    parts = partitions(spark)
    part = lambda block: F.pmod(F.xxhash64("piece", block), F.lit(parts)).cast("int")
    rows = own.join(open_, "piece").select("piece", "node", block.alias("block")).join(located, "node")
    rows = with_texts(rows.select("piece", "block", "node", "df", "file", "row"), texts)
    rows = rows.select("piece", "block", "node", "text", "df", part("block").alias("part")).repartitionById(parts, "part").sortWithinPartitions("piece", "block", "node")

    def gather(batches):
        now, nodes, held, df = None, [], [], []
        for batch in (part for x in batches for part in row_slices(x, "text")):
            for piece, block, node, text, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (piece, block) != now:
                    if nodes:
                        yield gathered(now, nodes, held, df)
                    now, nodes, held, df = (piece, block), [], [], []
                nodes.append(node)
                held.append(text)
                df.append(own)
        if nodes:
            yield gathered(now, nodes, held, df)

    def gathered(key, nodes, held, df) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([np.array(nodes, "<i8").tobytes()], pa.binary()), pa.array([packed_sets(held, df)], pa.binary())], ["piece", "block", "nodes", "sets"])

    table = written(rows.mapInArrow(lean(gather), "piece long, block int, nodes binary, sets binary"), "near-blocks", **{"parquet.block.row.count.limit": "4"})
    files = {int(re.search(r"part-([0-9]+)", f.rpartition("/")[2])[1]): f for f in files_of(table)}

    def solve(batches):
        blocks = Blocks(files, n_docs)
        for batch in batches:
            for piece, x, y, at_x, at_y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = blocks(at_y, piece, y)
                p = q if x == y else blocks(at_x, piece, x)
                if p is None or q is None:
                    continue
                nodes, sets = q if x == y else (np.concatenate([p[0], q[0]]), p[1] + q[1])
                links = np.array(list(forest(all_similarities(sets) >= least)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[links[:, 0]]), pa.array(nodes[links[:, 1]])], ["u", "v"])

    pairs = open_.select("piece", F.explode(F.sequence("a", F.col("a") + F.col("b") - 1)).alias("y")).select("piece", "y", F.explode(F.sequence(F.lit(0), "y")).alias("x"))
    dealt = pairs.repartition(parts, "piece", "y", F.floor(F.col("x") / ACROSS)).sortWithinPartitions("piece", "y", "x")
    found = written(dealt.select("piece", "x", "y", part("x").alias("at_x"), part("y").alias("at_y")).mapInArrow(lean(solve), "u long, v long").repartition(few(spark)), "near-links")
    discard(spark, table)
    return found


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, kept, text_hash, class_hash: one row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = written(docs.withColumn("h", F.xxhash64("text")), "near-rows", **{"parquet.block.size": str(4 * GROUP)})
    n = held.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()
    signed = written(signatures(held, n, bands, rows), "near-signatures")
    fine = signed.filter("doc_id is not null and d1 <> 0")
    files = files_of(held)
    classes = fine.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h", "file", "row")).alias("head"), F.first("bands").alias("bands"))
    classes = written_small(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "head", "bands"), "near-classes")
    members = classes.select(F.explode("bands").alias("piece"), "node").distinct()
    leaders = members.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("first")).filter("n > 1")
    leaders = written_small(leaders.select("piece", F.col("first.node").alias("leader")), "near-leaders")
    pieces = written_small(members.join(leaders, "piece"), "near-pieces")
    needed = pieces.select("node").distinct().join(classes.select("node", "head.file", "head.row"), "node")
    located = written_small(needed.join(fine.select("file", "row", "df"), ["file", "row"]).select("node", "file", "row", "df"), "near-located")
    pairs = pieces.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    links = verified(pairs, located, files, n, least)
    named = written_small(_components(links), "near-components")
    own = pieces.join(named, "node", "left")
    own = written_small(own.select("piece", "node", F.coalesce("component", "node").alias("component")), "near-own")
    more = in_blocks(own, located, files, n, least)
    links = named.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
    named = written_small(_components(links), "near-components")
    discard(spark, held, own, pieces, leaders, located)
    # the first row of each class of several nodes
    grouped = named.union(named.select(F.col("component").alias("node"), "component").distinct())
    grouped = written_small(grouped.join(classes.select("node", "head"), "node"), "near-groups")
    first = grouped.groupBy("component").agg(F.min("head").alias("first"))
    first = grouped.join(first, "component").select("node", "first")
    result = classes.select("node", "d1", "d2", "head").join(first, "node", "left").select("d1", "d2", F.coalesce("first", "head").alias("first"))
    result = written_small(result.select("d1", "d2", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("class_hash")), "near-results")
    yes = fine.select("doc_id", "h", "d1", "d2").join(result, ["d1", "d2"]).select("doc_id", "class_id", "h", "class_hash")
    no = signed.filter("doc_id is null or d1 = 0").select("doc_id", F.col("doc_id").alias("class_id"), "h", F.col("h").alias("class_hash"))
    kept = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("class_hash")), F.lit(True))
    return yes.union(no).select("doc_id", "class_id", kept.alias("kept"), F.col("h").alias("text_hash"), "class_hash")
