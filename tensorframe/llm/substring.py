"""Substring dedup: words in a passage of 20 that starts earlier somewhere else are removed.

A window is ``window`` consecutive words of one document; a window is repeated
if the same words also start earlier (smaller doc_id; then, among rows of one
doc_id, the row's place; then the start). All words of repeated windows go.

The rows are first written as a table. Its files never change, so from then on a row is a file and a place in it,
whichever task reads it and however often; a file's rows form groups of about GROUP bytes of text.

1. Census. Documents are cut into segments: runs of consecutive windows whose least GRAM-word hash (the anchor) is the
   same, at most 21 - GRAM windows. Equal windows have equal anchors, so all occurrences of a window lie in
   segments of one anchor. Each group sends its distinct anchors once, with the number of different segments;
   the answer says which anchors occur only once (nothing there can be repeated) and which are crowded.
2. Every group sends its segments of recurring anchors, as words, to the index shard of the anchor. Equal segments of a
   group are sent once, with the earliest place and a mark that there are more. Segments of a crowded
   anchor are cut where the set of the window's least hashes changes, more of these hashes the more crowded
   it is, and go to the shard of that set: so no anchor, however common, stays in one task.
3. An index shard builds a compressed full-text index (fm_index.py) of its different segments and streams each of
   them through it: matching statistics, carried along from right to left, give the windows that occur
   again, the index their earliest place. Intervals of windows that are not the earliest are reported;
   later copies of a whole segment are reported as one interval.
4. Each file is read again with all reports for its rows.

In a shard words are compared as they are, by a dictionary of the words themselves; hashes only decide what meets
where. A task holds one group, the answers for one file, or one shard, which is indexed in chunks of about
CHUNK words; the number of shards grows with the table.

Null texts have no words; null doc_ids come last in the order. Repeated rows count as documents
of their own. Texts shorter than a window lose nothing. Extra columns pass
through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bytes_of, file_groups, files_of, lean, partitions, written
from .fm_index import FMIndex
from .textwords import U, Words, encoded, grams, mix

WINDOW, GRAM = 20, 4
#: Bytes of text in a group, and of a row group in the table that is read.
GROUP, ROW_GROUP = 4_000_000, 16_000_000
#: Bytes of the written table for each shard, and words that are indexed together.
SHARD, CHUNK = 16_000_000, 400_000
#: An anchor with more different segments than this is crowded; for each further factor of STEP one more hash tells windows apart.
MANY, STEP = 128, 16
LAST = np.iinfo(np.int64).max

PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("file", "<u4"), ("row", "<u4"), ("start", "<u4"), ("n", "u1"), ("more", "u1")])
REPORT = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "u1"), ("copies", "u1")])


class Segments:
    """The segments of a group of documents; ``new`` marks the first of each set of equal ones, in the order ``order``."""

    def __init__(self, words: Words, docs: np.ndarray, window: int):
        hashes, counts = words.hashes(), words.counts
        self.window, self.firsts = window, np.cumsum(counts) - counts
        positions = window - GRAM + 1
        self.grams = grams(hashes, GRAM)
        n = len(hashes) - window + 1
        if n <= 0:
            self.at = self.n = self.row = self.order = self.start = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            self.twice = self.new = np.zeros(0, bool)
            return
        least, width = self.grams, 1  # sliding minimum, by doubling
        while width < positions:
            step = min(width, positions - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        row = np.repeat(np.arange(len(counts)), counts)[:n]
        valid = np.flatnonzero(np.arange(n) + window <= (self.firsts + counts)[row])
        anchor, row = least[valid], row[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        inside = np.arange(len(valid)) - np.repeat(head, np.diff(np.append(head, len(valid))))
        head = np.flatnonzero(inside % positions == 0)
        self.n = np.diff(np.append(head, len(valid)))
        self.at, self.row, self.anchor = valid[head], row[head], anchor[head]  # at: first word, in the group
        self.start = self.at - self.firsts[self.row]
        # whether the anchor occurs twice, so that the segment may hold equal windows itself
        reach = np.arange(2 * positions - 1)
        hits = self.grams[np.minimum(self.at[:, None] + reach, len(self.grams) - 1)] == self.anchor[:, None]
        self.twice = (hits & (reach < (self.n + positions - 1)[:, None])).sum(axis=1) > 1
        whole = grams(hashes, window, 1)
        content = mix(whole[self.at] * U(3) + mix(whole[self.at + self.n - 1] + self.n.astype(np.uint64)))
        self.order = np.lexsort((self.start, self.row, docs[self.row], content, self.anchor))
        a, b = self.order[:-1], self.order[1:]
        same = np.flatnonzero((self.anchor[a] == self.anchor[b]) & (content[a] == content[b]) & (self.n[a] == self.n[b]))
        self.new = np.ones(len(self.order), bool)
        if len(same):  # equal hashes; now the words
            ids, _ = words.ids()
            self.new[same + 1] = ~equal_stretches(ids, self.at[a[same]], self.at[b[same]], self.n[a[same]] + window - 1)


def equal_stretches(ids: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ids[x : x + size] equals ids[y : y + size], for each pair of places."""
    out = np.ones(len(x), bool)
    for k in range(int(sizes.max(initial=0))):
        at = np.minimum(k, sizes - 1)
        out &= ids[x + at] == ids[y + at]
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """0: the anchor occurs once; 1: it recurs; more: so many least hashes tell its windows apart."""
    crowded = 2 + np.floor(np.log(np.maximum(counts, MANY + 1) / max(MANY, 1)) / np.log(STEP)).astype(np.int64) if MANY else np.full(len(counts), 3)
    return np.where(counts < 2, 0, np.where(counts <= MANY, 1, np.minimum(crowded, 255))).astype(np.uint8)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key + U(99)) % U(parts)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def runs(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(target, places of it) for each target that occurs."""
    order = np.argsort(target, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(target[order], prepend=-1)), len(order))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(target[order[a]]), order[a:b]


def mark(n_words: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words covered by the given stretches."""
    steps = np.bincount(starts, minlength=n_words + 1) - np.bincount(np.minimum(starts + sizes, n_words), minlength=n_words + 1)
    return np.cumsum(steps)[:-1] > 0


def search(pieces: np.ndarray, texts: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows among the pieces of a shard (their words one after the other in ``texts``): files and reports."""
    n = pieces["n"].astype(np.int64)
    sizes = n + window - 1
    ids, alphabet = Words([texts]).ids()
    firsts = np.cumsum(sizes) - sizes
    # places of the windows in the corpus; windows of different pieces are different places
    order = np.lexsort((pieces["start"], pieces["row"], pieces["file"], pieces["doc"]))
    base = np.empty(len(n), np.int64)
    base[order] = np.cumsum(n[order]) - n[order]
    # equal pieces: the earliest stands for all
    places = np.arange(len(ids)) - np.repeat(firsts, sizes)
    content = np.add.reduceat(mix((ids << 8).astype(np.uint64) + places.astype(np.uint64)), firsts)
    order = np.lexsort((base, n, content))
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((content[a] == content[b]) & (n[a] == n[b]))
    new[same + 1] = ~equal_stretches(ids, firsts[a[same]], firsts[b[same]], sizes[a[same]])
    own = np.sort(order[new])
    held = np.repeat(np.isin(np.arange(len(n)), own), sizes)
    heads = places < np.repeat(n, sizes)
    place = np.where(heads, np.repeat(base, sizes) + places, LAST)
    index = FMIndex(ids[held], sizes[own], alphabet, place[held], window)
    at, earliest = index.statistics(ids, firsts[own], sizes[own], window)
    at = np.sort(at[place[at] > earliest])
    # runs of repeated windows of one piece
    piece = np.searchsorted(firsts, at, "right") - 1
    cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(piece, prepend=-1) != 0))
    k = piece[cut]
    found = np.zeros(len(cut), REPORT)
    found["row"], found["start"], found["n"] = pieces["row"][k], pieces["start"][k] + at[cut] - firsts[k], np.diff(np.append(cut, len(at)))
    later = order[~new]
    whole = np.zeros(len(later), REPORT)
    copied = np.flatnonzero(pieces["more"])
    copies = np.zeros(len(copied), REPORT)
    for report, which in ((whole, later), (copies, copied)):
        for name in ("row", "start", "n"):
            report[name] = pieces[name][which]
    copies["copies"] = 1
    return pieces["file"][np.concatenate([k, later, copied])].astype(np.int64), np.concatenate([found, whole, copies])


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept (binary: the words that stay, joined by one blank)."""
    spark = docs.sparkSession
    names = docs.columns
    added = []
    for name in ("n_words", "n_removed", "kept"):
        while name in names:
            name += "_"
        added.append(name)
    schema = docs.select("*", F.lit(0).cast("long").alias(added[0]), F.lit(0).cast("long").alias(added[1]), F.lit(b"").alias(added[2])).schema
    arrow = to_arrow_schema(docs.schema)
    table = written(docs, "substring-rows", **{"parquet.block.size": str(ROW_GROUP)})
    files = files_of(table)
    if not files:
        return spark.createDataFrame([], schema)
    parts = max(partitions(spark), -(-bytes_of(table) // SHARD))
    tasks = min(len(files), 4 * parts)

    def groups(file: int, whole: bool = False):
        """First row, rows and texts of each group of a file."""
        return file_groups(files[file], text_column, GROUP, names if whole else [id_column, text_column], arrow if whole else None)

    def cut(part: pa.RecordBatch, texts: list[str]) -> tuple[Words, np.ndarray, Segments]:
        words, ids = Words(encoded(texts)), _ids(part.column(part.schema.get_field_index(id_column)))
        return words, ids, Segments(words, ids, window)

    def anchors_of(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group's anchors by part of the census, their parts, and the number of different segments (two at least if anything may recur in the group)."""
        first = s.order[s.new]
        anchor, at = np.unique(s.anchor[first], return_inverse=True)
        total = np.bincount(at, minlength=len(anchor))
        again = np.bincount(np.searchsorted(anchor, s.anchor), weights=1 + s.twice, minlength=len(anchor)) > 1
        part = _part(anchor, parts)
        order = np.argsort(part, kind="stable")
        return anchor[order], part[order], np.maximum(total, 1 + again)[order]

    def census(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for group, (_, part, texts) in enumerate(groups(file)):
                    anchor, target, counts = anchors_of(cut(part, texts)[2])
                    rows = [(p, file, group, anchor[at].astype("<u8").tobytes(), counts[at].astype("<u4").tobytes()) for p, at in runs(target)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "file", "group", "anchors", "counts"])

    def answer(batches):
        keys, asked, counts = [], [], []
        for batch in batches:
            for part, file, group, a, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys.append((file, group, part))
                asked.append(np.frombuffer(a, "<u8"))
                counts.append(np.frombuffer(c, "<u4"))
        if not keys:
            return
        ends = np.cumsum([len(a) for a in asked])
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        level = levels(np.bincount(at, weights=np.concatenate(counts)).astype(np.int64))[at]
        for a in range(0, len(keys), 1024):
            file, group, part = zip(*keys[a : a + 1024], strict=True)
            data = [level[ends[i - 1] if i else 0 : ends[i]].tobytes() for i in range(a, a + len(file))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (file, group, part)] + [pa.array(data, pa.binary())], ["file", "group", "part", "levels"])

    def fetch(batches):
        told: dict[int, dict[int, list]] = {}
        for batch in batches:
            for file, group, part, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                told.setdefault(file, {}).setdefault(group, []).append((part, data))
        for file in sorted(told):
            for group, (row, part, texts) in enumerate(groups(file)):
                if group not in told[file]:
                    continue
                words, ids, s = cut(part, texts)
                anchor, _, _ = anchors_of(s)
                level = np.frombuffer(b"".join(x for _, x in sorted(told[file][group])), np.uint8)
                by_anchor = np.argsort(anchor)
                first = s.order[s.new]
                level = level[by_anchor][np.searchsorted(anchor[by_anchor], s.anchor[first])]
                more = np.diff(np.append(np.flatnonzero(s.new), len(s.new))) > 1
                some = level > 0
                first, level, more = first[some], level[some].astype(np.int64), more[some]
                piece = np.zeros(len(first), PIECE)
                piece["key"], piece["doc"], piece["file"], piece["row"] = s.anchor[first], ids[s.row[first]], file, row + s.row[first]
                piece["start"], piece["n"], piece["more"] = s.start[first], s.n[first], more
                piece, at = spread(piece, s.at[first], level, s.grams)
                a, b = words.starts[at], words.ends[at + piece["n"] + window - 2]
                rows = [(p, piece[own].tobytes(), b"\n".join([words.raw[i:j] for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)])) for p, own in runs(_part(piece["key"], parts))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "pieces", "texts"])

    def spread(piece: np.ndarray, at: np.ndarray, level: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts the segments of crowded anchors into runs of windows that share their `level` least hashes."""
        out, starts = [piece[level < 2]], [at[level < 2]]
        positions = window - GRAM + 1
        for depth in np.unique(level[level > 1]).tolist():
            every = np.flatnonzero(level == depth)
            for a in range(0, len(every), 20_000):
                own = every[a : a + 20_000]
                n = piece["n"][own].astype(np.int64)
                seg = np.repeat(own, n)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lowest = np.sort(gram[(at[seg] + offset)[:, None] + np.arange(positions)], axis=1)[:, :depth]
                key = np.zeros(len(seg), np.uint64)
                for k in range(lowest.shape[1]):
                    key = mix(key + lowest[:, k])
                new = np.ones(len(seg), bool)
                new[1:] = (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])
                head = np.flatnonzero(new)
                small = piece[seg[head]].copy()
                small["key"], small["n"] = key[head], np.diff(np.append(head, len(seg)))
                small["start"] += offset[head].astype(np.uint32)
                out.append(small)
                starts.append(at[seg[head]] + offset[head])
        return np.concatenate(out), np.concatenate(starts)

    def look_up(batches):
        pieces, texts = [], []
        for batch in batches:
            for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pieces.append(np.frombuffer(p, PIECE))
                texts.append(t)
        if not pieces:
            return
        words, pieces = Words(texts), np.concatenate(pieces)
        texts.clear()
        sizes = pieces["n"].astype(np.int64) + window - 1
        firsts = np.cumsum(sizes) - sizes
        a, b = words.starts[firsts], words.ends[firsts + sizes - 1]
        order = np.argsort(pieces["key"], kind="stable")
        total, key = np.cumsum(sizes[order]), pieces["key"][order]
        change = np.append(np.flatnonzero(np.diff(key)) + 1, len(order))  # ends of keys
        first = 0
        while first < len(order):  # whole keys together
            last = int(change[np.searchsorted(change, max(first + 1, np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK)))])
            own = order[first:last]
            file, found = search(pieces[own], b"\n".join([words.raw[i:j] for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)]), window)
            rows = [(f % tasks, f, found[at].tobytes()) for f, at in runs(file)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["task", "file", "data"])
            first = last

    def finish(batches):
        told: dict[int, list[bytes]] = {}
        for batch in batches:
            for file, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                told.setdefault(file, []).append(data)
        for file in sorted(told):
            every = np.frombuffer(b"".join(told[file]), REPORT)
            every = every[np.argsort(every["row"], kind="stable")]
            for row, part, texts in groups(file, whole=True):
                reports = every[np.searchsorted(every["row"], row) : np.searchsorted(every["row"], row + len(texts))]
                if reports["copies"].any():
                    words, _, s = cut(part, texts)
                else:
                    words, s = Words(encoded(texts)), None
                counts = words.counts
                firsts = np.cumsum(counts) - counts
                at = firsts[reports["row"].astype(np.int64) - row] + reports["start"]
                own = reports["copies"] == 0
                starts, sizes = [at[own]], [reports["n"][own].astype(np.int64)]
                if s is not None:
                    for x, n in later_copies(s, at[~own], reports["n"][~own].astype(np.int64)):
                        starts.append(x)
                        sizes.append(n)
                gone = mark(len(words.starts), np.concatenate(starts), np.concatenate(sizes) + window - 1)
                ends = np.cumsum(counts)
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[ends] - removed[ends - counts]
                kept = []
                for t, end, n, r in zip(texts, ends.tolist(), counts.tolist(), removed.tolist(), strict=True):
                    w = t.encode("utf-8", "surrogatepass").split()
                    kept.append(b" ".join(compress(w, ~gone[end - n : end])) if r else b" ".join(w))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [*names, *added])

    def later_copies(s: Segments, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The reported stretches of first segments, at the places of their later copies."""
        heads = np.flatnonzero(s.new)
        first = s.order[heads]
        by_place = np.argsort(s.at[first])
        k = by_place[np.searchsorted(s.at[first][by_place], at, "right") - 1]  # the reported segments
        offset, copies = at - s.at[first[k]], np.diff(np.append(heads, len(s.order)))[k] - 1
        inside = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        yield s.at[s.order[np.repeat(heads[k], copies) + 1 + inside]] + np.repeat(offset, copies), np.repeat(n, copies)

    numbers = spark.range(0, len(files), 1, tasks)
    asked = numbers.mapInArrow(lean(census), "part int, file int, group int, anchors binary, counts binary").repartitionById(parts, "part")
    answers = asked.mapInArrow(lean(answer), "file int, group int, part int, levels binary").repartitionById(tasks, F.col("file") % tasks)
    pieces = answers.mapInArrow(lean(fetch), "part int, pieces binary, texts binary").repartitionById(parts, "part")
    found = pieces.mapInArrow(lean(look_up), "task int, file int, data binary")
    every = numbers.select((F.col("id") % tasks).cast("int").alias("task"), F.col("id").cast("int").alias("file"), F.lit(b"").alias("data"))
    reports = written(found.union(every), "substring-reports")
    return reports.repartitionById(tasks, "task").mapInArrow(lean(finish), schema)
