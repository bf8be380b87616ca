"""Quality classifier: a generalised additive model with pairwise interactions.

score = sigmoid(intercept + sum of per-feature table entries + sum of per-pair
table entries). Tables are learned by cyclic gradient boosting: each round
visits every feature in turn, fits a shallow tree (one feature, MAIN_LEAVES
leaves) to the current gradients and adds it, scaled, to that feature's lookup
table. Then the pairs of features with the greatest remaining gain get
two-dimensional tables, boosted in the same way by trees with one cut on each
feature. Scoring is a bin search and additions over whole batches.

Inputs are statistics of the whole text only. The model is fitted on at most
``fit_rows`` labelled rows, those whose doc_id has the smallest hash; labels
of one doc_id are averaged (1 from one half up), null ones ignored; of several
texts with one doc_id the smallest is learned from. Without labels every score
is 0.5, with one class only it is near that class.

Null texts score as empty ones do. Null doc_ids are scored and never learned
from. Repeated rows are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
MAIN_ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
MAIN_LEAVES, LEAST_LEAF, RIDGE = 4, 10, 5.0

FEATURES = (
    "log_chars", "letters", "upper", "digits", "spaces", "sentence_marks", "exclamations", "symbols", "word_length",
    "line_length", "distinct_words", "log_distinct", "same_as_next", "commonest_word", "repeated_lines", "marked_words",
)

# character classes: 0 other (symbols), 1 lower or caseless letter, 2 upper letter, 3 digit, 4 white space, 5 sentence mark, 6 exclamation or question
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _table:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            t[c] = 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 4 if s.isspace() else 0
        for s in ".,;:'\"-()":
            t[ord(s)] = 5
        for s in "!?¡¿":
            t[ord(s)] = 6
        _table.append(t)
    return _table[0]


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    cut = np.concatenate([[0], np.cumsum(n)])
    counts = np.zeros((len(texts), 7))
    for k in range(7):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[:, k] = total[cut[1:]] - total[cut[:-1]]
    chars = np.maximum(n, 1)
    out = np.zeros((len(texts), len(FEATURES)))
    letters = counts[:, 1] + counts[:, 2]
    out[:, 0] = np.log1p(n)
    out[:, 1] = letters / chars
    out[:, 2] = counts[:, 2] / np.maximum(letters, 1)
    out[:, 3], out[:, 4], out[:, 5], out[:, 6], out[:, 7] = (counts[:, k] / chars for k in (3, 4, 5, 6, 0))
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        lines = [x for x in t.split("\n") if x]
        seen = Counter(words)
        w = len(words)
        out[i, 8:] = (
            n[i] / w,
            np.log1p(n[i] / max(len(lines), 1)),
            len(seen) / w,
            np.log1p(len(seen)) / np.log1p(w),
            sum(map(eq, words, words[1:])) / w,
            max(seen.values()) / w,
            1 - len(set(lines)) / max(len(lines), 1),
            (counts[i, 0] + counts[i, 6]) / w,
        )
    return out


@dataclass
class Model:
    """Cut points and lookup tables."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features, their coarse cuts, table

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, ca, cb, table in self.pairs:
            total += table[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, about equal numbers of rows apart."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with at most MAIN_LEAVES leaves, grown best gain first."""
    gs, hs, ns = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))

    def split(a: int, b: int):
        k = np.arange(a + 1, b)
        ok = k[(ns[k] - ns[a] >= LEAST_LEAF) & (ns[b] - ns[k] >= LEAST_LEAF)]
        if not len(ok):
            return 0.0, -1
        gain = _gain(gs[ok] - gs[a], hs[ok] - hs[a]) + _gain(gs[b] - gs[ok], hs[b] - hs[ok]) - _gain(gs[b] - gs[a], hs[b] - hs[a])
        i = int(gain.argmax())
        return float(gain[i]), int(ok[i])

    leaves = [(*split(0, len(g)), 0, len(g))]
    while len(leaves) < MAIN_LEAVES:
        top = max(leaves)
        if top[0] <= 0:
            break
        leaves.remove(top)
        _, k, a, b = top
        leaves += [(*split(a, k), a, k), (*split(k, b), k, b)]
    out = np.zeros(len(g))
    for _, _, a, b in leaves:
        out[a:b] = -(gs[b] - gs[a]) / (hs[b] - hs[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree with one cut on each of two features, from sums per cell: its gain and its values."""
    gs, hs = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))

    def four(s):
        nw = s[1:-1, 1:-1]
        ne, sw = s[1:-1, -1:] - nw, s[-1:, 1:-1] - nw
        return nw, ne, sw, s[-1, -1] - nw - ne - sw

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = list(zip(four(gs), four(hs), strict=True))
    gain = sum(_gain(a, b) for a, b in parts) - _gain(gs[-1, -1], hs[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = [-a[i, j] / (b[i, j] + RIDGE) for a, b in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on rows x with labels y in {0, 1}."""
    if not len(y):
        return Model()
    model = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if y.min() == y.max():
        return model
    model.cuts = [_quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    raw = np.full(len(y), model.intercept)
    for _ in range(MAIN_ROUNDS):
        for b, t, n in zip(bins, model.tables, sizes, strict=True):
            p = _sigmoid(raw)
            step = RATE * _tree(np.bincount(b, p - y, len(t)), np.bincount(b, p * (1 - p), len(t)), n)
            t += step
            raw += step[b]
    coarse = [_quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def sums(a: int, b: int):
        p = _sigmoid(raw)
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        at = cell[a] * shape[1] + cell[b]
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))

    gains = sorted(((_quadrants(*sums(a, b)[1:])[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, t in model.pairs:
            at, g, h = sums(a, b)
            step = RATE * _quadrants(g, h)[1]
            t += step
            raw += step.reshape(-1)[at]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """Fits the model on labelled documents that are not held out, ``fit_rows`` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # broadcasts fit_rows ids at most

    def measure(batches):
        for batch in batches:
            for part, t in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(features(t)), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(lean(measure), "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    return fit(np.array(got.x.tolist()).reshape(len(got), len(FEATURES)), got.quality.to_numpy(dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and the score of its text."""

    def add(batches):
        for batch in batches:
            for part, t in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(t)))], [*part.schema.names, name])

    name = "score"
    while name in docs.columns:
        name = f"{name}_"
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(lean(add), schema)
