import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tensorframe.llm import near_dedup as nd


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().encode().split()
        out.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    return out


def brute(rows, least):
    """Class of each row by comparing all pairs with exact document frequencies."""
    sets = sets_of([t for _, t in rows])
    df = Counter(s for x in sets for s in x)
    n = sum(map(bool, sets))
    weight = [{s: k * (1 + math.log1p(n / df[s]) / math.log1p(n)) for s, k in x.items()} for x in sets]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, x in enumerate(sets):
        for s in x:
            by[s].append(i)
    for i, a in enumerate(weight):
        if rows[i][0] is None:
            continue
        for j in {j for s in a for j in by[s] if j > i and rows[j][0] is not None}:
            both = sum(min(v, weight[j][s]) for s, v in a.items() if s in weight[j])
            if both / (sum(a.values()) + sum(weight[j].values()) - both) >= least:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[root(i)] = min(least_id.get(root(i), d), d)
    return sorted(((d, None if d is None else least_id[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(4)
    a, b = rng.random((2, 200)) * 3 + 0.1
    b[:120] = a[:120]
    sh = rng.integers(0, 1 << 40, 200).astype(np.uint64)
    got = nd.samples(np.repeat([0, 1], 200), np.concatenate([sh, sh]), np.concatenate([a, b]), 2, 1500)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_similarities_are_exact():
    texts = ["a b c d e f g h", "a b c d e f g x", "A B C D E F G H a b c d e", "a b", "", "q w e r t y u i o p"]
    table = np.ones(1 << 12, np.int64)
    table[::2] = 3
    weights = nd.Weights(table, 7)
    w = []
    for t in texts:
        _, sh, times, _, _ = nd.shingles([t])
        w.append(dict(zip(sh.tolist(), weights(sh, times), strict=True)))
    pairs = [(i, j) for i in range(6) for j in range(6)]
    got = nd.similarities([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs], weights)
    for (i, j), s in zip(pairs, got, strict=True):
        keys = w[i].keys() | w[j].keys()
        top = sum(max(w[i].get(k, 0), w[j].get(k, 0)) for k in keys)
        want = sum(min(w[i].get(k, 0), w[j].get(k, 0)) for k in keys) / top if top and w[i] and w[j] else 0
        assert s == pytest.approx(want)
    every = nd.all_similarities(nd.weighted_sets(texts, weights), 3)
    assert all(every[p] == pytest.approx(s) for p, s in zip(pairs, got, strict=True) if p[0] != p[1])


def test_sets_pack():
    texts = ["a b c d e f g h", "", "a a a a a a a a a", "one two"]
    df = [np.arange(1, len(nd.shingles([t])[1]) + 1) * 300 for t in texts]
    got = nd.unpacked_sets(nd.packed_sets(texts, [nd.narrow(d) for d in df]), 5000)
    want = nd.weighted_sets(texts, nd.Counted(5000, texts, [nd.narrow(d) for d in df]))
    assert all((x == y).all() for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def near_copy(rng, words, vocabulary, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 4])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for k in range(8):
        base = [rng.choice(vocabulary) for _ in range(150)]
        texts += [near_copy(rng, base, vocabulary, rng.randrange(16)) for _ in range(3 + 5 * k)] + [" ".join(base)] * k
    line = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(30)]
    texts += ["", "", None, "  \n", "two words", "two words", "Two  WORDS", "one", "word " * 3000, "word " * 3000]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(0, texts[0]), (3, "another text of the same number " * 3), (None, texts[1]), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bands string")
    got = nd.near_duplicates(df, bands=40, rows=2).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute(rows, 0.8)
    assert all(r.kept == (r.doc_id is None or (r.doc_id, r.text_hash) == (r.class_id, r.class_hash)) for r in got)
    classes = {(r.class_id, r.class_hash) for r in got if r.doc_id is not None}
    assert len({(r.doc_id, r.text_hash) for r in got if r.kept and r.doc_id is not None}) == len(classes)
    assert nd.near_duplicates(df.limit(0)).collect() == []


OWN = 79


def test_many_other_shingles_leave_weights_alone(spark, tmp_path):
    """Copies of similarity 0.79 by their shingles' own frequencies, beside five million other shingles."""
    rng = np.random.default_rng(1)
    base = " ".join(f"b{i}" for i in range(1004))
    texts = [base + " " + " ".join(f"t{k}x{i}" for i in range(OWN)) for k in range(40)]
    texts += [" ".join(map(str, rng.integers(0, 1 << 31, 1_000_000).tolist())) for _ in range(5)]
    pq.write_table(pa.table({"doc_id": list(range(45)), "text": texts}), f"{tmp_path}/documents.parquet", row_group_size=4)
    n, shared, own = 45, 1000 * (1 + math.log1p(45 / 40) / math.log1p(45)), OWN * (1 + math.log1p(45) / math.log1p(45))
    assert 0.785 < shared / (shared + 2 * own) < 0.795
    got = nd.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(d, d) for d in range(n)]


def test_document_frequencies_are_exact(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(400, "a b c a b"), (400, "a b c a b"), (None, "a b c a b c"), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    total = Counter(s for x in sets_of([t for _, t in rows]) for s in x)
    want = Counter((d, tuple(sorted(total[s] for s in x))) for (d, _), x in zip(rows, sets_of([t for _, t in rows]), strict=True))
    held = nd.written(df.selectExpr("doc_id", "text", "xxhash64(text) h"))
    assert Counter((r.doc_id, tuple(sorted(nd.wide(r.df).tolist()))) for r in nd.signatures(held, 401, 2, 2).collect()) == want
    big = np.array([1, 300, 70_000, 1 << 40])
    assert all((nd.wide(nd.narrow(big[:k])) == big[:k]).all() for k in range(5))


def test_texts_of_one_doc_id_are_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, a + " more")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False)]
    assert len({(r.class_id, r.class_hash) for r in got}) == 2


def test_long_words_that_a_polynomial_hash_confuses(spark):
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    got = nd.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("sf, floor", [("sf0.001", 1.0), ("sf0.01", 0.99)])
def test_query_against_brute_force(spark, sf, floor):
    """Recall and precision of the pairs of similarity 0.8 or more, counted within documents that have such a pair."""
    from tensorframe.llm.queries import op3_weighted_minhash

    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in op3_weighted_minhash(spark, path).collect()}
    want = dict(brute(rows, 0.8))
    assert got.keys() == want.keys()
    own = {d for d, c in Counter(want.values()).items() if c > 1}
    paired = [d for d, c in want.items() if c in own]
    assert paired and sum(got[d] == want[d] for d in paired) >= floor * len(paired)
    assert all(got[d] == d for d in want if d not in set(paired))
