import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.llm import embed_dedup, topk
from tensorframe.operators.graph import least_members

NAN, INF = float("nan"), float("inf")


def test_products_and_ties():
    rng = np.random.default_rng(1)
    ids = np.arange(500) * 3
    q, c = rng.integers(-3, 4, (20, 6)), rng.integers(-3, 4, (500, 6))
    scores, found = topk.best(topk.products(q, c), ids, 5)
    for r in range(20):
        want = sorted(((-int(s), int(i)) for s, i in zip(c @ q[r], ids, strict=True)))[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[r], found[r], strict=True)] == want
    big = np.array([[2**40, 1]])
    assert topk.products(big, big)[0, 0] == 2**80 + 1


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_topk_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(i, [float(rng.randint(-2, 2)) / 4 for _ in range(4)], "x") for i in range(120)]
    rows += [(5, rows[5][1], "again"), (7, [0.75, 0.25, -0.5, 0.5], "other"), (200, None, ""), (201, [1.0, None, 0.0, 0.0], ""), (202, [NAN] * 4, ""), (203, [INF] * 4, ""), (None, [1.0] * 4, ""), (204, [1.0, 2.0], ""), (205, [2.0, 2.0], ""), (206, [], "")]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, rank string").repartition(3)
    vectors = df.select("id", topk.quantised("embedding").alias("vector"), "rank")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = topk.exact_topk(vectors, vectors.filter("id % 5 = 0"), 3).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i in {i for i, _ in fine if i % 5 == 0}:  # rows of one id share a list
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for q, v in fine if q == i for j, w in fine if j != i and len(w) == len(v))[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_of_one_id_are_candidates_one_by_one(spark):
    vectors = spark.createDataFrame([(0, [1, 1]), (7, [5, 0]), (7, [9, 0]), (8, [6, 0])], "id long, vector array<long>")
    got = topk.exact_topk(vectors, vectors.filter("id = 0"), 2).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 9), (0, 2, 8, 6)]


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, vector array<long>")
    assert topk.exact_topk(empty, empty, 5).collect() == []


def closure(n, links):
    up = list(range(n))

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 99)]
    got = {r.node: r.least for r in least_members(spark.createDataFrame(links, "u long, v long")).collect()}
    want = closure(100, links)
    assert got == {i: c for i, c in enumerate(want) if i != c}


def brute(rows, least):
    fine = {k: np.array(v, np.float32).astype(float) for k, (_, v, label) in enumerate(rows) if rows[k][0] is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and rows[a][2] == rows[b][2] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / math.sqrt((fine[a] @ fine[a]) * (fine[b] @ fine[b])) >= least]
    counts = [sum(k in x for x in links) for k in range(len(rows))]
    ids = [r[0] for r in rows]
    group = closure(len(rows), links)
    least_id = {}
    for k, g in enumerate(group):
        if ids[k] is not None:
            least_id[g] = min(least_id.get(g, ids[k]), ids[k])
    return sorted(((ids[k], counts[k], least_id.get(group[k])) for k in range(len(rows))), key=repr)


def test_grid_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "INTERVAL", 50)
    monkeypatch.setattr(embed_dedup, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6))
    rows = [(int(i), [float(x) for x in centres[rng.integers(12)] + rng.standard_normal(6) * rng.choice([0.05, 0.3])], int(rng.integers(2))) for i in rng.permutation(300)]
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], rows[0][2]), (302, [0.0] * 6, 0), (303, None, 0), (304, [NAN] * 6, 1), (305, [1.0, None] * 3, 1), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [1.0, 2.1], 0), (309, [], 0), (None, rows[1][1], 0), (310, [1e30] * 6, 0), (311, [2e30] * 6, 0)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = sorted(((r.id, r.n_links, r.component_id) for r in embed_dedup.near_dedup(df).collect()), key=repr)
    assert got == brute(rows, 0.93)
    assert embed_dedup.near_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("held, block", [(2, 1), (32, 64)])
def test_files_of_many_blocks(spark, monkeypatch, held, block):
    monkeypatch.setattr(embed_dedup, "INTERVAL", 10_000)
    monkeypatch.setattr(embed_dedup, "HELD", held)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 8))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.standard_normal(8) * 0.2], i % 3) for i in range(1500)]
    got = embed_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows, 0.93)


def test_doubles_are_not_rounded_and_labels_may_be_text(spark):
    c = 0.93
    rows = [(1, [1.0, 0.0], "a"), (2, [c - 1e-9, math.sqrt(1 - (c - 1e-9) ** 2)], "a"), (3, [c + 1e-9, -math.sqrt(1 - (c + 1e-9) ** 2)], "a"), (4, [1.0, 0.0], "b")]
    got = embed_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 4)]


def test_distant_blocks_are_skipped():
    rng = np.random.default_rng(0)
    unit = embed_dedup._unit(np.concatenate([c + 0.01 * rng.standard_normal((300, 8)) for c in np.eye(8)]))
    x = embed_dedup.Interval(np.zeros(2400, int), np.arange(2400), np.ones(2400, int), unit, unit)
    tried = []
    box = embed_dedup.distant
    try:
        embed_dedup.distant = lambda *a: tried.append(box(*a)) or tried[-1]
        nx, _, _ = embed_dedup.join_pair(x, x, 0.93, math.sqrt(0.14))
    finally:
        embed_dedup.distant = box
    assert (nx == 299).all() and any(tried)
