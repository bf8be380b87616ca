import random

import numpy as np
import pytest

from tensorframe.functions.semiring import SAT_U32
from tensorframe.operators import algebra, blocked, graph, report
from tensorframe.sources import constructors as make
from tensorframe.sources import files
from tensorframe.tensor import ShapeError, from_numpy, from_rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def matrix(spark, n, pairs, **k):
    return make.from_edges(edges(spark, pairs), n, **k)


def cells(t):
    return sorted(tuple(r) for r in t.df.collect())


def labels(df):
    return [r.comp for r in df.orderBy("node").collect()]


def test_products(spark):
    a = matrix(spark, 3, [(0, 1), (1, 2)])
    assert cells(algebra.matmul(a, make.identity(spark, 3))) == [(0, 1, 1), (1, 2, 1)]
    t = matrix(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert cells(graph.power(t, 2)) == [(0, 2, 1), (1, 0, 1), (2, 1, 1)]
    assert cells(graph.power(t, 3)) == [(i, i, 1) for i in range(3)]
    assert matrix(spark, 2, [(0, 1), (0, 1)]).get(0, 1) == 2
    assert graph.power(matrix(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)]), 2).get(0, 3) == 2
    six = make.from_edges_undirected(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 3)]), 6)
    full = six.to_numpy().astype(int)
    assert (graph.power(six, 2).to_numpy() == full @ full).all()
    assert {r.i0: r.nnz for r in algebra.symbolic_nnz(six, six).collect()} == dict(enumerate(((full @ full) > 0).sum(axis=1).tolist()))


def test_sums_and_stability(spark):
    chain = matrix(spark, 4, [(0, 1), (1, 2), (2, 3)])
    total, k = graph.reachability_sum(chain)
    assert [(r[0], r[1]) for r in cells(total)] == [(i, j) for i in range(4) for j in range(i + 1, 4)] and k == 4
    long = matrix(spark, 64, [(i, i + 1) for i in range(63)], semiring=SAT_U32())
    stable, k = graph.power_until_stable(algebra.add(long, make.identity(spark, 64, SAT_U32())))
    assert stable.nnz() == 64 * 65 // 2 and k <= 8
    with pytest.raises(graph.NotConverged):
        graph.power_until_stable(matrix(spark, 3, [(0, 1), (1, 2), (2, 0)]), max_iter=5)


def test_stable_pattern_equals_squaring(spark, monkeypatch):
    """Symmetric patterns with a full diagonal form no products; the matrix and the number of squarings are those of squaring."""
    from tensorframe.functions.semiring import BOOL

    monkeypatch.setattr(graph, "MEMBERS", 3)
    shapes = [(4, []), (8, [(0, 1), (2, 3), (2, 4), (2, 5), (2, 6)]), (7, [(i, i + 1) for i in range(5)])]
    squared, product = [], graph.matmul
    monkeypatch.setattr(graph, "matmul", lambda *x: squared.append(1) or product(*x))
    for n, pairs in shapes:
        full = lambda ring: algebra.add(make.from_edges_undirected(edges(spark, [p for p in pairs if p[0] != p[1]]), n, ring()), make.identity(spark, n, ring()))  # noqa: E731, B023
        found, k = graph.power_until_stable(full(BOOL))
        assert not squared
        want, steps = graph.power_until_stable(full(SAT_U32))
        squared.clear()
        assert cells(found) == [(i, j, 1) for i, j, _ in cells(want)] and k == steps
    arrow, _ = graph.power_until_stable(algebra.add(matrix(spark, 4, [(0, 1), (1, 2), (2, 3)], semiring=BOOL()), make.identity(spark, 4, BOOL())))
    assert cells(arrow) == [(i, j, 1) for i in range(4) for j in range(i, 4)] and squared
    with pytest.raises(graph.NotConverged):
        graph.power_until_stable(algebra.add(make.from_edges_undirected(edges(spark, [(i, i + 1) for i in range(8)]), 9, BOOL()), make.identity(spark, 9, BOOL())), max_iter=3)


def test_components(spark):
    two = make.from_edges_undirected(edges(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]), 6)
    assert labels(graph.weak_components(two)) == labels(graph.strong_components(two)) == [0, 0, 0, 1, 1, 1]
    assert graph.count_components(graph.weak_components(make.empty(spark, (5, 5)))) == 5
    one = matrix(spark, 2, [(0, 1)])
    assert labels(graph.strong_components(one)) == [0, 1] and labels(graph.weak_components(one)) == [0, 0]
    with pytest.raises(ShapeError, match="requires a square 2D matrix"):
        graph.weak_components(make.empty(spark, (2, 3)))


def test_names(spark):
    pairs = spark.createDataFrame([(0, "x", "y"), (1, "x", "y"), (2, "y", "x"), (3, "a", "a"), (4, "a", "b")], "pos bigint, src string, dst string")
    found, ids = make.from_adjacency(pairs)
    assert {r.name: r.id for r in ids.collect()} == {"x": 0, "y": 1, "a": 2, "b": 3}
    assert sorted(map(tuple, found.collect())) == [(0, 1, 2), (1, 0, 1), (2, 2, 1), (2, 3, 1)]


def test_lattices(spark):
    assert make.lattice(spark, (5,)).nnz() == 8 and make.lattice(spark, (5,), torus=True).nnz() == 10
    grid = make.lattice(spark, (3, 3))
    assert [r.i1 for r in grid.row(4).collect()] == [0, 1, 2, 3, 5, 6, 7, 8]
    assert make.lattice(spark, (3, 3), torus=True).nnz() == 72 and make.lattice(spark, (2, 2, 2)).nnz() == 56
    assert cells(make.lattice(spark, (2,), torus=True)) == [(0, 1, 2), (1, 0, 2)]
    assert cells(make.lattice(spark, (2,), torus=True, dedupe=True)) == [(0, 1, 1), (1, 0, 1)]
    assert cells(make.lattice(spark, (1,), torus=True)) == [(0, 0, 2)]
    assert cells(grid) == cells(grid.transpose())
    thin = make.thin(grid, make.hashed_share(0.5))
    assert 0 < thin.nnz() < grid.nnz() and cells(thin) == cells(thin.transpose())


def test_random(spark):
    g = make.random_graph(spark, 10, 300, 1)
    assert sum(v for _, _, v in cells(g)) == 300 and all(i != j for i, j, _ in cells(g))
    t = make.with_density(spark, (7, 9), 0.5, 2)
    assert t.nnz() == 31 == len({(i, j) for i, j, _ in cells(t)}) and all(0 <= v < 1 and i < 7 and j < 9 for i, j, v in cells(t))


def test_reordering(spark):
    rng = random.Random(0)
    for n, pairs in ((6, [(0, 3), (1, 4), (2, 5), (0, 1), (3, 4)]), (5, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 3)]), (2, [(1, 0)]), (12, [(rng.randrange(12), rng.randrange(12)) for _ in range(14)])):
        a = matrix(spark, n, pairs)
        perm = graph.rcm(a)
        rows = perm.collect()
        assert sorted(r.new_id for r in rows) == sorted(r.old_id for r in rows) == list(range(n))
        assert cells(graph.unpermute(graph.permute(a, perm), perm)) == cells(a)
    wide = make.from_edges_undirected(edges(spark, [(i, 5 - i) for i in range(3)]), 6)
    assert graph.bandwidth(graph.permute(wide, graph.rcm(wide))).first().max_bw <= graph.bandwidth(wide).first().max_bw
    line = [(i, i + 1) for i in range(20)]
    shuffled = list(range(21))
    rng.shuffle(shuffled)
    mixed = make.from_edges_undirected(edges(spark, [(shuffled[a], shuffled[b]) for a, b in line]), 21)
    assert graph.bandwidth(graph.permute(mixed, graph.rcm(mixed))).first().max_bw == 1


def test_statistics(spark):
    tri = make.from_edges_undirected(edges(spark, [(i, i + 1) for i in range(4)]), 5)
    assert tuple(graph.bandwidth(tri).first()) == (1, 1.0)
    assert tuple(graph.degree_stats(tri).first()) == (1, 2, 1.6, 2)
    assert graph.diameter(tri) == 4 and graph.diameter(make.empty(spark, (3, 3))) == 0 and graph.diameter(matrix(spark, 2, [(0, 1)])) == 1
    found = graph.structure(tri)
    assert found["components"] == 1 and found["top_sizes"] == [5] and found["max_bw_rcm"] == 1


def test_edge_files(spark, tmp_path):
    (tmp_path / "g.edges").write_text("0 1\n\n  2   5 \n")
    n, e = files.load_edges(spark, str(tmp_path / "g.edges"))
    assert n == 6 and sorted(map(tuple, e.collect())) == [(0, 1), (2, 5)]
    (tmp_path / "mixed.txt").write_text("test a\nside,nodes,x\n 10,1000,2\nok\n")
    assert [r.line for r in files.csv_lines(spark, str(tmp_path / "mixed.txt"), "side").collect()] == ["side,nodes,x", "10,1000,2"]


def test_tiles(spark):
    a = from_rows(spark, [(0, 0, 3, 5, 1.5), (0, 0, 12, 9, -2.0)], (1, 1, 16, 16), "double")
    b = blocked.to_blocks(a)
    assert cells(b.to_tensor()) == cells(a) and b.nnz() == 2 and b.memory() == 2 * 256 and b.grid == (2, 2)
    ones = np.zeros((1, 1, 16, 16))
    ones[..., :8, :8] = 1
    x = blocked.to_blocks(from_numpy(spark, ones))
    out = blocked.attention(x, x)
    assert out.df.count() == 1 and set(out.df.first().block) == {8.0}
    rng = np.random.default_rng(1)
    q, k = rng.standard_normal((2, 3, 20, 12)), rng.standard_normal((2, 3, 17, 12))
    for n in (8, 16):
        got = blocked.attention(blocked.to_blocks(from_numpy(spark, q), n), blocked.to_blocks(from_numpy(spark, k), n)).to_tensor().to_numpy()
        assert np.abs(got - np.einsum("bhqd,bhkd->bhqk", q, k)).max() < 1e-3
    assert blocked.attention_macs(x, x) == 512
    m = rng.integers(0, 5, (3, 11, 9))
    y, z = blocked.to_blocks(from_numpy(spark, m)), blocked.to_blocks(from_numpy(spark, m.transpose(0, 2, 1)))
    assert (blocked.matmul(y, z).to_tensor().to_numpy() == m @ m.transpose(0, 2, 1)).all()
    assert cells(blocked.transpose(y).to_tensor()) == cells(z.to_tensor())
    square = blocked.to_blocks(from_numpy(spark, m[0, :9]))
    assert (blocked.power(square, 3).to_tensor().to_numpy() == np.linalg.matrix_power(m[0, :9], 3)).all()
    assert blocked.rel_diff(b, b) == 0 and blocked.rel_diff(b, blocked.empty(spark, a.shape)) == 1


def test_tolerant_operations(spark):
    shape = (6, 4, 7, 7)
    x = from_rows(spark, [(3, 1, 6, 6, 0.5), (3, 2, 6, 6, 1.0)], shape, "double")
    y = from_rows(spark, [(3, 1, 6, 6, 0.2), (3, 1, 6, 5, 0.2), (5, 0, 0, 1, 10.0), (5, 0, 0, 2, 20.0), (5, 0, 0, 3, 30.0)], shape, "double")
    total = algebra.tolerant_add(x, y)
    assert total.nnz() == 6 and total.get(3, 1, 6, 6) == pytest.approx(0.7)
    assert cells(algebra.multiply(x, y, tolerant=True)) == [(3, 1, 6, 6, pytest.approx(0.1))]
    assert algebra.rel_diff(x, x) == 0
    assert algebra.tolerant_add(x, x.with_df(x.df.withColumn("v", -x.df.v))).nnz() == 0


def test_break_even(spark):
    points = spark.createDataFrame([("r", 0.01, 10.0, 25.0), ("r", 0.02, 20.0, 25.0), ("r", 0.04, 40.0, 25.0), ("s", 0.01, 1.0, 5.0)], "run string, density double, time double, threshold double")
    got = report.break_even(points).collect()
    assert [(r.run, pytest.approx(r.density)) for r in got] == [("r", 0.025)]
    df = spark.createDataFrame([(1, 2.0, 3.0)], "n int, a double, b double")
    assert report.markdown(report.best_speedup(df, ["a", "b"])).split("\n")[2] == "| 1 | 2.0 | **3.0** |"


def reach(n, pairs):
    m = np.eye(n, dtype=bool)
    for a, b in pairs:
        m[a, b] = True
    for _ in range(n):
        m = m | (m.astype(int) @ m.astype(int) > 0)
    return m


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_equal_mutual_reachability(spark, seed):
    rng = random.Random(seed)
    n = 24
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range((20, 30, 60)[seed])] + [(3, 3)]
    m = reach(n, pairs)
    both = m & m.T
    least = [int(np.flatnonzero(both[i])[0]) for i in range(n)]
    number = {x: k for k, x in enumerate(sorted(set(least)))}
    assert labels(graph.strong_components(matrix(spark, n, pairs))) == [number[x] for x in least]


def test_strong_components_need_several_rounds(spark):
    rings = [(i, i + 1) for i in range(4)] + [(4, 0), (4, 7), (7, 8), (8, 9), (9, 7), (9, 11), (11, 12), (12, 11), (5, 0), (12, 6)]
    assert labels(graph.strong_components(matrix(spark, 13, rings))) == [0, 0, 0, 0, 0, 1, 2, 3, 3, 3, 4, 5, 5]


def distances(n, pairs):
    far = np.full((n, n), -1)
    near = [set() for _ in range(n)]
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for s in range(n):
        far[s, s], queue = 0, [s]
        for u in queue:
            for v in near[u]:
                if far[s, v] < 0:
                    far[s, v] = far[s, u] + 1
                    queue.append(v)
    return far


@pytest.mark.parametrize("sources", [3, 256])
def test_diameter_equals_brute_force(spark, monkeypatch, sources):
    monkeypatch.setattr(graph, "SOURCES", sources)
    line = [(i, i + 1) for i in range(39)] + [(i, i + 7) for i in range(33) if i % 3 == 0]
    assert graph.diameter(matrix(spark, 40, line)) == distances(40, line).max()
    rng = random.Random(sources)
    for n, m in ((12, 9), (18, 24)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert graph.diameter(matrix(spark, n, pairs)) == distances(n, pairs).max()
    ring = [(i, (i + 1) % 9) for i in range(9)]
    assert graph.diameter(matrix(spark, 9, ring)) == 4


def test_diameter_searches_few_nodes(spark, monkeypatch):
    """A search from the middle settles trees; of the leaves of a node one is searched from."""
    monkeypatch.setattr(graph, "SOURCES", 1)
    searched, search = [], graph._levels
    monkeypatch.setattr(graph, "_levels", lambda *x: searched.append(1) or search(*x))
    tree = [(0, k) for k in range(1, 6)] + [(k, 6 * k + j) for k in range(1, 6) for j in range(5)] + [(1, 40)]
    ring = [(k, (k + 1) % 5) for k in range(5)] + [(k, 5 * k + 5 + j) for k in range(5) for j in range(4)]
    for n, pairs, most in ((41, tree, 4), (30, ring, 8)):
        searched.clear()
        assert graph.diameter(matrix(spark, n, pairs)) == distances(n, pairs).max() == 4
        assert len(searched) <= most


def test_reordering_follows_the_textbook(spark):
    """Level by level: first parent, degree, number; reversed at the end."""
    rng = random.Random(5)
    n = 16
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(20)]
    near = [set() for _ in range(n)]
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    far, done, order = distances(n, pairs), set(), []
    for s in range(n):
        if s in done:
            continue
        part = [i for i in range(n) if far[s, i] >= 0]
        done |= set(part)
        first = min(part, key=lambda i: (len(near[i]), i))
        start = min(part, key=lambda i: (-far[first, i], len(near[i]), i))
        level = [start]
        while level:
            order += level
            place = {u: k for k, u in enumerate(level)}
            new = {v for u in level for v in near[u] if far[start, v] == far[start, u] + 1}
            level = sorted(new, key=lambda v: (min(place[u] for u in near[v] if u in place), len(near[v]), v))
    assert {r.old_id: r.new_id for r in graph.rcm(matrix(spark, n, pairs)).collect()} == {u: n - 1 - k for k, u in enumerate(order)}


def test_density_is_exact(spark):
    from math import prod

    for shape, share in (((7,), 1.0), ((10, 20, 25), 0.1), ((3, 3, 3), 0.99), ((1, 1), 1.0), ((40, 50), 0.0)):
        t = make.with_density(spark, shape, share, 5)
        found = cells(t)
        assert len(found) == len({c[:-1] for c in found}) == int(share * prod(shape))
        assert all(0 <= i < d for c in found for i, d in zip(c, shape, strict=False))
    assert cells(make.with_density(spark, (30, 30), 0.3, 1)) != cells(make.with_density(spark, (30, 30), 0.3, 2))


def test_distinct_cells_without_a_row_for_each(spark, monkeypatch):
    """Repeated cells count once, within a piece and across; cells outside the shape do not; no cell is sent as a row."""
    from tensorframe.tensor import Tensor

    monkeypatch.setattr(algebra, "PIECE", 50)
    monkeypatch.setattr(algebra, "SPAN", 64)
    rng = random.Random(3)
    held = [(rng.randrange(-1, 21), rng.randrange(31)) for _ in range(900)]
    t = Tensor(spark.createDataFrame([(i, j, 1) for i, j in held], "i0 bigint, i1 bigint, v bigint").repartition(5), (20, 30))
    assert algebra.distinct_cells(t).first().places == len({(i, j) for i, j in held if 0 <= i < 20 and j < 30})
    assert algebra.distinct_cells(make.empty(spark, (3, 3))).first().places == 0
    t = make.with_density(spark, (70, 90), 0.5, 2)
    assert algebra.distinct_cells(t).first().places == 3150
    from tensorframe import queries

    plan = queries.QUERIES["s16_with_density"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Expand" not in plan  # rows of a distinct count


def test_density_by_blocks(spark, monkeypatch):
    """Blocks share out the cells exactly and keep to their own places, so different places are counted without an exchange; if cells stray, with one."""
    from tensorframe import queries

    monkeypatch.setattr(make, "BLOCK", 64)
    for shape, share in (((30, 50), 0.5), ((7, 11, 13), 0.03), ((9, 40), 0.97), ((1500,), 0.2)):
        blocks, drawn = make.density_blocks(spark, shape, share, 5)
        held = []
        for number, count in blocks.collect():
            first, index, values = drawn(number, count)
            places = np.ravel_multi_index(index, shape)
            assert first == number * 64 and len(values) == count and (places // 64 == number).all() and ((values >= 0) & (values < 1)).all()
            held += places.tolist()
        assert len(held) == len(set(held)) == int(share * np.prod(shape))
        assert sorted(held) == sorted(int(np.ravel_multi_index(c[:-1], shape)) for c in cells(make.with_density(spark, shape, share, 5)))
    assert len(cells(make.with_density(spark, (), 1.0))) == 1
    sf, exact, plain = "/root/testdata/sf0.001", algebra.distinct_cells, make.density_blocks
    asked = []
    monkeypatch.setattr(algebra, "distinct_cells", lambda t: asked.append(1) or exact(t))
    want = queries.QUERIES["s16_with_density"](spark, sf).first()
    assert not asked and want.cells == want.places and want.every_row

    def strayed(*x):
        blocks, drawn = plain(*x)
        return blocks, lambda number, count: (drawn(number, count)[0] + 50, *drawn(number, count)[1:])

    monkeypatch.setattr(make, "density_blocks", strayed)
    assert queries.QUERIES["s16_with_density"](spark, sf).first() == want and asked


def test_static_index(spark):
    import bisect

    from tensorframe.sources import index

    rng = random.Random(1)
    lists = {k: sorted({rng.randrange(10_000) for _ in range(n)}) for k, n in enumerate([1, 15, 16, 17, 100, 256, 257, 1000, 4097])}
    ix = index.build(spark.createDataFrame([(k, x) for k, v in lists.items() for x in v for _ in range(1 + (x % 7 == 0))], "list long, x long"))
    start = 0
    for r in index.accessors(ix).orderBy("list").collect():
        n, nodes, total = len(lists[r.list]), -(-len(lists[r.list]) // 16), 0
        while nodes > 1:
            nodes = -(-nodes // 16)
            total += 16 * nodes
        assert (r.len, r.internal_len, r.data_start, r.is_empty) == (n, total, start, False)
        start += n
    asked = spark.createDataFrame([(k, x) for k in lists for x in [*range(-5, 10_005, 197), *lists[k][:20]]], "list long, q long")
    for r in index.find(ix, asked).collect():
        held = lists[r.list]
        at = bisect.bisect_left(held, r.q)
        assert (r.place, r.found) == (at, at < len(held) and held[at] == r.q)
    golden = index.build(spark.createDataFrame([(0, x) for x in (10, 20, 30, 40, 50)], "list long, x long"))
    assert [tuple(r)[2:] for r in index.find(golden, spark.createDataFrame([(0, 30), (0, 25)], "list long, q long")).orderBy("q").collect()] == [(False, 2), (True, 2)]


def test_batched_products(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-4, 5, (2, 3, 7, 5)), rng.integers(-4, 5, (2, 3, 5, 6))
    assert (algebra.batched_matmul(from_numpy(spark, a), from_numpy(spark, b)).to_numpy() == a @ b).all()
    x, y = rng.standard_normal((4, 6)), rng.standard_normal((6, 3))
    assert np.allclose(algebra.batched_matmul(from_numpy(spark, x), from_numpy(spark, y)).to_numpy(), x @ y)
    with pytest.raises(ShapeError):
        algebra.batched_matmul(from_numpy(spark, x), from_numpy(spark, x))


def test_row_entries(spark):
    a = from_rows(spark, [(0, 3, 1), (0, 1, 2), (2, 2, 5)], (3, 4))
    assert sorted(map(tuple, a.row_entry(1).collect())) == [(0, 3, 1)]
    assert [r.v for r in from_rows(spark, [(4, 9), (1, 7)], (5,)).row_entry(1).collect()] == [9]
