import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.functions.semiring import SAT_U32, SAT_U64
from tensorframe.operators import algebra
from tensorframe.operators.einsum import accumulate, compile_spec, einsum, einsum_binary, einsum_fn, einsum_scalar, einsum_unary, multiply_count
from tensorframe.plans import spec as S
from tensorframe.sources import constructors as make
from tensorframe.tensor import ShapeError, Tensor, from_numpy, from_rows


def seq(*shape, start=1):
    return np.arange(start, start + int(np.prod(shape))).reshape(shape)


@pytest.mark.parametrize(
    "spec, inputs, want",
    [
        ("ab,bc->ac", [seq(2, 3), seq(3, 2, start=7)], [58, 64, 139, 154]),
        ("ab->ba", [seq(2, 3)], [1, 4, 2, 5, 3, 6]),
        ("i,i->", [seq(4), seq(4, start=5)], 70),
        ("aa->", [seq(3, 3)], 15),
        ("ab,bc,cd->ad", [seq(2, 3), np.eye(3, 4, dtype=int), seq(4, 2)], [22, 28, 49, 64]),
        ("a,b->ab", [seq(3), seq(2, start=4)], [4, 5, 8, 10, 12, 15]),
        ("a,ab->b", [seq(2), seq(2, 2, start=3)], [13, 16]),
        ("ab,ab->", [seq(2, 2), seq(2, 2)], 30),
        ("i,i,i->", [seq(3), seq(3, start=4), seq(3, start=7)], 270),
        (" a b , b c -> a c ", [np.array([[1, 1, 1]]), np.array([[1], [-1], [5]])], [5]),
        ("ab,bc->ac", [np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0]]), seq(3, 2)], [3, 4, 5, 6, 1, 2]),
        ("ab,bc->ac", [np.array([[0, 2, 3], [1, 0, 0]]), seq(3, 4)], [37, 42, 47, 52, 1, 2, 3, 4]),
        ("acd->cd", [seq(2, 3, 4)], seq(2, 3, 4).sum(axis=0).reshape(-1).tolist()),
        ("a->aa", [seq(3)], np.diag([1, 2, 3]).reshape(-1).tolist()),
    ],
)
def test_goldens(spark, spec, inputs, want):
    out = einsum(spec, *(from_numpy(spark, x) for x in inputs)).to_numpy()
    assert out.reshape(-1).tolist() == (want if isinstance(want, list) else [want])


def test_batched_compressed_rows(spark):
    a = make.parts_of_arrays(spark, [0, 2, 3, 4, 5], [0, 1, 1, 0, 0], [1, 2, 3, 4, 5], (2, 2, 2))
    b = seq(2, 2, 3)
    out = einsum("bij,bjk->bik", a, from_numpy(spark, b)).to_numpy().astype(int)
    assert out[0, 1].tolist() == [12, 15, 18]
    assert (out == np.einsum("bij,bjk->bik", a.to_numpy().astype(int), b)).all()


def test_several_outputs(spark):
    a, b = from_numpy(spark, seq(2, 2)), from_numpy(spark, seq(2, 2, start=5))
    x, y = einsum("ab,bc->ac,ca", a, b)
    assert x.to_numpy().reshape(-1).tolist() == [19, 22, 43, 50] and y.to_numpy().reshape(-1).tolist() == [19, 43, 22, 50]
    x, y = einsum("ab,bc->ac,", a, b)
    assert x.to_numpy().sum() == y.df.first().v == 134
    p = from_rows(spark, [(0, 1, 2), (1, 2, 3)], (3, 3))
    q = from_rows(spark, [(1, 0, 5), (2, 2, 6)], (3, 3))
    for t in einsum("ab,bc->ac,ac", p, q):
        assert sorted(map(tuple, t.df.collect())) == [(0, 0, 10), (1, 2, 18)]
    rows = {(r.output, r.a, r.c): r.v for r in compile_spec("ab,bc->,ac", [(3, 3), (3, 3)]).grouping_sets(p, q).collect()}
    assert rows == {(0, None, None): 28, (1, 0, 0): 10, (1, 1, 2): 18}


def test_cyclic_against_itself(spark):
    c = from_rows(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1)], (3, 3))
    assert sorted(map(tuple, einsum("ab,cb->ac", c, c).df.collect())) == [(i, i, 1) for i in range(3)]
    assert sorted(map(tuple, einsum("ab,bc->ac", c, c).df.collect())) == [(0, 2, 1), (1, 0, 1), (2, 1, 1)]


def test_attention(spark):
    b, h, q, k, d = 2, 2, 3, 2, 4
    Q = np.fromfunction(lambda b, h, q, d: (b + 1) * (h + 1) * (q + 1) + d, (b, h, q, d), dtype=int)
    K = np.fromfunction(lambda b, h, k, d: (b + 1) * (h + 1) * (k + 1) * (d + 1), (b, h, k, d), dtype=int)
    x, y = from_numpy(spark, Q), from_numpy(spark, K)
    assert (einsum("bhqd,bhkd->bhqk", x, y).to_numpy() == np.einsum("bhqd,bhkd->bhqk", Q, K)).all()
    assert multiply_count("bhqd,bhkd->bhqk", x, y) == b * h * q * k * d


@pytest.mark.parametrize(
    "spec, shapes, error",
    [
        ("ab,bc", [(2, 3), (3, 2)], S.MissingArrow()),
        ("ab,bc->az", [(2, 3), (3, 2)], S.UnboundOutputIndex(index="z")),
        ("aB,bc->ac", [(2, 3), (3, 2)], S.InvalidIndex(ch="B")),
        ("a\tb->a", [(2, 3)], S.InvalidIndex(ch="\t")),
        ("ab->a.", [(2, 3)], S.InvalidIndex(ch=".")),
        ("ab,bc->ac", [(2, 3)], S.WrongInputCount(expected=1, got=2)),
        ("ab,->a", [(2, 3), ()], S.EmptyInput(input=1)),
        ("ab,bc->ac", [(2,), (3, 2)], S.InputNdimMismatch(input=0, array_ndim=1, spec_ndim=2)),
        ("ab,bc->ac", [(2, 3), (4, 2)], S.DimensionMismatch(index="b", expected=3, got=4)),
    ],
)
def test_errors(spec, shapes, error):
    with pytest.raises(type(error)) as got:
        compile_spec(spec, shapes)
    assert got.value == error and str(got.value) == str(error)


def test_output_errors(spark):
    a = from_numpy(spark, seq(2, 3))
    with pytest.raises(S.OutputNdimMismatch):
        einsum("ab->a", a, out_shapes=[(2, 3)])
    with pytest.raises(S.OutputDimMismatch) as got:
        einsum("ab->ba", a, out_shapes=[(2, 3)])
    assert str(got.value) == "output dimension 0 is 2 but expected 3"
    with pytest.raises(S.WrongInputCount):
        einsum("ab->ba", a, out_shapes=[(3, 2), (3, 2)])
    with pytest.raises(S.NonEmptyScalarOutput):
        einsum_scalar("ab->a", a)
    assert einsum_scalar("ab->", a) == 21


def test_entry_points(spark):
    a, b = from_numpy(spark, seq(2, 3)), from_numpy(spark, seq(3, 2, start=7))
    assert einsum_unary("ab->b", a).to_numpy().tolist() == [5, 7, 9]
    assert einsum_binary("ab,bc->ac", a, b).to_numpy().reshape(-1).tolist() == [58, 64, 139, 154]
    product = einsum_fn("i mid, mid j -> i j")
    assert product(a, b).to_numpy().reshape(-1).tolist() == [58, 64, 139, 154]
    with pytest.raises(S.UnboundOutputIndex):
        einsum_fn("i j -> k")
    twice = accumulate(product(a, b), product(a, b))
    assert twice.to_numpy().reshape(-1).tolist() == [116, 128, 278, 308]
    plan = compile_spec("ab,bc,cd->ad", [(2, 3), (3, 4), (4, 2)])
    assert plan.explain().startswith("ab,bc,cd->ad\njoin on")


def test_sweep(spark):
    """Random specs over a, b, c, d with sizes 2 to 5 against numpy, exact integers."""
    rng = random.Random(11)
    size = dict(zip("abcd", (2, 3, 4, 5), strict=True))
    values = np.random.default_rng(5)
    for _ in range(45):
        inputs = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 2, 2, 3]))]
        letters = sorted(set("".join(inputs)))
        out = "".join(rng.sample(letters, rng.randint(0, len(letters))))
        arrays = [values.integers(-2, 3, [size[c] for c in x]) for x in inputs]
        spec = f"{','.join(inputs)}->{out}"
        got = einsum(spec, *(from_numpy(spark, x) for x in arrays)).to_numpy().astype(int)
        assert (got == np.einsum(spec, *arrays)).all(), spec


def test_long_chains_use_the_greedy_order(spark):
    arrays = [np.random.default_rng(k).integers(0, 3, (3, 3)) for k in range(7)]
    spec = "ab,bc,cd,de,ef,fg,gh->ah"
    assert (einsum(spec, *(from_numpy(spark, x) for x in arrays)).to_numpy().astype(int) == np.linalg.multi_dot(arrays)).all()


def test_saturation(spark):
    big = 2**32 - 1
    a = from_rows(spark, [(0, 0, big)], (1, 1), semiring=SAT_U32())
    two = from_rows(spark, [(0, 0, 2)], (1, 1), semiring=SAT_U32())
    assert algebra.matmul(a, two).get(0, 0) == big
    assert algebra.add(a, two).get(0, 0) == big
    x = from_rows(spark, [(0, 0, 2**63 - 1)], (1, 1))
    x = x.with_df(x.df.withColumn("v", x.df.v.cast("decimal(20,0)")))
    assert int(algebra.matmul(x, x, SAT_U64()).get(0, 0)) == 2**64 - 1


def test_shapes(spark):
    a = from_numpy(spark, seq(2, 3))
    with pytest.raises(ShapeError):
        algebra.add(a, a.transpose())
    with pytest.raises(ShapeError):
        algebra.matmul(a, a)
    b = from_rows(spark, [(0, 1, 5), (1, 0, 7)], (2, 3))
    c = from_rows(spark, [(0, 1, 3), (1, 2, 9)], (2, 3))
    assert sorted(map(tuple, algebra.add(b, c).df.collect())) == [(0, 1, 8), (1, 0, 7), (1, 2, 9)]
    assert a.get(1, 2) == 6 and b.get(0, 0) == 0 and b.get_opt(0, 0) is None
    assert from_rows(spark, [(0, 0, 2), (0, 0, -2), (0, 1, 1)], (1, 2)).nnz() == 1


def test_sorted_search(spark):
    x = spark.createDataFrame([(v,) for v in (10, 20, 30, 40, 50)], "x bigint")
    q = spark.createDataFrame([(v,) for v in (30, 25, 5, 60, 10)], "q bigint")
    assert {r.q: (r.found, r.place) for r in algebra.search(x, q).collect()} == {30: (True, 2), 25: (False, 2), 5: (False, 0), 60: (False, 5), 10: (True, 0)}


# ---- arithmetic of the operands


def test_saturating_operands(spark):
    from tensorframe.functions.semiring import SAT_U32, SAT_U64, MixedSemirings

    a, b = (from_rows(spark, [(0, 0, v)], (1, 1), semiring=SAT_U32()) for v in (4294967295, 2))
    assert einsum("ab,bc->ac", a, b).get(0, 0) == 4294967295
    assert einsum_scalar("ab,bc->", a, b) == 4294967295
    x = from_rows(spark, [(0, 0, Decimal(2**63)), (0, 1, Decimal(2**63))], (1, 2), "decimal(20,0)", SAT_U64())
    assert einsum("ab->a", x).get(0) == 2**64 - 1
    with pytest.raises(MixedSemirings):
        einsum("ab,bc->ac", a, from_rows(spark, [(0, 0, 2)], (1, 1)))
    with pytest.raises(MixedSemirings):
        einsum("ab,bc->ac", a, x)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_blocks_equal_joins(spark, monkeypatch, kind):
    from tensorframe.operators import dense

    rng = np.random.default_rng(4)
    for name, value in (("LEAST", 0), ("SIDE", 3), ("INNER", 4), ("WORTH", 10**9)):
        monkeypatch.setattr(dense, name, value)
    cases = [("ab,bc->ac", (7, 9), (9, 5)), ("gab,gcb->gac", (2, 4, 6), (2, 5, 6)), ("ab,cb->ac", (1, 5), (8, 5)), ("abc,bcd->ad", (3, 4, 5), (4, 5, 7)), ("ab,b->a", (6, 7), (7,)), ("gab,bgh->gah", (2, 3, 4), (4, 2, 5)), ("ab,bc,cd->ad", (4, 5), (5, 6))]
    for spec, p, q in cases:
        arrays = [rng.integers(-3, 4, p) * (rng.random(p) < 0.6), rng.integers(-3, 4, q) * (rng.random(q) < 0.6)]
        if spec.count(",") == 2:
            arrays.append(rng.integers(-3, 4, (q[1], 4)))
        tensors = [from_numpy(spark, x, kind).materialised() for x in arrays]
        plan = compile_spec(spec, [t.shape for t in tensors], [t.estimate for t in tensors])
        assert dense.worthwhile(plan.tree, plan.sizes, tensors[0].arithmetic)
        assert np.array_equal(einsum(spec, *tensors).to_numpy().astype(float), np.einsum(spec, *arrays))


def test_blocks_are_exact_and_leave_absent_cells_out(spark, monkeypatch):
    from tensorframe.operators import dense

    monkeypatch.setattr(dense, "LEAST", 0)
    big = np.array([[2**31, 3], [5, -(2**31)]], dtype=object)
    t = from_rows(spark, [(i, j, int(big[i, j])) for i in range(2) for j in range(2)], (2, 2)).materialised()
    assert (einsum("ab,bc->ac", t, t).to_numpy() == big @ big).all()
    assert dense.exact_product(np.array([[2**40, 1]]), np.array([[2**20, 2**61]])).tolist() == [[2**60 + 2**61]]
    with pytest.raises(OverflowError):
        dense.exact_product(np.array([[2**40]]), np.array([[2**40]]))
    inf = from_rows(spark, [(0, 0, float("inf")), (1, 1, 2.0)], (2, 2), "double").materialised()
    got = {(r.i0, r.i1): r.v for r in einsum("ab,bc->ac", inf, inf).df.collect()}
    assert got == {(0, 0): float("inf"), (1, 1): 4.0}


def test_blocks_of_spread_rows_are_sent_a_few_times(spark, monkeypatch):
    """Rows of a batch that lie far apart share blocks, so a cell is not sent once for every SIDE places of the other side."""
    from tensorframe.operators import dense

    for name, value in (("LEAST", 0), ("SIDE", 4), ("INNER", 8), ("WORTH", 10**9)):
        monkeypatch.setattr(dense, name, value)
    sent, send = [], dense.paired
    monkeypatch.setattr(dense, "paired", lambda *given: sent.append(send(*given)) or sent[-1])
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (3, 600, 6)) * (np.arange(600) * 7 % 3 == np.arange(3)[:, None])[:, :, None] * (rng.random((3, 600, 6)) < 0.5)
    t = from_numpy(spark, x).materialised()
    want = np.einsum("gab,gcb->gac", x, x)
    halves = einsum("ghab,ghcb->ghac", *[Tensor(t.df.select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), F.col("i1").alias("i2"), F.col("i2").alias("i3"), "v"), (1, *t.shape), rows=t.rows)] * 2)
    assert np.array_equal(halves.to_numpy()[0].astype(int), want)
    assert sent[-1].count() < 10_000  # 150 * 150 * 2 * 3 with blocks of SIDE places
    assert np.array_equal(algebra.batched_matmul(t, t.transpose(0, 2, 1)).to_numpy().astype(int), want)
    assert sent[-1].count() < 10_000
    assert np.array_equal(einsum("bqd,bkd->bqk", t, t).to_numpy().astype(int), want)
    assert sent[-1].count() < 10_000 and len(sent) == 3


def test_blocks_are_sent_in_few_bytes(spark, monkeypatch):
    """t2_batched_scores: small integers take about a byte each where a block is sent for each that it meets."""
    from tensorframe.operators import dense

    sent, send = [], dense.paired
    monkeypatch.setattr(dense, "paired", lambda *given: sent.append(send(*given)) or sent[-1])
    x = np.random.default_rng(8).integers(-50, 51, (2, 300, 64))
    t = from_numpy(spark, x).materialised()
    got = algebra.batched_matmul(t, t.transpose(0, 2, 1))
    assert sent[-1].toArrow().nbytes < 2 * 4 * x.size  # each cell 4 times: to two blocks of the other side, as row and as column
    assert np.array_equal(got.to_numpy().astype(int), np.einsum("gab,gcb->gac", x, x))


def test_packed_cells_keep_their_values(spark, monkeypatch):
    from tensorframe.operators import dense

    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "PIECE", 5)
    for values in ([-1, 2**62 - 1], [-(2**62), 127], [-129, 2**31], [2**53 + 1, -3]):
        t = from_rows(spark, [(0, i, 0, v) for i, v in enumerate(values)], (1, 2, 1)).materialised()
        one = from_rows(spark, [(0, 0, 0, 1)], (1, 1, 1)).materialised()
        assert {(r.i1, r.v) for r in einsum("gab,gbc->gac", t, one).df.collect()} == set(enumerate(values))
    nan = from_rows(spark, [(0, 0, 0, float("nan")), (0, 1, 0, 0.1)], (1, 2, 1), "double").materialised()
    got = {(r.i1, r.i2): r.v for r in einsum("gab,gcb->gac", nan, nan).df.collect()}
    assert got[1, 1] == 0.1 * 0.1 and all(np.isnan(got[k]) for k in ((0, 0), (0, 1), (1, 0)))
    far = from_rows(spark, [(g, 7 * i, 300 * i, g + i) for g in range(1, 3) for i in range(1, 40)], (3, 300, 12_000)).materialised()
    assert {(r.i0, r.i1, r.i2): r.v for r in algebra.batched_matmul(far, far.transpose(0, 2, 1)).df.collect()} == {(g, 7 * i, 7 * i): (g + i) ** 2 for g in range(1, 3) for i in range(1, 40)}
    null = spark.createDataFrame([(None, 0, 0, 5), (0, 1, 0, 3)], "i0 bigint, i1 bigint, i2 bigint, v bigint")  # as a join: no label, no pair
    half = Tensor(null, (1, 2, 1), rows=2)
    assert [tuple(r) for r in einsum("gab,gcb->gac", half, half).df.collect()] == [(0, 1, 1, 9)]


def test_blocks_hold_as_many_rows_as_they_may(spark, monkeypatch):
    """t1_attention: rows that lie close in one place do not narrow every block, so each cell is sent to fewer."""
    from tensorframe.operators import dense

    for name, value in (("LEAST", 0), ("SIDE", 4), ("INNER", 8), ("WORTH", 10**9)):
        monkeypatch.setattr(dense, name, value)
    sent, send = [], dense.paired
    monkeypatch.setattr(dense, "paired", lambda *given: sent.append(send(*given)) or sent[-1])
    there = np.arange(1200) % 4 == 1
    there[800:804] = True  # four of SIDE places, elsewhere one
    x = np.random.default_rng(9).integers(1, 4, (2, 1200, 3)) * there[None, :, None]
    t = from_numpy(spark, x).materialised()
    assert np.array_equal(einsum("bqd,bkd->bqk", t, t).to_numpy().astype(int), np.einsum("gab,gcb->gac", x, x))
    blocks = 11  # of 303 rows by 28 to 32; 38 of them with 8 SIDE places each
    assert sent[-1].count() <= 2 * 2 * blocks**2 * 3
    assert dense.spans(t.named("bqd"), t.named("bkd"), ["b"], ["q"], ["k"], {"b": 2, "q": 1200, "k": 1200}, 1)[0] * blocks >= 1200


def test_sparse_operands_are_joined(spark):
    from tensorframe.operators import dense

    n = 100_000
    plan = compile_spec("ab,bc->ac", [(n, n), (n, n)], [3.0 * n, 3.0 * n])
    assert not dense.worthwhile(plan.tree, plan.sizes, from_rows(spark, [], (1,)).arithmetic)
    unknown = compile_spec("ab,bc->ac", [(2000, 2000)] * 2, [4e6, 4e6], False)
    assert not unknown.known
