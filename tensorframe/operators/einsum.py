"""Einstein summation over tensors.

Every operand loses its private indices first, operands are joined pairwise in
a planned order, and each join is followed by a sum over the indices that
nobody needs any more. A pair whose operands are known to be dense enough is multiplied in blocks instead
(dense.py). Zeros are dropped. The arithmetic is that of the operands (saturating, if they do; mixed ones are an error)
unless a semiring is given. An operand that is used more than once should be a written table
(Tensor.materialised), so that it is computed once and its size is known.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import Semiring, common
from ..plans import contraction
from ..plans.spec import NonEmptyScalarOutput, Spec, bind, check_outputs, parse_spec
from ..tensor import Tensor
from . import dense


@dataclass(frozen=True)
class EinsumPlan:
    """A parsed spec with its contraction order for given shapes; runs on any tensors of these shapes."""

    spec: Spec
    sizes: dict[str, int]
    shapes: tuple[tuple[int, ...], ...]
    tree: contraction.Leaf | contraction.Pair
    known: bool = False  # whether the operands' sizes are counts rather than guesses

    def explain(self) -> str:
        return f"{','.join(self.spec.inputs)}->{','.join(self.spec.outputs)}\n{contraction.explain(self.tree, self.spec.inputs)}"

    def _contract(self, tensors: tuple[Tensor, ...], ring: Semiring) -> tuple[DataFrame, frozenset[str]]:
        bind(self.spec, [t.shape for t in tensors])
        wanted = frozenset("".join(self.spec.outputs))
        frames: dict[int, DataFrame] = {}
        for k, (letters, t) in enumerate(zip(self.spec.inputs, tensors, strict=True)):
            frames[k] = _summed(*_operand(t, letters), _kept(self.spec, k, wanted), ring)

        def walk(node) -> tuple[DataFrame, frozenset[str]]:
            if isinstance(node, contraction.Leaf):
                return frames[node.number], node.letters
            (a, la), (b, lb) = walk(node.left), walk(node.right)
            if self.known and dense.worthwhile(node, self.sizes, ring):
                return dense.contract(a, la, b, lb, node.letters, self.sizes, ring), node.letters
            b = b.select(*sorted(lb), F.col("v").alias("w"))
            shared = sorted(la & lb)
            both = a.join(b, shared) if shared else a.crossJoin(b)
            out = both.select(*sorted(la | lb), ring.multiply(F.col("v"), F.col("w")).alias("v"))
            return _summed(out, la | lb, node.letters, ring), node.letters

        return walk(self.tree)

    def run(self, *tensors: Tensor, semiring: Semiring | None = None) -> tuple[Tensor, ...]:
        """One tensor per output."""
        ring = semiring or common([t.semiring for t in tensors], [t.kind for t in tensors])
        df, letters = self._contract(tensors, ring)
        out = []
        for o in self.spec.outputs:
            part = _summed(df, letters, frozenset(o), ring)
            if not o:
                cell = part.agg(F.coalesce(F.max("v"), ring.lit(0)).alias("v"))
                out.append(Tensor(cell, (), ring, 1))
                continue
            named = part.filter("v <> 0").select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(o)), "v")
            out.append(Tensor(named, tuple(self.sizes[c] for c in o), ring))
        return tuple(out)

    def grouping_sets(self, *tensors: Tensor, semiring: Semiring | None = None) -> DataFrame:
        """All outputs in one pass over the contraction: output (its number), the letters in order, v."""
        ring = semiring or common([t.semiring for t in tensors], [t.kind for t in tensors])
        df, letters = self._contract(tensors, ring)
        names = sorted(letters)
        sets = list(dict.fromkeys(tuple(sorted(set(o))) for o in self.spec.outputs))
        view = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in names)) if names else df.groupBy()
        rows = view.agg(ring.total(F.col("v")).alias("v"), *([F.grouping_id(*names).alias("g")] if names else [F.lit(0).alias("g")]))
        bits = {s: sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in s) for s in sets}
        numbers = {s: [k for k, o in enumerate(self.spec.outputs) if tuple(sorted(set(o))) == s] for s in sets}
        found = F.lit(None)
        for s in sets:
            found = F.when(F.col("g") == bits[s], F.array(*(F.lit(k) for k in numbers[s]))).otherwise(found)
        return rows.select(F.explode(found).alias("output"), *names, "v").filter("v <> 0")


def _operand(t: Tensor, letters: str) -> tuple[DataFrame, frozenset[str]]:
    """Columns named by letters; a repeated letter keeps the diagonal only."""
    df = t.df
    for k, c in enumerate(letters):
        first = letters.index(c)
        if first != k:
            df = df.filter(F.col(f"i{first}") == F.col(f"i{k}"))
    own = dict.fromkeys(letters)
    return df.select(*(F.col(f"i{letters.index(c)}").alias(c) for c in own), "v"), frozenset(own)


def _kept(spec: Spec, k: int, wanted: frozenset[str]) -> frozenset[str]:
    others = wanted.union(*(spec.inputs[:k] + spec.inputs[k + 1 :]))
    return frozenset(spec.inputs[k]) & others


def _summed(df: DataFrame, letters: frozenset[str], keep: frozenset[str], ring: Semiring) -> DataFrame:
    """Letters outside ``keep`` summed out, zeros dropped."""
    if letters <= keep:
        return df
    names = sorted(letters & keep)
    if names:
        return df.groupBy(*names).agg(ring.total(F.col("v")).alias("v")).filter("v <> 0")
    return df.agg(ring.total(F.col("v")).alias("v")).filter("v <> 0")


def compile_spec(spec: str, shapes: list[tuple[int, ...]], rows: list[float] | None = None, known: bool = True) -> EinsumPlan:
    """Parses, checks and orders a spec for tensors of these shapes (and numbers of cells, if there are any; ``known``: as counted)."""
    parsed = parse_spec(spec, len(shapes))
    sizes = bind(parsed, shapes)
    wanted = frozenset("".join(parsed.outputs))
    kept = [_kept(parsed, k, wanted) for k in range(len(shapes))]
    counts = rows or [float(prod(s)) for s in shapes]
    counts = [min(n, float(prod(sizes[c] for c in x))) for n, x in zip(counts, kept, strict=True)]
    return EinsumPlan(parsed, sizes, tuple(shapes), contraction.plan(kept, wanted, sizes, counts), rows is not None and known)


def einsum(spec: str, *tensors: Tensor, semiring: Semiring | None = None, out_shapes: list[tuple[int, ...]] | None = None):
    """The output tensor, or a tuple of them if the spec has several outputs."""
    plan = compile_spec(spec, [t.shape for t in tensors], [t.estimate for t in tensors], all(t.rows is not None for t in tensors))
    if out_shapes is not None:
        check_outputs(plan.spec, plan.sizes, out_shapes)
    out = plan.run(*tensors, semiring=semiring)
    return out[0] if len(out) == 1 else out


def einsum_unary(spec: str, a: Tensor) -> Tensor:
    parse_spec(spec, 1)
    return einsum(spec, a)


def einsum_binary(spec: str, a: Tensor, b: Tensor) -> Tensor:
    parse_spec(spec, 2)
    return einsum(spec, a, b)


def einsum_scalar(spec: str, *tensors: Tensor):
    """A number; the spec's output must be empty."""
    if parse_spec(spec, len(tensors)).outputs != ("",):
        raise NonEmptyScalarOutput
    return einsum(spec, *tensors).df.first().v


def einsum_fn(spec: str) -> Callable[..., Tensor]:
    """A function of tensors for a fixed spec whose index names may be any identifiers, such as ``row mid, mid col -> row col``."""
    left, arrow, right = spec.partition("->")
    if not arrow:
        parse_spec(spec)
    names = list(dict.fromkeys(spec.replace("->", " ").replace(",", " ").split()))
    short = dict(zip(names, "abcdefghijklmnopqrstuvwxyz", strict=False))
    if len(names) > 26:
        raise ValueError("at most 26 indices")
    side = lambda s: ",".join("".join(short[n] for n in part.split()) for part in s.split(","))
    text = f"{side(left)}->{side(right)}"
    n = text.partition("->")[0].count(",") + 1
    parse_spec(text, n)
    return lambda *tensors, **options: einsum(text, *tensors, **options)


def accumulate(out: Tensor, more: Tensor) -> Tensor:
    """out + more, for results that add to what is there."""
    from .algebra import add

    return add(out, more)


def multiply_count(spec: str, *tensors: Tensor) -> int:
    """Number of products that the (two-operand) contraction forms before any sum."""
    parsed = parse_spec(spec, len(tensors))
    bind(parsed, [t.shape for t in tensors])
    (a, la), (b, lb) = (_operand(t, s) for t, s in zip(tensors, parsed.inputs, strict=True))
    shared = sorted(la & lb)
    if not shared:
        return a.count() * b.count()
    # the size of a join from the counts per key, without forming it
    na, nb = (x.groupBy(*shared).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "n"), (b, "m")))
    return na.join(nb, shared).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("macs")).first().macs
