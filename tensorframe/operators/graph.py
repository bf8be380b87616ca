"""Graphs as square matrices: powers, closure, components, reordering, statistics.

Iterations keep their state in written tables, so lineage stays short and a
lost executor costs one step. Searches append a written table per step and read them as one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.constructors import identity, ranked
from ..sources.storage import partitions, stacked, written, written_small
from ..tensor import Tensor
from .algebra import _square, add, matmul, same_pattern


class NotConverged(RuntimeError):
    """An iteration that did not settle within its limit."""


def _kept(a: Tensor, name: str) -> Tensor:
    return replace(a, df=written(a.df, name))


def power(a: Tensor, k: int) -> Tensor:
    """A^k as A^(k-1) * A; A^0 is the identity."""
    n = _square(a)
    if k == 0:
        return identity(a.df.sparkSession, n, a.semiring)
    out = a
    for step in range(k - 1):
        out = matmul(out, a)
        if step < k - 2:
            out = _kept(out, "power")
    return out


def reachability_sum(a: Tensor, max_iter: int = 10_000) -> tuple[Tensor, int]:
    """A + A^2 + ... until the number of cells stays; the sum and the number of powers in it."""
    _square(a)
    total = last = _kept(a, "sum")
    count = total.nnz()
    for k in range(2, max_iter + 2):
        last = _kept(matmul(last, a), "power")
        total = _kept(add(total, last), "sum")
        if (new := total.nnz()) == count:
            return total, k
        count = new
    raise NotConverged(f"reachability did not settle in {max_iter} steps")


#: Nodes whose pairs with as many others are made from one row.
MEMBERS = 1024


def _together(comp: DataFrame) -> DataFrame:
    """i0, i1: all pairs of nodes with the same comp; made from pairs of member lists, so that a large component fills many tasks."""
    lists = ranked_within(comp, "comp", "node").groupBy("comp", F.expr(f"place div {MEMBERS}").alias("part")).agg(F.collect_list("node").alias("x"))
    lists = written(lists, "members")
    pairs = lists.select("comp", "x").join(lists.select("comp", F.col("x").alias("y")), "comp").repartition(4 * partitions(comp.sparkSession))
    return pairs.select(F.explode("x").alias("i0"), "y").select("i0", F.explode("y").alias("i1"))


def _stable_pattern(a: Tensor, max_iter: int) -> tuple[Tensor, int]:
    """What squaring of a symmetric pattern with a full diagonal comes to: all pairs within a component. 2^k steps reach
    every pair once they are as many as the diameter, and one more squaring shows it."""
    links = a.df.select("i0", "i1", F.lit(1).cast("bigint").alias("v"))
    comp = written(weak_components(Tensor(links, a.shape)), "components")
    links = written(a.df.filter("i0 <> i1").select("i0", "i1"), "neighbours")
    far = 0 if links.isEmpty() else _longest(links, comp)
    k = 1 + max(0, far - 1).bit_length()
    if k > max_iter:
        raise NotConverged(f"the pattern did not settle in {max_iter} squarings")
    return a.with_df(_together(comp).withColumn("v", a.arithmetic.lit(1))), k


def power_until_stable(a: Tensor, max_iter: int = 64) -> tuple[Tensor, int]:
    """Repeated squaring until the pattern stays; the matrix and the number of squarings.

    Squaring forms a product for every path of two cells. For patterns (BOOL) that are symmetric and have a full diagonal the result
    and its number of squarings follow from the components and the diameter, and no product is formed.
    """
    n = _square(a)
    now = _kept(a, "square")
    if a.arithmetic.name == "bool" and now.df.filter("i0 = i1").count() == n and now.df.join(now.transpose().df, now.index, "left_anti").isEmpty():
        return _stable_pattern(now, max_iter)
    for k in range(1, max_iter + 1):
        new = _kept(matmul(now, now), "square")
        if same_pattern(now, new):
            return new, k
        now = new
    raise NotConverged(f"the pattern did not settle in {max_iter} squarings")


def _numbered(labels: DataFrame, name: str) -> DataFrame:
    """node, comp: labels (node, least member) as dense numbers in order of the least member."""
    heads = ranked(labels.select("least").distinct(), "least").select("least", F.col("rank").alias(name))
    return labels.join(heads, "least").select("node", name)


def _spread(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """labels (node, label) with each label lowered to the least one that reaches the node along edges (u, v); only changes go on."""
    front = labels
    while not front.isEmpty():
        told = front.select(F.col("node").alias("u"), "label").join(edges, "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("new"))
        front = written_small(told.join(labels, "node").filter("new < label").select("node", F.col("new").alias("label")), name)
        if front.isEmpty():
            break
        labels = written(labels.join(front.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")), name)
    return labels


def _reached(starts: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """node: the starts and all that edges (u, v) lead to from them."""
    found = front = written_small(starts.select("node"), name)
    parts = [front]
    while True:
        step = front.select(F.col("node").alias("u")).join(edges, "u").select(F.col("v").alias("node")).distinct()
        front = written_small(step.join(found, "node", "left_anti"), name)
        if front.isEmpty():
            return found
        parts.append(front)
        found = stacked(parts)


def strong_components(a: Tensor) -> DataFrame:
    """node, comp: mutual reachability; numbers in order of the smallest member.

    Colouring: every node takes the least node that reaches it; the nodes of a colour that reach its
    first node back are that node's component, of which it is the least. They go, edges between colours
    too, and the rest is coloured anew; nodes without an edge in or out are components by themselves. State
    grows with nodes and edges, never with pairs that reach each other.
    """
    n = _square(a)
    spark = a.df.sparkSession
    edges = written(a.df.filter("i0 <> i1").select(F.col("i0").alias("u"), F.col("i1").alias("v")).distinct(), "strong-edges")
    known = []
    while True:
        # only nodes with edges in and out can lie on a cycle
        size, more = -1, edges.count()
        while more and more != size:
            size = more
            edges = written(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"), "strong-edges")
            more = edges.count()
        if not more:
            break
        nodes = edges.select(F.col("u").alias("node")).distinct()
        colour = _spread(written(nodes.select("node", F.col("node").alias("label")), "colour"), edges, "colour")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"c{end}"))
        same = written(edges.join(of("u"), "u").join(of("v"), "v").filter("cu = cv").select("u", "v"), "strong-edges")
        back = _reached(colour.filter("node = label"), same.select(F.col("v").alias("u"), F.col("u").alias("v")), "strong-back")
        part = written(back.join(colour, "node").select("node", F.col("label").alias("least")), "strong")
        known.append(part)
        gone = part.select("node")
        edges = written(same.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "strong-edges")
    every = spark.range(n).select(F.col("id").alias("node"))
    if not known:
        return every.select("node", F.col("node").alias("comp"))
    labels = every.join(stacked(known), "node", "left").select("node", F.coalesce("least", "node").alias("least"))
    return _numbered(written(labels, "strong"), "comp")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written_small(both.groupBy("u").agg(F.min("v").alias("m")), "least").select("u", F.least("u", "m").alias("m"))
    return written_small(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the greater end) and its smaller neighbours are linked to the smallest of them."""
    least = written_small(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written_small(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def least_members(links: DataFrame) -> DataFrame:
    """node, least for all nodes of links (u, v) that are not the least of their component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    nothing changes; no link passes through the driver. Joins meet written tables on both sides, so
    adaptive execution can split a hub's partition.
    """
    edges = written_small(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    old = None
    while (now := _state(edges)) != old and now[0]:
        old, edges = now, _small_star(_large_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))


def weak_components(a: Tensor) -> DataFrame:
    """node, comp: undirected connection, isolated nodes too; numbers in order of the smallest member."""
    n = _square(a)
    nodes = a.df.sparkSession.range(n).select(F.col("id").alias("node"))
    least = least_members(a.df.select(F.col("i0").alias("u"), F.col("i1").alias("v")))
    labels = nodes.join(least, "node", "left").select("node", F.coalesce("least", "node").alias("least"))
    return _numbered(written(labels, "weak"), "comp")


def count_components(components: DataFrame) -> int:
    return components.select("comp").distinct().count()


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def top_sizes(components: DataFrame, k: int = 10) -> DataFrame:
    """The k largest components."""
    return component_sizes(components).orderBy(F.desc("size"), "comp").limit(k)


def bandwidth(a: Tensor) -> DataFrame:
    """Greatest and mean distance of a cell from the diagonal."""
    gap = F.abs(F.col("i0") - F.col("i1"))
    return a.df.agg(F.coalesce(F.max(gap), F.lit(0)).cast("bigint").alias("max_bw"), (F.coalesce(F.sum(gap), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_bw"))


def degrees(a: Tensor) -> DataFrame:
    """node, degree: stored cells of every row, 0 included."""
    nodes = a.df.sparkSession.range(a.shape[0]).select(F.col("id").alias("node"))
    own = a.df.groupBy(F.col("i0").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_stats(a: Tensor) -> DataFrame:
    """min, median (the element n // 2 of the sorted degrees), mean and max degree, from the histogram of degrees."""
    hist = degrees(a).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)  # a row per distinct degree
    half = F.lit(a.shape[0] // 2)
    run = hist.select("degree", "n", F.sum("n").over(up).alias("upto"))
    return run.agg(
        F.min("degree").alias("min_deg"),
        F.min(F.when(F.col("upto") > half, F.col("degree"))).alias("median_deg"),
        (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("avg_deg"),
        F.max("degree").alias("max_deg"),
    )


def neighbours_by_degree(a: Tensor) -> DataFrame:
    """node, neighbour, place: the neighbours of every node, those of least degree (then least number) first."""
    own = degrees(a).select(F.col("node").alias("i1"), "degree")
    return ranked_within(a.df.select("i0", "i1").join(own, "i1"), "i0", "degree", "i1").select(F.col("i0").alias("node"), F.col("i1").alias("neighbour"), "place")


def ranked_within(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with place: the row's place (from 0) among those of its key; by a range sort, so that one key can fill many partitions."""
    every = ranked(df, key, *order)
    heads = every.groupBy(key).agg(F.min("rank").alias("_head"))
    return every.join(heads, key).withColumn("place", (F.col("rank") - F.col("_head")).cast("bigint")).drop("rank", "_head")


def permute(a: Tensor, perm: DataFrame) -> Tensor:
    """Rows and columns renumbered by perm (new_id, old_id)."""
    _square(a)
    row = perm.select(F.col("old_id").alias("i0"), F.col("new_id").alias("r"))
    col = perm.select(F.col("old_id").alias("i1"), F.col("new_id").alias("c"))
    return a.with_df(a.df.join(row, "i0").join(col, "i1").select(F.col("r").alias("i0"), F.col("c").alias("i1"), "v"))


def unpermute(a: Tensor, perm: DataFrame | None) -> Tensor:
    """Undoes permute(); without a permutation nothing happens."""
    return a if perm is None else permute(a, perm.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")))


def _levels(neighbours: DataFrame, starts: DataFrame) -> DataFrame:
    """node, root, level: distance from the start of each component (starts: node, root) in a graph with edges both ways.

    A level's neighbours lie on the level before, itself or the next, so a step meets two levels and
    appends one; nothing is written twice.
    """
    front = written_small(starts.select("node", "root", F.lit(0).alias("level")), "level")
    parts = [front]
    while not front.isEmpty():
        step = front.select(F.col("node").alias("i0"), "root").join(neighbours, "i0").select(F.col("i1").alias("node"), "root").distinct()
        for old in parts[-2:]:
            step = step.join(old, ["node", "root"], "left_anti")
        front = written_small(step.withColumn("level", F.lit(len(parts))), "level")
        parts.append(front)
    return stacked(parts)


def rcm(a: Tensor) -> DataFrame:
    """Reverse Cuthill-McKee ordering of the symmetrised pattern: new_id, old_id.

    All components are ordered at once, level by level: a node follows the
    first of its parents, then degree, then id. Each component starts at the node of least degree
    on the last level seen from its node of least degree. A level is ranked by a range sort and
    appended; a parent's place counts within its level.
    """
    n = _square(a)
    spark = a.df.sparkSession
    both = a.df.select("i0", "i1").unionByName(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"))).filter("i0 <> i1").distinct()
    both = written(both, "neighbours")
    deg = spark.range(n).select(F.col("id").alias("node")).join(both.groupBy(F.col("i0").alias("node")).count(), "node", "left")
    deg = written(deg.select("node", F.coalesce("count", F.lit(0)).alias("degree")), "degrees")
    comp = written(weak_components(Tensor(both.select("i0", "i1", F.lit(1).cast("bigint").alias("v")), (n, n))), "components")
    known = written(deg.join(comp, "node"), "known")
    first = known.groupBy("comp").agg(F.min(F.struct("degree", "node")).alias("x")).select(F.col("x.node").alias("node"), F.col("comp").alias("root"))
    far = _levels(both, first).join(known, "node")
    start = far.groupBy("comp").agg(F.min(F.struct(-F.col("level"), "degree", "node")).alias("x")).select(F.col("x.node").alias("node"), "comp")
    front = written_small(start.select("node", "comp", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("place")), "order")
    parts = [front]
    while not front.isEmpty():
        new = front.select(F.col("node").alias("i0"), F.col("place").alias("p")).join(both, "i0").groupBy(F.col("i1").alias("node")).agg(F.min("p").alias("parent"))
        for old in parts[-2:]:
            new = new.join(old, "node", "left_anti")
        placed = ranked(new.join(known, "node"), "comp", "parent", "degree", "node")
        front = written_small(placed.select("node", "comp", F.lit(len(parts)).alias("level"), F.col("rank").cast("bigint").alias("place")), "order")
        parts.append(front)
    placed = ranked(stacked(parts), "comp", "level", "place")
    return placed.select((F.lit(n - 1) - F.col("rank")).cast("bigint").alias("new_id"), F.col("node").alias("old_id"))


#: Nodes from which distances are searched at once.
SOURCES = 256


def diameter(a: Tensor) -> int:
    """Greatest distance between connected nodes of the undirected graph; 0 without edges."""
    n = _square(a)
    both = a.df.select("i0", "i1").unionByName(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"))).filter("i0 <> i1").distinct()
    both = written(both, "neighbours")
    if both.isEmpty():
        return 0
    return _longest(both, written(weak_components(Tensor(both.select("i0", "i1", F.lit(1).cast("bigint").alias("v")), (n, n))), "components"))


def _longest(both: DataFrame, comp: DataFrame) -> int:
    """The diameter from edges of both directions (i0, i1; at least one, no loops) and the components (node, comp).

    Two nodes on levels of at most d / 2 from a root are at most d apart. So, after a distance d has been found by
    searching from a node farthest from each component's root, only nodes on deeper levels are searched from, the deepest
    first, SOURCES at a time, until d rules out the rest. The root is the node of most neighbours or, where that leaves fewer nodes, the
    middle of a longest path found. Leaves of one node are as far from everything as each other: one of them is searched from.
    """
    near = written(both.groupBy(F.col("i0").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("i1").alias("only")), "degrees")
    deepest = lambda levels: levels.agg(F.max("level").alias("d")).first().d
    first = lambda nodes, key, *order: nodes.groupBy(key).agg(F.min(F.struct(*order, "node")).alias("x")).select(F.col("x.node").alias("node"), F.col(key).alias("root"))
    beyond = lambda levels, d: levels.filter(F.col("level") * 2 > d)
    levels = _levels(both, first(near.join(comp, "node"), "comp", -F.col("degree")))
    ahead = _levels(both, first(levels, "root", -F.col("level")))
    found = max(deepest(levels), deepest(ahead))
    if not beyond(levels, found).isEmpty():
        back = _levels(both, first(ahead, "root", -F.col("level")))
        found = max(found, deepest(back))
        ends = ahead.groupBy("root").agg(F.max("level").alias("long"))
        path = ahead.join(back.select("node", "root", F.col("level").alias("rest")), ["node", "root"]).join(ends, "root")
        halves = path.filter("level + rest = long and level = long div 2").join(near, "node")
        middle = _levels(both, first(halves, "root", -F.col("degree")))
        found = max(found, deepest(middle))
        left = lambda x, name: beyond(x, found).groupBy("root").agg(F.count(F.lit(1)).alias(name))
        better = left(levels, "n").join(left(middle, "m"), "root", "left").filter("coalesce(m, 0) < n").select("root")
        levels = levels.join(better, "root", "left_anti").unionByName(middle.join(better, "root", "left_semi"))
    deep = beyond(levels, found).join(near, "node").select("node", "level", F.when(F.col("degree") == 1, F.col("only")).otherwise(F.col("node")).alias("at"), (F.col("degree") == 1).alias("leaf"))
    deep = deep.groupBy("at", "leaf").agg(F.min(F.struct("node", "level")).alias("x")).select("x.node", "x.level", (-F.col("x.level")).alias("up"))
    deep = written(ranked(deep, "up", "node"), "deep")
    todo, done = deep.count(), 0
    while done < todo:
        some = deep.filter((F.col("rank") >= done) & (F.col("rank") < done + SOURCES))
        if 2 * deepest(some) <= found:
            break
        found = max(found, deepest(_levels(both, some.select("node", F.col("node").alias("root")))))
        done += SOURCES
    return found


def structure(a: Tensor, reorder: bool = True) -> dict:
    """A report: components, degrees, bandwidth before and after reordering, and the ratios."""
    comp = written(weak_components(a), "components")
    sizes = component_sizes(comp)
    out = {"nodes": a.shape[0], "nnz": a.nnz(), "components": count_components(comp)}
    out["top_sizes"] = [r["size"] for r in top_sizes(comp).collect()]
    out["singletons"] = sizes.filter("size = 1").count()
    out |= degree_stats(a).first().asDict() | bandwidth(a).first().asDict()
    if reorder:
        new = bandwidth(permute(a, written(rcm(a), "rcm"))).first()
        out |= {"max_bw_rcm": new.max_bw, "avg_bw_rcm": new.avg_bw}
        out |= {"max_reduction": out["max_bw"] / max(new.max_bw, 1), "avg_reduction": out["avg_bw"] / max(new.avg_bw, 0.001)}
    return out
