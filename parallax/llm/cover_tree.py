"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors at cosine ``t`` lie ``sqrt(2 - 2 t)`` apart, so a cosine
threshold is a distance.  Rows are dealt to blocks around pivots from a
bounded sample; two blocks meet only if their covering radii allow a link.
In the task of a pair of blocks each has a cover tree, nested levels with
halving radii, and pairs of nodes are pruned, taken whole or opened by the
same bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._common import remove, save
from .components import connected_components

#: vectors in a block at most (expected), pivots in the sample, points in a leaf
BLOCK, PIVOTS, LEAF = 2048, 128, 24
#: products computed at once inside a task, candidates for centres tried at once
PRODUCTS, CENTRES = 1 << 22, 64
_SLACK = 1e-7


class Node:
    """Points ``order[start:stop]`` within ``radius`` of ``centre``."""

    __slots__ = ("start", "stop", "centre", "radius", "children", "centres", "radii")

    def __init__(self, start: int, stop: int, centre: np.ndarray, radius: float):
        self.start, self.stop, self.centre, self.radius = start, stop, centre, radius
        self.children: list[Node] = []
        self.centres = self.radii = None


class CoverTree:
    """Levels of halving radii; every child's centre is one of its parent's points, the parent's own centre among them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.x, self.leaf = x.copy(), leaf
        radius = float(np.sqrt(((x - x[0]) ** 2).sum(axis=1).max()))
        self.root = Node(0, len(x), self.x[0].copy(), radius)
        level = 2.0
        while level / 2 > radius > 0:
            level /= 2
        todo = [(self.root, level)]
        while todo:
            node, level = todo.pop()
            if node.stop - node.start <= leaf or node.radius <= _SLACK:
                continue
            level /= 2
            while level >= node.radius:  # a level at which the node is its only child
                level /= 2
            todo += [(child, level) for child in self._split(node, level)]

    def _split(self, node: Node, level: float) -> list[Node]:
        """Children within ``level`` of centres that are chosen greedily, points reordered by child."""
        points = np.arange(node.start, node.stop)
        own = self.x[points]
        left, groups = np.arange(len(points)), []
        while len(left):
            # distances to some candidates at once; those that an earlier one covers are no centres
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (own[left] @ own[left[:CENTRES]].T)))
            free = np.ones(len(left), bool)
            for k in range(d.shape[1]):
                if free[k]:
                    near = np.flatnonzero(free & (d[:, k] <= level))
                    groups.append((left[near], float(d[near, k].max())))
                    free[near] = False
            left = left[free]
        moved = np.concatenate([g for g, _ in groups])
        self.order[node.start:node.stop] = self.order[points][moved]
        self.x[node.start:node.stop] = own[moved]
        at = node.start
        for g, radius in groups:
            node.children.append(Node(at, at + len(g), self.x[at].copy(), radius))
            at += len(g)
        node.centres = np.array([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        return node.children


class Links:
    """Link counts and spanning links of one pair of blocks, points numbered a then b."""

    def __init__(self, weight_a: np.ndarray, weight_b: np.ndarray | None):
        self.na = len(weight_a)
        self.wa, self.wb = weight_a, weight_a if weight_b is None else weight_b
        self.count = [np.zeros(len(self.wa), np.int64), np.zeros(len(self.wb), np.int64)]
        self.parent = np.arange(self.na + (0 if weight_b is None else len(weight_b)))
        self.same = weight_b is None

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def add(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """``linked`` (a x b) says which points are linked."""
        shift = 0 if self.same else self.na
        self.count[0][a] += linked @ self.wb[b]
        if not self.same:
            self.count[1][b] += self.wa[a] @ linked
        if linked.all():  # one star connects all
            for i in (*a[1:], *(b + shift)):
                self.join(a[0], i)
            return
        left = np.array([self.find(i) for i in a])
        right = np.array([self.find(j + shift) for j in b])
        for i in np.flatnonzero(linked.any(axis=1)):  # joins as often as components meet, not as often as points do
            met = np.unique(right[linked[i] & (right != left[i])])
            if len(met):
                for root in met:
                    self.join(left[i], root)
                all_roots = np.append(met, left[i])
                for roots in (left, right):
                    roots[np.isin(roots, all_roots)] = all_roots.min()


def dual_traversal(a: CoverTree, b: CoverTree, threshold: float, links: Links) -> None:
    """All pairs with cosine >= ``threshold``; with ``a is b`` each point's own pair is left out.

    With one tree both orders of a pair are visited, so counts on the first
    side are complete."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    same = a is b
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        if p.children and q.children:
            kids_p, kids_q, cp, cq, rp, rq = p.children, q.children, p.centres, q.centres, p.radii, q.radii
        elif p.children or q.children:  # open the one that has children
            kids_p, cp, rp = (p.children, p.centres, p.radii) if p.children else ([p], p.centre[None], np.array([p.radius]))
            kids_q, cq, rq = (q.children, q.centres, q.radii) if q.children else ([q], q.centre[None], np.array([q.radius]))
        else:
            ia, ib = a.order[p.start:p.stop], b.order[q.start:q.stop]
            linked = a.x[p.start:p.stop] @ b.x[q.start:q.stop].T >= threshold
            if same and p is q:
                np.fill_diagonal(linked, False)
            if linked.any():
                links.add(ia, ib, linked)
            continue
        step = max(1, PRODUCTS // len(kids_q))
        n_p, n_q = (np.array([k.stop - k.start for k in kids]) for kids in (kids_p, kids_q))
        for s in range(0, len(kids_p), step):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (cp[s:s + step] @ cq.T)))
            bound = rp[s:s + step, None] + rq[None, :]
            alive = d <= reach + bound + _SLACK
            whole = alive & (d + bound <= reach - _SLACK)
            one_p, one_q = np.flatnonzero(n_p[s:s + step] == 1), np.flatnonzero(n_q == 1)
            if len(one_p) and len(one_q):  # single points need no opening
                at = np.ix_(one_p, one_q)
                linked = alive[at] & (cp[s + one_p] @ cq[one_q].T >= threshold)
                if same and p is q:
                    linked &= (s + one_p)[:, None] != one_q
                if linked.any():
                    links.add(a.order[[kids_p[s + i].start for i in one_p]], b.order[[kids_q[j].start for j in one_q]], linked)
                alive[at] = False
            for i, j in zip(*np.nonzero(alive)):
                kp, kq = kids_p[s + i], kids_q[j]
                if whole[i, j] and not (same and kp is kq):
                    ia, ib = a.order[kp.start:kp.stop], b.order[kq.start:kq.stop]
                    links.add(ia, ib, np.ones((len(ia), len(ib)), bool))
                else:
                    stack.append((kp, kq))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def _cells(classes: DataFrame, pivots: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``classes`` with its nearest pivot of the same dimension (``cell``) and the distance to it (``away``).

    Pivots are a bounded sample by hash; they and nothing else reach the
    driver.  A group is dealt to the first ``cells`` of them (0: not dealt)."""
    found = classes.orderBy(F.xxhash64("h1", "h2")).select("dim", "v").limit(pivots).collect()
    by_dim: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}
    for r in found:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    for n, (dim, rows) in enumerate(sorted(by_dim.items())):
        first[dim] = sum(len(by_dim[d]) for d in sorted(by_dim)[:n])
    by_dim = {dim: _unit(np.array(rows, np.float64)) for dim, rows in by_dim.items()}

    @F.pandas_udf("cell int, away double")
    def nearest(v: pd.Series, cells: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(v), -1), np.full(len(v), 2.0)
        dims = v.map(len).to_numpy() if len(v) else np.empty(0, int)
        for dim in np.unique(dims):
            if dim in by_dim:
                at = np.flatnonzero((dims == dim) & (cells.to_numpy() > 0))
                if not len(at):
                    continue
                cos = _matrix(v.iloc[at]) @ by_dim[dim].T
                cos[np.arange(cos.shape[1]) >= cells.iloc[at].to_numpy()[:, None]] = -2.0
                cell[at] = cos.argmax(axis=1) + first[dim]
                away[at] = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(axis=1)))
        return pd.DataFrame({"cell": cell, "away": away})

    return classes.withColumn("_n", nearest("v", "cells")).withColumns({"cell": F.col("_n.cell"), "away": F.col("_n.away")}).drop("_n"), {
        i + first[dim]: row for dim, rows in by_dim.items() for i, row in enumerate(rows)}


def _meetings(blocks: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Pairs of blocks of one label and dimension that may hold a link: ``(label, dim, a, b)``, a <= b."""
    spark = blocks.sparkSession
    names = sorted(pivots)
    near = [(-1, -1, 0.0)]
    for i in names:
        for j in names:
            if len(pivots[i]) == len(pivots[j]):
                near.append((i, j, float(np.sqrt(max(0.0, 2 - 2 * float(pivots[i] @ pivots[j]))))))
    table = F.broadcast(spark.createDataFrame(near, "ca int, cb int, apart double"))  # at most PIVOTS squared rows
    a = blocks.select("label", "dim", F.col("block").alias("a"), F.col("cell").alias("ca"), F.col("radius").alias("ra"))
    b = blocks.select("label", "dim", F.col("block").alias("b"), F.col("cell").alias("cb"), F.col("radius").alias("rb"))
    both = a.join(b, ["label", "dim"]).where("a <= b").join(table, ["ca", "cb"])
    return both.where(F.col("apart") <= F.col("ra") + F.col("rb") + F.lit(reach + _SLACK)).select("label", "dim", "a", "b")


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
               threshold: float = 0.93, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``(<id>, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Two rows of one label are linked if their cosine, in double precision, is
    at least ``threshold``.  Rows with a null id or label, or a vector that is
    null, empty, zero or holds null or non-finite components, link with
    nothing: no links, a component of their own.  Vectors of different length
    do not compare.  Equal vectors form a class that is compared once;
    repeated rows are rows of their own and link to each other.  The
    component is the smallest id reachable; the row that bears it is kept.
    Other columns are ignored; an empty table gives an empty one."""
    spark, reach = vectors.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v"))
    rows = rows.withColumns({"ok": F.coalesce(usable, F.lit(False)), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    key = ["label", "h1", "h2"]
    classes = (rows.where("ok").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v"))
               .withColumn("dim", F.size("v")))
    classes, c_path = save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # groups that fit in one block stay whole, larger ones are dealt to as many cells as blocks, large cells by hash
    group = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    cells = F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(0).cast("long")
    marked, centres = _cells(classes.join(group, ["label", "dim"]).withColumn("cells", cells), pivots)
    marked, m_path = save(marked.drop("n", "cells"), "cells")
    sizes = marked.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    dealt = (marked.join(sizes.drop("n"), ["label", "dim", "cell"])
             .withColumn("block", F.struct("cell", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))))
    dealt, d_path = save(dealt.select("label", "dim", "block", "cell", "away", "cid", "rep", "w", "v"), "dealt")
    blocks = dealt.groupBy("label", "dim", "block", "cell").agg(F.max("away").alias("radius"))
    blocks = blocks.withColumn("radius", F.when(F.col("cell") < 0, 2.0).otherwise(F.col("radius")))
    meet, p_path = save(_meetings(blocks, centres, reach), "meet")
    data = dealt.select("label", "dim", "block", "cid", "rep", "w", "v")
    first = data.join(meet.withColumn("block", F.col("a")), ["label", "dim", "block"]).withColumn("side", F.lit(0))
    second = data.join(meet.where("a <> b").withColumn("block", F.col("b")), ["label", "dim", "block"]).withColumn("side", F.lit(1))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"])
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        one = len(sides[1]) == 0
        trees = [CoverTree(_matrix(s["v"])) for s in sides[:1 if one else 2]]
        weights = [s["w"].to_numpy(np.int64) for s in sides]
        links = Links(weights[0], None if one else weights[1])
        dual_traversal(trees[0], trees[-1], threshold, links)
        counts = links.count[0] if one else np.concatenate(links.count)
        root = np.array([links.find(i) for i in range(len(links.parent))])
        rep = pdf["rep"].to_numpy()
        out = pd.DataFrame({"cid": pdf["cid"].to_numpy(), "n": counts, "src": rep, "dst": rep[root]})
        return out[(out["n"] > 0)]

    id_type = rows.schema["id"].dataType.simpleString()
    found, f_path = save(first.unionByName(second).groupBy("label", "dim", "a", "b").applyInPandas(
        compare, f"cid long, n long, src {id_type}, dst {id_type}"), "found")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("src", "dst"))
    named = (classes.select("cid", "rep", "w", *key).join(counts, "cid", "left")
             .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
             .select(*key, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    named, _ = save(named, "named")
    remove(spark, c_path, m_path, d_path, p_path, f_path)
    some = rows.where("ok").join(named, key).select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id",
                                         F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
