"""Embedding near-duplicates: a cover tree over centres, dual traversal over node pairs, exact threshold pairs in leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import components, written

#: Vectors that one cell holds in memory; also how many vectors there are for each leaf of the tree.
CELL = 4096
#: The tree's centres come from at most this many vectors (smallest hashes of the ids), and there are at most MAX_LEAVES.
SAMPLE, MAX_LEAVES = 8192, 1024
#: Visitors compared with a cell at once.
STEP = 1024
#: Vectors of a node that is not split any more; from so many pairs of children on two nodes meet in a matrix product.
LEAF, BLOCK_PAIRS = 16, 4096


def nested_centres(sample: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A farthest-first order of ``count`` unit vectors and each one's level: radii 2, 1, 1/2, ... halve from level to level.

    Every prefix of the order covers the sample within the next centre's insertion radius, so the levels are nested."""
    near = np.full(len(sample), 4.0)
    chosen, level = [], []
    for _ in range(min(count, len(sample))):
        k = 0 if not chosen else int(near.argmax())
        if chosen and near[k] < 1e-12:
            break
        level.append(0 if not chosen else int(max(1, np.floor(1 - 0.5 * np.log2(near[k])))))
        chosen.append(k)
        near = np.minimum(near, np.maximum(0, 2 - 2 * sample @ sample[k]))
    return sample[chosen], np.maximum.accumulate(np.array(level, int))


class Tree:
    """Nested centres; node (level, i) for each centre i of a level up to it. Children of a node are the nearest at the next level."""

    def __init__(self, centres: np.ndarray, level: np.ndarray, leaf_radius: np.ndarray):
        self.centres = centres
        self.gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        self.bottom = int(level.max())
        self.children: dict[tuple[int, int], list[int]] = {}
        for depth in range(self.bottom):
            upper = np.flatnonzero(level <= depth)
            for i in np.flatnonzero(level <= depth + 1):
                parent = i if level[i] <= depth else int(upper[self.gap[i, upper].argmin()])
                self.children.setdefault((depth, parent), []).append(int(i))
        self.radius = {(self.bottom, i): float(r) for i, r in enumerate(leaf_radius)}
        for depth in range(self.bottom - 1, -1, -1):
            for i in np.flatnonzero(level <= depth):
                self.radius[depth, int(i)] = max(self.gap[i, c] + self.radius[depth + 1, c] for c in self.children[depth, int(i)])

    def near_leaves(self, within: float) -> list[tuple[int, int]]:
        """Dual traversal: leaf pairs (i, j), i <= j, that may hold vectors within ``within`` of each other."""
        out, open_ = [], [(0, 0, 0)]
        while open_:
            depth, i, j = open_.pop()
            if i != j and self.gap[i, j] > self.radius[depth, i] + self.radius[depth, j] + within + 1e-6:
                continue  # the covering radii bound every pair below: prune
            if depth == self.bottom:
                out.append((i, j))
                continue
            for x in self.children[depth, i]:
                for y in self.children[depth, j]:
                    if i != j or x <= y:
                        open_.append((depth + 1, min(x, y), max(x, y)))
        return sorted(set(out))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _packed(kind: str):
    def run(batches):
        for batch in batches:
            ids, raw, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and not any(x is None for x in v):
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        ids.append(i), raw.append(x.tobytes()), dims.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["id", "raw", "dim"])

    return run


def _housed(centres: np.ndarray, kind: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cos = _unit(batch.column(1).to_pylist(), kind) @ centres.T
                leaf = cos.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(leaf)), leaf]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32)), pa.array(far)], ["id", "raw", "leaf", "far"])

    return run


def _sent(centres: np.ndarray, kind: str, radius: np.ndarray, blocks: np.ndarray, near: np.ndarray, within: float):
    """Rows (cell, role, id, raw): role 0 in the own cell, role 1 as a visitor of an earlier one that may hold links."""
    base = np.concatenate([[0], np.cumsum(blocks)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            far = np.sqrt(np.maximum(0, 2 - 2 * _unit(batch.column(1).to_pylist(), kind) @ centres.T))
            own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[leaf]
            rows, cells, roles = [np.arange(len(ids))], [base[leaf] + own], [np.zeros(len(ids), np.int32)]
            for i in range(len(blocks)):
                other = np.flatnonzero((leaf > i) & near[i, leaf] & (far[:, i] <= radius[i] + within + 1e-6))
                for b in range(blocks[i]):
                    inside = np.flatnonzero((leaf == i) & (own > b))
                    both = np.concatenate([other, inside])
                    rows.append(both), cells.append(np.full(len(both), base[i] + b)), roles.append(np.ones(len(both), np.int32))
            at = pa.array(np.concatenate(rows))
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(roles)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "role", "id", "raw"])
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)

    return run


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches over edges (u, v)."""
    lab = np.arange(n)
    while True:
        a, b = lab[u], lab[v]
        if (a == b).all():
            return lab
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while (lab[lab] != lab).any():
            lab = lab[lab]


class Cover:
    """A cover tree over the unit vectors of one cell: nested levels whose radii halve, from 2 down to nodes of few or equal vectors.

    Each level's centres lie more than its radius apart and cover their nodes within it; a node's centre is also the first of its children. Nodes keep
    the covering radius that their vectors really have. A node that is not split goes down to the next level as it is."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels: list[dict] = []
        nodes, target = [(0, np.arange(len(x)))] if len(x) else [], 2.0
        while True:
            far = [np.sqrt(max(0.0, float((2 - 2 * x[m] @ x[c]).max()))) for c, m in nodes]
            self.levels.append({"centre": np.array([c for c, _ in nodes], np.int64), "radius": np.array(far)})
            target /= 2
            if not any(len(m) > LEAF and r > 1e-6 for (_, m), r in zip(nodes, far, strict=True)):
                break
            below, first = [], [0]
            for (c, m), r in zip(nodes, far, strict=True):
                below.extend(self._split(c, m, target) if len(m) > LEAF and r > target else [(c, m)])
                first.append(len(below))
            self.levels[-1]["first"], nodes = np.array(first), below
        self.order = np.concatenate([m for _, m in nodes]) if nodes else np.zeros(0, np.int64)
        self.levels[-1]["first"] = np.concatenate([[0], np.cumsum([len(m) for _, m in nodes])]).astype(np.int64)

    @classmethod
    def star(cls, x: np.ndarray) -> Cover:
        """The smallest cover tree of vectors that only visit: a root and every vector below it, with radius 0."""
        tree = cls.__new__(cls)
        n = len(x)
        far = np.sqrt(max(0.0, float((2 - 2 * x @ x[0]).max()))) if n else 0.0
        root = {"centre": np.zeros(min(n, 1), np.int64), "radius": np.array([far][: min(n, 1)]), "first": np.array([0, n][: min(n, 1) + 1])}
        tree.x, tree.order = x, np.arange(n)
        tree.levels = [root, {"centre": np.arange(n), "radius": np.zeros(n), "first": np.arange(n + 1)}]
        return tree

    def _split(self, centre: int, members: np.ndarray, target: float) -> list[tuple[int, np.ndarray]]:
        """Children within ``target``: the centre, then whatever is farthest from all centres so far, until all are covered."""
        part = self.x[members]
        gram = part @ part.T if len(part) <= STEP else None  # one product instead of one for each centre
        near, owner, centres = 2 - 2 * part @ self.x[centre], np.zeros(len(members), np.int64), [centre]
        while near.max() > target * target:
            k = int(near.argmax())
            gap = 2 - 2 * (part @ part[k] if gram is None else gram[k])
            gap[k] = 0
            closer = gap < near
            owner[closer] = len(centres)
            near[closer] = gap[closer]
            centres.append(int(members[k]))
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        return [(c, members[order[cut[i] : cut[i + 1]]]) for i, c in enumerate(centres) if cut[i + 1] > cut[i]]


def _met(pairs, first_a, first_b, xa, xb, reach, same):
    """Children (i, j) of node pairs whose vectors are within ``reach(i, j)`` of each other, and how many pairs were measured.

    Two nodes with many children meet in one matrix product, the others together."""
    a, b = pairs
    na, nb = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    out, measured = [(np.zeros(0, np.int64),) * 2], 0

    def keep(i, j, cos, twin):
        gap = np.sqrt(np.maximum(0, 2 - 2 * cos))
        ok = gap <= reach(i, j)
        if same:
            ok &= ~twin | (i <= j)
        return i[ok], j[ok]

    large = na * nb >= BLOCK_PAIRS
    for k in np.flatnonzero(large):
        js = np.arange(first_b[b[k]], first_b[b[k] + 1])
        for s in range(int(first_a[a[k]]), int(first_a[a[k] + 1]), STEP):
            rows = np.arange(s, min(s + STEP, int(first_a[a[k] + 1])))
            cos = xa(rows) @ xb(js).T
            measured += cos.size
            # a quick bound first: the pair with the widest reach
            i, j = np.nonzero(cos >= 1 - reach(None, None) ** 2 / 2)
            out.append(keep(rows[i], js[j], cos[i, j], np.full(len(i), bool(same and a[k] == b[k]))))
    rest = np.flatnonzero(~large)
    count = (na * nb)[rest]
    total = np.cumsum(count)
    begin = 0
    while begin < len(rest):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 20 * STEP, "right")))
        part, n = rest[begin:end], count[begin:end]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(nb[part], n)
        i, j = np.repeat(first_a[a[part]], n) + at // width, np.repeat(first_b[b[part]], n) + at % width
        measured += len(i)
        out.append(keep(i, j, np.einsum("ij,ij->i", xa(i), xb(j)), np.repeat(a[part] == b[part], n)))
        begin = end
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1)), measured


def near_pairs(one: Cover, two: Cover, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Dual traversal: all (u, v) with cosine >= ``least``, u of ``one`` and v of ``two`` (u < v if they are the same tree), and how many distances it took.

    Both trees go down together; a pair of nodes is left out if its centres are farther apart than both covering radii and the threshold's distance."""
    same = one is two
    if not len(one.x) or not len(two.x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    within = float(np.sqrt(2 - 2 * least)) + 1e-6
    pairs, measured, la, lb = (np.zeros(1, np.int64), np.zeros(1, np.int64)), 0, 0, 0
    while la < len(one.levels) - 1 or lb < len(two.levels) - 1:
        moves = la < len(one.levels) - 1, lb < len(two.levels) - 1
        firsts = [t.levels[k]["first"] if m else np.arange(len(t.levels[k]["centre"]) + 1) for t, k, m in zip((one, two), (la, lb), moves, strict=True)]
        la, lb = la + moves[0], lb + moves[1]
        x, y = one.levels[la], two.levels[lb]

        def reach(i, j, x=x, y=y):
            return within + (x["radius"].max() + y["radius"].max() if i is None else x["radius"][i] + y["radius"][j])

        pairs, n = _met(pairs, *firsts, lambda i, x=x: one.x[x["centre"][i]], lambda j, y=y: two.x[y["centre"][j]], reach, same)
        measured += n
    (i, j), n = _met(pairs, one.levels[la]["first"], two.levels[lb]["first"], lambda i: one.x[one.order[i]], lambda j: two.x[two.order[j]], lambda i, j: within, same)
    u, v = one.order[i], two.order[j]
    ok = np.einsum("ij,ij->i", one.x[u], two.x[v]) >= least
    if same:
        ok &= i < j
        u, v = np.minimum(u, v), np.maximum(u, v)
    return u[ok], v[ok], measured + n


def _linked(kind: str, least: float):
    """Counts of links for each vector and a spanning forest of them: rows (id, other, n)."""

    def forest(ids, vids, u, v, same):
        if not len(u):
            return None
        both = ids if same else np.concatenate([ids, vids])
        order = np.argsort(both, kind="stable")
        rank = np.empty(len(both), np.int64)
        rank[order] = np.arange(len(both))
        x, y = rank[u], rank[v + (0 if same else len(ids))]
        lab = roots(len(both), x, y)
        n = np.bincount(x, minlength=len(both)) + np.bincount(y, minlength=len(both))
        has = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(both[order][has], pa.int64()), pa.array(both[order][lab[has]], pa.int64()), pa.array(n[has], pa.int64())], ["id", "other", "n"])

    def run(batches):
        cell, ids, tree = None, None, None
        pending_ids, pending = [], []

        def settle():
            nonlocal ids, tree, pending_ids, pending
            ids, tree = np.concatenate(pending_ids), Cover(np.concatenate(pending))
            pending_ids, pending = [], []
            u, v, _ = near_pairs(tree, tree, least)
            return forest(ids, ids, u, v, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            c, role = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            vec = _unit(batch.column(3).to_pylist(), kind)
            bid = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (role[1:] != role[:-1])) + 1, [len(c)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                out = None
                if pending and (c[s] != cell or role[s] != 0):
                    out = settle()
                if out is not None:
                    yield out
                if c[s] != cell:
                    cell = c[s]
                    if role[s] != 0:
                        ids = None
                if role[s] == 0:
                    pending_ids.append(bid[s:e]), pending.append(vec[s:e])
                elif ids is not None:
                    for k in range(s, e, STEP):
                        stop = min(k + STEP, e)
                        u, v, _ = near_pairs(tree, Cover.star(vec[k:stop]), least)
                        out = forest(ids, bid[k:stop], u, v, False)
                        if out is not None:
                            yield out
        if pending and (out := settle()) is not None:
            yield out

    return run


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All links cosine >= ``least`` among vectors: vec_id, n_links, component_id, kept.

    A cover tree over nested centres with halving radii (drawn from a bounded sample) houses every vector in a leaf; covering
    radii come from all vectors. Dual traversal prunes node pairs that no link can span, and a vector visits another leaf only if
    the leaf's radius allows it. Large leaves are split into cells, each pair of vectors meets in one cell. A cell's vectors form a cover tree of
    their own, its visitors one of two levels, and dual traversal of these finds the pairs; cells emit counts and a spanning forest instead of pairs. Cosines
    are decided in double precision.

    Null or empty vectors, zero vectors and those with null, NaN or infinite components link with nothing, nor do vectors of
    different length. Ids should be unique; rows without an id are left out. An empty table gives no rows. Other columns are ignored.
    """
    kind = "<f8" if dict(vectors.dtypes)[vec_col] == "array<double>" else "<f4"
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL")
    packed = written(every.mapInArrow(_packed(kind), "id long, raw binary, dim int"))
    within = float(np.sqrt(2 - 2 * least))
    found = None
    for dim, total in sorted((r[0], r[1]) for r in packed.groupBy("dim").count().collect()):
        part = packed.where(F.col("dim") == dim).select("id", "raw")
        sample = _unit([r[0] for r in part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").collect()], kind)
        centres, level = nested_centres(sample, max(1, min(MAX_LEAVES, total // CELL)))
        housed = written(part.mapInArrow(_housed(centres, kind), "id long, raw binary, leaf int, far double"))
        radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for leaf, r, n in housed.groupBy("leaf").agg(F.max("far"), F.count("*")).collect():
            radius[leaf], count[leaf] = r, n
        near = np.zeros((len(centres), len(centres)), bool)
        for i, j in Tree(centres, level, radius).near_leaves(within):
            near[i, j] = True
        blocks = np.maximum(1, -(-count // CELL))
        sent = housed.mapInArrow(_sent(centres, kind, radius, blocks, near, within), "cell long, role int, id long, raw binary")
        cells = int(blocks.sum())
        links = sent.repartition(max(cells, 1), "cell").sortWithinPartitions("cell", "role").mapInArrow(_linked(kind, least), "id long, other long, n long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return every.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    degree = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = every.select("id").join(degree, "id", "left").join(labels, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
