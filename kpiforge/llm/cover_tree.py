"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors of one label (and length) form a tree whose nodes are balls
around a point of theirs; a node's own centre is one of its children's
centres (nested levels).  The upper levels are split on Spark until a node
holds at most LEAF_POINTS points; every split deals a node's points over
salted groups, so a label with a third of all rows is no single task.  Node
pairs are then refined level by level and dropped when the distance of their
centres exceeds both covering radii plus the link distance.  Surviving pairs
of lower nodes are finished in tasks: cover trees with halving radii, the
same dual traversal, and exact cosines for what is left.

Equal unit vectors are one point with a multiplicity, and a task returns
link counts and spanning links of what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import components, hot_split_join, prepare, written

MIN_COSINE = 0.98
LEAF_POINTS = 4096
FAN_OUT = 32
GROUP_POINTS = 8192
# Radii of the levels in a task's trees: halved from the first to the last.
FIRST_RADIUS, LAST_RADIUS = 1.0, 0.0625
SLACK = 1e-9  # over rounding errors when pruning


def reach(min_cosine: float) -> float:
    """Distance of unit vectors whose cosine is ``min_cosine``."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * min_cosine)))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = col.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1)


# ------------------------------------------------------------------- trees in a task


class Tree:
    """Nested levels over the rows of ``x``: per level the node of each point, and each node's centre and radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # node of point, centre, radius, parent
        n = len(x)
        owner = np.zeros(n, dtype=np.int64)  # node of the level above
        centres = np.zeros(1, dtype=np.int64)
        self._add(owner, centres, np.zeros(1, dtype=np.int64))
        radius = FIRST_RADIUS
        while radius >= LAST_RADIUS and n:
            node, centres, parent = self._split(owner, centres, radius)
            self._add(node, centres, parent)
            owner, radius = node, radius / 2

    def _add(self, node: np.ndarray, centres: np.ndarray, parent: np.ndarray) -> None:
        far = np.zeros(len(centres))
        if len(node):
            np.maximum.at(far, node, np.sqrt(np.maximum(0.0, ((self.x - self.x[centres[node]]) ** 2).sum(axis=1))))
        self.levels.append((node, centres, far, parent))

    def _split(self, owner: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, n = self.x, len(self.x)
        node = np.full(n, -1, dtype=np.int64)
        new_centres, parents = [], []
        order = np.argsort(owner, kind="stable")
        begin = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        for parent in range(len(centres)):
            own = order[begin[parent] : begin[parent + 1]]
            pending, centre = own, centres[parent]
            while len(pending):
                if len(own) == 1:
                    near = np.ones(1, dtype=bool)
                else:
                    near = ((x[pending] - x[centre]) ** 2).sum(axis=1) <= radius * radius
                    near |= pending == centre
                node[pending[near]] = len(new_centres)
                new_centres.append(centre)
                parents.append(parent)
                pending = pending[~near]
                centre = pending[0] if len(pending) else -1
        return node, np.array(new_centres, dtype=np.int64), np.array(parents, dtype=np.int64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)))


def dual_traversal(x: np.ndarray, y: np.ndarray | None, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of ``x`` and ``y`` (or within ``x``: i < j) with ``cosine >= min_cosine``.

    Levels are refined together; a node pair lives on while its centres are
    no farther apart than both radii plus the link distance.
    """
    one = Tree(x)
    two = one if y is None else Tree(y)
    limit = reach(min_cosine) + SLACK
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # living node pairs of the level
    for level in range(1, min(len(one.levels), len(two.levels))):
        _, ca, ra, pa_ = one.levels[level]
        _, cb, rb, pb = two.levels[level]
        a, b = _children(a, b, pa_, pb)
        if y is None:
            keep = a <= b
            a, b = a[keep], b[keep]
        far = _pair_distances(one.x, two.x, ca, cb, a, b)
        keep = far <= ra[a] + rb[b] + limit
        a, b = a[keep], b[keep]
    i, j = _children(a, b, one.levels[-1][0], two.levels[-1][0])
    if y is None:
        node = one.levels[-1][0]
        keep = (node[i] != node[j]) | (i < j)
        i, j = i[keep], j[keep]
    out_i, out_j = [], []
    for s in range(0, len(i), 1 << 18):
        p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
        hit = np.einsum("ij,ij->i", one.x[p], two.x[q]) >= min_cosine
        out_i.append(p[hit])
        out_j.append(q[hit])
    return np.concatenate(out_i or [i]), np.concatenate(out_j or [j])


def _children(a: np.ndarray, b: np.ndarray, parent_a: np.ndarray, parent_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs ``(a, b)``; ``parent_*`` gives each child's parent."""
    oa, ob = np.argsort(parent_a, kind="stable"), np.argsort(parent_b, kind="stable")
    sa, sb = parent_a[oa], parent_b[ob]
    a0, na = np.searchsorted(sa, a), np.searchsorted(sa, a, "right") - np.searchsorted(sa, a)
    b0, nb = np.searchsorted(sb, b), np.searchsorted(sb, b, "right") - np.searchsorted(sb, b)
    size = na * nb
    pair = np.repeat(np.arange(len(a)), size)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    return oa[a0[pair] + at // nb[pair]], ob[b0[pair] + at % nb[pair]]


def _pair_distances(x: np.ndarray, y: np.ndarray, ca: np.ndarray, cb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if 20 * len(a) > len(ca) * len(cb) and len(ca) * len(cb) <= LEAF_POINTS * LEAF_POINTS * 4:
        return _distances(x[ca], y[cb])[a, b]
    out = np.empty(len(a))
    for s in range(0, len(a), 1 << 18):
        p, q = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
        out[s : s + (1 << 18)] = np.sqrt(((x[ca[p]] - y[cb[q]]) ** 2).sum(axis=1))
    return out


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links over 0..n-1 a pair (point, smallest point of its component) per linked point."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _finish(min_cosine: float):
    def run(group: pa.Table) -> pa.Table:
        """Links between the points of two lower nodes (or within one): counts and spanning links."""
        side, pid, mult = (group.column(c).to_numpy() for c in ("side", "pid", "mult"))
        x = _matrix(group.column("vec"))
        order = np.argsort(side, kind="stable")
        pid, mult, x, cut = pid[order], mult[order], x[order], int((side == 0).sum())
        if cut == len(side):
            i, j = dual_traversal(x, None, min_cosine)
        else:
            i, j = dual_traversal(x[:cut], x[cut:], min_cosine)
            j = j + cut
        links = np.bincount(i, weights=mult[j], minlength=len(pid)) + np.bincount(j, weights=mult[i], minlength=len(pid))
        linked = np.flatnonzero(links)
        up, root = _spanning(len(pid), i, j)
        to = np.full(len(pid), -1, dtype=np.int64)
        to[up] = pid[root]
        return pa.table({"pid": pid[linked], "links": links[linked].astype(np.int64), "up": pa.array(to[linked], pa.int64())})

    return run


# ----------------------------------------------------------------------------- Spark


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as little-endian doubles; null where a vector links with nothing."""
    for b in batches:
        vecs, prints = [], []
        for v in b.column(2).to_pylist():
            unit = None
            if v and None not in v:
                x = np.asarray(v, dtype=np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    x = x / top  # neither overflow nor underflow in the norm
                    unit = (x / np.sqrt((x * x).sum()) + 0.0).astype("<f8").tobytes()
            vecs.append(unit)
            prints.append(None if unit is None else xxhash.xxh3_128_digest(unit))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(vecs, pa.binary()), pa.array(prints, pa.binary())], names=["id", "label", "vec", "print"]
        )


def _nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Each point's nearest centre; equally near ones share the points by id."""
    x, c = _matrix(points.column("vec")), _matrix(centres.column("vec"))
    pid, ids = points.column("pid").to_numpy(), centres.column("centre").to_numpy()
    far = _distances(x, c)
    tied = far <= far.min(axis=1, keepdims=True) + 1e-12
    rank = np.cumsum(tied, axis=1) - 1
    pick = (tied & (rank == ((pid * 2654435761 & 0x7FFFFFFF) % tied.sum(axis=1))[:, None])).argmax(axis=1)
    own = np.isin(pid, ids)
    pick[own] = [int(np.flatnonzero(ids == p)[0]) for p in pid[own]]  # a centre stays with itself: levels are nested
    dist = np.sqrt(((x - c[pick]) ** 2).sum(axis=1))
    return pa.table({"pid": pid, "mult": points.column("mult"), "vec": points.column("vec"), "node": ids[pick], "far": dist})


def _centre_gap():
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float(np.sqrt(((np.frombuffer(x, "<f8") - np.frombuffer(y, "<f8")) ** 2).sum())) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run


def _grow(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Split nodes until each holds LEAF_POINTS at most.

    ``points(pid, mult, vec, node, far)``; returns the points with their
    lower nodes, and for each level ``(child, parent)``.
    """
    levels = []
    while True:
        sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        big = written(sizes.filter(F.col("n") > LEAF_POINTS), "tree-large")
        if not big.limit(1).count():
            return points, levels
        fan = F.least(F.lit(FAN_OUT), 2 * F.ceil(F.col("n") / LEAF_POINTS))
        at = big.select("node", "n", fan.alias("fan"), F.ceil(F.col("n") / GROUP_POINTS).cast("int").alias("salts"))
        # A node's rows are thinned by hash before they are ranked, to about four for each centre
        # wanted (the node's own centre always); a node that draws too few is split again next level.
        draw = F.pmod(F.xxhash64("pid", F.lit(len(levels))), F.lit(1 << 30)) / float(1 << 30)
        drawn = points.join(at, "node").filter((F.col("pid") == F.col("node")) | (draw * F.col("n") <= 4 * F.col("fan")))
        order = Window.partitionBy("node").orderBy((F.col("pid") != F.col("node")).cast("int"), F.xxhash64("pid"))
        centres = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("fan"))
        centres = written(centres.select("node", F.col("pid").alias("centre"), "vec", "salts"), "tree-centres")
        dealt = points.join(at.select("node", "salts"), "node").withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int"))
        copies = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        split = (
            dealt.groupBy("node", "salt")
            .cogroup(copies.groupBy("node", "salt"))
            .applyInArrow(_nearest, "pid long, mult long, vec binary, node long, far double")
        )
        rest = points.join(big.select("node"), "node", "left_anti").select("pid", "mult", "vec", "node", "far")
        points = written(split.unionByName(rest), "tree-points")
        same = sizes.join(big.select("node"), "node", "left_anti").select(F.col("node").alias("child"), F.col("node").alias("parent"))
        levels.append(written(centres.select(F.col("centre").alias("child"), F.col("node").alias("parent")).unionByName(same), "tree-level"))


def _surviving(points: DataFrame, roots: DataFrame, levels: list[DataFrame], limit: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of lower nodes that may hold links, refined level by level."""
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if not levels:
        return pairs
    # radius of every node of every level: the farthest point of the lower nodes below it
    vec = points.select(F.col("pid").alias("node"), "vec")
    up = points.select("pid", "vec", "node")
    tables = []
    for level in reversed(levels):
        centre = vec.join(level.select(F.col("child").alias("node")), "node")
        tables.append(_radii(up, centre))
        up = up.join(level, up["node"] == level["child"]).select("pid", "vec", F.col("parent").alias("node"))
    for level, nodes in zip(levels, reversed(tables)):
        left = level.join(nodes, level["child"] == nodes["node"]).select(F.col("parent").alias("a"), F.col("child").alias("ca"), F.col("vec").alias("va"), F.col("radius").alias("ra"))
        right = left.select(F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("va").alias("vb"), F.col("ra").alias("rb"))
        grown = pairs.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        grown = grown.filter(_centre_gap()("va", "vb") <= F.col("ra") + F.col("rb") + F.lit(limit))
        pairs = written(grown.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), "tree-pairs")
    return pairs


def _radii(up: DataFrame, centre: DataFrame) -> DataFrame:
    gap = up.join(centre.select("node", F.col("vec").alias("cvec")), "node").select("node", _centre_gap()("vec", "cvec").alias("far"))
    return written(gap.groupBy("node").agg(F.max("far").alias("radius")).join(centre, "node"), "tree-radii")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """Links of cosine ``min_cosine`` or more (double precision) between vectors of one label.

    Returns a row per row: the id column, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable by links) and ``kept``
    (the id is its component's).

    Edge cases: vectors that are null, empty, all zero or hold null or
    non-finite components, and rows without a label, link with nothing;
    vectors of different lengths do not link; repeated rows and equal vectors
    link with each other; rows with a null id take part, have a null
    component alone and are never kept; other columns are not read; an empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    prepare(spark)
    id_type, label_type = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vec"))
    rows = written(source.mapInArrow(_unit, f"id {id_type}, label {label_type}, vec binary, print binary"), "unit-vectors")
    valid = F.col("label").isNotNull() & F.col("print").isNotNull()
    classes = (
        rows.filter(valid)
        .groupBy("label", "print")
        .agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"), F.min("id").alias("least"))
        .withColumn("pid", F.monotonically_increasing_id())
    )
    classes = written(classes, "vector-classes")
    roots = classes.groupBy("label", F.octet_length("vec").alias("dim")).agg(F.min("pid").alias("node"))
    points = classes.withColumn("dim", F.octet_length("vec")).join(roots, ["label", "dim"])
    points = written(points.select("pid", "mult", "vec", "node", F.lit(0.0).alias("far")), "tree-points")
    points, levels = _grow(points)
    pairs = _surviving(points, roots, levels, reach(min_cosine) + SLACK)
    body = points.select("pid", "mult", "vec", "node")
    left = pairs.join(body, pairs["a"] == body["node"]).select("a", "b", F.lit(0).alias("side"), "pid", "mult", "vec")
    right = pairs.filter("a <> b").join(body, F.col("b") == body["node"]).select("a", "b", F.lit(1).alias("side"), "pid", "mult", "vec")
    found = left.unionByName(right).groupBy("a", "b").applyInArrow(_finish(min_cosine), "pid long, links long, up long")
    found = written(found, "vector-links")
    links = found.groupBy("pid").agg(F.sum("links").alias("links"))
    near = components(found.filter("up >= 0").select(F.col("pid").alias("a"), F.col("up").alias("b")))
    named = classes.select("label", "print", "mult", "least", "pid").join(links, "pid", "left").join(near.withColumnRenamed("node", "pid"), "pid", "left")
    named = named.withColumn("root", F.coalesce("root", "pid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "print", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    named = written(named, "vector-components")
    done = hot_split_join(rows.filter(valid).select("id", "label", "print"), named, ["label", "print"], "mult", rows.count())
    alone = rows.filter(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
