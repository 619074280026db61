"""Exact top-k inner products by dual-tree search over cover trees (Beygelzimer et al. 2006; Curtin and Ram 2014).

Rows are routed to compact blocks by two levels of pivots fitted on a bounded sample; the pivots decide only where a row
stands, every row is indexed and the result is exact. Blocks of one first pivot form a group, so that data and queries are
trees of groups, blocks and the cover tree that each block carries. A pair of nodes, at any of these levels, is pruned when no
vector within the two covering radii can reach the worst kth score of the query node."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Children of a node at most, and points of a leaf.
FAN, LEAF = 8, 128
#: First and second pivots at most; beyond that many blocks, a cell is split by hashed id (which costs pruning, not results).
PIVOTS = 256


#: Components beyond this only take part as if they were this large where rows are placed, and are never pruned.
HUGE = 1e150


def floats(x: np.ndarray) -> np.ndarray:
    """Integers as floating point, cut off at HUGE."""
    if x.dtype != object:
        return x.astype(np.float64)
    most = int(HUGE)
    return np.array([[float(max(-most, min(most, v))) for v in row] for row in x], dtype=np.float64).reshape(x.shape)


class CoverTree:
    """points are permuted so that every node is a contiguous range; nodes hold a point as centre and the exact covering radius.

    The invariants of a cover tree hold at a scale r of each node's own: children are chosen farthest first, until they cover
    the node within half its radius or there are FAN of them. With r the reach of the children so chosen, every point is
    within r of its child's centre (covering), the centres are at least r apart (separation), and a node's centre is one of
    its children's (nesting). In many dimensions half the radius would take nearly all points as children; FAN steps down by
    a smaller factor instead."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.start: list[int] = []
        self.stop: list[int] = []
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        x = floats(points)
        root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        todo = [(self._node(0, len(x), root, 0.0), np.arange(len(x)), root)]
        if np.abs(x).max(initial=0) >= HUGE:  # squares would overflow: one leaf that is never pruned
            self.radius[0] = np.inf
            todo = []
        while todo:
            node, own, center = todo.pop()
            at = self.start[node]
            far = np.sqrt(((x[own] - x[center]) ** 2).sum(axis=1))
            self.radius[node] = float(far.max())
            if len(own) <= LEAF or self.radius[node] == 0:
                self.order[at : at + len(own)] = own
                continue
            centers, nearest, label = [center], far.copy(), np.zeros(len(own), dtype=np.int64)
            while len(centers) < FAN and nearest.max() > self.radius[node] / 2:
                new = int(own[nearest.argmax()])
                gap = np.sqrt(((x[own] - x[new]) ** 2).sum(axis=1))
                closer = gap < nearest
                label[closer], nearest[closer] = len(centers), gap[closer]
                centers.append(new)
            for k, c in enumerate(centers):
                part = own[label == k]
                child = self._node(at, at + len(part), c, 0.0)
                self.children[node].append(child)
                todo.append((child, part, c))
                at += len(part)
        self.centers = x[self.center]
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.radii = np.array(self.radius)
        self.points = points[self.order]

    def _node(self, start: int, stop: int, center: int, radius: float) -> int:
        self.start.append(start), self.stop.append(stop), self.center.append(center), self.radius.append(radius), self.children.append([])
        return len(self.start) - 1


def dual_search(q: CoverTree, q_ids: np.ndarray, d: CoverTree, d_ids: np.ndarray, k: int, floor: np.ndarray, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of d for each query of q, in q's order: (query row, data row, score) triples.

    Pairs of nodes are pruned by both covering radii until the query side is a leaf; from there on each query of the leaf goes
    down the data tree with a bound of its own, which has no radius on the query side. scored: gets the number of pairs of
    vectors that were scored.

    floor: scores that a result must reach (from blocks searched before). Equal scores prefer the smaller id; a row never
    meets its own id. Scores are exact: integers below 2**53 in floating point, then 64-bit integers, then Python's; what does
    not fit into 64 bits is reported as the nearest number that does."""
    worst_case = float(np.abs(floats(q.points)).max(initial=0)) * float(np.abs(floats(d.points)).max(initial=0)) * max(1, q.points.shape[1])
    kind = np.float64 if worst_case < 2**52 else np.int64 if worst_case < 2**62 else object
    qx, dx = q.points.astype(kind), d.points.astype(kind)
    n, m = len(qx), len(dx)
    rank = np.argsort(np.argsort(d_ids, kind="stable"), kind="stable")
    best = np.full((n, k), -np.inf if kind is not np.int64 else np.iinfo(np.int64).min, dtype=kind)
    row = np.full((n, k), m, dtype=np.int64)
    kth = floor.astype(np.float64).copy()
    ranks = np.append(rank, m)

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        ra, rb = q.radii[a][:, None], d.radii[b][None, :]
        with np.errstate(all="ignore"):
            value = q.centers[a] @ d.centers[b].T + ra * d.norms[b][None, :] + rb * q.norms[a][:, None] + ra * rb
            return np.nan_to_num(value + 1 + 1e-9 * np.abs(value), nan=np.inf, posinf=np.inf)

    qf = floats(q.points)
    q_norms = np.sqrt((qf * qf).sum(axis=1))

    def near(a: int, b: list[int]) -> np.ndarray:
        """Whether each query of a leaf (rows) can still find something in each data node (columns)."""
        s = slice(q.start[a], q.stop[a])
        with np.errstate(all="ignore"):
            value = qf[s] @ d.centers[b].T + q_norms[s][:, None] * d.radii[b][None, :]
            value = np.nan_to_num(value + 1 + 1e-9 * np.abs(value), nan=np.inf, posinf=np.inf)
        return value >= kth[s][:, None]

    def base(a: int, b: int) -> None:
        own, t = q.start[a] + np.flatnonzero(near(a, [b])[:, 0]), slice(d.start[b], d.stop[b])
        score = qx[own] @ dx[t].T
        if scored is not None:
            scored.append(score.size)
        ok = (score >= kth[own][:, None]).astype(bool) & (q_ids[own][:, None] != d_ids[t][None, :])
        for i in np.flatnonzero(ok.any(axis=1)):
            cols = np.flatnonzero(ok[i])
            r = int(own[i])
            value, at = np.concatenate([best[r], score[i][cols]]), np.concatenate([row[r], d.start[b] + cols])
            if kind is object:
                keep = np.array(sorted(range(len(at)), key=lambda j: (-value[j], ranks[at[j]]))[:k])
            else:
                keep = np.lexsort((ranks[at], -value if kind is np.float64 else ~value))[:k]
            best[r], row[r] = value[keep], at[keep]
            if row[r][-1] < m:
                kth[r] = max(kth[r], _below(best[r][-1]))

    stack = [(0, 0, float(bounds([0], [0])[0, 0]))] if n and m else []
    while stack:
        a, b, bound = stack.pop()
        if bound < kth[q.start[a] : q.stop[a]].min():
            continue
        if not q.children[a] and not d.children[b]:
            base(a, b)
            continue
        left, right = q.children[a] or [a], d.children[b] or [b]
        if not q.children[a]:
            right = [c for c, live in zip(right, near(a, right).any(axis=0).tolist(), strict=True) if live]
            if not right:
                continue
        value = bounds(left, right)
        for i in np.argsort(value, axis=None):  # the most promising pair comes off the stack first
            stack.append((left[i // len(right)], right[i % len(right)], float(value.flat[i])))
    found = np.nonzero(row < m)
    score = best[found]
    if kind is object:
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in score], dtype=np.int64)
    return found[0], row[found], score


def _below(score) -> float:
    """The score as a floating-point number, or one just below it where it is rounded."""
    value = float(max(-(10**300), min(10**300, score)))
    return value if abs(value) < 2**53 else float(np.nextafter(value, -np.inf))


def _quantised(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 x) of every component, as Python integers if 64 bits do not hold them; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) < 2.0**52:
        flat = np.floor(1024.0 * flat).astype(np.int64)
    else:
        flat = np.array([1024 * int(x) if abs(x) >= 2.0**52 else math.floor(1024 * x) for x in flat], dtype=object)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector without null, NaN or infinite components, as (vec_id, v)."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))  # noqa: E731  false for NaN, which is above infinity
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", lambda x: F.coalesce(sound(x), F.lit(False))))


def _farthest(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points, as rows of x."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T, nan=np.inf).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


def _pivots(x: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First pivots, and second ones for each of them, by the share of the sample that it draws."""
    first = x[_farthest(x, min(PIVOTS, math.isqrt(max(1, blocks) - 1) + 1))]
    of = _nearest(x, first)
    second = []
    for k in range(len(first)):
        own = x[of == k]
        second.append(own[_farthest(own, min(PIVOTS, -(-blocks * len(own) // len(x))))] if len(own) else first[k : k + 1])
    return first, second


def _routed(rows: DataFrame, pivots: tuple[np.ndarray, list[np.ndarray]], dim: int) -> DataFrame:
    """Rows with their group (nearest first pivot) and cell (nearest second pivot of that group)."""
    first, second = pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floats(_quantised(batch.column("v"), dim))
            group = _nearest(x, first)
            cell = np.zeros(len(x), dtype=np.int64)
            for k in np.unique(group):
                cell[group == k] = k * PIVOTS + _nearest(x[group == k], second[k])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int64())], ["vec_id", "v", "cell"])

    return rows.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, cell long")


def _blocks(rows: DataFrame, pivots: tuple[np.ndarray, list[np.ndarray]], dim: int, most: int, name: str) -> DataFrame:
    """One row for each block of about `most` vectors: block, g (group), n, center, radius, tree. A full cell is split by hashed id."""
    routed = staged(_routed(rows, pivots, dim), f"{name}-routed")
    splits = routed.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("splits"))  # PIVOTS * PIVOTS rows at most, 1 MB
    place = F.pmod(F.xxhash64("vec_id"), F.col("splits"))
    keyed = routed.join(F.broadcast(splits), "cell").withColumn("block", F.col("cell") * (1 << 32) + place)

    def build(table: pa.Table) -> pa.Table:
        x = _quantised(table.column("v"), dim)
        if x.dtype != object:
            x = x.astype(next(k for k in (np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(k).max))
        ids = table.column("vec_id").to_numpy()
        tree = CoverTree(x)
        blob = pickle.dumps((ids[tree.order], vars(tree)), protocol=5)
        cell = table.column("cell")[0].as_py()
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "g": pa.array([cell // PIVOTS], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "center": pa.array([tree.centers[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radius[0]], pa.float64()), "tree": pa.array([blob], pa.binary())})

    return staged(keyed.groupBy("block").applyInArrow(build, "block long, g long, n long, center array<double>, radius double, tree binary"), name, spent=(routed,))


def _groups(blocks: DataFrame) -> DataFrame:
    """g, d_center, d_radius of each group: the centre of its largest block, and the distance that its blocks reach."""
    heart = blocks.groupBy("g").agg(F.max_by("center", F.struct("n", "block")).alias("d_center"))
    far = F.sqrt(F.aggregate(F.zip_with("center", "d_center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)) + F.col("radius")
    return blocks.select("g", "center", "radius").join(F.broadcast(heart), "g").groupBy("g", "d_center").agg(F.max(far).alias("d_radius"))  # PIVOTS rows at most


def _bound() -> Column:
    """Largest inner product of a vector in the query block with one in the data block."""
    dot = F.aggregate(F.zip_with("q_center", "d_center", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, b: a + b * b))
    value = dot + F.col("q_radius") * norm("d_center") + F.col("d_radius") * norm("q_center") + F.col("q_radius") * F.col("d_radius")
    return value + 1 + 1e-9 * F.abs(value)


def _unpacked(blob: pa.Scalar) -> tuple[np.ndarray, CoverTree]:
    ids, fields = pickle.loads(blob.as_py())
    tree = CoverTree.__new__(CoverTree)
    vars(tree).update(fields)
    return ids, tree


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Top k of each block pair (columns q_block, q_tree, d_tree, floors by query id): q_block, query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q), (d_ids, d) = _unpacked(batch.column("q_tree")[i]), _unpacked(batch.column("d_tree")[i])
                known = dict(batch.column("floors")[i].as_py() or [])
                floor = np.array([known.get(int(x), -np.inf) for x in q_ids], dtype=np.float64)
                a, b, score = dual_search(q, q_ids, d, d_ids, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), batch.column("q_block")[i].as_py()), pa.int64()), pa.array(q_ids[a], pa.int64()), pa.array(d_ids[b], pa.int64()), pa.array(score.astype(np.int64), pa.int64())], ["q_block", "query_id", "vec_id", "score"])

    return pairs.select("q_block", "q_tree", "d_tree", "floors").mapInArrow(run, "q_block long, query_id long, vec_id long, score long")


def dual_tree_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 16384, data_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    vectors, queries: (vec_id, v), see usable(). Components are floor(1024 x), of any size; scores beyond 64 bits count as the
    nearest number of 64 bits. Repeated query ids count once, with the least vector; a repeated data row takes a rank of its
    own; rows with the query's id are its own. Shorter vectors are filled up with zeros, empty ones are zeros throughout.
    Equal scores go to the smaller id. Fewer than k others give fewer rows, none give none. Other columns are not read.
    sample: about so many rows, by hashed id, are what the pivots are fitted on."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(1, size[1] or 0, asked[1] or 0)
    share = int(min(1.0, sample / max(1, size[0])) * (1 << 30))
    seen = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("v").toArrow()
    fitted = floats(_quantised(seen.column("v"), dim)) if seen.num_rows else np.zeros((1, dim))
    data = _blocks(vectors, _pivots(fitted, -(-size[0] // data_block)), dim, data_block, "tree-data")
    asks = _blocks(queries, _pivots(fitted, -(-asked[0] // query_block)), dim, query_block, "tree-queries")
    groups = staged(_groups(data), "tree-groups")
    q = asks.select(F.col("block").alias("q_block"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"))
    d = data.select("g", F.col("block").alias("d_block"), F.col("center").alias("d_center"), F.col("radius").alias("d_radius"))
    near = F.aggregate(F.zip_with("q_center", "d_center", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    # Every query block meets every group (at most PIVOTS), and only the blocks of groups that are not pruned.
    known = sorted(r["g"] for r in groups.select("g").collect())
    met = q.withColumn("g", F.explode(F.array(*[F.lit(g).cast("long") for g in known]) if known else F.array().cast("array<long>"))).join(F.broadcast(groups), "g")
    start = met.groupBy("q_block").agg(F.max_by("g", F.struct(near, "g")).alias("g"))
    first = q.join(start, "q_block").join(d, "g").groupBy("q_block").agg(F.max_by("d_block", F.struct(near, "d_block")).alias("d_block"))
    first = staged(first, "tree-start")
    trees = lambda chosen: chosen.join(asks.select(F.col("block").alias("q_block"), F.col("tree").alias("q_tree")), "q_block").join(data.select(F.col("block").alias("d_block"), F.col("tree").alias("d_tree")), "d_block")
    nothing = F.lit(None).cast("array<struct<id:long,score:double>>").alias("floors")
    begun = staged(_searched(trees(first).select("q_block", "q_tree", "d_tree", nothing), k), "tree-first")
    kth = begun.groupBy("q_block", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    # A 64-bit score that floating point would round up is taken a little lower.
    score = F.col("kth").cast("double")
    kth = kth.withColumn("kth", F.when(F.col("kth").isNull(), float("-inf")).when(F.abs(score) < 2.0**53, score).otherwise(score - F.abs(score) * 1e-15))
    held = asks.select(F.col("block").alias("q_block"), "n")
    worst = kth.groupBy("q_block").agg(F.min("kth").alias("worst"), F.count("*").alias("known"), F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("kth").alias("score"))).alias("floors"))
    worst = held.join(worst, "q_block", "left").select("q_block", "floors", F.when(F.col("known") == F.col("n"), F.col("worst")).otherwise(float("-inf")).alias("worst"))
    worst = staged(worst, "tree-worst")
    open_ = met.join(worst.select("q_block", "worst"), "q_block").filter(_bound() >= F.col("worst")).select("q_block", "q_center", "q_radius", "worst", "g")
    pairs = open_.join(d, "g").filter(_bound() >= F.col("worst")).select("q_block", "d_block").join(first, ["q_block", "d_block"], "left_anti")
    later = _searched(trees(pairs.join(worst.select("q_block", "floors"), "q_block")), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return begun.unionByName(later).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_cover_tree(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all vectors."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return dual_tree_top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))
