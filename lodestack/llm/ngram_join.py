"""Exact n-gram Jaccard join with adaptive multi-match prefixes (AdaptJoin: Wang, Li and Feng 2012).

Shingles are ordered by how often they were seen together in a block of rows, then by hash. If two sets are similar, their
first |x| - ceil(t|x|) + l shingles share at least l. Each document picks its own l: a longer prefix costs more postings,
but asks for l shared ones before a pair is verified. Pairs are verified on whole sets. Documents with equal sets are one
class throughout, and components grow as pairs are verified, so a group of near copies is never expanded into its pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free_prefix, matched, release, shuffle_parts, small_batches, staged
from .textbytes import chunks, mix, sequence_hash, shingle_hashes, word_hashes

WORDS = 5
#: Links: BASE * intersection >= SHARE * union.
SHARE, BASE = 80, 100
#: Longest multi-match, and cost of a verification in postings.
MOST, VERIFY = 4, 8.0
#: Buckets up to this size are paired in full at once; larger ones by leaders and neighbours first.
SMALL = 32
#: Frequent shingles that are ordered last; only an order, any such set gives the same links.
HEAVY = 1 << 19
_U = np.uint64


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence; with fewer words than a shingle, one hash of all of them."""
    if len(words) >= WORDS:
        return np.unique(shingle_hashes(words, WORDS))
    return np.array([sequence_hash(words)], dtype=_U) if len(words) else np.zeros(0, _U)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, buf, off in chunks(column):
        hashes, _, rows = word_hashes(buf, off)
        at = 0
        for n in rows:
            yield shingle_set(hashes[at : at + n])
            at += n


def class_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers; the first is the class id."""
    if not len(own):
        return 0, 0
    a = mix(own).sum(dtype=_U) + _U(len(own))
    b = mix(own ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)
    return tuple(int(x) for x in mix(np.array([a, b], dtype=_U)).view(np.int64))


def overlap_needed(n: int | np.ndarray) -> int | np.ndarray:
    """Least intersection of a set of n with any similar one: ceil(t n)."""
    return -(-SHARE * n // BASE)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if BASE * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return BASE * shared >= SHARE * (len(a) + len(b) - shared)


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bin, by leading bits; at least a quarter as many bins as shingles.

    The smaller counts of two sketches add up to a bound of the intersection, never less than it, in a thirtieth of the
    bytes of a set. Empty if a bin holds over 255 shingles: then there is no bound."""
    bits = max(3, (len(own) // 4).bit_length())
    counts = np.bincount((mix(own) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(sketches: list[bytes], bins: int) -> np.ndarray:
    """Sketches as rows of so many bins (a power of two that none is shorter than)."""
    return np.stack([np.frombuffer(x, np.uint8).reshape(bins, -1).sum(axis=1, dtype=np.int64) for x in sketches])


def _within(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return BASE * bound >= SHARE * (n + m - bound)


def may_link(a: bytes, b: bytes) -> bool:
    """False only for sets that are not similar, by their sketches."""
    if not a or not b:
        return True
    x, y = folded([a], bins := min(len(a), len(b)))[0], folded([b], bins)[0]
    return bool(_within(np.minimum(x, y).sum(), x.sum(), y.sum()))


DOC = "kind byte, doc_id long, n int, key long, check long, shingle long, seen int"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a row for each document; kind 1: shingles that several distinct sets of a run of rows share."""
    pending, size, known = [], 0, set()

    def common() -> pa.RecordBatch:
        shingle, seen = np.unique(np.concatenate(pending) if pending else np.zeros(0, _U), return_counts=True)
        often = seen >= 3
        n = int(often.sum())
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), none, pa.nulls(n, pa.int32()), none, none, pa.array(shingle[often].view(np.int64)), pa.array(seen[often].astype(np.int32))], ["kind", "doc_id", "n", "key", "check", "shingle", "seen"])

    for batch in batches:
        keys, checks, counts = [], [], []
        for own in shingle_sets(batch.column("text")):
            key = class_key(own)
            keys.append(key[0]), checks.append(key[1]), counts.append(len(own))
            if key not in known:
                known.add(key)
                pending.append(own)
                size += len(own)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], ["kind", "doc_id", "n", "key", "check", "shingle", "seen"])
        if size > 4_000_000:
            yield common()
            pending, size, known = [], 0, set()
    yield common()


def prefix(own: np.ndarray, heavy: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(prefix shingles in order, level at which each enters, chosen multi-match, estimated frequencies)."""
    n = len(own)
    weight = np.ones(n)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
        weight = np.where(heavy[at] == own, seen[at], 1).astype(float)
    first = n - overlap_needed(n) + 1
    most = min(MOST, overlap_needed(n))
    length = first + most - 1
    order = np.lexsort((own, weight))[:length]
    scan = np.cumsum(weight[order])
    cost = [scan[first + level - 2] * (1 + VERIFY / level) for level in range(1, most + 1)]
    chosen = int(np.argmin(cost)) + 1
    order = order[: first + chosen - 1]
    return own[order], np.maximum(1, np.arange(len(order)) - first + 2).astype(np.uint8), chosen, weight[order]


_POST = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("level", "u1"), ("chosen", "u1")])


def _postings(heavy: np.ndarray, seen: np.ndarray, parts: int, cell: int):
    """Packed prefix postings by target partition. A shingle expected in more than `cell` sets is dealt into cells of salt
    pairs, so that any two of its sets meet in one cell and no cell takes them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            found = []
            for own in shingle_sets(batch.column("text")):
                key = class_key(own)
                if not len(own) or key in known:
                    continue
                known.add(key)
                token, level, chosen, weight = prefix(own, heavy, seen)
                post = np.empty(len(token), dtype=_POST)
                post["token"], post["key"], post["n"], post["level"], post["chosen"] = token, key[0], len(own), level, chosen
                hot = weight > cell
                if hot.any():
                    extra = [post[~hot]]
                    for k in np.flatnonzero(hot):
                        salts = int(-(-weight[k] // cell)) + 1
                        mine = key[0] % salts
                        for other in range(salts):
                            low, high = min(mine, other), max(mine, other)
                            one = post[k : k + 1].copy()
                            one["token"] = mix(one["token"] + _U(low * 65_537 + high + 1) * _U(0x9E3779B97F4A7C15))
                            extra.append(one)
                    post = np.concatenate(extra)
                found.append(post)
            if len(known) > 200_000:
                known = set()
            if not found:
                continue
            post = np.concatenate(found)
            part = (mix(post["token"]) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            post, part = post[order], part[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cuts[1:], len(part))
            blobs = [b"".join(np.ascontiguousarray(post[f][a:b]).tobytes() for f in _POST.names) for a, b in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "posts"])

    return run


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // _POST.itemsize
    out, at = np.empty(n, dtype=_POST), 0
    for f in _POST.names:
        kind = _POST.fields[f][0]
        out[f] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _tally(a: np.ndarray, b: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Pairs of postings rows as (key, key, need) with the number of shared shingles that count at that need."""
    need = np.minimum(post["chosen"][a], post["chosen"][b])
    n, m = post["n"][a].astype(np.int64), post["n"][b].astype(np.int64)
    ok = (np.maximum(post["level"][a], post["level"][b]) <= need) & (BASE * np.minimum(n, m) >= SHARE * np.maximum(n, m))
    a, b, need = a[ok], b[ok], need[ok]
    x, y = post["key"][a], post["key"][b]
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    low, high, need = low[order], high[order], need[order]
    cut = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, np.int64)
    out = np.empty(len(cut), dtype=[("a", "<i8"), ("b", "<i8"), ("need", "<i4"), ("shared", "<i4")])
    out["a"], out["b"], out["need"] = low[cut], high[cut], need[cut]
    out["shared"] = np.diff(np.append(cut, len(low)))
    return out


BUCKET = "kind byte, a long, b long, need int, shared int"


def _bucket_batch(kind: int, a: np.ndarray, b: np.ndarray, need: np.ndarray | None, shared: np.ndarray | None) -> pa.RecordBatch:
    some = lambda x: pa.nulls(len(a), pa.int32()) if x is None else pa.array(x, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), some(need), some(shared)], ["kind", "a", "b", "need", "shared"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: classes of large buckets (a: token, b: class, need: size of its set); kind 1: candidate pairs with partial counts."""
    blobs = [x.as_py() for batch in batches for x in batch.column("posts")]
    if not blobs:
        return
    post = np.concatenate([_unpacked(x) for x in blobs])
    del blobs
    post = post[np.lexsort((post["key"], post["n"], post["token"]))]
    fresh = np.append(True, (post["token"][1:] != post["token"][:-1]) | (post["key"][1:] != post["key"][:-1]))
    post = post[fresh]  # equal sets of other tasks
    start = np.flatnonzero(np.append(True, post["token"][1:] != post["token"][:-1]))
    size = np.diff(np.append(start, len(post)))
    post = post[np.repeat(size > 1, size)]
    if not len(post):
        return
    size = size[size > 1]
    start = np.cumsum(size) - size
    of = np.repeat(start, size)
    span = np.repeat(size, size)
    at = np.arange(len(post))
    wide = span > SMALL
    if wide.any():
        big = post[wide]
        for k in range(0, len(big), 1 << 18):
            p = big[k : k + (1 << 18)]
            yield _bucket_batch(0, p["token"].astype(np.uint64).view(np.int64), p["key"], p["n"], None)
    left, right = [], []
    for back in range(1, SMALL):
        ok = (at - back >= of) & ~wide
        if not ok.any():
            break
        left.append(at[ok] - back), right.append(at[ok])
    if wide.any():
        # In a large bucket: the row before, and the first row whose set is not too small to be similar (rows stand by size).
        own = at[wide]
        ok = own > of[own]
        left.append(own[ok] - 1), right.append(own[ok])
        rank = (np.searchsorted(start, of[own]).astype(np.int64) << 32) + post["n"][own]
        leader = np.searchsorted(rank, (np.searchsorted(start, of[own]).astype(np.int64) << 32) + overlap_needed(post["n"][own].astype(np.int64)))
        lead = own[leader]
        ok = lead < own
        left.append(lead[ok]), right.append(own[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique((a.astype(np.int64) << 32) | b)  # a leader may also be the row before
    for k in range(0, len(pairs), 1 << 22):
        out = _tally(pairs[k : k + (1 << 22)] >> 32, pairs[k : k + (1 << 22)] & 0xFFFFFFFF, post)
        yield _bucket_batch(1, out["a"], out["b"], out["need"], out["shared"])


def _cell_links(a: list[np.ndarray], b: list[np.ndarray], label_a: np.ndarray, label_b: np.ndarray, same: bool, width: int = 4096) -> list[tuple[int, int]]:
    """Links between sets of two blocks (or within one), as few as join their components: rows of a and b.

    Intersections are counted by products of 0/1 matrices over the shingles that at least two of the sets hold, `width`
    shingles at a time."""
    sets = a if same else [*a, *b]
    size = np.array([len(x) for x in sets])
    shingle, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = seen > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[at]
    row = np.repeat(np.arange(len(sets)), size)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = len(a), 0 if same else len(a)
    shared = np.zeros((left, len(sets) - right), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        bits = np.zeros((len(sets), width), dtype=np.float32)
        bits[row[part], column[part] - low] = 1
        shared += bits[:left] @ bits[right:].T
    n, m = size[:left, None], size[None, right:]
    linked = BASE * shared.astype(np.int64) >= SHARE * (n + m - shared.astype(np.int64))
    linked &= label_a[:, None] != (label_a if same else label_b)[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    other = label_a if same else label_b
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(label_a[i])), root(int(other[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def _cell(table: pa.Table) -> pa.Table:
    """Links between the components (labels) of the sets of a cell."""
    label = table.column("label").to_numpy()
    right = table.column("side").to_numpy()
    own = [np.frombuffer(x.as_buffer(), _U) for x in table.column("own").combine_chunks()]
    both = table.column("same")[0].as_py()
    a, b = np.flatnonzero(right == 0), np.flatnonzero(right == 1)
    found = _cell_links([own[i] for i in a], [own[i] for i in b], label[a], label[b], both) if len(a) and (both or len(b)) else []
    b = a if both else b
    return pa.table({"a": pa.array([int(label[a[i]]) for i, _ in found], pa.int64()), "b": pa.array([int(label[b[j]]) for _, j in found], pa.int64())})


def _hopeful_cell(table: pa.Table) -> pa.Table:
    """The classes of a cell whose sketch does not rule out a link with a class of another component there."""
    label, key, right = (table.column(c).to_numpy() for c in ("label", "key", "side"))
    known = table.column("sketch").to_pylist()
    both = table.column("same")[0].as_py()
    bins = min((len(x) for x in known if x), default=8)
    counts = folded([x or bytes(bins) for x in known], bins).astype(np.int32)
    size, free = counts.sum(axis=1), np.array([not x for x in known])
    a = np.arange(len(known)) if both else np.flatnonzero(right == 0)
    b = a if both else np.flatnonzero(right == 1)
    keep = np.zeros(len(known), dtype=bool)
    for i in a if len(b) else ():
        met = (label[b] != label[i]) & (free[i] | free[b] | _within(np.minimum(counts[i], counts[b]).sum(axis=1), size[i], size[b]))
        keep[b[met]] = True
        keep[i] |= met.any()
    return pa.table({"key": pa.array(key[keep], pa.int64())})


def _rows_of(column: str):
    """key and the set itself (own) or its sketch, for each text."""
    made = {"own": np.ndarray.tobytes, "sketch": sketch}[column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blobs = [], []
            for own in shingle_sets(batch.column("text")):
                keys.append(class_key(own)[0]), blobs.append(made(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["key", column])

    return run


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = pa.array([may_link(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("own_a"), batch.column("own_b")
        good = [i for i in range(batch.num_rows) if _similar(np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U))]
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])


def _fetched(keys: DataFrame, docs: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """The whole sets of classes (column own: sorted hashes), or their sketches (column sketch), by key."""
    wanted = staged(classes.join(keys, "key", "left_semi").select("rep", "key").distinct(), "join-ids")  # small: ids and keys
    # A class is read from the rows of its smallest id; a class of null ids only, from the rows without an id.
    own = docs.filter(F.col("doc_id").isNotNull())
    sets = matched(own, wanted.filter(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_rows_of(column), f"key long, {column} binary")
    bare = wanted.filter(F.col("rep").isNull()).select("key")
    if not bare.isEmpty():
        sets = sets.unionByName(matched(docs.filter(F.col("doc_id").isNull()).mapInArrow(_rows_of(column), f"key long, {column} binary"), bare, "key", "left_semi"))
    sets = staged(sets, "join-sets")
    # Only rows that share an id, or have none, can repeat a key. Without them the table stays as it is, so that joins with it can be split.
    n, different = sets.agg(F.count("*"), F.countDistinct("key")).first()
    return sets if n == different else staged(sets.dropDuplicates(["key"]), "join-sets", spent=(sets,))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Pairs of classes whose whole sets are similar, staged under the name: as many as give all components.

    Most pairs that share a prefix are not similar. Sketches rule those out before whole sets travel, so what travels grows
    with the classes that have near copies, not with the pairs."""
    ends = lambda p: p.select(F.col("a").alias("key")).unionByName(p.select(F.col("b").alias("key"))).distinct()
    sketches = _fetched(ends(pairs), docs, classes, "sketch")
    few = staged(_beside(pairs, sketches, "sketch").mapInArrow(_hopeful, "a long, b long"), "join-hopeful", spent=(pairs, sketches))
    sets = _fetched(ends(few), docs, classes, "own")
    # Of a group of near copies first one pair of each class, then only what would still join components.
    first = few.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = staged(_beside(first, sets, "own").mapInArrow(_verify, "a long, b long"), "join-first")
    label = components(linked)
    side = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    apart = few.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    rest = apart.select("a", "b").join(first, ["a", "b"], "left_anti")
    more = _beside(rest, sets, "own").mapInArrow(_verify, "a long, b long")
    return staged(linked.unionByName(more), name, spent=(sets, few, linked))


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with that column of both sets."""
    right = pairs.join(sets.select(F.col("key").alias("b"), F.col(column).alias(f"{column}_b")), "b")
    both = right.join(sets.select(F.col("key").alias("a"), F.col(column).alias(f"{column}_a")), "a")
    return both.select("a", "b", f"{column}_a", f"{column}_b")


def _cells(members: DataFrame, block: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, label, n, area, step) in every cell where their block meets another one; and the staged sizes behind it."""
    size = staged(members.groupBy("area", "step").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.col("n").cast("long")) / weight)).cast("int").alias("blocks")), "join-steps")
    beside = lambda by, name: size.select("area", (F.col("step") + by).alias("step"), F.col("blocks").alias(name))
    around = size.join(beside(1, "below"), ["area", "step"], "left").join(beside(-1, "above"), ["area", "step"], "left")
    dealt = members.join(around, ["area", "step"]).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # A cell is named by its two blocks, the one of the smaller step (or number) first.
    here, below, above = (F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1) for c in ("blocks", "below", "above"))
    none = F.array().cast("array<struct<i_step:int,i:int,j_step:int,j:int,side:int>>")
    name = lambda i_step, i, j_step, j, side: F.struct(i_step.alias("i_step"), i.alias("i"), j_step.alias("j_step"), j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    own, at = F.col("own"), F.col("step")
    cells = F.concat(
        F.transform(here, lambda o: name(at, F.least(own, o), at, F.greatest(own, o), F.when(own <= o, 0).otherwise(1))),
        F.when(F.col("below").isNotNull(), F.transform(below, lambda o: name(at - 1, o, at, own, 1))).otherwise(none),
        F.when(F.col("above").isNotNull(), F.transform(above, lambda o: name(at, own, at + 1, o, 0))).otherwise(none),
    )
    cells = dealt.select("key", "label", "area", F.explode(cells).alias("c")).select("key", "label", "area", "c.*")
    return cells.withColumn("same", (F.col("i_step") == F.col("j_step")) & (F.col("i") == F.col("j"))), size


def _bridged(large: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, block: int, weight: int) -> DataFrame:
    """Components (node, label) after all links across components that large buckets (a, key, n) still hold.

    Classes that meet in such buckets form areas. The classes of an area are dealt into steps by the size of their sets, a
    quarter apart, so that similar ones stand in one step or in neighbouring ones, and each step into blocks of about `block`
    classes and `weight` shingles at most. Two blocks of such steps meet in one cell, where the intersections of all their
    sets are counted at once; a cell returns only links that join components, so neither pairs nor links of a group are
    listed, however large it is. Cells are run twice: over sketches, which leave out classes that cannot have such a link, and
    over the whole sets of the others."""
    known = large.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_ = known.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("first")).filter("low <> high").select("a", "first")
    open_ = staged(open_, "join-open")
    # Few buckets stay open as a rule; broadcast, they leave the rows of a hot bucket where they are.
    met = known.join(F.broadcast(open_) if open_.count() <= 1_000_000 else open_, "a")
    meets = staged(met.select("key", "label", "n", "first").distinct(), "join-meets")
    if meets.isEmpty():
        return labels
    areas = components(meets.select(F.col("first").alias("a"), F.col("key").alias("b"))).select(F.col("node").alias("key"), F.col("label").alias("area"))
    step = F.floor(F.log("n") / math.log(BASE / SHARE) + 1e-9).cast("int")
    members = staged(meets.select("key", "label", "n").distinct().join(areas, "key").withColumn("step", step), "join-members", spent=(meets, open_))
    sketches = _fetched(members.select("key"), docs, classes, "sketch")
    # Sketches first: only classes that may still have a link travel as whole sets.
    rough, sizes = _cells(members, block, weight)
    by = ["area", "i_step", "i", "j_step", "j"]
    hopeful = rough.join(sketches, "key").groupBy(*by).applyInArrow(_hopeful_cell, "key long").distinct()
    left = staged(members.join(staged(hopeful, "join-near", spent=(sizes, sketches)), "key", "left_semi"), "join-left", spent=(members,))
    sets = _fetched(left.select("key"), docs, classes, "own")
    cells, sizes = _cells(left, block, weight)
    found = cells.join(sets, "key").groupBy(*by).applyInArrow(_cell, "a long, b long")
    extra = staged(found, "join-extra", spent=(sets, sizes, left))
    # Only components meet now: they are joined among themselves, and classes without a link so far come along as their own.
    joined = components(extra).select(F.col("node").alias("label"), F.col("label").alias("least"))
    moved = labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    alone = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
    return moved.unionByName(alone)


def jaccard_components(docs: DataFrame, **limits: int) -> DataFrame:
    """See _components; all passes over texts and sets run in small Arrow batches."""
    with small_batches(docs.sparkSession):
        return _components(docs, **limits).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, cell: int = 200_000, rows_a_part: int = 1_000_000, block: int = 512, weight: int = 1 << 20) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included),
    and the class and component behind it: key, check, label (null without links).

    docs: doc_id, text. cell: sets of one frequent shingle that meet in one task at most; rows_a_part: postings of a task;
    block, weight: classes of an area, and shingles of theirs, that one side of a comparison holds at most, about.
    A document without words (or a null text) has no shingles and is linked with nothing. Copies and repeated rows are one
    class; a null doc_id takes part in links, but names a component only if it has no other member (then null). An empty
    table gives no rows. Sets are compared by 64-bit shingle hashes, classes by 128 bits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = staged(docs.mapInArrow(_survey, DOC), "join-survey")
    own = survey.filter("kind = 0").select("doc_id", "n", "key", "check")
    often = staged(survey.filter("kind = 1").groupBy("shingle").agg(F.sum("seen").alias("seen")).filter("seen >= 6"), "join-often")
    steps = {r["step"]: r["count"] for r in often.groupBy(F.floor(F.log2("seen") * 8).alias("step")).count().collect()}  # under 300 rows
    least, room = 1 << 62, HEAVY
    for step in sorted(steps, reverse=True):
        room -= steps[step]
        if room < 0:
            break
        least = step
    often = often.filter(F.floor(F.log2("seen") * 8) >= least).toArrow()  # at most HEAVY rows
    heavy, seen = often.column("shingle").to_numpy().view(np.uint64), often.column("seen").to_numpy()
    order = np.argsort(heavy)
    table = docs.sparkSession.sparkContext.broadcast((heavy[order], seen[order]))  # at most HEAVY entries, 8 MB
    shingles = own.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), int(shingles * (BASE - SHARE) / BASE // rows_a_part))

    def post(batches):
        return _postings(*table.value, parts, cell)(batches)

    posted = docs.select("text").mapInArrow(post, "part int, posts binary").repartitionById(parts, F.col("part"))
    found = staged(posted.mapInArrow(_buckets, BUCKET), "join-buckets")
    counted = lambda p: p.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("shared").alias("shared")).filter("shared >= need").select("a", "b")
    tried = staged(counted(found.filter("kind = 1")), "join-pairs")
    classes = own.filter("n > 0").groupBy("key", "check", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    classes = staged(classes, "join-classes")
    links = _verified(tried, docs, classes, "join-links")
    labels = components(links)
    release(links)
    large = found.filter("kind = 0").select("a", F.col("b").alias("key"), F.col("need").alias("n"))
    if not large.isEmpty():
        labels = staged(_bridged(large, labels, docs, classes, block, weight), "join-labels", spent=(found,))
    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left")
    least = named.filter("label is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    special = named.filter("members > 1 or label is not null").join(least, "label", "left").select("key", "check", "n", F.coalesce("component_id", "rep").alias("component_id"), "label")
    out = own.join(special, ["key", "check", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", "check", "label")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _keyed(key: str, check: str):
    """Rows with the key of the set of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_key(own) for own in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], [*batch.schema.names, key, check])

    return run


def near_copy_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id; the columns stay those of docs.

    Rows that share an id are told apart by their sets: those of other components stay, of one component one row does (the
    least by set and text). A row without an id goes if its component has a document with one; all others without stay. Columns
    of any name pass through; an empty table stays empty."""
    with small_batches(spark):
        found = staged(_components(docs.select("doc_id", "text")), "join-components")
        gone = staged(found.filter("doc_id <> component_id").select("doc_id").distinct(), "join-gone")
        again = staged(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "join-again")
        if again.isEmpty() and found.filter("doc_id is null").isEmpty():
            return matched(docs, gone, "doc_id", "left_anti")
        known = docs.filter("doc_id is not null")
        kept = matched(known, gone.unionByName(again).distinct(), "doc_id", "left_anti")
        apart = matched(known, again, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
        p = free_prefix(docs.columns, ["key", "check", "id", "k", "c", "label", "group", "row"])
        key, check, id_, k, c, label, group, row = (p + n for n in ("key", "check", "id", "k", "c", "label", "group", "row"))
        schema = T.StructType([*apart.schema.fields, T.StructField(key, T.LongType()), T.StructField(check, T.LongType())])
        heads = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(id_), F.col("key").alias(k), F.col("check").alias(c), F.col("label").alias(label)).distinct()
        rows = apart.mapInArrow(_keyed(key, check), schema).join(heads, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(k)) & (F.col(check) == F.col(c)))
        rows = staged(rows, "join-apart")
        by = [F.col("doc_id").alias(id_), F.coalesce(label, key).alias(group), F.when(F.col(label).isNull(), F.col(check)).alias(c)]
        one = rows.filter("doc_id is not null").groupBy(*by).agg(F.min_by(F.struct(*docs.columns), F.struct(key, check, "text")).alias(row)).select(f"{row}.*")
        return kept.select(*docs.columns).unionByName(one).unionByName(rows.filter("doc_id is null").select(*docs.columns))
