"""Near copies by SimHash fingerprints, found with the general pigeonhole principle (Qin, Wang, Xiao, Wang and Lin 2018).

The 64 bits are grouped into partitions of correlated bits. If two fingerprints differ in at most `most` bits and the thresholds
of the partitions add up to most + 1 - partitions, then some partition differs in no more bits than its own threshold. Thresholds
need not be equal (-1 leaves a partition out): dynamic programming deals them out by estimated numbers of probes and candidates.
Fingerprints meet in buckets of a partition's value, neighbouring values are probed, and every candidate is verified on all
bits. Copies are one fingerprint throughout; buckets return only links that join components, never the pairs of a group."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, matched, release, shuffle_parts, small_batches, staged
from .textbytes import mix

WORDS, SEED, BITS = 4, 42, 64
#: Cost of a shuffled row, and of a verified candidate, in the same unit.
ROW, VERIFY = 1.0, 0.005
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _shingles(words: list[bytes]) -> list[int]:
    """XXH64 of each run of WORDS words."""
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    ends = (start + size)[WORDS - 1 :].tolist()
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)]


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text: bit k is set if over half of the shingles' hashes have it. Long texts are read in pieces."""
    counts, n, at, words = np.zeros(BITS, np.int64), 0, 0, []
    text = text or b""
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = blank.start() if blank else len(text)
        words = words[-(WORDS - 1) :] + text[at:stop].lower().split()
        if len(words) >= WORDS:
            hashes = np.array(_shingles(words), dtype="<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        at = stop
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, dtype=_U).view(np.int64))], ["doc_id", "fp"])


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints have bits i and j set, for one partition of rows."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = _bits(_unsigned(batch.column("fp"))).astype(np.float32)
        for k in range(0, len(bits), 1 << 16):
            total += (bits[k : k + (1 << 16)].T @ bits[k : k + (1 << 16)]).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "c"])


def bit_groups(together: np.ndarray, n: int, count: int) -> list[list[int]]:
    """Partitions of nearly equal width; a bit joins the group that it is most correlated with.

    together: numbers of fingerprints with both bits, of n. Bits that go together make a partition's values repeat, so they
    are put into one, which then gets the lower threshold, and the others tell fingerprints apart the better."""
    share = together / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for k in range(count):
        width = BITS // count + (k < BITS % count)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (tied[b, rest].sum(), -b))]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (tied[b, group].mean(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def near_share(group: list[int], p: np.ndarray, sample: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most t bits of the group, t = 0 to most: what independent bits would give, or
    what a sample shows where that is more."""
    alike = np.zeros(most + 1)
    alike[0] = 1
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        alike = alike * (1 - differ) + np.append(0, alike[:-1]) * differ
    seen = np.zeros(most + 1)
    own = sample & _U(_mask(group))
    for k in range(0, len(own), 512):
        apart = np.bitwise_count(own[k : k + 512, None] ^ own[None, :])
        seen += np.bincount(apart[apart <= most], minlength=most + 1)
    seen[0] -= len(own)
    return np.maximum(np.cumsum(alike), np.cumsum(seen) / max(1, len(own) * (len(own) - 1)))


def thresholds(groups: list[list[int]], shares: list[np.ndarray], n: int, most: int) -> tuple[float, list[int]]:
    """(cost, thresholds) of the cheapest way to deal most + 1 units to the groups; a group with k units has threshold k - 1.

    If every group differed in more bits than its threshold, all together would differ in most + 1 bits or more."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group, share in zip(groups, shares, strict=True):
        probes = np.cumsum([math.comb(len(group), t) for t in range(most + 1)])
        after: dict[int, tuple[float, list[int]]] = {}
        for units, (cost, own) in best.items():
            for k in range(most + 2 - units):
                price = cost + (n * (1 + (probes[k - 1] - 1) / 2) * ROW + n * n / 2 * share[k - 1] * VERIFY if k else 0)
                if units + k not in after or price < after[units + k][0]:
                    after[units + k] = price, [*own, k - 1]
        best = after
    return best[most + 1]


def plan(prints: DataFrame, n: int, most: int, sample: int) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each partition that takes part. Co-occurrence of bits is counted over all fingerprints; about
    `sample` of them, by hash, help to estimate candidates, which changes the cost and never the result."""
    rows = prints.select("fp").mapInArrow(_together, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # 4,096 rows
    together = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        together[r["i"], r["j"]] = r["c"]
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    seen = _unsigned(prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).select("fp").toArrow().column("fp").combine_chunks())
    p = np.diag(together) / max(1, n)
    found = []
    for count in range(1, most + 2):
        groups = bit_groups(together, n, count)
        cost, limits = thresholds(groups, [near_share(g, p, seen, most) for g in groups], n, most)
        found.append((cost, [(_mask(g), t) for g, t in zip(groups, limits, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _flips(mask: int, most: int) -> np.ndarray:
    """Sets of 1 to `most` bits of the mask."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(1 << b for b in chosen) for t in range(1, most + 1) for chosen in combinations(bits, t)], dtype=_U)


PLACED = "bucket long, fp long, probe boolean"


def _placed(partitions: list[tuple[int, int]]):
    """Rows of a fingerprint: one in the bucket of each partition's value, and one for each smaller value within the threshold.

    Of two values the larger one probes the smaller, so that each pair of values meets once."""

    def rows(bucket: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), probe))], ["bucket", "fp", "probe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [_flips(mask, t) for mask, t in partitions]
        for batch in batches:
            fp = _unsigned(batch.column("fp"))
            for k, (mask, _) in enumerate(partitions):
                own = fp & _U(mask)
                name = lambda value, k=k: mix(value ^ _U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))  # noqa: E731  a bijection in each partition
                yield rows(name(own), fp, False)
                step = max(1, (1 << 18) // max(1, len(fp)))
                for at in range(0, len(flips[k]), step):
                    near = own[:, None] ^ flips[k][None, at : at + step]
                    who, which = np.nonzero(near < own[:, None])
                    yield rows(name(near[who, which]), fp[who], True)

    return run


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Labels after joining those of a and b pairwise, and the places of the pairs that joined anything."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    used = []
    pairs = np.stack([label[a], label[b]], axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    for k in first.tolist():
        x, y = top(int(pairs[k, 0])), top(int(pairs[k, 1]))
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(k)
    if used:
        names, back = np.unique(label, return_inverse=True)
        label = np.array([top(int(x)) for x in names], dtype=np.int64)[back]
    return label, used


def bucket_links(fp: np.ndarray, probe: np.ndarray, label: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Places of links that join labels, among all pairs of which one at least is no probe.

    Rows are compared in blocks that double in size, and only with rows of another label; once a group of near copies has grown
    together, its members meet no more than what stands outside of it."""
    left = np.flatnonzero(~probe)
    found: list[tuple[int, int]] = []
    at, width = 0, len(left) if len(fp) <= 64 else 1
    while at < len(left):
        block = left[at : at + width]
        at, width = at + width, min(2 * width, 128)
        names, back, size = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) == 1:
            break
        inside = back == size.argmax()
        for rows, cols in ((block[inside[block]], np.flatnonzero(~inside)), (block[~inside[block]], np.arange(len(fp)))):
            if not len(rows) or not len(cols):
                continue
            near = np.bitwise_count(fp[rows, None] ^ fp[None, cols]) <= most
            i, j = np.nonzero(near)
            a, b = rows[i], cols[j]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if len(a):
                label, used = _roots(label, a, b)
                found += [(int(a[k]), int(b[k])) for k in used]
    return found


def _cells(most: int):
    """Links within runs of rows of one cell. Rows (cell, fp, probe, label) come sorted by cell."""

    def links(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(part).combine_chunks()
        cell, fp, label = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "fp", "label"))
        probe = table.column("probe").combine_chunks().to_numpy(zero_copy_only=False)
        x = fp.astype(np.int64).view(_U)
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        ends = np.append(cuts[1:], len(cell))
        a, b = [], []
        many = ends - cuts > 1
        for s, t in zip(cuts[many].tolist(), ends[many].tolist(), strict=True):
            for i, j in bucket_links(x[s:t], probe[s:t], label[s:t].copy(), most):
                a.append(fp[s + i]), b.append(fp[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(cell == cell[-1], True))  # the last cell may go on in the next batch
            if last or (held and held[-1].column("cell")[-1].as_py() != cell[0]):
                yield from links([*held, batch.slice(0, last)] if last else held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from links(held)

    return run


CELL = "cell long, fp long, probe boolean, label long"


def _compared(rows: DataFrame, most: int, parts: int) -> DataFrame:
    dealt = rows.select("cell", "fp", "probe", "label").repartition(parts, "cell").sortWithinPartitions("cell", "probe", "fp")
    return dealt.mapInArrow(_cells(most), "a long, b long")


def _named(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """frame with the label of each fingerprint, itself where it has no link yet."""
    return frame.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def _salt(count, also: int = 0):
    return F.pmod(F.xxhash64(F.col("fp"), F.lit(also)), count)


def links(prints: DataFrame, most: int = 4, sample: int = 4096, heavy: int = 8192, leaders: int = 64, rows_a_part: int = 1_000_000) -> DataFrame:
    """Components (node, label) of distinct fingerprints (fp) under links of at most `most` differing bits; only linked ones.

    heavy: rows of a bucket that one task compares. In a larger bucket about `leaders` of its fingerprints, by hash, first meet
    all others, in cells of about that size; a group of near copies grows together there. What is still outside of the bucket's
    largest component then meets all of its rows, in cells as well, so nothing is lost and no task holds more than a cell."""
    n = prints.count()
    if n < 2:
        return prints.sparkSession.createDataFrame([], "node long, label long")
    placed = staged(prints.select("fp").mapInArrow(_placed(plan(prints, n, most, sample)), PLACED), "sim-placed")
    size = staged(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > heavy), "sim-heavy")
    total = placed.count()
    parts = max(shuffle_parts(prints.sparkSession), total // rows_a_part)
    light = matched(placed, size.select("bucket"), "bucket", "left_anti").select(F.col("bucket").alias("cell"), "fp", "probe", F.col("fp").alias("label"))
    edges = staged(_compared(light, most, parts), "sim-links")
    if size.isEmpty():
        return components(edges)
    small = size.count() <= 500_000  # 16 bytes each
    crowd = staged(placed.join(F.broadcast(size) if small else size, "bucket"), "sim-crowd", spent=(placed,))
    cells = F.ceil(F.col("n") / heavy).cast("int")
    first = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")) < leaders
    name = lambda *of: F.xxhash64("bucket", *of)  # noqa: E731  a clash only compares more
    ahead = crowd.filter(first).select(F.explode(F.sequence(F.lit(0), cells - 1)).alias("salt"), "bucket", "fp").select(name("salt").alias("cell"), "fp", F.lit(False).alias("probe"), F.col("fp").alias("label"))
    behind = crowd.filter(~first).select(name(_salt(cells).cast("int")).alias("cell"), "fp", F.lit(True).alias("probe"), F.col("fp").alias("label"))
    parts = max(shuffle_parts(prints.sparkSession), crowd.count() // (16 * heavy))
    star = staged(_compared(ahead.unionByName(behind), most, parts), "sim-star")
    labels = staged(components(edges.unionByName(star)), "sim-labels")
    known = staged(_named(crowd, labels), "sim-known", spent=(crowd,))
    shares = known.groupBy("bucket", "label").agg(F.count("*").alias("own"))
    major = shares.groupBy("bucket").agg(F.max_by("label", F.struct("own", "label")).alias("major"), F.sum("own").alias("n"), F.max("own").alias("most")).filter("most < n")
    major = staged(major.select("bucket", "major", (F.col("n") - F.col("most")).alias("rest")), "sim-open")
    if major.isEmpty():
        return labels
    open_ = known.join(F.broadcast(major) if small else major, "bucket")
    across, along = F.ceil(F.col("rest") / heavy).cast("int"), cells
    steps = lambda count, as_: F.explode(F.sequence(F.lit(0), count - 1)).alias(as_)
    outside = open_.filter("label <> major").withColumn("x", _salt(across, 1).cast("int")).select("*", steps(along, "y")).select(name("x", "y").alias("cell"), "fp", F.lit(False).alias("probe"), "label")
    every = open_.withColumn("y", _salt(along, 2).cast("int")).select("*", steps(across, "x")).select(name("x", "y").alias("cell"), "fp", F.lit(True).alias("probe"), "label")
    rest = staged(_compared(outside.unionByName(every), most, parts), "sim-rest", spent=(major,))
    out = components(edges.unionByName(star).unionByName(rest))
    for table in (edges, star, rest, known):
        release(table)
    return out


def simhash_components(docs: DataFrame, most: int = 4, **limits: int) -> DataFrame:
    """One row for each document: doc_id, fp (64 bits, signed), component_id (the smallest doc_id reachable by links).

    docs: doc_id, text; other columns are not read. A-Z are lower-cased, words are runs without the six white-space bytes, and
    shingles have four words, repeats included (fewer words: the whole sequence). A null or empty text has no words, its
    fingerprint is 0 and is linked like any other. Copies and repeated rows share a fingerprint. A null doc_id takes part in
    links, but names a component only if it has no other member (then null). A bit that just half of the shingles set is 0. An
    empty table gives no rows. limits: see links()."""
    with small_batches(docs.sparkSession):
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        own = staged(own.mapInArrow(_prints, "doc_id long, fp long"), "sim-docs")
    prints = staged(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sim-prints")
    with small_batches(docs.sparkSession, 20_000):
        labels = staged(links(prints, most, **limits), "sim-components")
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    least = named.filter("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    groups = named.filter("copies > 1 or label is not null").join(least, "label", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return own.join(groups, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
