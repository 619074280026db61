"""Sharding by histogram sort (Solomonik and Kale 2010): exact counts below candidate keys, refined probes, one exchange.

The driver refines the few splitters between shards. Within a shard rows are exchanged in pieces, named by the leading bits of
their key, whose number follows the bytes; their offsets come from one more histogram, so nothing is counted after the
exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_LOW = -(1 << 63)
_DIGIT = 12
#: Widths of the radix digits of one 64-bit key word.
_WIDTHS = (12, 12, 12, 12, 12, 4)


@dataclass
class _Splitter:
    """One boundary: rows with (hi, lo) at or above it belong to the right. hi, lo are unsigned."""

    target: float
    near: float  # accepted distance from the target
    apart: float  # distance up to which a boundary between two groups is preferred to cutting a group
    word: int = 0
    prefix: int = 0
    depth: int = 0
    bytes_below: int = 0
    hi: int = 0
    key: tuple[int, int] | None = None


def _unsigned(column: str) -> Column:
    """Flip the sign bit, so that the unsigned order of the bits is the signed order of the value."""
    return F.col(column).bitwiseXOR(F.lit(_LOW))


def _signed(value: int) -> int:
    return value - (1 << 63)


def split_points(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """Boundaries of the shards' key ranges, in order.

    keys: hi, lo, size. Every round is one partially aggregated count over the open prefixes only; the driver sees at most
    4096 sums for each open splitter."""
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    share = total / shards
    splitters = [_Splitter(total * j / shards, share * tolerance, share * group_tolerance) for j in range(1, shards)]
    while open_ := [s for s in splitters if s.key is None]:
        for word, depth in sorted({(s.word, s.depth) for s in open_}):
            now = [s for s in open_ if (s.word, s.depth) == (word, depth)]
            shift = 64 - sum(_WIDTHS[: depth + 1])
            digit = F.shiftrightunsigned(_unsigned("lo" if word else "hi"), shift) if shift else _unsigned("lo" if word else "hi")
            rows = keys
            if word:
                rows = rows.filter(F.col("hi").isin(sorted({_signed(s.hi) for s in now})))
            if depth:
                above = 64 - sum(_WIDTHS[:depth])
                rows = rows.filter(F.shiftrightunsigned(_unsigned("lo" if word else "hi"), above).isin(sorted({s.prefix for s in now})))
            by = (["hi"] if word else []) + ["digit"]
            found = rows.withColumn("digit", digit).groupBy(*by).agg(F.sum("size").alias("b"), F.min("hi").alias("low"), F.max("hi").alias("high")).collect()
            bins: dict[tuple[int, int], list] = {}
            for r in found:
                d = r["digit"] % (1 << 64)
                bins.setdefault((r["hi"] if word else 0, d >> _WIDTHS[depth]), []).append((d, int(r["b"]), r["low"], r["high"]))
            for s in now:
                _probe(s, sorted(bins.get((_signed(s.hi) if word else 0, s.prefix), [])), shift)
    return sorted(s.key for s in splitters)


def _probe(s: _Splitter, bins: list, shift: int) -> None:
    """Settle the splitter on an edge of the bin that holds its target, or go down into that bin."""
    for d, size, low, high in bins:
        if s.bytes_below + size < s.target and d != bins[-1][0]:
            s.bytes_below += size
            continue
        left = (abs(s.bytes_below - s.target), s.bytes_below, d << shift)
        right = (abs(s.bytes_below + size - s.target), s.bytes_below + size, (d + 1) << shift)
        best = min(left, right)
        group = s.word == 0 and low == high
        last = shift == 0
        if best[0] <= s.near or group and best[0] <= s.apart or s.word == 1 and last:
            value = min(best[2], (1 << 64) - 1)
            if group:  # edges of a single group, whatever the depth
                value = low + (1 << 63) if best is left else low + (1 << 63) + 1
            s.bytes_below = best[1]
            s.key = (min(value, (1 << 64)), 0) if s.word == 0 else (s.hi, value)
            if best is right and s.word == 1 and best[2] >= 1 << 64:
                s.key = (s.hi + 1, 0)
        elif group:
            s.word, s.depth, s.prefix, s.hi = 1, 0, 0, low + (1 << 63)
        else:
            s.depth, s.prefix = s.depth + 1, d
        return
    s.key = (0, 0)  # no rows at all


def _bucket(points: list[tuple[int, int]], hi_: Column, lo_: Column) -> Column:
    """Number of points at or below the row's key, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        hi, lo = points[mid]
        if hi >= 1 << 64:
            return tree(low, mid)
        left = (hi_ < _signed(hi)) | ((hi_ == _signed(hi)) & (lo_ < _signed(lo))) if lo else hi_ < _signed(hi)
        return F.when(left, tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(points))


PIECE = ["shard", "lead", "hot", "hot_hi", "part"]


def _pieced(keys: DataFrame, shards: int, points: list[tuple[int, int]], bits: int, hot: DataFrame | None) -> DataFrame:
    """Rows (hi, lo) with the columns of PIECE: the shard, the leading bits of the key, and for a hot group its key and the
    part of its ids."""
    lead = F.shiftrightunsigned(_unsigned("hi"), 64 - bits) if bits else F.lit(0).cast("long")
    rows = keys.withColumns({"shard": _bucket(points, F.col("hi"), F.col("lo")) if points else F.lit(0), "lead": lead})
    if hot is None:
        return rows.withColumns({"hot": F.lit(False), "hot_hi": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    rows = rows.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "hi", "left")
    # The number of cuts at or below the id; between two cuts a very large group is cut on, evenly.
    at = F.size(F.filter("cuts", lambda c: c <= F.col("lo")))
    low, high = F.coalesce(F.get("cuts", at - 1), F.col("first")).cast("double"), F.coalesce(F.get("cuts", at), F.col("last")).cast("double")
    inner = F.greatest(F.lit(0), F.least(F.floor((F.col("lo").cast("double") - low) / (high - low + 1) * F.col("inner")).cast("long"), F.col("inner") - 1))
    flag = F.col("cuts").isNotNull()
    return rows.withColumns({"hot": flag, "hot_hi": F.when(flag, F.col("hi")).otherwise(0), "part": F.when(flag, at * F.col("inner") + inner).otherwise(0)}).drop("first", "last", "cuts", "inner")


#: Quantiles of the ids of a hot group that its parts are cut at.
KNOTS = 256


def _hot(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """hi, first, last, cuts, inner of groups (hi) beyond piece_bytes: parts follow quantiles of the ids, so neither a stray id
    nor a null one (the least) takes the others into one part."""
    quantiles = F.percentile_approx("lo", [k / KNOTS for k in range(1, KNOTS)], 10_000)
    sums = rows.groupBy("hi").agg(F.sum("size").alias("bytes"), F.min("lo").alias("first"), F.max("lo").alias("last"), quantiles.alias("q"))
    sums = sums.filter(F.col("bytes") > piece_bytes).withColumn("parts", F.ceil(F.col("bytes") / piece_bytes)).withColumn("knots", F.least(F.col("parts"), F.lit(KNOTS)).cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("knots") - 1), lambda k: F.get("q", F.floor(k * KNOTS / F.col("knots")).cast("int") - 1))
    return sums.select("hi", "first", "last", F.array_distinct(cuts).alias("cuts"), F.ceil(F.col("parts") / F.col("knots")).alias("inner"))


def histogram_shard(df: DataFrame, group: Column, row_id: str, size: Column, shards: int = 8, tolerance: float = 0.001, group_tolerance: float = 0.01, piece_bytes: int = 64 << 20) -> DataFrame:
    """Deal rows into `shards` of near equal bytes, in the order of (hash of group, row_id): adds shard, slot, size.

    group: what equal rows share; equal groups stand next to each other, so that a shard boundary cuts one only when keeping
    it whole would miss a shard's share by more than group_tolerance. A hot group is cut by row id as often as needed.
    slot: position in the shard, gapless from 0, in the order of the pieces: of about piece_bytes each, by the leading bits of
    the hash; a group of more than that comes after the others of its leading bits, in parts by row id. There are as many
    pieces as the bytes ask for.

    Nulls: a null group, id or size counts as empty text, the least id and 0. Rows alike in group and id always share a
    piece, in either order. An empty table gives an empty result. Columns of any name pass through; own columns named shard,
    slot or size are replaced."""
    work = df.drop("shard", "slot", "size").withColumn("size", F.coalesce(size, F.lit(0)).cast("long"))
    hi, lo = F.xxhash64(F.coalesce(group, F.lit(""))), F.coalesce(F.col(row_id).cast("long"), F.lit(_LOW))
    keys = staged(work.select(hi.alias("hi"), lo.alias("lo"), "size"), "shard-keys")
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    points = split_points(keys, shards, tolerance, group_tolerance) if total else [(0, 0)] * (shards - 1)
    bits = min(40, max(0, (total // piece_bytes).bit_length()))
    # Leading bits are even but for hot groups, so only overfull pieces are searched for those.
    plain = _pieced(keys, shards, points, bits, None)
    full = staged(plain.groupBy("lead").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * piece_bytes).select("lead"), "shard-full")
    hot = None
    if not full.isEmpty():
        few = F.broadcast(full) if full.count() <= 1_000_000 else full
        hot = staged(_hot(plain.join(few, "lead", "left_semi"), piece_bytes), "shard-hot")
    pieces = _pieced(keys, shards, points, bits, hot).groupBy(*PIECE).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy(*PIECE[1:]).rowsBetween(Window.unboundedPreceding, -1)
    pieces = staged(pieces.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"), "shard-pieces", spent=(full,))
    rows = work.select(F.struct(*work.columns).alias("row"), hi.alias("hi"), lo.alias("lo"))
    rows = _pieced(rows, shards, points, bits, hot).join(F.broadcast(pieces) if pieces.count() <= 1_000_000 else pieces, PIECE)
    order = Window.partitionBy(*PIECE).orderBy("hi", "lo")
    placed = rows.withColumn("at", F.row_number().over(order).cast("long") - 1 + F.col("base"))
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), F.col("at").alias("slot"))


def op8_histogram_shard(spark, sf_dir: str) -> DataFrame:
    """All documents into 8 shards of near equal bytes; the digest of the contract."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"))
    narrow = docs.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").alias("n"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = histogram_shard(narrow, F.col("digest"), "doc_id", F.col("n") + 1)
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
