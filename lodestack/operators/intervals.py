"""Joins of points and intervals by equality of buckets: no nested loop, whatever the lengths of the intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets double in width from level to level; beyond this many levels an interval would be longer than 2^62 units.
LEVELS = 62


def _level(length: Column) -> Column:
    """The least level whose buckets are at least as wide: an interval touches two of them at most."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("int")
    level = F.least(F.lit(LEVELS), level)
    short = length > F.call_function("shiftleft", F.lit(1).cast("long"), level)  # log2 was rounded down
    return F.least(F.lit(LEVELS), level + F.when(short, 1).otherwise(0))


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def stab_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points with the intervals of their keys that hold them: start <= at < end. how: inner or left.

    Times are whole numbers (cast them to microseconds first). An interval stands in the one or two buckets that it touches on
    the level of its length, a point in one bucket of each level that occurs (62 at most), so a pair meets exactly once, and
    neither a long interval nor a long span of time makes rows grow. All joins here shuffle: sizes of files say nothing about rows
    that are repeated by level, so such a side must not be broadcast. Nulls in keys, times or bounds, and empty intervals, meet
    nothing. All columns are kept; names that both sides have, other than keys, are an error."""
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash or how not in ("inner", "left"):
        raise ValueError(f"columns on both sides: {sorted(clash)}" if clash else f"no join of kind {how}")
    sound = intervals.filter(F.col(start) < F.col(end)).withColumn("_level", _level(F.col(end) - F.col(start)))
    levels = [r[0] for r in sound.select("_level").distinct().collect()]  # LEVELS at most
    first, last = _shift(F.col(start), F.col("_level")), _shift(F.col(end) - 1, F.col("_level"))
    placed = sound.withColumn("_bucket", F.explode(F.sequence(first, last)))
    near = points.withColumn("_level", F.explode_outer(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_bucket", _shift(F.col(at), F.col("_level")))
    inside = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    met = near.join(placed.hint("merge"), [*keys, "_level", "_bucket"]).filter(inside).drop("_level", "_bucket")
    if how == "inner":
        return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])
    # Points are matched by all of their columns: repeated points get the same intervals.
    lone = points.join(met.select(*points.columns).distinct().hint("merge"), [points[c].eqNullSafe(met[c]) for c in points.columns], "left_anti")
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys]).unionByName(lone, allowMissingColumns=True)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of the same keys that share a point. Either the right one starts within the left one, or the left one
    starts within the right one and after it, so two stab_joins find each pair once."""
    a, b = left_bounds, right_bounds
    right_starts = stab_join(right.filter(F.col(b[0]) < F.col(b[1])), left, keys, b[0], *a)
    left_starts = stab_join(left.filter(F.col(a[0]) < F.col(a[1])), right, keys, a[0], *b).filter(F.col(a[0]) > F.col(b[0]))
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    return right_starts.select(*columns).unionByName(left_starts.select(*columns))

