"""A sieve for array elements: hashes that a small table cannot hold are dropped before they become rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sieve(hashes: DataFrame, rows: int, column: str = "h", most: int = 200_000) -> Callable[[Column], Column] | None:
    """A test of a 64-bit hash against the table `hashes` of `rows` rows: false means that the table does not hold it.

    The leading bits of each hash mark a byte of a literal (at most 4 MB), so at most `most` rows reach the driver. None for
    larger tables: they are joined without a sieve."""
    if rows > most:
        return None
    bits = min(22, max(14, (16 * rows).bit_length()))
    marks = bytearray(1 << bits)
    place = lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int")
    for r in hashes.select(place(F.col(column)).alias("k")).distinct().collect():
        marks[r["k"]] = 1
    table = bytes(marks)
    return lambda h: F.substring(F.lit(table), place(h) + 1, F.lit(1)) == F.lit(b"\1")
