"""Records of large text files with their place in them, read by as many tasks as the files have blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks up to which their offsets are broadcast (about 30 MB).
BLOCKS = 200_000


def numbered(spark: SparkSession, path: str, mark: str, real: Column) -> DataFrame:
    """file, pos, value: the records of text files at path, each from one `mark` to the next, in file order.

    real: a condition on `value` that tells records from what stands before the first mark of a file. pos counts them from 0
    across all files by name, without gaps as long as whatever is not real stands before the others of its block. Files are
    split (unless compressed): a first pass counts each block's records, their running sum is a small table, and the second
    pass adds it to a record's place in its block. If both passes do not split the files alike, reading fails."""
    at = F.monotonically_increasing_id()  # (task, place in the task): in order within a block
    rows = spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    rows = rows.filter(real)
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")  # a row for each block
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    placed = rows.join(F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks, ["file", "block"], "left")
    alike = F.shiftright("at", 33) == F.shiftright("first", 33)
    pos = F.when(alike, F.col("before") + F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("the files were split in another way by the second pass")).cast("long"))
    return placed.select("file", pos.alias("pos"), "value")


#: The attributes of a tag's beginning; a `>` may stand in a value.
_ATTRIBUTES = r"""^(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*+"|'[^']*+'))++"""


def tagged(spark: SparkSession, path: str, tag: str, names: list[str]) -> DataFrame:
    """pos and the named attributes (strings, null where absent) of all elements of that tag, which must not nest."""
    rows = numbered(spark, path, f"<{tag}", F.col("value").rlike(_ATTRIBUTES))
    element = F.concat(F.lit(f"<{tag}"), F.regexp_extract("value", _ATTRIBUTES, 0), F.lit("/>"))
    row = F.from_xml(element, ", ".join(f"`_{n}` string" for n in names))
    return rows.select("pos", row.alias("r")).select("pos", *[F.col(f"r._{n}").alias(n) for n in names])
