"""What the operators of this subpackage share: staged tables, ids and fold arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import scratch

#: Paths that staged() wrote since scope() was entered.
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of all tables that are staged inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def staged(df: DataFrame, name: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    spent: staged tables that no later step reads; they are deleted once df is written. What a result still reads stays, as
    results are lazy; whoever names the shared folder clears it after use."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    for table in spent:
        release(table)
    for paths in _scopes:
        paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows for what runs inside: texts and sets are large, and two workers share an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete a staged table, once no later step needs it; other tables are left alone."""
    path = getattr(df, "_staged_at", None)
    if path:
        dropped(df.sparkSession, path)


def free_prefix(columns: list[str], names: list[str], prefix: str = "__") -> str:
    """A prefix with which none of the names is one of the columns."""
    while any(prefix + n in columns for n in names):
        prefix += "_"
    return prefix


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def interval_of(column: Column, bounds: list) -> Column:
    """Number of bounds (sorted) at or below the value, by a balanced tree of comparisons that stays in generated code."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def matched(rows: DataFrame, ids: DataFrame, key: str, how: str, most: int = 1_000_000) -> DataFrame:
    """rows left_semi or left_anti joined with a one-column table of ids: broadcast up to `most` ids (8 MB), shuffled beyond."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, label (the least node reachable).

    Rounds of FastSV (Zhang, Azad and Buluc 2020): a node hears the least label's label among its neighbours, takes it and
    hands it on to the node that it was labelled by, so whole trees hook onto each other and chains shrink by more than
    halves. Each round is staged, and nothing but a test for changes reaches the driver. Labels only fall, so rounds end."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = staged(both, "cc-edges")
    # f: the node that labels a node; g: the one that labels f. At first every node has its least neighbour.
    begun = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("f")).withColumn("changed", F.lit(True))
    held = staged(_labelled_twice(begun), "cc-labels")
    while True:
        heard = both.join(held.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("near"))
        told = F.array(
            F.struct("node", F.least("f", "g", "near").alias("new"), F.col("f").alias("old")),
            F.struct(F.col("f").alias("node"), F.col("near").alias("new"), F.lit(None).cast("long").alias("old")),
        )
        told = held.join(heard, "node").select(F.explode(told).alias("x")).select("x.*")
        stepped = told.groupBy("node").agg(F.min("new").alias("f"), F.max("old").alias("old"))
        held = staged(_labelled_twice(stepped.select("node", "f", (F.col("f") < F.col("old")).alias("changed"))), "cc-labels", spent=(held,))
        if held.filter((F.col("changed")) | (F.col("f") != F.col("g"))).isEmpty():
            release(both)
            return held.select("node", F.col("f").alias("label"))


def _labelled_twice(labels: DataFrame) -> DataFrame:
    return labels.join(labels.select(F.col("node").alias("f"), F.col("f").alias("g")), "f").select("node", "f", "g", "changed")
