"""Contexts for chunks, generated batch by batch and kept as they come: a run that dies has lost one batch at most."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.index import with_context


def finished(spark: SparkSession, store: str) -> DataFrame | None:
    """id, context of all batches that were written to their end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(conf)
    folders = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    whole = [str(p) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.schema("id string, context string").parquet(*whole) if whole else None


def generate(chunks: DataFrame, docs: DataFrame, model: Callable[[list[str], list[str]], list[str]], store: str, batches: int = 16, scope: list[str] | None = None) -> DataFrame:
    """chunks with the contexts that index.with_context() gives them, by way of a store of finished batches.

    Chunks without a context (in scope) that the store does not have are dealt into `batches` by a hash of their ids; each is
    one job whose rows become visible when it ends. A repeated call, after a failure or with more chunks, asks the model only
    for what is left. Chunks are told apart by id; a null id is not generated."""
    spark = chunks.sparkSession
    wanted = chunks.filter((F.coalesce("context", F.lit("")) == "") & F.col("id").isNotNull())
    if scope:
        wanted = wanted.filter(F.col("source_type").isin(scope))
    have = finished(spark, store)
    left = wanted if have is None else wanted.join(have.select("id"), "id", "left_anti").select(*chunks.columns)
    for k in range(batches):
        part = left.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        if not part.isEmpty():
            with_context(part, docs, model, scope).select("id", "context").write.parquet(f"{store}/batch-{uuid.uuid4().hex}")
    have = finished(spark, store)
    if have is None:
        return chunks
    known = have.groupBy("id").agg(F.min("context").alias("_context"))
    usable = F.coalesce("context", F.lit("")) == ""
    if scope:
        usable = usable & F.col("source_type").isin(scope)
    return chunks.join(known, "id", "left").withColumn("context", F.when(usable, F.coalesce("_context", "context")).otherwise(F.col("context"))).select(*chunks.columns)
