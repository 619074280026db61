"""Retrieval quality over hit tables: hit@k, recall@k, reciprocal rank, by query type and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["title", "source_url", "symbol", "section"]


def hit_matches(expect: Column, *fields: Column) -> Column:
    """The expected text occurs in the joined fields, whatever the case. Expects no nulls in the fields (see text_of)."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lower(expect))


def text_of(field: Column) -> Column:
    """A field as matching reads it: a null is the word None."""
    return F.coalesce(field.cast("string"), F.lit("None"))


def query_metrics(queries: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """query_id, type, hit, recall, rr, first_rank.

    queries: query_id, type, n_expect. matches: one row for each hit that matches an expectation: query_id, rank, expect_no.
    rr uses the whole list, hit and recall the first k; a query without expectations gets zeros."""
    best = matches.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.countDistinct(F.when(F.col("rank") <= k, F.col("expect_no"))).alias("found"))
    joined = queries.join(best, "query_id", "left")
    some = F.col("n_expect") > 0
    return joined.select(
        "query_id", "type",
        F.when(some & (F.col("first_rank") <= k), 1.0).otherwise(0.0).alias("hit"),
        F.when(some, F.coalesce(F.col("found"), F.lit(0)) / F.col("n_expect")).otherwise(0.0).alias("recall"),
        F.when(some & F.col("first_rank").isNotNull(), 1.0 / F.col("first_rank")).otherwise(0.0).alias("rr"),
        F.when(some, F.col("first_rank")).alias("first_rank"),
    )


def macro(per_query: DataFrame, by_type: bool = False) -> DataFrame:
    """Means of hit, recall and rr with the number of queries; by_type adds a row for each type (`?` without one)."""
    rows = per_query.withColumn("type", F.coalesce("type", F.lit("?")))
    aggs = [F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_at_k"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.count("*").alias("n")]
    if not by_type:
        return rows.agg(*aggs)
    return rows.rollup("type").agg(*aggs).withColumn("type", F.coalesce("type", F.lit("(all)")))


def misses(per_query: DataFrame) -> DataFrame:
    return per_query.filter("hit = 0").select("query_id", "type")
