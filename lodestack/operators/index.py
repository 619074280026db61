"""The search index as tables: records, postings and term statistics, and contexts for chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import embed_text, words
from lodestack.operators import blockmax
from lodestack.operators.retrieval import HIT_FIELDS, bm25_of_postings, build_where, hybrid, knn, postings, rerank, small

RECORD = ["id", "doc_id", "source_type", "source_url", "title", "version", "section", "symbol", "kind", "text", "embed_text", "vector"]


def records(chunks: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Chunks as index records: missing extras are empty, embed_text is context and text, vector its encoding."""
    have = set(chunks.columns)
    pick = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    out = chunks.withColumn("embed_text", embed_text(pick("context"), F.col("text")))
    return out.withColumn("vector", encode(F.col("embed_text"))).select(*[F.col(c) if c in ("vector", "embed_text", "text", "id", "doc_id") else pick(c).alias(c) for c in RECORD])


def build_table(chunks: DataFrame, encode: Callable[[Column], Column], root: str, forms: tuple[str, ...] = ("postings", "blocks")) -> None:
    """Write records, postings (sorted by term), document frequencies, statistics and postings in blocks below root, replacing
    what is there. forms: which of the two forms of postings are written; lexical() reads one of them.

    Raises ValueError without any chunk. Records are partitioned by source type; ids are not made unique."""
    if chunks.isEmpty():
        raise ValueError("no chunks to index")
    records(chunks, encode).write.mode("overwrite").option("compression", "zstd").partitionBy("source_type").parquet(f"{root}/records")
    spark = chunks.sparkSession
    lengths = spark.read.parquet(f"{root}/records").select(F.size(words(F.col("embed_text"))).alias("dl"))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{root}/stats")
    if "postings" in forms:
        own = postings(spark.read.parquet(f"{root}/records"), "id", "embed_text")
        own.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{root}/postings")
    if "blocks" in forms:
        blockmax.write_blocks(spark.read.parquet(f"{root}/records"), spark.read.parquet(f"{root}/stats").first()["avgdl"], f"{root}/blocks")
    held = spark.read.parquet(f"{root}/{forms[0]}")
    held.groupBy("term").agg((F.count("*") if forms[0] == "postings" else F.sum("n")).alias("df")).write.mode("overwrite").parquet(f"{root}/terms")


def open_table(spark: SparkSession, root: str, name: str = "records") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def lexical(spark: SparkSession, root: str, queries: DataFrame, k: int = 40, where: Column | None = None, pruned: bool = False) -> DataFrame:
    """query_id, id, score, rank by BM25 over embed_text, read from the postings of the queries' terms. where: on records.

    pruned: by blocks, of which only those are decoded that can hold a result; it pays where k is small against the table."""
    n, avgdl = open_table(spark, root, "stats").first()
    allowed = None if where is None else open_table(spark, root).filter(where).select(F.col("id").alias("doc_id"))
    if pruned:
        found = blockmax.Search(queries, open_table(spark, root, "blocks"), open_table(spark, root, "terms"), n, avgdl, k, allowed).results()
        return found.withColumnRenamed("doc_id", "id")
    found = bm25_of_postings(queries, open_table(spark, root, "postings"), open_table(spark, root, "terms"), n, avgdl, k, allowed)
    return found.withColumnRenamed("doc_id", "id")


def search(spark: SparkSession, root: str, queries: DataFrame, encode: Callable[[Column], Column], top_k: int = 6, source_type: str | None = None, version: str | None = None, mode: str = "hybrid", score: Callable[[Column, Column], Column] | None = None, candidates: int = 40) -> DataFrame:
    """The hits of each query (query_id, query), best first. mode: vector, hybrid, or symbol (hybrid with symbol names).

    score: a reranker of (query, text), applied to `candidates` hits. Of the records only ids, vectors and what the mode
    asks for are read, whole ones only for hits."""
    table = open_table(spark, root)
    where = build_where(source_type, version)
    asked = queries.select("query_id", "query")
    dense = knn(asked.withColumn("vector", encode(F.col("query"))), (table if where is None else table.filter(where)).select("id", "vector"), candidates)
    cut = candidates if score else top_k
    if mode == "vector":
        ranked = dense.filter(F.col("rank") <= cut)
    else:
        named = mode == "symbol"
        ranked = hybrid(dense, lexical(spark, root, asked, candidates, where), table if named else None, asked if named else None, cut, candidates)
    if score:
        texts = ranked.join(table.select("id", "text"), "id").join(small(asked), "query_id")
        ranked = rerank(texts, score(F.col("query"), F.col("text")), top_k).select("query_id", "id", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"))
    return hits(ranked.select("query_id", "id", "score", "rank"), table)


def hits(ranked: DataFrame, table: DataFrame) -> DataFrame:
    """Ranked ids (query_id, id, score, rank) with the fields of a hit; the score is rounded to 6 digits."""
    return ranked.join(table.select(*HIT_FIELDS), "id").withColumn("score", F.round("score", 6))


def with_context(chunks: DataFrame, docs: DataFrame, generate: Callable[[list[str], list[str]], list[str]], scope: list[str] | None = None) -> DataFrame:
    """Chunks with a context from a generator of (document texts, chunk texts), at most 64 at a time.

    Chunks that have one, or whose source type is out of scope (none: all are in), stay as they are. A chunk without its
    document is given its own text instead; of documents with one id the last by text counts."""
    texts = docs.groupBy(F.col("id").alias("doc_id")).agg(F.max("text").alias("_document"))
    rows = chunks.join(texts, "doc_id", "left").withColumn("_document", F.coalesce("_document", "text"))
    wanted = F.coalesce(F.col("context"), F.lit("")) == ""
    if scope:
        wanted = wanted & F.col("source_type").isin(scope)
    rows = rows.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).withColumn("_document", F.when(F.col("_wanted"), F.col("_document")))
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a batch few documents at a time become Python strings.
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                asked = part.filter(part.column("_wanted"))
                made = iter(generate(asked.column("_document").to_pylist(), asked.column("text").to_pylist()) if asked.num_rows else ())
                context = [next(made) if ask else own for ask, own in zip(part.column("_wanted").to_pylist(), part.column("context").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(context, pa.string()) if c == "context" else part.column(c) for c in columns], columns)

    return rows.select(*columns, "_document", "_wanted").mapInArrow(run, chunks.schema)


def node_graph_text(graph: dict) -> str:
    """A node graph as text: a heading, its nodes with their inputs, and its links."""
    lines = [f"{graph.get('kind', 'node').capitalize()} node graph: {graph.get('name', '')}".rstrip(), "", "Nodes:"]
    for node in graph.get("nodes", []):
        given = ", ".join(f"{k}={_value(v)}" for k, v in (node.get("inputs") or {}).items())
        lines.append(f"  - {node.get('type', '?')} '{node.get('name', '')}'" + (f"  ({given})" if given else ""))
    ends = [[link.get(f"{side}_{part}", "?") for side in ("from", "to") for part in ("node", "socket")] for link in graph.get("links", [])]
    return "\n".join(lines + (["", "Links:"] if ends else []) + [f"  - {a}.{b} -> {c}.{d}" for a, b, c, d in ends])


def _value(v) -> str:
    if isinstance(v, float):
        return f"{v:.3g}"
    if isinstance(v, list | tuple):
        return f"[{len(v)} values]" if len(v) > 4 else "(" + ", ".join(map(_value, v)) + ")"
    return str(v)


def node_graphs(graphs: DataFrame, column: str = "graph") -> DataFrame:
    """Graphs as JSON text with their rendering in `text`."""
    import json

    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def render(values: pd.Series) -> pd.Series:
        return values.map(lambda g: node_graph_text(json.loads(g)) if g else None)

    return graphs.withColumn("text", render(column))
