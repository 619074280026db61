"""The search as a table function of SQL: SELECT * FROM lodestack_search('how to ...', top_k => 5), or LATERAL for each row.

A function of Spark SQL is a query with parameters; Catalyst puts it in place of the call, so filters, joins and pruning see
through it, and with LATERAL a table of questions becomes a join instead of a loop."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestack.operators.index import open_table
from lodestack.operators.retrieval import K1, B

#: Rank constant of the fusion, and how many hits of each list it sees.
FUSE, CANDIDATES = 60, 40

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+', 0)"


def encoded(text: str, dim: int) -> str:
    """SQL for retrieval.hashed_encoder(dim) of a text: signed counts of its words' slots, length 1, as array<float>."""
    words = _WORDS.format(f"coalesce({text}, '')")
    summed = f"aggregate(transform({words}, w -> struct(CAST(pmod(xxhash64(w), {dim}) AS INT) AS slot, CASE WHEN pmod(xxhash64(w, 1), 2) = 1 THEN 1D ELSE -1D END AS sign)), array_repeat(0D, {dim}), (a, w) -> transform(a, (x, i) -> IF(i = w.slot, x + w.sign, x)))"
    return f"transform(array({summed}), raw -> transform(raw, x -> CAST(x / greatest(sqrt(aggregate(raw, 0D, (a, y) -> a + y * y)), 1e-300D) AS FLOAT)))[0]"


def register(spark: SparkSession, root: str, dim: int = 256, name: str = "lodestack_search", mode: str = "hybrid") -> None:
    """Register the table function `name`(query, top_k, source_type, version) over the index at root, written with
    hashed_encoder(dim); the last three may be left out or named. mode: hybrid or lexical.

    Columns: rank, id, score, title, source_url, source_type, version, section, symbol, kind, text, equal to index.search()
    (lexical: to index.lexical()). A null query finds nothing by its words; a null filter does not filter."""
    for table in ("records", "postings", "terms"):
        open_table(spark, root, table).createOrReplaceTempView(f"{name}_{table}")
    n, avgdl = open_table(spark, root, "stats").first()
    # A parameter is named by its function, as a column of its name would come first.
    allowed = f"({name}.source_type IS NULL OR r.source_type = {name}.source_type) AND ({name}.version IS NULL OR r.version = {name}.version)"
    asked = f"SELECT explode(array_distinct({_WORDS.format(f"coalesce({name}.query, '')")})) AS term"
    place = "ROW_NUMBER() OVER (ORDER BY round(score, 9) DESC, id)"
    # Postings are dealt by document, so the pairs of queries and documents are added up where they arise and never travel.
    lexical = f"""SELECT id, {place} AS rank, score FROM (
        SELECT /*+ BROADCAST(a) */ p.doc_id AS id, sum(ln(1 + ({n} - a.df + 0.5D) / (a.df + 0.5D)) * p.tf * {K1 + 1}D / (p.tf + {K1}D * ({1 - B}D + {B}D * p.dl / {avgdl or 1.0}D))) AS score
        FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, term, tf, dl FROM {name}_postings) p JOIN (SELECT id, source_type, version FROM {name}_records) r ON r.id = p.doc_id
        JOIN (SELECT w.term, t.df FROM ({asked}) w JOIN {name}_terms t ON t.term = w.term) a ON a.term = p.term
        WHERE {allowed} GROUP BY p.doc_id)"""
    unit = "aggregate(r.vector, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)"
    dot = "aggregate(zip_with(r.vector, q.v, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (a, x) -> a + x)"
    dense = f"""SELECT id, {place} AS rank, score FROM (
        SELECT r.id, coalesce(try_divide({dot}, sqrt({unit}) * sqrt(aggregate(q.v, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x))), 0D) AS score
        FROM {name}_records r CROSS JOIN (SELECT {encoded(f'{name}.query', dim)} AS v) q WHERE r.vector IS NOT NULL AND {allowed})"""
    if mode == "lexical":
        fused = f"SELECT id, score, rank FROM ({lexical})"
    else:
        both = f"SELECT id, rank AS d, CAST(NULL AS INT) AS l FROM ({dense}) WHERE rank <= {CANDIDATES} UNION ALL SELECT id, CAST(NULL AS INT), rank FROM ({lexical}) WHERE rank <= {CANDIDATES}"
        summed = f"SELECT id, coalesce(1D / ({FUSE} + max(d)), 0D) + coalesce(1D / ({FUSE} + max(l)), 0D) AS score, coalesce(max(d), 1000000 + max(l)) AS seen FROM ({both}) GROUP BY id"
        fused = f"SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, seen) AS rank FROM ({summed})"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, top_k INT DEFAULT 6, source_type STRING DEFAULT NULL, version STRING DEFAULT NULL)
        RETURNS TABLE(rank INT, id STRING, score DOUBLE, title STRING, source_url STRING, source_type STRING, version STRING, section STRING, symbol STRING, kind STRING, text STRING)
        RETURN SELECT f.rank, CAST(h.id AS STRING), round(f.score, 6), h.title, h.source_url, h.source_type, h.version, h.section, h.symbol, h.kind, h.text
        FROM ({fused}) f JOIN {name}_records h ON h.id = f.id WHERE f.rank <= {name}.top_k""")
