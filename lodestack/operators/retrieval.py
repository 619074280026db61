"""Search over a table of queries: BM25, exact vectors, symbol names, rank fusion, reranking. Every result is one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestack.functions.text import words

K1, B = 1.2, 0.75
HIT_FIELDS = ["id", "text", "source_type", "source_url", "title", "version", "section", "symbol", "kind"]
#: Rows up to which a side is broadcast.
SMALL = 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast df if its rows are few; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf, dl: the term counts of a text index, with each document's length in words."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    counted = tokens.mapInArrow(_counted, schema)  # where the texts are read: words never travel
    rows, different = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
    return counted if rows == different else counted.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            size = part.column("w").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms = part.column("w").flatten().dictionary_encode()
            cell, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(terms.dictionary) + terms.indices.to_numpy(), return_counts=True)
            row = cell // len(terms.dictionary)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), terms.dictionary.take(pa.array(cell % len(terms.dictionary))), pa.array(tf, pa.int64()), pa.array(size[row], pa.int32())], ["doc_id", "term", "tf", "dl"])


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, w: the distinct words of each query that has any; queries without an id are left out."""
    queries = queries.filter(F.col(query_id).isNotNull())
    return queries.select(F.col(query_id).alias("query_id"), F.array_distinct(words(F.coalesce(F.col(query), F.lit("")))).alias("w")).filter(F.size("w") > 0)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, doc_id, score) of each query with their rank; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, where: Column | None = None, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text", block: int = 512) -> DataFrame:
    """query_id, doc_id, score, rank (from 1) of the k best documents of each query; ties to the smaller id.

    For a table without an index, and many queries. Statistics are those of the whole table; `where` limits only the
    candidates. Common words pair nearly every document with nearly every query, so pairs are never rows: the queries travel
    to the documents, `block` of them at a time (a block's weights are its terms times its queries), words are found in the
    JVM, runs of documents are scored by one matrix product, and a task hands on only its own k best for each query."""
    spark = docs.sparkSession
    asked = query_terms(queries, query_id, query).select("query_id", F.explode("w").alias("term")).toArrow()  # the stated queries
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("ok"))
    # One pass over the table: document frequencies of the queries' terms, and under the empty term its rows and words.
    vocabulary = pa.array(["", *pc.unique(asked.column("term")).to_pylist()], pa.string())
    wanted = small(spark.createDataFrame(pa.table({"term": vocabulary})))
    seen = rows.select(F.size("w").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term"))
    found = seen.join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("words")).toArrow()
    whole = found.filter(pc.equal(found.column("term"), "")).to_pylist()
    n, total = (whole[0]["df"], whole[0]["words"]) if whole else (0, 0)
    at = pc.index_in(asked.column("term"), found.column("term").combine_chunks())
    known = asked.filter(at.is_valid())
    df = found.column("df").take(at.drop_null()).to_numpy().astype(np.float64)
    known = known.append_column("idf", pa.array(np.log(1 + (n - df + 0.5) / (df + 0.5))))
    ids = queries.schema[query_id].dataType
    schema = T.StructType([T.StructField("query_id", ids), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    candidates = rows.filter("ok").select("doc_id", "w").filter(F.size("w") > 0)
    order = known.column("query_id").combine_chunks().dictionary_encode()
    part = order.indices.to_numpy() // block
    scored = [candidates.mapInArrow(_scored(known.filter(pa.array(part == p)), total / n or 1.0, k, ids), schema) for p in np.unique(part)]
    return best(reduce(DataFrame.unionByName, scored) if scored else spark.createDataFrame([], schema), k)


class Best:
    """The k best (query, document, score) of each query so far, of those that tie with the kth the k smallest ids.

    A task hands on what is left at its end, so rows that go to the sort are queries times k for each task, not for each
    batch."""

    #: Scores this near to each other count as equal here; the final order decides among them.
    TIE = 1e-10

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.rows, self.full = 0, max(100_000, 4 * k * queries)

    def add(self, score: np.ndarray, docs: pa.Array, usable: np.ndarray) -> None:
        """Scores of all queries (rows) against documents (columns), where usable."""
        usable &= score >= self.floor[:, None] - self.TIE
        if score.shape[1] > self.k:
            least = -np.partition(-np.where(usable, score, -np.inf), self.k - 1, axis=1)[:, self.k - 1 : self.k]
            usable &= score >= least - self.TIE
        q, d = np.nonzero(usable)
        if len(q):
            self.held.append((q, docs.take(pa.array(d)), score[q, d]))
            self.rows += len(q)
        if self.rows > self.full:
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """What is left, by query."""
        if not self.held:
            return None
        q, score = np.concatenate([h[0] for h in self.held]), np.concatenate([h[2] for h in self.held])
        docs = pa.concat_arrays([h[1] for h in self.held])
        order = np.lexsort((-score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        at = order[place == self.k - 1]
        self.floor[q[at]] = score[at]
        apart = score - self.floor[q]
        near = np.flatnonzero(np.abs(apart) <= self.TIE)
        rank = pc.rank(docs.take(pa.array(near)), sort_keys="ascending", tiebreaker="dense").to_numpy() if len(near) else near
        near = near[np.lexsort((rank, q[near]))]
        near = near[np.arange(len(near)) - np.searchsorted(q[near], q[near]) < self.k]
        keep = np.concatenate([np.flatnonzero(apart > self.TIE), near])
        self.held, self.rows = [(q[keep], docs.take(pa.array(keep)), score[keep])], len(keep)
        return self.held[0]


def _scored(weights: pa.Table, avgdl: float, k: int, id_type: T.DataType):
    """A task's function: its k best documents for each query of (query_id, term, idf)."""
    ids, terms = weights.column("query_id").combine_chunks().dictionary_encode(), weights.column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(terms.dictionary), len(ids.dictionary)))
    matrix[terms.indices.to_numpy(), ids.indices.to_numpy()] = weights.column("idf").to_numpy()
    names, vocabulary, kind = ids.dictionary, terms.dictionary, to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(names), k)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                column = part.column("w")
                size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.index_in(column.flatten(), vocabulary)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                cell = np.repeat(np.arange(part.num_rows), size)[known] * len(vocabulary) + at.drop_null().to_numpy()
                tf = np.bincount(cell, minlength=part.num_rows * len(vocabulary)).reshape(part.num_rows, len(vocabulary)).astype(np.float64)
                tf *= (K1 + 1) / (tf + K1 * (1 - B + B * size[:, None] / avgdl))
                score = (tf @ matrix).T
                found.add(score, part.column("doc_id"), score > 0)
        left = found.settle()
        if left:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left[0])).cast(kind), left[1], pa.array(left[2])], ["query_id", "doc_id", "score"])

    return run


def known_terms(queries: DataFrame, terms: DataFrame, n: int, most: int = 1000, query_id: str = "query_id", query: str = "query") -> tuple[pa.Table, list[str] | None]:
    """query_id, term, idf of the stated queries' known terms; and their distinct terms, unless these are more than `most`."""
    asked = query_terms(queries, query_id, query).select("query_id", F.explode("w").alias("term"))
    wanted = asked.select("term").distinct()
    few = [r["term"] for r in wanted.limit(most + 1).collect()]
    if len(few) <= most:
        terms = terms.filter(F.col("term").isin(few))
    weight = terms.join(small(wanted), "term").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return asked.join(small(weight), "term").select("query_id", "term", "idf").toArrow(), few if len(few) <= most else None


def by_code(held: DataFrame, names: pa.DictionaryArray) -> DataFrame:
    """Rows of the terms in names, with the term's place in it as `code`."""
    codes = pa.table({"term": names.dictionary, "code": pa.array(range(len(names.dictionary)), pa.int32())})
    return held.join(small(held.sparkSession.createDataFrame(codes)), "term")


def bm25_of_postings(queries: DataFrame, posts: DataFrame, terms: DataFrame, n: int, avgdl: float, k: int = 10, allowed: DataFrame | None = None, most: int = 1000, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The same as bm25() from an index (see index.build_table): only the postings of the queries' terms are read.

    posts: term, doc_id, tf, dl, sorted by term; terms: term, df. allowed: doc_id of the candidates, if not all. Up to `most`
    distinct terms are handed to the scan as a filter, which skips the row groups without them."""
    weights, few = known_terms(queries, terms, n, most, query_id, query)
    if few is not None:
        posts = posts.filter(F.col("term").isin(few))
    ids, doc = queries.schema[query_id].dataType, posts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("query_id", ids), T.StructField("doc_id", doc), T.StructField("score", T.DoubleType())])
    if not weights.num_rows:
        return best(posts.sparkSession.createDataFrame([], schema), k)
    if allowed is not None:
        posts = posts.join(small(allowed), "doc_id", "left_semi")
    # Common words pair nearly every document with nearly every query: a document's postings meet, and pairs are never rows.
    names = weights.column("term").combine_chunks().dictionary_encode()
    coded = by_code(posts, names).select("doc_id", "code", F.col("tf").cast("int").alias("tf"), "dl")
    counts = coded.groupBy("doc_id").agg(F.max("dl").cast("long").alias("dl"), F.collect_list(F.struct("code", "tf")).alias("w"))
    own = weights.set_column(1, "term", names.indices)
    return best(counts.select("doc_id", "dl", F.col("w.code").alias("code"), F.col("w.tf").alias("tf")).mapInArrow(_scored_counts(own, avgdl or 1.0, k, ids), schema), k)


def query_matrices(weights: pa.Table, block: int = 512) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of (query_id, code, idf) `block` queries at a time: their ids, their terms' codes, and idf by both."""
    ids = weights.column("query_id").combine_chunks().dictionary_encode()
    order, term, idf = ids.indices.to_numpy(), weights.column("term").to_numpy(), weights.column("idf").to_numpy()
    parts = []
    for low in range(0, len(ids.dictionary), block):
        mine = (order >= low) & (order < low + block)
        held = np.unique(term[mine])
        matrix = np.zeros((len(held), min(block, len(ids.dictionary) - low)))
        matrix[np.searchsorted(held, term[mine]), order[mine] - low] = idf[mine]
        parts.append((ids.dictionary.slice(low, block), held, matrix))
    return parts


def _scored_counts(weights: pa.Table, avgdl: float, k: int, id_type: T.DataType, block: int = 512):
    """A task's function over counted documents (doc_id, dl, code, tf): its k best for each query of (query_id, code, idf)."""
    kind, parts = to_arrow_type(id_type), query_matrices(weights, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(len(names), k) for names, _, _ in parts]
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                column = part.column("code")
                row = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
                code, count = column.flatten().to_numpy(zero_copy_only=False), part.column("tf").flatten().to_numpy(zero_copy_only=False)
                dl = part.column("dl").to_numpy(zero_copy_only=False)
                for best_, (_, held, matrix) in zip(found, parts, strict=True):
                    at = np.minimum(np.searchsorted(held, code), len(held) - 1)
                    own = held[at] == code
                    tf = np.bincount(row[own] * len(held) + at[own], count[own], part.num_rows * len(held)).reshape(part.num_rows, len(held))
                    tf *= (K1 + 1) / (tf + K1 * (1 - B + B * dl[:, None] / avgdl))
                    score = (tf @ matrix).T
                    best_.add(score, part.column("doc_id"), score > 0)
        for best_, (names, _, _) in zip(found, parts, strict=True):
            left = best_.settle()
            if left:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(left[0])).cast(kind), left[1], pa.array(left[2])], ["query_id", "doc_id", "score"])

    return run


def knn(queries: DataFrame, table: DataFrame, k: int = 40, group: str | None = None, block: int = 4096) -> DataFrame:
    """query_id, id, score, rank of the k nearest rows by cosine; ties to the smaller id. Exact, nothing is approximated.

    queries: query_id, vector (and group); table: id, vector (and group). With a group column only rows of the query's group
    are candidates (a pre-filter; a null group of a query means all). The stated queries travel to the table, `block` of them
    at a time; each task returns its own k best by matrix products, so the table itself is never shuffled. Zero vectors
    score 0. Null vectors, vectors with a null component and queries without an id are left out. A query meets the rows whose
    vectors have its length."""
    sound = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    table = table.select("id", "vector", *([group] if group else [])).filter(sound)
    asked = queries.select("query_id", "vector", *([group] if group else [])).filter(sound & F.col("query_id").isNotNull()).toArrow()  # the stated queries
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", table.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = [table.mapInArrow(_nearest(part, k, group, to_arrow_type(queries.schema["query_id"].dataType)), schema) for part in _blocks(asked, block)]
    out = reduce(DataFrame.unionByName, found) if found else table.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(asked: pa.Table, block: int) -> Iterator[pa.Table]:
    """Queries in runs of at most `block`, of one vector length each."""
    size = pc.list_value_length(asked.column("vector"))
    for n in pc.unique(size).to_pylist():
        own = asked.filter(pc.equal(size, n))
        for low in range(0, own.num_rows, block):
            yield own.slice(low, block).combine_chunks()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _nearest(asked: pa.Table, k: int, group: str | None, id_type: pa.DataType):
    """A task's function: its k nearest rows for each query."""
    q, ids = _matrix(asked.column("vector")), pa.array(asked.column("query_id").to_pylist(), id_type)
    wanted = asked.column(group).combine_chunks().dictionary_encode() if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(q), k)
        for batch in batches:
            batch = batch.filter(pc.equal(batch.column("vector").value_lengths(), q.shape[1]))
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                score = q @ _matrix(part.column("vector")).T
                usable = np.isfinite(score)
                if wanted is not None:
                    own = pc.fill_null(pc.index_in(part.column(group).cast(wanted.dictionary.type), wanted.dictionary), -1).to_numpy(zero_copy_only=False)
                    mine = pc.fill_null(wanted.indices, -1).to_numpy(zero_copy_only=False)
                    usable &= (mine[:, None] < 0) | (mine[:, None] == own[None, :])
                found.add(score, part.column("id"), usable)
        left = found.settle()
        if left:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[0])), left[1], pa.array(left[2])], ["query_id", "id", "score"])

    return run


def build_where(source_type: str | None = None, version: str | None = None) -> Column | None:
    """Equality on the given columns, None without any."""
    parts = [F.col(c) == v for c, v in (("source_type", source_type), ("version", version)) if v]
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def where_text(source_type: str | None = None, version: str | None = None) -> str | None:
    """The same as text, with quotes doubled."""
    parts = [f"{c} = '{v.replace(chr(39), chr(39) * 2)}'" for c, v in (("source_type", source_type), ("version", version)) if v]
    return " AND ".join(parts) or None


def symbol_rank(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, id, query, symbol, title, first_seen) with symbol_score above 0 and symbol_rank (from 1).

    The score is the share of the words of the symbol's last part (of the title's, without a symbol) that the query has."""
    name = F.when(F.coalesce(F.col("symbol"), F.lit("")) != "", F.col("symbol")).otherwise(F.coalesce(F.col("title"), F.lit("")))
    leaf = F.array_distinct(words(F.replace(F.element_at(F.split(name, r"\."), -1), F.lit("_"), F.lit(" "))))
    score = F.when(F.size(leaf) > 0, F.size(F.array_intersect(leaf, words(F.col("query")))) / F.size(leaf)).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("symbol_score"), F.asc("first_seen"))
    return candidates.withColumn("symbol_score", score).filter("symbol_score > 0").withColumn("symbol_rank", F.row_number().over(order))


def routed(queries: DataFrame, symbols: DataFrame, least: int = 4) -> DataFrame:
    """queries (query_id, query, tier) with the tier that answers them: `technical` if they name the last part of a symbol (a
    word of at least `least` letters), else the tier that they ask for, technical without one."""
    leaf = F.lower(F.element_at(F.split("symbol", r"\."), -1))
    names = symbols.select(leaf.alias("w")).filter(F.length("w") >= least).distinct()
    named = queries.select("query_id", F.explode(words(F.coalesce("query", F.lit("")))).alias("w")).distinct().join(names, "w", "left_semi").select("query_id").distinct().withColumn("named", F.lit(True))
    return queries.join(named, "query_id", "left").withColumn("tier", F.when(F.col("named"), "technical").otherwise(F.coalesce("tier", F.lit("technical")))).drop("named")


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank from 1): query_id, id, score, rank; ties by first sight.

    The sum is taken list by list in a fixed order, so equal documents get equal scores whatever the shuffle did."""
    merged = None
    for n, ranked in enumerate(lists):
        own = ranked.select("query_id", "id", F.col("rank").alias(f"r{n}"))
        merged = own if merged is None else merged.join(own, ["query_id", "id"], "full")
    score, seen = F.lit(0.0), None
    for n in range(len(lists)):
        score = score + F.coalesce(1.0 / (k + F.col(f"r{n}")), F.lit(0.0))
        place = F.when(F.col(f"r{n}").isNotNull(), n * 1_000_000 + F.col(f"r{n}"))
        seen = place if seen is None else F.coalesce(seen, place)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("first_seen"))
    return merged.withColumn("score", score).withColumn("first_seen", seen).withColumn("rank", F.row_number().over(order))


def hybrid(dense: DataFrame, lexical: DataFrame, rows: DataFrame | None = None, queries: DataFrame | None = None, top_k: int = 6, candidates: int = 40) -> DataFrame:
    """Fused results of a dense and a lexical list (and, with rows and queries, of symbol names): query_id, id, score, rank.

    rows: id, symbol, title of the table; queries: query_id, query. The pool is cut at `candidates` after fusion."""
    lists = [dense.filter(F.col("rank") <= candidates), lexical.filter(F.col("rank") <= candidates)]
    if rows is not None:
        pool = fuse(lists).select("query_id", "id", "first_seen")
        named = pool.join(rows.select("id", "symbol", "title"), "id").join(small(queries.select("query_id", "query")), "query_id")
        lists.append(symbol_rank(named).select("query_id", "id", F.col("symbol_rank").alias("rank")))
    return fuse(lists).filter(F.col("rank") <= min(candidates, top_k)).select("query_id", "id", "score", "rank")


def rerank(hits: DataFrame, score: Column, top_k: int) -> DataFrame:
    """Hits (query_id, rank) in the order of a score rounded to 6 digits; ties keep their rank. Adds rerank_score, new_rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    return hits.withColumn("rerank_score", F.round(score, 6)).withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= top_k)


def scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function from a model that scores (queries, texts) batch by batch."""

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(query.tolist(), text.tolist()), dtype="float64")

    return run


def hashed_encoder(dim: int = 256) -> Callable[[Column], Column]:
    """A stand-in encoder: signed feature hashing of words, length 1. It carries no meaning beyond shared words."""

    @F.pandas_udf("array<float>")
    def summed(slots: pd.Series) -> pd.Series:
        def one(own: np.ndarray) -> np.ndarray:
            own = np.asarray(own, dtype=np.int64)
            raw = np.bincount(own >> 1, np.where(own & 1, 1.0, -1.0), dim)
            return (raw / max(np.sqrt((raw * raw).sum()), 1e-300)).astype(np.float32)

        return slots.map(one)

    def encode(text: Column) -> Column:
        # A word's slot, and its sign in the lowest bit.
        slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))
        return summed(F.transform(words(F.coalesce(text, F.lit(""))), slot))

    return encode


def trust_weight(score: Column, source: Column, status: Column, year: Column, authority: Column, media: Column, now: int) -> Column:
    """A fused score times weights for source, status, age, authority and media; null factors count as 1.

    Status: current 1.0, dated_valid 0.8, stale 0.5. Age: 0.6 for 2019 and before, up to 1.0 for `now`."""
    status = F.when(status == "current", 1.0).when(status == "dated_valid", 0.8).when(status == "stale", 0.5).otherwise(1.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - 2019) / float(max(now - 2019, 1))))
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return score * one(source) * status * one(0.6 + 0.4 * share) * one(authority) * one(media)
