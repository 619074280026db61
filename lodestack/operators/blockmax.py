"""Exact BM25 over postings in blocks that know their largest impact: blocks that cannot matter are never decoded.

Documents stand in segments of a few neighbours (of one source type, as they are stored). A block holds the postings of one term
in one segment, and the largest BM25 weight among them without the term's idf. For a query, idf times these weights, added up over
its terms, bounds every score of a segment (Block-Max: Ding and Suel 2011, over fixed ranges of documents as Mallia et al. 2022).
The segments with the best bounds are scored first; the kth score found there is a threshold, and of the others only those whose
bound reaches it are decoded. A segment's blocks meet in one row and the stated queries travel to them, so that pairs of queries
and segments or documents are never rows: a task hands on only its own best for each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from lodestack.functions.text import words
from lodestack.operators.retrieval import K1, B, Best, best, by_code, known_terms, query_matrices, small

#: Documents of a segment are 2 to the power of this.
SEGMENT_BITS = 5
#: Segments that are scored to find a query's threshold, for each result that it wants.
PROBE = 2
#: Slack of the threshold, as sums of floats depend on their order.
EPS = 1e-7
#: Documents whose words or scores are in hand at a time.
RUN = 512


def weight(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """The BM25 weight of a term in a document without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))


def blocks(rows: DataFrame, avgdl: float, bits: int = SEGMENT_BITS) -> DataFrame:
    """term, seg, impact, n, docs (id, tf, dl) of records (id, source_type, embed_text).

    Stored records lie by source type, so that a segment, which is the same number of neighbours of a scan's task, holds alike
    ones; its blocks are made where its texts are read. A block has at most 2^bits documents, however common its term is.
    Records with one id count as one, with the length of one of them."""
    read = rows.select("id", words(F.col("embed_text")).alias("w")).select("id", "w", F.size("w").alias("dl"))
    stored, different = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if stored != different:
        whole = read.filter("dl > 0").groupBy("id").agg(F.flatten(F.collect_list("w")).alias("w"), F.max("dl").alias("dl"))
        read = whole.sortWithinPartitions("id")
    placed = read.select("id", "w", "dl", F.shiftright(F.monotonically_increasing_id(), bits).alias("seg"))
    doc = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("impact", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("docs", T.ArrayType(doc))])
    return placed.mapInArrow(_cut(avgdl, max(RUN, 1 << bits), to_arrow_schema(schema)), schema)


def _cut(avgdl: float, most: int, schema: pa.Schema):
    """A task's function: the blocks of its segments. most: documents at a time, whole segments of them."""

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        size = part.column("w").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        terms = part.column("w").flatten().dictionary_encode()
        seg, dl = part.column("seg").to_numpy(), part.column("dl").to_numpy()
        # Ordered by segment, term and document.
        first = np.unique(seg, return_index=True)[1]
        place = np.searchsorted(first, np.arange(len(seg)), side="right") - 1
        v, d = max(1, len(terms.dictionary)), len(seg)
        row = np.repeat(np.arange(d), size)
        cell, tf = np.unique((place[row] * v + terms.indices.to_numpy()) * d + row, return_counts=True)
        block, row = cell // d, cell % d
        start = np.flatnonzero(np.diff(block, prepend=-1))
        n = np.diff(start, append=len(cell))
        impact = np.maximum.reduceat(weight(tf.astype(np.float64), dl[row], avgdl), start) if len(start) else np.zeros(0)
        docs = pa.StructArray.from_arrays([part.column("id").take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32())], fields=list(schema.field("docs").type.value_type))
        held = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)), pa.int32()), docs, type=schema.field("docs").type)
        return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(block[start] % v)).cast(schema.field("term").type), pa.array(seg[row[start]]), pa.array(impact), pa.array(n, pa.int32()), held], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if left is not None and left.num_rows:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            seg = batch.column("seg").to_numpy()
            whole = int(np.searchsorted(seg, seg[-1]))  # the last segment may go on in the next batch
            for low in range(0, whole, most):
                yield made(batch.slice(low, min(most, whole - low)))
            left = batch.slice(whole)
        if left is not None and left.num_rows:
            yield made(left)

    return run


def write_blocks(rows: DataFrame, avgdl: float, path: str, bits: int = SEGMENT_BITS) -> None:
    """blocks(), sorted by term over ranges of (term, segment): a common term's blocks are many files' worth, not one task's."""
    blocks(rows, avgdl, bits).repartitionByRange("term", "seg").sortWithinPartitions("term", "seg").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _dense(part: pa.RecordBatch, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The impacts of segments (rows) by their terms (columns, those of held); row, column and place in the batch of each block."""
    row = np.repeat(np.arange(part.num_rows), part.column("code").value_lengths().to_numpy(zero_copy_only=False))
    code = part.column("code").flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(held, code), len(held) - 1)
    own = np.flatnonzero(held[at] == code)
    impact = np.zeros((part.num_rows, len(held)))
    impact[row[own], at[own]] = part.column("impact").flatten().to_numpy(zero_copy_only=False)[own]
    return impact, row[own], at[own], own


def _bounded(parts: list, k: int, id_type: T.DataType):
    """A task's function over segments (seg, code, impact): for each query its k with the best bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(len(names), k) for names, _, _ in parts]
        for batch in batches:
            for low in range(0, batch.num_rows, RUN):
                part = batch.slice(low, RUN)
                for best_, (_, held, matrix) in zip(found, parts, strict=True):
                    bound = (_dense(part, held)[0] @ matrix).T
                    best_.add(bound, part.column("seg"), bound > 0)
        yield from _left(found, parts, id_type, "doc_id")

    return run


def _left(found: list, parts: list, id_type: T.DataType, column: str) -> Iterator[pa.RecordBatch]:
    for best_, (names, _, _) in zip(found, parts, strict=True):
        left = best_.settle()
        if left:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left[0])).cast(to_arrow_type(id_type)), left[1], pa.array(left[2])], ["query_id", column, "score"])


#: Of part p of the queries, which (segments, queries) are open: by segments' numbers and their bounds.
Open = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _stated(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Open:
    """Open are the pairs themselves: for each part segments in order, and the place of the query of each."""

    def mask(p: int, seg: np.ndarray, bound: np.ndarray) -> np.ndarray:
        segs, order = pairs[p]
        out = np.zeros(bound.shape, bool)
        for i, (low, high) in enumerate(zip(np.searchsorted(segs, seg), np.searchsorted(segs, seg, side="right"), strict=True)):
            out[i, order[low:high]] = True
        return out

    return mask


def _reaching(floors: list[np.ndarray]) -> Open:
    """Open are the pairs whose bound reaches the query's threshold."""
    return lambda p, seg, bound: (bound > 0) & (bound >= floors[p] - EPS)


def _scored(parts: list, avgdl: float, k: int, open_: Open, id_type: T.DataType):
    """A task's function over segments (seg, code, impact, id, tf, dl): its k best documents for each query, of open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(len(names), k) for names, _, _ in parts]
        step = max(1, RUN >> SEGMENT_BITS)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = {c: part.column(c).flatten() for c in ("id", "tf", "dl")}
                for p, (best_, (_, held, matrix)) in enumerate(zip(found, parts, strict=True)):
                    impact, row, at, own = _dense(part, held)
                    asked = open_(p, part.column("seg").to_numpy(), impact @ matrix)
                    # Decoded are the blocks of an open segment's own terms only.
                    needed = (asked.astype(np.float32) @ (matrix > 0).T.astype(np.float32) > 0)[row, at]
                    if not needed.any():
                        continue
                    row, at, own = row[needed], at[needed], own[needed]
                    tf, dl, ids = (lists[c].take(pa.array(own)) for c in ("tf", "dl", "id"))
                    n = tf.value_lengths().to_numpy(zero_copy_only=False)
                    ids = ids.flatten().dictionary_encode()
                    doc, docs = ids.indices, ids.dictionary
                    if doc.null_count:  # a document without an id is one, too
                        doc, docs = doc.fill_null(len(docs)), pa.concat_arrays([docs, pa.nulls(1, docs.type)])
                    doc = doc.to_numpy()
                    weights = np.zeros((len(docs), len(held)))
                    weights[doc, np.repeat(at, n)] = weight(tf.flatten().to_numpy().astype(np.float64), dl.flatten().to_numpy(), avgdl)
                    place = np.zeros(len(docs), np.int64)
                    place[doc] = np.repeat(row, n)
                    score = (weights @ matrix).T
                    best_.add(score, docs, (score > 0) & asked[place].T)
        yield from _left(found, parts, id_type, "doc_id")

    return run


def _counted(parts: list, opens: list[Open], id_type: T.DataType):
    """A task's function over segments (seg, code, impact): for each query its blocks, and those in open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(names)), np.int64) for names, _, _ in parts]
        for batch in batches:
            for low in range(0, batch.num_rows, RUN):
                part = batch.slice(low, RUN)
                for p, (total, (_, held, matrix)) in enumerate(zip(sums, parts, strict=True)):
                    impact = _dense(part, held)[0]
                    mine = ((impact > 0).astype(np.float64) @ (matrix > 0)).astype(np.int64)
                    asked = np.logical_or.reduce([o(p, part.column("seg").to_numpy(), impact @ matrix) for o in opens])
                    total += np.stack([mine.sum(axis=0), (mine * asked).sum(axis=0)])
        for total, (names, _, _) in zip(sums, parts, strict=True):
            yield pa.RecordBatch.from_arrays([names.cast(to_arrow_type(id_type)), pa.array(total[0]), pa.array(total[1])], ["query_id", "blocks", "decoded"])

    return run


class Search:
    """A search for the k best documents of each query (query_id, query) over blocks().

    held: blocks(); terms: term, df. allowed: doc_id of the candidates, if not all; statistics stay those of the whole table.
    Up to `most` distinct terms are handed to the scan as a filter. Queries without a known word or without an id find
    nothing."""

    def __init__(self, queries: DataFrame, held: DataFrame, terms: DataFrame, n: int, avgdl: float, k: int = 10, allowed: DataFrame | None = None, most: int = 1000, probe: int = PROBE):
        self.k, self.avgdl, self.allowed, self.ids, self.held = k, avgdl, allowed, queries.schema["query_id"].dataType, held
        weights, few = known_terms(queries, terms, n, most)
        names = weights.column("term").combine_chunks().dictionary_encode()
        self.parts = query_matrices(weights.set_column(1, "term", names.indices))
        self.coded = by_code(held if few is None else held.filter(F.col("term").isin(few)), names)
        doc = held.schema["docs"].dataType.elementType["id"].dataType
        self.found = self._schema(doc)
        if not self.parts:
            return
        first = best(self._bounds().mapInArrow(_bounded(self.parts, probe * k, self.ids), self._schema(T.LongType())), probe * k).select("query_id", "doc_id").toArrow()
        self.first = _stated([self._places(names, first, "doc_id") for names, _, _ in self.parts])
        tops = held.sparkSession.createDataFrame(pa.table({"seg": first.column("doc_id").unique()}), "seg long")
        probed = best(self._scores(self.coded.join(small(tops), "seg", "left_semi"), self.first), k)
        kth = probed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).filter("kth IS NOT NULL").toArrow()
        floors = []
        for names, _, _ in self.parts:
            score, order = self._places(names, kth, "kth")
            floors.append(np.full(len(names), -np.inf))
            floors[-1][order] = score
        self.rest = _reaching(floors)

    def _schema(self, doc: T.DataType) -> T.StructType:
        return T.StructType([T.StructField("query_id", self.ids), T.StructField("doc_id", doc), T.StructField("score", T.DoubleType())])

    @staticmethod
    def _places(names: pa.Array, stated: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        """A column of the stated queries' rows in order, and each row's place in names; of those in names."""
        place = {q: i for i, q in enumerate(names.to_pylist())}
        rows = [(v, place[q]) for q, v in zip(stated.column("query_id").to_pylist(), stated.column(column).to_pylist(), strict=True) if q in place]
        rows.sort()
        return np.array([v for v, _ in rows]), np.array([i for _, i in rows], np.int64)

    def _bounds(self) -> DataFrame:
        """seg, code, impact: a segment's blocks in one row, without their postings, which stay in their column."""
        met = self.coded.select("seg", "code", "impact").repartition("seg").groupBy("seg").agg(F.collect_list(F.struct("code", "impact")).alias("b"))
        return met.select("seg", F.col("b.code").alias("code"), F.col("b.impact").alias("impact"))

    def _scores(self, coded: DataFrame, open_: Open) -> DataFrame:
        """query_id, doc_id, score of each task's best documents, of open segments."""
        if self.allowed is not None:
            each = coded.select("seg", "code", "impact", F.explode("docs").alias("d")).withColumn("doc_id", F.col("d.id"))
            coded = each.join(small(self.allowed), "doc_id", "left_semi").withColumn("docs", F.array("d"))
        parts = ["code", "impact", "id", "tf", "dl"]
        own = coded.select("seg", "code", "impact", *[F.col(f"docs.{c}").alias(c) for c in parts[2:]])
        met = own.repartition("seg").groupBy("seg").agg(F.collect_list(F.struct(*parts)).alias("b"))
        return met.select("seg", *[F.col(f"b.{c}").alias(c) for c in parts]).mapInArrow(_scored(self.parts, self.avgdl, self.k, open_, self.ids), self.found)

    def results(self) -> DataFrame:
        """query_id, doc_id, score, rank; ties to the smaller id, as bm25() has them."""
        return best(self._scores(self.coded, self.rest) if self.parts else self.held.sparkSession.createDataFrame([], self.found), self.k)

    def decoded(self) -> DataFrame:
        """query_id, blocks, decoded: blocks of the query's terms, and those whose postings are decoded."""
        schema = T.StructType([self.found["query_id"], T.StructField("blocks", T.LongType()), T.StructField("decoded", T.LongType())])
        if not self.parts:
            return self.held.sparkSession.createDataFrame([], schema)
        counted = self._bounds().mapInArrow(_counted(self.parts, [self.first, self.rest], self.ids), schema)
        return counted.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("decoded").alias("decoded")).filter("blocks > 0")
