"""Conflict-constrained best-fit packing of documents into fixed-length token sequences.

Items are dealt into sections and packed section by section, largest first. Open bins are ordered by residual; the successor
search starts at the first residual that holds the item and goes on to larger ones until the bin's bitmaps have no conflict:
one bitmap for duplicate clusters, and one for each allowed document of a source (plane j has the bit of a source once the
bin holds more than j of its documents). Items of bins that stay under half full are dealt and packed once more, across
sections."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_parts, small_batches, staged
from .ngram_join import class_key, shingle_sets
from .token_rollup import PATTERN, VOCABULARY, encoding_of, token_ids, vocabulary_bytes

PIECE = T.StructType([
    T.StructField("bin_id", T.LongType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("residual", T.LongType()),
])


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, residual of each bin). sizes are at most capacity and in falling order; sources and clusters are
    small numbers, a cluster of -1 conflicts with nothing."""
    order: list[tuple[int, int]] = []  # (residual, bin) of bins with room
    residual: list[int] = []
    cluster_bits: list[int] = []
    planes: list[list[int]] = []
    bins = np.empty(len(sizes), dtype=np.int64)
    for i in range(len(sizes)):
        size, source = int(sizes[i]), 1 << int(sources[i])
        cluster = 0 if clusters[i] < 0 else 1 << int(clusters[i])
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not cluster_bits[b] & cluster and not planes[b][-1] & source:
                order.pop(at)
                break
            at += 1
        else:
            b = len(residual)
            residual.append(capacity), cluster_bits.append(0), planes.append([0] * per_source)
        bins[i] = b
        residual[b] -= size
        cluster_bits[b] |= cluster
        for j, plane in enumerate(planes[b]):
            if not plane & source:
                planes[b][j] = plane | source
                break
        if residual[b]:
            insort(order, (residual[b], b))
    return bins, np.array(residual, dtype=np.int64)


def pack(docs: DataFrame, row_id: str, size: Column, source: Column, cluster: Column, capacity: int = 2048, per_source: int = 4, section: int = 4096) -> DataFrame:
    """Pieces of all documents in bins: row_id, bin_id, position, start, length, residual (room left in the bin).

    A document longer than capacity is cut: its full pieces fill bins of their own, the rest is an item. No bin holds two
    documents of a cluster, nor more than per_source of one source. section: rows packed together, about; more rows mean more
    sections, never larger ones. A row's section is a hash of its id, size, source and cluster, and of its number among rows
    equal in these, so that a hot source, cluster, id or size, and any number of equal rows, spread over all sections. Within
    a section items stand by falling size, then by id as text (none first), source and cluster. Bins thus follow from the
    rows alone, not from their order or files.

    Nulls: a null id is kept; a null size counts as 0, and an item of size 0 takes a place, but no room. A null source is a
    source of its own; a null cluster conflicts with nothing. Repeated rows are items of their own. Other columns are not
    read. An empty table gives no rows."""
    capacity_ = F.lit(capacity).cast("long")
    items = docs.select(F.col(row_id).alias("_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("_size"), F.coalesce(F.xxhash64(source), F.lit(0)).alias("_source"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("_cluster"))
    whole = F.when(F.col("_size") > 0, F.floor((F.col("_size") - 1) / capacity_)).otherwise(0).cast("long")
    items = items.withColumn("_whole", whole).select("_id", "_source", "_cluster", "_whole", (F.col("_whole") * capacity_).alias("_start"), (F.col("_size") - F.col("_whole") * capacity_).alias("_rest"))
    # Equal rows are interchangeable: they travel as one row and their count.
    items = staged(items.groupBy(*items.columns).agg(F.count("*").alias("_n")), "pack-items")
    rows, most = items.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    parts = max(1, -(-rows // section))
    first = _sections(_numbered(items, most), 0, parts, capacity, per_source)
    named = lambda p: p.select(F.col("_id").alias(row_id), *PIECE.names)
    if parts == 1:
        return named(first)
    first = staged(first, "pack-first", spent=(items,))
    loose = F.col("residual") * 2 > capacity
    again = staged(first.filter(loose).select("_id", "_source", "_cluster", "_place", F.lit(0).cast("long").alias("_whole"), F.col("start").alias("_start"), F.col("length").alias("_rest")), "pack-loose")
    second = _sections(again, parts, max(1, -(-again.count() // section)), capacity, per_source)
    return named(first.filter(~loose)).unionByName(named(second))


def _numbered(items: DataFrame, most: int, run: int = 65536) -> DataFrame:
    """Each item of a table of items and counts (_n, at most `most`) as a row of its own, with `_place`: a hash of the row and
    its number among its equals. More than `run` equals are dealt over tasks in runs of so many, before they become rows."""
    own = [c for c in items.columns if c != "_n"]
    place = F.xxhash64(*own, "_nth").alias("_place")

    def rows(counts: DataFrame, begin: Column, count: Column) -> DataFrame:
        return counts.select(*own, F.explode(F.sequence(begin, begin + count - 1)).alias("_nth")).select(*own, place)

    zero = F.lit(0).cast("long")
    if most <= run:
        return rows(items, zero, F.col("_n"))
    runs = items.filter(F.col("_n") > run).select("*", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(run).cast("long"))).alias("_begin"))
    runs = runs.repartition(shuffle_parts(items.sparkSession), *own, "_begin")
    return rows(items.filter(F.col("_n") <= run), zero, F.col("_n")).unionByName(rows(runs, F.col("_begin"), F.least(F.lit(run).cast("long"), F.col("_n") - F.col("_begin"))))


def _sections(items: DataFrame, base: int, parts: int, capacity: int, per_source: int) -> DataFrame:
    """Pieces of items, section by section; sections are numbered from base, which deals them anew as well."""
    keyed = items.select("*", (F.pmod(F.xxhash64("_place", F.lit(base)), F.lit(parts)) + base).cast("long").alias("_section"))
    kind = T.StructType([items.schema["_id"], items.schema["_source"], items.schema["_cluster"], items.schema["_place"], *PIECE.fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        start, rest, whole = (table.column(c).to_numpy() for c in ("_start", "_rest", "_whole"))
        _, source = np.unique(table.column("_source").to_numpy(), return_inverse=True)
        own = table.column("_cluster")
        known = ~own.is_null().to_numpy()
        digest = own.fill_null(0).to_numpy()
        cluster = np.full(len(rest), -1, dtype=np.int64)
        _, label, count = np.unique(digest[known], return_inverse=True, return_counts=True)
        renumber = np.cumsum(count > 1) - 1
        cluster[known] = np.where(count[label] > 1, renumber[label], -1)
        text = np.array(["" if x is None else f"={x}" for x in table.column("_id").to_pylist()])
        falling = np.lexsort((table.column("_place").to_numpy(), start, digest, table.column("_source").to_numpy(), text, -rest))
        bins, room = best_fit(rest[falling], source[falling], cluster[falling], capacity, per_source)
        row, number = falling, bins
        by_bin = np.argsort(bins, kind="stable")
        first = np.flatnonzero(np.diff(np.append(-1, bins[by_bin])))
        position = np.empty(len(row), dtype=np.int64)
        position[by_bin] = np.arange(len(bins)) - np.repeat(first, np.diff(np.append(first, len(bins))))
        start, length, left = start[row], rest[row], room[bins]
        many = whole[falling]
        full = np.repeat(falling, many)
        if len(full):
            nth = np.arange(len(full)) - np.repeat(np.cumsum(many) - many, many)
            row, number = np.concatenate([row, full]), np.concatenate([number, len(room) + np.arange(len(full))])
            position = np.concatenate([position, np.zeros(len(full), np.int64)])
            start, length = np.concatenate([start, nth * capacity]), np.concatenate([length, np.full(len(full), capacity)])
            left = np.concatenate([left, np.zeros(len(full), np.int64)])
        section = table.column("_section")[0].as_py()
        kept = [table.column(c).take(pa.array(row)) for c in ("_id", "_source", "_cluster", "_place")]
        return pa.table([*kept, pa.array(section * (1 << 32) + number, pa.int64()), pa.array(position, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(left, pa.int64())], names=["_id", "_source", "_cluster", "_place", *PIECE.names])

    return keyed.groupBy("_section").applyInArrow(run, kind)


def measured(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """keep columns, `_tokens` (length of each whole text in tokens, 0 for null and empty) and `_copies` (the class of texts
    with the same set of word shingles, as the n-gram join has it; null for a text without words), in one pass over texts."""
    ranks = vocabulary_bytes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        for batch in batches:
            tokens = [len(token_ids(encoding, t.as_py())) for t in pc.fill_null(batch.column(text), "")]
            keys = ["%d:%d" % class_key(own) if len(own) else None for own in shingle_sets(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(tokens, pa.int64()), pa.array(keys, pa.string())], [*keep, "_tokens", "_copies"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_tokens", T.LongType()), T.StructField("_copies", T.StringType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def packed_tokens(docs: DataFrame, pieces: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Each bin's sequence: bin_id, tokens (of its pieces, in order of position). Ids must be unique and not null.

    A document is encoded once, whatever the number of its pieces; a bin gathers at most capacity tokens."""
    ranks = vocabulary_bytes(docs.sparkSession, vocabulary)
    cuts = pieces.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("start", "length", "bin_id", "position"))).alias("_cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        for batch in batches:
            for t, own in zip(pc.fill_null(batch.column("_text"), ""), batch.column("_cuts"), strict=True):
                ids, own = token_ids(encoding, t.as_py()), own.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([c["bin_id"] for c in own], pa.int64()), pa.array([c["position"] for c in own], pa.int32()), pa.array([ids[c["start"] : c["start"] + c["length"]] for c in own], pa.list_(pa.int32()))], ["bin_id", "position", "tokens"])

    rows = cuts.join(docs.select(row_id, F.col(text).alias("_text")), row_id).select("_text", "_cuts")
    parts = rows.mapInArrow(run, "bin_id long, position int, tokens array<int>")
    return parts.groupBy("bin_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "tokens"))), lambda p: p["tokens"])).alias("tokens"))


def _packed(docs: DataFrame) -> DataFrame:
    with small_batches(docs.sparkSession):
        return pack(measured(docs, ["doc_id", "source"]), "doc_id", F.col("_tokens"), F.col("source"), F.col("_copies"))


def op9_conflict_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens; no two of a class of copies and at most four of a source share one."""
    return _packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row for each piece of each document; rows without an id, or that share one, are items of their own."""
    return _packed(docs.select("doc_id", "text", "source"))
