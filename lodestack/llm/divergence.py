"""How sources of a language diverge in their use of terms: chi-square-like distances of smoothed shares, in whole numbers.

Distances between all sources of a language are added up by a heavy-light split. A term that many sources use fills a dense
column of counts; columns are compared as numpy tiles. A rare term corrects what its absence would give: a source's own terms
cost a sum over (source, count) classes, and only sources that share the term need a pairwise term. Both are exact, so their
sum is. Terms are dealt out by hash, groups by tiles, so that no task holds a language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Documents of a language that a kept term is in, at least.
LEAST = 3
UNIT = 1_000_000_000
#: Ranks of the terms of a group.
RANKS = 200
#: Bytes of a text whose words are held at once, and distinct (group, term) entries before they are handed on.
PIECE, FLUSH = 1 << 20, 200_000
#: A-Z lower-cased; ASCII other than letters ends a term.
_OTHER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 128 else 32 for k in range(256))


def _counted(text: bytes) -> Counter:
    """Occurrences of each term of a text, read in pieces; bytes beyond ASCII belong to terms, so UTF-8 stays whole."""
    if len(text) <= PIECE:
        return Counter(text.translate(_FOLD).split())
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = _OTHER.search(text, at + PIECE)
        stop = end.start() if end else len(text)
        found.update(text[at:stop].translate(_FOLD).split())
        at = stop
    return found


COUNTS = "lang string, source string, term string, count long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts and document counts by (lang, source, term); an empty term stands for the group itself."""
    count: dict = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in count.items():
            names, many = list(terms), np.array(list(terms.values()), dtype=np.int64).reshape(-1, 2)
            word = pa.array(names, pa.binary()).view(pa.string())
            group = lambda v, n=len(names): pa.array([v], pa.string()).take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([group(lang), group(source), word, pa.array(many[:, 0]), pa.array(many[:, 1])], ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary()), strict=True):
            terms = count.setdefault((lang, source), {b"": [0, 0]})
            size -= len(terms)
            for term, many in _counted(text.as_py()).items():
                held = terms.get(term)
                if held is None:
                    terms[term] = [many, 1]
                else:
                    held[0] += many
                    held[1] += 1
            size += len(terms)
            if size > FLUSH:
                yield from rows()
                count, size = {}, 0
    yield from rows()


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total) in 64 bits: three digits at a time, for totals below 2^53."""
    first = (count + 1) * 1000
    second = F.pmod(first, total) * 1000
    third = F.pmod(second, total) * 1000
    return 1 + _div(first, total) * 1_000_000 + _div(second, total) * 1000 + _div(third, total)


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient, in 64 bits."""
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """share() of numpy integers."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """distance() of numpy integers."""
    gap = p - q
    return gap * gap // q


def tile_sums(left: tuple, right: tuple, heavy: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """What the terms at hand add to the distances of left groups (rows) to right groups (columns), less the distance of
    two groups without the term.

    left, right: postings (group, term, count) of one set of terms, numbered by term; heavy: whether a term is compared as a
    dense column; n_left, n_right: totals N + V of the groups."""
    zero_l, zero_r = shares(np.zeros(1, np.int64), n_left), shares(np.zeros(1, np.int64), n_right)
    none = distances(zero_l[:, None], zero_r[None, :])
    out = np.zeros(none.shape, np.int64)
    # Heavy terms: dense columns, a few at a time.
    column = np.cumsum(heavy) - 1
    width = max(1, (1 << 19) // max(1, none.size))
    dense = []
    for (group, term, count), totals in ((left, n_left), (right, n_right)):
        table = np.zeros((len(totals), int(heavy.sum())), np.int64)
        own = heavy[term]
        table[group[own], column[term[own]]] = count[own]
        dense.append(shares(table, totals[:, None]))
    for k in range(0, dense[0].shape[1], width):
        p, q = dense[0][:, None, k : k + width], dense[1][None, :, k : k + width]
        out += (distances(p, q) - none[:, :, None]).sum(axis=2)
    # Light terms: each side against the other's absence, by classes of equal counts.
    for (group, term, count), totals, side in ((left, n_left, 0), (right, n_right, 1)):
        own = ~heavy[term]
        classes, many = np.unique(np.stack([group[own], count[own]], axis=1), axis=0, return_counts=True)
        for k in range(0, len(classes), 4096):
            g, c = classes[k : k + 4096].T
            p = shares(c, totals[g])
            alone = distances(p[:, None], zero_r[None, :]) - none[g] if side == 0 else distances(zero_l[:, None], p[None, :]) - none[:, g]
            weight = many[k : k + 4096]
            if side == 0:
                np.add.at(out, g, alone * weight[:, None])
            else:
                np.add.at(out.T, g, (alone * weight[None, :]).T)
    # Light terms that two groups share: what the two sums above miss.
    (gl, tl, cl), (gr, tr, cr) = (tuple(a[~heavy[part[1]]] for a in part) for part in (left, right))
    order_l, order_r = np.argsort(tl, kind="stable"), np.argsort(tr, kind="stable")
    gl, tl, cl, gr, tr, cr = gl[order_l], tl[order_l], cl[order_l], gr[order_r], tr[order_r], cr[order_r]
    first, last = np.searchsorted(tr, tl, side="left"), np.searchsorted(tr, tl, side="right")
    met = np.cumsum(last - first)
    at = 0
    while at < len(tl):
        stop = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + (1 << 18), side="right")))
        size = (last - first)[at:stop]
        a = np.repeat(np.arange(at, stop), size)
        b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at:stop], size)
        i, j = gl[a], gr[b]
        p, q = shares(cl[a], n_left[i]), shares(cr[b], n_right[j])
        np.add.at(out, (i, j), distances(p, q) - distances(p, zero_r[j]) - distances(zero_l[i], q) + none[i, j])
        at = stop
    return out


PAIRS = "lang string, g long, h long, value long"


def _tiles(table: pa.Table) -> pa.Table:
    """tile_sums() of one cell: rows (lang, side, slot, gid, total, term, count, heavy) of the left and right tile."""
    side = table.column("side").to_numpy()
    gid, total = table.column("gid").to_numpy(), np.maximum(table.column("total").to_numpy(), 1)
    term = table.column("term").combine_chunks().dictionary_encode()
    names, term = term.dictionary, term.indices.to_numpy()
    count, is_heavy = table.column("count").to_numpy(), table.column("heavy").to_numpy(zero_copy_only=False)
    heavy = np.zeros(len(names), bool)
    heavy[term[is_heavy]] = True
    parts, totals, ids = [], [], []
    for k in (0, 1):
        own = side == k
        found, at, place = np.unique(gid[own], return_index=True, return_inverse=True)
        real = count[own] > 0
        parts.append((place[real], term[own][real], count[own][real]))
        ids.append(found), totals.append(total[own][at])
    lang = table.column("lang")[0].as_py()
    if not len(ids[0]) or not len(ids[1]):
        return pa.table({"lang": pa.array([], pa.string()), "g": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
    out = tile_sums(*parts, heavy, *totals)
    g, h = np.repeat(ids[0], len(ids[1])), np.tile(ids[1], len(ids[0]))
    keep = g != h
    return pa.table({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "g": pa.array(g[keep]), "h": pa.array(h[keep]), "value": pa.array(out.ravel()[keep])})


def divergence(docs: DataFrame, ranks: int = RANKS, tile: int = 128, postings: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) is from the other sources of its language
    (part `pair`, all ranks) and by which terms it stands out from the language as a whole (part `term`, up to `ranks`).

    docs: text, lang, source; a null counts as '', other columns are not read. Terms are runs of letters and of characters
    beyond ASCII, A-Z lower-cased; a language keeps those of LEAST of its documents (rows; a repeated row counts again). A
    group without terms, or of a language without kept terms, has distances as well (0 where nothing is kept). Ties go by
    item in UTF-8 order. An empty table gives no rows. Exact for groups and languages of up to 2^53 occurrences.

    tile: groups that one cell compares with as many others; postings: (group, term) entries of a cell, about. A term is heavy
    where over a third of a language's groups use it."""
    spark = docs.sparkSession
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with small_batches(spark):
        counts = staged(text.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "div-terms")
    by_lang = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.count("*").alias("used"))
    terms = staged(by_lang.filter(F.col("docs") >= LEAST).drop("docs"), "div-kept")
    kept = staged(counts.filter("term <> ''").select("lang", "source", "term", "count").join(terms, ["lang", "term"]), "div-used")
    groups = counts.filter("term = ''").select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("N"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(terms.groupBy("lang").agg(F.count("*").alias("V"), F.sum("all").alias("L")), "lang", "left").fillna(0, ["V", "L"])
    sizes = kept.groupBy("lang").agg(F.count("*").alias("postings"))
    langs = staged(langs.join(sizes, "lang", "left").fillna(0, ["postings"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("postings") / postings)).cast("int")), "div-langs")
    groups = groups.join(own, ["lang", "source"], "left").fillna(0, ["N"]).join(langs.select("lang", "V", "L", "groups", "blocks"), "lang")
    # Numbers of groups, by hash within a language: row_number() would bring a language's groups into one task.
    groups = staged(groups.withColumn("gid", F.xxhash64("source", "lang")).withColumn("tile", F.pmod(F.xxhash64("source", F.lit(5)), F.ceil(F.col("groups") / tile))).withColumn("total", F.col("N") + F.col("V")), "div-groups", spent=(counts,))
    out = _terms(kept, groups, ranks).unionByName(_pairs(kept, groups, tile))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _small(groups: DataFrame) -> DataFrame:
    """The table of groups, to be broadcast up to a counted number of rows (about 20 MB), else shuffled."""
    return F.broadcast(groups) if groups.count() <= 200_000 else groups


def _terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """Terms that a group uses more than its language does."""
    found = kept.join(_small(groups.select("lang", "source", "total", (F.col("L") + F.col("V")).alias("whole"))), ["lang", "source"])
    found = found.select("lang", "source", "term", share(F.col("count"), F.col("total")).alias("p"), share(F.col("all"), F.col("whole")).alias("q")).filter("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)


def _pairs(kept: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """Distances of all pairs of groups of a language: cells of two tiles and a share of the terms, added up."""
    tiles = F.ceil(F.col("groups") / tile)
    known = _small(groups.select("lang", "source", "gid", "tile", "total", "groups", "blocks"))
    heavy = F.col("used") * 3 > F.col("groups")
    rows = kept.join(known, ["lang", "source"]).select("lang", "groups", "gid", "tile", "total", "term", "count", heavy.alias("heavy"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    # Each group also comes once for each block of terms without a term, so that all pairs of a cell are there.
    bare = groups.select("lang", "groups", "gid", "tile", "total", F.lit("").alias("term"), F.lit(0).cast("long").alias("count"), F.lit(False).alias("heavy"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1)
    sides = F.concat(F.transform(others, lambda o: F.struct(F.col("tile").alias("x"), o.alias("y"), F.lit(0).alias("side"))), F.transform(others, lambda o: F.struct(o.alias("x"), F.col("tile").alias("y"), F.lit(1).alias("side"))))
    cells = rows.unionByName(bare).select("*", F.explode(sides).alias("cell")).select("lang", "block", "cell.*", "gid", "total", "term", "count", "heavy")
    sums = cells.groupBy("lang", "block", "x", "y").applyInArrow(_tiles, PAIRS).groupBy("lang", "g", "h").agg(F.sum("value").alias("sum"))
    names = groups.select("lang", "gid", "source", "V", share(F.lit(0).cast("long"), F.greatest(F.col("total"), F.lit(1))).alias("zero"))
    g = names.select("lang", F.col("gid").alias("g"), "source", "V", F.col("zero").alias("p"))
    h = names.select("lang", F.col("gid").alias("h"), F.col("source").alias("item"), F.col("zero").alias("q"))
    both = sums.join(_small(g), ["lang", "g"]).join(_small(h), ["lang", "h"])
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("sum") + F.col("V") * distance(F.col("p"), F.col("q"))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both.withColumn("rank", F.row_number().over(order))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


_SHARE = "1 + (1000000000 * ({0} + 1)) // {1}"
OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c, count(DISTINCT d) AS df FROM words GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(c)::BIGINT AS c FROM counts GROUP BY ALL HAVING sum(df) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY ALL),
named AS (SELECT DISTINCT lang, source FROM docs),
filled AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.c AS whole, coalesce(c.c, 0) AS c FROM named g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(c)::BIGINT AS n FROM filled GROUP BY ALL),
shares AS MATERIALIZED (SELECT f.lang, f.source, f.term, f.c, {_SHARE.format("f.c", "(t.n + l.v)")} AS p, {_SHARE.format("f.whole", "(l.n + l.v)")} AS q
  FROM filled f JOIN totals t ON t.lang = f.lang AND t.source = f.source JOIN langs l ON l.lang = f.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
