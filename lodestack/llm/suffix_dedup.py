"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts earlier, in a smaller doc_id or before it in the same
document. Every such string holds a minimiser: the window of CORE bytes with the least hash among its windows, which depends
on the string alone. Strings that are equal therefore meet at equal minimisers, so it is enough to

1. find the minimisers of every text and deal them by hash, each with a hash of all bytes that strings around it can hold
   (its neighbourhood). Of equal neighbourhoods all but the first are repeats as a whole;
2. where a minimiser stands in different neighbourhoods, bring one copy of each to a shard, sort the shard's suffixes by
   induced sorting, and read runs of common prefixes of SPAN bytes from the permuted prefix array; all but the first
   string of a run are repeats;
3. merge the repeats of each document and cut them out.

A minimiser in more than HOT neighbourhoods (a line that very many texts share, each going on in its own way) would make one
shard grow with the corpus. Its strings are dealt one by one instead: each string of SPAN bytes around it goes to a partition
of its own hash, where all but the first are repeats. A task that meets a minimiser in more than LOOSE neighbourhoods already
deals them by neighbourhood and only leaves a mark with the minimiser's partition, which then treats the rest alike.

Equal neighbourhoods are settled within a task before anything is shuffled, so a task sends each of them at most once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, matched, shuffle_parts, small_batches, staged
from .induced_sort import joined, permuted_lcp, suffix_array
from .textbytes import BYTE, chunks, mix, series, text_array

SPAN, CORE = 100, 32
#: Bytes that a string around a minimiser can hold before it, and from its start on.
REACH = SPAN - CORE
#: Neighbourhoods of one minimiser that are brought to one shard at most.
HOT = 1024
LOOSE = 128
#: Bytes of a piece of a very long text, whose minimisers are found at once.
PIECE = 1 << 20
#: Text of one suffix array.
SHARD_BYTES = 256 << 10
_U = np.uint64
_MAX = np.iinfo(np.uint64).max
_STEP = series(32, 9) | _U(1)
_GAP = _U(0x1234567890ABCDEF)
_NULL_ID = -(1 << 63)

ANCHOR = np.dtype([("core", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<u4")])
COVER = np.dtype([("doc", "<i8"), ("low", "<u4"), ("high", "<u4")])
ASK = np.dtype([("doc", "<i8"), ("core", "<u8"), ("at", "<u4"), ("hot", "u1")])
STRING = np.dtype([("core", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<u4")])


def _doubled(h: np.ndarray, step: int, k: int) -> np.ndarray:
    """Hashes of windows twice as long as those in h, which are `step` bytes."""
    out = h[:-step] * _STEP[k]
    out += h[step:]
    out ^= out >> _U(29)
    out *= _STEP[k + 8]
    return out


def _sliding(least, x: np.ndarray, width: int) -> np.ndarray:
    """least (np.minimum or np.maximum) over each run of `width` values."""
    step = 1
    while 2 * step <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def _inside(starts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """Positions in any of the runs [start, end)."""
    change = np.zeros(total + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:total] > 0


def minimisers(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash, hash of the neighbourhood) of the minimisers of all strings of SPAN bytes.

    Rows stand SPAN apart, so that no window crosses them. Equal least hashes are all minimisers."""
    size = np.diff(off)
    shift = (np.arange(len(size)) + 1) * SPAN
    total = len(buf) + (len(size) + 1) * SPAN
    h1 = np.full(total + 2 * SPAN, _GAP, dtype=_U)
    h1[np.arange(len(buf)) + np.repeat(shift, size)] = BYTE[buf]
    hs = [h1]
    for k in range(5):
        hs.append(_doubled(hs[-1], 1 << k, k))
    starts, ends = off[:-1] + shift, off[:-1] + shift + size
    long = size >= SPAN
    core = np.where(_inside(starts[long], ends[long] - CORE + 1, total), hs[5][:total], _MAX)
    low = _sliding(np.minimum, core, REACH + 1)
    low = np.where(_inside(starts[long], ends[long] - SPAN + 1, len(low)), low, _U(0))
    edge = np.zeros(REACH, dtype=_U)
    best = _sliding(np.maximum, np.concatenate([edge, low, edge]), REACH + 1)
    at = np.flatnonzero((core == best) & (core != _MAX))
    around = np.zeros(len(at), dtype=_U)
    for k in range(5):
        around = mix(around * _STEP[20] + hs[5][at - REACH + 32 * k])
    around = mix(around * _STEP[20] + hs[3][at - REACH + 160])
    row = np.searchsorted(starts, at, side="right") - 1
    return row, at - starts[row], core[at], around


def _piecewise(buf: np.ndarray, off: np.ndarray, step: int = 0):
    """minimisers(), a very long text in overlapping pieces."""
    step = step or PIECE
    if len(off) != 2 or len(buf) <= 2 * step:
        return minimisers(buf, off)
    found = []
    pad = 2 * SPAN
    for a in range(0, len(buf), step):
        lo, hi = max(0, a - pad), min(len(buf), a + step + pad)
        _, at, core, around = minimisers(buf[lo:hi], np.array([0, hi - lo]))
        own = (at + lo >= a) & (at + lo < a + step)
        found.append((at[own] + lo, core[own], around[own]))
    at, core, around = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.zeros(len(at), dtype=np.int64), at, core, around


def _packed(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, dtype=kind), 0
    for f in kind.names:
        own = kind.fields[f][0]
        out[f] = np.frombuffer(blob, own, n, at)
        at += n * own.itemsize
    return out


def _dealt(rows: np.ndarray, by: str, kind: int, parts: int) -> pa.RecordBatch:
    """Rows packed for their target partitions."""
    part = (mix(rows[by].astype(_U)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(part))[: len(cuts)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int8()), pa.array([_packed(rows[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["part", "kind", "data"])


DEALT = "part int, kind byte, data binary"
IS_ANCHOR, IS_COVER, IS_ASK, IS_STRING, IS_NEAR, IS_LOOSE, IS_MARK = range(7)
MARK = np.dtype([("core", "<u8")])


def _covers(doc: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    out = np.empty(len(doc), dtype=COVER)
    out["doc"] = doc
    out["low"] = np.maximum(at.astype(np.int64) - before, 0)
    out["high"] = at.astype(np.int64) + after
    return merged(out)


def merged(covers: np.ndarray) -> np.ndarray:
    """Covers of each document as maximal runs, in order."""
    if not len(covers):
        return covers
    covers = covers[np.lexsort((covers["low"], covers["doc"]))]
    _, group = np.unique(covers["doc"], return_inverse=True)
    lift = group.astype(np.int64) << 33
    reach = np.maximum.accumulate(covers["high"].astype(np.int64) + lift)
    fresh = np.append(True, covers["low"][1:].astype(np.int64) + lift[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    out = covers[first].copy()
    out["high"] = (reach - lift)[np.append(first[1:], len(covers)) - 1]
    return out


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each neighbourhood, repeats that start elsewhere), from rows in any order.

    Neighbourhoods are the same if both their hash and their minimiser's are, so only those of one minimiser can be confused,
    with a chance of 2^-64 a pair."""
    order = np.argsort(rows["around"])
    rows = rows[order]
    fresh = np.append(True, rows["around"][1:] != rows["around"][:-1])
    lone = fresh & np.append(fresh[1:], True)
    shared = rows[~lone]
    shared = shared[np.lexsort((shared["at"], shared["doc"], shared["core"], shared["around"]))]
    fresh = np.append(True, (shared["around"][1:] != shared["around"][:-1]) | (shared["core"][1:] != shared["core"][:-1])) if len(shared) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(shared)), 0)) if len(shared) else np.zeros(0, np.int64)
    later = (shared["doc"] != shared["doc"][head]) | (shared["at"] != shared["at"][head])
    return np.concatenate([rows[lone], shared[fresh]]), shared[later]


def _scan(parts: int, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def settle() -> Iterator[pa.RecordBatch]:
            first, later = _firsts(np.concatenate(held))
            core, of, count = np.unique(first["core"], return_inverse=True, return_counts=True)
            loose = count > LOOSE
            if loose.any():
                marks = np.empty(int(loose.sum()), dtype=MARK)
                marks["core"] = core[loose]
                yield _dealt(marks, "core", IS_MARK, parts)
                yield _dealt(first[loose[of]], "around", IS_LOOSE, parts)
                first = first[~loose[of]]
            yield _dealt(first, "core", IS_ANCHOR, parts)
            if len(later):
                yield _dealt(_covers(later["doc"], later["at"], REACH, SPAN), "doc", IS_COVER, parts)

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for i, j, buf, off in chunks(batch.column("text"), 1 << 18):
                row, at, core, around = _piecewise(buf, off)
                own = np.empty(len(row), dtype=ANCHOR)
                own["core"], own["around"], own["doc"], own["at"] = core, around, ids[i:j][row], at
                held.append(own)
                count += len(own)
            if count > most:
                yield from settle()
                held, count = [], 0
        if held:
            yield from settle()

    return run


def _asked(first: np.ndarray, hot: np.ndarray) -> np.ndarray:
    asks = np.empty(len(first), dtype=ASK)
    for f in ("doc", "core", "at"):
        asks[f] = first[f]
    asks["hot"] = hot
    return asks


def _met(parts: int):
    """Partitions of anchors: repeats of whole neighbourhoods, and questions for minimisers with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {IS_ANCHOR: [], IS_LOOSE: [], IS_MARK: []}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == IS_COVER).any():
                yield batch.filter(pa.array(kind == IS_COVER))
            for k, held in blobs.items():
                held += [x.as_py() for x in batch.column("data").filter(pa.array(kind == k))]
        loose = np.concatenate([np.zeros(0, ANCHOR), *[_unpacked(x, ANCHOR) for x in blobs.pop(IS_LOOSE)]])
        if len(loose):
            first, later = _firsts(loose)
            if len(later):
                yield _dealt(_covers(later["doc"], later["at"], REACH, SPAN), "doc", IS_COVER, parts)
            yield _dealt(_asked(first, np.ones(len(first), bool)), "doc", IS_ASK, parts)
        marks = np.unique(np.concatenate([np.zeros(0, _U), *[_unpacked(x, MARK)["core"] for x in blobs.pop(IS_MARK)]]))
        rows = np.concatenate([np.zeros(0, ANCHOR), *[_unpacked(x, ANCHOR) for x in blobs.pop(IS_ANCHOR)]])
        rows = rows[np.argsort(rows["core"])]
        fresh = np.append(True, rows["core"][1:] != rows["core"][:-1])[: len(rows)]
        rows = rows[~(fresh & np.append(fresh[1:], True)[: len(rows)]) | np.isin(rows["core"], marks)]
        if not len(rows):
            return
        first, later = _firsts(rows)
        if len(later):
            yield _dealt(_covers(later["doc"], later["at"], REACH, SPAN), "doc", IS_COVER, parts)
        first = first[np.argsort(first["core"], kind="stable")]
        fresh = np.append(True, first["core"][1:] != first["core"][:-1])
        count = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1]
        marked = np.isin(first["core"], marks)
        wanted = marked | (count > 1)
        if wanted.any():
            yield _dealt(_asked(first[wanted], (marked | (count > HOT))[wanted]), "doc", IS_ASK, parts)

    return run


def _by_doc(kind: np.dtype):
    """One row for each document of a partition: doc, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_py() for batch in batches for x in batch.column("data")]
        if not blobs:
            return
        rows = np.concatenate([_unpacked(x, kind) for x in blobs])
        rows = merged(rows) if kind is COVER else rows[np.argsort(rows["doc"], kind="stable")]
        cuts = np.flatnonzero(np.append(True, rows["doc"][1:] != rows["doc"][:-1]))
        ends = np.append(cuts[1:], len(rows))
        for k in range(0, len(cuts), 20_000):
            own = list(zip(cuts[k : k + 20_000], ends[k : k + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][cuts[k : k + 20_000]], pa.int64()), pa.array([_packed(rows[a:b]) for a, b in own], pa.binary())], ["doc", "data"])

    return run


def _strings(own: bytes, at: np.ndarray, core: np.ndarray, doc: int) -> np.ndarray:
    """The strings of SPAN bytes around minimisers of one text, by minimiser, hash and place."""
    buf = np.frombuffer(own, dtype=np.uint8)
    low, high = np.maximum(at.astype(np.int64) - REACH, 0), np.minimum(at.astype(np.int64) + SPAN, len(buf))
    out = []
    for a, b, least in zip(low.tolist(), high.tolist(), core, strict=True):
        hs = [BYTE[buf[a:b]]]
        for k in range(5):
            hs.append(_doubled(hs[-1], 1 << k, k))
        n = b - a - SPAN + 1
        h = np.zeros(n, dtype=_U)
        for k in range(3):
            h = mix(h * _STEP[21] + hs[5][32 * k : 32 * k + n])
        one = np.empty(n, dtype=STRING)
        one["core"], one["around"], one["doc"], one["at"] = least, mix(h * _STEP[21] + hs[2][96 : 96 + n]), doc, a + np.arange(n)
        out.append(one)
    return np.concatenate(out)


NEAR = "part int, kind byte, core long, doc long, low long, near binary"


def _near(part: np.ndarray, kind: int, core: np.ndarray, doc: np.ndarray, low: np.ndarray, near: list) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(n, kind, np.int8)), pa.array(np.ascontiguousarray(core).view(np.int64)), pa.array(doc, pa.int64()), pa.array(low, pa.int64()), pa.array(near, pa.binary())], ["part", "kind", "core", "doc", "low", "near"])


def _answered(parts: int, most: int = 1 << 18):
    """Neighbourhoods that were asked for, dealt by minimiser, and packed strings of hot minimisers, dealt by their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def settle() -> Iterator[pa.RecordBatch]:
            first, later = _firsts(np.concatenate(held))
            sent = _dealt(first, "around", IS_STRING, parts)
            none = np.zeros(sent.num_rows, dtype=_U)
            yield _near(sent.column("part").to_numpy(), IS_STRING, none, none.astype(np.int64), none.astype(np.int64), sent.column("data").to_pylist())
            if len(later):
                sent = _dealt(_covers(later["doc"], later["at"], 0, SPAN), "doc", IS_COVER, parts)
                none = np.zeros(sent.num_rows, dtype=_U)
                yield _near(sent.column("part").to_numpy(), IS_COVER, none, none.astype(np.int64), none.astype(np.int64), sent.column("data").to_pylist())

        for batch in batches:
            raw, off = text_array(batch.column("text"))
            ids = batch.column("doc").to_numpy()
            for k in range(batch.num_rows):
                asks = _unpacked(batch.column("data")[k].as_py(), ASK)
                own = raw[off[k] : off[k + 1]].tobytes()
                if asks["hot"].any():
                    hot = asks[asks["hot"] == 1]
                    held.append(_strings(own, hot["at"], hot["core"], int(ids[k])))
                    count += len(held[-1])
                    asks = asks[asks["hot"] == 0]
                if len(asks):
                    low = np.maximum(asks["at"].astype(np.int64) - REACH, 0)
                    part = (mix(asks["core"]) % _U(parts)).astype(np.int64)
                    yield _near(part, IS_NEAR, asks["core"], np.full(len(asks), ids[k]), low, [own[a : b + SPAN] for a, b in zip(low.tolist(), asks["at"].tolist(), strict=True)])
                if count > most:
                    yield from settle()
                    held, count = [], 0
        if held:
            yield from settle()

    return run


def repeats(texts: list[bytes], doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Covers of the strings of SPAN bytes in texts that also start earlier; texts[i] begins at byte low[i] of document doc[i]."""
    s = joined(texts)
    order = suffix_array(s)
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(of)) - start[of]
    until = np.append(size[of] - 1 - at, 0)
    lcp = permuted_lcp(s, order, until)[order]
    run = np.cumsum(lcp < SPAN) - 1
    count = np.bincount(run)
    many = count[run] > 1
    own, run = order[many], run[many]
    if not len(own):
        return np.zeros(0, dtype=COVER)
    d, place = doc[of[own]], low[of[own]] + at[own]
    turn = np.lexsort((place, d, run))
    d, place, run = d[turn], place[turn], run[turn]
    fresh = np.append(True, run[1:] != run[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
    later = (d != d[head]) | (place != place[head])
    return _covers(d[later], place[later], 0, SPAN)


def _induced(parts: int):
    """Suffix arrays over runs of whole minimisers of a partition, and the strings of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings = [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for k in np.flatnonzero(kind == IS_COVER):
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(k, 1), batch.column("kind").slice(k, 1), batch.column("near").slice(k, 1)], ["part", "kind", "data"])
            strings += [_unpacked(x.as_py(), STRING) for x in batch.column("near").filter(pa.array(kind == IS_STRING))]
            if (kind == IS_NEAR).any():
                held.append(pa.Table.from_batches([batch.filter(pa.array(kind == IS_NEAR))]))
        if strings:
            _, later = _firsts(np.concatenate(strings))
            if len(later):
                yield _dealt(_covers(later["doc"], later["at"], 0, SPAN), "doc", IS_COVER, parts)
        if not held:
            return
        rows = pa.concat_tables(held)
        core = rows.column("core").to_numpy()
        order = np.argsort(core, kind="stable")
        core, doc, low = core[order], rows.column("doc").to_numpy()[order], rows.column("low").to_numpy()[order]
        near = rows.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        size = pc.binary_length(near).to_numpy(zero_copy_only=False)[order]
        whole = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
        filled = np.append(np.cumsum(size) - size, size.sum())
        a = 0
        while a < len(core):
            b = whole[np.searchsorted(filled[whole], filled[a] + SHARD_BYTES, side="right") :][:1]
            b = max(int(b[0]) if len(b) else len(core), a + 1)
            found = repeats(near.take(pa.array(order[a:b])).to_pylist(), doc[a:b], low[a:b])
            if len(found):
                yield _dealt(found, "doc", IS_COVER, parts)
            a = b

    return run


KEPT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("kept_text", T.StringType()),
])


_ARROW = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.list_(pa.int64())), "kept_text": pa.string()}


def _parts(docs: DataFrame, text: str) -> int:
    """Shuffle partitions: those of the session, or more, so that one gets the anchors of about 48 MB of text at most."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), size // (48 << 20))


def repeated_covers(docs: DataFrame, parts: int) -> DataFrame:
    """doc, data: the packed covers of each document that has any. docs: doc (long, not null), text."""
    met = docs.mapInArrow(_scan(parts), DEALT).repartitionById(parts, F.col("part")).mapInArrow(_met(parts), DEALT)
    met = staged(met, "dedup-met")
    asks = met.filter(F.col("kind") == IS_ASK).repartitionById(parts, F.col("part")).mapInArrow(_by_doc(ASK), "doc long, data binary")
    asks = staged(asks, "dedup-asks")
    asked = matched(docs, asks.select("doc"), "doc", "left_semi").join(asks.hint("merge"), "doc")
    near = asked.select("doc", "text", "data").mapInArrow(_answered(parts), NEAR).repartitionById(parts, F.col("part"))
    induced = staged(near.mapInArrow(_induced(parts), DEALT), "dedup-induced", spent=(asks,))
    covers = met.filter(F.col("kind") == IS_COVER).unionByName(induced).repartitionById(parts, F.col("part"))
    return staged(covers.mapInArrow(_by_doc(COVER), "doc long, data binary"), "dedup-covers", spent=(met, induced))


def _cut(own: bytes, data: bytes | None) -> tuple[bytes, np.ndarray]:
    """(bytes that stay, maximal removed runs)."""
    if data is None:
        return own, np.zeros((0, 2), np.int64)
    rows = _unpacked(data, COVER)
    low, high = rows["low"].astype(np.int64), np.minimum(rows["high"].astype(np.int64), len(own))
    last, kept = 0, []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        kept.append(own[last:a])
        last = b
    kept.append(own[last:])
    return b"".join(kept), np.stack([low, high], axis=1)


def _identified(docs: DataFrame, doc_id: str, text: str, parts: int, name: str) -> DataFrame:
    """docs with a column of that name, a number ordered as the ids are (null first) that only rows alike in id and text share.

    Where no id occurs twice it is the id itself, otherwise the rank of (id, digest of the text), counted over ranges."""
    rows = docs.withColumn(name, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)))
    if rows.groupBy(name).count().filter("count > 1").isEmpty():
        return rows
    p = free_prefix(docs.columns, ["id", "digest", "i", "d"])
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(f"{p}id", F.col(doc_id).cast("long")).withColumn(f"{p}digest", digest)
    ranged = marked.select(F.col(f"{p}id").alias("i"), F.col(f"{p}digest").alias("d")).distinct().repartitionByRange(parts, "i", "d")
    ranged = staged(ranged.withColumn("range", F.spark_partition_id()), "dedup-ids")
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())  # a row for each partition
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    starts = docs.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(counts, before, strict=False)], "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("i", "d"))
    ranks = ranged.withColumn("at", place).join(F.broadcast(starts), "range").select(F.col("i").alias(f"{p}i"), F.col("d").alias(f"{p}d"), (F.col("before") + F.col("at") - 1).alias(name))
    named = marked.join(ranks, F.col(f"{p}id").eqNullSafe(F.col(f"{p}i")) & (F.col(f"{p}digest") == F.col(f"{p}d")))
    return staged(named.select(*docs.columns, name), "dedup-rows", spent=(ranged,))


def remove_repeats(docs: DataFrame, keep: list[str], want: list[str], doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """keep columns of docs and the wanted columns of KEPT (with prefix before their names): sizes, spans, digest and bytes left of each document.

    A null text is empty; a text under SPAN bytes keeps all; a text of any length is read whole. A null id comes before all
    others. Rows alike in id and text get the same result; rows of one id (or without one) and different texts are documents
    of their own, ordered by digest. An empty table gives no rows. Columns of any name pass through, as long as the prefixed
    new names differ from them. Texts are UTF-8 bytes throughout; what is left of a text may cut characters."""
    clash = [prefix + c for c in want if prefix + c in keep]
    if clash:
        raise ValueError(f"columns {clash} of the table clash with the new ones; name a prefix")
    p = free_prefix([*docs.columns, *[prefix + c for c in want]], ["doc", "text", "data"])
    doc, whole, found = p + "doc", p + "text", p + "data"
    parts = _parts(docs, text)
    docs = _identified(docs, doc_id, text, parts, doc)
    with small_batches(docs.sparkSession):
        covers = repeated_covers(docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")), parts)
    rows = docs.select(*keep, doc, F.coalesce(F.col(text), F.lit("")).alias(whole))
    rows = rows.join(covers.select(F.col("doc").alias(doc), F.col("data").alias(found)).hint("merge"), doc, "left")
    fields = [T.StructField(prefix + c, KEPT[c].dataType) for c in want]
    make = {
        "n_bytes": lambda own, kept, spans: len(own),
        "n_removed": lambda own, kept, spans: len(own) - len(kept),
        "n_spans": lambda own, kept, spans: len(spans),
        "kept_sha256": lambda own, kept, spans: hashlib.sha256(kept).hexdigest(),
        "kept": lambda own, kept, spans: kept,
        "spans": lambda own, kept, spans: spans.tolist(),
        "kept_text": lambda own, kept, spans: kept.decode("utf-8", "ignore"),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {c: [] for c in want}
            raw, off = text_array(batch.column(whole))
            data = batch.column(found)
            for k in range(batch.num_rows):
                own = raw[off[k] : off[k + 1]].tobytes()
                kept, spans = _cut(own, data[k].as_py())
                for c in want:
                    made[c].append(make[c](own, kept, spans))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(made[c], _ARROW[c]) for c in want]], [*keep, *[prefix + c for c in want]])

    return rows.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *fields]))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What exact removal of repeated 100-byte strings leaves of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings; those of which nothing but white space is left go.

    The columns stay those of docs; n_chars follows the new text, where there is such a column. The stray bytes of a character
    that was cut go too. A null text becomes empty."""
    columns = docs.columns
    own = [c for c in columns if c not in ("text", "n_chars")]
    p = free_prefix(columns, ["n_removed", "kept_text"])
    found = remove_repeats(docs, own, ["n_removed", "kept_text"], prefix=p).filter((F.col(f"{p}n_removed") == 0) | F.col(f"{p}kept_text").rlike(r"\S"))
    new = {"text": F.col(f"{p}kept_text"), "n_chars": F.length(f"{p}kept_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else c for c in columns])
