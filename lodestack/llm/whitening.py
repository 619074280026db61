"""PCA whitening of embeddings by matrix-free block Lanczos with full reorthogonalisation (Golub and Underwood 1977).

The covariance is never formed: each step is one distributed pass over the rows, which adds up the centred product XᵀX V for a
block V of directions. The driver holds the Krylov basis alone (dimensions x basis). New directions are made orthogonal to all
earlier ones, a block that breaks down is filled up with fresh random directions, a basis that is full is restarted from its
best Ritz vectors, and the residuals of the wanted pairs decide when to stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

SCALE, SHIFT = 1024, 100_000
#: Bytes of the matrix that a task holds at once, about.
MATRIX = 4 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _sound(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of rows without null or non-finite entries, their sizes, all their entries)."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0).astype(np.int64)
    flat = column.flatten()  # the entries of rows that are not null
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), dtype=bool)
    bad[row[~np.isfinite(value)]] = True  # a null entry became NaN
    bad |= column.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(~bad), sizes[~bad], value[~bad[row]]


def quantised(value: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit integers; what does not fit is the nearest number that does."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * value)
    safe = np.abs(scaled) < 2.0**62
    out = np.where(safe, scaled, 0).astype(np.int64) + SHIFT
    for k in np.flatnonzero(~safe):
        out[k] = min(HIGH, max(LOW, (int(scaled[k]) if np.isfinite(scaled[k]) else (1 << 64) * int(np.sign(scaled[k]))) + SHIFT))
    return out


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sound rows, with their integers as 8 bytes each: whole batches are matrices without a copy."""
    for batch in batches:
        rows, sizes, value = _sound(batch.column("v"))
        ends = np.append(0, np.cumsum(8 * sizes)).astype(np.int32)
        x = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(quantised(value))])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), x], ["vec_id", "x"])


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of each batch that has rows; shorter rows are filled up with the value of a zero."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("x")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 8
        flat = np.frombuffer(data, np.int64, int(ends[-1] - ends[0]), 8 * int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, np.int64)
        if (np.diff(ends) == dim).all():
            yield batch.column("vec_id"), flat.reshape(-1, dim)
            continue
        x = np.full((len(column), dim), SHIFT, np.int64)
        x[np.repeat(np.arange(len(column)), np.diff(ends)), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))] = flat
        yield batch.column("vec_id"), x


class Centre:
    """Exact column sums S of n rows: x - S/n as double, and n x - S as integers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def double(self, x: np.ndarray) -> np.ndarray:
        """x - S/n. The whole part goes first, in integers, so that nothing is lost to the size of x."""
        if x.size and max(int(x.max()), -int(x.min()), *(abs(int(w)) for w in (self.whole.min(), self.whole.max()))) >= 1 << 61:
            return x.astype(np.float64) - self.whole - self.part  # integers could wrap around
        return x - self.whole - self.part

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n x - S)^2 of each row, exactly."""
        most = max((max(abs(int(x.max()) - int(self.whole.min())), abs(int(x.min()) - int(self.whole.max()))) if x.size else 0) + 1, 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            gap = (x - self.whole) * self.n - np.array(self.rest, dtype=np.int64)
            return (gap * gap).sum(axis=1)
        gap = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (gap * gap).sum(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)


def _sums(dim: int):
    """Rows (d, high, low) whose sums over 32-bit halves are the exact column sums, and the count of rows at d = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for _, x in _read(batches, dim):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.append(0, high)), pa.array(np.append(n, low))], ["d", "high", "low"])

    return run


def _centred(rows: DataFrame, dim: int) -> Centre:
    total = rows.mapInArrow(_sums(dim), "d long, high long, low long").groupBy("d")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r["d"]: (int(r["high"]) << 32) + int(r["low"]) for r in total.agg(wide("high"), wide("low")).collect()}  # a row for each dimension
    return Centre(found[-1], [found[d] for d in range(dim)])


def _product(rows: DataFrame, centre: Centre, v: np.ndarray) -> np.ndarray:
    """Covariance times v by one pass: partial products by partition, added up by dimension."""
    dim, width = v.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, width))
        for _, x in _read(batches, dim):
            z = centre.double(x)
            total += z.T @ (z @ v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), *(pa.array(total[:, k]) for k in range(width))], ["d", *(f"y{k}" for k in range(width))])

    names = [f"y{k}" for k in range(width)]
    added = rows.mapInArrow(run, "d long, " + ", ".join(f"{c} double" for c in names)).groupBy("d").agg(*(F.sum(c).alias(c) for c in names))
    out = np.zeros((dim, width))
    for r in added.collect():  # a row for each dimension
        out[r["d"]] = [r[c] for c in names]
    return out / centre.n


def _fresh(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block that spans what is new in `block`, orthogonal to the basis.

    A direction that is nothing but rounding (breakdown) is replaced by a random one; only a full space leaves columns out."""
    found = basis
    for column in block.T:
        if found.shape[1] == len(block):
            break
        size = np.linalg.norm(column)
        for attempt in range(3):
            for _ in range(2):  # twice is enough (Parlett)
                column = column - found @ (found.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * max(size, scale if attempt == 0 else 0):
                break
            column = rng.standard_normal(len(block))
            size = np.linalg.norm(column)
        column = column / left
        column = column - found @ (found.T @ column)
        found = np.column_stack([found, column / np.linalg.norm(column)])
    return found[:, basis.shape[1] :]


def lanczos(multiply, dim: int, count: int, block: int = 8, most: int = 96, tolerance: float = 1e-14, passes: int = 500, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes) of the `count` largest eigenpairs of a symmetric positive operator; falling values.

    multiply takes (dim, width) blocks. most: columns of the basis before it is restarted from its best Ritz vectors and their
    residuals. A pair has converged when its residual is at most tolerance x largest value x sqrt(dim), which is rounding; a
    basis of the whole space is exact. More than `passes` multiplications raise an error instead of returning rough vectors."""
    count = min(count, dim)
    rng = np.random.default_rng(seed)
    most = min(dim, max(most, count + 2 * block))
    q = np.zeros((dim, 0))
    aq = np.zeros((dim, 0))
    new = _fresh(rng.standard_normal((dim, min(block, dim))), q, 0.0, rng)
    for done in range(1, passes + 1):
        product = multiply(new)
        q, aq = np.hstack([q, new]), np.hstack([aq, product])
        small = q.T @ aq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn[:, :count], aq @ turn[:, :count]
        residual = np.linalg.norm(image - ritz * values[:count], axis=0)
        largest = max(abs(values[0]), np.finfo(float).tiny)
        if q.shape[1] == dim or (q.shape[1] >= count and residual.max(initial=0) <= tolerance * largest * np.sqrt(dim)):
            return np.maximum(values[:count], 0), ritz, done
        if q.shape[1] + block > most and most < dim:
            keep = min(count + block, q.shape[1])
            rest = aq @ turn[:, :block] - (q @ turn[:, :block]) * values[:block]
            q, aq = q @ turn[:, :keep], aq @ turn[:, :keep]
            new = _fresh(rest, q, largest * 1e-4, rng)
        else:
            new = _fresh(product, q, largest * 1e-4, rng)
    raise RuntimeError(f"eigenvectors have not converged in {passes} passes over the rows")


def _identity_error(rows: DataFrame, centre: Centre, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by one pass."""
    width = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for _, x in _read(batches, len(turn)):
            w = centre.double(x) @ turn
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.divmod(np.arange(total.size), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "c"])

    total = np.zeros((width + 1, width))
    for r in rows.mapInArrow(run, "i long, j long, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # (width + 1) x width rows
        total[r["i"], r["j"]] = r["c"]
    mean = total[-1] / centre.n
    return float(np.abs(total[:-1] / centre.n - np.outer(mean, mean) - np.eye(width)).max())


def _trace(rows: DataFrame, centre: Centre, dim: int) -> int:
    """Sum of all deviations, exactly, of any size: pieces of 60 bits are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _read(batches, dim):
            own = centre.deviations(x)
            total += int(own.sum()) if own.dtype == object else (int((own >> 32).sum()) << 32) + int((own & 0xFFFFFFFF).sum())
        pieces = [total >> k & (1 << 60) - 1 for k in range(0, max(1, total.bit_length()), 60)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.int64())], ["k", "piece"])

    found = rows.mapInArrow(run, "k long, piece long").groupBy("k").agg(F.sum(F.col("piece").cast("decimal(38,0)")).alias("piece")).collect()  # a row for each piece
    return sum(int(r["piece"]) << (60 * r["k"]) for r in found)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = 8, block: int = 8, most: int = 96) -> DataFrame:
    """A row for each remaining vector and component up to `count`: the columns of WHITENED, components numbered from 1.

    Vectors that are null or hold null, NaN or infinite entries are dropped; an entry c of the others becomes the integer
    x = floor(1024 c) + 100000 (of 64 bits: larger ones are the nearest such number). Shorter vectors are filled up with zeros.
    Repeated rows and ids count as often as they come, a null id stays null, other columns are not read. deviation is exact; one
    beyond 64 bits is given as 2^63 - 1 (the trace is added up without that limit). A component without variance cannot be
    scaled and is left out: constant vectors, one row or an empty table give no rows. Equal eigenvalues have any basis of
    their space, the same for all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    with small_batches(spark, 4096):
        held = staged(rows.mapInArrow(_integers, "vec_id long, x binary"), "white-integers")
    dim = held.agg(F.max(F.length("x"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], WHITENED)
    dim //= 8
    with small_batches(spark, max(16, MATRIX // (8 * dim))):
        centre = _centred(held, dim)
        trace = _trace(held, centre, dim)
        if not trace:
            return spark.createDataFrame([], WHITENED)
        values, ritz, _ = lanczos(lambda v: _product(held, centre, v), dim, count, block, most)
        kept = values > 1e-13 * values[0]
        turn = ritz[:, kept] / np.sqrt(values[kept])
        explained = values[kept] / (trace / centre.n**3)  # a quotient of integers is correctly rounded
        return staged(held.mapInArrow(_projected(centre, turn, explained, _identity_error(held, centre, turn)), WHITENED), "whitened", spent=(held,))


def _projected(centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float):
    dim, width = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _read(batches, dim):
            n, own = len(x), centre.deviations(x)
            if own.dtype == object:
                own = np.array([min(HIGH, v) for v in own], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(n), width))
            columns = [ids.take(row), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)), pa.array(np.full(n * width, centre.n)), pa.array(np.repeat(own, width)), pa.array((centre.double(x) @ turn).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * width, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every embedding."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
