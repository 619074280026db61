"""Quality scores by a generalised additive model with pairwise interactions (Lou et al. 2013).

Shape functions are lookup tables over quantile bins, built by cyclic boosting: in turn each feature (later each chosen
pair) gets a shallow tree fitted to the current gradient, shrunk and added to its table. A score is a sum of looked-up
table entries, so scoring is one gather and addition for each table, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, staged
from .textbytes import chunks, mix, word_bounds, word_hashes

FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "marks", "symbols", "non_ascii",
    "marked_words", "bare_marks", "stops", "lines", "distinct_words", "top_word", "echoes", "distinct_triples",
]

_UPPER, _DIGIT_, _MARK, _SYMBOL, _HIGH, _STOP, _LINE = (np.zeros(256, dtype=bool) for _ in range(7))
_UPPER[65:91] = True
_DIGIT_[48:58] = True
_MARK[[ord(c) for c in ".,;:'\"()-!?"]] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_SYMBOL &= ~_MARK
_SYMBOL[ord("!")] = True
_HIGH[128:] = True
_STOP[[ord(c) for c in ".?!"]] = True
_LINE[10] = True


def _runs(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return (run[off[1:]] - run[off[:-1]]).astype(float)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros only."""
    n = np.diff(off).astype(float)
    starts, ends = word_bounds(buf, off)
    hashes, size, rows = word_hashes(buf, off)
    words, some = rows.astype(float), np.maximum(rows, 1)
    edge = np.concatenate([[0], np.cumsum(rows)])
    per_word = lambda flags: _runs(flags, edge) / some
    ended = _SYMBOL[buf[ends - 1]] if len(ends) else np.zeros(0, bool)
    alone = ended & (size == 1)
    out = np.zeros((len(n), len(FEATURES)))
    per_byte = np.maximum(n, 1)
    out[:, 0], out[:, 1] = np.log1p(n), np.log1p(words)
    out[:, 2] = _runs(size, edge) / some
    out[:, 3], out[:, 4] = per_word(size > 14), per_word(size < 4)
    for k, table in enumerate((_UPPER, _DIGIT_, _MARK, _SYMBOL, _HIGH), start=5):
        out[:, k] = _runs(table[buf], off) / per_byte
    out[:, 10], out[:, 11] = per_word(ended), per_word(alone)
    out[:, 12], out[:, 13] = _runs(_STOP[buf], off) / some, _runs(_LINE[buf], off) / some
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    out[:, 16] = per_word(echo)
    triple = hashes.copy()
    if len(hashes) > 2:
        triple[:-2] = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))
    for k in range(len(n)):
        own = hashes[edge[k] : edge[k + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            out[k, 14], out[k, 15] = len(counts) / len(own), counts.max() / len(own)
        if len(own) > 2:
            out[k, 17] = len(np.unique(triple[edge[k] : edge[k + 1] - 2])) / (len(own) - 2)
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(buf, off) for _, _, buf, off in chunks(batch.column("text"))]
        table = np.vstack(rows) if rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(table[:, k].astype(np.float32)) for k in range(len(FEATURES))]], ["doc_id", *FEATURES])


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row; a null text counts as empty, a text of any length is read whole. Other columns, also
    such as are named like a feature, are not read."""
    kind = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.FloatType()) for c in FEATURES]])
    return docs.select("doc_id", "text").mapInArrow(_featured, kind)


@dataclass
class AdditiveModel:
    """cuts: bin edges for each feature; tables: one value for each bin; pairs: (i, j, coarse cuts, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow(grad: np.ndarray, hess: np.ndarray, splits: int, least: float) -> np.ndarray:
    """A regression tree with `splits` cuts on one binned feature, as a table over its bins."""
    parts = [(0, len(grad))]
    for _ in range(splits):
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            if b - a < 2:
                continue
            left, right = h[:-1], h[-1] - h[:-1]
            gain = g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (h[-1] + 1)
            gain[(left < least) | (right < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, a + k + 1)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features (four leaves): its gain and its table."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best = (0.0, 0, 0)
    all_g, all_h = g[-1, -1], h[-1, -1]
    gain = np.zeros((max(g.shape[0] - 1, 0), max(g.shape[1] - 1, 0)))
    if gain.size:
        corner_g, corner_h = g[:-1, :-1], h[:-1, :-1]
        top_g, top_h, left_g, left_h = g[:-1, -1:], h[:-1, -1:], g[-1:, :-1], h[-1:, :-1]
        for x, y in ((corner_g, corner_h), (top_g - corner_g, top_h - corner_h), (left_g - corner_g, left_h - corner_h), (all_g - top_g - left_g + corner_g, all_h - top_h - left_h + corner_h)):
            gain += x**2 / (y + 1)
        gain -= all_g**2 / (all_h + 1)
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = (float(gain[at]), at[0] + 1, at[1] + 1)
    out = np.zeros(grad.shape)
    _, a, b = best
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            if grad[rows, cols].size:
                out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + 1)
    return best[0], out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.2, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> AdditiveModel:
    """Boost main effects in cycles, rank pairs by what a four-leaf tree gains on the rest, then boost the best pairs."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    cuts = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    index = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    raw = np.full(len(y), base)
    for _ in range(rounds):
        for k, table in enumerate(tables):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _shallow(np.bincount(index[k], y - p, len(table)), np.bincount(index[k], p * (1 - p), len(table)), 3, 2.0)
            table += step
            raw += step[index[k]]
    p = 1 / (1 + np.exp(-raw))
    coarse = [_edges(x[:, k], pair_bins) for k in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cell[i] * shape[1] + cell[j], values, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, _, _, table in chosen:
            p = 1 / (1 + np.exp(-raw))
            step = rate * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            raw += step[cell[i], cell[j]]
    return AdditiveModel(base, cuts, tables, chosen)


def train(feats: DataFrame, labels: DataFrame, label: str = "quality", most: int = 40_000) -> AdditiveModel | None:
    """Fit on labelled rows (doc_id, label 0 or 1; other labels are left out). None if there are none.

    A document labelled twice alike counts once, one with both labels not at all; rows without an id have no label.

    most: bound on the labelled rows that are fitted (to about 1 %). Beyond it, the rows whose hashed id falls into the matching
    share are taken; at 19 numbers a row the driver holds 6 MB at the default."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).filter("label = other").drop("other")
    rows = feats.join(known.hint("merge"), "doc_id")
    there = rows.count()
    if there > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / there * (1 << 30)))
    rows = rows.drop("doc_id").toPandas().sort_values([*FEATURES, "label"])
    if rows.empty:
        return None
    return fit(rows[FEATURES].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))


def score(feats: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """doc_id and score for every row of a feature table; 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x) if model else np.full(len(x), 0.5), pa.float64())], ["doc_id", "score"])

    return feats.mapInArrow(run, T.StructType([feats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op5_additive_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from labelled rows outside the held-out third.

    Null and empty texts are scored by their (zero) features; a repeated row is scored each time; an empty labels table
    gives 0.5 throughout."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    feats = staged(feature_table(docs), "quality-features")
    model = train(feats.filter(id_crc() % 3 != 1), labels.filter(id_crc() % 3 != 1))
    return score(feats, model).select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
