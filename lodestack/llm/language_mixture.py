"""Language identification by mixture inference: EM over word likelihoods, language sets chosen by penalised likelihood.

Model: hashed byte trigrams per language, counted over every training text. A word's likelihood under a language is the
product of its trigrams'; a document is a mixture of languages with unknown proportions. EM gives the proportions; the
languages are ranked by them, and the number kept maximises log-likelihood minus a BIC-like penalty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, id_crc
from .textbytes import LOWER, chunks

#: Size of the trigram table; the model is languages x BINS numbers whatever the corpus.
BINS = 1 << 15
UNKNOWN = "und"

# Letters keep their (folded) byte, everything else becomes a blank. Bytes from 0x80 are parts of non-ASCII characters.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _folded(buf: np.ndarray) -> np.ndarray:
    low = _FOLD[buf]
    if len(buf) > 1:  # capital letters of Latin-1: C3 80..9E
        upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
        low[upper] += 0x20
    return low


def _trigrams(low: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bin of the trigram centred on each byte; before and after a text stands a blank, whatever its neighbours are."""
    mid = low.astype(np.uint32)
    before, after = np.full(len(low), 0x20, dtype=np.uint32), np.full(len(low), 0x20, dtype=np.uint32)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    some = np.diff(off) > 0
    before[off[:-1][some]], after[off[1:][some] - 1] = 0x20, 0x20
    code = (before * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language among these rows: (lang, bin, n)."""
    langs: dict[str, int] = {}
    totals = np.zeros((0, BINS), dtype=np.int64)
    for batch in batches:
        own = [langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()]
        if len(langs) > len(totals):
            totals = np.vstack([totals, np.zeros((len(langs) - len(totals), BINS), np.int64)])
        own = np.array(own, dtype=np.int64)
        for i, j, buf, off in chunks(batch.column("text")):
            low = _folded(buf)
            letter = low != 0x20
            key = (np.repeat(own[i:j], np.diff(off)) * BINS + _trigrams(low, off))[letter]
            seen = np.bincount(key, minlength=totals.size) if len(key) * 4 > totals.size else None
            if seen is None:
                bins, n = np.unique(key, return_counts=True)
                totals.ravel()[bins] += n
            else:
                totals += seen.reshape(totals.shape)
    for name, k in langs.items():
        bins = np.flatnonzero(totals[k])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(totals[k][bins], pa.int64())], ["lang", "bin", "n"])


class LanguageModel:
    """Language names (sorted) and log-probabilities of the bins, one row for each bin."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names, self.logp = names, logp


def train(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Count every text of docs (text, lang; rows with a null in either are left out).

    The driver receives one count for each language and bin, however many documents there are."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = usable.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((BINS, len(names)))
    counts[rows["bin"].to_numpy(dtype=np.int64), np.array([names.index(x) for x in rows["lang"]], dtype=np.int64)] = rows["n"].to_numpy()
    counts += smoothing
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32) if names else counts.astype(np.float32))


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of runs of `rows` values each (runs may be empty); a run's sum depends on its own values alone."""
    out = np.zeros((len(rows), *values.shape[1:]))
    some = rows > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(rows) - rows)[some], axis=0)
    return out


def _word_logs(low: np.ndarray, off: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods of words [words, languages], words per row)."""
    letter = low != 0x20
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[off] = True
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | edge[1:-1]
    starts = np.flatnonzero(starts)
    rows = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.zeros((0, logp.shape[1]), np.float32), rows
    at = np.flatnonzero(letter)
    return np.add.reduceat(logp[_trigrams(low, off)[at]], np.searchsorted(at, starts), axis=0), rows


def _fit(like: np.ndarray, rows: np.ndarray, allowed: np.ndarray, near: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for each run of words over its allowed languages: (proportions, log-likelihood, what the maximum is above it at most).

    The log-likelihood is concave in the proportions, so with g the mean over words of like / mixture, the maximum is at most
    words * (max g - 1) above the current value. A document is done when that is below `near`, or after `rounds` rounds."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    value, gap = np.zeros(len(rows)), np.zeros(len(rows))
    open_ = np.flatnonzero(rows)
    like = like[np.repeat(rows > 0, rows)]
    for turn in range(rounds):
        own, words = share[open_], rows[open_]
        mixed = (like * np.repeat(own, words, axis=0)).sum(axis=1, keepdims=True)
        mixed = np.maximum(mixed, 1e-300)
        g = _sums(like / mixed, words) / words[:, None]
        value[open_] = _sums(np.log(mixed[:, 0]), words)
        gap[open_] = words * np.maximum((g * allowed[open_]).max(axis=1) - 1, 0)
        done = gap[open_] < near
        if turn == rounds - 1 or done.all():
            break
        new = own * g
        share[open_[~done]] = (new / new.sum(axis=1, keepdims=True))[~done]
        if done.any():
            like = like[np.repeat(~done, words)]
            open_ = open_[~done]
    return share, value, gap


def infer(logs: np.ndarray, rows: np.ndarray, penalty: float = 3.0, near: float = 0.05, rounds: int = 200) -> np.ndarray:
    """Language proportions [documents, languages] of runs of words (rows: words of each); zero outside the chosen language set.

    Each document first gets EM over all languages; languages ranked by proportion give nested sets, EM is run again within
    each set, and the set with the largest log-likelihood - penalty * size * ln(words + 1) / 2 stays (the smaller one on
    ties). Sets that cannot win, because even the maximum over all languages less their penalty is below the best one so far,
    are skipped; nothing else is. near, rounds: see _fit()."""
    n, count = logs.shape[1], len(rows)
    if not n:
        return np.zeros((count, 0))
    top = logs.max(axis=1, keepdims=True) if len(logs) else logs
    like = np.exp((logs - top).astype(np.float64))
    full, value, gap = _fit(like, rows, np.ones((count, n)), near, rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    cost = penalty * np.log(rows + 1) / 2
    single = np.take_along_axis(_sums(np.log(np.maximum(like, 1e-300)), rows), order[:, :1], axis=1)[:, 0]
    best, chosen = single - cost, (rank == 0).astype(float)
    for size in range(2, n + 1):
        open_ = np.flatnonzero((rows > 0) & (value + gap - size * cost > best))
        if not len(open_):
            break  # larger sets cost more
        of = np.zeros(count, dtype=bool)
        of[open_] = True
        share, fit, _ = _fit(like[np.repeat(of, rows)], rows[open_], (rank[open_] < size).astype(float), near, rounds)
        score = fit - size * cost[open_]
        better = score > best[open_]
        best[open_[better]] = score[better]
        chosen[open_[better]] = share[better]
    chosen[rows == 0] = 0
    return chosen


def _has_letter(column: pa.Array, lo: int, hi: int, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    has = hits[off[1:]] > hits[off[:-1]]
    for k in np.flatnonzero(~has & (np.diff(off) > 0)):
        has[k] = any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "ignore"))
    return has


PREDICTION = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("proportions", T.ArrayType(T.DoubleType())),
])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """Language columns for every row: lang_pred, score, languages, proportions (largest first; ties by name).

    keep: further columns to carry along; prefix: before the names of the new columns, which keep must not have. score is the
    proportion of lang_pred. A text that is null or has no letter, and any text where the model knows no language, is `und`
    with score 0 and empty lists. A text is read whole, one of over 2 MB in pieces of 1 MB that end at blanks. An answer
    depends on the text alone, not on the rows beside it, so repeated rows get equal answers. An empty table gives no rows."""
    clash = [prefix + c for c in PREDICTION.names if prefix + c in keep]
    if clash:
        raise ValueError(f"columns {clash} of the table clash with the new ones; name a prefix")
    names, logp = model.names, model.logp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores, sets, shares = [], [], [], []
            column = batch.column(text)
            for i, j, buf, off in chunks(column):
                has = _has_letter(column, i, j, buf, off)
                if not names:
                    has[:] = False
                if has.any():
                    if j - i == 1 and len(buf) > 1 << 21:
                        low = _folded(buf)
                        cuts = [0]
                        while cuts[-1] + (1 << 20) < len(low):
                            blank = np.flatnonzero(low[cuts[-1] + (1 << 20) :][: 1 << 20] == 0x20)
                            cuts.append(cuts[-1] + (1 << 20) + (int(blank[0]) if len(blank) else 0))
                        cuts.append(len(low))
                        logs = np.concatenate([_word_logs(low[a:b], np.array([0, b - a]), logp)[0] for a, b in zip(cuts, cuts[1:], strict=False)])
                        rows = np.array([len(logs)])
                    else:
                        logs, rows = _word_logs(_folded(buf), off, logp)
                    share = infer(logs, rows)
                else:
                    share = np.zeros((j - i, len(names)))
                for k in range(j - i):
                    if not has[k] or not share[k].any():
                        preds.append(UNKNOWN), scores.append(0.0), sets.append([]), shares.append([])
                        continue
                    order = [x for x in np.argsort(-share[k], kind="stable") if share[k][x] > 0]
                    preds.append(names[order[0]]), scores.append(float(min(1.0, share[k][order[0]])))
                    sets.append([names[x] for x in order]), shares.append([float(share[k][x]) for x in order])
            out = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], [*keep, *[prefix + c for c in PREDICTION.names]])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + f.name, f.dataType) for f in PREDICTION.fields])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(id_crc() % 4 != 2)


def op6_language_mixture(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, train(_learnable(docs)), ["doc_id"])
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their `lang`; those that no language is found for go.

    The columns stay those of docs. Nulls and repeated rows are treated as in identify()."""
    model = train(_learnable(docs))
    columns = docs.columns
    prefix = free_prefix(columns, PREDICTION.names)
    found = identify(docs, model, columns, prefix=prefix).filter(F.col(f"{prefix}lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"{prefix}lang_pred").alias("lang") if c == "lang" else c for c in columns])
