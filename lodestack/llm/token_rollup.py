"""Token counts kept as delta-maintained rollups.

A store holds, for each batch, its change rows (the ledger) and their signed sums by source, language and tokenizer version.
Totals are sums of committed deltas; nothing is recounted. Batches have numbers: the entry of a number is published by
creating one file that must not exist yet. Of two writers that start from the same state one gets the number; the other
works out its delta again, against what the first has committed. A batch that is known by name changes nothing."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, scratch, shuffle_parts

#: Where the public vocabularies lie on the driver, unless a caller names another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that the encoder's pattern may not get through; the separators 1C to 1F are no white space to it.
_BLANKS = re.compile(r"[^\S\x1c-\x1f]{1000,}")

LEDGER = T.StructType([
    T.StructField("doc_key", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("tokenizer", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("live", T.BooleanType()),
])
KEYS = ["source", "lang", "tokenizer"]
DELTA = T.StructType([*(LEDGER[k] for k in KEYS), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])


def encoding_of(ranks: bytes, pattern: str = PATTERN):
    """The encoding of a vocabulary file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("lodestack", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def vocabulary_bytes(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A vocabulary file (about 1 MB), read on the driver and broadcast."""
    with open(vocabulary, "rb") as lines:
        return spark.sparkContext.broadcast(lines.read())


def token_ids(encoding, text: str) -> list[int]:
    """Tokens of a text. The encoder gives up on very long runs of white space; such a run, less its last character where a
    word follows, is one piece by the pattern, and is encoded as such."""
    try:
        return encoding.encode_ordinary(text)
    except BaseException as failed:
        if type(failed).__name__ != "PanicException":
            raise
    ids, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()]) + encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def counted(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """keep columns and `tokens`, the length of each whole text in byte-level BPE tokens (0 for null and empty).

    Special tokens' strings are ordinary text. keep must not hold a column `tokens`. An empty table gives no rows, repeated
    rows are counted each."""
    if "tokens" in keep:
        raise ValueError("keep has a column `tokens` already")
    ranks = vocabulary_bytes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        for batch in batches:
            tokens = [len(token_ids(encoding, t.as_py())) for t in pc.fill_null(batch.column(text), "")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(tokens, pa.int64())], [*keep, "tokens"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("tokens", T.LongType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: the id, or for a row without one a digest of its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


class RollupStore:
    """A folder on a shared filesystem: log/<number> (one small file a batch), ledger/attempt=<id>/bucket=<n>,
    delta/attempt=<id>.

    Ledger rows lie in `buckets` folders by hash of their key, and a log entry names the buckets that its batch wrote: a
    batch reads earlier rows of its own keys' buckets only. More buckets suit larger ledgers; entries say by how many they
    were dealt, so writers may differ in this.

    A log entry appears whole and only if its number is free: through a hard link on local filesystems, elsewhere through a
    rename, which must not replace a file (as in HDFS). Data of attempts that no entry names are never read."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._entries: list[dict] = []

    def _path(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[dict]:
        """All entries in order; those seen before are not read again."""
        while True:
            path, fs = self._path(f"log/{len(self._entries):08d}")
            if not fs.exists(path):
                return list(self._entries)
            stream = fs.open(path)
            try:
                self._entries.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()

    def _publish(self, number: int, entry: dict) -> bool:
        """Create the entry of a number; False if another writer has it."""
        target, fs = self._path(f"log/{number:08d}")
        own, _ = self._path(f"try/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        stream = fs.create(own, False)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        if fs.getUri().getScheme() == "file":
            jvm = self.spark.sparkContext._jvm
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(target), local(own))
            except Exception as taken:
                if "FileAlreadyExistsException" not in str(taken):
                    raise
                return False
            finally:
                fs.delete(own, False)
            return True
        done = not fs.exists(target) and fs.rename(own, target)
        if not done:
            fs.delete(own, False)
        return bool(done)

    def committed(self) -> list[str]:
        """Names of the committed batches, in order of commit."""
        return [e["batch"] for e in self._log() if e["batch"] is not None]

    def _since_base(self, log: list[dict]) -> list[dict]:
        last = max((k for k, e in enumerate(log) if e["batch"] is None), default=0)
        return log[last:]

    def _read(self, kind: str, schema: T.StructType, log: list[dict], near: dict[int, set[int]] | None = None) -> DataFrame:
        """Rows of the batches since the last compaction, with their turn `at`; one scan, however many batches there are.
        near: the buckets to read, by the number that a batch was dealt by."""
        own = self._since_base(log)
        places = []
        for e in own:
            whole = f"{self.root}/{kind}/attempt={e[kind]}"
            held = None if near is None else e["held"]
            places += [whole] if held is None else [f"{whole}/bucket={n}" for n in held if n in near[e["buckets"]]]
        if not places:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("at", T.IntegerType())]))
        parts = [T.StructField("attempt", T.StringType()), *([T.StructField("bucket", T.IntegerType())] if kind == "ledger" else [])]
        rows = self.spark.read.schema(T.StructType([*schema.fields, *parts])).option("basePath", f"{self.root}/{kind}").parquet(*places)
        turns = self.spark.createDataFrame([(e[kind], k) for k, e in enumerate(own)], "attempt string, at int")  # a row for each batch since the last compaction
        return rows.join(F.broadcast(turns), "attempt").select(*schema.names, "at")

    def _current(self, log: list[dict], touched: DataFrame | None = None) -> DataFrame:
        """The latest ledger row of each document and tokenizer, or of the touched ones (k, t)."""
        near = None
        if touched is not None:  # at most `buckets` numbers
            near = {n: {r[0] for r in touched.select(bucket_of("k", n)).distinct().collect()} for n in {e["buckets"] for e in self._since_base(log)}}
        rows = self._read("ledger", LEDGER, log, near)
        if touched is not None:
            rows = rows.join(touched, rows["doc_key"].eqNullSafe(touched["k"]) & rows["tokenizer"].eqNullSafe(touched["t"]), "left_semi")
        own = [c for c in LEDGER.names if c not in ("doc_key", "tokenizer")]
        latest = rows.groupBy("doc_key", "tokenizer").agg(F.max_by(F.struct(*own), "at").alias("x"))
        return latest.select(*[F.col(c) if c in ("doc_key", "tokenizer") else F.col(f"x.{c}") for c in LEDGER.names])

    def current(self) -> DataFrame:
        return self._current(self._log())

    def _write_delta(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType) for f in DELTA.fields]).write.parquet(f"{self.root}/delta/attempt={attempt}")
        return attempt

    def _write_ledger(self, rows: DataFrame) -> dict:
        """Rows by bucket; what a log entry says of them. A bucket of a large batch is dealt over several tasks, so that
        tasks stay as small as the session's shuffles are and each writes few files."""
        attempt, parts = uuid.uuid4().hex, shuffle_parts(self.spark)
        path = f"{self.root}/ledger/attempt={attempt}"
        slot = F.pmod(F.xxhash64("doc_key", "tokenizer"), F.lit(max(1, parts // self.buckets)))
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields], bucket_of("doc_key", self.buckets).alias("bucket"))
        dealt.repartition(parts, "bucket", slot).write.partitionBy("bucket").parquet(path)
        # The names of at most `buckets` folders.
        held = self.spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).select("bucket").distinct().collect()
        return {"ledger": attempt, "buckets": self.buckets, "held": sorted(r[0] for r in held)}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of LEDGER rows (live false: a deletion); False if it was committed before.

        changes may lack doc_key; the id as text takes its place. Within a batch the greatest row of a key and tokenizer
        counts (live over deleted, then more tokens, then source and language), so repeated rows count once, and of rows that
        differ one decides. A null key is a key like any other, null tokens are 0, other columns are not read. A deletion of
        an unknown document changes nothing. An empty batch commits with no effect. A batch that failed half-way leaves data
        that no entry names, and is written anew."""
        if any(e["batch"] == batch for e in self._log()):
            return False
        if "doc_key" not in changes.columns:
            changes = changes.withColumn("doc_key", F.col("doc_id").cast("string"))
        ranked = F.struct(F.coalesce("live", F.lit(True)).alias("live"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang", F.col("doc_id").cast("long").alias("doc_id"))
        latest = changes.groupBy("doc_key", "tokenizer").agg(F.max(ranked).alias("x")).select("doc_key", "tokenizer", "x.*")
        written = self._write_ledger(latest)
        path = f"{self.root}/ledger/attempt={written['ledger']}"
        new = self.spark.read.schema(LEDGER).parquet(path)
        while True:
            log = self._log()
            if any(e["batch"] == batch for e in log):
                dropped(self.spark, path)
                return False
            signed = new.filter("live").select(*KEYS, F.lit(1).alias("sign"), "tokens")
            if log:
                old = self._current(log, new.select(F.col("doc_key").alias("k"), F.col("tokenizer").alias("t"))).filter("live")
                signed = signed.unionByName(old.select(*KEYS, F.lit(-1).alias("sign"), "tokens"))
            sums = signed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
            delta = self._write_delta(sums)
            if self._publish(len(log), {"batch": batch, **written, "delta": delta}):
                return True
            dropped(self.spark, f"{self.root}/delta/attempt={delta}")

    def compact(self) -> None:
        """Publish the present state as one entry, from which reading begins; totals and names of batches stay as they are."""
        while log := self._log():
            written, delta = self._write_ledger(self._current(log).filter("live")), self._write_delta(self._sums(log))
            if self._publish(len(log), {"batch": None, **written, "delta": delta}):
                return
            dropped(self.spark, f"{self.root}/ledger/attempt={written['ledger']}")
            dropped(self.spark, f"{self.root}/delta/attempt={delta}")

    def _sums(self, log: list[dict]) -> DataFrame:
        sums = self._read("delta", DELTA, log).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the committed batches; groups that fell to nothing are left out."""
        return self._sums(self._log())


def op1_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals after three deliveries: all documents, the same again (no effect), and a revision by labels.

    The revision deletes toxic documents and moves those of quality 0 to the language `low`; of several labels of a document
    one toxic one and one of quality 0 are enough. Rows without an id are told apart by their texts and have no labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(doc_key().alias("doc_key"), "doc_id", "source", "lang", "text")
    store = RollupStore(spark, scratch(spark, "token-rollup"))
    counts = counted(docs, ["doc_key", "doc_id", "source", "lang"])
    load = counts.select("doc_key", "doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), "tokens", F.lit(True).alias("live"))
    store.commit("load", load)
    store.commit("load", load)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    judged = store.current().join(labels.filter("toxic = 1 OR quality = 0").hint("merge"), "doc_id")
    low = F.when(F.coalesce(F.col("quality") == 0, F.lit(False)), F.lit("low")).otherwise(F.col("lang"))
    store.commit("labels", judged.select("doc_key", "doc_id", "source", low.alias("lang"), "tokenizer", "tokens", (F.coalesce(F.col("toxic"), F.lit(0)) != 1).alias("live")))
    return store.totals()
