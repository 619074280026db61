"""Answers meet the latest question before them in a stream, by event time, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: State with timers and lists needs this store (part of Spark).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIRED = "key string, id long, at timestamp, title string"
#: Groups that the keys of a stream are dealt into.
BUCKETS = 64
#: What is kept of a post.
_POST = pa.schema([("key", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("asked", pa.bool_()), ("title", pa.string())])


def _packed(posts: pa.Table) -> tuple[bytes]:
    """Posts as one entry of a list state: entries are costly one by one, so a frame of rows is one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _POST) as out:
        out.write_table(posts)
    return (sink.getvalue().to_pybytes(),)


class _Pairing(StatefulProcessor):
    """Questions and answers of a bucket of keys. An answer is due when the watermark has reached its time, as then every
    question that can stand before it has come; whatever is due goes at once, so a bucket's state is read once a batch."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.posts = handle.getListState("posts", "rows binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, at: int) -> None:
        """One timer for each bucket, at the first moment when there is something to do."""
        if self.alarm.exists():
            known = self.alarm.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def _moment(self, us: np.ndarray, asked: np.ndarray) -> int:
        """When the first of these answers is due, or the first of these questions too old: the first whole millisecond."""
        return int((-(-us // 1000) + np.where(asked, self.keep + 1, 0)).min())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, moment = [], None
        for frame in rows:
            if not len(frame):
                continue
            asked, us = frame["is_question"].astype(bool).to_numpy(), frame["us"].astype("int64").to_numpy()
            columns = [frame["key"], us, frame["id"], asked, frame["title"]]
            new.append(_packed(pa.Table.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _POST, strict=True)], schema=_POST)))
            own = self._moment(us, asked)
            moment = own if moment is None else min(moment, own)
        if new:
            self.posts.appendList(new)
            self._wake(moment)
        yield pd.DataFrame(columns=["key", "id", "at", "title"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        posts = pa.concat_tables([pa.ipc.open_stream(row[0]).read_all() for row in self.posts.get()]).combine_chunks()
        name = posts.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        us, asked = posts.column("us").to_numpy(), posts.column("asked").to_numpy()
        # By key and time, questions before the answers of their time, and of those the one with the greatest id last.
        order = np.lexsort((posts.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(), ~asked, us, name))
        name, us, asked = name[order], us[order], asked[order]
        latest = np.maximum.accumulate(np.where(asked, np.arange(len(order)), -1))
        seen = (latest >= 0) & (name[latest] == name) & (us - us[latest] <= self.keep * 1000)
        due = ~asked & (us <= passed)
        title = posts.column("title").take(pa.array(order[latest[due]], mask=~seen[due]))
        own = posts.take(pa.array(order[due]))
        out = pd.DataFrame({"key": own.column("key").to_pandas(), "id": own.column("id").to_pandas(), "at": pd.to_datetime(us[due], unit="us"), "title": title.to_pandas()})
        # Of a key's questions that are in the past only the latest can still be seen, until it is too old.
        old = np.flatnonzero(asked & (us <= passed))
        last = old[name[old] != np.append(name[old[1:]], -1)] if len(old) else old
        left = us > passed
        left[last[passed - us[last] <= self.keep * 1000]] = True
        self.alarm.clear()
        if left.any():
            self.posts.put([_packed(posts.take(pa.array(order[left])))])
            self._wake(self._moment(us[left], asked[left]))
        else:
            self.posts.clear()
        yield out

    def close(self) -> None:
        pass


def pair_by_time(posts: DataFrame, late: str = "10 minutes", keep_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """key, id, at, title of every answer: the title of the latest question of its key at or before it, at most keep_seconds
    before it (else null, as a null title). Of questions at one time the one with the greatest id counts.

    posts: a stream of key, id, at (timestamp), is_question, title. Rows may come in any order as long as none is later than
    `late` behind the latest; later ones are dropped. An answer leaves when the watermark passes it, so the result is that of
    the batch over the same rows, however they are cut into batches. State is the answers that wait and, for each key, the
    questions of the watermark's delay and one before it; a key without either has none. Rows with a null key or time are
    left out. Start the query with started(), which picks the state store.

    Keys are dealt into `buckets` groups by their hash, and a batch reads the state of a bucket as a whole, once, when
    something in it is due: a call for each key costs far more than the rows of most keys. About 16,000 waiting rows a bucket
    are a good measure; a checkpoint keeps the number that it was begun with."""
    rows = posts.filter("key IS NOT NULL AND at IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), "at", F.unix_micros("at").alias("us"), F.coalesce("is_question", F.lit(False)).alias("is_question"), F.col("title").cast("string").alias("title"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(_Pairing(keep_seconds * 1000), PAIRED, "Append", "EventTime")


def started(stream: DataFrame, out: str, checkpoint: str):
    """Run what there is of a stream into a Parquet table, with the state store that timers need."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
