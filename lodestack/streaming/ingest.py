"""Incremental building: new documents are chunked as they arrive, and answers meet earlier questions in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.chunking import chunk_markdown


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the chunks of a stream of documents (doc_id, text) to a Parquet table, each document once."""
    stream = chunk_markdown(docs, **options)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


PAIRED = "id long, parent long, title string"


def _pair(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    title = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values("pos")
    out = []
    for row in rows.itertuples():
        if row.is_question:
            title = row.title
        else:
            out.append((row.id, key[0], title or "untitled"))
    if title is not None:
        state.update((title,))
    yield pd.DataFrame(out, columns=["id", "parent", "title"])


def pair_stream(posts: DataFrame) -> DataFrame:
    """Answers with the latest title of their question that arrived before them, else `untitled`; never revised.

    posts: a stream of (pos, id, is_question, parent, title), where a question's parent is its own id. The state is one title
    for each question."""
    return posts.groupBy("parent").applyInPandasWithState(_pair, PAIRED, "title string", "append", GroupStateTimeout.NoTimeout)
