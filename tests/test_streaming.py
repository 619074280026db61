"""Streams give what the same rows give in one batch."""

from lodestack.operators.chunking import chunk_markdown
from lodestack.streaming import ingest


def test_chunk_stream_is_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# T{i}\n\n" + "some prose in here. " * 30) for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = sorted(r.id for r in chunk_markdown(docs).collect())
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_answers_see_earlier_questions_only(spark, tmp_path):
    kind = "pos long, id long, is_question boolean, parent long, title string"
    first = [(1, 10, True, 10, "ten"), (2, 21, False, 10, None), (3, 22, False, 30, None)]
    later = [(4, 30, True, 30, "thirty"), (5, 23, False, 30, None), (6, 24, False, 10, None)]
    for k, rows in enumerate((first, later)):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.pair_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.id: r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {21: "ten", 22: "untitled", 23: "thirty", 24: "ten"}
