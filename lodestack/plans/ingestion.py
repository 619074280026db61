"""Queries of sources, sinks and streams over the driver's tables: dumps in file order, paged archives, session files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.plans.catalogue import _STRIP, query
from lodestack.session import scratch, size_of, table
from lodestack.sources import documents as sources
from lodestack.sources.file_sink import write_files
from lodestack.sources.paged import paged_source
from lodestack.streaming import pairing

#: What XML cannot hold.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def _escaped(text: Column, attribute: bool = False) -> Column:
    """Text for HTML, or for an attribute of XML, where white space has to be named to stay."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    for char, name in (('"', "&quot;"), ("\n", "&#xA;"), ("\r", "&#xD;"), ("\t", "&#x9;")) if attribute else ():
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _dump(spark, sf_dir: str) -> str:
    """Documents as a question-and-answer dump in order of their ids: every fourth is a question, the others answer the one
    that their id points to, which may stand behind them or be missing."""
    d, asked = F.col("doc_id"), F.col("doc_id") % 4 == 0
    parent = F.floor(d * 37 / 40) * 4 % 1000
    body = F.concat(F.lit("<p>"), _escaped(F.regexp_replace(F.coalesce("text", F.lit("")), _CONTROL, "")), F.lit("</p>"))
    attributes = F.concat(F.lit(' Body="'), _escaped(body, True), F.lit('"'), F.when(asked, F.concat(F.lit('\n    Title="'), _escaped(F.concat(F.lit("About <"), "source", F.lit(">")), True), F.lit('"'))).otherwise(F.concat(F.lit(' ParentId="'), parent.cast("string"), F.lit('" Score="7" CreationDate="2024-05-06T07:08"'))))
    line = F.concat(F.lit('  <row Id="'), d.cast("string"), F.lit('" PostTypeId="'), F.when(asked, "1").otherwise("2"), F.lit('"'), attributes, F.lit(" />"))
    path = scratch(spark, "dump")
    # Sorted ranges become files whose names are in the order of the ranges; there are more of them for larger tables.
    parts = max(4, size_of(spark, f"{sf_dir.rstrip('/')}/documents.parquet") >> 24)
    table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return path


_BODY = _STRIP.format(rf"regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g')")
_DUMP_SQL = f"""WITH posts AS (SELECT doc_id AS id, doc_id % 4 = 0 AS is_question, CAST(floor(doc_id * 37 / 40) AS BIGINT) * 4 % 1000 AS parent, 'About <' || source || '>' AS title, {_BODY} AS body, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id IS NOT NULL)"""


@query(_DUMP_SQL + " SELECT id, pos, is_question, md5(body) AS body FROM posts")
def dump_positions(spark, sf_dir):
    """Every post of a dump of several files with its place in it, read by as many tasks as there are blocks."""
    rows = sources.posts_xml(spark, _dump(spark, sf_dir))
    own = F.regexp_replace(sources.html_text("Body", "\n"), r"^\s+|\s+$", "")
    return rows.select(F.col("Id").cast("long").alias("id"), "pos", (F.col("PostTypeId") == "1").alias("is_question"), F.md5(own.cast("binary")).alias("body"))


@query(_DUMP_SQL + """, made AS (SELECT a.id, coalesce(q.title, 'An answer') AS title, a.body FROM posts a LEFT JOIN posts q ON q.is_question AND q.id = a.parent AND q.pos < a.pos WHERE NOT a.is_question AND a.body <> '')
SELECT id, title, md5('Q: ' || title || chr(10) || chr(10) || 'A:' || chr(10) || body) AS text FROM made""")
def dump_in_order(spark, sf_dir):
    """The answers of that dump as documents, each under the title of the question that stands before it."""
    made = sources.answers(sources.posts_xml(spark, _dump(spark, sf_dir)), "http://x/a", "An answer", in_order=True)
    return made.select(F.element_at(F.split("source_url", "/"), -1).cast("long").alias("id"), "title", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH pairs AS (SELECT a.event_id AS id, CAST(a.user_id AS VARCHAR) AS key, q.props AS title, row_number() OVER (PARTITION BY a.event_id ORDER BY q.ts DESC, q.event_id DESC) AS k
  FROM events a LEFT JOIN events q ON q.event_type = 'view' AND q.user_id = a.user_id AND q.ts <= a.ts AND q.ts >= a.ts - INTERVAL 6 HOUR WHERE a.event_type <> 'view' AND a.user_id IS NOT NULL AND a.ts IS NOT NULL)
SELECT id, key, title FROM pairs WHERE k = 1""")
def stream_pairs(spark, sf_dir):
    """Events as a stream: each one meets its user's latest view of the last six hours. A row at the end of time closes it."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("is_question"), F.col("props").alias("title"))
    root = scratch(spark, "pairs")
    end = events.agg(F.lit("").alias("key"), F.lit(-1).cast("long").alias("id"), (F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at"), F.lit(True).alias("is_question"), F.lit("").alias("title"))
    events.unionByName(end).write.parquet(f"{root}/in")
    stream = pairing.pair_by_time(spark.readStream.schema(events.schema).parquet(f"{root}/in"), keep_seconds=6 * 3600, buckets=max(pairing.BUCKETS, events.count() >> 14))
    pairing.started(stream, f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.schema(pairing.PAIRED).parquet(f"{root}/out").select("id", "key", "title")


def _saved_archive(spark, sf_dir: str, per_page: int) -> tuple[str, int]:
    """Documents as saved pages of a blog's REST archive, oldest first: folder, number of pages."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    name = F.col("doc_id").cast("string")
    post = F.struct(
        F.struct(F.concat(F.lit("Post "), name).alias("rendered")).alias("title"), F.concat(F.lit("http://b/"), name).alias("link"), F.concat((2019 + F.col("doc_id") % 8).cast("string"), F.lit("-02-03T10:00")).alias("date"),
        F.struct(F.concat(F.lit("<h2>Post &amp; "), name, F.lit("</h2><p>"), _escaped(F.coalesce("text", F.lit(""))), F.lit("</p>")).alias("rendered")).alias("content"),
    )
    pages = docs.groupBy(F.floor(F.col("doc_id") / per_page).alias("page")).agg(F.to_json(F.collect_list(post)).alias("text"))
    root = scratch(spark, "archive")
    write_files(pages.select(F.concat(F.lit("page-"), (F.col("page") + 1).cast("string"), F.lit(".json")).alias("name"), "text"), root)
    return root, (docs.agg(F.max("doc_id")).first()[0] or 0) // per_page + 1


def _fetcher(root: str):
    """A fetcher of saved pages; a page that was not saved is empty."""

    def fetch(page: int, per_page: int) -> tuple[int, list[dict]]:
        import json

        from lodestack.sources.file_sink import read_file

        text = read_file(f"{root}/page-{page}.json")
        return 200, json.loads(text) if text else []

    return fetch


@query(rf"""WITH items AS (SELECT doc_id AS i, {_STRIP.format("coalesce(text, '')")} AS body FROM documents WHERE doc_id IS NOT NULL)
SELECT 'http://b/' || i AS source_url, md5('Post ' || i || chr(10) || chr(10) || 'Post & ' || i || CASE WHEN body = '' THEN '' ELSE chr(10) || body END) AS text, CASE WHEN 2019 + i % 8 >= 2024 THEN 'current' ELSE 'dated_valid' END AS status FROM items""")
def archive_stream(spark, sf_dir):
    """Documents as pages of an archive that is read as a stream, twenty a page."""
    root, pages = _saved_archive(spark, sf_dir, 20)
    spark.dataSource.register(paged_source(_fetcher(root), "saved_archive", total=lambda: pages * 20))
    out = scratch(spark, "posts")
    stream = spark.readStream.format("saved_archive").option("per_page", "20").option("pages_per_task", "8").load()
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("page int, json string").parquet(f"{out}/rows")
    post = F.from_json("json", "title struct<rendered:string>, link string, date string, content struct<rendered:string>")
    items = rows.select(post.alias("p")).select(F.col("p.title.rendered").alias("title"), "p.link", F.col("p.date").alias("pub"), F.col("p.content.rendered").alias("html"))
    made = sources.blog_posts(items, "http://b", rest=True)
    return made.select("source_url", F.md5(F.col("text").cast("binary")).alias("text"), F.col("extra.version_status").alias("status"))


@query("""WITH lines AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS line FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS text FROM lines GROUP BY conv_id) SELECT 'session-' || conv_id || '.txt' AS name, md5(text) AS text FROM whole""")
def session_files(spark, sf_dir):
    """Each conversation as a file of its own, written by the tasks that hold it, and read back."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    root = scratch(spark, "sessions")
    write_files(whole.select(F.concat(F.lit("session-"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("name"), F.array_join("lines.line", "\n").alias("text")), root)
    return sources.files(spark, root, "session-*").select(F.col("rel").alias("name"), F.md5(F.col("text").cast("binary")).alias("text"))
