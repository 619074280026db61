"""Dumps in file order, stateful pairing, archives as streams, files that appear together."""

import datetime as dt
import json
import random

import pytest

from lodestack.config import Settings
from lodestack.plans.every import ORACLES, QUERIES
from lodestack.sources import documents as sources
from lodestack.sources import registry
from lodestack.sources.file_sink import read_file, write_files
from lodestack.sources.paged import paged_source
from lodestack.streaming import pairing

ROW = '  <row Id="{}" PostTypeId="{}"{}\n   Body="&lt;p&gt;text {} a>b &#xA;&quot;x&quot;&lt;/p&gt;" />\n'


def dump(n, seed=3):
    """A Posts.xml whose questions may repeat an id or stand behind their answers, and what a sequential reader makes of it."""
    rng, lines, known, want = random.Random(seed), [], {}, {}
    for i in range(n):
        if rng.random() < 0.3:
            of = rng.randrange(40)
            lines.append(ROW.format(of, 1, f' Title="Title {i} &lt;{of}&gt;"', i))
            known[str(of)] = f"Title {i} <{of}>"
        else:
            of = str(rng.randrange(40))
            lines.append(ROW.format(1000 + i, 2, f""" ParentId='{of}' Score="9" CreationDate="2024-01-01" """, i))
            want[f"http://x/{1000 + i}"] = known.get(of, "An answer")
    return '<?xml version="1.0" encoding="utf-8"?>\n<posts>\n' + "".join(lines) + "</posts>\n", want


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


def test_answers_in_file_order_whatever_the_blocks(spark, tmp_path, small_blocks):
    text, want = dump(800)
    (tmp_path / "Posts.xml").write_text(text)
    for blocks in (1, 4, 16):
        small_blocks(-(-len(text) // blocks))
        posts = sources.posts_xml(spark, str(tmp_path / "Posts.xml"))
        rows = posts.select("pos", "Body").collect()
        assert sorted(r.pos for r in rows) == list(range(800)) and all(f"<p>text {r.pos} a>b \n\"x\"</p>" == r.Body for r in rows)
        got = {r.source_url: r.title for r in sources.answers(posts, "http://x", "An answer", in_order=True).collect()}
        assert got == want


def test_dump_source_by_settings(spark, tmp_path):
    text, want = dump(60)
    (tmp_path / "Posts.xml").write_text(text)
    made = lambda own: registry.read(spark, Settings({"sources": {"stackexchange": own}}, tmp_path), ["stackexchange"], registry.CREATIVE)
    got = made({"posts_xml": "Posts.xml", "base_url": "http://x", "default_title": "An answer"})
    assert {r.source_url: r.title for r in got.collect()} == want
    with pytest.raises(RuntimeError, match="posts_xml is not set"):
        made({"base_url": "http://x"})


def test_bridge_source(spark, tmp_path):
    (tmp_path / "bridge" / "src").mkdir(parents=True)
    (tmp_path / "bridge" / "src" / "server.py").write_text("x = 1\n")
    (tmp_path / "bridge" / "empty.py").write_text(" \n")
    own = Settings({"sources": {"blendermcp": {"dir": "bridge", "base_url": "http://w/blob/main/"}}}, tmp_path)
    got = registry.read(spark, own).collect()
    assert [(r.source_type, r.source_url, r.title, r.extra.path) for r in got] == [("blendermcp", "http://w/blob/main/src/server.py", "src/server.py", "src/server.py")]


POST = "key string, id long, at timestamp, is_question boolean, title string"
START = dt.datetime(2024, 1, 1)


def posts(n=500, seed=1):
    """Posts at irregular times, out of order by less than ten minutes."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), i, START + dt.timedelta(seconds=i * 20, microseconds=rng.randrange(3) * 400), rng.random() < 0.25, rng.choice([f"q{i}", None])) for i in range(n)]
    rows += [("a", n, rows[40][2], True, "same time"), ("b", n + 1, rows[77][2], False, None), rows[9]]
    rows.sort(key=lambda r: r[2].timestamp() + rng.random() * 500)
    return rows


def paired(rows, keep):
    want = []
    for key, i, at, asked, _ in rows:
        if key is None or asked:
            continue
        seen = [(q[2], q[1], q[4]) for q in rows if q[3] and q[0] == key and q[2] <= at and (at - q[2]).total_seconds() <= keep]
        want.append((key, i, at, max(seen, key=lambda q: q[:2])[2] if seen else None))
    return sorted(want, key=str)


def run_pairs(spark, folder, batches, keep):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, POST).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = pairing.pair_by_time(spark.readStream.schema(POST).parquet(f"{folder}/in"), "10 minutes", keep)
        query = pairing.started(stream, f"{folder}/out", f"{folder}/log")
        query.awaitTermination()
        yield [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


END = [("end", -1, START + dt.timedelta(days=9), True, None)]


def test_pairs_by_time_are_the_batch_with_bounded_state(spark, tmp_path):
    rows = posts()
    cut = len(rows) // 10 + 1
    ten = [rows[k : k + cut] for k in range(0, len(rows), cut)]
    sizes = list(run_pairs(spark, str(tmp_path / "ten"), [*ten, END], 900))  # each batch is a query of its own: restarts in between
    read = lambda name: sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / name / "out")).collect()), key=str)
    assert read("ten") == paired(rows, 900)
    # Three keys with a few lists each, however long the stream; only the closing row is left at the end.
    assert max(max(s) for s in sizes) <= 3 * 6 + 2 and sizes[-1][-1] <= 2
    assert max(sizes[8]) <= max(sizes[2]) + 4
    list(run_pairs(spark, str(tmp_path / "one"), [rows, END], 900))
    assert read("one") == read("ten")


def test_archive_stream_reads_no_page_twice(spark, tmp_path):
    log, held = str(tmp_path / "fetched"), str(tmp_path / "size")

    def fetch(page, per_page):
        with open(log, "a") as f:
            f.write(f"{page}\n")
        with open(held) as f:
            n = int(f.read())
        return 200, [{"id": k} for k in range((page - 1) * per_page, min(n, page * per_page))]

    def total():
        with open(held) as f:
            return int(f.read())

    def grown(n):
        (tmp_path / "size").write_text(str(n))
        stream = spark.readStream.format("grown_archive").option("per_page", "5").option("pages_per_task", "2").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r.json)["id"] for r in spark.read.schema("page int, json string").parquet(str(tmp_path / "out")).collect())

    spark.dataSource.register(paged_source(fetch, "grown_archive", total))
    assert grown(23) == list(range(20))
    assert grown(24) == list(range(20)) and grown(41) == list(range(40))
    pages = [int(x) for x in open(log).read().split()]
    assert sorted(pages) == list(range(1, 9))
    assert sorted(json.loads(r.json)["id"] for r in spark.read.format("grown_archive").option("per_page", "5").load().collect()) == list(range(41))
    with pytest.raises(Exception, match="known size"):
        spark.dataSource.register(paged_source(fetch, "endless"))
        spark.readStream.format("endless").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "x")).start().awaitTermination()


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.txt", f"text {i}\n" if i else None) for i in range(20)], "name string, text string").repartition(6)
    out = tmp_path / "out"
    write_files(rows, str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(f"f{i}.txt" for i in range(20))
    assert (out / "f7.txt").read_text() == "text 7\n" and (out / "f0.txt").read_text() == "" and read_file(f"file://{out}/f3.txt") == "text 3\n" and read_file(f"{out}/none") is None
    (out / "other").write_text("stays")
    write_files(rows.limit(1), str(out))
    with pytest.raises(Exception, match="there twice"):
        write_files(rows.limit(3), str(out), "append")
    with pytest.raises(Exception, match="there twice"):
        write_files(rows.unionByName(rows), str(tmp_path / "again"))
    bad = rows.selectExpr("CASE WHEN name = 'f9.txt' THEN '../x' ELSE name END AS name", "text")
    with pytest.raises(Exception, match="no name of a file"):
        write_files(bad, str(tmp_path / "bad"))
    assert sorted(p.name for p in out.iterdir()) == sorted(["other", *[f"f{i}.txt" for i in range(20)]])
    assert not any((tmp_path / n).exists() and list((tmp_path / n).iterdir()) for n in ("again", "bad"))


def test_queries_are_registered():
    assert {"dump_positions", "dump_in_order", "stream_pairs", "archive_stream", "session_files"} <= set(QUERIES) & set(ORACLES)
