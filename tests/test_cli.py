"""The command line from sources to evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack import cli
from lodestack.config import load_settings
from lodestack.operators import index, retrieval
from lodestack.sources import registry

TEXTS = ["Rendering with the engine and samples. ", "Meshes have vertices, edges and faces. ", "Keyframes animate values over time. "]


def test_build_search_eval(spark, tmp_path, capsys):
    docs = [
        {"id": f"d{i}", "text": f"# Page {i}\n\n" + t * 6, "source_type": "manual", "source_url": f"http://x/{i}", "title": f"Page {i}", "version": "5.1" if i else "5.0"}
        for i, t in enumerate(TEXTS)
    ]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, docs)))
    root = str(tmp_path / "index")
    cli.main(["build-chunks", str(tmp_path / "corpus.jsonl"), str(tmp_path / "chunks")])
    calls = []
    generate = lambda d, c: calls.append(len(c)) or [f"About {x[:8]}." for x in d]
    assert tuple(cli.build_context(spark, str(tmp_path / "corpus.jsonl"), str(tmp_path / "chunks"), generate, limit=2)) == (2, 3)
    assert {r.doc_id: r.context for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {"d0": "About # Page 0.", "d1": "About # Page 1.", "d2": ""}
    cli.main(["build-index", str(tmp_path / "chunks"), root])
    cli.main(["search", root, "edges of meshes", "--k", "2"])
    assert "1. [" in capsys.readouterr().out
    found = cli.search_tool(spark, root, "edges of meshes", 2, version="5.1")
    assert found[0]["title"] == "Page 1" and set(found[0]) == {*retrieval.HIT_FIELDS, "score"} and len(found) == 2
    with pytest.raises(ValueError):
        cli.search_tool(spark, root, "x", source_type="nothing")
    with pytest.raises(ValueError):
        cli.search(spark, root, spark.createDataFrame([(1, "x")], "query_id long, query string"), way="hybrid+rerank")
    labelled = [{"query": "animate keyframes", "type": "manual", "expect": ["Page 2"]}, {"query": "engine samples", "type": "manual", "expect": ["page 0"], "filter": {"version": "5.1"}}, {"query": "faces", "type": "api", "expect": ["http://x/1"]}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, labelled)))
    # A reranker that puts the longest question's words last: every text scores by what it shares with the question.
    score = lambda q, t: F.size(F.array_intersect(F.split(F.lower(q), " "), F.split(F.lower(t), "[^a-z]+"))).cast("double")
    quality, missed = cli.evaluate(spark, root, str(tmp_path / "q.jsonl"), score=score)
    got = {(r.way, r.type): (r.hit_at_k, r.n) for r in quality.collect()}
    assert {way for way, _ in got} == set(cli.CONFIGURATIONS) and got["hybrid", "(all)"] == (2 / 3, 3) and got["hybrid+rerank", "api"] == (1.0, 1) and got["hybrid+symbol", "manual"] == (0.5, 2)
    assert {(r.way, r.query) for r in missed.collect()} == {(way, "engine samples") for way in cli.CONFIGURATIONS}


def test_search_by_postings_is_search_by_table(spark, tmp_path):
    rows = [(f"c{i}", f"d{i % 7}", "api" if i % 3 else "manual", " ".join(TEXTS[j % 3] for j in range(i % 5 + 1)) + f" word{i % 11}", None) for i in range(60)]
    chunks = spark.createDataFrame([*rows, ("e", "d", "api", "", None)], "id string, doc_id string, source_type string, text string, context string")
    index.build_table(chunks, retrieval.hashed_encoder(16), str(tmp_path))
    queries = spark.createDataFrame([(1, "the engine word3"), (2, "Meshes, meshes! word4 nowhere"), (3, None), (4, "zzz"), (5, "values over time")], "query_id long, query string")
    table = index.open_table(spark, str(tmp_path)).withColumnRenamed("doc_id", "parent")
    for where in (None, F.col("source_type") == "api"):
        plain = {(r.query_id, r.doc_id): (r["rank"], round(r.score, 9)) for r in retrieval.bm25(queries, table, 12, where, doc_id="id", text="embed_text", block=2).collect()}
        got = {(r.query_id, r.id): (r["rank"], round(r.score, 9)) for r in index.lexical(spark, str(tmp_path), queries, 12, where).collect()}
        assert got == plain and {q for q, _ in got} == {1, 2, 5}
    posts = index.open_table(spark, str(tmp_path), "postings")
    many = {(r.query_id, r.doc_id): r["rank"] for r in retrieval.bm25_of_postings(queries, posts, index.open_table(spark, str(tmp_path), "terms"), *index.open_table(spark, str(tmp_path), "stats").first(), 12, most=2).collect()}
    assert many == {k: v[0] for k, v in {(r.query_id, r.doc_id): (r["rank"],) for r in retrieval.bm25(queries, table, 12, doc_id="id", text="embed_text").collect()}.items()}
    plan = index.lexical(spark, str(tmp_path), queries.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_corpus_of_registered_sources(spark, tmp_path, capsys):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("notes/5.1/index.md", "# Overview\n\nnews")
    put("api/ops/m.html", '<dl class="py function"><dt id="m.f">f(x)</dt><dd><p>Does f.</p></dd></dl>')
    put("manual/a/page.rst", "Page\n====\n\n" + "Some :ref:`words <x>` on it. " * 10)
    put("manual/short.rst", "Page\n====\n")
    put("handbook/guide.md", "# Guide\n\n" + "text " * 40)
    put("lib/tool.py", "def tool():\n    return 1\n")
    put("curated/traps.md", "# Traps\n\nmind them")
    put("blog/p.json", json.dumps([{"title": {"rendered": "T"}, "link": "http://t", "date": "2025-02-03T00", "content": {"rendered": "<p>b</p>"}}]))
    put("addons/one/a.py", "x = 1\n")
    settings = {
        "version": "5.1", "paths": {"corpus": "out/corpus.jsonl", "chunks": "out/chunks", "index": "out/index"},
        "sources": {
            "release_notes": {"dir": "notes", "versions": ["5.1"], "base_url": "http://n", "product": "Prod"}, "api": {"dir": "api", "base_url": "http://api"}, "manual": {"dir": "manual", "base_url": "http://m"},
            "dev_docs": {"dir": "handbook", "base_url": "http://h"}, "code": {"dir": "lib", "base_url": "http://c"}, "gotchas": {"dir": "curated", "base_url": "http://g"},
            "dev_blog": {"dir": "blog", "base_url": "http://b"}, "addons": {"dir": "addons", "list": [{"name": "one", "license": "mit"}]},
        },
    }
    put("settings.yaml", json.dumps(settings))
    cli.main(["build-all", str(tmp_path / "settings.yaml")])
    docs = {(r.source_type, r.source_url): r for r in spark.read.schema(cli.DOCUMENT).json(str(tmp_path / "out/corpus.jsonl")).collect()}
    assert set(docs) == {("release_notes", "http://n/5.1/"), ("api", "http://api/ops/m.html#m.f"), ("manual", "http://m/a/page.html"), ("dev_docs", "http://h/guide/"), ("code", "http://c/tool.py"), ("gotchas", "http://g/traps.md")}
    assert docs["release_notes", "http://n/5.1/"].title == "Prod 5.1 Release Notes — Overview" and docs["api", "http://api/ops/m.html#m.f"].text == "f(x)\n\nDoes f." and docs["manual", "http://m/a/page.html"].text.startswith("# Page\n\nSome words on it.")
    out = capsys.readouterr().out
    assert "all" in out and "records" in out
    assert {r["what"]: r.docs for r in cli.corpus_report(spark.read.schema(cli.DOCUMENT).json(str(tmp_path / "out/corpus.jsonl"))).filter("what <> 'type'").collect()} == {"all": 6, "version": 6}
    assert cli.search_tool(spark, str(tmp_path / "out/index"), "tool", 3, "code")[0]["symbol"] == "tool"
    got = load_settings(str(tmp_path / "settings.yaml"))
    assert {(r.source, r.version_status, r.docs) for r in cli.gather(spark, got, str(tmp_path / "creative"), ["dev_blog", "addons"]).collect()} == {("addons", "current", 1), ("dev_blog", "current", 1)}
    with pytest.raises(ValueError, match="unknown sources"):
        registry.read(spark, got, ["dev_blog"])


def test_scene_eval_writes_its_files(spark, tmp_path, capsys):
    (tmp_path / "tasks.jsonl").write_text(json.dumps({"id": "t", "prompt": "p", "success_hints": ["AgX"]}))
    text = cli.scene_eval(spark, str(tmp_path / "tasks.jsonl"), 2, str(tmp_path / "out"))
    assert "directional only" in text and (tmp_path / "out" / "report.md").read_text() == text
    assert len(json.loads((tmp_path / "out" / "summary.json").read_text())) == 22
    assert sorted(p.name for p in (tmp_path / "out" / "sessions").iterdir()) == ["t_off_0.json", "t_off_1.json", "t_on_0.json", "t_on_1.json"]
    cli.main(["show-session", str(tmp_path / "out" / "sessions" / "t_off_1.json"), "--code-lines", "1"])
    shown = capsys.readouterr().out
    assert shown.startswith("## t (RAG-off, run 1, model demo)\nbrief concepts: AgX\n") and "glare_type_attribute" in shown
    assert cli.show_session(spark, str(tmp_path / "out" / "sessions")).count("summary: ") == 4


def overlap(queries, texts):
    return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in zip(queries, texts, strict=True)]


def about(documents, chunks):
    return [f"of {len(d)}" for d in documents]


def test_commands_with_models_by_name(spark, tmp_path, capsys):
    texts = ["# Render\n\nengine samples and light " * 12, "# Animate\n\nkeyframes and curves " * 12]
    docs = [{"id": f"d{i}", "text": t, "source_type": "manual", "source_url": f"u{i}", "title": f"Page {i}", "version": "5.1", "extra": None} for i, t in enumerate(texts)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "keyframes curves", "type": "manual", "expect": ["Page 1"]}))
    settings = {"paths": {"corpus": "corpus.jsonl", "chunks": "chunks", "index": "index"}, "contextual": {"enabled": False, "scope": ["manual"]}}
    for name, flag in (("off", False), ("on", True)):
        (tmp_path / f"{name}.yaml").write_text(json.dumps(settings | {"contextual": {"enabled": flag, "scope": ["manual"]}}))
    cli.main(["build-chunks", str(tmp_path / "corpus.jsonl"), str(tmp_path / "chunks")])
    cli.main(["build-context", str(tmp_path / "off.yaml"), "tests.test_cli:about"])
    assert spark.read.parquet(str(tmp_path / "chunks")).filter("context <> ''").count() == 0
    cli.main(["build-context", str(tmp_path / "on.yaml"), "tests.test_cli:about"])
    rows = spark.read.parquet(str(tmp_path / "chunks")).collect()
    assert rows and {r.context for r in rows} == {f"of {len(t)}" for t in texts}
    cli.main(["build-index", str(tmp_path / "chunks"), str(tmp_path / "index")])
    cli.main(["eval", str(tmp_path / "index"), str(tmp_path / "q.jsonl"), "--reranker", "tests.test_cli:overlap"])
    cli.main(["verify", str(tmp_path / "index"), "keyframes and curves"])
    out = capsys.readouterr().out
    assert "nothing was done" in out and "chunks have a context" in out and "hybrid+rerank" in out and "tool and SQL agree" in out
    with pytest.raises(ValueError, match="module:name"):
        cli.named("nothing")
