"""Chunking, search, evaluation, sessions and sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack.functions import html, text
from lodestack.operators import ablation, chunking, evaluation, index, retrieval, sessions
from lodestack.sources import documents as sources
from lodestack.sources import jsonl


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def test_stable_id_is_joined_sha256(spark):
    import hashlib

    got = spark.range(1).select(text.stable_id(F.lit("a"), F.lit(None), F.lit(3)).alias("r")).first()["r"]
    assert got == hashlib.sha256(b"a\x1f\x1f3").hexdigest()[:16]


def test_sections_keep_the_trail(spark):
    md = "intro\n# Top\n\ntext\n## A\nbody a\n### A1\nbody a1\n## B\n\n# \nlast\r\nline"
    got = [(list(s["path"]), s["body"]) for s in one(spark, chunking.sections, md)]
    assert got == [([], "intro"), (["Top"], "text"), (["Top", "A"], "body a"), (["Top", "A", "A1"], "body a1"), ([""], "last\nline")]
    assert one(spark, chunking.sections, "####### seven\n#no") [0]["body"] == "####### seven\n#no"


def plain_hard_split(t, most):
    out = []
    while len(t) > most:
        at = t.rfind(" ", 0, most)
        at = at if at > 0 else most
        out.append(t[:at].strip())
        t = t[at:].strip()
    return out + ([t] if t else [])


def test_hard_split_cuts_at_blanks(spark):
    for t in ("aa bb cc dd", "a" * 25, "a" * 9 + " " + "b" * 30 + " c", "", "word " * 40):
        assert one(spark, lambda c: chunking.hard_split(c, 10), t) == plain_hard_split(t, 10)


def test_paragraphs_are_packed_with_overlap(spark):
    body = "\n\n".join(f"paragraph number {i} with some words" for i in range(60))
    rows = spark.createDataFrame([(["A", "B"], body)], "p array<string>, b string")
    got = rows.select(chunking.pack_section(F.col("p"), F.col("b"), 200, 20, 10).alias("r")).first()["r"]
    assert len(got) > 10 and all(c.startswith("A > B\n\n") and len(c) <= 240 for c in got)
    tail = got[0][-20:].lstrip()
    assert got[1].startswith("A > B\n\n" + tail)
    short = spark.createDataFrame([([], "tiny")], "p array<string>, b string")
    assert short.select(chunking.pack_section(F.col("p"), F.col("b"), 200, 20, 10).alias("r")).first()["r"] == []


def test_code_windows_lose_nothing(spark):
    code = "".join(f"x{i} = {i}\n" for i in range(2000)) + "y" * 950 + "\n"
    got = one(spark, lambda c: chunking.code_windows(c, 300), code)
    assert "".join(got) == code and max(map(len, got)) <= 300
    assert one(spark, lambda c: chunking.code_windows(c, 300), "short\n") == ["short\n"]


def test_python_is_cut_by_symbol(spark):
    source = 'import os\n# note\nX = 1\n\n@deco\ndef add_cube():\n    return "é"\n\nclass Panel:\n    a = 1\n'
    got = [(s["name"], s["code"], s["line"]) for s in one(spark, chunking.python_symbols, source)]
    assert got == [("<module>", "import os\n# note\nX = 1", 1), ("add_cube", '@deco\ndef add_cube():\n    return "é"', 5), ("Panel", "class Panel:\n    a = 1", 9)]
    broken = "import os\n\ndef broken(:\n    pass\n\n@deco(\n)\nasync def good(\n    a,\n):\n    return [\n        1\n    ]\n\n\nclass C:\n\tx = 1\nprint 'old'\n"
    got = [(s["name"], s["code"], s["line"]) for s in one(spark, chunking.python_symbols, broken)]
    assert got == [("<module>", "import os\n@deco(\n)\nprint 'old'", 1), ("broken", "def broken(:\n    pass", 3), ("good", "async def good(\n    a,\n):\n    return [\n        1\n    ]", 8), ("C", "class C:\n\tx = 1", 16)]
    assert [s["name"] for s in one(spark, chunking.python_symbols, "print 'old'")] == ["<module>"] and one(spark, chunking.python_symbols, "  \n") == []
    docs = spark.createDataFrame([("d", "def big():\n" + "    x = 1\n" * 3000)], "doc_id string, text string")
    assert {r.symbol.split("#")[0] for r in chunking.chunk_python(docs, 1000).collect()} == {"big"}


def test_chunks_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "manual" if i % 3 else "api", "# T\n\n" + ("some prose here. " * (i * 9))) for i in range(30)], "doc_id long, source_type string, text string")
    ids = [sorted(r.id for r in chunking.chunk_corpus(docs.repartition(n)).select("id").collect()) for n in (1, 4, 16)]
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) > 30


def test_terse_api_entries_stay(spark):
    docs = spark.createDataFrame([("d", "api", "bpy.x")], "doc_id string, source_type string, text string")
    assert chunking.chunk_corpus(docs).count() == 1


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, id string, rank int")
    got = [(r.id, round(r.score, 6)) for r in retrieval.fuse([a, b]).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]


def test_symbol_names_rank_full_matches_first(spark):
    rows = [(1, "a", "select or deselect all objects", "lib.ops.object.select_all", "", 2), (1, "b", "select or deselect all objects", "lib.ops.object.select_random", "", 1), (1, "c", "select or deselect all objects", "", "Nothing", 3)]
    got = retrieval.symbol_rank(spark.createDataFrame(rows, "query_id long, id string, query string, symbol string, title string, first_seen int")).orderBy("symbol_rank").collect()
    assert [(r.id, r.symbol_score) for r in got] == [("a", 1.0), ("b", 0.5)]


def test_where_is_safe(spark):
    assert retrieval.build_where() is None and retrieval.where_text() is None
    assert retrieval.where_text("api", "5.1") == "source_type = 'api' AND version = '5.1'"
    assert retrieval.where_text("o'x") == "source_type = 'o''x'"


def test_rerank_orders_and_cuts(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, 0.9000001)], "query_id long, id string, rank int, s double")
    assert [r.id for r in retrieval.rerank(hits, F.col("s"), 2).orderBy("new_rank").collect()] == ["b", "c"]
    assert retrieval.rerank(hits.limit(0), F.col("s"), 2).count() == 0


def test_bm25_and_knn_edge_cases(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "beta beta gamma")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Beta beta"), (2, "nothing"), (3, None)], "query_id long, query string")
    assert {(r.query_id, r.doc_id) for r in retrieval.bm25(queries, docs).collect()} == {(1, 1), (1, 4)}
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<double>")
    assert [(r.id, r.score) for r in retrieval.knn(asked, rows, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert retrieval.knn(asked, rows.limit(0), 2).count() == 0 and retrieval.knn(asked.limit(0), rows, 2).count() == 0
    named = spark.createDataFrame([(i, [float(i % 4), 1.0], g) for i, g in enumerate(["a", "b", None, "a", "c", "b", "a"])], "id long, vector array<double>, g string")
    asked = spark.createDataFrame([("x", [0.0, 1.0], "a"), ("y", [0.0, 1.0], None), ("z", [1.0, 1.0], "gone"), ("w", None, "a")], "query_id string, vector array<double>, g string")
    got = {}
    for r in retrieval.knn(asked, named, 10, group="g", block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {"x": [0, 6, 3], "y": [0, 4, 1, 5, 2, 6, 3]}


def test_metrics_are_those_by_hand(spark):
    asked = spark.createDataFrame([(1, "api", 2), (2, None, 1), (3, "api", 0)], "query_id long, type string, n_expect int")
    found = spark.createDataFrame([(1, 2, 0), (1, 7, 1), (2, 6, 0)], "query_id long, rank int, expect_no int")
    per = {r.query_id: (r.hit, r.recall, r.rr) for r in evaluation.query_metrics(asked, found, 5).collect()}
    assert per == {1: (1.0, 0.5, 0.5), 2: (0.0, 0.0, 1 / 6), 3: (0.0, 0.0, 0.0)}
    by = {r.type: r.n for r in evaluation.macro(evaluation.query_metrics(asked, found, 5), by_type=True).collect()}
    assert by == {"api": 2, "?": 1, "(all)": 3}
    empty = evaluation.macro(evaluation.query_metrics(asked.limit(0), found, 5)).first()
    assert (empty.hit_at_k, empty.n) == (0.0, 0)


LINT = [
    ("e = 'BLENDER_EEVEE_NEXT'", ["eevee_next_engine_id"]), ("# avoid NISHITA", []), ("x = 'NISHITA' # NISHITA", ["nishita_sky_removed"]), ("view_transform = 'AGX'", ["agx_view_transform_casing"]), ("view_transform='AgX'", []),
    ("n.glare_type = 1", ["glare_type_attribute"]), ("import bgl\nbgl.x", ["bgl_module_removed"] * 2), ("unregister_module(a)", ["register_module_removed"]), ("s.new_effect(type='X', frame_end=f(1), length=10)", []),
    ("s.new_effect(type='X', frame_end=f(1))", ["new_effect_missing_length"]), ("a = '#' + 'NISHITA'", ["nishita_sky_removed"]),
]


@pytest.mark.parametrize("code,rules", LINT)
def test_lint(spark, code, rules):
    assert [h["rule_id"] for h in one(spark, sessions.lint, code)] == rules


def tasks(spark):
    rows = [("harbour", ["Lighthouse", "fog"]), ("attic", ["beams", "dust", "lamp"]), ("empty_plan", None)]
    return spark.createDataFrame(rows, "id string, success_hints array<string>")


def test_demo_report_numbers(spark):
    scored = sessions.score(ablation.demo_sessions(spark, tasks(spark), 3)).cache()
    text = ablation.report(scored, "demo", "3 tasks x 3 runs.")
    lines = text.splitlines()
    assert lines[0] == "# Scene-eval report" and "Synthetic backend" in text and "## Summary" in lines
    assert "RAG helped on 3/3 tasks, by error_rate, gotcha_hits, task_signal, grounding." in lines
    # Off, in runs of 3, 4 and 3 pieces of code: 2, 3 and 2 fail, and lint finds something in each piece.
    for want in (
        "| harbour | -0.694 | -3.333 | +1.000 | +1.000 | ✅ |", "| empty_plan | -0.694 | -3.333 | 0 | +1.000 | ✅ |", "| metric | RAG-off | RAG-on | Δ (on−off) | |", "| error_rate | 0.694 | 0.000 | -0.694 | ✅ |",
        "| scene_total | 3.000 | 38.000 | +35.000 | ✅ |", "| completed | 1.000 | 1.000 | 0 | · |", "| code_executions | 3.333 | 3.000 | -0.333 | · |", "| clean_run | 0.000 | 1.000 | +1.000 | ✅ |",
        "Pooled error_rate (all errors over all runs of code): 0.700 off, 0.000 on.", "**RAG effect:** fewer failed runs (-0.69), fewer outdated calls (-3.33), more runs after a query (+1.00).",
        "Spread (±pop. stdev), off and on: error_rate 0.04 and 0.00, gotcha_hits 0.47 and 0.00, task_signal_rate 0.00 and 0.00, query_before_call_rate 0.00 and 0.00.",
    ):
        assert want in lines, want
    assert [x for x in lines if x.startswith("## ")] == ["## Summary", "## attic (RAG-on n=3, RAG-off n=3)", "## empty_plan (RAG-on n=3, RAG-off n=3)", "## harbour (RAG-on n=3, RAG-off n=3)"]
    rows = [x.split(" | ")[0] for x in lines[lines.index("## attic (RAG-on n=3, RAG-off n=3)") :] if x.startswith("| ")]
    assert rows[1 : len(sessions.METRICS) + 1] == [f"| {m}" for m in sessions.METRICS]
    assert "directional only" not in text and "directional only" in ablation.report(scored.filter("run_index < 2"))


def test_worse_metrics_are_marked_and_do_not_count_as_help(spark):
    scored = sessions.score(ablation.demo_sessions(spark, tasks(spark), 1)).withColumn("rag_enabled", ~F.col("rag_enabled"))
    text = ablation.report(scored, "live")
    assert "RAG helped on 0/3 tasks" in text and "| error_rate | 0.000 | 0.667 | +0.667 | ⚠️ |" in text and "**RAG effect:** none that counts here." in text and "Synthetic" not in text


def test_one_condition_has_no_delta(spark):
    text = ablation.report(sessions.score(ablation.demo_sessions(spark, tasks(spark), 1)).filter("rag_enabled"))
    assert text.count("Only one condition present") == 3 and "## Summary" not in text and "| metric" not in text


def test_transcript(spark):
    rows = ablation.demo_sessions(spark, tasks(spark), 2)
    shown = {(r.task_id, r.rag_enabled, r.run_index): r.text.split("\n") for r in ablation.transcripts(rows).collect()}
    assert len(shown) == 12
    on = shown["harbour", True, 1]
    assert on[:5] == ["## harbour (RAG-on, run 1, model demo)", "brief concepts: Lighthouse, fog", "  1. SEARCH [manual]: how to stage harbour  -> 2 hits", "  2. EXEC [OK]", "     | plan = 'Lighthouse fog'"]
    assert on[-1] == "summary: executions 3, errors 0, error rate 0.00, queries 3, grounding 1.00, lint hits 0, task signal 1.00, completed true"
    off = shown["empty_plan", False, 1]
    assert off[1:5] == ["  1. EXEC [ERR ImportError]", "     | import bgl", "     error: demo ImportError", "     lint (raises) bgl_module_removed: Draw with the gpu module."]
    assert "  4. EXEC [ERR AttributeError]" in off and not any(x.startswith("  4.") for x in shown["empty_plan", False, 0]) and not any("brief concepts" in x for x in off)
    bare = spark.createDataFrame([("t", False, 0, None, None, None, None, None, None)], sessions.SESSION)
    assert ablation.transcripts(bare).first()["text"].startswith("## t (RAG-off, run 0)\nsummary: executions 0")


def test_session_rates(spark):
    data = [{"task_id": "t", "rag_enabled": True, "run_index": 0, "model": "", "events": [{"type": "rag_query", "query": "q"}, {"type": "rag_query", "query": "q"}, {"type": "code_exec", "code": "a", "ok": True}, {"type": "code_exec", "code": "B", "ok": False}], "completed": True, "success_hints": ["b", "b", "zz"]}, {"task_id": "t", "rag_enabled": False, "run_index": 0}]
    rows = spark.read.schema(sessions.SESSION).json(spark.sparkContext.parallelize([json.dumps(d) for d in data]))
    got = {r.rag_enabled: r for r in sessions.score(rows).collect()}
    assert (got[True].query_before_call_rate, got[True].error_rate, got[True].iterations, got[True].clean_run) == (0.5, 0.5, 4, False)
    assert abs(got[True].task_signal_rate - 2 / 3) < 1e-12 and (got[False].error_rate, got[False].clean_run, got[False].task_signal_rate) == (0.0, False, 0.0)


RST = """*****
Title
*****

Intro :ref:`shown <target>` and `link <http://x>`__ with ``code``.

.. figure:: a.png
   :align: center

   caption

Sub
===

.. note:: Take care
   of this

.. toctree::
   :maxdepth: 2

   a

.. comment
.. math:: x
   y = 1
Deep
----
"""


def test_rst_becomes_markdown(spark):
    got = one(spark, sources.rst_markdown, RST)
    assert one(spark, sources.rst_markdown, None) is None and one(spark, sources.rst_markdown, "") == "" and one(spark, sources.rst_markdown, "a\n\n") == "a\n\n"
    assert [x for x in got.split("\n") if x.strip()] == ["# Title", "Intro shown and link with `code`.", "## Sub", "**Note:** Take care", "   of this", "   y = 1", "### Deep"]


def test_rst_blocks_of_every_kind(spark):
    convert = lambda t: one(spark, sources.rst_markdown, t)
    # Levels go by the turn of the rule character; a rule shorter than its title is none.
    assert convert("A\n==\nB\n--\nC\n~~~\nLonger\n---\n=====\nD\n=====\nE\r\n~~~~\r") == "A\n==\nB\n--\n# C\nLonger\n---\n## D\n# E"
    heads = "".join(f"{c * 3}\nT{k}\n{c * 3}\n" for k, c in enumerate("#*=-^~+:"))
    assert convert(heads).split("\n")[:-1] == ["#" * min(k + 1, 6) + f" T{k}" for k in range(8)]
    # A dropped block ends at the first line that is not further indented; others keep their body.
    assert convert("  .. figure:: x\n     :w: 1\n\n    cap\n  after") == "  after"
    assert convert(".. code-block:: py\n   :linenos:\n\n   x = 1\n.. [1] note\n..\nend") == "\n   x = 1\nend"
    assert convert(".. Tip::\n.. WARNING:: hot ``x``") == "**Tip:**\n**Warning:** hot `x`"
    assert convert("see `a\nb <c>`_ and :doc:`d <e>` :k:`v`") == "see `a\nb <c>`_ and d v"


PAGE = """<html><dl class="py class"><dt id="m.C" class="sig">class <b>C</b>(x)<a>¶</a></dt><dd><p>About C.</p>
<dl class="py method"><dt id="m.C.f">f()¶</dt><dd><p>Does f.</p></dd></dl><dl class="py attribute"><dt id="m.C.a">a</dt><dd></dd></dl></dd></dl>
<dl class="py"><dt>no id</dt></dl></html>"""


def test_api_pages(spark):
    got = {(r[0], r[1]): r for r in html.api_symbols(PAGE, "m.html")}
    assert list(got) == [("m.C", "class"), ("m.C", "class_summary"), ("m.C.f", "method"), ("m.C.a", "attribute")]
    assert got[("m.C", "class")][3] == "class C (x)\n\nAbout C." and got[("m.C", "class_summary")][3].endswith("Members:\n- class C (x)\n- f()\n- a")
    spark.udtf.register("api_symbols", html.ApiSymbols)
    spark.createDataFrame([(PAGE, "m.html")], "h string, f string").createOrReplaceTempView("pages_t")
    assert spark.sql("SELECT s.symbol FROM pages_t, LATERAL api_symbols(h, f) s").count() == 4


POSTS = [
    ("1", "1", None, "5", "u", "2020-01-01T0", "q", "How <b>?", "<py><mod-x>"), ("2", "2", "1", "7", "u2", "2022-05-01T0", "<p>Do  this</p><p>and that</p>", None, None), ("3", "2", "9", "4", "u", "2025-01-02", "<p>x</p>", None, None),
    ("4", "2", "1", "1", "u", "2025", "<p>low</p>", None, None), ("5", "2", "1", "bad", "u", "2025", "<p>z</p>", None, None), ("6", "2", "1", "9", "u", "2018-01-01", "<p>old</p>", None, None), ("9", "1", None, "1", "u", "2020", "", "Later", None),
]


def test_answers_meet_questions(spark):
    names = ["Id", "PostTypeId", "ParentId", "Score", "OwnerUserId", "CreationDate", "Body", "Title", "Tags"]
    posts = spark.createDataFrame([(*p, i) for i, p in enumerate(POSTS)], ", ".join(f"{n} string" for n in names) + ", pos long")
    got = {r.source_url[-1]: r for r in sources.answers(posts, "http://x/a", "An answer").collect()}
    assert set(got) == {"2", "3"} and got["2"].text == "Q: How <b>?\n\nA:\nDo  this\nand that" and got["2"].extra.tags == "py mod-x"
    assert (got["2"].extra.version_status, got["3"].extra.version_status, got["2"].extra.license, got["3"].title) == ("dated_valid", "current", "cc-by-sa-4.0", "Later")
    early = {r.source_url[-1]: r.title for r in sources.answers(posts, "http://x/a", "An answer", in_order=True).collect()}
    assert early == {"2": "How <b>?", "3": "An answer"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "index.md").write_text("# Overview\n\ntext")
    (tmp_path / "notes" / "py_api.md").write_text("no heading")
    (tmp_path / "notes" / "empty.md").write_text("  \n")
    got = {r.source_url: r.title for r in sources.release_notes(spark, {"5.1": str(tmp_path / "notes")}, "http://n").collect()}
    assert got == {"http://n/5.1/": "5.1 Release Notes — Overview", "http://n/5.1/py_api/": "5.1 Release Notes — Py Api"}
    tree = tmp_path / "addon"
    for name in ("a.py", "setup.py", "test_x.py", "tests/t.py", "pkg/b.py", "pkg/blank.py"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("" if "blank" in name else f"# {name}\nx = 1\n")
    (tree / "pkg" / "m.toml").write_text('blender_version_min = "4.2.0"\n')
    assert {r.title for r in sources.python_tree(spark, str(tree), "http://w", name="n").collect()} == {"n/a.py", "n/pkg/b.py"}
    assert sources.python_tree(spark, str(tmp_path / "gone"), "http://w").count() == 0
    listed = [("n", "http://g/n.git", "gpl-3.0", str(tree)), ("old", "", "gpl-3.0", str(tmp_path / "notes"))]
    assert {r.source_url for r in sources.vetted_addons(spark, listed, "m.toml").collect()} == {"http://g/n/blob/HEAD/a.py", "http://g/n/blob/HEAD/pkg/b.py"}


@pytest.mark.parametrize("toml,ok", [('blender_version_min = "4.2.0"', True), ('blender_version_min = "5"', True), ('blender_version_min = "4.1"', False), ("x = 1", False), ("not toml", False), ("blender_version_min = 5", False), ('blender_version_min = "a.b"', False), (None, False)])
def test_manifest_gate(toml, ok):
    assert sources._current(toml, (4, 2), "blender_version_min") is ok


def test_feeds(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    feed.write_text('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>A</title><link>http://a</link><pubDate>Wed, 14 May 2025 10:00:00 +0000</pubDate><content:encoded>&lt;p&gt;full&lt;/p&gt;</content:encoded><description>short</description></item><item><title></title><description>x</description></item></channel></rss>')
    got = sources.blog_posts(sources.feed_items(spark, str(feed)), "http://blog").collect()
    assert [(r.title, r.text, r.extra.version_status, r.extra.source_date) for r in got] == [("A", "A\n\nfull", "current", "Wed, 14 May 2025")]
    rest = tmp_path / "p.json"
    rest.write_text(json.dumps([{"title": {"rendered": "T"}, "link": "http://t", "date": "2023-02-03T00", "content": {"rendered": "<p>b</p>"}}, {"title": {"rendered": "E"}, "content": {"rendered": ""}}]))
    got = sources.blog_posts(sources.rest_posts(spark, str(rest)), "http://blog", rest=True).collect()
    assert [(r.source_url, r.extra.version_status, r.extra.source_date) for r in got] == [("http://t", "dated_valid", "2023-02-03")]


def test_pages_end_where_they_should():
    pages = {1: (200, [{}] * 2), 2: (200, [{}]), 3: (200, [{}])}
    assert [len(p) for p in sources.paged(lambda n, k: pages[n], 2)] == [2, 1]
    assert list(sources.paged(lambda n, k: (200, []), 2)) == []
    with pytest.raises(RuntimeError):
        list(sources.paged(lambda n, k: (500, []), 2))


def test_jsonl_names_the_bad_line(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    assert jsonl.write_jsonl(rows, str(tmp_path / "out"), single=True) == 2
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "id long, t string").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1, "t": "x"}\n{"id": oops}\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:2: invalid Document row"):
        jsonl.read_jsonl(spark, str(bad), "id long, t string", name="Document")
    jsonl.rewrite(rows, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    jsonl.rewrite(table.filter("id = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d1", "api", "add cube mesh", "ctx"), ("c2", "d1", "manual", "render engine", None)], "id string, doc_id string, source_type string, text string, context string")
    index.build_table(chunks, retrieval.hashed_encoder(16), str(tmp_path))
    table = index.open_table(spark, str(tmp_path))
    assert {(r.id, r.embed_text, r.symbol) for r in table.collect()} == {("c1", "ctx\n\nadd cube mesh", ""), ("c2", "render engine", "")}
    assert index.open_table(spark, str(tmp_path), "terms").filter("term = 'cube'").first()["df"] == 1
    with pytest.raises(ValueError):
        index.build_table(chunks.limit(0), retrieval.hashed_encoder(16), str(tmp_path))
    query = spark.createDataFrame([(1, "cube mesh")], "query_id long, query string")
    ranked = retrieval.bm25(query, table.withColumnRenamed("doc_id", "parent"), doc_id="id", text="embed_text").withColumnRenamed("doc_id", "id")
    assert [r.title for r in index.hits(ranked.select("query_id", "id", "score", "rank"), table).collect()] == [""]


def test_contexts_only_where_wanted(spark):
    chunks = spark.createDataFrame([("c1", "d1", "manual", "t1", None), ("c2", "gone", "manual", "t2", None), ("c3", "d1", "api", "t3", None), ("c4", "d1", "manual", "t4", "has")], "id string, doc_id string, source_type string, text string, context string")
    docs = spark.createDataFrame([("d1", "document")], "id string, text string")
    got = {r.id: r.context for r in index.with_context(chunks, docs, lambda d, c: [f"{a}/{b}" for a, b in zip(d, c, strict=True)], ["manual"]).collect()}
    assert got == {"c1": "document/t1", "c2": "t2/t2", "c3": None, "c4": "has"}


def test_node_graphs(spark):
    graph = {"name": "Rock", "kind": "material", "nodes": [{"name": "P", "type": "Bsdf", "inputs": {"Roughness": 0.8, "Color": [1.0, 0.5, 0.25, 1.0], "Big": [0] * 9}}], "links": [{"from_node": "N", "from_socket": "Fac", "to_node": "P", "to_socket": "R"}]}
    got = index.node_graphs(spark.createDataFrame([(json.dumps(graph),)], "graph string")).first()["text"]
    assert got.split("\n") == ["Material node graph: Rock", "", "Nodes:", "  - Bsdf 'P'  (Roughness=0.8, Color=(1, 0.5, 0.25, 1), Big=[9 values])", "", "Links:", "  - N.Fac -> P.R"]


def test_snapshots_and_outcomes(spark):
    shot = one(spark, text.snapshot, '{"objects":[{"type":"MESH"},{"type":"LIGHT"}],"material_count":3}')
    assert tuple(shot) == (2, 1, 3, 0, 1) and tuple(one(spark, text.snapshot, "nope")) == (0, 0, 0, 0, 0)
    got = spark.createDataFrame([(False, "Traceback: KeyError: x"), (False, "fine"), (True, "odd")], "f boolean, t string").select(text.exec_outcome(F.col("f"), F.col("t")).alias("r")).collect()
    assert [(r.r.ok, r.r.error_type) for r in got] == [(False, "KeyError"), (True, None), (False, "RuntimeError")]


def test_trust_weights_default_to_one(spark):
    none = F.lit(None)
    got = spark.range(1).select(retrieval.trust_weight(F.lit(0.5), none.cast("double"), none.cast("string"), none.cast("int"), none.cast("double"), none.cast("double"), 2026).alias("r"), retrieval.trust_weight(F.lit(1.0), F.lit(1.0), F.lit("stale"), F.lit(2019), F.lit(1.0), F.lit(1.0), 2026).alias("s")).first()
    assert got.r == 0.5 and abs(got.s - 0.3) < 1e-12
