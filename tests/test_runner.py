"""The session loop with scripted parts, settings, and the paged source."""

import json

from lodestack.config import load_settings
from lodestack.operators import runner, sessions
from lodestack.sources.paged import paged_source


class Script:
    def __init__(self, *steps):
        self.steps = list(steps)

    def next_action(self, prompt, seen):
        return self.steps.pop(0) if self.steps else runner.Action("done")


class Machine:
    def execute(self, code):
        return runner.Outcome(False, "KeyError", "k" * 900) if "BAD" in code else runner.Outcome(True)

    def snapshot(self):
        return {"objects": 1, "meshes": 1, "materials": 0, "material_nodes": 0, "lights": 2}


class Library:
    def search(self, query, source_type, top_k):
        return [{"title": "T", "text": "x" * 900, "source_url": "u", "source_type": "api"}] * top_k


def test_sessions_are_recorded_and_scored(spark):
    ask, good, bad = runner.Action("query", query="q", top_k=2), runner.Action("exec", code="fine AgX"), runner.Action("exec", code="BAD")
    on = runner.run_session("t", "p", Script(ask, good, bad), Machine(), Library(), success_hints=["agx"])
    off = runner.run_session("t", "p", Script(*[ask] * 9), Machine(), None, most=4)
    assert on["completed"] and not off["completed"] and [e["n_hits"] for e in off["events"]] == [0] * 4
    assert on["events"][0]["n_hits"] == 2 and len(on["events"][2]["error_message"]) == runner.MESSAGE
    rows = spark.read.schema(sessions.SESSION).json(spark.sparkContext.parallelize([json.dumps(on), json.dumps(off)]))
    got = {r.rag_enabled: r for r in sessions.score(rows).collect()}
    assert (got[True].error_rate, got[True].query_before_call_rate, got[True].task_signal_rate, got[True].scene_total) == (0.5, 0.5, 1.0, 4)


def test_conditions_hits_and_unknown_actions():
    ask, odd, end = runner.Action("query", query="q", top_k=2), runner.Action("dance"), runner.Action("done")
    got = runner.run_session("t", "p", Script(odd, ask, odd, end), Machine(), Library())
    assert got["completed"] and [e["n_hits"] for e in got["events"]] == [2] and [len(h["text"]) for h in got["events"][0]["hits"]] == [runner.HIT_TEXT] * 2
    off = runner.run_session("t", "p", Script(ask), Machine(), Library(), rag_enabled=False)
    assert not off["rag_enabled"] and off["events"][0]["n_hits"] == 0 and off["events"][0]["hits"] == []
    bare = runner.run_session("t", "p", Script(ask), Machine(), None, rag_enabled=True)
    assert bare["rag_enabled"] and bare["events"][0]["n_hits"] == 0
    lost = runner.run_session("t", "p", Script(*[odd] * 9), Machine(), None, most=5)
    assert not lost["completed"] and lost["events"] == []


def test_tools():
    assert runner.tool_text([]) == "No results." and runner.tool_text(runner.Outcome(True)) == "Executed OK."
    assert runner.tool_text(runner.Outcome(False, "E", "m")) == "ERROR E: m"
    assert runner.action_of("search", {"query": "a"}) == runner.Action("query", query="a") and runner.action_of("other", {}).kind == "done"
    assert len(runner.trimmed({"text": "y" * 999})["text"]) == runner.HIT_TEXT


def test_settings(tmp_path):
    file = tmp_path / "s.yaml"
    file.write_text("a: {b: {c: 3}}\npaths: {raw: data/raw}\n")
    got = load_settings(str(file))
    assert got.section("a", "b", "c") == 3 and got.section("a", "x", default=7) == 7 and got.section("a", "b", "c", "d") is None
    assert got.path("raw") == tmp_path / "data" / "raw" and load_settings(str(file)) is got


def test_paged_source(spark):
    spark.dataSource.register(paged_source(lambda page, per: (200, [{"id": page * 10 + k} for k in range(per if page < 3 else 1)])))
    rows = spark.read.format("paged").option("per_page", 2).load().collect()
    assert [(r.page, json.loads(r.json)["id"]) for r in rows] == [(1, 10), (1, 11), (2, 20), (2, 21), (3, 30)]
