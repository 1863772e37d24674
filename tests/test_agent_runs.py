"""Runs in a table against the loop that takes them one by one, with a scripted model."""

import json

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import agent, agent_runs

TEXTS = {f"c{i}": f"text {i % 7} of {i}" for i in range(40)}


def found(query, k, least):
    """Chunks that share words with the query, best first."""
    words = set(query.split())
    scored = sorted((-len(words & set(t.split())) / 4, c) for c, t in TEXTS.items())
    return [{"chunk_id": c, "source_path": f"/docs/{c}", "score": -s, "text": TEXTS[c]} for s, c in scored[:k] if -s >= least and s]


def script(messages, tools):
    """What the model says depends on the question and on how often it was asked."""
    question = next(m["content"] for m in reversed(messages) if m["role"] == "user")
    n, turn = int(question.split()[-1]), sum(m["role"] == "assistant" for m in messages)
    if n % 10 == 9 and turn == 1:
        raise TimeoutError("late")
    if turn >= n % 7:
        last = messages[-1]["content"]
        return agent.Turn("" if n % 11 == 0 else f"answer {n} é after {len(last)} characters")
    calls = [(f"id{turn}", agent.SEARCH, json.dumps({"query": f" text {n % 7} of {n} ", "top_k": 1 + turn}))]
    if n % 3 == 0:
        calls += [("id9", agent.SEARCH, '{"query": " "}'), ("id9", "other_tool", "{}"), (None, agent.SEARCH, {"query": "x"})]
    if n % 4 == 0:
        calls.append(("more", agent.SEARCH, '{"query": "text 3", "min_score": 0.5}'))
    return agent.Turn(None, tuple(calls))


@pytest.fixture
def search(spark):
    @F.udf("array<string>")
    def one(query, k, least):
        return [json.dumps(r) for r in found(query, k, least)]

    batches = []

    def batch(wanted):
        batches.append(wanted.count())
        return wanted.select("query_id", F.posexplode(one("query", "top_k", "min_score")).alias("pos", "result")).select("query_id", (F.col("pos") + 1).alias("rank"), "result")

    batch.batches = batches
    return batch


def one_by_one(question, steps=None):
    try:
        r = agent.Agent(agent.SearchTool(found), script, max_steps=steps).run(question)
        return r.answer, r.stopped_reason, r.step, json.loads(json.dumps(r.messages)), json.loads(json.dumps(r.tool_calls)), r.evidence
    except TimeoutError:
        return "TimeoutError: late", "failed"


def test_a_thousand_tasks(spark, tmp_path, search):
    tasks = [(f"t{i}", f"question {i}") for i in range(1000)]
    df = spark.createDataFrame(tasks, "task_id string, query string")
    tracker, group = spark.sparkContext.statusTracker(), "agents"
    spark.sparkContext.setJobGroup(group, group)
    rows = agent_runs.run_agents(df, script, search, str(tmp_path)).collect()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.task_id: (r.answer, r.stopped_reason, r.step, json.loads(r.messages), json.loads(r.tool_calls), json.loads(r.evidence)) for r in rows}
    assert len(rows) == 1000
    for t, q in tasks:
        want = one_by_one(q)
        assert got[t][: len(want)] == want
    assert {r.stopped_reason for r in rows} == {"completed", "max_steps", "failed"}
    assert len(search.batches) == 5 and jobs < 150  # a batch for each step; jobs don't grow with tasks


def test_runs_and_odd_tasks(spark, tmp_path, search):
    df = spark.createDataFrame([("a", "question 2"), ("b", "  "), ("c", None)], "task_id string, query string")
    rows = agent_runs.run_agents(df, script, search, str(tmp_path), repeat=2, max_steps=2).collect()
    got = {(r.task_id, r.run_id): (r.answer, r.stopped_reason) for r in rows}
    assert got == {("a", 0): one_by_one("question 2", 2)[:2], ("a", 1): one_by_one("question 2", 2)[:2]} | {(t, k): ("no question", "failed") for t in "bc" for k in (0, 1)}
    assert agent_runs.run_agents(df.limit(0), script, search, str(tmp_path)).count() == 0


def test_harness_with_an_agent(spark, tmp_path, monkeypatch, capsys):
    """Tasks answered by an agent over a workspace: what it found counts, task by task."""
    from gleanworks import cli
    from gleanworks.sources import remote

    def speak(messages, tools):
        if messages[-1]["role"] == "user":
            return agent.Turn(None, (("1", agent.SEARCH, json.dumps({"query": messages[-1]["content"], "top_k": 2})),))
        return agent.Turn("It says so [1]." if json.loads(messages[-1]["content"])["count"] else "没有找到")

    monkeypatch.setattr(remote.ChatClient, "from_environment", classmethod(lambda cls: speak))
    (tmp_path / "a.txt").write_text("Query, key and value make attention.")
    (tmp_path / "b.txt").write_text("A protocol controls transmission.")
    ws = str(tmp_path / "ws")
    for name in "ab":
        cli.main(["ingest", str(tmp_path / f"{name}.txt"), "--workspace", ws, "--incremental"])
    tasks = [{"id": x, "query": q, "relevant_source_paths": [str(tmp_path / f"{x}.txt")], "expected_points": ["p"]} for x, q in (("a", "key and value"), ("b", "protocol controls"))]
    (tmp_path / "t.jsonl").write_text("".join(json.dumps(t) + "\n" for t in [*tasks, {"id": "c", "query": "zzz", "task_type": "refusal"}]))
    capsys.readouterr()
    assert cli.main(["harness", str(tmp_path / "t.jsonl"), "--real", "--repeat", "2", "--workspace", ws]) == 0
    overall = next(r for r in map(json.loads, capsys.readouterr().out.splitlines()) if r["section"] == "overall")
    assert overall["retrieval_hit_rate"] == overall["refusal_correct_rate"] == 1.0 and overall["avg_tool_calls"] == 1.0
