"""Agent runs as a table: one row of state for each task and run, one pass for each step.

A step asks the model for all runs that are still open, checks the calls it makes, answers all of their searches by one batch,
and joins the results back; so the number of Spark jobs grows with the steps of the longest run, not with the tasks. What
the model said is written before anything is done with it, and so is the state after each step: a lost
executor asks again for one task's rows of one step at most. A run's state is what ``Agent`` has in memory, and
``Agent.start``, ``ask``, ``act`` and the checks of ``SearchTool`` are what is applied to it.

Defined cases: a model that fails stops its run (stopped_reason ``failed``, the reason in answer), others go on; a
blank question fails at once; calls of unknown tools and with wrong arguments get errors as results, as in ``Agent``; a call
without an id is one of its own; no tasks give no rows. Pages of the web can't be fetched here: their budget is a run's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agent import SEARCH, Agent, SearchTool

#: A run between steps: what Agent keeps, as JSON, and what routes it.
STATE = "task_id string, run_id int, state string, open boolean"
#: A call: its place in the step; the search it asks for (query, top_k, min_score), or the error that it gets.
CALL = "task_id string, run_id int, pos int, query string, top_k int, min_score double, error string"
RUN = "task_id string, run_id int, answer string, stopped_reason string, step int, messages string, tool_calls string, evidence string"
#: Runs that one task asks the model for.
TASK_RUNS = 64


class _Wanted(Exception):
    """Carries a search out of a tool's checks."""

    def __init__(self, *search):
        self.search = search


def _want(query: str, k: int, least: float) -> list:
    raise _Wanted(query, k, least)


def _packed(state: dict) -> str:
    return json.dumps({k: v for k, v in state.items() if k != "history"}, ensure_ascii=False)


def _unpacked(text: str) -> dict:
    state = json.loads(text)
    return state | {"pending": tuple(tuple(c) for c in state["pending"])}


def _each(step: Callable[[dict], dict], columns: str):
    """A function of rows, as mapInPandas takes it, from one that gives a row (or several) for a row."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [x for r in f.to_dict("records") for x in step(r)]
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


def run_agents(tasks: DataFrame, chat: Callable, search: Callable[[DataFrame], DataFrame], folder: str, repeat: int = 1, max_steps: int | None = None, prompt: str = "", top_k: int = 5, min_score: float = 0.08) -> DataFrame:
    """``tasks``: task_id, query. ``chat``: as of ``Agent``. ``search``: of searches (query_id, query, top_k, min_score) the results
    (query_id, rank, result), a result being a JSON object. ``folder``: one that all machines see.
    Returns a row of RUN for each task and run; messages, tool_calls and evidence are JSON arrays."""
    spark = tasks.sparkSession
    folder = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    agent = Agent(SearchTool(_want, top_k, min_score), chat, None, max_steps, prompt)
    tool = agent.search

    def failed(state: dict, why: str) -> dict:
        return state | {"answer": why, "stopped_reason": "failed", "pending": ()}

    def begin(r):
        try:
            state = agent.start(r["query"] or "")
        except ValueError as e:
            state = failed({"question": r["query"], "messages": [], "tool_calls": [], "evidence": [], "step": 0}, str(e))
        yield r["task_id"], r["run_id"], _packed(state), state["stopped_reason"] is None

    def ask(r):
        state = _unpacked(r["state"])
        try:
            state = agent.ask(state)
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            state = failed(state, f"{type(e).__name__}: {e}")
        yield r["task_id"], r["run_id"], _packed(state), state["stopped_reason"] is None

    def calls(r):
        for pos, (_, name, arguments) in enumerate(_unpacked(r["state"])["pending"]):
            query = k = least = error = None
            try:
                if name != SEARCH:
                    raise ValueError(f"not an allowed tool: {name}")
                if not isinstance(arguments, str):
                    raise ValueError("arguments must be a JSON text")
                tool.invoke(arguments)
            except _Wanted as e:
                query, k, least = e.search
            except Exception as e:  # noqa: BLE001  errors are results
                error = str(e)
            yield r["task_id"], r["run_id"], pos, query, k, least, error

    def act(r):
        given = {x["pos"]: x for x in r["given"]}
        state = _unpacked(r["state"])
        answers = iter([given[i] for i in range(len(state["pending"]))])

        def dispatch(name, arguments):
            x = next(answers)
            if x["error"] is not None:
                return {"error": x["error"]}
            results = [json.loads(t) for t in x["results"]]
            return {"query": x["query"], "top_k": int(x["top_k"]), "min_score": float(x["min_score"]), "count": len(results), "results": results}

        told = Agent(tool, chat, None, max_steps, prompt)
        told.dispatch = dispatch
        state = told.act(state)
        yield r["task_id"], r["run_id"], _packed(state), state["stopped_reason"] is None

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(max(1, -(-df.count() // TASK_RUNS)), "task_id", "run_id")

    runs = tasks.select(F.col("task_id").cast("string").alias("task_id"), F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("run_id"), "query")
    states = written(runs.mapInPandas(_each(begin, STATE), STATE), "start")
    done = [states.filter("NOT open")]
    states = states.filter("open")
    for step in range(1, 1 + (max_steps or 5)):
        if states.isEmpty():
            break
        said = written(spread(states).mapInPandas(_each(ask, STATE), STATE), f"{step:03d}-said")
        done.append(said.filter("NOT open"))
        waiting = said.filter("open")
        made = written(waiting.mapInPandas(_each(calls, CALL), CALL), f"{step:03d}-calls")
        key = F.concat_ws("\n", "run_id", "pos", "task_id")
        wanted = made.filter("error IS NULL").select(key.alias("query_id"), "query", "top_k", "min_score")
        found = search(wanted).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "result"))).alias("r"))  # top_k results at most
        met = made.withColumn("query_id", key).join(found.select("query_id", F.col("r.result").alias("results")), "query_id", "left")
        given = F.struct("pos", "query", "top_k", "min_score", "error", F.coalesce("results", F.array().cast("array<string>")).alias("results"))
        by_run = met.groupBy("task_id", "run_id").agg(F.collect_list(given).alias("given"))  # a model's calls of one turn
        after = written(waiting.join(by_run, ["task_id", "run_id"]).select("task_id", "run_id", "state", "given").mapInPandas(_each(act, STATE), STATE), f"{step:03d}-state")
        done.append(after.filter("NOT open"))
        states = after.filter("open")

    def end(r):
        s = json.loads(r["state"])
        yield r["task_id"], r["run_id"], s["answer"], s["stopped_reason"], s["step"], *(json.dumps(s[k], ensure_ascii=False) for k in ("messages", "tool_calls", "evidence"))

    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.mapInPandas(_each(end, RUN), RUN)
