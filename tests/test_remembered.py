"""Answers of models: asked once, kept, tried again; counted by a client that writes down its calls."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanworks.functions.embedders import RemoteEmbedder
from gleanworks.operators import harness, index, remembered


def client(log, bad=(), fail_first=0):
    """Upper-cases texts; writes each call to a file of its own line; fails on some texts, and at first."""

    def ask(texts):
        with open(log, "a") as f:
            f.write("\x1f".join(texts) + "\n")
        calls = Path(log).read_text().splitlines()
        if len(calls) <= fail_first or any(t in bad for t in texts):
            raise ConnectionError("no")
        return [t.upper() for t in texts]

    return ask


def asked(log):
    return [line.split("\x1f") for line in Path(log).read_text().splitlines()] if Path(log).exists() else []


@pytest.fixture
def go(spark, tmp_path):
    def run(texts, n="log", model="m", bad=(), fail_first=0, **more):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
        found = remembered.answers(df, client(str(tmp_path / n), bad, fail_first), model, str(tmp_path / "memory"), wait=0.01, **more)
        said = df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().join(found, F.sha2("t", 256) == F.col("text_hash"))
        return {r.t: (r.value, r.failure) for r in said.collect()}, asked(tmp_path / n)

    return run


def test_each_text_once(go):
    got, calls = go(["a", "b", "a", None, "", "c" * 9])
    assert got == {t: (t.upper(), None) for t in ("a", "b", "", "c" * 9)}
    assert sorted(t for c in calls for t in c) == sorted(["a", "b", "", "c" * 9])
    again, calls = go(["a", "d", "b"], "log2")
    assert again == {t: (t.upper(), None) for t in "abd"} and calls == [["d"]]
    _, calls = go(["a"], "log3", model="other")
    assert calls == [["a"]]
    assert go([], "log4") == ({}, [])


def test_failures_are_rows_and_tried_again(go):
    texts = [f"t{i}" for i in range(20)]
    got, calls = go(texts, bad=("t7",), tries=2)
    assert got["t7"] == (None, "ConnectionError: no") and all(got[t] == (t.upper(), None) for t in texts if t != "t7")
    got, calls = go(texts, "log2", tries=2)
    assert got["t7"] == ("T7", None) and calls == [["t7"]]


def test_back_off(go):
    got, calls = go(["a"], fail_first=2, tries=4)
    assert got == {"a": ("A", None)} and len(calls) == 3
    got, calls = go(["b"], "log2", fail_first=9, tries=3)
    assert got == {"b": (None, "ConnectionError: no")} and len(calls) == 3


def test_a_dead_service_is_not_asked_for_every_text(go):
    got, calls = go([f"x{i}" for i in range(60)], fail_first=10**9, tries=2)
    assert len(got) == 60 and all(f for _, f in got.values())
    assert len(calls) <= 3 * (2 + 3)  # three partitions: a batch twice, then three texts


def test_batches():
    texts = ["aa", "b", "é" * 3, "c", "", "d" * 50, "e"]
    for rows, most in ((2, 1000), (100, 7), (1, 1)):
        cut = list(remembered._batches(texts, rows, most))
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a <= rows and (b - a == 1 or sum(len(t.encode()) for t in texts[a:b]) <= most) for a, b in cut)


def test_wrong_number_of_answers(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    found = remembered.answers(df, lambda texts: texts[1:], "m", str(tmp_path / "m"), tries=1)
    assert [r.failure for r in found.collect()] == ["ValueError: 0 answers to 1 texts"] * 2


def test_index_by_a_service(spark, tmp_path):
    log = str(tmp_path / "log")

    def call(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if "bad" in texts:
            raise ConnectionError("no")
        return [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]

    embedder, memory = RemoteEmbedder("e", "m", call), str(tmp_path / "memory")
    row = "chunk_id string, text string, content_hash string, ingestion_fingerprint string, chunking_fingerprint string"
    one = spark.createDataFrame([(str(i), f"text {i % 3}", "h", "i", "c") for i in range(9)], row)
    made = index.build(one, embedder, memory)
    assert {(r.chunk_id, tuple(r.vector)) for r in made.collect()} == {(str(i), (6.0, 1.0)) for i in range(9)}
    assert made.count() == 9 and len(Path(log).read_text().splitlines()) == 3
    more = one.union(spark.createDataFrame([("x", "text 1", "h", "i", "c"), ("y", "another", "h", "i", "c")], row))
    both = index.update(more, made, embedder, memory=memory)
    assert both.count() == 11 and sorted(Path(log).read_text().splitlines()) == ["another", "text 0", "text 1", "text 2"]
    with pytest.raises(index.IndexProblem, match="ConnectionError"):
        index.build(spark.createDataFrame([("z", "bad", "h", "i", "c")], row), RemoteEmbedder("e", "m", lambda t: (_ for _ in ()).throw(ConnectionError("no"))), str(tmp_path / "other"))


def test_judge_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def complete(messages):
        with open(log, "a") as f:
            f.write(messages[1]["content"] + "\n")
        if messages[1]["content"] == "p2":
            raise TimeoutError("late")
        return '{"faithfulness": 5, "coverage": 4, "overall": 5, "failure_type": "正常", "reason": "r"}'

    prompts = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p3")], "task_id string, prompt string")
    for _ in range(2):
        got = {r.task_id: (r.overall, r.error) for r in harness.judge(prompts, complete, str(tmp_path / "m"), "model").collect()}
        assert got == {t: (5, None) for t in "abc"}
    assert sorted(Path(log).read_text().splitlines()) == ["p1", "p3"]
