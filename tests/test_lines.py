"""Places of lines over many splits, and the contract of tasks."""

import json

import pytest

from gleanworks.operators import harness
from gleanworks.sources import files, lines

TASK = {"id": "a", "query": "q", "relevant_chunk_ids": ["c"], "expected_points": ["p"]}


def test_numbers_over_splits(spark, tmp_path):
    texts = {"a.jsonl": [f'{{"n": {i}}}' if i % 50 else "x" * (i % 90) for i in range(3000)], "b.jsonl": ["[1]", "", '{"n": 1}', "é {"]}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n", newline="\r\n" if name == "b.jsonl" else "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4000")
        raw = lines.split_lines(spark, str(tmp_path))
        assert raw.select("file", "split").distinct().count() > 5
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in lines.numbered(raw, raw).collect())
        assert got == sorted((name, i, x) for name, rows in texts.items() for i, x in enumerate(rows, 1))
        _, bad = lines.scan_jsonl(spark, str(tmp_path))
        want = sorted((name, i, "not an object" if x == "[1]" else "not JSON") for name, rows in texts.items() for i, x in enumerate(rows, 1) if x and not x.startswith('{"n'))
        assert sorted((r.file.rsplit("/", 1)[1], r.line, r.problem) for r in bad.collect()) == want
        with pytest.raises(ValueError, match="line 51:"):
            files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "n int")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


CASES = [
    ({}, None),
    ({"id": "  "}, "id"), ({"id": 3}, "id"), ({"id": None}, "id"),
    ({"query": ""}, "query"), ({"query": ["q"]}, "query"),
    ({"task_type": "other"}, "task_type"), ({"task_type": None}, "task_type"), ({"task_type": 1}, "task_type"),
    ({"task_type": "refusal", "relevant_chunk_ids": [], "expected_points": []}, None),
    ({"relevant_chunk_ids": "c"}, "labels"), ({"relevant_chunk_ids": [1]}, "labels"), ({"relevant_source_paths": ["x", " "]}, "labels"), ({"relevant_source_paths": [None]}, "labels"), ({"relevant_source_paths": None}, None),
    ({"relevant_chunk_ids": []}, "no label"), ({"relevant_chunk_ids": None}, "no label"),
    ({"expected_points": ["p"] * 5}, None), ({"expected_points": ["p"] * 8}, None), ({"expected_points": ["p"] * 9}, "expected_points"),
    ({"expected_points": None}, "expected_points"), ({"expected_points": ["p", 1]}, "expected_points"), ({"expected_points": [""]}, "expected_points"),
    ({"expected_points": []}, "no expected_points"),
    ({"category": None}, "category"), ({"category": 1}, "category"), ({"category": " c "}, None),
    ({"auto": "true"}, "auto"), ({"auto": None}, "auto"), ({"auto": True}, None),
]


def test_task_contract(spark, tmp_path):
    rows = [TASK | {"id": f"t{i}"} | change for i, (change, _) in enumerate(CASES)]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\nnull\n{\n")
    tasks, problems = harness.scan_tasks(spark, str(tmp_path / "t.jsonl"))
    want = {i: p for i, (_, p) in enumerate(CASES, 1) if p} | {len(CASES) + 1: "not an object", len(CASES) + 2: "not JSON"}
    assert {r.line: r.problem for r in problems.collect()} == want
    got = {r.line: r for r in tasks.collect()}
    assert sorted(got) == [i for i, (_, p) in enumerate(CASES, 1) if not p]
    assert all((r.task_type, r.auto, r.category) == (CASES[i - 1][0].get("task_type", "answerable"), CASES[i - 1][0].get("auto", False), CASES[i - 1][0].get("category", "").strip()) for i, r in got.items())


def test_repeated_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(TASK | {"id": x}) + "\n" for x in ("a", " b", "a", "c")))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps(TASK | {"id": x}) + "\n" for x in ("b ", "d")))
    tasks, problems = harness.scan_tasks(spark, str(tmp_path))
    assert sorted((r.file[-7:], r.line, r.problem) for r in problems.collect()) == [("a.jsonl", 3, "repeated id"), ("b.jsonl", 1, "repeated id")]
    assert sorted((r.id, r.line) for r in tasks.collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 2)]


def test_no_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n \n")
    tasks, problems = harness.scan_tasks(spark, str(tmp_path))
    assert tasks.collect() == problems.collect() == []
