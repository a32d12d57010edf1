"""The command line, end to end on small files."""

import json

import pytest

from millrace.cli import main, parser
from millrace.tasks import TASKS


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"messages": [{"role": "user", "content": f"q{k}"}, {"role": "assistant", "content": f"a{k % 3}", "id": 9 - k}]} for k in range(10)]))
    return str(path)


def read(path):
    return [m["messages"][0]["content"] for m in json.loads(open(path).read())]


def test_tasks(spark, source, tmp_path):
    out = str(tmp_path / "out.json")
    run = lambda *a: main([*a, "--source-file", source, "--output-file", out], spark)
    run("merge")
    assert read(out) == [f"q{k}" for k in range(10)]
    run("sample", "--num", "3")
    assert len(read(out)) == 3
    run("sort")
    assert read(out) == [f"q{k}" for k in range(9, -1, -1)]
    run("filter", "--filter-function", "is_single_turn")
    assert len(read(out)) == 10
    run("filter", "--filter-function", "is_overlong", "--partial-kwargs", "threshold=1000")
    assert read(out) == []
    run("dedup")
    assert read(out) == []
    other = tmp_path / "b.json"
    other.write_text(json.dumps(json.loads(open(source).read())[:4]))
    main(["dedup", "--source-file", source, "--reference-file", str(other), "--output-file", out], spark)
    assert read(out) == [f"q{k}" for k in range(4, 10)]
    run("generate", "--process-function", "generate_for_test")
    assert json.loads(open(out).read())[0]["messages"][1]["content"].startswith("echo:")
    parts = main(["split", "--source-file", source, "--output-dir", str(tmp_path), "--ratios", "8", "1", "1"], spark)
    assert [p.rsplit("/", 1)[-1] for p in parts] == ["a_3.ratio_0.80.part_0.json", "a_3.ratio_0.10.part_1.json", "a_3.ratio_0.10.part_2.json"] and [len(read(p)) for p in parts] == [8, 1, 1]
    assert main(["analyze", "--source-file", source, "--item", "rounds"], spark) == [(1, 10)]
    assert main(["analyze", "--source-file", source], spark) == [(1024, 10)]
    assert main(["watch", "--source-file", source, "--pattern", "q7|q2", "--start", "5", "--num", "2"], spark) == ["user: ==**__q7__**==\nassistant: a1", "user: ==**__q2__**==\nassistant: a2"]


def test_own_functions(spark, source, tmp_path):
    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\nfrom millrace.registry import predicate\n\n@predicate('third')\ndef third(k=3):\n    return F.col('id') % k == 0\n")
    out = str(tmp_path / "out.json")
    main(["filter", "--source-file", source, "--output-file", out, "--filter-function", "third", "--functions", str(tmp_path / "own.py")], spark)
    assert read(out) == ["q0", "q3", "q6", "q9"]


def test_chat(spark):
    said = []
    lines = iter(["hello", "clear", "again", ""])
    history = TASKS["chat"](spark, "fake", read=lambda _: next(lines), say=said.append)
    assert len(said) == 2 and [m["role"] for m in history] == ["user", "assistant"]


def test_parser():
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
