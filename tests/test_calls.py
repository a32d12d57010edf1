"""Calls are made once; caches and checkpoints from the command line; guards."""

import asyncio
import json
import time

import numpy as np
import pytest

from millrace.external import calls
from pyspark.sql import functions as F

from millrace.cli import main
from millrace.external.backend import CallError, FakeBackend, register_backend
from millrace.external.calls import Cache, Calls, cached_calls, call_rows, embed_stored
from millrace.functions import text as T
from millrace.operators import dataset, stats, transforms
from millrace.sources import samples as S
from millrace.sources.shared import new_folder


def noting(path, answer=lambda last: f"n{last}", name="noting"):
    """A model that writes a line for each call."""

    def reply(messages):
        with open(path, "a") as f:
            f.write(messages[-1]["content"].replace("\n", " ") + "\n")
        return answer(messages[-1]["content"])

    return FakeBackend(name, reply)


def calls_in(path):
    return open(path).read().splitlines() if path.exists() else []


def turns(spark, n=10):
    return spark.range(n).select("id", F.col("id").alias("pos"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("q"), F.col("id")).alias("content"), F.lit(None).cast("map<string,string>").alias("extras"))).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))


@pytest.mark.parametrize("name, a_row", [("generate_last_turn", 1), ("generate_every_turn", 1), ("classify_coding_task", 1), ("translate", 1)])
def test_each_row_is_called_once(spark, tmp_path, name, a_row):
    log = tmp_path / "log"
    answer = (lambda last: "x\ntask: QA" if last.endswith(("1", "2", "3")) else "none") if name == "classify_coding_task" else (lambda last: f"n{last}")
    rows = turns(spark)
    if name == "translate":
        rows = rows.withColumn("messages", F.concat("messages", F.transform("messages", lambda m: F.struct(F.lit("assistant").alias("role"), m["content"].alias("content"), m["extras"].alias("extras")))))
    done, rejected = getattr(transforms, name)(rows, noting(log, answer))
    for k, df in enumerate((done, rejected)):
        df.write.parquet(str(tmp_path / str(k)))
    assert done.count() + rejected.count() == 10
    assert len(calls_in(log)) == 10 * a_row


def test_programs_run_once(spark, tmp_path):
    log = tmp_path / "log"
    code = F.concat(F.lit(f"open('{log}', 'a').write('x')\nprint("), F.col("id"), F.lit(")"))
    rows = turns(spark, 4).withColumn("messages", F.concat("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("```python\n"), code, F.lit("\n```")).alias("content"), F.lit(None).cast("map<string,string>").alias("extras")))))
    done, rejected = transforms.generate_pot_sample(rows, FakeBackend(answer=lambda m: "words"), allow=True, timeout=8.0)
    assert done.count() == 4 and rejected.count() == 0 and log.read_text() == "x" * 4


def test_modes(spark):
    df = spark.range(40).select("id", F.col("id").cast("string").alias("p")).coalesce(1)
    async def later(text):
        await asyncio.sleep(0.001)
        return text + "!"

    def made(text):
        time.sleep(0.005)
        if text == "7":
            raise CallError("x" * 5000)
        return text + "!"

    for mode in ("thread", "coroutine", "serial"):
        rows = {r.id: r for r in call_rows(df, "id", "p", made, 4, mode).collect()}
        assert len(rows) == 40 and rows[8].value == "8!" and not rows[7].ok and rows[7].error == "x" * 5000
    assert {r.value for r in call_rows(df, "id", "p", later, 4, "coroutine").collect()} == {f"{k}!" for k in range(40)}
    with pytest.raises(ValueError):
        call_rows(df, "id", "p", made, 4, "none")


def test_an_earlier_result_outlives_later_ones(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    frame = lambda n: spark.range(n).select("id", F.col("id").cast("string").alias("p"))
    first = cached_calls(frame(5), "id", "p", str.upper, cache, "f")
    second = cached_calls(frame(9), "id", "p", str.upper, cache, "f")
    assert first.count() == 5 and second.count() == 9 and first.count() == 5


def test_command_line_calls(spark, tmp_path):
    source, out, log = str(tmp_path / "a.json"), str(tmp_path / "out.json"), tmp_path / "log"
    (tmp_path / "a.json").write_text(json.dumps([{"messages": [{"role": "user", "content": f"q{k}"}]} for k in range(10)]))
    register_backend(noting(log, name="noting"))
    run = lambda *more: main(["generate", "--source-file", source, "--output-file", out, "--failure-file", str(tmp_path / "bad.json"), "--process-function", "generate_last_turn", "--model", "noting", *more], spark)
    run("--num-workers", "2", "--call-mode", "coroutine")
    assert len(calls_in(log)) == 10 and [m["messages"][1]["content"] for m in json.loads(open(out).read())] == [f"nq{k}" for k in range(10)]
    for _ in range(2):
        run("--cache-dir", str(tmp_path / "cache"))
    assert len(calls_in(log)) == 20
    run("--checkpoint-dir", str(tmp_path / "ranks"), "--checkpoint-interval", "4")
    assert len(calls_in(log)) == 30
    run("--checkpoint-dir", str(tmp_path / "ranks"), "--resume-from-checkpoint")
    assert len(calls_in(log)) == 30 and len(json.loads(open(out).read())) == 10
    register_backend(FakeBackend("failing", failures={"q3": 10**6}))
    with pytest.raises(ValueError):
        run("--resume-from-checkpoint")


def test_reruns(spark, tmp_path):
    log = tmp_path / "log"

    def once(text):
        with open(log, "a+") as f:
            f.seek(0)
            seen = f.read().split()
            f.write(text + "\n")
        if text == "3" and seen.count("3") < 2:
            raise CallError("not yet")
        return text

    df = spark.range(6).select("id", F.col("id").cast("string").alias("p"))
    for reruns, ok in ((1, 5), (3, 6), (-1, 6)):
        log.unlink(missing_ok=True)
        assert Calls(reruns=reruns).run(df, "id", "p", once, "s").where("ok").count() == ok


def test_stored_embeddings(spark, tmp_path):
    log = tmp_path / "log"

    def lengths(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id long, text string")
    first = embed_stored(df, "text", lengths, str(tmp_path / "v"), "m")
    second = embed_stored(df.union(spark.createDataFrame([(5, "ccc")], df.schema)), "text", lengths, str(tmp_path / "v"), "m")
    assert {r.id: r.embedding for r in second.collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: None, 5: [3.0]}
    assert first.count() == 4 and sorted(calls_in(log)) == ["a", "bb", "ccc"]


def test_ids_that_have_gaps(spark):
    df = spark.createDataFrame([(0, 0), (5, 5)], "id long, pos long")
    assert sorted(r.id for r in dataset.merge(df, df, df).collect()) == [0, 5, 6, 11, 12, 17]
    assert sorted(r.id for r in S.concat(df.limit(0), df).collect()) == [0, 5]


def test_output_guards(spark, tmp_path):
    source = tmp_path / "a.json"
    source.write_text(json.dumps([{"messages": [{"role": "user", "content": "q"}]}]))
    (tmp_path / "folder.json").mkdir()
    with pytest.raises(IsADirectoryError):
        main(["merge", "--source-file", str(source), "--output-file", str(tmp_path / "folder.json")], spark)
    with pytest.raises(ValueError):
        main(["generate", "--source-file", str(source), "--output-file", str(tmp_path / "x" / "o.json"), "--failure-file", str(tmp_path / "y" / "f.json"), "--process-function", "generate_for_test"], spark)
    main(["merge", "--source-file", str(source), "--output-file", str(tmp_path / "new" / "o.json")], spark)
    assert json.loads((tmp_path / "new" / "o.json").read_text())[0]["messages"][0]["content"] == "q"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError):
        new_folder(Session(), "x")


def test_program_parts_against_the_pattern(spark):
    import random
    import re

    pattern = re.compile(r"^(.*)(\n```python\n.*\n```\n)(\n```output\n.*\n```\n)(.*)", re.S)
    r = random.Random(1)
    pieces = ["\n```python\n", "\n```\n", "\n```output\n", "\n```\n\n```output\n", "a", "é\n", "```", "\n", " "]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 14))) for _ in range(3000)] + [None, "", "x\n```python\ny\n```\n\n```output\nz\n```\ns" * 3]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").select("id", T.program_parts(F.col("t")).alias("p")).collect()
    hits = 0
    for row in got:
        m = pattern.match(texts[row.id]) if texts[row.id] is not None else None
        assert (row.p is not None) == (m is not None)
        if m:
            hits += 1
            assert list(row.p) == [x.strip() for x in m.groups()]
    assert hits > 50


def test_reduced_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ np.diag([5.0, 3, 1, 0.5, 0.1]) + 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    for method, base in (("pca", x - x.mean(0)), ("svd", x)):
        _, _, axes = np.linalg.svd(base)
        got = np.array([r.reduced for r in stats.reduce_dimensions(df, 2, method=method).orderBy("id").collect()])
        want = x @ axes[:2].T
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_a_batch_is_not_held_at_once(spark):
    async def tasks_now(text):
        import asyncio

        return str(len(asyncio.all_tasks()))

    df = spark.range(3000).selectExpr("id", "cast(id as string) as payload").coalesce(1)
    got = calls.call_rows(df, "id", "payload", tasks_now, mode="coroutine").collect()
    assert [r.id for r in got] == list(range(3000)) and max(int(r.value) for r in got) <= calls.HELD + 2


def test_ranks_run_at_once(spark, tmp_path):
    """Each call waits until another rank's has begun."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def wait(text):
        import os
        import time

        (seen / text).touch()
        for _ in range(300):
            if len(os.listdir(seen)) > 1:
                return text
            time.sleep(0.1)
        raise RuntimeError("no other rank")

    df = spark.createDataFrame([(k, str(k)) for k in range(2)], "id long, payload string")
    got = calls.run_checkpointed(df, "id", "payload", wait, str(tmp_path / "run"), every=1).collect()
    assert sorted(r.value for r in got) == ["0", "1"]
