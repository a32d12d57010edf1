"""Duplicates, statistics, filters, transforms, calls, streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.external import calls
from millrace.external.backend import CallError, FakeBackend, Retry, RetryableError, get_backend, get_embedder, register_embedder
from millrace.operators import dedup, filters, stats, transforms
from millrace.sandbox import has_syntax_error, run_code, run_column, same_literal, status

MESSAGES = "id long, messages array<struct<role:string,content:string,extras:map<string,string>>>"
FENCE = "```"


def conv(spark, *rows):
    return spark.createDataFrame([(k, [(r, c, None) for r, c in m]) for k, m in enumerate(rows)], MESSAGES)


def kept(df):
    return sorted(r.id for r in df.collect())


def test_exact(spark):
    source = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, None)], "id long, text string")
    assert kept(dedup.exact_match(source, source.where("text = 'b'"))) == [0, 1, 3]
    assert kept(dedup.exact_match(source, source)) == [3]
    once = dedup.exact_match(source, source.where("text = 'b'"))
    assert kept(dedup.exact_match(once, source.where("text = 'b'"))) == [0, 1, 3]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert kept(dedup.embedding_similarity(df, threshold=0.9)) == [2, 3, 4]
    assert kept(dedup.embedding_similarity(df, threshold=0.9, keep="first")) == [0, 2, 3, 4]
    assert kept(dedup.embedding_similarity(df, df.where("id = 2"), threshold=1.0)) == [0, 1, 2, 3, 4]
    assert kept(dedup.embedding_similarity(df.where("id < 3"), threshold=0.1, measure="l2")) == [2]


@pytest.mark.parametrize("rows", [3, 1000])
def test_scores_against_numpy(spark, rows):
    x = np.random.default_rng(3).normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, embedding array<float>")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    got = stats.score_stats(df, rows=rows).first()
    assert (got["pairs"], got["mean"], got["std"], got["max"], got["min"]) == pytest.approx((1600, s.mean(), s.std(), s.max(), s.min()), abs=1e-8)
    np.fill_diagonal(s, -np.inf)
    best = {r.id: r.best for r in dedup.best_scores(df, rows=rows).collect()}
    assert [best[k] for k in range(40)] == pytest.approx(s.max(1))
    near = {(r.id, r["rank"]): r.other for r in dedup.nearest(df, k=3, rows=rows).collect()}
    assert all(near[k, j + 1] == np.argsort(-s[k])[j] for k in range(40) for j in range(3))


def test_distances_of_far_vectors(spark):
    """Squares of distances cancel far from the origin; the distances that are given don't. Of equal scores the least id is the nearest."""
    x = np.random.default_rng(4).normal(size=(60, 6)) * 1e-4 + 1e5
    x[7] = x[3]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {r.id: r.best for r in dedup.best_scores(df, measure="l2", rows=25).collect()}[3] == 0
    near = {(r.id, r["rank"]): r.other for r in dedup.nearest(df.union(df.selectExpr("id + 100", "embedding")), df.where("id < 9"), rows=20).collect()}
    assert near[3, 1] == near[103, 1] == near[7, 1]


def test_blocks_meet_once(spark):
    """Each two blocks of a set are scored in one task, from both sides."""
    plan = dedup.best_scores(spark.createDataFrame([(k, [1.0, k * 1.0]) for k in range(50)], "id long, embedding array<float>"), rows=5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_jaccard_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefghij", k=r.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(t.split()) for t in texts]
    for t in (0.3, 0.5, 0.8):
        want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and x and y and len(x & y) / len(x | y) > t}
        assert {(p.a, p.b) for p in dedup.jaccard_pairs(df, threshold=t).collect()} == want
    assert kept(dedup.jaccard_similarity(df, df, threshold=0.99)) == [k for k, x in enumerate(sets) if not x]


def test_jaccard_in_blocks(spark, monkeypatch):
    """Sets of many sizes that all share words: blocks of few words, and nearly no pairs written but those above the threshold."""
    r = random.Random(6)
    base = [[f"w{int(r.paretovariate(0.7))}" for _ in range(r.choice((3, 8, 40, 41, 150)))] for _ in range(120)]
    texts = [" ".join(w if r.random() > 0.1 else f"x{r.random()}" for w in b) for b in base for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets, seen = [set(t.split()) for t in texts], {}
    write = dedup.written

    def keep(d, name):
        seen[name] = write(d, name)
        return seen[name]

    monkeypatch.setattr(dedup, "written", keep)
    monkeypatch.setattr(dedup, "BLOCK_WORDS", 700)
    monkeypatch.setattr(dedup, "TUPLES", 500)
    for t in (0.4, 0.7):
        seen.clear()
        want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and len(x & y) / len(x | y) > t}
        got = {(p.a, p.b): p.similarity for p in dedup.jaccard_pairs(df, threshold=t).collect()}
        assert got == pytest.approx(want) and len(want) > 50
        assert seen["near"].count() <= len(want)
    for words in (0, dedup.SMALL_WORDS):
        monkeypatch.setattr(dedup, "SMALL_WORDS", words)
        seen.clear()
        left = kept(dedup.jaccard_similarity(df, df.where("id % 3 = 0"), threshold=0.4))
        assert left == [a for a, x in enumerate(sets) if not any(len(x & y) / len(x | y) > 0.4 for y in sets[::3])]
        assert ("near" in seen) == (words == 0)


def test_statistics(spark):
    df = conv(spark, [("human", "a"), ("assistant", "b")], [("system", "s"), ("user", "a"), ("user", "b")])
    assert {r.rounds: r.n for r in stats.rounds_histogram(df).collect()} == {1: 1, 2: 1}
    observed, seen = stats.counted(df)
    observed.collect()
    assert seen.get["n"] == 2
    text = spark.createDataFrame([("x" * n,) for n in (1, 1024, 1025, 200_000)], "text string")
    assert {r.bin: r.n for r in stats.length_histogram(text, F.col("text")).collect()} == {1024: 2, 2048: 1, None: 1}
    votes = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1), (2, None)], "k long, v long")
    assert [tuple(r) for r in stats.agreement(votes, "k", "v").collect()] == [(0, 1)]
    df = spark.createDataFrame([(k, [float(k), float(k * k), 1.0]) for k in range(9)], "id long, embedding array<float>")
    assert len(stats.reduce_dimensions(df, 2).first().reduced) == 2
    assert len(stats.reduce_dimensions(df, 2, method="svd").first().reduced) == 2


def test_filters(spark):
    code = f"x\n{FENCE}python\nprint(1)\n{FENCE}\n\n{FENCE}output\n1\n{FENCE}\ny"
    df = conv(spark, [("user", "q"), ("assistant", code)], [("user", "q"), ("assistant", code.replace("print(1)", "print(2)"))], [("user", "q"), ("assistant", "no code")], [("user", "q"), ("assistant", f"{FENCE}python\nwhile True: pass\n{FENCE}")], [("user", "q"), ("assistant", f"{FENCE}python\nx = (\n{FENCE}")])
    assert kept(filters.filter_samples(df, "has_python_code")) == [0, 1, 3, 4]
    assert kept(filters.filter_samples(df, "is_single_turn", dry_run=True)) == [0, 1, 2, 3, 4]
    assert kept(filters.filter_samples(df, "is_pot_output_regular", strict=False)) == [0, 1]
    with pytest.raises(Exception, match="program-of-thought"):
        filters.filter_samples(df, "is_pot_output_regular").collect()
    assert kept(filters.filter_samples(df, "has_syntax_error", strict=False)) == [4]
    assert kept(filters.filter_samples(df, "can_python_code_run", allow=True, timeout=1.0)) == [0, 1]
    assert kept(filters.filter_samples(df, "python_code_run_result_correct", allow=True)) == [0]
    with pytest.raises(PermissionError):
        filters.filter_samples(df, "can_python_code_run")
    assert kept(filters.filter_samples(df, "is_overlong", threshold=20, template=False)) == [0, 1]
    with pytest.raises(ValueError):
        filters.filter_samples(df, "nothing")
    with pytest.raises(Exception, match="assistant"):
        filters.filter_samples(conv(spark, [("user", "q")]), "has_python_code").collect()


def test_sandbox(spark):
    assert run_code("print(1)") == (False, 0, "1\n", "")
    assert run_code("while True: pass", timeout=0.5)[0]
    assert len(run_code("print('x' * 9999)")[2]) == 2048
    programs = ["print(1)", "assert False", "x = (", "1/0", None, "import sys; sys.exit(3)"]
    df = run_column(spark.createDataFrame(list(enumerate(programs)), "k int, code string"), "code", allow=True)
    assert [r[0] for r in df.orderBy("k").select(status(F.col("run"))).collect()] == ["ok", "assertion_error", "syntax_error", "error", None, "error"]
    assert [r[0] for r in df.orderBy("k").select(has_syntax_error("code")).collect()] == [False, False, True, False, None, False]
    pairs = spark.createDataFrame([("[1, 2]", "[1,2]"), ("a ", "a"), ("1", "2"), (None, "1")], "a string, b string")
    assert [r[0] for r in pairs.select(same_literal("a", "b")).collect()] == [True, True, False, None]


def test_drop_last_human(spark):
    df = conv(spark, [("human", "a"), ("assistant", "b"), ("human", "c")], [("system", "s"), ("human", "a"), ("assistant", "b")], [("human", "a"), ("assistant", "b")], [("assistant", "a"), ("human", "b"), ("human", "c")], [("system", "s"), ("human", "a"), ("human", "b")])
    done, rejected = transforms.drop_last_human_message(df)
    assert {r.id: len(r.messages) for r in done.collect()} == {0: 2, 1: 3}
    assert kept(rejected) == [2, 3, 4] and all(r.reason for r in rejected.collect())


def test_generation(spark):
    df = conv(spark, [("user", "q"), ("assistant", "old")], [("user", "q")], [("system", "s")])
    done, rejected = transforms.generate_last_turn(df, FakeBackend(answer=lambda m: f"n{len(m)}"))
    assert {r.id: [m.content for m in r.messages] for r in done.collect()} == {0: ["q", "n1"], 1: ["q", "n1"]} and kept(rejected) == [2]
    done, _ = transforms.generate_every_turn(conv(spark, [("user", "a"), ("assistant", "x"), ("user", "b")]), FakeBackend(answer=lambda m: f"n{len(m)}"))
    assert [m.content for m in done.first().messages] == ["a", "n1", "b", "n3"]
    done, rejected = transforms.classify_programming_language(conv(spark, [("user", "q")]), FakeBackend(answer=lambda m: "so\nprogramming language: Python"))
    assert done.first().messages[0].extras == {"programming_language": "python"} and not rejected.count()
    same = [FakeBackend(f"m{k}", answer=lambda m: "so\ntask: QA") for k in range(2)]
    done, _ = transforms.find_code_agreement(conv(spark, [("user", "q")]), same)
    assert done.first().messages[0].extras == {"coding_task": "qa"}
    _, rejected = transforms.find_code_agreement(conv(spark, [("user", "q")]), [same[0], FakeBackend("o", answer=lambda m: "so\ntask: Debug")])
    assert rejected.first().reason == "the models differ"
    program = conv(spark, [("user", "q"), ("assistant", f"{FENCE}python\nprint(7)\n{FENCE}")], [("user", "q"), ("assistant", "none")])
    done, rejected = transforms.generate_pot_sample(program, FakeBackend(answer=lambda m: "words"), allow=True)
    assert done.first().messages[2].content == f"words\n{FENCE}python\nprint(7)\n{FENCE}\n\n{FENCE}output\n7\n{FENCE}\nwords" and kept(rejected) == [1]
    bash = FakeBackend(answer=lambda m: f"{FENCE}bash\necho 7\n{FENCE}")
    done, rejected = transforms.translate_python_to_bash(program, bash, runner=lambda c: "Success")
    assert done.first().messages[1].content == f"{FENCE}bash\necho 7\n{FENCE}" and kept(rejected) == [1]
    zh = FakeBackend(answer=lambda m: "question: 问\nanswer: 答\nground_truth: 42")
    done, rejected = transforms.translate(conv(spark, [("user", "q"), ("assistant", "a")]), zh)
    assert [m.content for m in done.first().messages] == ["问", "答"] and done.first().messages[1].extras == {"ground_truth": "42"}


def test_calls(spark, tmp_path):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "id long, payload string")

    def once(text):
        if text in ("p3", "p7"):
            raise CallError("no")
        return text.upper()

    rows = {r.id: r for r in calls.call_rows(df, "id", "payload", once).collect()}
    assert rows[1].value == "P1" and not rows[3].ok and rows[3].error_class == "CallError"
    with pytest.raises(Exception, match="odd"):
        calls.call_rows(df, "id", "payload", lambda t: (_ for _ in ()).throw(RuntimeError("odd"))).collect()

    folder = str(tmp_path / "run")
    whole = {(r.id, r.ok, r.value) for r in calls.run_checkpointed(df, "id", "payload", once, str(tmp_path / "other")).collect()}
    got = calls.run_checkpointed(df, "id", "payload", once, folder, every=5)
    assert {(r.id, r.ok, r.value) for r in got.collect()} == whole
    # a run cut off after two ranks goes on with the third
    import shutil

    shutil.rmtree(f"{folder}/ranks/000002")
    calls_seen = tmp_path / "seen"
    calls_seen.mkdir()

    def noted(text):
        (calls_seen / text).touch()
        return once(text)

    got = calls.run_checkpointed(df, "id", "payload", noted, folder, every=5, resume=True)
    assert {(r.id, r.ok, r.value) for r in got.collect()} == whole and sorted(p.name for p in calls_seen.iterdir()) == ["p10", "p11"]
    again = calls.run_checkpointed(df, "id", "payload", lambda t: t.upper() if t != "p7" else once(t), folder, resume=True, reruns=2)
    assert {r.id for r in again.where("not ok").collect()} == {7} and {r.attempt for r in again.where("id in (3, 7)").collect()} == {1, 2}


def test_cache(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id long, payload string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def noted(text):
        import uuid

        (seen / uuid.uuid4().hex).touch()
        return text.upper()

    cache = calls.Cache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        assert {(r.id, r.value) for r in calls.cached_calls(df, "id", "payload", noted, cache, "f").collect()} == {(0, "A"), (1, "A"), (2, "B")}
    assert len(list(seen.iterdir())) == 2
    calls.cached_calls(df, "id", "payload", noted, cache, "g").collect()
    assert len(list(seen.iterdir())) == 4


def test_backends():
    fake = FakeBackend(failures={"x": 2})
    waits = []
    assert Retry(attempts=3, jitter=0).call(lambda: fake.chat([{"role": "user", "content": "x"}], {}), waits.append)
    assert waits == [0.5, 1.0]
    with pytest.raises(RetryableError):
        Retry(attempts=1).call(lambda: FakeBackend(failures={"x": 2}).chat([{"role": "user", "content": "x"}], {}))
    with pytest.raises(ValueError):
        get_backend("none")
    register_embedder("unit", lambda texts: [[1.0]] * len(texts))
    assert get_embedder("unit-large")(["a"]) == [[1.0]]
    with pytest.raises(ValueError):
        get_embedder("none")


def test_http(tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from millrace.external.backend import HttpBackend, HttpRunner, chat_once

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            bad = body.get("model") == "busy" and len(seen) < 2
            self.send_response(503 if bad else 400 if body.get("model") == "wrong" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"status": "Success", "choices": [{"text": "t"} if "prompt" in body else {"message": {"content": "m"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    turn = [{"role": "user", "content": "hi"}]
    quick = Retry(attempts=3, first=0, jitter=0)
    assert chat_once(HttpBackend("busy", url), turn, {"temperature": 0}, quick) == "m" and len(seen) == 2 and seen[1][1]["temperature"] == 0
    assert chat_once(HttpBackend("x", url, completion=True), turn, {}, quick) == "t" and seen[-1][0] == "/completions"
    with pytest.raises(CallError):
        chat_once(HttpBackend("wrong", url), turn, {}, quick)
    assert HttpRunner(url)("echo 1") == "Success" and seen[-1][1] == {"code": "echo 1", "language": "bash"}
    server.shutdown()


def test_embed(spark):
    df = spark.createDataFrame([("a",), (None,), ("bcd",)], "text string")
    assert [r.embedding for r in calls.embed(df, "text", lambda ts: [[float(len(t))] for t in ts], batch=1).collect()] == [[1.0], None, [3.0]]


def test_stream(spark, sf, tmp_path):
    from millrace.streaming import samples as S

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.drop_repeats(S.read_stream(spark, str(tmp_path / "in"), events), "ts", "400 days", "user_id", "event_type")
    S.run_once(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id", "event_type").distinct().count()
    S.run_once(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id", "event_type").distinct().count()
