"""Schemas, sample files and set-like operations."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import dataset, sampling
from millrace.sources import samples as S

CASES = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "id": 7}]}, "generic"),
    ([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "generic"),
    ({"question": "q", "answer_only": "1", "answer": "a", "split": "train"}, "gsm8k_en"),
    ({"question": "q", "answer_only": "1", "answer": "a", "split": "train", "question_zh": "z", "answer_zh": "w"}, "gsm8k_en"),
    ({"problem_ID": "1", "problem_cn": "c", "problem_en": "e", "answer": "a"}, "leetcode"),
    ({"problem": "p", "level": "L", "type": "t", "solution": "s"}, "math_en"),
    ({"query": "q", "response": "r", "type": "t"}, "meta_math_qa_en"),
    ({"problem": "p", "solution": "s", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "generic"),
    ({"foo": 1}, None),
    ({"messages": [{"role": "robot", "content": "x"}]}, None),
    ({"messages": [{"role": "user", "content": 1}]}, None),
    ({"messages": []}, None),
    ({"question": 1, "answer_only": "1", "answer": "a", "split": "train"}, None),
]


def test_detection(spark):
    raw = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(CASES)], "pos long, raw string")
    got = [r[0] for r in raw.orderBy("pos").select(schemas.detected(F.col("raw"))).collect()]
    assert got == [name for _, name in CASES]
    most = [r[0] for r in raw.orderBy("pos").select(schemas.detected(F.col("raw"), "most_specific")).collect()]
    assert most[3] == "gsm8k_zh" and most[7] == "numina"


def test_read_and_write(spark, tmp_path):
    items = [{"messages": [{"role": "user", "content": f"é{k}", "id": k}], "z": None, "tag": "x"} for k in range(5)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, items)) + "\n\n")
    both = S.read_samples(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")])
    rows = both.orderBy("pos").collect()
    assert [r.id for r in rows] == list(range(10)) and rows[7].messages[0].content == "é2" and rows[0].extras == {"tag": "x"} and rows[0].messages[0].extras == {"id": "0"}
    S.write_json_array(both, str(tmp_path / "out.json"))
    back = json.loads((tmp_path / "out.json").read_text())
    assert len(back) == 10 and back[3]["messages"][0]["content"] == "é3" and "z" not in back[3] and "é" in (tmp_path / "out.json").read_text()
    S.write_jsonl(both, str(tmp_path / "out_dir"))
    assert spark.read.text(str(tmp_path / "out_dir")).count() == 10
    assert json.loads(S.first_sample(spark, str(tmp_path / "b.jsonl"))) == items[0]
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(StopIteration):
        S.first_sample(spark, str(tmp_path / "empty.json"))
    assert S.read_samples(spark, str(tmp_path / "empty.json")).count() == 0
    with pytest.raises(ValueError):
        S.read_raw(spark, "x.csv")
    (tmp_path / "bad.json").write_text(json.dumps([*items, {"messages": [{"role": "robot", "content": "x"}]}]))
    with pytest.raises(Exception, match="not a generic sample"):
        S.read_samples(spark, str(tmp_path / "bad.json")).collect()
    assert S.read_samples(spark, str(tmp_path / "bad.json"), on_error="drop").count() == 5
    (tmp_path / "none.json").write_text('[{"foo": 1}]')
    with pytest.raises(TypeError):
        S.read_samples(spark, str(tmp_path / "none.json"))
    (tmp_path / "lists.json").write_text(json.dumps([[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]]))
    assert S.read_samples(spark, str(tmp_path / "lists.json"), schema="oai").first().text == "assistant: b"
    S.check_paths(spark, [str(tmp_path / "a.json")], [str(tmp_path / "new" / "x.json")])
    with pytest.raises(FileNotFoundError):
        S.check_paths(spark, [str(tmp_path / "gone.json")])
    assert S.file_lengths(spark, str(tmp_path / "a.json")).first().bytes == (tmp_path / "a.json").stat().st_size


def test_named_schemas(spark):
    raw = spark.createDataFrame([(0, json.dumps({"question": "q", "answer_only": "1", "answer": "a", "split": "test", "question_zh": "z", "answer_zh": "w"}))], "pos long, raw string")
    assert schemas.to_canonical(raw, "gsm8k_zh").first().text == "z\nw"
    raw = spark.createDataFrame([(0, json.dumps({"problem_ID": "1", "problem_cn": "c", "problem_en": "e", "answer": "a"}))], "pos long, raw string")
    assert schemas.to_canonical(raw, "leetcode").first().text == "Human:\ne\nAssistant:\na"
    assert schemas.to_canonical(raw, "leetcode_cn").first().text == " c a"


def ids(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*(columns or ("id",))).collect()]


def frame(spark, n):
    return spark.range(n).select("id", F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id")).alias("text"))


def test_dataset_operations(spark):
    df = frame(spark, 6)
    assert ids(dataset.select_by_ids(df, [4, 1])) == [4, 1]
    with pytest.raises(KeyError):
        dataset.select_by_ids(df, [9])
    assert sorted(ids(dataset.exclude_by_ids(df, [0, 5]))) == [1, 2, 3, 4]
    assert dataset.contains(df, [1, 2]) and not dataset.contains(df, [1, 9]) and dataset.contains(df, 0)
    assert sorted(ids(dataset.get(df, slice(1, 3)))) == [1, 2] and sorted(ids(dataset.get(df, slice(-2, None)))) == [4, 5]
    assert ids(dataset.get(df, 3)) == [3]
    assert dataset.upsert(df, spark.createDataFrame([(2, 2, "new"), (8, 8, "x")], "id long, pos long, text string")).where("text in ('new', 'x')").count() == 2
    assert sorted(ids(dataset.append(df, df.limit(2)))) == list(range(8))
    merged = dataset.merge(df, df)
    assert sorted(ids(merged)) == list(range(12))
    with pytest.raises(ValueError):
        dataset.merge(df, df.drop("text"))
    assert sorted(ids(dataset.intersect(df, frame(spark, 2)))) == [0, 1]
    assert dataset.merge(df, df, shuffled=True).count() == 12


def test_sort_is_stable(spark):
    df = spark.createDataFrame([(0, 0, "x", 2), (1, 1, "y", 1), (2, 2, "z", 2)], "id long, pos long, text string, k int")
    assert [r.text for r in dataset.sort(df, F.col("k"), reverse=True).orderBy("pos").collect()] == ["x", "z", "y"]
    assert [r.text for r in dataset.sort(df, F.col("k")).orderBy("pos").collect()] == ["y", "x", "z"]


@pytest.mark.parametrize(("n", "ratio", "k"), [(100, 0.29, 28), (1000, 0.015, 15), (10, 0.55, 5), (7, 0.5, 3)])
def test_sample_ratio(spark, n, ratio, k):
    assert sampling.sample(spark.range(n), ratio=ratio).count() == k


def test_large_samples_come_in_parallel(spark, monkeypatch):
    """The same rows in the same order as by one top-k, of equal ids too, without a limit of all behind the sort."""
    df = spark.range(3000).selectExpr("id % 1000 as id", "id as n").repartition(7)
    few = sampling.sample(df, num=1000)
    monkeypatch.setattr(sampling, "FEW", 100)
    many = sampling.sample(df, num=1000)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit 1000" not in plan and plan.startswith("Sort")
    assert ids(many) == ids(few)


def test_sample_parity(spark):
    assert ids(sampling.sample(spark.range(1000), num=10, parity=True)) == [654, 114, 25, 759, 281, 250, 228, 142, 754, 104]
    with pytest.raises(ValueError):
        sampling.sample(spark.range(3), num=4)
    assert sampling.dry_run(spark.range(3)).count() == 3


@pytest.mark.parametrize(("n", "ratios", "sizes"), [(10, (1, 1, 1), [3, 3, 4]), (10, (8, 1, 1), [8, 1, 1]), (7, (0.5, 0.5), [3, 4]), (3, (1, 1, 1, 1), [0, 0, 0, 3])])
def test_split_sizes(spark, n, ratios, sizes):
    assert [b - a for a, b in sampling.part_bounds(n, ratios)] == sizes
    parts = sampling.split(spark.range(n), ratios)
    assert [p.count() for p in parts] == sizes
    assert sorted(i for p in sampling.split(spark.range(n), ratios, randomly=True) for i in ids(p)) == list(range(n))


@settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.lists(st.floats(0.01, 100), min_size=1, max_size=6))
def test_parts_cover(n, ratios):
    bounds = sampling.part_bounds(n, ratios)
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:])) and all(a <= b for a, b in bounds)


def test_lines_keep_the_order_of_their_files(spark, tmp_path):
    """Spark reads large splits first; positions go by file and by place within it."""
    folder, n = tmp_path / "many.jsonl", 0
    folder.mkdir()
    for k in range(6):
        lines = [json.dumps({"n": n + j, "x": "y" * 900}) for j in range(1 + 40 * k)]
        (folder / f"part-{k:05d}.txt").write_text("\n\n".join(lines) + "\n")
        n += len(lines)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = S.read_raw(spark, str(folder)).orderBy("pos").collect()
        assert [(r.pos, json.loads(r.raw)["n"]) for r in got] == [(k, k) for k in range(n)]
        assert json.loads(S.first_sample(spark, str(folder)))["n"] == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
