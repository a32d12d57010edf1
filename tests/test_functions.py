"""Scalar functions and predicates by table."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import labels, plain
from millrace.functions import messages as M
from millrace.functions import text as T
from millrace.functions.language import detect_language

FENCE = "```"


def values(spark, function, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[1] for r in rows.select("k", function(F.col("x"))).orderBy("k").collect()]


CODE = {
    f"pre\n{FENCE}python\nprint(1)\n{FENCE}\n\n{FENCE}output\n1\n{FENCE}\nsum": "print(1)\n",
    "none": None,
    f"{FENCE} \n\nx{FENCE}": "x",
    f"{FENCE}\n{FENCE}": "",
    f"{FENCE}\n   \n{FENCE}": "",
    f"{FENCE}py\nA\n{FENCE} {FENCE}sh\nB\n{FENCE}": "A\n",
    f"{FENCE}python x\nA\n{FENCE}": None,
    f"text {FENCE} inline {FENCE} \n{FENCE}py\nA\n{FENCE}": "A\n",
}


def test_extract_code(spark):
    assert values(spark, T.extract_code, CODE) == list(CODE.values())
    assert values(spark, T.has_code_block, CODE) == [bool((v or "").strip()) for v in CODE.values()]


def pot(middle="\n"):
    return f"comp\n{FENCE}python\nprint(1)\n{FENCE}\n{middle}{FENCE}output\n1\n{FENCE}\nsum"


def test_program_parts(spark):
    empty = f"comp\n{FENCE}python\nx\n{FENCE}\n\n{FENCE}output\n\n{FENCE}\ns"
    bare = f"comp\n{FENCE}python\nx\n{FENCE}\n\n{FENCE}output\n{FENCE}\ns"
    two = pot() + "\n" + pot()
    got = values(spark, T.program_parts, [pot(), pot(""), bare, empty, two, "é" * 100_000 + pot()])
    assert tuple(got[0]) == ("comp", f"{FENCE}python\nprint(1)\n{FENCE}", f"{FENCE}output\n1\n{FENCE}", "sum")
    assert got[1] is None and got[2] is None and got[3] is not None
    assert got[4].comprehension.count("output") == 1 and got[4].summary == "sum"
    assert got[5] is not None
    assert values(spark, T.program_output, [pot(), empty]) == ["1", ""]


def test_steps(spark):
    step = f"{FENCE}python\na\n{FENCE}{{}}{FENCE}output\nb\n{FENCE}"
    assert values(spark, T.count_steps, [step.format("\n") + "t" + step.format("\n\n"), step.format(" "), f"{FENCE}python\na\n{FENCE} t {step}".format("\n")]) == [2, 0, 1]


def test_remove_output(spark):
    text = f"a{FENCE}output\n1{FENCE}b{FENCE}output\n1\n2\n{FENCE}c"
    assert values(spark, T.remove_output, [text, f"{FENCE}output\nx{FENCE}"]) == ["abc", None]
    assert values(spark, T.extract_output, [text, "x"]) == ["1", None]


def test_render_think(spark):
    cases = {"<think>\na\nb\n</think>\nans": "> a\n> b\nans", "<think></think>x": "x", "no": "no", "<think>a<think>b</think>c<think>d</think>": "> a<think>bc> d", "": "", "<think>open": "<think>open"}
    assert values(spark, T.render_think, cases) == list(cases.values())


def test_detect_language(spark):
    cases = {"hello": "en", "hello world": "unknown", "": "unknown", "中文": "zh", "über": "de", "été": "fr", "été ü": "de", "한": "kr", "Привет": "ru", "ひ中": "jp", "中ひ": "zh", "ü 中": "zh"}
    assert values(spark, detect_language, cases) == list(cases.values())
    assert values(spark, lambda x: detect_language(x, relaxed=True), ["hello, world!", "12", "olá"]) == ["en", "unknown", "unknown"]


@pytest.mark.parametrize(("n", "said"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (20, "20th"), (21, "21st"), (112, "112th")])
def test_ordinal(spark, n, said):
    assert spark.range(1).select(T.ordinal(F.lit(n))).first()[0] == said


def test_replace_prefix_question(spark):
    assert values(spark, lambda x: T.replace_from_right(x, ".json", ".rerun.json"), ["a.json"]) == ["a.rerun.json"]
    assert values(spark, lambda x: T.replace_from_right(x, "a", "b", 2), ["aaxa", "a", ""]) == ["abxb", "b", ""]
    assert values(spark, lambda x: T.prefix_match(F.lit(" He"), x), ["hello", "oh"]) == [True, False]
    text = "question: q\nanswer: a\nground_truth: 42"
    assert tuple(values(spark, T.question_parts, [text])[0]) == ("q", "a", "42")
    assert values(spark, lambda x: T.question_parts(x, as_written=True)["ground_truth"], [text]) == ["4"]
    assert values(spark, T.question_parts, ["question: q\nanswer: a"]) == [None]


def test_highlight(spark):
    assert values(spark, lambda x: T.highlight(x, "a.c"), ["xabc a\nc", "none", "a$c"]) == ["x==**__abc__**== ==**__abc__**==", "none", "==**__a$c__**=="]


def test_kwargs():
    assert plain.parse_kwargs("tokenizer=Qwen/Qwen-14B, threshold=1024") == {"tokenizer": "Qwen/Qwen-14B", "threshold": 1024}
    assert plain.parse_kwargs("a=[1, (2, 3)], b='x, y', c={'k': None}") == {"a": [1, (2, 3)], "b": "x, y", "c": {"k": None}}
    assert plain.parse_kwargs("") == {}
    with pytest.raises(ValueError):
        plain.parse_kwargs("a")


def test_labels():
    cases = {"python": "python", "javascript (node)": "javascript", "typescript.": "typescript", "pythn": "other", "c++": "c++", "golang": None, "zig": None, "x" * 42: None}
    assert {a: labels.closest(a, labels.LANGUAGES) for a in cases} == cases


def test_names_and_times(spark):
    assert plain.part_name("a", 0.8, 0, 3) == "a_3.ratio_0.80.part_0.json"
    assert len(plain.timestamp()) == 14
    assert str(values(spark, plain.parse_timestamp, ["20240102030405", "x"])) == "[datetime.datetime(2024, 1, 2, 3, 4, 5), None]"
    keys = spark.range(1).select(plain.cache_key("f", "1", F.lit("x")), plain.cache_key("g", "1", F.lit("x"))).first()
    assert keys[0] != keys[1]


ROLES = {("human", "assistant"): True, ("system", "human", "assistant"): True, ("human", "human", "assistant"): True, ("human", "assistant", "human"): True, ("assistant", "tool", "human"): True, ("human", "human", "human", "assistant"): False, ("assistant",): False, ("user", "assistant"): True}


def test_single_turn(spark):
    rows = spark.createDataFrame([(k, [(r, "x", None) for r in roles]) for k, roles in enumerate(ROLES)], "k int, messages array<struct<role:string,content:string,extras:map<string,string>>>")
    assert [r[1] for r in rows.select("k", M.is_single_turn(F.col("messages"))).orderBy("k").collect()] == list(ROLES.values())
    assert rows.select("k", M.is_single_turn(F.col("messages"), legacy=True).alias("x")).orderBy("k").collect()[-1].x is False
    assert rows.select(M.chat_template(F.col("messages"))).first()[0].startswith("<|im_start|>human\nx<|im_end|>\n")
    tagged = rows.select(M.tag_first(F.col("messages"), "t", F.lit("v")).alias("m")).first().m
    assert tagged[0].extras == {"t": "v"}
