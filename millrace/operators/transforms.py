"""Per-row transforms of canonical rows. Each gives (done, rejected); rejected rows are the source's, with a reason."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..external.backend import Backend, FakeBackend, answer_of
from ..external.calls import Calls, chat_function, chat_payload
from ..functions import labels
from ..functions import messages as M
from ..functions import text as T
from ..functions.language import NAMES, detect_language
from ..registry import transform
from ..sandbox import run_column
from ..sources.shared import written

Result = tuple[DataFrame, DataFrame]


def _divide(df: DataFrame, reason: Column, messages: Column) -> Result:
    """Rows with new messages where ``reason`` is null, and the others as they are."""
    marked = df.withColumn("_reason", reason)
    done = marked.where("_reason is null").withColumn("messages", messages).drop("_reason")
    return done, marked.where("_reason is not null").withColumnRenamed("_reason", "reason")


def _at(k: int) -> Column:
    return M.role(M.at(F.col("messages"), k))


@transform("drop_last_human_message")
def drop_last_human_message(df: DataFrame) -> Result:
    """Without a human message at the end. A conversation has more than two messages, begins with system and human or human and assistant, and keeps one of either."""
    m = F.col("messages")
    last_is_human = F.coalesce(_at(-1) == "user", F.lit(False))
    left = F.when(last_is_human, F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    begins = F.when(_at(1) == "system", _at(2) == "user").when(_at(1) == "user", _at(2) == "assistant").otherwise(False)
    reason = F.when(F.size(m) <= 2, "two messages or fewer").when(~F.coalesce(begins, F.lit(False)), "a wrong beginning").when((M.count_role(left, "user") == 0) | (M.count_role(left, "assistant") == 0), "a role is missing")
    return _divide(df, reason, left)


def _rewrite(df: DataFrame, shape: Callable[[Column], Column]) -> Result:
    m = F.col("messages")
    answer = F.when(M.role(M.last(m)) == "assistant", M.last(m)["content"])
    df = df.withColumn("_parts", T.program_parts(answer))
    parts = F.col("_parts")
    empty = (parts["comprehension"] == "") | (parts["code"] == "") | (parts["output"] == "") | (parts["summary"] == "")
    reason = F.when(answer.isNull(), "the last message isn't the assistant's").when(parts.isNull(), "not a program-of-thought answer").when(empty, "a part is empty")
    done, rejected = _divide(df, reason, M.replace_last(m, shape(parts)))
    return done.drop("_parts"), rejected.drop("_parts")


@transform("rewrite_pot_remove_output")
def rewrite_pot_remove_output(df: DataFrame) -> Result:
    """Comprehension, code and summary, an empty line between."""
    return _rewrite(df, lambda p: F.concat_ws("\n\n", p["comprehension"], p["code"], p["summary"]))


@transform("rewrite_pot_remove_output_summary")
def rewrite_pot_remove_output_summary(df: DataFrame) -> Result:
    """Comprehension and code."""
    return _rewrite(df, lambda p: F.concat_ws("\n", p["comprehension"], p["code"]))


@transform("rewrite_pot_remove_summary")
def rewrite_pot_remove_summary(df: DataFrame) -> Result:
    """Comprehension, code and output."""
    return _rewrite(df, lambda p: F.concat_ws("\n", p["comprehension"], p["code"], p["output"]))


def ask(df: DataFrame, messages: Column, backend: Backend, params: Mapping[str, Any] | None = None, calls: Calls | None = None, key: str = "id", name: str = "answer") -> DataFrame:
    """``df``, whose ids are unique, with a struct (ok, value, error_class, error) of the model's answer to ``messages``.

    The calls are made here, once for each row, and written; reading the result doesn't call again.
    """
    how = calls or Calls()
    asked = df.withColumn("_ask", messages).select(key, chat_payload("_ask").alias("_payload"))
    called = how.run(asked, key, "_payload", chat_function(backend, params, how.retry), f"{backend.name}-{name.strip('_')}", repr(sorted((params or {}).items())))
    return df.join(called.select(key, F.struct("ok", "value", "error_class", "error").alias(name)), key)


def _answered(df: DataFrame, messages: Column, name: str = "answer") -> Result:
    reason = F.when(~F.col(f"{name}.ok"), F.coalesce(F.col(f"{name}.error"), F.lit("the call failed")))
    done, rejected = _divide(df, reason, messages)
    return done.drop(name), rejected.drop(name)


@transform("generate_last_turn")
def generate_last_turn(df: DataFrame, backend: Backend | None = None, calls: Calls | None = None, **params) -> Result:
    """A new answer at the end, in place of one that is there; the turn before must be a human's."""
    m = F.col("messages")
    asked = F.when(_at(-1) == "assistant", F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    ready, wrong = _divide(df, F.when(~F.coalesce(M.role(M.last(asked)) == "user", F.lit(False)), "no human turn to answer"), asked)
    done, failed = _answered(ask(ready, F.col("messages"), backend or FakeBackend(), params, calls), F.concat("messages", F.array(M.message("assistant", F.col("answer.value")))))
    return done, wrong.unionByName(failed, allowMissingColumns=True)


@transform("generate_for_test")
def generate_for_test(df: DataFrame, **params) -> Result:
    """:func:`generate_last_turn` with the model that needs no network."""
    return generate_last_turn(df, FakeBackend(), **params)


@transform("generate_every_turn")
def generate_every_turn(df: DataFrame, backend: Backend | None = None, calls: Calls | None = None, **params) -> Result:
    """Each human turn answered in order, with all before it as history."""
    import json

    model, how = backend or FakeBackend(), calls or Calls()

    def talk(payload: str) -> str:
        history: list[dict[str, str]] = []
        for turn in json.loads(payload):
            history.append(turn)
            answer = how.retry.call(lambda: answer_of(model.chat(history, params)))
            history.append({"role": "assistant", "content": answer})
        return json.dumps(history, ensure_ascii=False)

    human = F.filter("messages", lambda m: M.role(m) == "user")
    asked = df.withColumn("_ask", human)
    called = how.run(asked.select("id", chat_payload("_ask").alias("_p")), "id", "_p", talk, f"{model.name}-turns", repr(sorted(params.items()))).select("id", F.struct("ok", "value", "error_class", "error").alias("answer"))
    spoken = F.transform(F.from_json("answer.value", "array<struct<role:string,content:string>>"), lambda m: F.struct(m["role"], m["content"], F.lit(None).cast("map<string,string>").alias("extras")))
    return _answered(df.join(called, "id"), spoken)


def system_prompt(id_: Column, seed: int = 42) -> Column:
    """A system prompt put together from its variants by a hash of the id."""
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(id_, F.lit(seed + k)), F.lit(len(xs))) + 1).cast("int"))
    return F.concat_ws(" ", pick(0, ("You are a careful assistant.", "You solve problems with programs.", "You are a patient teacher.")), pick(1, ("Explain the task first, then write Python.", "Say what is asked, then give Python code.")), pick(2, ("Show the output and sum it up.", "End with the output and a summary.")))


@transform("generate_pot_sample")
def generate_pot_sample(df: DataFrame, backend: Backend | None = None, timeout: float = 3.0, allow: bool = False, calls: Calls | None = None, **params) -> Result:
    """A program-of-thought answer from a question and code: the code is run, and a model writes what is asked and what came out."""
    model = backend or FakeBackend()
    m = F.col("messages")
    question = F.filter(m, lambda x: M.role(x) == "user")
    coded = df.withColumn("_code", T.extract_code(M.last(m)["content"])).withColumn("_q", F.get(question, F.lit(0))["content"])
    ran = written(run_column(coded, "_code", "_run", timeout, allow), "runs")  # each program runs once
    reason = F.when(F.col("_code").isNull() | (T.strip(F.col("_code")) == ""), "no code").when(F.col("_q").isNull(), "no question").when(F.coalesce(F.col("_run.timeout") | (F.col("_run.exit_code") != 0), F.lit(True)), "the code doesn't run").when(T.strip(F.col("_run.stdout")) == "", "no output")
    ready, wrong = _divide(ran, reason, m)
    extra = ("_code", "_q", "_run")
    first = ask(ready, F.array(M.message("user", F.concat(F.lit("Say what this asks:\n"), F.col("_q")))), model, params, calls, name="_first")
    both = ask(first, F.array(M.message("user", F.concat(F.lit("Sum up this output:\n"), F.col("_run.stdout"), F.lit("\nof this task:\n"), F.col("_q")))), model, params, calls, name="_second")
    failed = F.when(~F.col("_first.ok") | ~F.col("_second.ok"), "the call failed")
    body = F.concat(F.col("_first.value"), F.lit("\n```python\n"), T.strip(F.col("_code")), F.lit("\n```\n\n```output\n"), T.strip(F.col("_run.stdout")), F.lit("\n```\n"), F.col("_second.value"))
    done, bad = _divide(both, failed, F.array(M.message("system", system_prompt(F.col("id"))), M.message("user", F.col("_q")), M.message("assistant", body)))
    more = (*extra, "_first", "_second")
    return done.drop(*more), wrong.drop(*extra).unionByName(bad.drop(*more))


def _classify(df: DataFrame, names: tuple[str, ...], tag: str, line: str, backend: Backend | None, params: Mapping[str, Any], calls: Calls | None) -> Result:
    order = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.xxhash64(n, "id").alias("h"), n.alias("n"))))
    prompt = F.concat(F.lit(f"Choose one and end with a line '{line}: NAME'. Names: "), F.array_join(F.transform(order, lambda x: x["n"]), ", "))
    told = F.array(M.message("system", prompt), M.message("user", M.to_str(F.col("messages"))))
    got = ask(df, told, backend or FakeBackend(), params, calls).withColumn("_label", labels.parse_label(names, line)(F.col("answer.value")))
    reason = F.when(~F.col("answer.ok"), F.col("answer.error")).when(F.col("_label").isNull(), "no label in the answer")
    done, rejected = _divide(got, reason, M.tag_first(F.col("messages"), tag, F.col("_label")))
    return done.drop("answer", "_label"), rejected.drop("answer", "_label")


@transform("classify_programming_language")
def classify_programming_language(df: DataFrame, backend: Backend | None = None, calls: Calls | None = None, **params) -> Result:
    """The first message tagged with the programming language that a model names."""
    return _classify(df, labels.LANGUAGES, "programming_language", "programming language", backend, params, calls)


@transform("classify_coding_task")
def classify_coding_task(df: DataFrame, backend: Backend | None = None, calls: Calls | None = None, **params) -> Result:
    """The first message tagged with the kind of coding task that a model names; the order of names differs by row."""
    return _classify(df, labels.CODING_TASKS, "coding_task", "task", backend, params, calls)


@transform("find_code_agreement")
def find_code_agreement(df: DataFrame, backends: Sequence[Backend] = (), tag: str = "coding_task", **params) -> Result:
    """Rows for which all models name the same label, tagged with it."""
    models = list(backends) or [FakeBackend("fake-a"), FakeBackend("fake-b")]
    votes = None
    for k, model in enumerate(models):
        done, _ = classify_coding_task(df, model, **params)
        one = done.select("id", F.lit(k).alias("k"), F.try_element_at(F.col("messages")[0]["extras"], F.lit("coding_task")).alias("vote"))
        votes = one if votes is None else votes.union(one)
    agreed = votes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("vote").alias("_d"), F.min("vote").alias("_vote"))
    both = df.join(agreed, "id", "left")
    reason = F.when(F.coalesce("_n", F.lit(0)) < len(models), "a model gave no label").when(F.col("_d") != 1, "the models differ")
    done, rejected = _divide(both, reason, M.tag_first(F.col("messages"), tag, F.col("_vote")))
    return done.drop("_n", "_d", "_vote"), rejected.drop("_n", "_d", "_vote")


@transform("translate_python_to_bash")
def translate_python_to_bash(df: DataFrame, backend: Backend | None = None, runner: Callable[[str], str] | None = None, calls: Calls | None = None, **params) -> Result:
    """The program of the last message written anew for another shell by a model, kept if ``runner`` says ``Success``; without a runner nothing is run and all are kept."""
    code = T.extract_code(M.last(F.col("messages"))["content"])
    ready, wrong = _divide(df.withColumn("_code", code), F.when(code.isNull(), "no code"), F.col("messages"))
    told = F.array(M.message("user", F.concat(F.lit("Write this Python program for Bash, in one fenced block:\n"), F.col("_code"))))
    got = ask(ready, told, backend or FakeBackend(), params, calls).withColumn("_new", T.extract_code(F.col("answer.value")))
    reason = F.when(~F.col("answer.ok"), F.col("answer.error")).when(F.col("_new").isNull(), "no code in the answer")
    body = F.concat(F.lit("```bash\n"), F.col("_new"), F.lit("```"))
    if runner is not None:
        ran = (calls or Calls()).run(got.select("id", "_new"), "id", "_new", lambda c: runner(c or ""), "runs").select("id", F.col("value").alias("_status"))
        got = got.join(ran, "id", "left")
        reason = reason.when(F.coalesce(F.col("_status") != "Success", F.lit(True)), "the program doesn't run")
    done, rejected = _divide(got, reason, M.replace_last(F.col("messages"), body))
    more = ("_code", "_new", "answer", "_status")
    return done.drop(*more), wrong.drop(*more).unionByName(rejected.drop(*more))


def translate(df: DataFrame, backend: Backend, source: str = "en", target: str = "zh", relaxed: bool = False, calls: Calls | None = None, **params) -> Result:
    """Question, answer and ground truth in another language: the model's text must be in it, and have the three parts."""
    m = F.col("messages")
    human, answer = F.get(F.filter(m, lambda x: M.role(x) == "user"), F.lit(0)), F.get(F.filter(m, lambda x: M.role(x) == "assistant"), F.lit(0))
    truth = F.coalesce(F.try_element_at(answer["extras"], F.lit("ground_truth")), F.lit(""))
    body = F.concat(F.lit("question: "), human["content"], F.lit("\nanswer: "), answer["content"], F.lit("\nground_truth: "), truth, F.lit("\n"))
    ready, wrong = _divide(df.withColumn("_body", body), F.when(body.isNull(), "no question or answer"), m)
    told = F.array(M.message("system", F.lit(f"Translate from {NAMES[source]} to {NAMES[target]}; keep the labels question, answer and ground_truth.")), M.message("user", F.col("_body")))
    got = ask(ready, told, backend, params, calls)
    parts = T.question_parts(F.col("answer.value"))
    reason = F.when(~F.col("answer.ok"), F.col("answer.error")).when(detect_language(F.col("answer.value"), relaxed) != target, "another language").when(parts.isNull(), "a part is missing")
    extras = F.map_concat(F.map_filter(F.coalesce(answer["extras"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k != "ground_truth"), F.create_map(F.lit("ground_truth"), parts["ground_truth"]))
    new = F.concat(F.filter(m, lambda x: M.role(x) == "system"), F.array(M.message("user", parts["question"]), F.struct(F.lit("assistant").alias("role"), parts["answer"].alias("content"), extras.alias("extras"))))
    done, rejected = _divide(got, reason, new)
    return done.drop("answer", "_body"), wrong.drop("_body").unionByName(rejected.drop("answer", "_body"))
