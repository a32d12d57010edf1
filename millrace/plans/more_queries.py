"""Queries over schemas, files, model calls and the rest of the library, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..external.calls import Cache, Calls, cached_calls, call_rows, embed, embed_stored, run_checkpointed
from ..functions import messages as M
from ..functions import plain
from ..functions.labels import CODING_TASKS, LANGUAGES
from ..operators import dataset, filters, sampling, stats, transforms
from ..schemas import detected, to_canonical
from ..sources import samples as S
from ..sources.shared import new_folder
from . import fakes
from .queries import documents, programs, query, samples, table

# -- schemas

_Q, _A = "coalesce(source, '')", "coalesce(text, '')"
#: By schema: fields as SQL, and the fields of question and answer and how they read as text.
_SCHEMAS: dict[str, tuple[dict[str, str], str, str, str]] = {
    "gsm8k_en": ({"question": _Q, "answer_only": "n_chars::varchar", "answer": _A, "split": "'train'"}, "question", "answer", "question || chr(10) || answer"),
    "gsm8k_zh": ({"question": _Q, "answer_only": "n_chars::varchar", "answer": _A, "split": "'test'", "question_zh": f"'zh ' || {_Q}", "answer_zh": f"'zh ' || {_A}"}, "question_zh", "answer_zh", "question_zh || chr(10) || answer_zh"),
    "leetcode": ({"problem_ID": "doc_id::varchar", "problem_cn": f"'cn ' || {_Q}", "problem_en": _Q, "answer": _A}, "problem_en", "answer", "'Human:' || chr(10) || problem_en || chr(10) || 'Assistant:' || chr(10) || answer"),
    "leetcode_cn": ({"problem_ID": "doc_id::varchar", "problem_cn": f"'cn ' || {_Q}", "problem_en": _Q, "answer": _A}, "problem_cn", "answer", "' ' || problem_cn || ' ' || answer"),
    "math_en": ({"problem": _Q, "level": "'Level 1'", "type": "coalesce(lang, '')", "solution": _A}, "problem", "solution", "problem || chr(10) || solution"),
    "math_zh": ({"problem": _Q, "level": "'Level 2'", "type": "coalesce(lang, '')", "solution": _A}, "problem", "solution", "problem || chr(10) || solution"),
    "meta_math_qa_en": ({"query": _Q, "response": _A, "type": "coalesce(lang, '')"}, "query", "response", "query || chr(10) || response"),
    "meta_math_qa_zh": ({"query": _Q, "response": _A, "type": "coalesce(lang, '')", "query_zh": f"'zh ' || {_Q}", "response_zh": f"'zh ' || {_A}"}, "query_zh", "response_zh", "query_zh || chr(10) || response_zh"),
    "numina": ({"problem": _Q, "solution": _A}, "user", "assistant", "'problem: ' || problem || chr(10) || 'solution: ' || solution || chr(10)"),
    "oai": ({}, "", "", ""),
}


def raw_samples(docs: DataFrame, name: str):
    """A column of documents as raw JSON samples of a schema."""
    expression = lambda sql: F.expr(sql.replace("::varchar", "").replace("n_chars", "cast(n_chars as string)").replace("doc_id", "cast(id as string)"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if name == "oai":
        return F.to_json(F.array(message("system", F.lit("be kind")), message("user", expression(_Q)), message("assistant", expression(_A))))
    fields = [expression(sql).alias(field) for field, sql in _SCHEMAS[name][0].items()]
    if name == "numina":
        fields.append(F.array(message("user", expression(_Q)), message("assistant", expression(_A))).alias("messages"))
    return F.to_json(F.struct(*fields))


def _schema_query(name: str) -> None:
    fields, user, assistant, text = _SCHEMAS[name]
    columns = ", ".join(f"{sql} as {field}" for field, sql in fields.items()) or f"{_Q} as q"
    if name == "numina":
        user, assistant = "problem", "solution"
    if name == "oai":
        columns, user, assistant, text = f"{_Q} as q, {_A} as a", "q", "a", "'user: ' || q || chr(10) || 'assistant: ' || a"

    @query(f"schema_{name}", f"with s as (select doc_id, {columns} from documents) select doc_id as id, {user} as question, {assistant} as answer, {text} as text from s")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = documents(spark, sf_dir)
        rows = to_canonical(raw.select(F.col("id").alias("pos"), raw_samples(raw, name).alias("raw")), name)
        of = lambda role: F.get(F.filter("messages", lambda m: M.role(m) == role), F.lit(0))["content"]
        return rows.select("id", of("user").alias("question"), of("assistant").alias("answer"), "text")


for _name in _SCHEMAS:
    _schema_query(_name)

_KINDS = ("gsm8k_en", "gsm8k_zh", "leetcode", "math_en", "meta_math_qa_en", "meta_math_qa_zh", "numina", "oai")


def _raw_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    raw = F.lit('{"unknown": 1}')
    for k, name in enumerate(_KINDS):
        raw = F.when(F.col("n_chars") % 9 == k, raw_samples(docs, name)).otherwise(raw)
    return docs.select("id", raw.alias("raw"))


def _found(first: bool) -> str:
    names = [{"gsm8k_zh": "gsm8k_en", "meta_math_qa_zh": "meta_math_qa_en", "numina": "generic", "oai": "generic"}.get(n, n) if first else n for n in _KINDS]
    return "case n_chars % 9 " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(names)) + " end"


@query("detect_first_match", f"select doc_id as id, {_found(True)} as schema from documents")
def detect_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_of_many(spark, sf_dir).select("id", detected(F.col("raw")).alias("schema"))


@query("detect_most_specific", f"select doc_id as id, {_found(False)} as schema from documents")
def detect_most_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_of_many(spark, sf_dir).select("id", detected(F.col("raw"), "most_specific").alias("schema"))


@query("load_dropping_others", "select doc_id as id from documents where n_chars % 9 = 2")
def load_dropping_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_of_many(spark, sf_dir).withColumnRenamed("id", "pos")
    return to_canonical(raw, "leetcode", on_error="drop").select("id")


# -- files

_TURNS = "select dense_rank() over (order by conv_id) - 1 as id, text from (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id)"


def _through_file(name: str, suffix: str, write) -> None:
    @query(name, _TURNS)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{new_folder(spark, name)}/samples.{suffix}"
        write(samples(spark, sf_dir), path)
        return S.read_samples(spark, path).select("id", M.to_str(F.col("messages")).alias("text"))


_through_file("json_array_file", "json", S.write_json_array)
_through_file("json_lines_file", "jsonl", S.write_jsonl)


@query("several_files", "with t as (select conv_id as id, count(*) as messages from conversations group by conv_id) select id, messages from t union all select id + (select max(id) + 1 from t), messages from t")
def several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Parquet files, whose ids have gaps or not."""
    path = f"{new_folder(spark, 'several')}/samples.parquet"
    samples(spark, sf_dir).write.parquet(path)
    return S.read_samples(spark, [path, path]).select("id", F.size("messages").cast("long").alias("messages"))


@query("first_sample", "select string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations where conv_id = (select min(conv_id) from conversations)")
def first_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'first')}/samples.jsonl"
    S.write_jsonl(samples(spark, sf_dir), path)
    raw = spark.createDataFrame([(0, S.first_sample(spark, path))], "pos long, raw string")
    return to_canonical(raw, "generic").select("text")


# -- models

_N = "('0x' || substr(sha256({}), 1, 8))::bigint"
_CONV = "with c as (select conv_id as id, string_agg(role || ': ' || text, chr(10) order by turn) as x from conversations group by conv_id)"


def _classified(name: str, labels: tuple[str, ...], line: str, tag: str) -> None:
    k = f"{_N.format('x')} % {len(labels) + 1}"

    @query(name, f"{_CONV} select id, {[x.lower() for x in labels]!r}[{k} + 1] as label from c where {k} < {len(labels)}")
    def done(spark: SparkSession, sf_dir: str) -> DataFrame:
        got, _ = getattr(transforms, name)(samples(spark, sf_dir), fakes.labelling(labels, line))
        return got.select("id", F.col("messages")[0]["extras"][tag].alias("label"))

    @query(f"{name}_rejects", f"{_CONV} select id, 'no label in the answer' as reason from c where {k} = {len(labels)}")
    def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(transforms, name)(samples(spark, sf_dir), fakes.labelling(labels, line))[1].select("id", "reason")


_classified("classify_programming_language", LANGUAGES, "programming language", "programming_language")
_classified("classify_coding_task", CODING_TASKS, "task", "coding_task")

_VOTES = f"{_CONV}, v as (select id, {_N.format('x')} % 3 as a, {_N.format('x')} // 3 % 3 as b from c)"


@query("find_code_agreement", f"{_VOTES} select id, ['generation', 'completion'][a + 1] as label, null::varchar as reason from v where a = b and a < 2 union all select id, null, case when a = 2 or b = 2 then 'a model gave no label' else 'the models differ' end from v where not (a = b and a < 2)")
def find_code_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [fakes.labelling(CODING_TASKS[:2], "task", d, f"fake-{d}") for d in (1, 3)]
    done, rejected = transforms.find_code_agreement(samples(spark, sf_dir), models)
    return done.select("id", F.col("messages")[0]["extras"]["coding_task"].alias("label"), F.lit(None).cast("string").alias("reason")).union(rejected.select("id", F.lit(None).cast("string"), "reason"))


_SHELL = f"""with p as (select doc_id as id, 'Write this Python program for Bash, in one fenced block:' || chr(10) || 'print(' || n_chars || ')' || chr(10) as ask from documents),
 n as (select id, {_N.format('ask')} as n from p), r as (select id, n, {_N.format("'echo ' || n || chr(10)")} % 2 as ok from n)"""


@query("translate_python_to_bash", f"{_SHELL} select id, case when n % 3 > 0 and ok = 1 then '```bash' || chr(10) || 'echo ' || n || chr(10) || '```' end as text, case when n % 3 = 0 then 'no code in the answer' when ok = 0 then 'the program doesn''t run' end as reason from r")
def translate_python_to_bash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    answer = F.concat(F.lit("```python\nprint("), F.col("n_chars").cast("string"), F.lit(")\n```"))
    rows = docs.select("id", F.col("id").alias("pos"), F.array(M.message("user", F.col("source")), M.message("assistant", answer)).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))
    done, rejected = transforms.translate_python_to_bash(rows, fakes.SHELL, fakes.shell_status)
    return done.select("id", M.last(F.col("messages"))["content"].alias("text"), F.lit(None).cast("string").alias("reason")).union(rejected.select("id", F.lit(None).cast("string"), "reason"))


_BOTH = f"""with f as (select conv_id as id, arg_min(text, turn) filter (role in ('user', 'human')) as q, arg_min(text, turn) filter (role = 'assistant') as a from conversations group by conv_id),
 t as (select id, case when q is not null and a is not null then {_N.format("'question: ' || q || chr(10) || 'answer: ' || a || chr(10) || 'ground_truth: ' || chr(10)")} end as n from f)"""


@query("translate", f"""{_BOTH} select id, case when n % 4 in (1, 3) then '问' || n end as question, case n % 4 when 1 then '答' || n when 3 then '答' end as answer, case n % 4 when 1 then '真' when 3 then '真' || n end as ground_truth,
 case when n is null then 'no question or answer' when n % 4 = 0 then 'another language' when n % 4 = 2 then 'a part is missing' end as reason from t""")  # fmt: skip
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, rejected = transforms.translate(samples(spark, sf_dir), fakes.TRANSLATOR)
    of = lambda role: F.get(F.filter("messages", lambda m: M.role(m) == role), F.lit(0))
    none = F.lit(None).cast("string")
    good = done.select("id", of("user")["content"].alias("question"), of("assistant")["content"].alias("answer"), of("assistant")["extras"]["ground_truth"].alias("ground_truth"), none.alias("reason"))
    return good.union(rejected.select("id", none, none, none, "reason"))


_ECHO = "'echo:' || substr(sha256({}), 1, 16)"
_POT_ROWS = """with b as (select item_id as id, 'q' || item_id as q, length(text) as n, case when item_id % 20 = 0 or item_id % 5 in (1, 2, 3) then 'the code doesn''t run' when item_id % 7 = 0 then 'no output' end as reason from benchmark)"""


@query("generate_pot_sample", f"""{_POT_ROWS} select id, case when reason is null then {_ECHO.format("'Say what this asks:' || chr(10) || q")} || chr(10) || '```python' || chr(10) || 'print(' || n || ')' || chr(10) || '```' || chr(10) || chr(10) || '```output' || chr(10) || n || chr(10) || '```' || chr(10)
 || {_ECHO.format("'Sum up this output:' || chr(10) || n || chr(10) || chr(10) || 'of this task:' || chr(10) || q")} end as text, reason from b""")  # fmt: skip
def generate_pot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    short = F.concat(F.lit("print("), F.col("length").cast("string"), F.lit(")"))
    code = F.when((n % 20 == 0) | (n % 5).isin(1, 2, 3), F.regexp_replace("code", r"(?s)^.*\n", "")).when(n % 7 == 0, "x = 1").otherwise(short)
    rows = programs(spark, sf_dir).withColumn("code", F.regexp_replace(code, r"len\(x\)", "0"))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("pos"), F.array(M.message("user", F.concat(F.lit("q"), n.cast("string"))), M.message("assistant", F.concat(F.lit("```python\n"), F.col("code"), F.lit("\n```")))).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))
    done, rejected = transforms.generate_pot_sample(rows, timeout=8.0, allow=True)
    none = F.lit(None).cast("string")
    return done.select("id", M.last(F.col("messages"))["content"].alias("text"), none.alias("reason")).union(rejected.select("id", none, "reason"))


@query("generate_for_test", f"""with l as (select conv_id as id, arg_max(case role when 'human' then 'user' else role end, turn) as r, arg_max(text, turn) as x from conversations group by conv_id),
 k as (select v.conv_id as id, arg_max(case v.role when 'human' then 'user' else v.role end, v.turn) as r, arg_max(v.text, v.turn) as x from conversations v join (select conv_id, max(turn) as t from conversations group by conv_id) m on m.conv_id = v.conv_id where v.turn < m.t group by v.conv_id)
 select l.id, {_ECHO.format("case when l.r = 'assistant' then k.x else l.x end")} as answer from l left join k on k.id = l.id where case when l.r = 'assistant' then k.r else l.r end = 'user'""")  # fmt: skip
def generate_for_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = transforms.generate_for_test(samples(spark, sf_dir), calls=Calls(workers=2, mode="coroutine"))
    return done.select("id", M.last(F.col("messages"))["content"].alias("answer"))


_CALLED = f"select doc_id as id, {_N.format('text')} % 3 <> 0 as ok, case when {_N.format('text')} % 3 <> 0 then {_N.format('text')}::varchar end as value, case when {_N.format('text')} % 3 = 0 then 'CallError' end as error_class, case when {_N.format('text')} % 3 = 0 then 'no ' || {_N.format('text')} end as error"
_RESULT = ("id", "ok", "value", "error_class", "error")


def _call_query(name: str, mode: str) -> None:
    @query(name, _CALLED + " from documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return call_rows(documents(spark, sf_dir), "id", "text", fakes.fails_for_some, workers=4, mode=mode).select(*_RESULT)


_call_query("call_threads", "thread")
_call_query("call_coroutines", "coroutine")
_call_query("call_serially", "serial")


@query("call_async_function", f"select doc_id as id, {_N.format('text')}::varchar as value from documents")
def call_async_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_rows(documents(spark, sf_dir), "id", "text", fakes.answer_later, mode="coroutine").select("id", "value")


@query("cached_calls", _CALLED + ", 1 as run from documents union all " + _CALLED + ", 2 from documents")
def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one cache; the second must not disturb what the first gave."""
    cache = Cache(spark, f"{new_folder(spark, 'cache')}/answers")
    runs = [cached_calls(documents(spark, sf_dir), "id", "text", fakes.fails_for_some, cache, "number") for _ in range(2)]
    return runs[0].select(*_RESULT, F.lit(1).alias("run")).union(runs[1].select(*_RESULT, F.lit(2)))


@query("resume_calls", _CALLED + ", 0 as attempt from documents")
def resume_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the documents of one language, taken up again for all."""
    folder, docs = new_folder(spark, "resumed"), documents(spark, sf_dir)
    run_checkpointed(docs.where("lang = 'en'"), "id", "text", fakes.fails_for_some, folder, every=500)
    return run_checkpointed(docs, "id", "text", fakes.fails_for_some, folder, resume=True).select(*_RESULT, "attempt")


@query("rerun_calls", _CALLED + f", case when {_N.format('text')} % 3 = 0 then 2 else 0 end as attempt from documents")
def rerun_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows are called twice more, and fail again."""
    return run_checkpointed(documents(spark, sf_dir), "id", "text", fakes.fails_for_some, new_folder(spark, "rerun"), reruns=2).select(*_RESULT, "attempt")


_LENGTHS = "select doc_id as id, length(text)::float as a, (length(text) - length(replace(text, 'e', '')))::float as b from documents"


@query("embed_texts", _LENGTHS)
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(documents(spark, sf_dir), "text", fakes.lengths).select("id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@query("embed_stored", _LENGTHS)
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of which some are stored from an earlier run."""
    folder, docs = f"{new_folder(spark, 'vectors')}/lengths", documents(spark, sf_dir)
    embed_stored(docs.where("lang = 'en'"), "text", fakes.lengths, folder, "lengths").count()
    return embed_stored(docs, "text", fakes.lengths, folder, "lengths").select("id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


# -- sets, samples, statistics

@query("merge_shuffled", "with n as (select max(doc_id) + 1 as n from documents), u as (select doc_id as id from documents union all select doc_id + n from documents, n) select id, row_number() over (order by md5('42:' || id), id) - 1 as pos from u")
def merge_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("id").alias("pos"))
    return dataset.merge(docs, docs, shuffled=True)


@query("dry_run", "select doc_id as id from documents order by md5('42:' || doc_id), doc_id limit 16")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dry_run(documents(spark, sf_dir)).select("id")


@query("split_parts", "with c as (select count(*) as n from documents), k as (select doc_id as id, row_number() over (order by doc_id) - 1 as k from documents) select id, case when k < n // 2 then 'first' else 'second' end as part from k, c")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sampling.split(documents(spark, sf_dir).select("id"), (1, 1))
    return a.withColumn("part", F.lit("first")).union(b.withColumn("part", F.lit("second")))


@query("intersect_ids", "select doc_id as id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.intersect(documents(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))).select("id")


@query("append_rows", "with m as (select max(doc_id) + 1 as m from documents) select doc_id as id, text from documents union all select m + row_number() over (order by item_id) - 1, text from benchmark, m")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("id").alias("pos"), "text")
    more = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    return dataset.append(docs, more).select("id", "text")


@query("cache_keys", """select doc_id as id, sha256('{"f":"f","v":"1","x0":' || doc_id || '}') as cache_key from documents""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", plain.cache_key("f", "1", F.col("id")).alias("cache_key"))


@query("token_metric", "select sum(len(regexp_extract_all(text, '[a-zA-Z0-9\\x{80}-\\x{10ffff}]+|[^a-zA-Z0-9\\x{80}-\\x{10ffff}\\s]')))::bigint as tokens from documents")
def token_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.METRICS["tokens"](documents(spark, sf_dir)).select(F.col("tokens").cast("long").alias("tokens"))


@query("counts", "select count(*) filter (n_chars % 4 in (1, 2)) as done, count(*) filter (n_chars % 4 not in (1, 2)) as rejected from documents")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows seen while both results of a transform are written."""
    from .queries import fenced

    folder, seen = new_folder(spark, "counts"), []
    for k, df in enumerate(transforms.rewrite_pot_remove_output(fenced(spark, sf_dir))):
        df, observed = stats.counted(df)
        df.write.parquet(f"{folder}/{k}")
        seen.append(observed.get["n"])
    return spark.createDataFrame([tuple(seen)], "done long, rejected long")


@query("legacy_single_turn", "with v as (select conv_id, case when role = 'user' and conv_id % 2 = 0 then 'human' else role end as role from conversations), r as (select conv_id as id, count(distinct role) as kinds, count(*) filter (role = 'system') as s, count(*) filter (role = 'assistant') as a, count(*) filter (role = 'human') as h from v group by conv_id) select id from r where kinds between 2 and 3 and s <= 1 and a = 1 and h between 1 and 2")
def legacy_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as they stand: ``user`` isn't ``human``. Half of the conversations say so."""
    name = lambda m: F.when((m["role"] == "user") & (F.col("id") % 2 == 0), "human").otherwise(m["role"])
    said = F.transform("messages", lambda m: F.struct(name(m).alias("role"), m["content"].alias("content"), m["extras"].alias("extras")))
    return filters.filter_samples(samples(spark, sf_dir).withColumn("messages", said), "is_single_turn", legacy=True).select("id")


@query("stream_first_of_repeats", "select distinct text from documents")
def stream_first_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a stream of documents lets through once within a watermark."""
    from ..streaming.samples import drop_repeats, read_stream, run_once

    like = table(spark, sf_dir, "documents")
    stream = read_stream(spark, f"{sf_dir}/documents*.parquet", like).withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200)))
    folder = new_folder(spark, "repeats")
    run_once(drop_repeats(stream, "at", "1 hour", "text").select("text"), f"{folder}/out", f"{folder}/progress")
    return spark.read.schema("text string").parquet(f"{folder}/out")
