"""Queries over the library's operators, each on whole tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import messages as M
from ..functions import plain
from ..functions import text as T
from ..functions.labels import CODING_TASKS, parse_label
from ..functions.language import detect_language, language_name
from ..functions.tokens import approximate_tokens
from ..operators import dataset, dedup, filters, sampling, stats, transforms
from ..sources.samples import conversations, to_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_Made = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[_Made], _Made]:
    def add(function: _Made) -> _Made:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


_WRAPPED_SQL = """(case n_chars % 4 when 0 then 'pre' || chr(10) || text else 'pre' || chr(10) || '```python' || chr(10) || (case n_chars % 4 when 2 then '' else text end) || chr(10) || '```' || chr(10) || chr(10)
  || '```output' || chr(10) || (case n_chars % 4 when 3 then '' else n_chars::varchar end) || chr(10) || '```' || chr(10) || (case n_chars % 4 when 3 then '' else 'sum' end) end)"""
_POT = "'^(.*)(\\n```python\\n.*\\n```\\n)(\\n```output\\n.*\\n```\\n)(.*)'"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _wrapped() -> Column:
    """A document's text as code, with its number of characters as output. By that number, a quarter has no fences, a quarter no code, and a quarter neither output nor summary."""
    kind = F.col("n_chars") % 4
    code, n = F.when(kind == 2, "").otherwise(F.col("text")), F.when(kind == 3, "").otherwise(F.col("n_chars").cast("string"))
    whole = F.concat(F.lit("pre\n```python\n"), code, F.lit("\n```\n\n```output\n"), n, F.lit("\n```\n"), F.when(kind == 3, "").otherwise("sum"))
    return F.when(kind == 0, F.concat(F.lit("pre\n"), F.col("text"))).otherwise(whole)


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples whose answer has code and output."""
    docs = documents(spark, sf_dir)
    return docs.select("id", F.col("id").alias("pos"), F.array(M.message("user", F.col("source")), M.message("assistant", _wrapped())).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))


# -- samples as text

@query("conv_to_str", "select conv_id as id, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id")
def conv_to_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("id", M.to_str(F.col("messages")).alias("text"))


@query("conv_to_str_oai", "select conv_id as id, coalesce(string_agg(case when turn > 0 then role || ': ' || text end, chr(10) order by turn), '') as text from conversations group by conv_id")
def conv_to_str_oai(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import oai_to_str

    return samples(spark, sf_dir).select("id", oai_to_str(F.col("messages")).alias("text"))


@query("chat_template", "select conv_id as id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) || '<|im_start|>assistant' || chr(10) as text from conversations group by conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("id", M.chat_template(F.col("messages"), prompt=True).alias("text"))


@query("role_counts", """select conv_id as id, count(*) filter (role = 'system') as system, count(*) filter (role in ('user', 'human')) as "user", count(*) filter (role = 'assistant') as assistant,
  count(distinct case role when 'human' then 'user' else role end) as kinds from conversations group by conv_id""")  # fmt: skip
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.role_counts(samples(spark, sf_dir))


@query("rounds_histogram", "with r as (select conv_id, count(*) filter (role in ('user', 'human')) as rounds from conversations group by conv_id) select rounds, count(*) as n from r group by rounds")
def rounds_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rounds_histogram(samples(spark, sf_dir))


@query("length_histogram", "select case when length(text) > 131072 then null else cast(1024 * pow(2, greatest(0, ceil(log2(greatest(length(text), 1) / 1024.0)))) as bigint) end as bin, count(*) as n from documents group by 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(documents(spark, sf_dir), F.col("text"))


@query("detect_schema_histogram", "select 'generic' as schema, count(distinct conv_id) as n from conversations")
def detect_schema_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import detected

    return to_json(samples(spark, sf_dir)).groupBy(detected(F.col("raw")).alias("schema")).agg(F.count(F.lit(1)).alias("n"))


@query("json_round_trip", "select conv_id as id, count(*) as messages, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import to_canonical

    back = to_canonical(to_json(samples(spark, sf_dir)), "generic")
    return back.select("id", F.size("messages").cast("long").alias("messages"), "text")


# -- filters

_ROLES = "select conv_id as id, count(distinct case role when 'human' then 'user' else role end) as kinds, count(*) filter (role = 'system') as s, count(*) filter (role = 'assistant') as a, count(*) filter (role in ('user', 'human')) as h, count(*) as n from conversations group by conv_id"


@query("filter_single_turn", f"select id, n as messages from ({_ROLES}) where kinds between 2 and 3 and s <= 1 and a = 1 and h between 1 and 2")
def filter_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(samples(spark, sf_dir), "is_single_turn").select("id", F.size("messages").cast("long").alias("messages"))


@query("filter_has_code", f"select doc_id as id from documents where trim(regexp_extract({_WRAPPED_SQL}, '```(\\s*)(\\S*)?\\n(.*?)```', 3, 's'), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def filter_has_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(fenced(spark, sf_dir), "has_python_code").select("id")


@query("filter_multi_step", f"select doc_id as id from documents where len(regexp_extract_all({_WRAPPED_SQL} || chr(10) || {_WRAPPED_SQL}, '```python\\n(.*?)```[\\n]*```output\\n(.*?)```', 0, 's')) > 1")
def filter_multi_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    twice = F.concat(_wrapped(), F.lit("\n"), _wrapped())
    return filters.filter_samples(docs.select("id", F.array(M.message("user", F.col("source")), M.message("assistant", twice)).alias("messages")), "is_multi_step").select("id")


@query("filter_pot_regular", f"select doc_id as id from documents where regexp_matches({_WRAPPED_SQL}, {_POT}, 's') and {_STRIP.format(f"regexp_extract({_WRAPPED_SQL}, {_POT}, 3, 's')")} <> '```output' || chr(10) || chr(10) || '```'")
def filter_pot_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(fenced(spark, sf_dir), "is_pot_output_regular", strict=False).select("id")


@query("filter_overlong", "with t as (select conv_id as id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) as x from conversations group by conv_id) select id, len(regexp_extract_all(x, '[a-zA-Z0-9\\x{80}-\\x{10ffff}]+|[^a-zA-Z0-9\\x{80}-\\x{10ffff}\\s]')) as tokens from t where tokens > 512")
def filter_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.filter_samples(samples(spark, sf_dir), "is_overlong", threshold=512)
    return kept.select("id", approximate_tokens(M.chat_template(F.col("messages"))).cast("long").alias("tokens"))


@query("filter_syntax_error", "select doc_id as id from documents where n_chars % 3 = 0")
def filter_syntax_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    code = F.concat(F.lit("```python\nx = "), F.to_json(F.array("source")), F.lit("[0]\ny = ("), F.col("n_chars").cast("string"), F.when(F.col("n_chars") % 3 == 0, " +").otherwise(")"), F.lit("\n```"))
    return filters.filter_samples(docs.select("id", F.array(M.message("user", F.col("source")), M.message("assistant", code)).alias("messages")), "has_syntax_error").select("id")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, length, code): a program for each item of the benchmark, that prints the length of its text, or doesn't end, can't be parsed, fails an assertion, or fails otherwise."""
    text = F.concat(F.lit("import json\nx = json.loads(r'''"), F.to_json(F.array("text")), F.lit("''')[0]\n"))
    n = F.col("item_id") % 20
    end = F.when(n == 0, "while True: pass").when(n % 5 == 1, "print(").when(n % 5 == 2, "assert len(x) < 0").when(n % 5 == 3, "raise ValueError(len(x))").otherwise("print(len(x))")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("length"), F.concat(text, end).alias("code")).repartition(8)


_OUTCOME = "case when item_id % 20 = 0 then 'timeout' when item_id % 5 = 1 then 'syntax_error' when item_id % 5 = 2 then 'assertion_error' when item_id % 5 = 3 then 'error' else 'ok' end"


@query("run_code", f"select item_id as id, {_OUTCOME} as status, case when {_OUTCOME} = 'ok' then length(text) || chr(10) else '' end as stdout from benchmark")
def run_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sandbox import run_column, status

    ran = run_column(programs(spark, sf_dir), "code", timeout=8.0, allow=True)
    return ran.select("id", status(F.col("run")).alias("status"), F.col("run.stdout").alias("stdout"))


def answers_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs as samples, whose output fence is right for ids that aren't divisible by 3."""
    made = programs(spark, sf_dir)
    output = F.when(F.col("id") % 3 == 0, "-1").otherwise(F.concat(F.lit(" "), F.col("length").cast("string")))
    answer = F.concat(F.lit("so\n```python\n"), F.col("code"), F.lit("\n```\n\n```output\n"), output, F.lit("\n```\nend"))
    return made.select("id", F.col("id").cast("long").alias("pos"), F.array(M.message("user", F.concat(F.lit("q"), F.col("id").cast("string"))), M.message("assistant", answer)).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))


@query("can_python_code_run", f"select item_id as id from benchmark where {_OUTCOME} = 'ok'")
def can_python_code_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(answers_with_code(spark, sf_dir), "can_python_code_run", timeout=8.0, allow=True).select("id")


@query("run_result_correct", f"select item_id as id from benchmark where {_OUTCOME} = 'ok' and item_id % 3 <> 0")
def run_result_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(answers_with_code(spark, sf_dir), "python_code_run_result_correct", timeout=8.0, allow=True).select("id")


@query("filter_overlong_lines", "with t as (select conv_id as id, string_agg(role || ': ' || text, chr(10) order by turn) as x from conversations group by conv_id) select id from t where len(regexp_extract_all(x, '[a-zA-Z0-9\\x{80}-\\x{10ffff}]+|[^a-zA-Z0-9\\x{80}-\\x{10ffff}\\s]')) > 300")
def filter_overlong_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_samples(samples(spark, sf_dir), "is_overlong", threshold=300, template=False).select("id")


@query("filter_own_predicate", "select conv_id as id from conversations group by conv_id having count(*) % 2 = 0")
def filter_own_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..registry import predicate

    predicate("_even_messages")(lambda by=2: F.size("messages") % by == 0)
    return filters.filter_samples(samples(spark, sf_dir), "_even_messages", by=2).select("id")


# -- transforms

_DROP = f"""with c as ({_ROLES}), f as (
  select conv_id as id, max(case when turn = 0 then case role when 'human' then 'user' else role end end) as r0, max(case when turn = 1 then case role when 'human' then 'user' else role end end) as r1, max(turn) as last_turn, arg_max(case role when 'human' then 'user' else role end, turn) as last_role from conversations group by conv_id
), j as (select c.*, r0, r1, last_turn, last_role, n > 2 and ((r0 = 'system' and r1 = 'user') or (r0 = 'user' and r1 = 'assistant')) and a > 0 and h - (last_role = 'user')::int > 0 as ok from c join f using (id))"""


@query("drop_last_human", _DROP + " select j.id, string_agg(v.role || ': ' || v.text, chr(10) order by v.turn) as text from j join conversations v on v.conv_id = j.id where ok and not (v.turn = j.last_turn and last_role = 'user') group by j.id")
def drop_last_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = transforms.drop_last_human_message(samples(spark, sf_dir))
    return done.select("id", M.to_str(F.col("messages")).alias("text"))


@query("drop_last_human_rejects", _DROP + " select id, n as messages from j where not coalesce(ok, false)")
def drop_last_human_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = transforms.drop_last_human_message(samples(spark, sf_dir))
    return rejected.select("id", F.size("messages").cast("long").alias("messages"))


def _pot_sql(shape: str) -> str:
    parts = ", ".join(f"{_STRIP.format(f'regexp_extract(w, {_POT}, {k + 1}, {chr(39)}s{chr(39)})')} as {n}" for k, n in enumerate(("p", "c", "o", "s")))
    return f"with w as (select doc_id as id, {_WRAPPED_SQL} as w from documents), x as (select id, {parts} from w where regexp_matches(w, {_POT}, 's')) select id, {shape} as text from x where p <> '' and c <> '' and o <> '' and s <> ''"


def _rewritten(name: str, shape: str) -> None:
    @query(name, _pot_sql(shape))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done, _ = getattr(transforms, name)(fenced(spark, sf_dir))
        return done.select("id", M.last(F.col("messages"))["content"].alias("text"))


_rewritten("rewrite_pot_remove_output", "p || chr(10) || chr(10) || c || chr(10) || chr(10) || s")
_rewritten("rewrite_pot_remove_output_summary", "p || chr(10) || c")
_rewritten("rewrite_pot_remove_summary", "p || chr(10) || c || chr(10) || o")


@query("rewrite_pot_rejects", "select doc_id as id, case when n_chars % 4 = 0 then 'not a program-of-thought answer' else 'a part is empty' end as reason from documents where n_chars % 4 in (0, 3)")
def rewrite_pot_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.rewrite_pot_remove_output(fenced(spark, sf_dir))[1].select("id", "reason")


_FAKE = "'echo:' || substr(sha256({}), 1, 16)"


@query("generate_last_turn", f"""with f as (select conv_id, max(turn) as t, arg_max(case role when 'human' then 'user' else role end, turn) as r from conversations group by conv_id),
 k as (select v.conv_id as id, v.turn, v.role, v.text from conversations v join f on f.conv_id = v.conv_id where not (v.turn = f.t and f.r = 'assistant')),
 l as (select id, arg_max(case role when 'human' then 'user' else role end, turn) as r, arg_max(text, turn) as x, count(*) as n from k group by id)
 select id, n + 1 as messages, {_FAKE.format('x')} as answer from l where r = 'user'""")  # fmt: skip
def generate_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = transforms.generate_last_turn(samples(spark, sf_dir))
    return done.select("id", F.size("messages").cast("long").alias("messages"), M.last(F.col("messages"))["content"].alias("answer"))


@query("generate_every_turn", f"select conv_id as id, turn, {_FAKE.format('text')} as answer from conversations where role in ('user', 'human')")
def generate_every_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = samples(spark, sf_dir).select("*", F.transform(F.filter("messages", lambda m: M.role(m) == "user"), lambda m: m["extras"]["id"]).alias("turns")).where(F.size("turns") > 0)
    done, _ = transforms.generate_every_turn(human)
    answers = F.filter("messages", lambda m: m["role"] == "assistant")
    return done.select("id", F.explode(F.arrays_zip("turns", answers.alias("a"))).alias("x")).select("id", F.col("x.turns").cast("long").alias("turn"), F.col("x.a.content").alias("answer"))


@query("call_documents", f"select doc_id as id, true as ok, {_FAKE.format('text')} as value from documents")
def call_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..external.backend import FakeBackend, Retry
    from ..external.calls import call_rows, chat_function

    docs = documents(spark, sf_dir).select("id", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("payload"))
    return call_rows(docs, "id", "payload", chat_function(FakeBackend(), retry=Retry(first=0, jitter=0))).select("id", "ok", "value")


@query("agreement", "select doc_id, quality as agreed from labels where quality = toxic")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    voters = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("vote"))
    return stats.agreement(voters, "doc_id", "vote")


_TASKS_SQL = str([x.lower() for x in CODING_TASKS])


@query("parse_labels", f"select conv_id, turn, case when length(text) % 3 = 0 then 'other' when length(text) % 3 = 1 then {_TASKS_SQL}[length(text) % 10 + 1] end as label from conversations")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that name a label, that name one almost, and that name none."""
    turns = table(spark, sf_dir, "conversations")
    n = F.length("text")
    named = F.get(F.array(*map(F.lit, CODING_TASKS)), n % 10)
    said = F.when(n % 3 == 0, "so\ntask: Debgu").when(n % 3 == 1, F.concat(F.lit("task: x\nwhy\ntask: "), named, F.lit(" "))).otherwise(F.concat(F.lit("no such line, "), named))
    return turns.select("conv_id", "turn", parse_label(CODING_TASKS, "task")(said).alias("label"))


# -- text functions

@query("extract_code", f"select doc_id as id, case when n_chars % 4 > 0 then regexp_extract({_WRAPPED_SQL}, '```(\\s*)(\\S*)?\\n(.*?)```', 3, 's') end as code, case when n_chars % 4 > 0 then regexp_extract({_WRAPPED_SQL}, '```output\\n(.*?)```', 1, 's') end as output from documents")
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", T.extract_code(_wrapped()).alias("code"), T.extract_output(_wrapped()).alias("output"))


@query("remove_output", f"select doc_id as id, regexp_replace({_WRAPPED_SQL}, '```output\\n.*?```', '', 'gs') as text from documents")
def remove_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", T.remove_output(_wrapped()).alias("text"))


@query("render_think", f"select doc_id as id, 'a' || case when {_STRIP.format('text')} = '' then '' else '> ' || replace({_STRIP.format('text')}, chr(10), chr(10) || '> ') end || 'b' as text from documents")
def render_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", T.render_think(F.concat(F.lit("a<think>\n"), F.col("text"), F.lit("\n</think>b"))).alias("text"))


_DETECT = """case when regexp_extract(text, '[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{0400}-\\x{04ff}]') between chr(19968) and chr(40959) then 'zh'
 when regexp_extract(text, '[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{0400}-\\x{04ff}]') <> '' then 'other'
 when regexp_matches(text, '[äöüßÄÖÜ]') then 'de' when regexp_matches(text, '[éèêëàâîïôûùçÉÈÊËÀÂÎÏÔÛÙÇ]') then 'fr' when regexp_full_match(text, '[a-zA-Z]+') then 'en' else 'unknown' end"""


@query("detect_language", f"select doc_id as id, {_DETECT} as code, case {_DETECT} when 'de' then 'German' when 'fr' then 'French' when 'en' then 'English' end as name from documents")
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = detect_language(F.col("text"))
    return documents(spark, sf_dir).select("id", code.alias("code"), language_name(code).alias("name"))


@query("language_histogram", f"select lang, {_DETECT} as code, count(*) as n from documents group by all")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang", detect_language(F.col("text")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("scalar_functions", """select doc_id as id, doc_id || case when doc_id % 100 between 10 and 20 then 'th' when doc_id % 10 = 1 then 'st' when doc_id % 10 = 2 then 'nd' when doc_id % 10 = 3 then 'rd' else 'th' end as place,
  sha256(text) as digest, starts_with(lower(text), lower(source)) as prefixed, replace(source, 'src', 'from ') as renamed, regexp_replace(text, 'e([^e]*)$', 'E\\1', 's') as last_replaced from documents""")  # fmt: skip
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("id", T.ordinal(F.col("id")).alias("place"), T.digest(text).alias("digest"), T.prefix_match(F.col("source"), text).alias("prefixed"), T.replace_from_right(F.col("source"), "src", "from ").alias("renamed"), T.replace_from_right(text, "e", "E", 1).alias("last_replaced"))


@query("parse_questions", f"select doc_id as id, source as question, {_STRIP.format('text')} as answer, cast(n_chars as varchar) as ground_truth from documents")
def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("question: "), F.col("source"), F.lit("\nanswer: "), F.col("text"), F.lit("\nground_truth: "), F.col("n_chars").cast("string"), F.lit("\n"))
    return documents(spark, sf_dir).select("id", T.question_parts(body).alias("p")).select("id", "p.*")


@query("timestamps", "select event_id, strftime(ts, '%Y%m%d%H%M%S') as stamp, date_trunc('second', ts) as back from events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = plain.format_timestamp(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), plain.parse_timestamp(stamp).alias("back"))


@query("token_count", "select doc_id as id, len(regexp_extract_all(text, '[a-zA-Z0-9\\x{80}-\\x{10ffff}]+|[^a-zA-Z0-9\\x{80}-\\x{10ffff}\\s]')) as tokens from documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", approximate_tokens(F.col("text")).cast("long").alias("tokens"))


# -- search

@query("search_any", "select conv_id as id, count(*) as messages from conversations group by conv_id having bool_or(regexp_matches(text, 'th[aeo]n.*tion', 's'))")
def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where(M.search(F.col("messages"), "th[aeo]n.*tion")).select("id", F.size("messages").cast("long").alias("messages"))


@query("search_last", "select conv_id as id from conversations group by conv_id having regexp_matches(arg_max(text, turn), 'th[aeo]n.*tion', 's')")
def search_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where(M.search(F.col("messages"), "th[aeo]n.*tion", last_only=True)).select("id")


@query("highlight", "select conv_id, turn, case when regexp_matches(text, 'th[aeo]n') then replace(regexp_replace(text, 'th[aeo]n', chr(1), 'g'), chr(1), '==**__' || regexp_extract(text, 'th[aeo]n') || '__**==') else text end as text from conversations")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.highlight(F.col("text"), "th[aeo]n").alias("text"))


# -- sets, order, samples

@query("merge", "with n as (select max(doc_id) + 1 as n from documents) select doc_id as id, text from documents union all select doc_id + n, text from documents, n")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("id").alias("pos"), "text")
    return dataset.merge(docs, docs).select("id", "text")


def _sorted(name: str, reverse: bool) -> None:
    @query(name, f"with l as (select conv_id as id, max(turn) as last_turn from conversations group by conv_id) select id, last_turn, row_number() over (order by last_turn {'desc' if reverse else ''}, id) - 1 as pos from l")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dataset.sort(samples(spark, sf_dir), dataset.by_last_message(), reverse).select("id", dataset.by_last_message().alias("last_turn"), "pos")


_sorted("sort_last_message", False)
_sorted("sort_last_message_reverse", True)


@query("shuffle", "select doc_id as id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as pos from documents")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.shuffle(documents(spark, sf_dir).select("id"), 42)


_SPLIT = "with c as (select count(*) as n from documents), k as (select doc_id as id, row_number() over (order by {}) - 1 as k from documents) select id, case when k < cast(floor(n * 0.8::double) as bigint) then 0 when k < cast(floor(n * 0.8::double) as bigint) + cast(floor(n * 0.1::double) as bigint) then 1 else 2 end as part from k, c"


@query("split_sequential", _SPLIT.format("doc_id"))
def split_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_part(documents(spark, sf_dir).select("id"), (8, 1, 1))


@query("split_randomly", _SPLIT.format("md5('42:' || doc_id), doc_id"))
def split_randomly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_part(documents(spark, sf_dir).select("id"), (8, 1, 1), randomly=True)


@query("sample_ratio", "with c as (select count(*) as n from documents), r as (select doc_id as id, text, row_number() over (order by md5('42:' || doc_id), doc_id) as k from documents) select id, text from r, c where k <= cast(floor(n * 0.29::double) as bigint)")
def sample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(documents(spark, sf_dir).select("id", "text"), ratio=0.29)


@query("sample_num", "select doc_id as id, text from documents order by md5('7:' || doc_id), doc_id limit 50")
def sample_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(documents(spark, sf_dir).select("id", "text"), num=50, seed=7)


@query("sample_parity")
def sample_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(documents(spark, sf_dir).select("id", "source"), num=50, parity=True)


@query("select_by_ids", "select d.doc_id as id, text from documents d semi join (select doc_id from labels where quality = 1) l on l.doc_id = d.doc_id")
def select_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return dataset.select_by_ids(documents(spark, sf_dir), good).select("id", "text")


@query("exclude_by_ids", "select doc_id as id, text from documents where doc_id not in (select doc_id from labels)")
def exclude_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.exclude_by_ids(documents(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select("id", "text")


@query("union_ids", "select doc_id as id from labels union select item_id from benchmark")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.union_ids(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))


@query("upsert", "select d.doc_id as id, coalesce(b.text, d.text) as text from documents d left join benchmark b on b.item_id = d.doc_id union all select item_id, text from benchmark where item_id not in (select doc_id from documents)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.upsert(documents(spark, sf_dir).select("id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


# -- duplicates

@query("dedup_exact_reference", "select doc_id as id, text from documents d where not exists (select 1 from documents e join labels l on l.doc_id = e.doc_id where l.quality = 0 and e.text = d.text)")
def dedup_exact_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", "text")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return dedup.exact_match(docs, docs.join(poor, "id", "left_semi"))


@query("dedup_exact_self", "select doc_id as id from documents where n_chars % 3 = 0")
def dedup_exact_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set is its own reference: all rows go but those without a text, here a third."""
    docs = documents(spark, sf_dir).select("id", F.when(F.col("n_chars") % 3 > 0, F.col("text")).alias("text"))
    return dedup.exact_match(docs, docs).select("id")


@query("distinct_text", "select min(doc_id) as id, text from documents group by text")
def distinct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.distinct_text(documents(spark, sf_dir).select("id", "text"))


_PAIRS = "with p as (select a.vec_id as i, b.vec_id as j, b.label, case when a.vec_id = b.vec_id then 0 else list_cosine_similarity(a.embedding::double[], b.embedding::double[]) end as s from embeddings a, embeddings b)"


@query("dedup_vector_self", _PAIRS + " select i as id from p group by i having max(s) <= 0.4")
def dedup_vector_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.embedding_similarity(embeddings(spark, sf_dir), threshold=0.4).select("id")


@query("dedup_vector_keep_first", _PAIRS + " select i as id from p group by i having coalesce(max(s) filter (j < i), -1) <= 0.4")
def dedup_vector_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.embedding_similarity(embeddings(spark, sf_dir), threshold=0.4, keep="first").select("id")


@query("dedup_vector_reference", "select a.vec_id as id from embeddings a, embeddings b where b.label = 0 group by 1 having max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) <= 0.4")
def dedup_vector_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return dedup.embedding_similarity(e, e.where("label = 0"), threshold=0.4).select("id")


@query("nearest_vector", _PAIRS + " select i as id, arg_min(j, row(-round(s, 9), j)) as other, round(max(s), 6) as score from p where i <> j group by i")
def nearest_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.nearest(embeddings(spark, sf_dir)).select("id", "other", F.round("score", 6).alias("score"))


@query("l2_distance", "select a.vec_id as id, round(min(list_distance(a.embedding::double[], b.embedding::double[])), 6) as distance from embeddings a, embeddings b where a.vec_id <> b.vec_id group by 1")
def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.best_scores(embeddings(spark, sf_dir), measure="l2").select("id", F.round("best", 6).alias("distance"))


@query("threshold_sweep", _PAIRS + ", m as (select i, max(s) as best from p where i <> j group by i), t as (select k / 10.0::double as threshold from range(10) r(k)) select threshold, count(*) filter (best > threshold) as rows, round(count(*) filter (best > threshold) * 100.0::double / count(*), 6) as percent from m, t group by threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.threshold_sweep(embeddings(spark, sf_dir))


@query("score_stats", _PAIRS + " select count(*) as pairs, round(avg(s), 9) as mean, round(stddev_pop(s), 9) as std, round(max(s), 9) as max, round(min(s), 9) as min from p")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.score_stats(embeddings(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"
_NEAR = "with s as (select doc_id as id, {w} as w from documents), p as (select a.id as a, b.id as b, len(list_intersect(a.w, b.w)) as k, len(a.w) + len(b.w) as n from s a, s b where a.id <> b.id and least(len(a.w), len(b.w)) >= {t} * greatest(len(a.w), len(b.w)))"


@query("dedup_jaccard", _NEAR.format(w=_WORDS.format("text"), t=0.6) + " select id from s where id not in (select a from p where k::double / (n - k) > 0.6)")
def dedup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_similarity(documents(spark, sf_dir), threshold=0.6).select("id")


@query("jaccard_pairs", _NEAR.format(w=_WORDS.format("text"), t=0.8) + " select a, b, round(k::double / (n - k), 9) as similarity from p where k::double / (n - k) > 0.8")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_pairs(documents(spark, sf_dir), threshold=0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("dedup_jaccard_reference", f"with s as (select item_id as id, {_WORDS.format('text')} as w from benchmark), d as (select doc_id as id, {_WORDS.format('text')} as w from documents) select id from d where id not in (select d.id from d, s where len(list_intersect(d.w, s.w))::double / (len(d.w) + len(s.w) - len(list_intersect(d.w, s.w))) > 0.2)")
def dedup_jaccard_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_similarity(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), threshold=0.2).select("id")


# -- streams

@query("stream_turns", "select conv_id, turn, text from conversations where role in ('user', 'human') and text not in (select text from benchmark)")
def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns that a stream over the conversations lets through, written to the shared folder and read again."""
    from ..streaming.samples import drop_known, keep, read_stream, run_once
    from ..sources.shared import new_folder

    like = table(spark, sf_dir, "conversations")
    stream = keep(read_stream(spark, f"{sf_dir}/conversations*.parquet", like), F.lower("role").isin("user", "human"))
    folder = new_folder(spark, "stream")
    run_once(drop_known(stream, table(spark, sf_dir, "benchmark")).select("conv_id", "turn", "text"), f"{folder}/out", f"{folder}/progress")
    return spark.read.schema("conv_id long, turn long, text string").parquet(f"{folder}/out")
