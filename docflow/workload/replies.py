"""Queries: schema checks, repair, errors, retries, policies, jobs, tools, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions.errors import classify_errors, error_column, errors_from_json, errors_to_json, http_status, retry_plan
from docflow.functions.schema_check import find_violations, unwrap_reply, violations
from docflow.operators import transcripts as T
from docflow.operators.jobs import job_progress
from docflow.operators.policy import LIMITS, resolve_policy
from docflow.operators.tools import ToolRegistry, ToolSpec, calculator_tool, echo_tool, execute_tool_calls
from docflow.plans.extend import extend_transcripts
from docflow.plans.models import ColumnModel, complete_distinct, digest_model
from docflow.plans.render import RequestOptions, render_messages, render_requests
from docflow.plans.structured import complete_structured
from docflow.session import work_folder
from docflow.sinks.transcripts import batch_lines, write_attachment_files
from docflow.sources.files import read_attachments
from docflow.streaming.status import read_status, run_status
from docflow.workload.registry import query, stream_path, table
from docflow.workload.summaries import _reply

_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "name": {"type": "string", "enum": ["known", "unknown"]}},
           "required": ["k", "name"], "additionalProperties": False}
# A reply per event: name by event type, wrong in several ways.
_SQL_REPLIES = """r AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _replies(spark, sf):
    k = F.get_json_object("props", "$.k")
    body = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"k":'), k, F.lit(',"name":"known"}')))
            .when(F.col("event_type") == "click", F.concat(F.lit('{"k":"'), k, F.lit('","name":"other"}')))
            .when(F.col("event_type") == "error", F.col("props"))
            .when(F.col("event_type") == "signup", F.concat(F.lit('{"k":'), k, F.lit(',"name":"unknown","extra":1}')))
            .otherwise(F.concat(F.lit("broken "), k)))
    return table(spark, sf, "events").select("event_id", "event_type", k.cast("long").alias("k"), body.alias("reply"))


@query("schema_violations", f"""WITH {_SQL_REPLIES}
SELECT event_id, '/k' AS path, CASE WHEN k < 10 THEN 'minimum' ELSE 'maximum' END AS keyword FROM r
  WHERE event_type IN ('view', 'error', 'signup') AND (k < 10 OR k > 90)
UNION ALL SELECT event_id, '/k', 'type' FROM r WHERE event_type = 'click'
UNION ALL SELECT event_id, '/name', 'enum' FROM r WHERE event_type = 'click'
UNION ALL SELECT event_id, '', 'required' FROM r WHERE event_type = 'error'
UNION ALL SELECT event_id, '', 'additionalProperties' FROM r WHERE event_type = 'signup'
UNION ALL SELECT event_id, '', 'parse' FROM r WHERE event_type = 'purchase'""")
def _(spark, sf):
    rows = _replies(spark, sf).select("event_id", F.explode(violations(F.col("reply"), _SCHEMA)).alias("v"))
    return rows.select("event_id", F.col("v.instance_path").alias("path"), F.col("v.keyword").alias("keyword"))


@query("unwrap_reply", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE props END AS reply FROM events""")
def _(spark, sf):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"result":'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", unwrap_reply(reply, True).alias("reply"))


def repairing_model() -> ColumnModel:
    """Wrong at first; the second call fixes users whose prompt asks for it."""
    def fn(_system, user, _limit):
        asked = user.contains("Problems, as JSON:")
        fixable = user.rlike("^task [0-9]*[02468]:")
        return F.when(asked & fixable, F.lit('{"k":50,"name":"unknown"}')).otherwise(F.lit('{"k":5,"name":"unknown"}'))
    return ColumnModel("repairing", fn)


@query("complete_structured", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS repairs,
  CASE WHEN event_id % 2 = 0 THEN '{"k":50,"name":"unknown"}' END AS reply, CASE WHEN event_id % 2 = 1 THEN 422 END::BIGINT AS code FROM events""")
def _(spark, sf):
    requests = table(spark, sf, "events").select("event_id", F.lit("").alias("system"), F.concat(F.lit("task "), F.col("event_id").cast("string"), F.lit(": "), "event_type").alias("user"))
    out = complete_structured(requests, repairing_model(), _SCHEMA, max_repairs=2)
    return out.select("event_id", F.col("repairs").cast("long").alias("repairs"), F.when(F.col("error").isNull(), F.col("reply")).alias("reply"),
                      F.col("error.interpreted_code").cast("long").alias("code"))


@query("complete_distinct", f"""SELECT event_id, {_reply('s', "event_type || ':' || (user_id % 7)")} AS reply FROM events""")
def _(spark, sf):
    requests = table(spark, sf, "events").select("event_id", F.lit("s").alias("system"), F.concat("event_type", F.lit(":"), (F.col("user_id") % 7).cast("string")).alias("user"))
    return complete_distinct(requests, digest_model()).select("event_id", "reply")


# Failures per event: status, code and message by event type and value.
_SQL_ERRORS = """e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events),
x AS (SELECT event_id, CASE k % 8 WHEN 0 THEN 400 WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 402 WHEN 4 THEN 400 WHEN 5 THEN 503 WHEN 6 THEN NULL ELSE 404 END AS status,
  CASE WHEN event_type = 'view' THEN 'content_filter' WHEN event_type = 'click' THEN 'rate_limit_exceeded' END AS code,
  CASE k % 8 WHEN 0 THEN 'This exceeds the Maximum Context Length' WHEN 4 THEN 'blocked by filter' WHEN 6 THEN 'billing hold' WHEN 7 THEN 'Unauthorized client' ELSE 'failed' END AS message FROM e)"""


def _errors(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long") % 8
    status = (F.when(k == 0, 400).when(k == 1, 429).when(k == 2, 401).when(k == 3, 402).when(k == 4, 400).when(k == 5, 503).when(k == 7, 404))
    code = F.when(F.col("event_type") == "view", "content_filter").when(F.col("event_type") == "click", "rate_limit_exceeded")
    message = (F.when(k == 0, "This exceeds the Maximum Context Length").when(k == 4, "blocked by filter").when(k == 6, "billing hold")
               .when(k == 7, "Unauthorized client").otherwise("failed"))
    return table(spark, sf, "events").select("event_id", status.alias("status"), code.alias("code"), message.alias("message"))


_SQL_CLASSIFIED = f"""{_SQL_ERRORS}, c AS (SELECT *, CASE
  WHEN code = 'content_filter' OR (status = 400 AND contains(lower(message), 'filter')) THEN 'content_filter_violation'
  WHEN status = 400 AND contains(lower(message), 'maximum context length') THEN 'context_overflow'
  WHEN status = 429 OR code = 'rate_limit_exceeded' THEN 'rate_limit' WHEN status = 401 OR contains(lower(message), 'unauthorized') THEN 'authentication'
  WHEN status = 402 OR contains(lower(message), 'billing') THEN 'quota_exceeded' ELSE 'unclassified_api_error' END AS type FROM x),
coded AS (SELECT *, CASE type WHEN 'content_filter_violation' THEN 422 WHEN 'rate_limit' THEN 429 WHEN 'authentication' THEN 401 WHEN 'quota_exceeded' THEN 402
  ELSE coalesce(status, 500) END AS icode FROM c)"""


_THREAD = {"$ref": "#/$defs/turn", "$defs": {"turn": {
    "type": "object", "required": ["role", "n"], "properties": {"role": {"enum": ["user", "assistant"]}, "n": {"maximum": 200}, "reply": {"$ref": "#/$defs/turn"}}}}}


@query("recursive_schema", """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, role, length(text) AS n,
  repeat('/reply', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS place FROM conversations)
SELECT conv_id, place || '/n' AS instance_path, 'maximum' AS keyword FROM t WHERE n > 200
UNION ALL SELECT conv_id, place || '/role', 'enum' FROM t WHERE role NOT IN ('user', 'assistant')""")
def _(spark, sf):
    """Conversations as threads, each turn inside the one before it, against a schema that refers to itself."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))).alias("turns"))
    inner = lambda acc, t: F.concat(F.lit('{"role":"'), t["role"], F.lit('","n":'), t["n"].cast("string"),
                                    F.coalesce(F.concat(F.lit(',"reply":'), acc), F.lit("")), F.lit("}"))
    threads = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.aggregate("turns", F.lit(None).cast("string"), inner).alias("reply"))
    return find_violations(threads, _THREAD, "conv_id").select("conv_id", "instance_path", "keyword")


@query("classify_errors", f"""WITH {_SQL_CLASSIFIED} SELECT event_id, type AS interpreted_type, CAST(icode AS BIGINT) AS interpreted_code FROM coded""")
def _(spark, sf):
    return classify_errors(_errors(spark, sf)).select("event_id", "interpreted_type", F.col("interpreted_code").cast("long").alias("interpreted_code"))


@query("errors_json", f"""WITH {_SQL_CLASSIFIED} SELECT event_id, '{{"exception":"Error","provider":"openai","message":' || to_json(message) || ',"interpretedErrorType":"' || type ||
  '","interpretedCode":' || icode || ',"interpretedMessage":"' || CASE type
    WHEN 'content_filter_violation' THEN 'Content was filtered due to policy violations. Please try with different content.'
    WHEN 'context_overflow' THEN 'Too many tokens for model' WHEN 'rate_limit' THEN 'Rate limit exceeded. Please try again later.'
    WHEN 'authentication' THEN 'Authentication failed. Please check API credentials.'
    WHEN 'quota_exceeded' THEN 'API quota exceeded. Please check your billing and usage limits.' ELSE 'An error occurred while processing your request.' END || '"}}' AS json,
  CAST(icode AS BIGINT) AS http_status, type AS type_back FROM coded""")
def _(spark, sf):
    rows = error_column(classify_errors(_errors(spark, sf)), "openai").withColumn("json", errors_to_json(F.col("error")))
    return rows.select("event_id", "json", http_status(F.col("json")).cast("long").alias("http_status"),
                       errors_from_json(F.col("json"))["interpreted_type"].alias("type_back"))


@query("retry_plan", """WITH a AS (SELECT user_id AS request_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS attempt, event_type, event_id FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) AS r FROM a)
SELECT request_id, attempt + 1 AS next_attempt, CAST(least(8000, 250 * pow(2, attempt - 1)) AS BIGINT) AS backoff_cap_ms FROM l
WHERE r = 1 AND attempt < 1000 AND event_type <> 'view' AND event_id % 11 <> 0 AND event_type IN ('error', 'click', 'signup')""")
def _(spark, sf):
    from pyspark.sql import Window
    numbered = table(spark, sf, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    attempts = numbered.select(
        F.col("user_id").alias("request_id"), "attempt", (F.col("event_type") == "view").alias("ok"),
        F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "click", 429).when(F.col("event_type") == "purchase", 404).alias("status"),
        (F.col("event_id") % 11 == 0).alias("aborted"))
    return retry_plan(attempts, max_attempts=1000)


_MODELS = {"fast": {"num_schema_repair_max_attempts": 15, "ms_client_request_timeout": 610001, "temperature": 0.0},
           "big": {"num_defective_reply_max_attempts": 16, "system": "Think."}, "view": "click", "click": "fast", "error": "big", "signup": "purchase", "purchase": "signup"}


@query("resolve_policy", """SELECT event_id, CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'fast' WHEN 'error' THEN 'big' END AS resolved_model,
  event_type IN ('signup', 'purchase') AS failed,
  CAST(CASE WHEN event_id % 3 = 0 THEN 35 WHEN event_type IN ('view', 'click') THEN 15 ELSE 25 END AS BIGINT) AS repairs,
  CAST(CASE WHEN event_type = 'error' THEN 16 ELSE 5 END AS BIGINT) AS defective, CAST(2 AS BIGINT) AS attempts,
  CAST(CASE WHEN event_type IN ('view', 'click') THEN 610001 ELSE 600000 END AS BIGINT) AS timeout,
  CASE WHEN event_type = 'error' THEN 'Think.' ELSE 'You are a helpful assistant.' END AS system,
  CAST(CASE WHEN event_type IN ('view', 'click') THEN 0.0 ELSE 0.8 END AS DOUBLE) AS temperature FROM events""")
def _(spark, sf):
    requests = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 == 0, 35).alias("num_schema_repair_max_attempts"))
    out = resolve_policy(requests.withColumnRenamed("num_schema_repair_max_attempts", "r").withColumnRenamed("r", "num_schema_repair_max_attempts"), _MODELS,
                         {"num_schema_repair_max_attempts": 25})
    names = dict(zip(LIMITS, ("repairs", "defective", "attempts", "timeout")))
    return out.select("event_id", "resolved_model", F.col("model_error").isNotNull().alias("failed"), *[F.col(k).alias(v) for k, v in names.items()], "system", "temperature")


_SQL_PROGRESS = """WITH o AS (SELECT user_id % 50 AS job_id, CASE event_type WHEN 'error' THEN CASE WHEN user_id % 50 < 10 THEN 'error' ELSE 'done' END WHEN 'view' THEN
    CASE WHEN user_id % 50 < 30 THEN 'pending' ELSE 'done' END ELSE 'done' END AS state FROM events)
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE state = 'done') AS BIGINT) AS completed,
  CAST(count(*) FILTER (WHERE state = 'error') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE state = 'done') * 100 // count(*) AS BIGINT) AS percent,
  CASE WHEN count(*) FILTER (WHERE state = 'error') > 0 THEN 'error' WHEN count(*) FILTER (WHERE state <> 'done') = 0 THEN 'complete' ELSE 'processing' END AS status
FROM o GROUP BY job_id"""


def _outcomes(events):
    job = F.col("user_id") % 50
    state = (F.when((F.col("event_type") == "error") & (job < 10), "error").when((F.col("event_type") == "view") & (job < 30), "pending").otherwise("done"))
    return events.select(job.cast("long").alias("job_id"), state.alias("state"))


@query("job_progress", _SQL_PROGRESS)
def _(spark, sf):
    return job_progress(_outcomes(table(spark, sf, "events")))


@query("job_status_stream", _SQL_PROGRESS)
def _(spark, sf):
    """The same counts kept as the state of a stream over the files of the events table."""
    folder = work_folder(spark)
    run_status(spark, stream_path(sf, "events"), "user_id bigint, event_type string", _outcomes, f"{folder}/out", f"{folder}/state")
    return read_status(spark, f"{folder}/out")


def _calls(spark, sf):
    k, b = F.get_json_object("props", "$.k").cast("int"), (F.col("user_id") % 4).cast("int")
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "subtract", "multiply", "divide", "power")]), (k % 5 + 1).cast("int"))
    name = (F.when(F.col("event_type") == "view", "echo").when(F.col("event_type") == "click", "pick_file").when(F.col("event_type") == "signup", "nope").otherwise("calculator"))
    args = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message")))).otherwise(
        F.to_json(F.struct(op.alias("operation"), k.alias("a"), b.alias("b"))))
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("call_id"), name.alias("tool_name"), args.alias("arguments"))


@query("tool_calls", """WITH c AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 4 AS b FROM events),
d AS (SELECT *, ['add', 'subtract', 'multiply', 'divide', 'power'][(k % 5 + 1)::BIGINT] AS op, CASE k % 5 WHEN 0 THEN k + b WHEN 1 THEN k - b WHEN 2 THEN k * b
  WHEN 3 THEN CASE WHEN b <> 0 THEN k / CAST(b AS DOUBLE) END END AS v FROM c)
SELECT CAST(event_id AS VARCHAR) AS call_id, CASE event_type WHEN 'view' THEN '{"message":"m' || event_id || '"}'
    WHEN 'click' THEN NULL WHEN 'signup' THEN NULL ELSE CASE WHEN v IS NOT NULL THEN '{"operation":"' || op || '","a":' || k || ',"b":' || b || ',"result":' ||
      (CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END) || '}' END END AS content,
  CASE WHEN event_type = 'click' THEN 'Client tools cannot be executed on the server' WHEN event_type = 'signup' THEN 'Tool not found: nope'
    WHEN event_type <> 'view' AND op = 'divide' AND b = 0 THEN 'Division by zero' WHEN event_type <> 'view' AND op = 'power' THEN 'Unknown operation: power' END AS error FROM d""")
def _(spark, sf):
    tools = ToolRegistry([echo_tool(), calculator_tool(), ToolSpec("pick_file", kind="client")])
    return execute_tool_calls(_calls(spark, sf), tools).select("call_id", "content", "error")


def _turns(spark, sf):
    return T.text_turns(table(spark, sf, "conversations"))


@query("concat_transcripts", """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) + 1 AS n FROM conversations)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, sha256(text) AS text_hash FROM t
UNION ALL SELECT conv_id, CAST(turn + n AS BIGINT), role, sha256(text) FROM t""")
def _(spark, sf):
    both = T.concat_transcripts(_turns(spark, sf), _turns(spark, sf))
    return both.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2(T.message_text(F.col("parts")), 256).alias("text_hash"))


_SQL_MESSAGES = """m AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, '[' || string_agg('{"role":"' || role || '","content":' || to_json(text) || '}', ',' ORDER BY turn) || ']' AS msgs,
  max(turn) + 1 AS n FROM conversations GROUP BY conv_id)"""


@query("extend_transcripts", f"""WITH {_SQL_MESSAGES} SELECT conv_id, CAST(n AS BIGINT) AS turn, 'assistant' AS role, {_reply('Help.', 'msgs')} AS text FROM m""")
def _(spark, sf):
    suffix, _ = extend_transcripts(_turns(spark, sf), digest_model(), "Help.")
    return suffix.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", T.message_text(F.col("parts")).alias("text"))


def _counting_model() -> ColumnModel:
    """Asks for a product as long as a conversation has fewer tool results than user messages, then replies."""
    def reply(_system, user, _limit):
        count = lambda role: ((F.length(user) - F.length(F.replace(user, F.lit(f'"role":"{role}"'), F.lit("")))) / len(f'"role":"{role}"')).cast("int")
        done, wanted = count("tool_response"), count("user")
        number = lambda c: c.cast("string")
        ask = F.concat(F.lit('{"tool_calls":[{"name":"calculator","call_id":"c'), number(done), F.lit('","arguments":{"operation":"multiply","a":'),
                       number(done + 2), F.lit(',"b":'), number(wanted), F.lit("}}]}"))
        return F.when(done < wanted, ask).otherwise(F.concat(F.lit("done "), number(done)))
    return ColumnModel("counting", reply)


@query("tool_rounds", """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, max(turn) + 1 AS n, count(*) FILTER (WHERE role = 'user') AS r FROM conversations GROUP BY conv_id),
k AS (SELECT *, unnest(range(r)) AS k FROM c)
SELECT conv_id, CAST(n + 2 * k AS BIGINT) AS turn, 'tool_call' AS role, '{"a":' || (k + 2) || ',"b":' || r || ',"operation":"multiply"}' AS shown FROM k
UNION ALL SELECT conv_id, CAST(n + 2 * k + 1 AS BIGINT), 'tool_response',
  '"{\\"operation\\":\\"multiply\\",\\"a\\":' || (k + 2) || ',\\"b\\":' || r || ',\\"result\\":' || (k + 2) * r || '}"' FROM k
UNION ALL SELECT conv_id, CAST(n + 2 * r AS BIGINT), 'assistant', 'done ' || r FROM c""")
def _(spark, sf):
    suffix, _ = extend_transcripts(_turns(spark, sf), _counting_model(), "Help.", tools=ToolRegistry([calculator_tool()]))
    one = F.get("parts", F.lit(0))
    return suffix.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(one["arguments"], one["response"], one["text"]).alias("shown"))


@query("render_messages", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, sha256('{"role":"' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END
  || '","content":[{"type":"text","text":' || to_json(text) || '}]}') AS anthropic_hash FROM conversations""")
def _(spark, sf):
    rows = render_messages(_turns(spark, sf), "anthropic")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.sha2(F.array_join("messages", ","), 256).alias("anthropic_hash"))


@query("render_requests", f"""WITH {_SQL_MESSAGES},
o AS (SELECT conv_id, 'openai' AS provider, '{{"model":"gpt-4o","messages":[{{"role":"developer","content":"Help."}},' || substr(msgs, 2) || ',"temperature":0.5,"stream":false,"max_tokens":256}}' AS body FROM m
  UNION ALL SELECT conv_id, 'reasoning', '{{"model":"o3-mini","messages":' || msgs || ',"reasoning_effort":"high"}}' FROM m
  UNION ALL SELECT conv_id, 'ollama', '{{"model":"llama","messages":' || msgs || ',"stream":false,"tools":[],"options":{{"temperature": 0.8}}}}' FROM m
  UNION ALL SELECT CAST(conv_id AS VARCHAR), 'google', '{{"model":"g","contents":[' || coalesce(string_agg('{{"role":"' || CASE role WHEN 'assistant' THEN 'model' ELSE role END ||
      '","parts":[{{"text":' || to_json(text) || '}}]}}', ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') || '],"generationConfig":{{}}}}' FROM conversations GROUP BY conv_id)
SELECT conv_id, provider, sha256(body) AS body_hash FROM o""")
def _(spark, sf):
    turns = _turns(spark, sf)
    named = lambda df, name: df.select("conv_id", F.lit(name).alias("provider"), F.sha2("body", 256).alias("body_hash"))
    out = named(render_requests(turns, "openai", RequestOptions("gpt-4o", "Help.", 0.5, 256)), "openai")
    out = out.unionByName(named(render_requests(turns, "openai", RequestOptions("o3-mini", None, 0.5, 256)), "reasoning"))
    out = out.unionByName(named(render_requests(turns, "ollama", RequestOptions("llama")), "ollama"))
    return out.unionByName(named(render_requests(turns, "google", RequestOptions("g")), "google"))


@query("batch_lines", f"""WITH {_SQL_MESSAGES}
SELECT CAST(conv_id AS VARCHAR) AS conv_id, 'ollama' AS provider, 'llama' AS model, '{{"custom_id":' || to_json(CAST(conv_id AS VARCHAR)) ||
  ',"body":{{"model":"llama","messages":' || msgs || ',"stream":false,"tools":[],"options":{{"temperature": 0.8}}}}}}' AS line FROM m""")
def _(spark, sf):
    requests = render_requests(_turns(spark, sf), "ollama", RequestOptions("llama"))
    return batch_lines(requests, "ollama", "llama").select("conv_id", "provider", "model", F.col("value").alias("line"))


def _tool_turns(spark, sf):
    """Each event as a call in its user's conversation; most are answered."""
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("conv_id"), F.col("event_id").cast("int").alias("turn"),
                                               F.col("event_id").cast("string").alias("call_id"), "event_type", "props")
    call = events.select("conv_id", F.col("turn") * 2, F.lit("tool_call"), F.array(T.part("tool_call", tool_name=F.col("event_type"), call_id=F.col("call_id"), arguments=F.col("props"))))
    answered = events.where("event_type <> 'error'").select("conv_id", F.col("turn") * 2 + 1, F.lit("tool_response"), F.array(
        T.part("tool_response", tool_name=F.col("event_type"), call_id=F.col("call_id"), response=F.get_json_object("props", "$.k"))))
    return call.unionAll(answered).toDF("conv_id", "turn", "role", "parts")


@query("match_tool_results", """SELECT CAST(user_id AS VARCHAR) AS conv_id, CAST(event_id AS VARCHAR) AS call_id, event_type AS tool_name,
  CAST(event_id * 2 AS BIGINT) AS call_turn, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS response FROM events""")
def _(spark, sf):
    out = T.match_tool_results(_tool_turns(spark, sf))
    return out.select("conv_id", "call_id", "tool_name", F.col("call_turn").cast("long").alias("call_turn"), "response")


@query("pending_tool_calls", """SELECT CAST(user_id AS VARCHAR) AS conv_id, CAST(event_id AS VARCHAR) AS call_id, event_type AS tool_name FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    return T.pending_tool_calls(_tool_turns(spark, sf)).select("conv_id", "call_id", "tool_name")


@query("transcript_roundtrip", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, role, sha256(text) AS text_hash FROM conversations""")
def _(spark, sf):
    back = T.read_transcripts(T.transcripts_json(_turns(spark, sf)), "json")
    return back.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2(T.message_text(F.col("parts")), 256).alias("text_hash"))


@query("attach_parts", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS n_parts,
  CASE WHEN turn % 2 = 0 THEN 'note.md' END AS filename FROM conversations""")
def _(spark, sf):
    turns = _turns(spark, sf)
    even = turns.where("turn % 2 = 0")
    image = even.select("conv_id", "turn", F.lit(1).alias("idx"), T.part("image", url=F.lit("data:image/png;base64,AA==")).alias("part"))
    note = even.select("conv_id", "turn", F.lit(0).alias("idx"), T.part("document", filename=F.lit("note.md"), text=T.message_text(F.col("parts"))).alias("part"))
    out = T.attach_parts(turns, image.unionByName(note))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), F.size("parts").cast("long").alias("n_parts"), F.get("parts", F.lit(1))["filename"].alias("filename"))


@query("attachment_files", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn, 'document' AS kind, 'note.md' AS filename,
  sha256(text) AS content_hash FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn AS BIGINT), 'image', NULL,
  sha256('data:image/png;base64,iVBORw0KGgo=') FROM conversations WHERE turn % 2 = 0""")
def _(spark, sf):
    """Every message as an attached note, some with an image too, written as files and read back."""
    turns = _turns(spark, sf)
    note = turns.select("conv_id", "turn", F.lit(0).alias("idx"), T.part("document", filename=F.lit("note.md"), text=T.message_text(F.col("parts"))).alias("part"))
    image = turns.where("turn % 2 = 0").select("conv_id", "turn", F.lit(1).alias("idx"), T.part("image", url=F.lit("data:image/png;base64,iVBORw0KGgo=")).alias("part"))
    folder = f"{work_folder(spark)}/files"
    write_attachment_files(T.attach_parts(turns, note.unionByName(image)), folder)
    back = read_attachments(spark, folder)
    place = lambda k: F.regexp_extract("path", r"/([^/]+)/(\d+)-\d+-[^/]+$", k)
    return back.select(place(1).alias("conv_id"), place(2).cast("long").alias("turn"), "part.kind",
                       F.regexp_extract("part.filename", r"\d+-\d+-(.*)$", 1).alias("filename"),
                       F.sha2(F.coalesce("part.text", "part.url"), 256).alias("content_hash"))
