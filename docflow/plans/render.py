"""Provider request bodies from turns, for offline batch files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.dataurl import DATA_URL
from docflow.functions.jsonx import json_number, json_object
from docflow.functions.schema_check import wrap_schema
from docflow.functions.text import json_string
from docflow.operators.ordering import concat_ordered

# Fixed value: what stands for the reason of a call that gives none.
NO_RATIONALE = "A tool is called."

PROVIDERS = ("openai", "anthropic", "ollama", "google")


@dataclass(frozen=True)
class RequestOptions:
    """Settings of a request; ``tools`` are (name, description, input schema) dicts."""

    model: str
    system: str | None = None
    temperature: float | None = None
    max_output_tokens: int | None = None
    tools: tuple[dict, ...] = ()
    schema: dict | None = None
    reasoning_effort: str = "high"
    verbosity: str | None = None
    stream: bool = False
    extra: dict = field(default_factory=dict)


def _obj(**members: Column) -> Column:
    return json_object(*members.items())


def _str(text: str) -> Column:
    return F.lit(json.dumps(text, ensure_ascii=False))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _q(c: Column) -> Column:
    return F.coalesce(json_string(c), F.lit("null"))


def _response_text(p: Column) -> Column:
    """A tool response as text: strings raw, other values as JSON."""
    return F.when(p["response"].startswith('"'), F.try_variant_get(F.try_parse_json(p["response"]), "$", "string")).otherwise(p["response"])


def _text_block(c: Column) -> Column:
    return _obj(type=_str("text"), text=_q(c))


def _openai(role: Column, parts: Column) -> Column:
    """Array of message JSONs of one turn (one per tool response)."""
    calls = _array(F.transform(parts, lambda p: _obj(id=_q(p["call_id"]), type=_str("function"), function=_obj(
        name=_q(p["tool_name"]), arguments=_q(F.coalesce(p["arguments"], F.lit("{}")))))))
    item = lambda p: F.when(p["kind"] == "image", _obj(type=_str("image_url"), image_url=_obj(url=_q(p["url"]), detail=_str("high")))).otherwise(_text_block(p["text"]))
    single = (F.size(parts) == 1) & (parts[0]["kind"] != "image")
    content = F.when(single, _q(parts[0]["text"])).otherwise(_array(F.transform(parts, item)))
    return (F.when(role == "tool_call", F.array(_obj(role=_str("assistant"), content=F.lit("null"), tool_calls=calls)))
            .when(role == "tool_response", F.transform(parts, lambda p: _obj(
                role=_str("tool"), tool_call_id=_q(p["call_id"]), content=_q(_response_text(p)))))
            .otherwise(F.array(_obj(role=_q(role), content=content))))


def _anthropic(role: Column, parts: Column) -> Column:
    def call(p):
        said = F.concat(F.lit("<thinking>"), F.coalesce(F.nullif(p["rationale"], F.lit("")), F.lit(NO_RATIONALE)), F.lit("</thinking>"))
        use = _obj(type=_str("tool_use"), id=_q(p["call_id"]), name=_q(p["tool_name"]), input=F.coalesce(p["arguments"], F.lit("{}")))
        return F.when(p["kind"] == "tool_call", F.array(_text_block(said), use)).otherwise(F.array(_text_block(p["text"])))

    def image(p):
        ok = p["url"].rlike(DATA_URL)
        mime = F.when(ok, F.regexp_extract(p["url"], DATA_URL, 1)).otherwise(F.lit("image/png"))
        data = F.when(ok, F.regexp_extract(p["url"], DATA_URL, 2)).otherwise(F.lit(""))
        return _obj(type=_str("image"), source=_obj(type=_str("base64"), media_type=_q(mime), data=_q(data)))

    result = lambda p: _obj(type=_str("tool_result"), tool_use_id=_q(p["call_id"]), content=F.coalesce(p["response"], F.lit("null")))
    item = lambda p: F.when(p["kind"] == "image", image(p)).otherwise(_text_block(p["text"]))
    return (F.when(role == "tool_call", F.array(_obj(role=_str("assistant"), content=_array(F.flatten(F.transform(parts, call))))))
            .when(role == "tool_response", F.array(_obj(role=_str("user"), content=_array(F.transform(
                F.filter(parts, lambda p: p["kind"] == "tool_response"), result)))))
            .otherwise(F.array(_obj(role=F.when(role == "user", _str("user")).otherwise(_str("assistant")), content=_array(F.transform(parts, item))))))


def _ollama(role: Column, parts: Column) -> Column:
    named = (F.when(role.isin("system", "user", "assistant", "tool", "function"), role)
             .when(role.isin("tool_call", "tool_response"), F.lit("assistant")).otherwise(F.lit("user")))
    text = F.transform(F.filter(parts, lambda p: p["kind"] != "image"), lambda p: F.when(
        p["kind"] == "tool_call", F.concat(F.lit("[ToolCall: "), p["tool_name"], F.lit(", arguments: "), F.coalesce(p["arguments"], F.lit("{}")), F.lit("]"))).when(
        p["kind"] == "tool_response", F.concat(F.lit("[ToolResponse from "), p["tool_name"], F.lit(": "), F.coalesce(_response_text(p), F.lit("null")), F.lit("]")))
        .otherwise(p["text"]))
    images = F.transform(F.filter(parts, lambda p: p["kind"] == "image"), lambda p: _q(p["url"]))
    return F.array(_obj(role=_q(named), content=_q(F.array_join(text, "\n")), images=F.when(F.size(images) > 0, _array(images))))


def _google(role: Column, parts: Column) -> Column:
    def item(p):
        data = p["url"].rlike(DATA_URL)
        inline = _obj(inline_data=_obj(mime_type=_q(F.regexp_extract(p["url"], DATA_URL, 1)), data=_q(F.regexp_extract(p["url"], DATA_URL, 2))))
        return (F.when(p["kind"] == "text", _obj(text=_q(p["text"])))
                .when((p["kind"] == "image") & data, inline)
                .when((p["kind"] == "image") & ~p["url"].startswith("data:"), _obj(fileData=_obj(fileUri=_q(p["url"]), mimeType=_str("image/jpeg")))))
    kept = F.filter(F.transform(parts, item), lambda x: x.isNotNull())
    named = F.when(role == "assistant", F.lit("model")).otherwise(role)
    return F.when(role.isin("system", "tool_call", "tool_response"), F.array().cast("array<string>")).otherwise(F.array(_obj(role=_q(named), parts=_array(kept))))


_MESSAGES = {"openai": _openai, "anthropic": _anthropic, "ollama": _ollama, "google": _google}


def render_messages(turns: DataFrame, provider: str) -> DataFrame:
    """(conv_id, turn, messages): provider message JSONs of each turn, row by row."""
    if provider not in _MESSAGES:
        raise ValueError(f"unknown provider: {provider}")
    return turns.select("conv_id", "turn", _MESSAGES[provider](F.col("role"), F.col("parts")).alias("messages"))


def _tools_json(provider: str, tools: tuple[dict, ...]) -> Column | None:
    if not tools:
        return F.lit("[]") if provider == "ollama" else None
    schema = lambda t: t.get("input_schema", {"type": "object", "properties": {}})
    if provider == "anthropic":
        rows = [{"name": t["name"], "description": t.get("description"), "input_schema": schema(t)} for t in tools]
    else:
        rows = [{"type": "function", "function": {"name": t["name"], "description": t.get("description"), "parameters": schema(t)}} for t in tools]
    return F.lit(json.dumps(rows, ensure_ascii=False))


def model_parameters(options: RequestOptions) -> dict[str, Column]:
    """Parameters a chat-completions model accepts, by the rules for its name."""
    name = options.model
    out: dict[str, Column] = {}
    if options.temperature is not None:
        out["temperature"] = json_number(F.lit(options.temperature))
    out["stream"] = F.lit(str(options.stream).lower())
    if options.max_output_tokens is not None and not name.startswith(("o3", "gpt5")):
        out["max_tokens"] = F.lit(str(options.max_output_tokens))
    if options.schema is not None:
        wrapped, _ = wrap_schema(options.schema)
        out["response_format"] = F.lit(json.dumps({"type": "json_schema", "json_schema": {"name": "forced-schema", "schema": wrapped}}))
    # Names of models that reason and so take no sampling parameters.
    reasoning = name.startswith("o") or name in ("gpt-5", "gpt-5-mini")
    if reasoning:
        out.pop("temperature", None)
        out.pop("stream", None)
        if name != "o1-preview":
            out["reasoning_effort"] = _str(options.reasoning_effort)
        if name.startswith("gpt-5") and options.verbosity:
            out["verbosity"] = _str(options.verbosity)
    return out


def render_requests(turns: DataFrame, provider: str, options: RequestOptions) -> DataFrame:
    """(conv_id, body, reason): one request body per conversation.

    Conversations too long for one request come back with reason ``context_overflow``
    (their messages stay available row by row through ``render_messages``).
    """
    rendered = render_messages(turns, provider).where(F.size("messages") > 0)
    rows = rendered.withColumn("_m", F.array_join("messages", ","))
    joined = concat_ordered(rows, ["conv_id"], "turn", "_m", ",", "_messages").withColumn("_found", F.lit(True))
    # A conversation of only dropped turns still yields a request.
    everyone = turns.select("conv_id").distinct().join(joined, "conv_id", "left")
    body_text = F.when(F.col("_found").isNull(), F.lit("")).otherwise(F.col("_messages"))
    lead = ""
    if options.system is not None and provider in ("openai", "ollama"):
        lead = json.dumps({"role": "developer" if provider == "openai" else "system", "content": options.system}, ensure_ascii=False, separators=(",", ":"))
    comma = F.when((body_text != "") & F.lit(bool(lead)), ",").otherwise("")
    messages = F.concat(F.lit("[" + lead), comma, body_text, F.lit("]"))
    model, tools = _str(options.model), _tools_json(provider, options.tools)
    opt = lambda v: [] if v is None else [v]
    if provider == "openai":
        members = [("model", model), ("messages", messages), *model_parameters(options).items(), *[("tools", t) for t in opt(tools)]]
    elif provider == "anthropic":
        members = [("model", model), ("max_tokens", F.lit(str(options.max_output_tokens or 4096))),
                   *[("temperature", json_number(F.lit(t))) for t in opt(options.temperature)],
                   *[("system", _str(s)) for s in opt(options.system)], ("messages", messages),
                   *[("tools", t) for t in opt(tools)], ("stream", F.lit(str(options.stream).lower()))]
    elif provider == "ollama":
        temperature = 0.8 if options.temperature is None else options.temperature
        members = [("model", model), ("messages", messages), ("stream", F.lit(str(options.stream).lower())), ("tools", tools),
                   ("options", F.lit(json.dumps({"temperature": temperature}))),
                   *[("format", F.lit(json.dumps(s))) for s in opt(options.schema)]]
    else:
        generation = {} if options.temperature is None else {"temperature": options.temperature}
        members = [("model", model), ("contents", messages), ("generationConfig", F.lit(json.dumps(generation))),
                   *[("systemInstruction", F.lit(json.dumps({"parts": [{"text": s}]}, ensure_ascii=False))) for s in opt(options.system)]]
    members += [(k, F.lit(json.dumps(v))) for k, v in options.extra.items()]
    return everyone.select("conv_id", F.when(body_text.isNotNull(), json_object(*members)).alias("body"),
                           F.when(body_text.isNull(), F.lit("context_overflow")).alias("reason"))
