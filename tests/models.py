"""Scripted models for tests; importable by Python workers."""

import json
import re


class Scripted:
    """Replies by a function of the request."""

    def __init__(self, fn):
        self.fn = fn

    def __call__(self, request):
        return self.fn(request)


def open_none():
    return None


class Refused(Exception):
    status = 400
    interpreted_type = "content_filter_violation"
    interpreted_code = 422


def digest_call(_client, request):
    """The digest column model as a callable."""
    import hashlib
    return hashlib.sha256((request["system"] + "\n" + request["user"]).encode()).hexdigest()[:16]


def bracket_call(_client, request):
    part = lambda name: re.search(rf'\[{name}\]\n"(.*?)"\n\n', request["user"], re.S).group(1)
    return f"({part('first')}+{part('second')})"


def refusing_bracket_call(client, request):
    """Merges, but refuses to merge anything with a part that says "bad"."""
    merged = bracket_call(client, request)
    if "bad" in merged:
        raise Refused("blocked")
    return merged


def picky_embed(_client, texts):
    if any("bad" in t for t in texts):
        raise ValueError("no vector for this")
    return [[float(len(t))] for t in texts]


def budget_call(_client, request):
    chunk = re.search(r'<chunk id="[^"]*">\n(.*?)\n</chunk>\Z', request["user"], re.S).group(1)
    words = re.findall(r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+\Z", chunk)
    return "".join(words[:int(request["max_output_tokens"])])


def flaky_call(_client, request):
    """Empty until the third attempt."""
    return "" if request["attempt"] < 2 else f"ok after {request['attempt']}"


def repair_call(_client, request):
    """Invalid first; valid once a repair was asked for, unless the user says never."""
    history = request["history"]
    if len(history) == 0 or "never" in request["user"]:
        return '{"name":123,"status":"bad"}'
    assert history[0]["role"] == "assistant" and '"keyword":"type"' in history[1]["content"] and "must be string" in history[1]["content"]
    return '{"name":"Alice","status":"unknown"}'


def empty_object_call(_client, _request):
    return "{}"


def failing_call(_client, request):
    if "bad" in request["user"]:
        raise Refused("image blocked by content safety")
    return "fine"


def tool_call_model(_client, request):
    """Asks for tools by the conversation's last message."""
    messages = json.loads(request["user"])
    last = messages[-1]
    if last["role"] == "user":
        text = last["content"]
        if text.startswith("calc"):
            return json.dumps({"tool_calls": [{"name": "calculator", "call_id": "c1", "arguments": {"operation": "multiply", "a": 12, "b": 34}},
                                              {"name": "echo", "arguments": {"message": "hi"}}]})
        if text.startswith("client"):
            return json.dumps({"tool_calls": [{"name": "echo", "call_id": "e", "arguments": {"message": "x"}},
                                              {"name": "pick_file", "call_id": "p", "arguments": {}, "rationale": "need it"}]})
        if text.startswith("loop"):
            return json.dumps({"tool_calls": [{"name": "echo", "call_id": "l", "arguments": {"message": "again"}}]})
        return "plain answer"
    if "again" in json.dumps(last):
        return json.dumps({"tool_calls": [{"name": "echo", "arguments": {"message": "again"}}]})
    return "tools said " + "; ".join(p["response"] for p in last["content"])


def embed_lengths(_client, texts):
    return [[float(len(t)), 1.0] for t in texts]


def double(x):
    """Doubles x."""
    return {"result": 2 * x}
