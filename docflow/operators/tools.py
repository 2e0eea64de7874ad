"""Tools over tables of calls."""

from __future__ import annotations

import inspect
import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.jsonx import bind, json_number, json_object
from docflow.functions.text import json_string
from docflow.session import small

log = logging.getLogger(__name__)
OUTCOME = "struct<content:string,error:string>"
CLIENT_ERROR = "Client tools cannot be executed on the server"


@dataclass(frozen=True)
class ToolSpec:
    """``column(arguments JSON text) -> struct(content, error)`` runs natively;
    ``batch(dict) -> result`` runs in Python, its exceptions become error rows."""

    name: str
    description: str = ""
    input_schema: dict | None = None
    kind: str = "server"        # server, client or mcp
    column: Callable[[Column], Column] | None = None
    batch: Callable[[dict], object] | None = None

    @classmethod
    def from_function(cls, fn: Callable, kind: str = "server") -> "ToolSpec":
        """Wrap a function; its parameters give the input schema."""
        names = list(inspect.signature(fn).parameters)
        schema = {"type": "object", "properties": {n: {"type": "any", "description": ""} for n in names}, "required": names}
        return cls(fn.__name__, inspect.getdoc(fn) or "No description available.", schema, kind, batch=lambda args: fn(**args))


class ToolRegistry:
    """Tools by name. A second registration of a name is skipped with a warning."""

    def __init__(self, tools: Iterable[ToolSpec] = ()):
        self._tools: dict[str, ToolSpec] = {}
        for tool in tools:
            self.register(tool)

    def register(self, tool: ToolSpec) -> None:
        if tool.name in self._tools:
            log.warning("tool %s is already registered; skipped", tool.name)
            return
        self._tools[tool.name] = tool

    def unregister(self, name: str) -> None:
        self._tools.pop(name, None)

    def get(self, name: str) -> ToolSpec | None:
        return self._tools.get(name)

    def by_kind(self, kind: str) -> list[ToolSpec]:
        return [t for t in self._tools.values() if t.kind == kind]

    def has_client_tools(self) -> bool:
        return bool(self.by_kind("client"))

    def definitions(self) -> tuple[dict, ...]:
        return tuple({"name": t.name, "description": t.description, "input_schema": t.input_schema or {"type": "object", "properties": {}}}
                     for t in self._tools.values())

    def __iter__(self):
        return iter(self._tools.values())


def registry_table(spark, tools: ToolRegistry) -> DataFrame:
    """(tool_name, kind, native) - one row per registered tool, so always small."""
    rows = [(t.name, t.kind, t.column is not None) for t in tools]
    return spark.createDataFrame(rows, "tool_name string, kind string, native boolean")


def execute_tool_calls(calls: DataFrame, tools: ToolRegistry) -> DataFrame:
    """Add ``content`` and ``error`` to ``calls(tool_name, call_id, arguments, …)``.

    Unknown tools, client tools and failing calls are error rows. Native tools are
    expressions; only calls of Python tools leave the JVM.
    """
    looked = calls.join(small(registry_table(calls.sparkSession, tools), len(list(tools))), "tool_name", "left")
    runnable = F.col("kind").isNotNull() & (F.col("kind") != "client")
    native = F.struct(F.lit(None).cast("string").alias("content"), F.lit("tool has no implementation").alias("error")).cast(OUTCOME)
    branch = (F.when(F.col("kind").isNull(), _outcome(None, F.concat(F.lit("Tool not found: "), "tool_name")))
              .when(F.col("kind") == "client", _outcome(None, F.lit(CLIENT_ERROR))))
    for tool in tools:
        if tool.column is not None and tool.kind != "client":
            branch = branch.when(F.col("tool_name") == tool.name, tool.column(F.col("arguments")).cast(OUTCOME))
    python = {t.name: t.batch for t in tools if t.column is None and t.batch is not None and t.kind != "client"}
    in_python = F.col("tool_name").isin(*python) if python else F.lit(False)
    done = (looked.where(~(runnable & in_python)).withColumn("_o", branch.otherwise(native))
            .select(*calls.columns, "_o.content", "_o.error"))
    if not python:
        return done

    def run(batches):
        for pdf in batches:
            contents, errors = [], []
            for name, args in zip(pdf.tool_name, pdf.arguments):
                try:
                    result = python[name](json.loads(args or "{}"))
                    contents.append(result if isinstance(result, str) else json.dumps(result, separators=(",", ":"), ensure_ascii=False))
                    errors.append(None)
                except Exception as err:  # a failing tool is a row
                    contents.append(None)
                    errors.append(str(err))
            yield pdf.assign(content=contents, error=errors)

    fields = ", ".join(f"`{n}` {t}" for n, t in calls.dtypes)
    return done.unionByName(looked.where(runnable & in_python).select(*calls.columns)
                            .mapInPandas(run, f"{fields}, content string, error string"))


def _outcome(content: Column | None, error: Column | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if content is None else content).alias("content"), (null if error is None else error).alias("error")).cast(OUTCOME)


def echo_tool() -> ToolSpec:
    """Gives its ``message`` back."""
    def column(args: Column) -> Column:
        message = F.get_json_object(args, "$.message")
        return _outcome(F.when(message.isNull(), F.lit("{}")).otherwise(json_object(("message", json_string(message)))), None)
    schema = {"type": "object", "properties": {"message": {"type": "string"}}, "required": ["message"]}
    return ToolSpec("echo", "Echoes the message", schema, column=column)


def calculator_tool() -> ToolSpec:
    """The four operations on ``a`` and ``b``."""
    def column(args: Column) -> Column:
        return bind(F.from_json(args, "operation string, a double, b double"), outcome)

    def outcome(call: Column) -> Column:
        op, a, b = call["operation"], call["a"], call["b"]
        value = (F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b)
                 .when((op == "divide") & (b != 0), a / b))
        error = (F.when((op == "divide") & (b == 0), F.lit("Division by zero"))
                 .when(F.coalesce(~op.isin("add", "subtract", "multiply", "divide"), F.lit(True)),
                       F.concat(F.lit("Unknown operation: "), F.coalesce(op, F.lit("undefined")))))
        number = lambda c: F.coalesce(json_number(c), F.lit("null"))
        content = json_object(("operation", json_string(op)), ("a", number(a)), ("b", number(b)), ("result", number(value)))
        return _outcome(F.when(error.isNull(), content), error)
    schema = {"type": "object", "properties": {"operation": {"type": "string", "enum": ["add", "subtract", "multiply", "divide"]},
                                               "a": {"type": "number"}, "b": {"type": "number"}}, "required": ["operation", "a", "b"]}
    return ToolSpec("calculator", "Adds, subtracts, multiplies or divides", schema, column=column)
