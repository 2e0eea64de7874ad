"""JSON Schema as Column expressions over VARIANT.

The schema is compiled once on the driver; checking rows is native. A keyword that has no
translation here is an error at build time, never silently passed. Schemas that refer to
themselves take rounds over a table of nodes (``find_violations``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.jsonx import bind, json_kind, member
from docflow.functions.text import json_string, strip_code_fence
from docflow.session import work_folder

VIOLATION = "struct<instance_path:string,keyword:string,message:string>"

# Keywords that carry no constraint.
IGNORED = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format"}
# Kinds of a variant that are numbers.
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
# Kind of each simple JSON type.
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _fail(bad: Column, path: Column, keyword: str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    row = F.struct(path.alias("instance_path"), F.lit(keyword).alias("keyword"), text.alias("message"))
    return F.when(F.coalesce(bad, F.lit(False)), F.array(row)).otherwise(_none())


def _double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_type(v: Column, kind: Column, name: str) -> Column:
    if name == "number":
        return kind.isin(*NUMBERS)
    if name == "integer":
        return kind.isin(*NUMBERS) & (_double(v) == F.floor(_double(v)))
    if name not in KINDS:
        raise ValueError(f"unknown JSON Schema type: {name}")
    return kind == KINDS[name]


def _equals(v: Column, kind: Column, value) -> Column:
    if value is None:
        return _is_type(v, kind, "null")
    if isinstance(value, bool):
        return _is_type(v, kind, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return _is_type(v, kind, "number") & (_double(v) == float(value))
    if isinstance(value, str):
        return _is_type(v, kind, "string") & (_text(v) == value)
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))


class Context:
    """What checks of one schema share. ``cut`` names the recursive ``$ref``s that are not expanded below the value at hand:
    with ``marks`` they leave a row of keyword ``$ref`` with the reference and the value, else, and wherever only
    the outcome counts, they fail if ``bad`` (an array column) names the path and the reference."""

    def __init__(self, root: dict, cut: frozenset[str] = frozenset(), bad: Column | None = None, marks: bool = False, inside: bool = False):
        self.root, self.cut, self.bad, self.marks, self.inside = root, cut, bad, marks, inside

    def below(self) -> Context:
        return Context(self.root, self.cut, self.bad, self.marks, True)

    def deciding(self) -> Context:
        return Context(self.root, self.cut, self.bad, False, self.inside)


def place(path: Column, ref: str) -> Column:
    return F.concat(path, F.lit(f"\n{ref}"))


def _resolve(ref: str, root: dict) -> dict:
    if not ref.startswith("#"):
        raise ValueError(f"only local $ref is supported: {ref}")
    node = root
    for key in [k for k in ref[1:].split("/") if k]:
        node = node[key.replace("~1", "/").replace("~0", "~")]
    return node


def _constrains(schema, ctx: Context, seen: tuple) -> bool:
    """Whether a schema can be violated at all (unknown keywords count, so they get reported)."""
    if isinstance(schema, bool):
        return not schema
    for key, value in schema.items():
        if key in ("properties", "patternProperties"):
            if any(_constrains(sub, ctx, seen) for sub in value.values()):
                return True
        elif key in ("items", "additionalProperties"):
            if _constrains(value, ctx, seen):
                return True
        elif key not in IGNORED:
            return True
    return False


def _check(schema, value: Column, path: Column, ctx: Context, seen: tuple) -> Column:
    """Violations of a value inside another; the value and its kind are bound once."""
    # A reference may come again here: it is another value.
    return bind(value, lambda v: bind(json_kind(v), lambda k: F.concat(*_compile(schema, v, k, path, ctx.below(), () if ctx.cut else seen))))


def _at_top(schema, value: Column, path: Column, ctx: Context, ref: str | None = None) -> Column:
    """Violations of a whole value, or of the value that a reference was cut at."""
    return bind(value, lambda v: bind(json_kind(v), lambda k: F.concat(_none(), *_compile(schema, v, k, path, ctx, (ref,) if ref else ()))))


def _compile(schema, v: Column, kind: Column, path: Column, ctx: Context, seen: tuple = ()) -> list[Column]:
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [_fail(v.isNotNull(), path, "false schema", "boolean schema is false")]
    known = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems",
             "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum",
             "exclusiveMaximum", "multipleOf", "minProperties", "maxProperties", "anyOf", "oneOf", "allOf", "not", "$ref",
             "patternProperties", "contains", "minContains", "maxContains", "if", "then", "else", "dependentRequired"}
    unknown = set(schema) - known - IGNORED
    if unknown:
        raise ValueError(f"unsupported JSON Schema keywords: {sorted(unknown)}")
    out: list[Column] = []
    fail = lambda bad, kw, msg: out.append(_fail(v.isNotNull() & bad, path, kw, msg))
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = _is_type(v, kind, types[0])
        for t in types[1:]:
            ok = ok | _is_type(v, kind, t)
        fail(~ok, "type", f"must be {','.join(types)}")
    number, string = _is_type(v, kind, "number"), _is_type(v, kind, "string")
    for kw, bad, sign in (("maximum", _double(v) > schema.get("maximum", 0), "<="),
                          ("minimum", _double(v) < schema.get("minimum", 0), ">="),
                          ("exclusiveMaximum", _double(v) >= schema.get("exclusiveMaximum", 0), "<"),
                          ("exclusiveMinimum", _double(v) <= schema.get("exclusiveMinimum", 0), ">")):
        if kw in schema:
            fail(number & bad, kw, f"must be {sign} {schema[kw]}")
    if "multipleOf" in schema:
        ratio = _double(v) / float(schema["multipleOf"])
        fail(number & (F.abs(ratio - F.round(ratio)) > 1e-9), "multipleOf", f"must be multiple of {schema['multipleOf']}")
    for kw, more in (("maxLength", True), ("minLength", False)):
        if kw in schema:
            n = F.length(_text(v))
            fail(string & ((n > schema[kw]) if more else (n < schema[kw])), kw,
                 f"must NOT have {'more' if more else 'fewer'} than {schema[kw]} characters")
    if "pattern" in schema:
        fail(string & ~_text(v).rlike(schema["pattern"]), "pattern", f'must match pattern "{schema["pattern"]}"')
    array = _is_type(v, kind, "array")
    for kw, more in (("maxItems", True), ("minItems", False)):
        if kw in schema:
            n = F.size(_elements(v))
            fail(array & ((n > schema[kw]) if more else (n < schema[kw])), kw,
                 f"must NOT have {'more' if more else 'fewer'} than {schema[kw]} items")
    if schema.get("uniqueItems"):
        texts = F.transform(_elements(v), lambda x: F.to_json(x))
        fail(array & (F.size(F.array_distinct(texts)) < F.size(texts)), "uniqueItems", "must NOT have duplicate items")
    if "items" in schema and _constrains(schema["items"], ctx, seen):
        def each(x, i):
            return _check(schema["items"], x, F.concat(path, F.lit("/"), i.cast("string")), ctx, seen)
        out.append(F.when(array, F.flatten(F.transform(_elements(v), each))).otherwise(_none()))
    if "contains" in schema:
        least, most = schema.get("minContains", 1), schema.get("maxContains")
        fits = F.size(F.filter(_elements(v), lambda x, i: F.size(_check(
            schema["contains"], x, F.concat(path, F.lit("/"), i.cast("string")), ctx.deciding(), seen)) == 0)) \
            if _constrains(schema["contains"], ctx, seen) else F.size(_elements(v))
        bad = (fits < least) if most is None else (fits < least) | (fits > most)
        wanted = f"at least {least}" if most is None else f"at least {least} and no more than {most}"
        fail(array & bad, "contains", f"must contain {wanted} valid item(s)")
    obj = _is_type(v, kind, "object")
    for kw, more in (("maxProperties", True), ("minProperties", False)):
        if kw in schema:
            n = F.size(_keys(v))
            fail(obj & ((n > schema[kw]) if more else (n < schema[kw])), kw,
                 f"must NOT have {'more' if more else 'fewer'} than {schema[kw]} properties")
    for name in schema.get("required", []):
        fail(obj & member(v, name).isNull(), "required", f"must have required property '{name}'")
    for name, others in schema.get("dependentRequired", {}).items():
        for other in others:
            fail(obj & member(v, name).isNotNull() & member(v, other).isNull(), "dependentRequired",
                 f"must have property {other} when property {name} is present")
    props, patterns = schema.get("properties", {}), schema.get("patternProperties", {})

    def other(k: Column) -> Column:
        """A key that neither ``properties`` nor ``patternProperties`` speaks of."""
        left = ~k.isin(*props) if props else F.lit(True)
        for pattern in patterns:
            left = left & ~k.rlike(pattern)
        return left

    def of_entries(wanted, sub) -> Column:
        chosen = F.map_entries(F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda k, _x: wanted(k)))
        return F.when(obj, F.flatten(F.transform(chosen, lambda e: _check(
            sub, e["value"], F.concat(path, F.lit("/"), e["key"]), ctx, seen)))).otherwise(_none())

    for pattern, sub in patterns.items():
        if _constrains(sub, ctx, seen):
            out.append(of_entries(lambda k: k.rlike(pattern), sub))
    extra = schema.get("additionalProperties", True)
    if extra is False:
        unexpected = F.filter(_keys(v), other)
        out.append(F.when(obj, F.transform(unexpected, lambda _k: F.struct(
            path.alias("instance_path"), F.lit("additionalProperties").alias("keyword"),
            F.lit("must NOT have additional properties").alias("message")))).otherwise(_none()))
    elif extra is not True and extra != {} and _constrains(extra, ctx, seen):
        out.append(of_entries(other, extra))
    parts = []
    for name, sub in props.items():
        pointer = F.concat(path, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))
        if _constrains(sub, ctx, seen):
            parts.append(_check(sub, member(v, name), pointer, ctx, seen))
    if parts:
        out.append(F.when(obj, F.concat(*parts)).otherwise(_none()))
    if "const" in schema:
        fail(~_equals(v, kind, schema["const"]), "const", "must be equal to constant")
    if "enum" in schema:
        ok = F.lit(False)
        for value in schema["enum"]:
            ok = ok | F.coalesce(_equals(v, kind, value), F.lit(False))
        fail(~ok, "enum", "must be equal to one of the allowed values")
    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in ctx.cut and ctx.inside:
            if ctx.marks:
                fail(F.lit(True), "$ref", F.concat(F.lit(f"{ref}\n"), F.to_json(v)))
            else:
                fail(F.array_contains(ctx.bad, place(path, ref)), "$ref", f"must match {ref}")
        elif ref in seen:
            raise ValueError(f"recursive $ref in one expression, use find_violations: {ref}")
        else:
            out += _compile(_resolve(ref, ctx.root), v, kind, path, ctx, (*seen, ref))
    for sub in schema.get("allOf", []):
        out += _compile(sub, v, kind, path, ctx, seen)
    holds = lambda sub: (F.size(F.concat(*c)) == 0) if (c := _compile(sub, v, kind, path, ctx.deciding(), seen)) else F.lit(True)
    if "anyOf" in schema:
        ok = F.lit(False)
        for sub in schema["anyOf"]:
            ok = ok | holds(sub)
        fail(~ok, "anyOf", "must match a schema in anyOf")
    if "oneOf" in schema:
        n = F.lit(0)
        for sub in schema["oneOf"]:
            n = n + holds(sub).cast("int")
        fail(n != 1, "oneOf", "must match exactly one schema in oneOf")
    if "if" in schema:
        for branch, met in (("then", holds(schema["if"])), ("else", ~holds(schema["if"]))):
            if branch in schema and (found := _compile(schema[branch], v, kind, path, ctx, seen)):
                whole = F.concat(*found)
                out.append(F.when(met, whole).otherwise(_none()))
                fail(met & (F.size(whole) > 0), "if", f'must match "{branch}" schema')
    if "not" in schema:
        fail(holds(schema["not"]), "not", "must NOT be valid")
    return out


def variant_violations(v: Column, schema: dict, first_only: bool = False) -> Column:
    """array<(instance_path, keyword, message)> of a variant; empty where it conforms."""
    if not _constrains(schema, Context(schema), ()):
        return _none()
    found = _at_top(schema, v, F.lit(""), Context(schema))
    return F.slice(found, 1, 1) if first_only else found


def violations(reply: Column, schema: dict, first_only: bool = False) -> Column:
    """Violations of a reply text; a reply that is not JSON has one of keyword ``parse``."""
    parse = F.array(F.struct(F.lit("").alias("instance_path"), F.lit("parse").alias("keyword"), F.lit("reply is not valid JSON").alias("message")))
    return bind(F.try_parse_json(strip_code_fence(reply)), lambda v: F.when(v.isNull(), parse).otherwise(
        variant_violations(v, schema, first_only)))


# --- recursive schemas -------------------------------------------------------------------

def recursive_refs(schema: dict) -> frozenset[str]:
    """The ``$ref``s of a schema that lead back to themselves."""
    def inside(node) -> set[str]:
        if isinstance(node, dict):
            own = {node["$ref"]} if isinstance(node.get("$ref"), str) else set()
            # What ``enum`` and ``const`` hold is data; definitions count where they are referred to.
            return own.union(*[inside(x) for k, x in node.items() if k not in ("enum", "const", "$defs", "definitions")])
        return set().union(*[inside(x) for x in node]) if isinstance(node, list) else set()

    direct, open_refs = {}, inside(schema)
    while open_refs:
        ref = open_refs.pop()
        direct[ref] = inside(_resolve(ref, schema))
        open_refs |= direct[ref] - set(direct)

    def reached(ref: str) -> set[str]:
        found, left = set(), set(direct[ref])
        while left:
            found.add(one := left.pop())
            left |= direct[one] - found
        return found
    return frozenset(r for r in direct if r in reached(r))


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _node_levels(rows: DataFrame, folder: str) -> int:
    """Write all values inside ``rows(id, path, value)`` (JSON texts), a folder for each level; the number of levels."""
    level, no = rows, 0
    while True:
        level.write.parquet(f"{folder}/nodes/level={no}")
        here = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/nodes/level={no}")
        if here.isEmpty():
            return no
        opened = here.select("id", "path", F.parse_json("value").alias("v")).withColumn("k", json_kind(F.col("v")))
        entries = F.map_entries(F.from_json(F.to_json("v"), "map<string,variant>"))
        inner = F.when(F.col("k") == "OBJECT", F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))).when(
            F.col("k") == "ARRAY", F.transform(_elements(F.col("v")), lambda x, i: F.struct(i.cast("string").alias("key"), F.to_json(x).alias("value"))))
        level = opened.select("id", "path", F.explode(inner).alias("c")).select("id", F.concat("path", F.lit("/"), _escaped(F.col("c.key"))).alias("path"), "c.value")
        no += 1


def find_violations(rows: DataFrame, schema: dict, key: str, reply: str = "reply") -> DataFrame:
    """(key, instance_path, keyword, message) of the replies in ``rows``, for any schema, recursive ones included.

    ``key`` is unique. Where references recurse, replies are opened into a table of nodes (path, value). From the deepest
    level up, each node is checked against every recursive reference by the outcomes of the nodes below; then the
    violations are found from the top down: a round checks the values that the round before came to through
    such a reference. So there are as many rounds as replies are deep, and none rewrites what others found.
    """
    parsed = rows.select(F.col(key).alias("id"), F.lit("").alias("path"), F.try_parse_json(strip_code_fence(F.col(reply))).alias("v"))
    broken = parsed.where("v IS NULL").select("id", F.lit("").alias("instance_path"), F.lit("parse").alias("keyword"),
                                              F.lit("reply is not valid JSON").alias("message"))
    texts = parsed.where("v IS NOT NULL").select("id", "path", F.to_json("v").alias("value"))
    cut = recursive_refs(schema)
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    bads = T.StructType([texts.schema["id"], T.StructField("at", T.StringType())])
    levels = _node_levels(texts, folder) if cut else 0
    read = lambda name, shape: spark.read.schema(shape).parquet(f"{folder}/{name}").select(*shape.names)
    gathered = lambda: read("bad", bads).groupBy("id").agg(F.collect_list("at").alias("_bad"))
    none = F.array().cast("array<string>")
    with_bad = lambda nodes, some: nodes.join(gathered(), "id", "left").withColumn("_bad", F.coalesce("_bad", none)) if some else nodes.withColumn("_bad", none)
    for no in range(levels - 1, -1, -1):
        nodes = with_bad(read(f"nodes/level={no}", texts.schema), no < levels - 1).withColumn("v", F.parse_json("value"))
        ctx = Context(schema, cut, F.col("_bad"))
        failing = [F.when(F.size(_at_top(_resolve(ref, schema), F.col("v"), F.col("path"), ctx, ref)) > 0, place(F.col("path"), ref)) for ref in sorted(cut)]
        nodes.select("id", F.explode(F.array_compact(F.array(*failing))).alias("at")).write.parquet(f"{folder}/bad/level={no}")

    found = T.StructType([texts.schema["id"], *[T.StructField(n, T.StringType()) for n in ("instance_path", "keyword", "message")]])
    frontier, no = texts.withColumn("ref", F.lit("")), 0
    while True:
        here = with_bad(frontier, levels > 0).withColumn("v", F.parse_json("value"))
        ctx = Context(schema, cut, F.col("_bad"), marks=True)
        checks = F.lit(None)
        for ref in ("", *sorted(cut)):
            checks = F.when(F.col("ref") == ref, _at_top(_resolve(ref, schema) if ref else schema, F.col("v"), F.col("path"), ctx, ref or None)).otherwise(checks)
        here.select("id", F.explode(checks).alias("x")).select("id", "x.*").write.parquet(f"{folder}/found/round={no}")
        marked = read(f"found/round={no}", found).where("keyword = '$ref'")
        if not cut or marked.isEmpty():
            break
        at = F.instr("message", "\n")
        frontier = marked.select("id", F.col("instance_path").alias("path"), F.substring("message", at + 1, F.length("message")).alias("value"),
                                 F.substring("message", F.lit(1), at - 1).alias("ref"))
        no += 1
    # Marks of a reference are the values it came to, not violations.
    final = read("found", found).where("keyword <> '$ref'")
    return final.unionByName(broken).withColumnRenamed("id", key)


def wrap_schema(schema: dict) -> tuple[dict, bool]:
    """Providers want object schemas: others are wrapped as ``{result: …}``."""
    if schema.get("type") and schema["type"] != "object":
        return {"type": "object", "properties": {"result": schema}, "required": ["result"]}, True
    return schema, False


def unwrap_reply(reply: Column, was_wrapped: bool) -> Column:
    """The ``result`` member of a wrapped reply as JSON text; anything else unchanged."""
    if not was_wrapped:
        return reply
    def value(v):
        quoted = json_string(_text(v))
        return F.when(v.isNull(), reply).when(json_kind(v) == "STRING", quoted).when(
            json_kind(v) == "VOID", F.lit("null")).otherwise(F.get_json_object(reply, "$.result"))
    return bind(member(F.try_parse_json(reply), "result"), value)
