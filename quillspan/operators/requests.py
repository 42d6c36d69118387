"""Strict requests: JSON text to operations, or the first reason why not.

Spark's JSON reader is lenient, so strictness is added: duplicate keys fail ``try_parse_json``, unknown fields fail a check of
each object's keys, and only then is the text read with the fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_digest, path_problem
from ..schemas import ANCHOR, PRECONDITION, SELECTOR

LIMITS = {"bytes": 4 << 20, "depth": 64, "operations": 1000, "paths": 1000}
VERSION = 1
REQUEST = f"struct<version:int,operations:array<struct<kind:string,source:struct<path:string,selector:{SELECTOR},precondition:{PRECONDITION}>,destination:struct<path:string,anchor:{ANCHOR},precondition:{PRECONDITION}>>>>"
FIELDS = {
    "request": ("version", "operations"), "operation": ("kind", "source", "destination"), "source": ("path", "selector", "precondition"),
    "destination": ("path", "anchor", "precondition"), "selector": ("kind", "start", "end"), "anchor": ("kind", "line", "offset"), "precondition": ("kind", "value"),
}


def bare_json(text: Column) -> Column:
    """A JSON text without its strings; an unclosed string ends the text."""
    return F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*+(?:"|\\?\z)', "")


def json_nesting(text: Column) -> Column:
    """``most``: the deepest nesting of brackets outside of strings; ``again``: whether a bracket opens once all were closed."""
    brackets = F.regexp_replace(bare_json(text), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"), F.lit(False).alias("shut"), F.lit(False).alias("again"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"), (acc["shut"] | ((depth <= 0) & (c != ""))).alias("shut"), (acc["again"] | (acc["shut"] & (c != ""))).alias("again"))

    return F.when(text.isNotNull(), F.aggregate(F.split(brackets, ""), start, step))


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside of strings."""
    return json_nesting(text)["most"].cast("long")


def trailing_json(text: Column) -> Column:
    """Whether something but white space follows the first value of a text that begins with an object or an array."""
    return json_nesting(text)["again"] | ~bare_json(text).rlike(r"[\]}][ \t\r\n]*\z")


def unknown_keys(text: Column, kind: str) -> Column:
    """Whether a JSON object has a key that its kind does not know."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, FIELDS[kind])))) > 0, F.lit(False))


def strict_keys(text: Column) -> Column:
    """Whether every object of a request has known keys only."""
    ops = F.from_json(F.get_json_object(text, "$.operations"), "array<string>")

    def bad(op: Column) -> Column:
        inner = [("$.source", "source"), ("$.destination", "destination"), ("$.source.selector", "selector"), ("$.source.precondition", "precondition"), ("$.destination.anchor", "anchor"), ("$.destination.precondition", "precondition")]
        out = unknown_keys(op, "operation")
        for path, kind in inner:
            out = out | unknown_keys(F.get_json_object(op, path), kind)
        return out

    return ~unknown_keys(text, "request") & ~F.coalesce(F.exists(ops, bad), F.lit(False))


def operation_problem(o: Column) -> Column:
    """Domain checks of one operation, in their order."""
    sel, anchor, pre, post = o["source"]["selector"], o["destination"]["anchor"], o["source"]["precondition"], o["destination"]["precondition"]
    lines = (sel["kind"] == "lines") & (sel["start"] >= 1) & (sel["start"] <= sel["end"])
    spans = (sel["kind"] == "bytes") & (sel["start"] < sel["end"])
    placed = anchor["kind"].isin("file_start", "file_end") | (anchor["kind"].isin("before_line", "after_line") & (anchor["line"] > 0)) | ((anchor["kind"] == "byte_offset") & (anchor["offset"] >= 0))
    no = F.lit(False)
    return (
        F.when(~F.coalesce(o["kind"].isin("move", "copy"), no), "INVALID_REQUEST")
        .when(~F.coalesce(lines | spans, no), "INVALID_REQUEST")
        .when(~F.coalesce(pre["kind"] == "sha256", no), "INVALID_REQUEST")
        .when(~F.coalesce(is_digest(pre["value"]), no), "INVALID_DIGEST")
        .when(~F.coalesce(placed, no), "INVALID_REQUEST")
        .when(~F.coalesce(post["kind"].isin("sha256", "must_not_exist"), no), "INVALID_REQUEST")
        .when((post["kind"] == "sha256") & ~F.coalesce(is_digest(post["value"]), no), "INVALID_DIGEST")
    )


def parse(requests: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``requests(batch_id, body)`` with ``problem`` (the first, in the order of evaluation) and the parsed ``request``."""
    n = LIMITS | (limits or {})
    body = F.col("body")
    df = requests.select("batch_id", "body", json_depth(body).alias("depth"), (F.expr("try_parse_json(body)").isNotNull() & ~trailing_json(body)).alias("well_formed"), F.from_json(body, REQUEST).alias("request"), strict_keys(body).alias("strict"))
    ops = F.col("request.operations")
    paths = F.flatten(F.transform(ops, lambda o: F.array(o["source"]["path"], o["destination"]["path"])))
    first = F.get(F.filter(F.transform(ops, operation_problem), lambda p: p.isNotNull()), F.lit(0))
    no = F.lit(False)
    problem = (
        F.when(F.octet_length(body) > n["bytes"], "RESOURCE_LIMIT_EXCEEDED")
        .when(F.col("depth") > n["depth"], "RESOURCE_LIMIT_EXCEEDED")
        .when(~F.coalesce("well_formed", no) | F.col("request").isNull(), "INVALID_JSON")
        .when(~F.col("strict"), "INVALID_REQUEST")
        .when(~F.coalesce(F.col("request.version") == VERSION, no), "UNSUPPORTED_PROTOCOL_VERSION")
        .when(F.coalesce(F.size(ops), F.lit(0)) <= 0, "INVALID_REQUEST")
        .when(F.size(ops) > n["operations"], "RESOURCE_LIMIT_EXCEEDED")
        .when(F.exists(paths, lambda p: p.isNull() | path_problem(p).isNotNull()), "INVALID_REQUEST")
        .when(F.size(F.array_distinct(paths)) > n["paths"], "RESOURCE_LIMIT_EXCEEDED")
        .otherwise(first)
    )
    return df.select("batch_id", problem.alias("problem"), "request")


def operations(parsed: DataFrame) -> DataFrame:
    """The operations of good requests, one row each."""
    good = parsed.filter(F.col("problem").isNull())
    return good.select("batch_id", F.posexplode("request.operations").alias("k", "o")).select("batch_id", F.col("k").cast("long").alias("operation_index"), "o.kind", "o.source", "o.destination")
