"""Capabilities by the types of their JSON."""

import json

from quillspan.operators import reports


def test_capabilities_by_type(spark):
    good = {"documentSymbolProvider": True, "textDocumentSync": 1}
    cases = {
        "plain": (good, "utf-16", None),
        "object": (good | {"documentSymbolProvider": {}, "textDocumentSync": {"openClose": True, "change": 2}, "positionEncoding": "utf-8"}, "utf-8", None),
        "null encoding": (good | {"positionEncoding": None}, "utf-16", None),
        "text true": (good | {"documentSymbolProvider": "true"}, None, "LSP_CAPABILITY_UNAVAILABLE"),
        "text object": (good | {"documentSymbolProvider": "{}"}, None, "LSP_CAPABILITY_UNAVAILABLE"),
        "false": (good | {"documentSymbolProvider": False}, None, "LSP_CAPABILITY_UNAVAILABLE"),
        "none": ({}, None, "LSP_CAPABILITY_UNAVAILABLE"),
        "text sync": (good | {"textDocumentSync": "1"}, None, "LSP_DOCUMENT_SYNC_UNAVAILABLE"),
        "no sync": (good | {"textDocumentSync": 0}, None, "LSP_DOCUMENT_SYNC_UNAVAILABLE"),
        "closed": (good | {"textDocumentSync": {"openClose": "true", "change": 1}}, None, "LSP_DOCUMENT_SYNC_UNAVAILABLE"),
        "number": (good | {"positionEncoding": 8}, None, "UNSUPPORTED_TEXT_ENCODING"),
        "other": (good | {"positionEncoding": "utf-7"}, None, "UNSUPPORTED_TEXT_ENCODING"),
    }
    rows = [(k, json.dumps({"capabilities": c, "serverInfo": {"name": "s", "version": 3}})) for k, (c, _, _) in cases.items()] + [("torn", "{")]
    got = {r.name: (r.position_encoding, r.problem, r.server_name, r.server_version) for r in reports.negotiate(spark.createDataFrame(rows, "name string, result string")).collect()}
    assert got == {k: (e, p, "s", None) for k, (_, e, p) in cases.items()} | {"torn": (None, "LSP_CAPABILITY_UNAVAILABLE", None, None)}
