"""Parsing takes a file's lines apart once, whatever the number of its expressions."""

import ast

from loomgraph.sources import parsers

TEXT = "class A:\n    def f(self, x: int = 1):\r\n        é.g('ü',\n            h(x))\n        return log.write(x)\rb = C(1)\n"


def test_sources_are_not_split_for_each_expression(monkeypatch):
    def splits(*_, **__):
        raise AssertionError("splits the whole file")

    monkeypatch.setattr(ast, "get_source_segment", splits)
    calls = parsers.parse("a.py", "python", TEXT)["calls"]
    assert [c["call_name"] for c in calls] == ["é.g", "h", "log.write"]
    assert calls[0]["arg_exprs"] == ["'ü'", "h(x)"]


def test_sources_are_those_of_the_syntax_module():
    python = parsers._Python(TEXT)
    for node in ast.walk(python.tree):
        assert python.source(node) == parsers.collapse(ast.get_source_segment(TEXT, node) or "")
