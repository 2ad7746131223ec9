"""Parsers: source text to symbols, chains and call records with file-local ids.

A parser turns a file into a tree of the few constructs that chains know; one pass over the
tree then emits symbols, markers and calls. Python is read by its own syntax module, other
languages by the lexer in loomgraph.sources.blocks.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field

from loomgraph.functions.effects import EffectRule, classify_text
from loomgraph.schema import CLASS_KINDS, FIRST_SYMBOL_ID, MARKERS

MOST_NESTED = 200
_SPACE = re.compile(r"\s+")
_LINE = re.compile(r"(.*?(?:\r\n|\n|\r|\Z))", re.S)  # as the syntax tree counts them


@dataclass
class Node:
    """kind: call, if, loop, switch, return, throw, break, continue, try or block; definitions are in Scope."""

    kind: str
    name: str = ""
    line: int = 0
    text: str = ""
    args: list[str] = field(default_factory=list)
    #: Calls of the condition or discriminant, and of what a call's parts hold.
    head: list[Node] = field(default_factory=list)
    bodies: list[list[Node]] = field(default_factory=list)
    #: A loop that tests its condition after the body.
    test_last: bool = False
    #: An if that stands for the `elif` of the one around it.
    chained: bool = False


@dataclass
class Scope:
    """A definition: function, class or variable, with what is defined inside and the nodes of its body."""

    kind: str
    name: str
    line: int
    end_line: int
    signature: str | None = None
    doc: str | None = None
    type_name: str | None = None
    annotations: list[dict] = field(default_factory=list)
    inner: list[Scope] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)
    has_chain: bool = False


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def base_type(name: str) -> str:
    return re.split(r"::|\.", re.sub(r"[*&\s]", "", name.partition("<")[0].partition("[")[0]))[-1]


class Emitter:
    """Numbers the scopes of a file from 100 on and writes their chains."""

    def __init__(self, path: str, language: str, rules: tuple[EffectRule, ...] = ()):
        self.path, self.language, self.rules = path, language, rules
        self.symbols: list[dict] = []
        self.chains: list[dict] = []
        self.calls: list[dict] = []

    def scopes(self, found: list[Scope], owner: dict | None = None) -> None:
        for scope in found:
            inside_class = owner is not None and owner["kind"] in CLASS_KINDS
            kind = "method" if scope.kind == "function" and inside_class else scope.kind
            level = {"parameter": "parameter", "field": "object_field"}.get(kind) or ("global" if owner is None else "object_field" if inside_class else "local")
            symbol = {
                "id": FIRST_SYMBOL_ID + len(self.symbols), "name": scope.name, "kind": kind, "scope": level, "scope_id": owner["id"] if owner else 0,
                "type_ref": 0, "type_name": scope.type_name, "file": self.path, "line": scope.line, "end_line": scope.end_line,
                "signature": scope.signature, "doc": scope.doc, "annotations": scope.annotations, "language": self.language,
            }
            self.symbols.append(symbol)
            if scope.has_chain:
                chain = [symbol["id"]]
                self.chains.append({"func_id": symbol["id"], "chain": chain})
                self.nodes(scope.body, chain, None, False, 0)
            self.scopes(scope.inner, symbol)

    def types(self) -> None:
        """type_ref of what names a class of the same file: the first class of that name.

        What Rust's impl blocks hold belongs to the type that they are for, if the file defines it.
        """
        first: dict[str, int] = {}
        blocks = [s for s in self.symbols if self.language == "rust" and s["kind"] == "class" and s["type_name"] == s["name"]]
        held = {s["id"] for s in blocks}
        for s in self.symbols:
            if s["kind"] in CLASS_KINDS and s["id"] not in held:
                first.setdefault(s["name"], s["id"])
        for s in self.symbols:
            if s["type_name"]:
                s["type_ref"] = first.get(base_type(s["type_name"]), 0)
        owner = {s["id"]: s["type_ref"] for s in blocks if s["type_ref"]}
        for s in self.symbols:
            if s["kind"] == "method":
                s["scope_id"] = owner.get(s["scope_id"], s["scope_id"])

    def nodes(self, found: list[Node], chain: list[int], condition: str | None, loop: bool, depth: int) -> None:
        if depth <= MOST_NESTED:
            for node in found:
                getattr(self, f"_{node.kind}")(node, chain, condition, loop, depth + 1)

    def _mark(self, chain: list[int], *names: str) -> None:
        chain += [MARKERS[n] for n in names]

    def _call(self, node: Node, chain, condition, loop, depth) -> None:
        effect, text = classify_text(node.name, self.rules)
        head, _, last = node.name.rpartition(".")
        self.calls.append(
            {
                "caller_id": chain[0], "call_name": node.name, "position": len(chain), "arg_exprs": node.args, "line": node.line,
                "condition": condition, "is_loop_body": loop, "effect": effect, "effect_desc": text,
                "target_class": head if self.language == "java" and head[:1].isupper() else None,
                "target_method": last if self.language == "java" and head[:1].isupper() else None,
            }
        )
        chain.append(0)
        self.nodes(node.head, chain, None, loop, depth)

    def _block(self, node: Node, chain, condition, loop, depth) -> None:
        self.nodes(node.head, chain, condition, loop, depth)
        for body in node.bodies:
            self.nodes(body, chain, condition, loop, depth)

    def _if(self, node: Node, chain, condition, loop, depth) -> None:
        """An else gets a marker; an elif is an if of its own instead, and so is what follows it."""
        test = node.text or condition
        self._mark(chain, "IF_TRUE")
        self.nodes(node.head, chain, test, loop, depth)
        self.nodes(node.bodies[0], chain, test, loop, depth)
        if len(node.bodies) > 1:
            chained = len(node.bodies[1]) == 1 and node.bodies[1][0].kind == "if" and node.bodies[1][0].chained
            if not (chained or node.chained):
                self._mark(chain, "IF_FALSE")
            self.nodes(node.bodies[1], chain, f"!{test}" if test else None, loop, depth)
        self._mark(chain, "BRANCH_END")

    def _loop(self, node: Node, chain, condition, loop, depth) -> None:
        test = node.text or condition
        self._mark(chain, "LOOP")
        if not node.test_last:
            self.nodes(node.head, chain, test, True, depth)
        self.nodes(node.bodies[0], chain, test, True, depth)
        if node.test_last:
            self.nodes(node.head, chain, test, True, depth)
        self._mark(chain, "LOOP_BACK")

    def _switch(self, node: Node, chain, condition, loop, depth) -> None:
        self.nodes(node.head, chain, None, loop, depth)
        for case in node.bodies:
            self._mark(chain, "SWITCH_CASE")
            self.nodes(case, chain, None, loop, depth)
            self._mark(chain, "SWITCH_END")

    def _return(self, node: Node, chain, condition, loop, depth) -> None:
        self._mark(chain, node.kind.upper())
        self.nodes(node.head, chain, condition, loop, depth)

    _throw = _return

    def _break(self, node: Node, chain, condition, loop, depth) -> None:
        self._mark(chain, node.kind.upper())

    _continue = _break

    def _try(self, node: Node, chain, condition, loop, depth) -> None:
        """bodies: the body, then each handler; head: what always or otherwise runs at the end."""
        self.nodes(node.bodies[0], chain, condition, loop, depth)
        for handler in node.bodies[1:]:
            self._mark(chain, "IF_TRUE")
            self.nodes(handler, chain, None, loop, depth)
            self._mark(chain, "BRANCH_END")
        self.nodes(node.head, chain, condition, loop, depth)

    def result(self) -> dict:
        self.types()
        return {"symbols": self.symbols, "chains": self.chains, "calls": self.calls}


# ---- Python


class _Python:
    """Python source to scopes and nodes."""

    def __init__(self, text: str):
        self.tree = ast.parse(text)
        # Split once: every expression asks for its own text.
        self.lines = text.splitlines()
        self.tree_lines = _LINE.findall(text)

    def source(self, node: ast.AST | None) -> str:
        """What ast.get_source_segment gives, on one line; that function splits the whole file at each call."""
        if node is None or getattr(node, "end_lineno", None) is None:
            return ""
        first, last = node.lineno - 1, node.end_lineno - 1
        found = [line.encode() for line in self.tree_lines[first : last + 1]]
        found[-1] = found[-1][: node.end_col_offset]
        found[0] = found[0][node.col_offset :]
        return collapse(b"".join(found).decode())

    def scopes(self, statements: list[ast.stmt], in_class: bool, top: bool = False) -> list[Scope]:
        found = []
        for s in statements:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                found.append(self._function(s))
            elif isinstance(s, ast.ClassDef):
                inner = self.scopes(s.body, True)
                bases = self.source(s.bases[0]) if s.bases else None
                found.append(Scope("class", s.name, self._first(s), s.end_lineno, self._signature(s), ast.get_docstring(s), bases, self._decorators(s), inner, has_chain=True))
            elif isinstance(s, ast.Assign | ast.AnnAssign):
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                kind = self.source(s.annotation) if isinstance(s, ast.AnnAssign) else self._constructed(s.value)
                for t in targets:
                    if isinstance(t, ast.Name):
                        which = "field" if in_class else "constant" if t.id.isupper() else "variable"
                        found.append(Scope(which, t.id, s.lineno, s.end_lineno, type_name=kind))
            elif isinstance(s, ast.If | ast.For | ast.While | ast.With | ast.Try | ast.AsyncFor | ast.AsyncWith):
                for part in ("body", "orelse", "finalbody"):
                    found += self.scopes(getattr(s, part, []), in_class)
                for handler in getattr(s, "handlers", []):
                    found += self.scopes(handler.body, in_class)
        seen, unique = set(), []
        for scope in found:  # a variable is defined once
            if scope.kind in ("variable", "constant", "field") and (scope.kind, scope.name) in seen:
                continue
            seen.add((scope.kind, scope.name))
            unique.append(scope)
        return unique

    def _constructed(self, value: ast.AST | None) -> str | None:
        name = self.source(value.func) if isinstance(value, ast.Call) else ""
        return name if name.rpartition(".")[2][:1].isupper() else None

    def _first(self, s) -> int:
        return s.lineno

    def _signature(self, s) -> str:
        lines = self.lines[s.lineno - 1 : s.body[0].lineno]
        head = "\n".join(lines)[s.col_offset :]
        return collapse(re.split(r":\s*(?:#[^\n]*)?(?:\n|$)", head, maxsplit=1)[0])

    def _decorators(self, s) -> list[dict]:
        found = []
        for d in s.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            args = {}
            if call:
                args = {str(i): self.source(a) for i, a in enumerate(call.args)} | {k.arg or "**": self.source(k.value) for k in call.keywords}
            found.append({"name": self.source(call.func if call else d), "args": args, "line": d.lineno})
        return found

    def _function(self, s) -> Scope:
        a = s.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        params = [Scope("parameter", p.arg, p.lineno, p.end_lineno, type_name=self.source(p.annotation) or None) for p in every]
        scope = Scope("function", s.name, self._first(s), s.end_lineno, self._signature(s), ast.get_docstring(s), None, self._decorators(s), has_chain=True)
        scope.inner = params + self.scopes(s.body, False)
        scope.body = self.statements(s.body)
        return scope

    def statements(self, body: list[ast.stmt]) -> list[Node]:
        return [n for s in body for n in self._statement(s)]

    def calls(self, *nodes: ast.AST | None) -> list[Node]:
        """Calls in expressions, an outer one before those inside it."""
        found = []
        for node in nodes:
            if node is None:
                continue
            if isinstance(node, ast.Call):
                args = [self.source(x) for x in node.args] + [self.source(k) for k in node.keywords]
                inside = self.calls(node.func, *node.args, *(k.value for k in node.keywords))
                found.append(Node("call", self.source(node.func), node.lineno, args=args, head=inside))
            elif isinstance(node, ast.IfExp):
                found.append(Node("if", line=node.lineno, text=self.source(node.test), head=self.calls(node.test), bodies=[self.calls(node.body), self.calls(node.orelse)]))
            elif not isinstance(node, ast.Lambda):
                found += self.calls(*ast.iter_child_nodes(node))
        return found

    def _statement(self, s: ast.stmt) -> list[Node]:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return []
        if isinstance(s, ast.If):
            bodies = [self.statements(s.body)]
            if s.orelse:
                bodies.append(self.statements(s.orelse))
                if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) and self.lines[s.orelse[0].lineno - 1].lstrip().startswith("elif"):
                    bodies[1][0].chained = True
            return [Node("if", line=s.lineno, text=self.source(s.test), head=self.calls(s.test), bodies=bodies)]
        if isinstance(s, ast.For | ast.AsyncFor | ast.While):
            head = self.calls(s.test if isinstance(s, ast.While) else s.iter)
            text = self.source(s.test) if isinstance(s, ast.While) else ""
            return [Node("loop", line=s.lineno, text=text, head=head, bodies=[self.statements(s.body)]), *self.statements(s.orelse)]
        if isinstance(s, ast.Return):
            return [Node("return", line=s.lineno, head=self.calls(s.value))]
        if isinstance(s, ast.Raise):
            return [Node("throw", line=s.lineno, head=self.calls(s.exc, s.cause))]
        if isinstance(s, ast.Break):
            return [Node("break", line=s.lineno)]
        if isinstance(s, ast.Continue):
            return [Node("continue", line=s.lineno)]
        if isinstance(s, ast.Try):
            handlers = [self.calls(h.type) + self.statements(h.body) for h in s.handlers]
            return [Node("try", line=s.lineno, bodies=[self.statements(s.body), *handlers], head=self.statements(s.orelse + s.finalbody))]
        if isinstance(s, ast.With | ast.AsyncWith):
            return self.calls(*(i.context_expr for i in s.items)) + self.statements(s.body)
        if isinstance(s, ast.Match):
            cases = [self.calls(c.guard) + self.statements(c.body) for c in s.cases]
            return [Node("switch", line=s.lineno, head=self.calls(s.subject), bodies=cases)]
        return self.calls(*ast.iter_child_nodes(s))


def parse(path: str, language: str, text: str, rules: tuple[EffectRule, ...] = ()) -> dict | None:
    """Symbols, chains and calls of a file, effects by these rules before the default ones; None if no parser can read it."""
    try:
        emitter = Emitter(path, language, rules)
        if language == "python":
            python = _Python(text)
            emitter.scopes(python.scopes(python.tree.body, False, True))
        else:
            from loomgraph.sources import blocks

            found = blocks.scopes(language, text)
            if found is None:
                return None
            emitter.scopes(found)
        return emitter.result()
    except (SyntaxError, ValueError, IndexError, RecursionError):
        return None


def parse_json(path: str, language: str, text: str, rules: tuple[EffectRule, ...] = ()) -> str | None:
    found = parse(path, language, text, rules)
    return json.dumps(found) if found is not None else None

