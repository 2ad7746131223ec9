"""A tolerant reader of languages with braces or `end`: definitions, control flow and calls.

It knows tokens, brackets and a few words for each language, and no more grammar than chains
need. What it doesn't recognise it reads as an expression, so calls are still found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomgraph.sources.parsers import Node, Scope, base_type, collapse


@dataclass(frozen=True)
class Language:
    """functions, classes: words that start definitions; typed: whether a parameter's or field's type stands before its name."""

    functions: tuple[str, ...] = ()
    classes: tuple[str, ...] = ("class", "interface", "enum")
    typed: bool = False
    #: Whether a line's end ends a statement.
    lines: bool = False
    #: Whether methods and functions may have no word before their name.
    bare_functions: bool = False
    comment: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    string: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    switch: tuple[str, ...] = ("switch",)
    #: Blocks that end with a word rather than a brace.
    ends: bool = False


_C_LIKE = {"typed": True, "bare_functions": True}
_SCRIPT = {"functions": ("function",), "lines": True, "bare_functions": True, "string": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'}
LANGUAGES = {
    "typescript": Language(**_SCRIPT),
    "tsx": Language(**_SCRIPT),
    "javascript": Language(**_SCRIPT),
    "java": Language(classes=("class", "interface", "enum", "record"), **_C_LIKE),
    "csharp": Language(classes=("class", "interface", "enum", "struct", "record"), **_C_LIKE),
    "c": Language(classes=("struct", "enum", "union"), **_C_LIKE),
    "cpp": Language(classes=("class", "struct", "enum", "union"), **_C_LIKE),
    "go": Language(functions=("func",), classes=("struct", "interface"), lines=True, switch=("switch", "select"), string=r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\''),
    "rust": Language(functions=("fn",), classes=("struct", "enum", "trait", "impl", "union"), switch=("match",), string=r'"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'|\'\w+'),
    "php": Language(functions=("function", "fn"), classes=("class", "interface", "trait", "enum"), typed=True, switch=("switch", "match"), comment=r"//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)|<\?php|\?>"),
    "scala": Language(functions=("def",), classes=("class", "trait", "object", "enum"), lines=True, switch=("match",)),
    "swift": Language(functions=("func", "init"), classes=("class", "struct", "protocol", "enum", "extension"), lines=True),
    "ruby": Language(functions=("def",), classes=("class", "module"), lines=True, ends=True, switch=("case",), comment=r"\#[^\n]*"),
    "lua": Language(functions=("function",), classes=(), lines=True, ends=True, switch=(), comment=r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*"),
}
_WORDS = "if else for while do switch case default return throw break continue try catch finally new class interface enum import static public private protected const var".split()
_MORE_WORDS = {
    "typescript": "function let of in typeof instanceof delete await yield async abstract extends implements",
    "tsx": "function let of in typeof instanceof delete await yield async abstract extends implements",
    "javascript": "function let of in typeof instanceof delete await yield async extends",
    "java": "instanceof final abstract extends implements throws record synchronized",
    "csharp": "foreach in is as struct namespace using await async record override virtual readonly where",
    "c": "struct union goto sizeof typedef extern",
    "cpp": "struct union goto sizeof typedef extern namespace template using delete virtual override noexcept",
    "go": "go defer func range select chan map struct type package fallthrough",
    "rust": "fn match impl loop as in where mut let struct trait pub use mod move ref async await unsafe dyn",
    "php": "function fn foreach elseif match as trait extends implements echo namespace use abstract final",
    "scala": "def match val object trait extends with yield lazy override package",
    "swift": "func guard in is as let struct protocol extension repeat where throws init",
    "ruby": "def end then elsif unless until begin rescue ensure next raise not and or in module when yield",
    "lua": "function end then elseif until repeat not and or in local goto nil",
}
_RESERVED = {name: frozenset(_WORDS) | frozenset(more.split()) for name, more in _MORE_WORDS.items()}
_OPEN, _CLOSE = "([{", ")]}"
_LINKS = (".", "->", "::", "?.", "!.", "?->")
_INTERFACES = ("interface", "trait", "protocol")
_OPERATORS = r"\?->|::=|:=|=>|->|::|\?\.|!\.|\.\.\.|\.\.[<=]?|&&|\|\||[-+*/%&|^<>=!~]=|<<|>>"


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, number, mark or line
    text: str
    start: int
    end: int
    line: int


def tokens(language: Language, text: str) -> list[Token]:
    pattern = re.compile(
        f"(?P<skip>{language.comment})|(?P<string>{language.string})|(?P<word>[@$]*[^\\W\\d]\\w*[?!]?(?=\\W|$)|[@$]*[^\\W\\d]\\w*)"
        f"|(?P<number>\\d\\w*(?:\\.\\d\\w*)?)|(?P<line>\\n)|(?P<mark>{_OPERATORS}|[^\\s])",
        re.DOTALL,
    )
    found, line = [], 1
    for m in pattern.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "word" and value[-1] in "?!" and not language.ends:
            kept = value[:-1]
            found.append(Token(kind, kept, m.start(), m.end() - 1, line))
            found.append(Token("mark", value[-1], m.end() - 1, m.end(), line))
        elif kind == "line":
            if language.lines:
                found.append(Token(kind, value, m.start(), m.end(), line))
        elif kind != "skip":
            found.append(Token(kind, value, m.start(), m.end(), line))
        line += value.count("\n")
    return found


def partners(found: list[Token]) -> dict[int, int]:
    """For each bracket its partner's place; brackets without one point past the end or at the start."""
    stack, pairs = [], {}
    for i, t in enumerate(found):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "mark" and t.text in _CLOSE and stack and _OPEN.index(found[stack[-1]].text) == _CLOSE.index(t.text):
            pairs[stack[-1]] = i
            pairs[i] = stack.pop()
    return pairs | {i: len(found) for i in stack}


@dataclass
class Found:
    """What a stretch of code holds."""

    nodes: list[Node] = field(default_factory=list)
    scopes: list[Scope] = field(default_factory=list)


class Reader:
    def __init__(self, name: str, text: str):
        self.name, self.language, self.text, self.reserved = name, LANGUAGES[name], text, _RESERVED[name]
        self.t = tokens(self.language, text)
        self.pair = partners(self.t)

    # ---- looking at tokens

    def at(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind != "string" and self.t[i].text in texts

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word" and self.t[i].text.strip("@$?!") not in self.reserved

    def after(self, i: int) -> int:
        """Past the bracket that opens at i."""
        return min(self.pair.get(i, i) + 1, len(self.t))

    def source(self, i: int, j: int) -> str:
        return collapse(self.text[self.t[i].start : self.t[j - 1].end]) if i < j <= len(self.t) else ""

    def skip_lines(self, i: int, j: int) -> int:
        while i < j and (self.t[i].kind == "line" or self.at(i, ";")):
            i += 1
        return i

    def find(self, i: int, j: int, *texts: str, lines: bool = False) -> int:
        """The first place of one of the texts outside brackets (brackets themselves can be asked for), or j."""
        while i < j:
            if self.at(i, *texts) or (lines and self.t[i].kind == "line"):
                return i
            i = self.after(i) if self.at(i, *_OPEN) else i + 1
        return j

    def statement_end(self, i: int, j: int) -> int:
        """Where an expression statement ends: at a semicolon, a line's end that doesn't go on, or a stray brace."""
        start = i
        while i < j:
            if self.at(i, ";", "}"):
                return i
            if self.t[i].kind == "line" and i > start:
                goes_on = self.at(i - 1, ",", "=", "&&", "||", "+", ".", "(", "=>", ":=") or self.at(self.skip_lines(i, j), ".", "?.", "&&", "||", "->", "{" if self.name not in ("ruby", "lua") and self.at(i - 1, "=") else ".")
                if not goes_on:
                    return i
            i = self.after(i) if self.at(i, *_OPEN) else i + 1
        return j

    # ---- calls

    def calls(self, i: int, j: int) -> list[Node]:
        """Calls between two places, an outer one before those inside it."""
        found: list[Node] = []
        while i < j:
            if self.is_name(i) or (self.at(i, "self", "this", "super")):
                i, more = self._path(i, j)
                found += more
            elif self.at(i, *_OPEN):
                end = min(self.pair.get(i, j), j)
                found += self.calls(i + 1, end)
                i = end + 1
            else:
                i += 1
        return found

    def _path(self, i: int, j: int) -> tuple[int, list[Node]]:
        """A path of names with calls on it: the last call stands around those before it."""
        start, inner, loose = i, [], []
        if self.at(i - 1, "new") and self.name in ("java", "csharp"):
            start = i - 1
        i += 1
        while i < j:
            if self.at(i, *_LINKS) and (self.is_name(i + 1) or self.at(i + 1, "new", "class", "await", "default")):
                i += 2
            elif self.name == "lua" and self.at(i, ":") and self.is_name(i + 1):
                i += 2
            elif (self.name in ("php", "ruby") and self.at(i, *_LINKS) and i + 1 < j and self.t[i + 1].kind == "word"):
                i += 2
            elif self.at(i, "(") or (self.at(i, "!") and self.name == "rust" and self.at(i + 1, *_OPEN)):
                open_ = i + self.at(i, "!")
                end = min(self.pair.get(open_, j), j)
                call = Node("call", self._call_name(start, i), self.t[i - 1].line, args=self._args(open_ + 1, end))
                call.head = inner + self.calls(open_ + 1, end)
                inner, i = [call], end + 1
            elif self.at(i, "<", "::") and (close := self._generic(i + self.at(i, "::"), j)):
                i = close
            elif self.at(i, "["):
                end = min(self.pair.get(i, j), j)
                loose += self.calls(i + 1, end)
                i = end + 1
            elif self.at(i, "{") and inner and self.name in ("swift", "scala", "ruby") and i < j and self.t[i - 1].line == self.t[i].line:
                end = min(self.pair.get(i, j), j)  # a block that belongs to the call before it
                inner[0].head += self.calls(i + 1, end)
                i = end + 1
            elif self.name == "ruby" and not inner and self._ruby_command(start, i, j):
                return j, [Node("call", self._call_name(start, i), self.t[i - 1].line, args=self._args(i, j), head=self.calls(i, j))]
            else:
                break
        return i, inner + loose

    def _ruby_command(self, start: int, i: int, j: int) -> bool:
        """Whether a name and what follows it on the line are a call without brackets."""
        follows = self.t[i].kind in ("string", "number") or self.is_name(i) or self.at(i, "self")
        spaced = self.t[i].start > self.t[i - 1].end and self.t[i].line == self.t[i - 1].line
        first = start == 0 or self.t[start - 1].kind == "line" or self.at(start - 1, ";", "then", "do", "else")
        return first and follows and spaced

    def _generic(self, i: int, j: int) -> int | None:
        """Past type arguments that a call follows."""
        depth, at = 0, i
        while at < j and at - i < 40 and self.at(i, "<"):
            depth += self.at(at, "<") - self.at(at, ">") - 2 * self.at(at, ">>")
            if depth <= 0:
                return at + 1 if self.at(at + 1, "(") else None
            if self.at(at, ";", "{", "&&", "||", "(", ")") or self.t[at].kind == "line":
                return None
            at += 1
        return None

    def _call_name(self, i: int, j: int) -> str:
        name = self.source(i, j)
        if self.name == "php":
            return re.sub(r"\?->|->|::", ".", name).replace("$", "")
        return re.sub(r"<[^()]*>$", "", name) if self.name == "csharp" else name

    def _args(self, i: int, j: int) -> list[str]:
        found, start = [], i
        while i <= j and start < j:
            comma = self.find(i, j, ",")
            if text := self.source(start, comma):
                found.append(text)
            i = start = comma + 1
        return found

    # ---- statements

    def body(self, i: int, j: int) -> Found:
        found = Found()
        while (i := self.skip_lines(i, j)) < j:
            before = i
            i = self._statement(i, j, found)
            i = max(i, before + 1)
        return found

    def block(self, i: int, j: int) -> tuple[int, Found]:
        """The block or single statement at a place."""
        i = self.skip_lines(i, j) if not self.at(i, ";") else i
        if self.at(i, "{"):
            return self.after(i), self.body(i + 1, min(self.pair.get(i, j), j))
        found = Found()
        return self._statement(i, j, found), found

    def _head_end(self, i: int, j: int) -> tuple[int, int, int]:
        """(from, to, after) of a condition: in brackets, or everything up to the brace."""
        if self.at(i, "(") and (self.language.bare_functions or self.name in ("php", "scala")):
            return i + 1, min(self.pair.get(i, j), j), self.after(i)
        end = self.find(i, j, "{")
        return i, end, end

    def _statement(self, i: int, j: int, found: Found) -> int:
        if i >= j:
            return j
        t = self.t[i]
        word = t.text if t.kind == "word" else ""
        if word in ("if", "guard"):
            return self._if(i, j, found)
        if word in ("for", "foreach", "while", "loop"):
            a, b, after = self._head_end(i + 1, j)
            end, inner = self.block(after, j)
            found.nodes.append(Node("loop", line=t.line, text=self.source(a, b), head=self.calls(a, b), bodies=[inner.nodes]))
            found.scopes += inner.scopes
            return end
        if word in ("do", "repeat") and self.at(self.skip_lines(i + 1, j), "{"):
            end, inner = self.block(i + 1, j)
            found.scopes += inner.scopes
            if self.at(at := self.skip_lines(end, j), "while"):
                a, b, after = self._head_end(at + 1, j) if self.at(at + 1, "(") else (at + 1, e := self.statement_end(at + 1, j), e)
                found.nodes.append(Node("loop", line=t.line, text=self.source(a, b), head=self.calls(a, b), bodies=[inner.nodes], test_last=True))
                return after
            return self._handlers(end, j, found, inner.nodes, t.line)
        if word == "try" and self.at(self.skip_lines(i + 1, j), "{", "("):
            at, resources = i + 1, []
            if self.at(at, "("):
                resources, at = self.calls(at + 1, self.pair.get(at, j)), self.after(at)
            end, inner = self.block(at, j)
            found.nodes += resources
            found.scopes += inner.scopes
            return self._handlers(end, j, found, inner.nodes, t.line)
        if word in self.language.switch and word != "match" or word == "match" and self.name in ("rust", "php"):
            a, b, after = self._head_end(i + 1, j)
            return self._switch(t.line, a, b, after, j, found)
        if self.name == "scala" and (at := self.find(i, self.statement_end(i, j), "match")) < j and self.at(at, "match") and self.at(at + 1, "{"):
            return self._switch(t.line, i, at, at + 1, j, found)
        if word in ("return", "throw", "break", "continue"):
            end = self.statement_end(i + 1, j) if not (self.at(i + 1, ";", "}") or (i + 1 < j and self.t[i + 1].kind == "line")) else i + 1
            kind = word
            found.nodes.append(Node(kind, line=t.line, head=self.calls(i + 1, end) if kind in ("return", "throw") else []))
            return end
        if (end := self._definition(i, j, found)) is not None:
            return end
        if self.at(i, "{"):
            end, inner = self.block(i, j)
            found.nodes.append(Node("block", bodies=[inner.nodes]))
            found.scopes += inner.scopes
            return end
        end = self.statement_end(i, j)
        self._variable(i, end, found)
        found.nodes += self._expression(i, end)
        return end

    def _expression(self, i: int, j: int) -> list[Node]:
        """Calls of an expression; a conditional one becomes a branch."""
        mark = self.find(i, j, "?")
        colon = self.find(mark + 1, j, ":") if mark < j and self.name not in ("rust", "swift", "ruby", "scala", "lua") else j
        if mark < j and colon < j:
            start = next((k + 1 for k in range(mark - 1, i - 1, -1) if self.at(k, "=", ":=", "return")), i)
            text = self.source(start, mark)
            branch = Node("if", line=self.t[mark].line, text=text, head=self.calls(start, mark), bodies=[self.calls(mark + 1, colon), self.calls(colon + 1, j)])
            return [*self.calls(i, start), branch]
        return self.calls(i, j)

    def _if(self, i: int, j: int, found: Found) -> int:
        line = self.t[i].line
        a, b, after = self._head_end(i + 1, j)
        guard = self.at(i, "guard")
        if guard and self.at(b - 1, "else"):
            b -= 1
        end, inner = self.block(after, j)
        node = Node("if", line=line, text=self.source(a, b), head=self.calls(a, b), bodies=[inner.nodes])
        found.nodes.append(node)
        found.scopes += inner.scopes
        at = self.skip_lines(end, j)
        if self.at(at, "else", "elseif"):
            chained = self.at(at, "elseif")
            more = Found()
            end = self._if(at, j, more) if chained else self._else(at + 1, j, more)
            if chained and more.nodes:
                more.nodes[0].chained = True
            node.bodies.append(more.nodes)
            found.scopes += more.scopes
        return end

    def _else(self, i: int, j: int, found: Found) -> int:
        end, inner = self.block(i, j)
        found.nodes += inner.nodes
        found.scopes += inner.scopes
        return end

    def _handlers(self, i: int, j: int, found: Found, tried: list[Node], line: int) -> int:
        node = Node("try", line=line, bodies=[tried])
        found.nodes.append(node)
        while self.at(at := self.skip_lines(i, j), "catch", "finally"):
            start = self.find(at + 1, j, "{")
            i, inner = self.block(start, j)
            if self.at(at, "finally"):
                node.head += inner.nodes
            elif self.name == "scala":
                node.bodies += [c for n in self._cases(start, j) for c in [n]]
            else:
                node.bodies.append(inner.nodes)
            found.scopes += inner.scopes
        return i

    def _switch(self, line: int, a: int, b: int, brace: int, j: int, found: Found) -> int:
        brace = self.find(brace, j, "{")
        found.nodes.append(Node("switch", line=line, head=self.calls(a, b), bodies=self._cases(brace, j)))
        return self.after(brace)

    def _cases(self, brace: int, j: int) -> list[list[Node]]:
        """The bodies of the cases in a brace: after labels with colons, or of arms with arrows."""
        i, end, cases = brace + 1, min(self.pair.get(brace, j), j), []
        arms = self.name in ("rust", "scala") or (self.name in ("php", "java", "csharp") and self.find(i, end, "=>", "->") < self.find(i, end, ":"))
        starts = []
        while i < end:
            if arms and self.at(i, "=>", "->"):
                starts.append((i, i + 1))
            elif not arms and self.at(i, "case", "default") and not self.at(i - 1, ".", "goto"):
                colon = self.find(i, end, ":")
                starts.append((i, colon + 1))
                i = colon
            i = self.after(i) if self.at(i, *_OPEN) else i + 1
        for n, (label, start) in enumerate(starts):
            stop = starts[n + 1][0] if n + 1 < len(starts) else end
            body: list[Node] = []
            text = self.t[label + 1] if not arms and self.at(label, "case") and label + 1 < end else None
            if text is not None and text.kind == "string" and label + 2 == start - 1:
                body.append(Node("call", text.text[1:-1], text.line))
            if arms:
                stop = self._arm_end(start, stop if n + 1 < len(starts) else end)
            cases.append(body + self.body(start, stop).nodes)
        return cases

    def _arm_end(self, i: int, j: int) -> int:
        """Where an arm's value ends: after its block, at a comma, or where the next pattern's line starts."""
        if self.at(i, "{"):
            return self.after(i)
        comma = self.find(i, j, ",", "case")
        return comma

    # ---- definitions

    def _definition(self, i: int, j: int, found: Found) -> int | None:
        """Read the definition that starts here into found.scopes; None if there is none."""
        notes, start = [], i
        while self.at(i, "@") or (i < j and self.t[i].kind == "word" and self.t[i].text.startswith("@")) or (self.at(i, "#") and self.at(i + 1, "[")) or (self.at(i, "[") and self.name == "csharp" and i == self.skip_lines(start, j)):
            i = self._annotation(i, j, notes)
            i = self.skip_lines(i, j)
        brace = self.find(i, j, "{", ";", "=", "=>", "}")
        stop = brace if not self.language.lines else min(brace, self._line_stop(i, brace))
        words = [k for k in range(i, stop) if self.t[k].kind == "word" and not self._inside(k, i)]
        for k in words:
            text = self.t[k].text
            if text in self.language.functions and (self.is_name(k + 1) or text == "init" or self.at(k + 1, "(")):
                return self._function(start, k, j, found, notes)
            if text in self.language.classes and self.name != "go" and (self.is_name(k + 1) or text == "impl") and not self.at(k - 1, ".", "::"):
                return self._class(start, k, j, found, notes)
            if self.name == "go" and text == "type" and self.is_name(k + 1) and self.at(k + 2, *self.language.classes):
                return self._class(start, k, j, found, notes)
        if self.language.bare_functions and self.at(brace, "{") and (name := self._bare_name(i, brace)) is not None:
            return self._function(start, name - 1, j, found, notes)
        if (arrow := self._arrow(i, j)) is not None:
            return self._arrow_function(i, arrow, j, found)
        return None

    def _line_stop(self, i: int, j: int) -> int:
        return self.find(i, j, lines=True)

    def _inside(self, k: int, i: int) -> bool:
        """Whether place k lies in brackets that open after place i."""
        return any(o < k < self.pair.get(o, o) for o in range(i, k) if self.at(o, *_OPEN))

    def _annotation(self, i: int, j: int, notes: list[dict]) -> int:
        line = self.t[i].line
        if self.at(i, "#", "["):
            open_ = i + self.at(i, "#")
            name = self.t[open_ + 1].text if open_ + 1 < j else ""
            notes.append({"name": name, "args": {}, "line": line})
            return self.after(open_)
        at = i + 1
        name = self.t[i].text.lstrip("@") or (self.t[at].text if at < j else "")
        at += self.at(i, "@")
        while self.at(at, ".") and self.is_name(at + 1):
            name, at = f"{name}.{self.t[at + 1].text}", at + 2
        args = {}
        if self.at(at, "("):
            for n, text in enumerate(self._args(at + 1, self.pair.get(at, j))):
                key, mark, value = text.partition("=")
                args[key.strip() if mark and key.strip().isidentifier() else str(n)] = value.strip() if mark and key.strip().isidentifier() else text
            at = self.after(at)
        notes.append({"name": name, "args": args, "line": line})
        return at

    def _bare_name(self, i: int, brace: int) -> int | None:
        """The name of a function without a word before it: a name, its parameters, and nothing like a call after it."""
        k = self.find(i, brace, "(")
        if k >= brace or not self.is_name(k - 1) or self.at(k - 2, ".", "->", "new", "="):
            return None
        if self.name in ("typescript", "tsx", "javascript") and not self.in_class:
            return None
        if self.language.typed and k - 1 == i and not self.in_class:
            return None
        after = self.after(k)
        ends = self.at(after, "{", ":", "->", "const", "noexcept", "override", "throws", "where", "final")
        return k - 1 if ends else None

    in_class = False

    def _params(self, open_: int, j: int) -> list[Scope]:
        found, i, end = [], open_ + 1, min(self.pair.get(open_, j), j)
        while i < end:
            comma = self.find(i, end, ",")
            stop = self.find(i, comma, "=")
            names = [k for k in range(i, stop) if self.is_name(k)]
            if names:
                colon = self.find(i, stop, ":")
                if colon < stop:
                    before = [k for k in names if k < colon]
                    name, kind = (before or names)[-1], self.source(colon + 1, stop)
                elif self.language.typed:
                    name = names[-1]
                    kind = self.source(i, name) if name > i else ""
                else:
                    name, kind = names[0], self.source(names[0] + 1, stop) if self.name == "go" else ""
                line = self.t[name].line
                found.append(Scope("parameter", self.t[name].text.lstrip("$"), line, line, type_name=kind or None))
            i = comma + 1
        return found

    def _function(self, start: int, k: int, j: int, found: Found, notes: list[dict]) -> int:
        """A function whose word, or the place before whose name, is k."""
        at = k + 1
        if self.name == "go" and self.at(at, "("):
            at = self.after(at)
        named = self.is_name(at)
        name = self.t[at].text if named else self.t[k].text
        open_ = self.find(at, j, "(", "{", "=", ";")
        params = self._params(open_, j) if self.at(open_, "(") else []
        begin = self.after(open_) if self.at(open_, "(") else open_
        brace = self.find(begin, j, "{", ";", "=", "=>") if not self.language.lines else min(self.find(begin, j, "{", ";", "=", "=>"), self.find(begin, j, lines=True))
        signature = self.source(start, brace)
        scope = Scope("function", name, self.t[start].line, self.t[start].line, signature, annotations=notes, inner=params, has_chain=True)
        if self.at(brace, "=", "=>"):
            at = self.skip_lines(brace + 1, j)
            end = self.after(at) if self.at(at, "{") else self.statement_end(at, j)
            inner = self.body(at + 1, end - 1) if self.at(at, "{") else Found(self._expression(at, end))
        elif self.at(brace, "{"):
            end, inner = self._nested(brace, j, False)
        else:
            end, inner = brace, Found()
        scope.body = inner.nodes
        scope.inner = params + inner.scopes
        scope.end_line = self.t[min(end, len(self.t)) - 1].line
        found.scopes.append(scope)
        return end

    def _nested(self, brace: int, j: int, in_class: bool) -> tuple[int, Found]:
        before, self.in_class = self.in_class, in_class
        inner = self.body(brace + 1, min(self.pair.get(brace, j), j))
        self.in_class = before
        return self.after(brace), inner

    def _class(self, start: int, k: int, j: int, found: Found, notes: list[dict]) -> int:
        brace = self.find(k, j, "{", ";")
        if self.language.lines and self.name == "scala":
            brace = min(brace, self.find(k, j, lines=True))
        word = self.t[k + 2].text if self.name == "go" else self.t[k].text
        kind = "interface" if word in _INTERFACES else "enum" if word == "enum" else "class"
        names = [m for m in range(k + 1, brace) if self.is_name(m) and not self._inside(m, k)]
        if not names:
            return brace + 1
        target = names[0]
        if word == "impl" and (at := self.find(k, brace, "for")) < brace:
            target = next((m for m in names if m > at), target)
        name = self.t[target].text
        base = next((self.t[m].text for m in names if m > target and self.at(m - 1, "extends", "implements", ":", "<", "public", "with")), None)
        scope = Scope(kind, name, self.t[start].line, self.t[start].line, self.source(start, brace), None, name if word in ("impl", "extension") else base and base_type(base), notes, has_chain=True)
        end = brace
        if self.at(brace, "{"):
            end, inner = self._nested(brace, j, True)
            for s in inner.scopes:
                s.kind = "field" if s.kind in ("variable", "constant") else s.kind
            scope.inner = inner.scopes
        scope.end_line = self.t[min(end, len(self.t)) - 1].line
        found.scopes.append(scope)
        return end

    def _arrow(self, i: int, j: int) -> int | None:
        """The name in `const name = (...) => ...`."""
        if self.name not in ("typescript", "tsx", "javascript"):
            return None
        end = self.statement_end(i, j)
        equals = self.find(i, end, "=")
        names = [k for k in range(i, equals) if self.is_name(k)]
        at = equals + 1 + self.at(equals + 1, "async")
        is_arrow = self.at(at, "(") and self.find(self.after(at), end, "=>") < end or self.is_name(at) and self.at(at + 1, "=>")
        return names[0] if equals < end and names and is_arrow else None

    def _arrow_function(self, i: int, name: int, j: int, found: Found) -> int:
        arrow = self.find(self.find(name, j, "="), j, "=>")
        open_ = self.find(self.find(name, j, "=") + 1, arrow, "(")
        params = self._params(open_, j) if open_ < arrow else []
        at = arrow + 1
        if self.at(at, "{"):
            end, inner = self._nested(at, j, False)
        else:
            end = self.statement_end(at, j)
            inner = Found(self._expression(at, end))
        scope = Scope("function", self.t[name].text, self.t[i].line, self.t[min(end, len(self.t)) - 1].line, self.source(i, arrow), inner=params + inner.scopes, body=inner.nodes, has_chain=True)
        found.scopes.append(scope)
        return end

    def _variable(self, i: int, j: int, found: Found) -> None:
        """A variable that the statement declares, with its type if that can be seen."""
        stop = self.find(i, j, "=", ":=")
        made = next((self.t[k + 1].text for k in range(stop, j) if self.at(k, "new") and self.is_name(k + 1)), None)
        words = {self.t[k].text for k in range(i, stop) if self.t[k].kind == "word"}
        colon = self.find(i, stop, ":")
        names = [k for k in range(i, min(stop, colon)) if self.is_name(k)]
        if not names or any(self.at(k, "(", "[", ".", "->") for k in range(i, stop)):
            return
        declared = words & {"var", "let", "const", "val", "static"} or self.at(stop, ":=")
        if self.language.typed and self.name != "php" and len(names) >= 2 and (stop < j or self.at(j, ";")):
            name, kind = names[-1], self.source(names[0], names[-1])
        elif declared or (self.in_class and colon < stop):
            name, kind = names[0], self.source(colon + 1, stop) if colon < stop else self.source(names[0] + 1, stop) if self.name == "go" and self.at(i, "var") else ""
            if not kind and self.name in ("swift", "scala", "go") and self.is_name(stop + 1 + self.at(stop + 1, "&")) and self.t[stop + 1 + self.at(stop + 1, "&")].text[:1].isupper():
                kind = self.t[stop + 1 + self.at(stop + 1, "&")].text
        else:
            return
        constant = "const" in words and self.t[name].text.isupper() or {"static", "final"} <= words
        line = self.t[name].line
        found.scopes.append(Scope("constant" if constant else "variable", self.t[name].text.lstrip("$"), line, line, type_name=kind if kind and kind != "var" else made))


class EndReader(Reader):
    """Languages whose blocks end with a word."""

    def until(self, i: int, j: int, *stops: str) -> tuple[int, Found]:
        found = Found()
        while (i := self.skip_lines(i, j)) < j and not self.at(i, *stops):
            before = i
            i = max(self._statement(i, j, found), before + 1)
        return i, found

    def _then(self, i: int, j: int) -> int:
        """Past a condition and the word, if any, that ends it."""
        return self.find(i, j, "then", "do", lines=True) if self.name == "ruby" else self.find(i, j, "then", "do")

    def _statement(self, i: int, j: int, found: Found) -> int:
        if i >= j:
            return j
        t = self.t[i]
        word = t.text if t.kind == "word" else ""
        if word in ("if", "unless", "elsif", "elseif"):
            return self._branch(i, j, found)
        if word in ("for", "while", "until"):
            start = self._then(i + 1, j)
            end, inner = self.until(start + 1, j, "end")
            found.nodes.append(Node("loop", line=t.line, text=self.source(i + 1, start), head=self.calls(i + 1, start), bodies=[inner.nodes]))
            return end + 1
        if word == "repeat":
            end, inner = self.until(i + 1, j, "until")
            stop = self.statement_end(end + 1, j)
            found.nodes.append(Node("loop", line=t.line, text=self.source(end + 1, stop), head=self.calls(end + 1, stop), bodies=[inner.nodes], test_last=True))
            return stop
        if word == "do" or (word == "begin" and self.name == "ruby"):
            return self._begin(i, j, found)
        if word == "case" and self.name == "ruby":
            return self._when(i, j, found)
        if word in ("return", "raise", "break", "next", "goto"):
            kind = {"raise": "throw", "next": "continue"}.get(word, word)
            end = self.statement_end(i, j)
            end = min(end, self.find(i, end, "end", "if", "unless"))
            if kind != "goto":
                found.nodes.append(Node(kind, line=t.line, head=self.calls(i + 1, end) if kind in ("return", "throw") else []))
            return self._modified(i, end, j, found, 1)
        if (word in self.language.functions and (self.is_name(i + 1) or self.at(i + 1, "self"))) or (self.at(i, "local") and self.at(i + 1, "function")):
            return self._define(i + self.at(i, "local"), j, found)
        if word in self.language.classes:
            end_line = self.find(i, j, ";", lines=True)
            base = next((self.t[k + 1].text for k in range(i, end_line) if self.at(k, "<")), None)
            before, self.in_class = self.in_class, True
            end, inner = self.until(end_line, j, "end")
            self.in_class = before
            found.scopes.append(Scope("class", self.t[min(i + 1, j - 1)].text, t.line, self.t[min(end, len(self.t) - 1)].line, self.source(i, end_line), None, base, inner=inner.scopes, has_chain=True))
            return end + 1
        return self._plain(i, j, found)

    def _plain(self, i: int, j: int, found: Found) -> int:
        """An expression, with the block it may be given."""
        end = self.statement_end(i, j)
        block = self.find(i, end, "do", "function")
        if block < end:
            before = self.calls(i, block)
            at = self.after(block + 1) if self.at(block, "function") and self.at(block + 1, "(") else block + 1
            if self.name == "ruby" and self.at(at, "|"):
                at = self.find(at + 1, j, "|") + 1
            stop, inner = self.until(at, j, "end")
            (before[-1].head if before else found.nodes).extend(inner.nodes)
            found.nodes += before
            return self.statement_end(stop + 1, j) if stop + 1 < j and self.t[stop + 1].kind != "line" else stop + 1
        modifier = self.find(i + 1, end, "if", "unless", "while", "until") if self.name == "ruby" else end
        start = len(found.nodes)
        self._variable_of(i, modifier, found)
        found.nodes += self.calls(i, modifier)
        return self._modified(i, modifier, j, found, len(found.nodes) - start)

    def _variable_of(self, i: int, j: int, found: Found) -> None:
        equals = self.find(i, j, "=")
        name = equals - 1
        if equals < j and self.is_name(name) and name - i <= 1:
            made = self.t[equals + 1].text if self.at(equals + 2, ".") and self.at(equals + 3, "new") else None
            text = self.t[name].text
            found.scopes.append(Scope("field" if text.startswith("@") else "constant" if text.isupper() else "variable", text.lstrip("@"), self.t[name].line, self.t[name].line, type_name=made))

    def _modified(self, i: int, at: int, j: int, found: Found, n: int) -> int:
        """Wrap the last n nodes in what a modifier behind them says."""
        end = self.statement_end(at, j) if at < j and self.t[at].kind != "line" else at
        if self.name != "ruby" or not self.at(at, "if", "unless", "while", "until"):
            return end if not self.at(at, "end") else at
        inner = found.nodes[len(found.nodes) - n :]
        del found.nodes[len(found.nodes) - n :]
        kind = "if" if self.at(at, "if", "unless") else "loop"
        found.nodes.append(Node(kind, line=self.t[at].line, text=self.source(at + 1, end), head=self.calls(at + 1, end), bodies=[inner]))
        return end

    def _branch(self, i: int, j: int, found: Found) -> int:
        start = self._then(i + 1, j)
        end, inner = self.until(start + 1, j, "else", "elsif", "elseif", "end")
        node = Node("if", line=self.t[i].line, text=self.source(i + 1, start), head=self.calls(i + 1, start), bodies=[inner.nodes])
        found.nodes.append(node)
        found.scopes += inner.scopes
        if self.at(end, "elsif", "elseif"):
            more = Found()
            end = self._branch(end, j, more)
            more.nodes[0].chained = True
            node.bodies.append(more.nodes)
            return end
        if self.at(end, "else"):
            end, inner = self.until(end + 1, j, "end")
            node.bodies.append(inner.nodes)
        return end + 1

    def _begin(self, i: int, j: int, found: Found) -> int:
        end, inner = self.until(i + 1, j, "rescue", "ensure", "else", "end")
        return self._rescues(end, j, found, inner, self.t[i].line)

    def _rescues(self, end: int, j: int, found: Found, inner: Found, line: int) -> int:
        node = Node("try", line=line, bodies=[inner.nodes])
        found.scopes += inner.scopes
        while self.at(end, "rescue", "ensure", "else"):
            kind, start = self.t[end].text, self.find(end, j, lines=True)
            end, part = self.until(start, j, "rescue", "ensure", "else", "end")
            if kind == "rescue":
                node.bodies.append(part.nodes)
            else:
                node.head += part.nodes
        found.nodes += [node] if len(node.bodies) > 1 or node.head else inner.nodes
        return end + 1

    def _when(self, i: int, j: int, found: Found) -> int:
        start = self.find(i + 1, j, lines=True)
        node = Node("switch", line=self.t[i].line, head=self.calls(i + 1, start))
        end = self.skip_lines(start, j)
        while self.at(end, "when", "else"):
            start = self.find(end + 1, j, "then", lines=True) if self.at(end, "when") else end
            label = [Node("call", self.t[k].text[1:-1], self.t[k].line) for k in range(end + 1, start) if self.t[k].kind == "string"]
            end, part = self.until(start + 1, j, "when", "else", "end")
            node.bodies.append(label + part.nodes)
        found.nodes.append(node)
        return end + 1

    def _define(self, i: int, j: int, found: Found) -> int:
        at = i + 1
        while self.at(at + 1, ".", ":") and at + 2 < j:
            at += 2
        name = self.t[at].text
        open_ = at + 1
        params = self._params(open_, j) if self.at(open_, "(") else []
        begin = self.after(open_) if self.at(open_, "(") else open_
        before, self.in_class = self.in_class, False
        end, inner = self.until(begin, j, "end", "rescue", "ensure")
        self.in_class = before
        body = Found(scopes=inner.scopes)
        end = self._rescues(end, j, body, inner, self.t[i].line)
        scope = Scope("function", name, self.t[i].line, self.t[min(end, len(self.t)) - 1].line, self.source(i, begin), inner=params + inner.scopes, body=body.nodes, has_chain=True)
        found.scopes.append(scope)
        return end


def scopes(language: str, text: str) -> list[Scope] | None:
    """The definitions of a file, outermost first; None for a language that isn't known."""
    if language not in LANGUAGES:
        return None
    reader = (EndReader if LANGUAGES[language].ends else Reader)(language, text)
    found = reader.until(0, len(reader.t)) if isinstance(reader, EndReader) else (0, reader.body(0, len(reader.t)))
    return found[1].scopes
