"""Trees of page scripts, by precedence climbing over their tokens.

A node has a kind, a value (name, text, operator), the place of its first token, and children with the part each plays.
Statements end at a semicolon, before a closing brace, at the end, or where a line ends. Nesting is bounded, so no
script can exhaust the stack.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .script_tokens import ScriptSyntaxError, Token, tokens

DEEPEST = 400  # nested statements and expressions


@dataclass
class Node:
    kind: str
    value: str | None = None
    at: int = 0
    parts: list[tuple[str, Node]] = field(default_factory=list)

    def get(self, part: str) -> Node | None:
        return next((n for p, n in self.parts if p == part), None)

    def all(self, part: str) -> list[Node]:
        return [n for p, n in self.parts if p == part]


#: Operators between two values, from the loosest to the tightest.
LEVELS = [("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "in", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",)]
BINDING = {op: k for k, ops in enumerate(LEVELS) for op in ops}
ASSIGNING = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^=".split())
BEHIND = frozenset(". ?. [ (".split())
PREFIXES = frozenset("! ~ + - ++ -- typeof void delete await".split())


class _Reader:
    def __init__(self, script: str):
        self.tokens = tokens(script)
        self.k, self.depth = 0, 0
        self.functions, self.loops, self.switches = 0, 0, 0
        self.labels: list[str] = []
        self.in_generator = False
        self.close = _closing(self.tokens)

    # Tokens ---------------------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def sees(self, *texts: str) -> bool:
        t = self.tokens[self.k]
        return t.text in texts and t.kind in ("mark", "keyword")

    def word(self, text: str) -> bool:
        """Whether a name that is a keyword only here comes next."""
        return self.now.kind == "name" and self.now.text == text

    def take(self, *texts: str) -> bool:
        t = self.tokens[self.k]
        if t.text in texts and t.kind in ("mark", "keyword"):
            self.k += 1
            return True
        return False

    def want(self, text: str) -> None:
        if not self.take(text):
            raise self.wrong(f"expected {text!r}")

    def next(self) -> Token:
        self.k += 1
        return self.tokens[self.k - 1]

    def name(self) -> str:
        if self.now.kind != "name" and not self.sees("async", "undefined"):
            raise self.wrong("expected a name")
        return self.next().value

    def wrong(self, text: str) -> ScriptSyntaxError:
        return ScriptSyntaxError(f"{text} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def ends(self) -> None:
        if not self.take(";") and not self.sees("}") and self.now.kind != "end" and not self.now.line_before:
            raise self.wrong("expected ';'")

    def nested(self, read: Callable[[], Node]) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise ScriptSyntaxError(f"nested too deeply at {self.now.at}")
        try:
            return read()
        finally:
            self.depth -= 1

    def listed(self, end: str, read: Callable[[], Node], part: str = "item") -> list[tuple[str, Node]]:
        """Parts with commas between them up to ``end``."""
        out = []
        while not self.take(end):
            out.append((part, read()))
            if not self.sees(end):
                self.want(",")
        return out

    # Statements -----------------------------------------------------------------------------------------------------

    def program(self) -> Node:
        parts = []
        while self.now.kind != "end":
            parts.append(("item", self.statement()))
        return Node("program", None, 0, parts)

    def statement(self) -> Node:
        return self.nested(self._statement)

    def _statement(self) -> Node:
        t = self.now
        if self.sees("{"):
            return self.block()
        if self.take(";"):
            return Node("empty", None, t.at)
        if self.sees("var", "const") or self.sees("let"):
            node = self.declaration()
            self.ends()
            return node
        if self.sees("function") or self.sees("async") and self.ahead().text == "function" and not self.ahead().line_before:
            return self.function(named=True)
        if self.sees("class"):
            return self.class_(named=True)
        if t.kind == "keyword" and (read := getattr(self, f"_{t.text}", None)):
            self.k += 1
            node = read(t)
            return node
        if t.kind == "name" and self.ahead().text == ":" and self.ahead().kind == "mark":
            self.k += 2
            self.labels.append(t.value)
            body = self.statement()
            self.labels.pop()
            return Node("label", t.value, t.at, [("body", body)])
        node = Node("expression", None, t.at, [("value", self.expression())])
        self.ends()
        return node

    def block(self) -> Node:
        t = self.now
        self.want("{")
        parts = []
        while not self.take("}"):
            if self.now.kind == "end":
                raise self.wrong("unterminated block")
            parts.append(("item", self.statement()))
        return Node("block", None, t.at, parts)

    def declaration(self, in_for: bool = False) -> Node:
        t, parts = self.next(), []
        while True:
            first = self.now
            item = Node("variable", None, first.at, [("target", self.target())])
            if self.take("="):
                item.parts.append(("value", self.assigned(not in_for)))
            elif item.parts[0][1].kind != "name" and not in_for:
                raise self.wrong("a pattern needs a value")
            parts.append(("item", item))
            if not self.take(","):
                return Node("declaration", t.text, t.at, parts)

    def target(self) -> Node:
        """A name, or a pattern of them with defaults and a rest."""
        t = self.now
        if self.take("["):
            parts = []
            while not self.take("]"):
                if self.take(","):
                    parts.append(("item", Node("hole", None, self.now.at)))
                    continue
                parts.append(("item", self.given(last="]")))
                if not self.sees("]"):
                    self.want(",")
            return Node("array_pattern", None, t.at, parts)
        if self.take("{"):
            return Node("object_pattern", None, t.at, self.listed("}", self._field))
        return Node("name", self.name(), t.at)

    def given(self, last: str) -> Node:
        """A target that may be a rest or have a default."""
        t = self.now
        if self.take("..."):
            node = Node("rest", None, t.at, [("target", self.target())])
            if not self.sees(last):
                raise self.wrong("a rest must be last")
            return node
        target = self.target()
        if self.take("="):
            return Node("default", None, t.at, [("target", target), ("value", self.assigned())])
        return target

    def _field(self) -> Node:
        t = self.now
        if self.sees("..."):
            return self.given(last="}")
        key, bare = self.key()
        if self.take(":"):
            return Node("pair", key.value, t.at, [("key", key), ("value", self.given(last="}"))])
        if not bare:
            raise self.wrong("expected ':'")
        value = Node("name", key.value, t.at)
        if self.take("="):
            value = Node("default", None, t.at, [("target", value), ("value", self.assigned())])
        return Node("pair", key.value, t.at, [("key", key), ("value", value)])

    def _return(self, t: Token) -> Node:
        if not self.functions:
            raise ScriptSyntaxError(f"return outside function at {t.at}")
        parts = [] if self.sees(";", "}") or self.now.kind == "end" or self.now.line_before else [("value", self.expression())]
        self.ends()
        return Node("return", None, t.at, parts)

    def _throw(self, t: Token) -> Node:
        if self.now.line_before:
            raise self.wrong("a line ends behind throw")
        node = Node("throw", None, t.at, [("value", self.expression())])
        self.ends()
        return node

    def _if(self, t: Token) -> Node:
        parts = [("test", self.grouped()), ("body", self.statement())]
        if self.take("else"):
            parts.append(("else", self.statement()))
        return Node("if", None, t.at, parts)

    def grouped(self) -> Node:
        self.want("(")
        node = self.expression()
        self.want(")")
        return node

    def looped(self) -> Node:
        self.loops += 1
        body = self.statement()
        self.loops -= 1
        return body

    def _while(self, t: Token) -> Node:
        return Node("while", None, t.at, [("test", self.grouped()), ("body", self.looped())])

    def _do(self, t: Token) -> Node:
        body = self.looped()
        self.want("while")
        node = Node("do", None, t.at, [("body", body), ("test", self.grouped())])
        self.take(";")
        return node

    def _for(self, t: Token) -> Node:
        waits = self.take("await")
        self.want("(")
        start = None
        if self.sees("var", "let", "const"):
            start = self.declaration(in_for=True)
        elif not self.sees(";"):
            start = Node("expression", None, self.now.at, [("value", self.expression(with_in=False))])
        if start is not None and (self.sees("in") or self.word("of")):
            kind = self.next().text
            parts = [("target", start), ("of", self.expression())]
            self.want(")")
            return Node(f"for_{kind}", "await" if waits else None, t.at, [*parts, ("body", self.looped())])
        parts = [("start", start)] if start else []
        self.want(";")
        if not self.sees(";"):
            parts.append(("test", self.expression()))
        self.want(";")
        if not self.sees(")"):
            parts.append(("step", self.expression()))
        self.want(")")
        return Node("for", None, t.at, [*parts, ("body", self.looped())])

    def _leave(self, t: Token, allowed: bool) -> Node:
        label = None
        if self.now.kind == "name" and not self.now.line_before:
            label = self.next().value
            if label not in self.labels:
                raise ScriptSyntaxError(f"no such label: {label} at {t.at}")
        elif not allowed:
            raise ScriptSyntaxError(f"{t.text} outside loop at {t.at}")
        self.ends()
        return Node(t.text, label, t.at)

    def _break(self, t: Token) -> Node:
        return self._leave(t, bool(self.loops or self.switches))

    def _continue(self, t: Token) -> Node:
        return self._leave(t, bool(self.loops))

    def _try(self, t: Token) -> Node:
        parts = [("body", self.block())]
        if self.take("catch"):
            if self.take("("):
                parts.append(("name", Node("name", self.name(), self.now.at)))
                self.want(")")
            parts.append(("catch", self.block()))
        if self.take("finally"):
            parts.append(("finally", self.block()))
        if len(parts) == 1:
            raise self.wrong("'try' needs 'catch' or 'finally'")
        return Node("try", None, t.at, parts)

    def _switch(self, t: Token) -> Node:
        parts = [("value", self.grouped())]
        self.want("{")
        self.switches += 1
        seen = False
        while not self.take("}"):
            at = self.now.at
            if self.take("default"):
                if seen:
                    raise ScriptSyntaxError(f"second default at {at}")
                seen, case = True, Node("default", None, at)
            else:
                self.want("case")
                case = Node("case", None, at, [("test", self.expression())])
            self.want(":")
            while not self.sees("case", "default", "}"):
                case.parts.append(("item", self.statement()))
            parts.append(("case", case))
        self.switches -= 1
        return Node("switch", None, t.at, parts)

    # Functions and classes ------------------------------------------------------------------------------------------

    def body(self, read: Callable[[], Node], generator: bool) -> Node:
        """What a function does: loops, labels and generators around it don't reach in."""
        kept = self.functions, self.loops, self.switches, self.labels, self.in_generator
        self.functions, self.loops, self.switches, self.labels, self.in_generator = self.functions + 1, 0, 0, [], generator
        node = read()
        self.functions, self.loops, self.switches, self.labels, self.in_generator = kept
        return node

    def parameters(self) -> list[tuple[str, Node]]:
        self.want("(")
        return self.listed(")", lambda: self.given(last=")"), "parameter")

    def function(self, named: bool) -> Node:
        t, kind = self.now, ["async"] if self.take("async") else []
        self.want("function")
        if self.take("*"):
            kind.append("generator")
        parts = []
        if not self.sees("("):
            parts.append(("name", Node("name", self.name(), self.now.at)))
        elif named:
            raise self.wrong("a function needs a name")
        return Node("function", " ".join(kind) or None, t.at, [*parts, *self.parameters(), ("body", self.body(self.block, "generator" in kind))])

    def method(self, t: Token, kind: str | None, key: Node) -> Node:
        parts = [("key", key), *self.parameters()]
        return Node("method", kind, t.at, [*parts, ("body", self.body(self.block, "generator" in (kind or "")))])

    def class_(self, named: bool) -> Node:
        t, parts = self.next(), []
        if self.now.kind == "name":
            parts.append(("name", Node("name", self.next().value, self.ahead(-1).at)))
        elif named:
            raise self.wrong("a class needs a name")
        if self.take("extends"):
            parts.append(("parent", self.unary()))
        self.want("{")
        while not self.take("}"):
            if not self.take(";"):
                parts.append(("member", self.member()))
        return Node("class", None, t.at, parts)

    def modifiers(self, known: tuple[str, ...]) -> list[str]:
        """Words before a key that are no keys themselves."""
        found = []
        while self.now.text in known and self.now.kind in ("name", "keyword") and self.ahead().text not in ("(", "=", ";", "}", ",", ":"):
            found.append(self.next().text)
        if self.take("*"):
            found.append("generator")
        return found

    def member(self) -> Node:
        t = self.now
        kinds = self.modifiers(("static", "async", "get", "set"))
        key, _ = self.key()
        if self.sees("("):
            return self.method(t, " ".join(kinds) or None, key)
        parts = [("key", key)]
        if self.take("="):
            parts.append(("value", self.body(self.assigned, False)))
        self.ends()
        return Node("field", " ".join(kinds) or None, t.at, parts)

    def key(self) -> tuple[Node, bool]:
        """(a key, whether it is a bare name that can stand for itself)."""
        t = self.next()
        if t.kind == "mark" and t.text == "[":
            node = Node("computed", None, t.at, [("value", self.assigned())])
            self.want("]")
            return node, False
        if t.kind in ("name", "keyword", "string"):
            return Node("key", t.value, t.at), t.kind == "name" or t.text in ("async", "undefined")
        if t.kind == "number":
            return Node("key", number_text(t.value), t.at), False
        self.k -= 1
        raise self.wrong("expected a key")

    # Expressions ----------------------------------------------------------------------------------------------------

    def expression(self, with_in: bool = True) -> Node:
        first = self.assigned(with_in)
        if not self.sees(","):
            return first
        parts = [("item", first)]
        while self.take(","):
            parts.append(("item", self.assigned(with_in)))
        return Node("sequence", None, first.at, parts)

    def assigned(self, with_in: bool = True) -> Node:
        return self.nested(lambda: self._assigned(with_in))

    def _assigned(self, with_in: bool) -> Node:
        t = self.now
        if self.arrow_ahead():
            return self.arrow(with_in)
        if self.in_generator and self.word("yield"):
            self.k += 1
            kind = "all" if self.take("*") else None
            empty = self.sees(")", "]", "}", ",", ";", ":") or self.now.kind == "end" or self.now.line_before
            return Node("yield", kind, t.at, [] if empty and not kind else [("value", self.assigned(with_in))])
        if self.sees("[", "{") and self.tokens[self.close.get(self.k, self.k) + 1].text == "=":
            target = self.target()
            self.want("=")
            return Node("assign", "=", t.at, [("target", target), ("value", self.assigned(with_in))])
        left = self.binary(0, with_in)
        if self.take("?"):
            yes = self.assigned()
            self.want(":")
            return Node("choice", None, t.at, [("test", left), ("yes", yes), ("no", self.assigned(with_in))])
        if self.now.kind == "mark" and self.now.text in ASSIGNING:
            if left.kind not in ("name", "member", "index"):
                raise self.wrong("bad assignment target")
            op = self.next().text
            return Node("assign", op, t.at, [("target", left), ("value", self.assigned(with_in))])
        return left

    def arrow_ahead(self) -> bool:
        k = self.k + (self.sees("async") and not self.ahead().line_before and (self.ahead().text == "(" or self.ahead().kind == "name"))
        t = self.tokens[k]
        if t.kind == "name" or t.text in ("async", "undefined") and t.kind == "keyword":
            k += 1
        elif t.kind == "mark" and t.text == "(" and k in self.close:
            k = self.close[k] + 1
        else:
            return False
        return k < len(self.tokens) and self.tokens[k].kind == "mark" and self.tokens[k].text == "=>" and not self.tokens[k].line_before

    def arrow(self, with_in: bool) -> Node:
        t = self.now
        waits = self.sees("async") and self.ahead().text != "=>" and self.take("async")
        parts = self.parameters() if self.sees("(") else [("parameter", Node("name", self.name(), t.at))]
        self.want("=>")
        read = self.block if self.sees("{") else lambda: self.assigned(with_in)
        return Node("arrow", "async" if waits else None, t.at, [*parts, ("body", self.body(read, False))])

    def binary(self, least: int, with_in: bool) -> Node:
        left = self.unary()
        while True:
            level = BINDING.get(self.now.text, -1) if self.now.kind in ("mark", "keyword") else -1
            if level < least or self.sees("in") and not with_in:
                return left
            op = self.next().text
            right = self.nested(lambda level=level: self.binary(level if op == "**" else level + 1, with_in))
            left = Node("binary", op, left.at, [("left", left), ("right", right)])

    def unary(self) -> Node:
        t = self.now
        if t.kind in ("mark", "keyword") and t.text in PREFIXES:
            self.k += 1
            value = self.nested(self.unary)
            if t.text in ("++", "--") and value.kind not in ("name", "member", "index"):
                raise self.wrong(f"bad {t.text} target")
            return Node("unary", t.text, t.at, [("value", value)])
        node = self.called(self.primary())
        if self.sees("++", "--") and not self.now.line_before:
            if node.kind not in ("name", "member", "index"):
                raise self.wrong(f"bad {self.now.text} target")
            return Node("postfix", self.next().text, node.at, [("value", node)])
        return node

    def called(self, node: Node, calls: bool = True) -> Node:
        """Members, indices, calls and templates behind a value."""
        while True:
            t = self.now
            if t.text not in BEHIND and t.kind != "template":
                return node
            if self.take("."):
                node = Node("member", self.property(), node.at, [("object", node)])
            elif self.take("?."):
                if self.sees("("):
                    node = Node("call", "?.", node.at, [("callee", node), *self.arguments()])
                elif self.take("["):
                    node = Node("index", "?.", node.at, [("object", node), ("index", self.expression())])
                    self.want("]")
                else:
                    node = Node("member", self.property(), node.at, [("object", node), ("optional", Node("mark", "?.", t.at))])
            elif self.take("["):
                node = Node("index", None, node.at, [("object", node), ("index", self.expression())])
                self.want("]")
            elif calls and self.sees("("):
                node = Node("call", None, node.at, [("callee", node), *self.arguments()])
            elif t.kind == "template" and t.text.startswith("`"):
                node = Node("tagged", None, node.at, [("tag", node), ("template", self.template(tagged=True))])
            else:
                return node

    def property(self) -> str:
        if self.now.kind not in ("name", "keyword"):
            raise self.wrong("expected a name")
        return self.next().value

    def spread(self) -> Node:
        t = self.now
        if self.take("..."):
            return Node("spread", None, t.at, [("value", self.assigned())])
        return self.assigned()

    def arguments(self) -> list[tuple[str, Node]]:
        self.want("(")
        return self.listed(")", self.spread, "argument")

    def template(self, tagged: bool = False) -> Node:
        node = Node("template", None, self.now.at)
        while True:
            t = self.next()
            if t.kind != "template":
                self.k -= 1
                raise self.wrong("expected the template to go on")
            if t.value is None and not tagged:
                raise ScriptSyntaxError(f"bad escape in template at {t.at}")
            node.parts.append(("text", Node("string", t.value, t.at)))
            if not t.text.endswith("${"):
                return node
            node.parts.append(("value", self.expression()))

    def primary(self) -> Node:
        t = self.now
        if t.kind == "template":
            return self.template()
        if self.sees("function") or self.sees("async") and self.ahead().text == "function" and not self.ahead().line_before:
            return self.function(named=False)
        if self.sees("class"):
            return self.class_(named=False)
        self.k += 1
        if t.kind == "number":
            return Node("number", number_text(t.value), t.at)
        if t.kind in ("string", "name", "pattern"):
            return Node(t.kind, t.value, t.at)
        if t.kind == "keyword" and t.text in ("true", "false", "null", "undefined"):
            return Node("constant", t.text, t.at)
        if t.kind == "keyword" and t.text in ("super", "async"):
            return Node("name", t.text, t.at)
        if t.text == "(" and t.kind == "mark":
            node = self.expression()
            self.want(")")
            return node
        if t.text == "[" and t.kind == "mark":
            return Node("array", None, t.at, self.items())
        if t.text == "{" and t.kind == "mark":
            return Node("object", None, t.at, self.listed("}", self.entry))
        if t.text == "new":
            return self.new(t)
        self.k -= 1
        raise self.wrong("unexpected token")

    def items(self) -> list[tuple[str, Node]]:
        out = []
        while not self.take("]"):
            if self.take(","):
                out.append(("item", Node("hole", None, self.now.at)))
                continue
            out.append(("item", self.spread()))
            if not self.sees("]"):
                self.want(",")
        return out

    def new(self, t: Token) -> Node:
        if self.take("."):
            return Node("new_target", self.property(), t.at)
        first = self.new(self.next()) if self.sees("new") else self.primary()
        node = self.called(first, calls=False)
        return Node("new", None, t.at, [("callee", node), *(self.arguments() if self.sees("(") else [])])

    def entry(self) -> Node:
        t = self.now
        if self.sees("..."):
            return self.spread()
        kinds = self.modifiers(("async", "get", "set"))
        key, bare = self.key()
        if self.sees("("):
            return self.method(t, " ".join(kinds) or None, key)
        if kinds:
            raise self.wrong("expected a method")
        if self.take(":"):
            return Node("pair", key.value, t.at, [("key", key), ("value", self.assigned())])
        if not bare:
            raise self.wrong("expected ':'")
        return Node("pair", key.value, t.at, [("key", key), ("value", Node("name", key.value, t.at))])


def _closing(found: list[Token]) -> dict[int, int]:
    """The place of the mark that closes each opening one; template pieces open and close as well."""
    out, open_ = {}, []
    for k, t in enumerate(found):
        if t.kind == "template":
            if not t.text.startswith("`") and open_:
                open_.pop()
            if t.text.endswith("${"):
                open_.append(k)
        elif t.kind == "mark" and t.text in ("(", "[", "{"):
            open_.append(k)
        elif t.kind == "mark" and t.text in (")", "]", "}") and open_:
            out[open_.pop()] = k
    return out


def number_text(x: float) -> str:
    """A number as a script writes it, as far as whole ones and short fractions go."""
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def tree(script: str) -> Node:
    """The tree of a script; raises ``ScriptSyntaxError``. Calls nest some ten times as deep as what is read."""
    reader, most = _Reader(script), sys.getrecursionlimit()
    sys.setrecursionlimit(max(most, 20 * DEEPEST))
    try:
        return reader.program()
    finally:
        sys.setrecursionlimit(most)


def walk(root: Node) -> Iterator[tuple[int, int | None, str | None, int, Node]]:
    """(number, the parent's number, part, depth, node) in the order of the text."""
    todo: list[tuple[int | None, str | None, int, Node]] = [(None, None, 0, root)]
    k = 0
    while todo:
        parent, part, depth, node = todo.pop()
        yield k, parent, part, depth, node
        todo += [(k, p, depth + 1, n) for p, n in reversed(node.parts)]
        k += 1


# What scripts say without being run -------------------------------------------------------------------------------------


class Unknown(Exception):
    """A value that only a run would tell."""


def constants(root: Node) -> dict[str, Node]:
    """Values of names declared as const once in the whole script."""
    found: dict[str, list[Node]] = {}
    for _, _, _, _, n in walk(root):
        if n.kind == "declaration":
            for v in n.all("item"):
                if v.get("target").kind == "name":
                    found.setdefault(v.get("target").value, []).append(v.get("value") if n.value == "const" else None)
        elif n.kind in ("function", "arrow", "method"):
            for p in n.all("parameter"):
                for _, _, _, _, x in walk(p):
                    if x.kind == "name":
                        found.setdefault(x.value, []).append(None)
    return {k: v[0] for k, v in found.items() if len(v) == 1 and v[0] is not None}


def value_of(node: Node, known: dict[str, Node], depth: int = 0) -> object:
    """What an expression of literals, constants, sums of texts and ``JSON.stringify`` stands for; raises ``Unknown``."""
    again = lambda n: value_of(n, known, depth + 1)
    if depth > 200:
        raise Unknown
    if node.kind == "string":
        return node.value
    if node.kind == "number":
        x = float(node.value)
        return int(x) if x == int(x) else x
    if node.kind == "constant" and node.value != "undefined":
        return {"true": True, "false": False, "null": None}[node.value]
    if node.kind == "name" and node.value in known:
        return again(known[node.value])
    if node.kind == "template":
        return "".join(text_of(again(n)) for _, n in node.parts)
    if node.kind == "binary" and node.value == "+":
        a, b = again(node.get("left")), again(node.get("right"))
        if isinstance(a, str) or isinstance(b, str):
            return text_of(a) + text_of(b)
    if node.kind == "array" and all(n.kind not in ("hole", "spread") for _, n in node.parts):
        return [again(n) for _, n in node.parts]
    if node.kind == "object" and all(n.kind == "pair" and n.value is not None for _, n in node.parts):
        return {n.value: again(n.get("value")) for _, n in node.parts}
    if node.kind == "call" and dotted(node.get("callee")) == "JSON.stringify" and len(node.all("argument")) == 1:
        return json.dumps(again(node.get("argument")), ensure_ascii=False, separators=(",", ":"))
    raise Unknown


def text_of(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (list, dict)):
        raise Unknown
    return value if isinstance(value, str) else number_text(float(value))


def dotted(node: Node | None) -> str | None:
    """``a.b.c`` for names and their members."""
    names = []
    while node is not None and node.kind == "member":
        names.append(node.value)
        node = node.get("object")
    return ".".join([node.value, *reversed(names)]) if node is not None and node.kind == "name" else None


def calls(root: Node, run: bool = False) -> Iterator[Node]:
    """Every call in order; with ``run`` those alone that stand in no function, or in one that is called where it stands."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.kind == "call":
            yield node
        if run and node.kind in ("function", "arrow", "method"):
            continue
        parts = [n for _, n in node.parts]
        if node.kind == "call" and node.get("callee").kind in ("function", "arrow"):
            parts += [n for p, n in node.get("callee").parts if p == "body"]
        todo += parts[::-1]


FETCHES = ("fetch", "window.fetch", "self.fetch", "globalThis.fetch")


def fetches(root: Node) -> Iterator[tuple[str, str, str]]:
    """(method, address as written, body) of fetch calls, whether or not a run would come by them.

    Address, method and body are told from literals, sums of them and names declared as const once. Calls whose address
    or method only a run would tell are left out; a body of that kind is empty.
    """
    known = constants(root)
    for call in calls(root):
        arguments = call.all("argument")
        if dotted(call.get("callee")) not in FETCHES or not arguments:
            continue
        how = arguments[1] if len(arguments) > 1 else Node("object")
        how = known.get(how.value, how) if how.kind == "name" else how
        try:
            address = value_of(arguments[0], known)
            if how.kind != "object" or any(n.kind != "pair" for _, n in how.parts) or not isinstance(address, str):
                continue
            given = {n.value: n.get("value") for _, n in how.parts}
            method = value_of(given["method"], known) if "method" in given else "GET"
        except Unknown:
            continue
        try:
            body = value_of(given["body"], known) if "body" in given else None
        except Unknown:
            body = None
        if isinstance(method, str):
            yield method.upper(), address, body if isinstance(body, str) else ""
