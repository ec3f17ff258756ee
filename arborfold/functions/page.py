"""One parsed page at hand: selectors, text, forms, clicks and embedded data, in one pass over its rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote_plus

from . import css, json_text, url
from .html import Row, collapse, parse
from .script_tokens import ScriptSyntaxError
from .script_tree import Node, Unknown, calls, constants, dotted, fetches, text_of, tree, value_of
from .snapshot import Renderer, role_of

#: Where pages keep their data, in order of precedence.
JSON_SELECTORS = ("script#__NEXT_DATA__", 'script[type="application/ld+json"]', 'script[type="application/json"]')
NOT_SENT = ("submit", "button", "image", "file", "reset")
OFF = ("", "off", "false", "0")
SCRIPT_TYPES = ("", "text/javascript", "application/javascript", "module")


class ActionError(ValueError):
    """An action the page has no place for."""


def attr(row: Row, name: str) -> str | None:
    for k, v in row.attrs:
        if k == name:
            return v
    return None


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[ \t\n\r\f]+", text) if t]


_TESTS: dict[str, Callable[[str, str], bool]] = {
    "": lambda a, v: True, "=": str.__eq__, "~=": lambda a, v: v in re.split(r"[ \t\n\r\f]+", a), "|=": lambda a, v: a == v or a.startswith(f"{v}-"),
    "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__,
}


def own_test(c: css.Compound) -> Callable[[Row, Callable[[Row], bool]], bool]:
    """Whether an element's own row fits a compound; the second argument tells whether a row is empty."""
    tests: list[Callable] = []
    if c.tag is not None:
        tests.append(lambda r, e: r.tag == c.tag)
    wanted = [("id", "=", c.id)] if c.id is not None else []
    for name, op, value in [*wanted, *(("class", "~=", k) for k in c.classes), *c.attrs]:
        tests.append(lambda r, e, n=name, f=_TESTS[op], v=value: (own := attr(r, n)) is not None and f(own, v))
    for name, arg in c.pseudos:
        if name == "nth-child":
            a, b = arg
            tests.append(lambda r, e, a=a, b=b: r.elem_ord == b if a == 0 else (r.elem_ord - b) % a == 0 and (r.elem_ord - b) // a >= 0)
        elif name == "not":
            tests.append(lambda r, e, f=own_test(arg): not f(r, e))
        else:
            tests.append({"first-child": lambda r, e: r.elem_ord == 1, "last-child": lambda r, e: r.elem_ord == r.elem_total, "only-child": lambda r, e: r.elem_total == 1, "empty": lambda r, e: e(r)}[name])
    return lambda r, e: all(t(r, e) for t in tests)


@lru_cache(maxsize=256)
def _compiled(selector: str) -> list[tuple[list[Callable], list[str]]]:
    return [([own_test(c) for c in s.compounds], s.combinators) for s in css.parse(selector)]


def match(rows: list[Row], selector: str) -> list[int]:
    """Ids of the elements that match, in document order; raises ``css.CssError``.

    One pass a group: a node's bits tell which compounds of the chain end at it; a compound asks its combinator's
    neighbour for the bit before. Rows are those of one page, ids counting from 0.
    """
    empty: set[int] | None = None

    def is_empty(r: Row) -> bool:
        nonlocal empty
        if empty is None:
            empty = {x.parent_id for x in rows if x.kind == "element" or x.kind == "text" and x.text.strip()}
        return r.node_id not in empty

    found: set[int] = set()
    for tests, combinators in _compiled(selector):
        n = len(rows)
        own, above = [0] * n, [0] * n  # bits of a node, and of it and its ancestors
        before, earlier = {}, {}  # by parent, bits of the last element and of all elements so far
        last = 1 << (len(tests) - 1)
        for r in rows:
            if r.kind != "element":
                continue
            k, p, bits = r.node_id, r.parent_id, 0
            for i, test in enumerate(tests):
                if i:
                    c = combinators[i - 1]
                    held = own[p] if c == ">" else above[p] if c == " " else before.get(p, 0) if c == "+" else earlier.get(p, 0)
                    if not held >> (i - 1) & 1:
                        continue
                if test(r, is_empty):
                    bits |= 1 << i
            own[k], above[k] = bits, above[p] | bits
            before[p] = bits
            earlier[p] = earlier.get(p, 0) | bits
            if bits & last:
                found.add(k)
    return sorted(found)


class Page:
    """A parsed page with its address. Filling it in changes its rows' attributes in place."""

    def __init__(self, html: str | None, at: str | None = None, bare: bool = True):
        self.rows, self.at = parse(html or "", bare), at or ""
        self._base: tuple[str, url.Url] | None = None

    def select(self, selector: str) -> list[Row]:
        return [self.rows[k] for k in match(self.rows, selector)]

    def below(self, r: Row) -> list[Row]:
        return self.rows[r.node_id + 1 : r.subtree_end]

    def text(self, r: Row) -> str:
        """The text nodes below, joined by spaces, white space collapsed."""
        return collapse(" ".join(x.text for x in self.below(r) if x.kind == "text"))

    def raw_text(self, r: Row) -> str:
        """The text nodes below as they stand."""
        return "".join(x.text for x in self.below(r) if x.kind == "text")

    def snapshot(self) -> str:
        return Renderer(self.rows).render()

    def title(self) -> str | None:
        first = next((r for r in self.rows if r.tag == "title"), None)
        return None if first is None or first.subtree_end == first.node_id + 1 else self.text(first)

    def lines(self, selector: str) -> list[str]:
        return [f"- {r.tag} '{self.text(r)[:120]}'" for r in self.select(selector)]

    def closest(self, r: Row, selector: str) -> Row | None:
        """The nearest of ``r`` and its ancestors that matches."""
        hits = set(match(self.rows, selector))
        while r is not None and r.node_id not in hits:
            r = self.rows[r.parent_id] if r.parent_id is not None else None
        return r

    def stats(self) -> tuple[int, int]:
        """Nodes, and distinct names of tags and attributes."""
        return len(self.rows), len({r.tag for r in self.rows if r.tag} | {k for r in self.rows for k, _ in r.attrs})

    def refs(self) -> dict[int, Row]:
        return {r.ref: r for r in self.rows if r.ref}

    def base(self) -> url.Url:
        """The page's address; it is read once."""
        if self._base is None or self._base[0] != self.at:
            self._base = self.at, url.parse(self.at)
        return self._base[1]

    def resolve(self, text: str) -> str:
        return str(url.join(self.base(), text.strip()))

    def json_blocks(self) -> list[tuple[Row, str, str]]:
        """(element, first selector that finds it, text) of embedded JSON, by selector and document order."""
        seen: dict[int, tuple] = {}
        for s in JSON_SELECTORS:
            for r in self.select(s):
                seen.setdefault(r.node_id, (r, s, self.text(r)))
        return list(seen.values())

    def json_lines(self, path: str | None = None) -> list[str]:
        """Each block under its selector, parsed and written again, or what a dotted path holds there."""
        out = []
        for _, selector, raw in self.json_blocks():
            try:
                value = json_text.parse(raw)
            except json_text.JsonError as e:
                out.append(f"== {selector}\n(parse error: {e})")
                continue
            found = json_text.get(value, path) if path else value
            out.append(f"== {selector}\n" + ("(no match for path)" if found is json_text.MISSING else json_text.dump(found)))
        return out

    def scripts(self, most: int = 32) -> list[tuple[Row, str | None, str | None]]:
        """(element, src, body) of what would run: each address once, ``most`` of them."""
        out, seen = [], set()
        for r in self.rows:
            if r.tag != "script" or (attr(r, "type") or "").strip().lower() not in SCRIPT_TYPES:
                continue
            src = attr(r, "src")
            if src is None:
                out.append((r, None, self.raw_text(r) or None))
            elif src not in seen and len(seen) < most:
                seen.add(src)
                out.append((r, src, None))
        return out

    # Forms ----------------------------------------------------------------------------------------------------------

    def find_form(self, selector: str | None = None) -> Row | None:
        """The first form, or the first among the hits of a selector."""
        return next((r for r in (self.select(selector) if selector else self.rows) if r.tag == "form"), None)

    def _option(self, select: Row) -> str:
        options = [r for r in self.below(select) if r.tag == "option"]
        first = next((o for o in options if attr(o, "selected") is not None), options[0] if options else None)
        return "" if first is None else (attr(first, "value") if attr(first, "value") is not None else self.text(first))

    def form_fields(self, form: Row) -> list[tuple[str, str]]:
        """Successful controls in order: unnamed and disabled ones and buttons send nothing; boxes only when checked."""
        out = []
        for r in self.below(form):
            name, kind, value = attr(r, "name"), attr(r, "type") or "text", attr(r, "value")
            if r.tag not in ("input", "select", "textarea") or not name or attr(r, "disabled") is not None:
                continue
            if r.tag == "input":
                box = kind in ("checkbox", "radio")
                if kind in NOT_SENT or box and attr(r, "checked") is None:
                    continue
                out.append((name, value if value is not None else "on" if box else ""))
            elif value is not None:
                out.append((name, value))
            else:
                out.append((name, self._option(r) if r.tag == "select" else self.text(r)))
        return out

    def form_of(self, r: Row) -> Row | None:
        """The form that clicking an element sends, if it sends any: the nearest one it stands in."""
        up = r if r.tag in ("button", "input", "summary") else None
        while up is not None and up.tag != "form":
            up = self.rows[up.parent_id] if up.parent_id is not None else None
        return up

    def submit(self, form: Row, values: list[tuple[str, str]] = ()) -> tuple[str, str, str]:
        """(method, address, body) of a form's request; ``values`` replace the first field of their name or come behind."""
        if "multipart" in (attr(form, "enctype") or "").lower():
            raise ActionError("unsupported: multipart/form-data")
        fields = self.form_fields(form)
        for name, value in values:
            at = next((k for k, f in enumerate(fields) if f[0] == name), None)
            if at is None:
                fields.append((name, value))
            else:
                fields[at] = (name, value)
        data = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}".replace("~", "%7E") for k, v in fields)
        target = url.join(self.base(), (attr(form, "action") or "").strip())
        if (attr(form, "method") or "get").lower() == "post":
            return "POST", str(target), data
        return "GET", str(target._replace(query=data) if data else target), ""

    def fill(self, ref: int, value: str) -> None:
        """Put a value into a text control, or switch a box."""
        r = self.refs().get(ref)
        if r is None:
            raise ActionError(f"no element #{ref}")
        if r.tag not in ("input", "textarea", "select"):
            raise ActionError(f"unsupported: fill on {r.tag}")
        if r.tag == "input" and attr(r, "type") in ("checkbox", "radio"):
            if value in OFF:
                r.attrs[:] = [a for a in r.attrs if a[0] != "checked"]
            else:
                set_attr(r.attrs, "checked", "")
        else:
            set_attr(r.attrs, "value", value)

    def click(self, ref: int) -> tuple[str, str, str]:
        """(method, address, body) of what clicking a numbered element asks for."""
        r = self.refs().get(ref)
        if r is None:
            raise ActionError(f"no element #{ref}")
        if r.tag == "a" and attr(r, "href") is not None:
            return "GET", self.resolve(attr(r, "href")), ""
        form = self.form_of(r)
        if form is None:
            raise ActionError(f"unsupported: click on {r.tag}")
        return self.submit(form)

    # Scripts --------------------------------------------------------------------------------------------------------

    def trees(self, word: str | None = None) -> list[tuple[Row, Node | None, str | None]]:
        """(element, tree, error) of each inline script that would run; with ``word`` of those alone that can hold such a name,
        written out or with escapes."""
        out = []
        for r, _, body in self.scripts():
            if body is not None and (word is None or word in body or "\\u" in body):
                try:
                    out.append((r, tree(body), None))
                except ScriptSyntaxError as e:
                    out.append((r, None, str(e)))
        return out

    def fetches(self) -> list[tuple[str, str, str]]:
        """(method, address, body) of the fetch calls in the page's own scripts, as far as their text tells; scripts that can't be
        read have none, calls to what is no address are left out."""
        out = []
        for _, root, _ in self.trees("fetch"):
            for method, address, body in fetches(root) if root else ():
                try:
                    out.append((method, self.resolve(address), body))
                except url.UrlError:
                    continue
        return out

    def _target(self, node: Node, known: dict[str, Node], depth: int = 0) -> Row | None:
        """The element that an expression of a script stands for: by id, selector or place among forms and links."""
        node = known.get(node.value, node) if node.kind == "name" else node
        try:
            if node.kind == "call" and (arguments := node.all("argument")):
                how, what = dotted(node.get("callee")), value_of(arguments[0], known)
                if how == "document.getElementById":
                    return next((r for r in self.rows if r.kind == "element" and attr(r, "id") == what), None)
                if how == "document.querySelector" and isinstance(what, str):
                    return next(iter(self.select(what)), None)
            if node.kind in ("index", "member") and (of := node.get("object")) is not None:
                key = value_of(node.get("index"), known) if node.kind == "index" else node.value
                found = None
                if dotted(of) in ("document.forms", "document.links"):
                    found = [r for r in self.rows if r.tag == "form" or r.tag == "a" and attr(r, "href") is not None]
                    found = [r for r in found if (r.tag == "form") == (dotted(of) == "document.forms")]
                elif of.kind == "call" and dotted(of.get("callee")) == "document.querySelectorAll" and of.all("argument"):
                    found = self.select(str(value_of(of.all("argument")[0], known)))
                if found is not None:
                    named = [r for r in found if isinstance(key, str) and key in (attr(r, "id"), attr(r, "name"))]
                    return found[key] if isinstance(key, int) and 0 <= key < len(found) else next(iter(named), None)
        except (Unknown, css.CssError):
            pass
        return None

    def _asked(self, root: Node, depth: int = 0) -> Iterator[tuple[str, str, str, str]]:
        known = constants(root)
        for call in calls(root, run=True):
            callee, arguments = call.get("callee"), call.all("argument")
            if dotted(callee) in ("__doPostBack", "window.__doPostBack"):
                form = self.find_form()
                try:
                    event = [text_of(value_of(a, known)) for a in arguments[:2]]
                except Unknown:
                    continue
                if form is not None:
                    event += ["undefined"] * (2 - len(event))
                    yield "postback", *self.submit(form, list(zip(POSTBACK, event, strict=True)))
            elif callee.kind == "member" and callee.value in ("click", "submit"):
                r = self._target(callee.get("object"), known)
                if r is None:
                    continue
                if callee.value == "submit" and r.tag == "form":
                    yield "submit", *self.submit(r)
                elif callee.value == "click" and r.tag == "a" and (href := attr(r, "href")) is not None:
                    if href.lstrip()[:11].lower() == "javascript:":
                        if depth < 3:
                            yield from self._asked(tree(href.lstrip()[11:]), depth + 1)
                    elif (at := self.resolve(href)).startswith(("http:", "https:")):
                        yield "link", "GET", at, ""

    def script_requests(self) -> list[tuple[str, str, str, str]]:
        """(kind, method, address, body) of the navigations that the page's scripts ask for outside of functions: clicks on
        links, submits of forms, post-backs of the first form."""
        out = []
        for _, root, _ in self.trees():
            try:
                out += self._asked(root) if root else ()
            except (ActionError, url.UrlError, ScriptSyntaxError):
                continue
        return out

    def bridge(self) -> tuple[str, str, str, str] | None:
        """The one navigation that is followed: the last click on a link, else the last form sent."""
        found = self.script_requests()
        return next((x for x in reversed(found) if x[0] == "link"), found[-1] if found else None)


    def statements(self) -> list[tuple[Node, dict[str, Node]]]:
        """The expressions that stand as statements of their own in the page's scripts, outside functions, loops and
        branches, with the names their script declares as const."""
        out = []
        for _, root, _ in self.trees():
            known = constants(root) if root else {}
            out += [(s.get("value"), known) for s in root.all("item") if s.kind == "expression"] if root else []
        return out

    def write(self, node: Node, known: dict[str, Node]) -> tuple[Row, str, str, str | None] | None:
        """(element, edit, name, value) of a statement that plainly writes: an assignment or call on an element found as in
        ``script_requests``, with values its text tells. Edits: text, html, append (parsed HTML), set and unset (an attribute), remove."""
        try:
            return self._write(node, known)
        except (Unknown, AttributeError):
            return None

    def _write(self, node: Node, known: dict[str, Node]) -> tuple[Row, str, str, str | None] | None:
        if node.kind == "assign" and node.value == "=" and node.get("target").kind == "member":
            target, name = node.get("target").get("object"), node.get("target").value
            value = value_of(node.get("value"), known)
            if dotted(node.get("target")) in ("document.title", "window.document.title"):
                title = next((r for r in self.rows if r.tag == "title"), None)
                return (title, "text", "", text_of(value)) if title else None
            if target.kind == "member" and target.value == "style":
                r, pairs = self._target(target.get("object"), known), []
                if r is None:
                    return None
                key = re.sub("[A-Z]", lambda m: f"-{m[0].lower()}", name)
                pairs = [p for p in (d.partition(":") for d in (attr(r, "style") or "").split(";")) if p[1] and p[0].strip().lower() != key]
                pairs += [(key, ":", text_of(value))] if text_of(value) else []
                return r, "set", "style", " ".join(f"{k.strip()}: {v.strip()};" for k, _, v in pairs)
            r = self._target(target, known)
            if r is None:
                return None
            if name in ("textContent", "innerText"):
                return r, "text", "", text_of(value)
            if name == "innerHTML":
                return r, "html", "", text_of(value)
            if name in FLAGS:
                return r, "set" if value else "unset", name, "" if value else None
            return (r, "set", WRITTEN[name], text_of(value)) if name in WRITTEN else None
        if node.kind != "call" or node.get("callee").kind != "member":
            return None
        callee, given = node.get("callee"), [text_of(value_of(a, known)) for a in node.all("argument")]
        of, name = callee.get("object"), callee.value
        if of.kind == "member" and of.value == "classList" and name in ("add", "remove") and given:
            r = self._target(of.get("object"), known)
            held = _tokens(attr(r, "class") or "")
            left = [t for t in held if t not in given] if name == "remove" else [*held, *(t for t in dict.fromkeys(given) if t not in held)]
            return r, "set", "class", " ".join(left)
        r = self._target(of, known)
        if r is None:
            return None
        if name == "setAttribute" and len(given) == 2:
            return r, "set", given[0].lower(), given[1]
        if name == "removeAttribute" and given:
            return r, "unset", given[0].lower(), None
        if name == "insertAdjacentHTML" and len(given) == 2 and given[0].lower() == "beforeend":
            return r, "append", "", given[1]
        return (r, "remove", "", None) if name == "remove" and not given else None


#: The fields of a post-back, properties that are attributes, and those that are there or not.
POSTBACK = ("__EVENTTARGET", "__EVENTARGUMENT")
WRITTEN = {"id": "id", "className": "class", "value": "value", "href": "href", "src": "src", "title": "title", "name": "name", "alt": "alt", "type": "type", "lang": "lang"}
FLAGS = ("checked", "disabled", "hidden", "selected")


def set_attr(attrs: list[tuple[str, str]], name: str, value: str) -> None:
    """Set the first attribute of a name at its place, or add it."""
    at = next((k for k, a in enumerate(attrs) if a[0] == name), None)
    if at is None:
        attrs.append((name, value))
    else:
        attrs[at] = (name, value)


def role(r: Row) -> str:
    return role_of(r.tag, r.attrs)
