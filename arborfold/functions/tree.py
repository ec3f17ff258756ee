"""Trees of nodes that can be edited, and their HTML text."""

from __future__ import annotations

from .html import VOID, Draft, Row, _finish, parse
from .page import Page, match, set_attr


class Node:
    """An element, text, comment, document or fragment with its place in a tree."""

    __slots__ = ("kind", "tag", "attrs", "text", "parent", "children")

    def __init__(self, kind: str, tag: str | None = None, attrs: list[tuple[str, str]] | None = None, text: str | None = None):
        self.kind, self.tag, self.attrs, self.text = kind, tag, list(attrs or []), text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def detach(self) -> Node:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None
        return self

    def holds(self, other: Node | None) -> bool:
        """Whether ``other`` is this node or stands below it."""
        while other is not None and other is not self:
            other = other.parent
        return other is not None

    def insert(self, node: Node, before: Node | None = None) -> None:
        """Put ``node``, or the children of a fragment, before a child, or at the end; a node can't go below itself."""
        if node.holds(self):
            raise ValueError("a node can't stand below itself")
        if before is not None and before.parent is not self:
            raise ValueError("no child of this node")
        for n in list(node.children) if node.kind == "fragment" else [node]:
            if n is before:
                continue
            n.detach()
            at = len(self.children) if before is None else next(k for k, c in enumerate(self.children) if c is before)
            self.children.insert(at, n)
            n.parent = self

    def clear(self) -> None:
        for c in list(self.children):
            c.detach()

    def clone(self, deep: bool = True) -> Node:
        out = Node(self.kind, self.tag, self.attrs, self.text)
        todo = [(self, out)] if deep else []
        while todo:
            a, b = todo.pop()
            for c in a.children:
                d = Node(c.kind, c.tag, c.attrs, c.text)
                d.parent = b
                b.children.append(d)
                todo.append((c, d))
        return out

    def set(self, name: str, value: str) -> None:
        set_attr(self.attrs, name, value)

    def unset(self, name: str) -> None:
        self.attrs = [a for a in self.attrs if a[0] != name]

    def outer_html(self) -> str:
        """Text escapes & < >, attributes & and double quotes; void elements have no end; script text is escaped like any."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.kind == "text":
                out.append(n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif n.kind == "comment":
                out.append(f"<!--{n.text}-->")
            else:
                if n.kind == "element":
                    out.append(f"<{n.tag}" + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in n.attrs) + ">")
                    if n.tag not in VOID:
                        todo.append(f"</{n.tag}>")
                if n.tag not in VOID:
                    todo += n.children[::-1]
        return "".join(out)

    def inner_html(self) -> str:
        return "".join(c.outer_html() for c in self.children)


def from_rows(rows: list[Row]) -> list[Node]:
    """The rows' nodes, each in its place, the document first."""
    nodes = [Node(r.kind, r.tag, r.attrs, r.text) for r in rows]
    for r in rows[1:]:
        nodes[r.node_id].parent = nodes[r.parent_id]
        nodes[r.parent_id].children.append(nodes[r.node_id])
    return nodes


def ordered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.children[::-1]
    return out


def to_rows(root: Node) -> list[Row]:
    """Rows of a tree, numbered anew."""
    nodes = ordered(root)
    number = {id(n): k for k, n in enumerate(nodes)}
    rows = [Draft(n.kind, n.tag, n.attrs, n.text, number.get(id(n.parent)) if k else None) for k, n in enumerate(nodes)]
    for n, r in zip(nodes, rows, strict=True):
        r.children = [number[id(c)] for c in n.children]
    for r in rows[1:]:
        r.depth = rows[r.parent].depth + 1
    return _finish(rows)


def fragment(html: str) -> Node:
    """Parsed HTML as a fragment."""
    root = from_rows(parse(html))[0]
    root.kind = "fragment"
    return root


#: Edits and what they do to each hit of their selector.
EDITS = ("set", "unset", "text", "html", "append", "before", "remove", "clear", "wrap")


def edit(root: Node, op: str, selector: str, arg: str | None = None, value: str | None = None) -> int:
    """Apply an edit to the hits of a selector as they stand now; returns how many there were.

    set (attribute, value), unset (attribute), text, html (children instead of what is there), append and before
    (parsed HTML, a copy for each hit), remove, clear, wrap (into a new element of a tag).
    """
    if op not in EDITS:
        raise ValueError(f"unknown edit {op!r}")
    nodes = ordered(root)
    hits = [nodes[k] for k in match(to_rows(root), selector)]
    for n in hits:
        if op == "set":
            n.set(arg, value or "")
        elif op == "unset":
            n.unset(arg)
        elif op in ("text", "html", "clear"):
            n.clear()
            if op == "text" and arg:
                n.insert(Node("text", text=arg))
            elif op == "html":
                n.insert(fragment(arg or ""))
        elif op == "append":
            n.insert(fragment(arg or ""))
        elif op == "before" and n.parent is not None:
            n.parent.insert(fragment(arg or ""), n)
        elif op == "remove":
            n.detach()
        elif op == "wrap" and n.parent is not None:
            new = Node("element", (arg or "div").lower())
            n.parent.insert(new, n)
            new.insert(n)
    return len(hits)


def written(page: Page) -> tuple[str, int]:
    """(HTML of a page after what its scripts plainly write, how many writes there were); each sees what those before it left."""
    done, nodes = 0, from_rows(page.rows)
    root = nodes[0]
    for statement in page.statements():
        found = page.write(*statement)
        if found is None:
            continue
        row, what, name, value = found
        n = nodes[row.node_id]
        done += 1
        if what in ("set", "unset"):  # no node moves
            if what == "set":
                n.set(name, value or "")
            else:
                n.unset(name)
            page.rows[row.node_id] = row._replace(attrs=n.attrs)
            continue
        if what == "remove":
            n.detach()
        else:
            if what != "append":
                n.clear()
            if what == "text" and value:
                n.insert(Node("text", text=value))
            elif what != "text":
                n.insert(fragment(value or ""))
        nodes, page.rows = ordered(root), to_rows(root)
    return root.outer_html(), done
