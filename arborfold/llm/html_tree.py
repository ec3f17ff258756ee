"""A forgiving HTML parser to small trees, text blocks with their place, and simple tree matching."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: What a start tag ends when it stands open, and what keeps it open.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody tfoot", "table"), "thead": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

#: Elements deeper than this have no children of their own; what they hold follows them, as in browsers.
DEPTH = 256

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


def _attrs(text: str) -> dict[str, str]:
    if not text or text == "/":
        return {}
    out = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """The document as a tree; unclosed and misnested tags are closed where a browser would close them, roughly."""
    root = Node("#root", {}, None)
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            return root
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].children.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and stack[k].tag not in ("p",):
                    break
        if tag in ENDS:
            ended, kept = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in kept:
                    break
                if stack[k].tag in ended:
                    del stack[k:]
                    if tag in ("li", "option"):
                        break
        node = Node(tag, _attrs(m[3] or m[6] or ""), stack[-1])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(unescape(html[at : end.start() if end else len(html)]))
            at = end.end() if end else len(html)
            continue
        if len(stack) < DEPTH and (tag in BLOCK or not (m[3] or "").endswith("/")):
            stack.append(node)


def skeleton(root: Node) -> tuple[str, dict[int, int]]:
    """The tree of block tags as text, ``tag(child child)``, with runs of equal neighbours as one node, and the
    number, in reading order, of the skeleton's node for each block node (by ``id``)."""
    number: dict[int, int] = {}

    def shape(node: Node) -> tuple:
        kids = [shape(c) for c in node.children if not isinstance(c, str) and c.tag in BLOCK] if node.tag not in RAW else []
        runs: list[list] = []
        for s in kids:
            if runs and runs[-1][0][0] == s[0]:
                runs[-1].append(s)
            else:
                runs.append([s])
        return f"{node.tag}({' '.join(r[0][0] for r in runs)})" if runs else node.tag, node, runs

    def place(s: tuple, n: int) -> int:
        number[id(s[1])] = n
        n += 1
        for run in s[2]:
            ends = [place(k, n) for k in run]
            n = ends[0]
        return n

    top = shape(root)
    place(top, 0)
    return top[0], number


def repeated(root: Node, number: dict[int, int]) -> list[int]:
    """The numbers of skeleton nodes that stand for several neighbours."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        kids = [c for c in node.children if not isinstance(c, str)]
        blocks = [number[id(c)] for c in kids if c.tag in BLOCK and id(c) in number]
        found |= {a for a, b in zip(blocks, blocks[1:], strict=False) if a == b}
        todo += kids
    return sorted(found)


@lru_cache(maxsize=4096)
def read_skeleton(text: str) -> tuple:
    """(tag, number, children) from a skeleton's text."""
    n, stack, done = 0, [], None
    for part in re.findall(r"[^()\s]+|[()]", text):
        if part == "(":
            stack.append(done)
        elif part == ")":
            done = stack.pop()
        else:
            done = (part, n, [])
            n += 1
            if stack:
                stack[-1][2].append(done)
            else:
                top = done
    return top


def match(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest order-preserving match of two trees with equal tags from the roots down, as
    (size, pairs of node numbers)."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[2], b[2]
    if not x or not y:
        return 1, [(a[1], b[1])]
    best = [[(0, None)] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            up, left = best[i - 1][j][0], best[i][j - 1][0]
            size, pairs = match(x[i - 1], y[j - 1])
            both = best[i - 1][j - 1][0] + size
            best[i][j] = (both, pairs) if size and both >= up and both >= left else (up, "up") if up >= left else (left, "left")
    i, j, found = len(x), len(y), [(a[1], b[1])]
    total = 1 + best[i][j][0]
    while i and j:
        step = best[i][j][1]
        if step == "up":
            i -= 1
        elif step == "left":
            j -= 1
        elif step is None:
            break
        else:
            found += step
            i, j = i - 1, j - 1
    return total, found
