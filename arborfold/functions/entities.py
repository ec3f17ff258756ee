"""Character references as this engine decodes them: a fixed set of names, some also without a semicolon."""

from __future__ import annotations

import re
from html.entities import html5, name2codepoint

#: The names known with a semicolon, besides those of U+00C0 to U+00FF.
_NAMES = (
    "amp lt gt quot apos nbsp ensp emsp thinsp zwnj zwj shy hellip mdash ndash lsquo rsquo ldquo rdquo sbquo bdquo dagger Dagger bull"
    " prime Prime lsaquo rsaquo oline frasl copy reg trade euro pound yen cent curren deg plusmn times divide micro para sect middot"
    " permil sup1 sup2 sup3 frac14 frac12 frac34 iexcl iquest ordf ordm laquo raquo not macr acute cedil uml brvbar weierp image real"
    " alefsym spades clubs hearts diams larr uarr rarr darr harr forall part exist empty nabla isin notin prod sum minus lowast radic"
    " prop infin and or cap cup int there4 sim cong asymp ne equiv le ge sub sup nsub sube supe oplus otimes perp sdot"
    " Alpha Beta Gamma Delta alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega Omega Sigma Pi Theta Lambda Phi"
)
NAMED = {n: html5[f"{n};"] for n in [*_NAMES.split(), *(n for n, c in name2codepoint.items() if 0xC0 <= c <= 0xFF)]}
#: The names also known without a semicolon, by longest prefix.
BARE = sorted("amp lt gt quot nbsp copy reg trade hellip mdash ndash laquo raquo times divide euro pound yen cent deg plusmn para sect middot bull micro".split(), key=len, reverse=True)

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]*)(;?))")


def _number(n: int, literal: str) -> str:
    if n > 0xFFFFFFFF:
        return literal
    if 0x80 <= n <= 0x9F:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)
    return "�" if n == 0 or 0xD800 <= n <= 0xDFFF or n > 0x10FFFF else chr(n)


def _one(m: re.Match) -> str:
    if m[1] or m[2]:
        return _number(int(m[1], 16) if m[1] else int(m[2]), m[0])
    if m[4] and m[3] in NAMED:
        return NAMED[m[3]]
    for name in BARE:
        if m[3].startswith(name):
            return NAMED[name] + m[3][len(name) :] + m[4]
    return m[0]


def _closed(m: re.Match) -> str:
    return _one(m) if m[4] or not m[3] else m[0]


def decode(text: str, bare: bool = True) -> str:
    """Text with its references decoded; without ``bare`` names count only where a semicolon ends them."""
    if "&" not in text:
        return text
    return _REFERENCE.sub(_one if bare else _closed, text)
