"""The bounded matcher: known cases, the JVM's engine as its measure, and patterns that would never end."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborfold.functions import patterns
from arborfold.functions.patterns import OutOfFuel, compiled, expand, matches, replace, split
from arborfold.functions.regexes import RegexError

CASES = [
    (r"<([^>]+@[^>]+)>", "", "a<b@c>d", (1, 6, ("b@c",))), (r"text\/plain|text\/html", "i", "TEXT/HTML", (0, 9, ())), (r"\d{4,8}", "", "ab12345c", (2, 7, ())), (r"(a*)*b", "", "aaab", (0, 4, ("aaa",))),
    (r"(a|ab)(c|bcd)(d*)", "", "abcd", (0, 4, ("a", "bcd", ""))), (r"(\w)\1", "", "abccd", (2, 4, ("c",))), (r"(?=(a+))a*b\1", "", "baaabac", (3, 6, ("a",))), (r"^b", "m", "a\nb", (2, 3, ())), (r"^b", "", "a\nb", None),
    (r"b$", "", "b\n", None), (r"b$", "m", "b c", (0, 1, ())), (r"a{,2}", "", "a{,2}", (0, 5, ())), (r"\bé", "", "é", None), (r"[]", "", "x", None), (r"[^]", "", "\n", (0, 1, ())), (r".", "", "\n\r\x85", (2, 3, ())), (r".", "s", "\n", (0, 1, ())),
    (r"a??b", "", "aab", (1, 3, ())), (r"(?:)*x", "", "x", (0, 1, ())), (r"(a)|b\1", "", "b", (0, 1, (None,))), (r"\101", "", "\x0101", (0, 3, ())), (r"[\d-x]+", "", "1-x", (0, 3, ())), (r"x(?!y)", "", "xyxz", (2, 3, ())),
    (r"É", "i", "é", (0, 1, ())), (r"[^a]", "i", "Ab", (1, 2, ())), (r"\S\s\W\D", "", "a b.", None), (r"\S\s\W\D", "", "a .b", (0, 4, ())), (r"A\x42\t", "", "AB\t", (0, 3, ())), (r"(a)(?:b|(c))", "", "ab", (0, 2, ("a", None))), (r"(?=a)b|a", "", "a", (0, 1, ())),
]


@pytest.mark.parametrize(("pattern", "flags", "text", "want"), CASES)
def test_matches(pattern, flags, text, want):
    m = compiled(pattern, flags).match(text)
    assert (m and (m.start, m.end, tuple(g and text[g[0] : g[1]] for g in m.groups))) == want


@pytest.mark.parametrize("bad", ["(", "a)", "[a", "*", "^*", "(?<a>b)", "(?<=a)b", "[b-a]", "a{2,1}", "\\", "(?:" * 300 + ")" * 300, "(((((a|b){99}){99}){99}){9}){9}"])
def test_refused_patterns(bad):
    with pytest.raises(RegexError):
        compiled(bad)


ATOMS = ["a", "b", "[ab]", "[^a]", ".", r"\w", "(a)", "(?:b|c)", "(a|bc)", r"\b", "(?=b)", "(?!a)", "^", "$"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ATOMS), st.sampled_from(["", "", "*", "+", "?", "*?", "{1,2}", "{2}"])), min_size=1, max_size=5), st.text("abc\n", max_size=10))
def test_agrees_with_python(parts, text):
    pattern = "".join(a + (q if a not in (r"\b", "^", "$") else "") for a, q in parts)
    want = re.compile(pattern.replace("$", r"\Z").replace(".", r"[^\n\r]"), re.ASCII).search(text)
    got = compiled(pattern).match(text)
    assert (got and (got.start, got.end)) == (want and want.span())


def test_fuel():
    for pattern, text in (("(a+)+$", "a" * 40 + "!"), ("(a|aa)+$", "a" * 60 + "!"), (r"(.*)(.*)(.*)(.*)\1x", "ab" * 200), ("(?=(a+)+$)b", "a" * 40 + "!")):
        with pytest.raises(OutOfFuel, match="out of fuel"):
            compiled(pattern).match(text, 0, 100_000)
    assert compiled("a*b").match("a" * 100_000 + "b", 0, 300_000).end == 100_001
    assert len(list(matches(compiled("[ab]c"), "xac" * 5000, 1000))) == 5000  # fuel is for each match


def test_replace_and_split():
    assert replace(compiled("(a)(b)?", "g"), "xabya", "[$1$2$3$&$$$`|$']") == "x[ab$3ab$x|ya]y[a$3a$xaby|]" and replace(compiled("a"), "aa", "b") == "ba"
    many = compiled("(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)(k)")
    assert expand("$11-$1-$99-$0-$01", many.match("abcdefghijk"), "abcdefghijk") == "k-a-i9-$0-a"
    assert split(compiled("(-)|,"), "a-b,c") == ["a", "-", "b", None, "c"] and split(compiled(""), "abc") == ["a", "b", "c"]
    assert split(compiled("b"), "") == [""] and split(compiled(""), "") == [] and split(compiled(","), ",a,") == ["", "a", ""]


def test_columns(spark):
    rows = [("aé12", r"(\d)(x)?", "", 1000), ("none", r"\d", "", 1000), ("a" * 40 + "!", "(a+)+$", "", 1000), ("a", "(", "", 1000), (None, "a", "", 1000), ("a", "a", "q", 1000)]
    df = spark.createDataFrame(rows, "t string, p string, f string, n int")
    got = [r["m"] and r["m"].asDict() for r in df.select(patterns.regex_exec("t", "p", "f", "n").alias("m")).collect()]
    assert got[0] == {"start": 3, "end": 4, "matched": "1", "groups": ["1", None], "error": None}
    assert got[1]["start"] is None and got[1]["error"] is None and got[2]["error"] == "out of fuel" and got[3]["error"] == "unclosed group" and got[4] is None and got[5]["error"].startswith("bad flags")
    one = df.limit(1).select(patterns.regex_match("t", F.lit("[a-z0-9]"), F.lit("g"), "n")["found"].alias("all"), patterns.regex_replace("t", F.lit("[0-9]"), F.lit("g"), F.lit("<$&>"), "n")["text"].alias("r"), patterns.regex_split("t", F.lit("é"), F.lit(""), "n")["parts"].alias("s")).first()
    assert (one["all"], one["r"], one["s"]) == (["a", "1", "2"], "aé<1><2>", ["a", "12"])
