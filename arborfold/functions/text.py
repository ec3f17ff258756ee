"""Small text forms as columns: sizes, numbers, base64, styles, class lists, places of an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import DEFAULT_PORTS

SPACES = r"[ \t\n\r\f]+"


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one digit, by whole numbers: ties go to the even digit."""
    ten, one = n.cast("long") * 10, F.lit(unit).cast("long")
    whole, rest = F.call_function("div", ten, one), ten % one
    up = (rest * 2 > one) | ((rest * 2 == one) & (whole % 2 == 1))
    tenths = whole + up.cast("long")
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    """Bytes below 1,024, then KB and MB with one digit; ties go to the even digit."""
    kb = F.concat(_tenths(n, 1 << 10), F.lit(" KB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(F.concat(_tenths(n, 1 << 20), F.lit(" MB")))


def format_count(n: Column) -> Column:
    """Digits in threes."""
    return F.format_number(n, 0)


def format_ms(ms: Column) -> Column:
    """Whole milliseconds; ties go to the even number."""
    return F.concat(F.bround(ms.cast("double"), 0).cast("decimal(30,0)").cast("string"), F.lit("ms"))


def to_base64(data: Column) -> Column:
    """Bytes as text, on one line; text counts as its UTF-8 bytes."""
    return F.regexp_replace(F.base64(data.cast("binary")), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """The bytes of such a text, white space aside; null for what is none. Missing padding is made up for."""
    bare = F.regexp_replace(F.regexp_replace(text, "[ \t\n\f\r]", ""), "={1,2}$", "")
    full = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    good = bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1)
    return F.when(good, F.unbase64(full))


def location(u: Column) -> Column:
    """The parts of ``url_parts`` as a script's location names them."""
    known = F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv))
    bare = F.when(u["host"].contains(":"), F.concat(F.lit("["), u["host"], F.lit("]"))).otherwise(u["host"])
    port = F.when(u["port"].isNull() | u["port"].eqNullSafe(F.try_element_at(known, u["scheme"])), "").otherwise(u["port"].cast("string"))
    host = F.when(port == "", bare).otherwise(F.concat(bare, F.lit(":"), port))
    protocol = F.concat(u["scheme"], F.lit(":"))
    marked = lambda mark, part: F.when(F.coalesce(part, F.lit("")) == "", "").otherwise(F.concat(F.lit(mark), part))
    parts = {"protocol": protocol, "host": host, "hostname": bare, "port": port, "pathname": u["path"], "search": marked("?", u["query"]), "hash": marked("#", u["fragment"]), "origin": F.concat(protocol, F.lit("//"), host)}
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def authority(u: Column) -> Column:
    """Host and port as a request names them: the default port is left out."""
    return location(u)["host"]


def request_target(u: Column) -> Column:
    return F.concat(u["path"], F.when(u["query"].isNull(), "").otherwise(F.concat(F.lit("?"), u["query"])))


def style_pairs(style: Column) -> Column:
    """The declarations of a style attribute: (name, value) in order, names in lower case but for custom ones."""
    parts = F.filter(F.split(style, ";"), lambda d: d.contains(":"))
    name = lambda d: F.trim(F.regexp_extract(d, "^([^:]*)", 1))
    lower = lambda d: F.when(name(d).startswith("--"), name(d)).otherwise(F.lower(name(d)))
    pairs = F.transform(parts, lambda d: F.struct(lower(d).alias("name"), F.trim(F.regexp_extract(d, "(?s)^[^:]*:(.*)$", 1)).alias("value")))
    return F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != ""))


def style_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit(": "), p["value"], F.lit(";"))), " ")


def style_set(pairs: Column, name: str, value: str) -> Column:
    """A declaration set at its place or at the end; an empty value removes it."""
    if not value:
        return F.filter(pairs, lambda p: p["name"] != name)
    new = F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    there = F.exists(pairs, lambda p: p["name"] == name)
    return F.when(there, F.transform(pairs, lambda p: F.when(p["name"] == name, new).otherwise(p))).otherwise(F.concat(pairs, F.array(new)))


#: What styles are where an element says nothing of its own.
STYLE_DEFAULTS = [
    ("background-color", "rgba(0, 0, 0, 0)"), ("color", "rgb(0, 0, 0)"), ("font-family", "Arial"), ("font-size", "16px"), ("font-weight", "400"), ("visibility", "visible"),
    ("position", "static"), ("display", "block"), ("opacity", "1"), ("transition-duration", "0s"), ("transition-delay", "0s"),
]


def computed_style(style: Column) -> Column:
    """The declarations that hold for an element with this style attribute: its own, without their priority, then the
    defaults of those it lacks; a font's last word is its family. Null is no style. Sheets are not looked at."""
    plain = lambda v: F.trim(F.regexp_replace(v, "(?i)!important.*$", ""))
    own = F.transform(style_pairs(F.coalesce(style, F.lit(""))), lambda p: F.struct(p["name"].alias("name"), plain(p["value"]).alias("value")))
    font = F.try_element_at(F.filter(own, lambda p: p["name"] == "font"), F.lit(-1))["value"]
    family = F.translate(F.regexp_extract(font, r"(\S+)\s*$", 1), "\"'", "")
    known = F.array(*(F.struct(F.lit(k).alias("name"), (F.coalesce(family, F.lit(v)) if k == "font-family" else F.lit(v)).alias("value")) for k, v in STYLE_DEFAULTS))
    return F.concat(own, F.filter(known, lambda d: ~F.exists(own, lambda p: p["name"] == d["name"])))


def style_value(pairs: Column, name: str) -> Column:
    """A property's value, by its kebab or camel name; empty where there is none."""
    key = name if name.startswith("--") else "".join(f"-{c.lower()}" if c.isupper() else c for c in name)
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["name"] == key), F.lit(0))["value"], F.lit(""))


def camel(name: Column) -> Column:
    """A style's name as a script writes it; custom names stay."""
    words = F.split(name, "-")
    up = F.transform(words, lambda w, k: F.when((k == 0) | (w == ""), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))))
    return F.when(name.startswith("--"), name).otherwise(F.array_join(up, ""))


def kebab(name: Column) -> Column:
    return F.when(name.startswith("--"), name).otherwise(F.lower(F.regexp_replace(name, "([A-Z])", "-$1")))


def class_tokens(value: Column) -> Column:
    """The tokens of a class attribute, each once."""
    return F.array_distinct(F.filter(F.split(F.coalesce(value, F.lit("")), SPACES), lambda t: t != ""))


def _token(name: str) -> str:
    if not name or any(c in " \t\n\r\f" for c in name):
        raise ValueError(f"no class token: {name!r}")
    return name


def class_add(value: Column, *names: str) -> Column:
    return F.array_join(F.array_union(class_tokens(value), F.array(*(F.lit(_token(n)) for n in names))), " ")


def class_remove(value: Column, *names: str) -> Column:
    return F.array_join(F.array_except(class_tokens(value), F.array(*(F.lit(_token(n)) for n in names))), " ")


def class_toggle(value: Column, name: str, force: bool | None = None) -> Column:
    there = F.array_contains(class_tokens(value), _token(name))
    add = ~there if force is None else F.lit(force)
    return F.when(add, class_add(value, name)).otherwise(class_remove(value, name))


def class_contains(value: Column, name: str) -> Column:
    return F.array_contains(class_tokens(value), name)


def class_replace(value: Column, old: str, new: str) -> Column:
    """The token in the other's place; nothing where it is absent."""
    tokens = F.transform(class_tokens(value), lambda t: F.when(t == _token(old), _token(new)).otherwise(t))
    return F.array_join(F.array_distinct(tokens), " ")
