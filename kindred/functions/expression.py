"""A small expression language over item columns, compiled to Catalyst columns.

Grammar, weakest first: ``c ? a : b``, ``||``, ``&&``, ``== !=``, ``< <= > >=``, ``+ -``, ``* / %``, unary ``! -``, then members, calls
and indexes; literals are numbers, "strings", true, false and null. Null follows SQL: a comparison with null is null, and a
row is selected only where the whole expression is true. Division by zero gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<num>\d+(?:\.\d+)?)[mMdDfFlL]?|@"(?P<raw>(?:[^"]|"")*)"|"(?P<str>(?:\\.|[^"\\])*)"|\'(?P<chr>(?:\\.|[^\'\\])*)\'|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:().,\[\]]))')


class ExpressionError(ValueError):
    """What is wrong with an expression."""


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; kinds are num, str, id and op."""
    if not source.strip():
        raise ExpressionError("the expression is empty")
    if re.search(r"(?<![=!<>])=(?!=)", re.sub(r'@"(?:[^"]|"")*"|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', "", source)):
        raise ExpressionError("assignment is not allowed")
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise ExpressionError(f"unexpected character at {at}: {source[at:at + 10]!r}")
        kind = m.lastgroup
        text = m[kind]
        if kind == "raw":
            text = text.replace('""', '"')
        elif kind in ("str", "chr"):
            text = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text)
        out.append(("str" if kind in ("raw", "chr") else kind, text))
        at = m.end()
    return out


class Value:
    """A column with the type that decides what operators do: num, str, bool, list, time, span or null."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind


_BINARY = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


class _Parser:
    def __init__(self, source: str, names: dict[str, Value]):
        self.t, self.at, self.names = tokens(source), 0, names

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.t) and self.t[self.at][0] == "op" and self.t[self.at][1] in ops

    def take(self, op: str) -> None:
        if not self.peek(op):
            raise ExpressionError(f"{op!r} expected")
        self.at += 1

    def whole(self) -> Value:
        v = self.ternary()
        if self.at < len(self.t):
            raise ExpressionError(f"unexpected {self.t[self.at][1]!r}")
        return v

    def ternary(self) -> Value:
        test = self.binary(0)
        if not self.peek("?"):
            return test
        self.at += 1
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        return Value(F.when(test.column, yes.column).otherwise(no.column), yes.kind if yes.kind != "null" else no.kind)

    def binary(self, level: int) -> Value:
        if level == len(_BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*_BINARY[level]):
            op = self.t[self.at][1]
            self.at += 1
            left = _apply(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Value:
        if self.peek("!", "-"):
            op = self.t[self.at][1]
            self.at += 1
            v = self.unary()
            return Value(~v.column, "bool") if op == "!" else Value(-v.column, "num")
        return self.postfix(self.primary())

    def primary(self) -> Value:
        if self.at >= len(self.t):
            raise ExpressionError("the expression ends too early")
        kind, text = self.t[self.at]
        self.at += 1
        if kind == "num":
            return Value(F.lit(float(text) if "." in text else int(text)), "num")
        if kind == "str":
            return Value(F.lit(text), "str")
        if kind == "op":
            if text != "(":
                raise ExpressionError(f"unexpected {text!r}")
            v = self.ternary()
            self.take(")")
            return v
        if text in ("true", "false"):
            return Value(F.lit(text == "true"), "bool")
        if text == "null":
            return Value(F.lit(None), "null")
        if text in _STATIC and self.peek("."):
            self.at += 1
            name = self.t[self.at][1]
            self.at += 1
            found = _STATIC[text].get(name)
            if found is None:
                raise ExpressionError(f"unknown function {text}.{name}")
            return found(*self.arguments())
        if text == "item" and self.peek("."):
            self.at += 1
            text = self.t[self.at][1]
            self.at += 1
        if text not in self.names:
            raise ExpressionError(f"unknown name {text!r}")
        return self.names[text]

    def arguments(self) -> list[Value]:
        self.take("(")
        out = []
        while not self.peek(")"):
            if out:
                self.take(",")
            out.append(self.ternary())
        self.take(")")
        return out

    def postfix(self, v: Value) -> Value:
        while self.peek(".", "["):
            if self.peek("["):
                self.at += 1
                i = self.ternary()
                self.take("]")
                v = Value(F.get(v.column, i.column.cast("int")), "str")
                continue
            self.at += 1
            if self.at >= len(self.t) or self.t[self.at][0] != "id":
                raise ExpressionError("a member's name expected")
            name = self.t[self.at][1]
            self.at += 1
            args = self.arguments() if self.peek("(") else None
            found = _MEMBERS.get((v.kind, name))
            if found is None:
                raise ExpressionError(f"unknown member {name!r}")
            v = found(v, *(args or []))
        return v


def _text(v: Value) -> Column:
    return v.column.cast("string")


def _apply(op: str, a: Value, b: Value) -> Value:
    x, y = a.column, b.column
    if op in ("||", "&&"):
        return Value(x | y if op == "||" else x & y, "bool")
    if op in ("==", "!="):
        same = y.isNull() if a.kind == "null" else x.isNull() if b.kind == "null" else x == y
        return Value(same if op == "==" else ~same, "bool")
    if op in ("<", "<=", ">", ">="):
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
    if op == "+" and "str" in (a.kind, b.kind):
        return Value(F.concat(_text(a), _text(b)), "str")
    x, y = x.cast("double"), y.cast("double")
    if op == "/":
        return Value(F.try_divide(x, y), "num")
    if op == "%":
        return Value(F.when(y != 0, x % y), "num")
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], "num")


def _contains(v: Value, part: Value, any_case: Value | None = None) -> Value:
    return Value(F.contains(F.lower(v.column), F.lower(part.column)) if any_case is not None else F.contains(v.column, part.column), "bool")


def _cut(v: Value, begin: Value, length: Value | None = None) -> Value:
    n = length.column.cast("int") if length is not None else F.length(v.column)
    return Value(F.substring(v.column, begin.column.cast("int") + 1, n), "str")


def _num(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *v: Value(f(*(x.column for x in v)), "num")


def _str(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *v: Value(f(*(x.column for x in v)), "str")


def _bool(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *v: Value(f(*(x.column for x in v)), "bool")


def _span(seconds: float) -> Callable[..., Value]:
    return lambda v: Value(v.column.cast("double") * seconds, "span")


def _pattern(p: Column) -> Column:
    """A pattern without a leading (?i), which the domain drops and does not apply."""
    return F.regexp_replace(p, r"^\(\?i\)", "")


def _half_up(x: Column, digits: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), digits) if digits is not None else F.lit(1.0)
    return F.floor(x * scale + 0.5) / scale


_MEMBERS: dict[tuple[str, str], Callable[..., Value]] = {
    ("str", "Contains"): _contains,
    ("str", "StartsWith"): _bool(F.startswith),
    ("str", "EndsWith"): _bool(F.endswith),
    ("str", "ToLower"): _str(F.lower),
    ("str", "ToUpper"): _str(F.upper),
    ("str", "ToLowerInvariant"): _str(F.lower),
    ("str", "ToUpperInvariant"): _str(F.upper),
    ("str", "Trim"): _str(F.trim),
    ("str", "IndexOf"): _num(lambda s, x: F.position(x, s) - 1),
    ("str", "Substring"): _cut,
    ("str", "Replace"): _str(F.replace),
    ("str", "Equals"): _bool(lambda a, b: a == b),
    ("str", "Length"): _num(F.length),
    ("list", "Contains"): _bool(lambda a, x: F.exists(a, lambda e: F.lower(e) == F.lower(x))),
    ("list", "Any"): _bool(lambda a: F.size(a) > 0),
    ("list", "Count"): _num(F.size),
    ("list", "Length"): _num(F.size),
    ("time", "Year"): _num(F.year),
    ("time", "Month"): _num(F.month),
    ("time", "Day"): _num(F.dayofmonth),
    ("time", "Hour"): _num(F.hour),
    ("time", "Minute"): _num(F.minute),
    ("time", "Second"): _num(F.second),
    ("time", "DayOfYear"): _num(F.dayofyear),
    ("span", "TotalSeconds"): _num(lambda s: s),
    ("span", "TotalMinutes"): _num(lambda s: s / 60),
    ("span", "TotalHours"): _num(lambda s: s / 3600),
    ("span", "TotalDays"): _num(lambda s: s / 86400),
    ("span", "TotalMilliseconds"): _num(lambda s: s * 1000),
    ("span", "Days"): _num(lambda s: F.floor(s / 86400)),
    ("span", "Hours"): _num(lambda s: F.floor(s / 3600) % 24),
    ("span", "Minutes"): _num(lambda s: F.floor(s / 60) % 60),
    ("span", "Seconds"): _num(lambda s: F.floor(s) % 60),
    ("span", "Milliseconds"): _num(lambda s: F.floor(s * 1000 + 0.5) % 1000),
    ("time", "Ticks"): _num(lambda t: F.unix_millis(t.cast("timestamp")) * 10000),
    ("match", "Success"): _bool(lambda m: m.isNotNull()),
    ("match", "Value"): _str(lambda m: F.coalesce(m, F.lit(""))),
}
_STATIC: dict[str, dict[str, Callable[..., Value]]] = {
    "Math": {
        "Abs": _num(F.abs),
        "Min": _num(F.least),
        "Max": _num(F.greatest),
        "Round": _num(_half_up),
        "Floor": _num(F.floor),
        "Ceiling": _num(F.ceil),
        "Pow": _num(F.pow),
        "Sqrt": _num(F.sqrt),
    },
    "Regex": {"IsMatch": _bool(lambda s, p: F.regexp(s, _pattern(p))), "Match": lambda s, p: Value(F.regexp_substr(s.column, _pattern(p.column)), "match")},
    "TimeSpan": {"FromSeconds": _span(1), "FromMinutes": _span(60), "FromHours": _span(3600)},
    "string": {
        "IsNullOrEmpty": _bool(lambda s: F.coalesce(s, F.lit("")) == ""),
        "IsNullOrWhiteSpace": _bool(lambda s: F.trim(F.coalesce(s, F.lit(""))) == ""),
    },
}
_KINDS = {"string": "str", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}


#: The properties of an item and what columns hold them.
ITEM_PROPERTIES = {
    "Id": "id", "GroupId": "group_id", "Path": "path", "Name": "name", "Extension": "ext", "Folder": "folder", "Folders": "folders", "Tags": "tags", "Rating": "star", "Annotation": "annotation", "Url": "url",
    "Size": "size", "SizeLong": "size", "Similarity": "similarity", "Difference": "difference", "Duration": "duration", "FrameSize": "frame_size", "FrameSizeInt": "frame_size_int", "Format": "format",
    "AudioFormat": "audio_format", "AudioChannel": "audio_channels", "AudioSampleRate": "audio_sample_rate", "AudioBitRateKbs": "audio_bit_rate", "AudioLanguages": "audio_languages", "SubtitleLanguages": "subtitle_languages",
    "BitRateKbs": "bit_rate", "Fps": "fps", "HdrFormat": "hdr", "DateCreated": "created", "DateModified": "modified", "ImportedAt": "imported", "IsImage": "is_image",
    "IsBestDuration": "is_best_duration", "IsBestSize": "is_best_size", "IsBestFps": "is_best_fps", "IsBestBitRateKbs": "is_best_bit_rate", "IsBestAudioSampleRate": "is_best_audio_sample_rate",
    "IsBestAudioBitRateKbs": "is_best_audio_bit_rate", "IsBestHdrFormat": "is_best_hdr", "IsBestFrameSize": "is_best_frame_size", "Flags": "flags", "PartialClipOffset": "partial_offset", "IsMissing": "missing", "IsDeletedContent": "tombstone",
}
#: Properties that are bits of the flags.
FLAG_PROPERTIES = {"IsFlipped": 1, "IsPartialClip": 2, "IsAiMatched": 4}


def item_names(dtypes: list[tuple[str, str]]) -> dict[str, Value]:
    """The item's properties over a result table's columns; durations and clip offsets are time spans."""
    known = names_of(dtypes)
    out = {p: known[c] for p, c in ITEM_PROPERTIES.items() if c in known}
    for p in ("Duration", "PartialClipOffset"):
        if p in out:
            out[p] = Value(out[p].column, "span")
    if "flags" in known:
        out |= {p: Value(F.col("flags").bitwiseAND(F.lit(b)) != 0, "bool") for p, b in FLAG_PROPERTIES.items()}
    return out


def names_of(dtypes: list[tuple[str, str]], prefix: str = "") -> dict[str, Value]:
    """The names an expression may use, from a DataFrame's columns, in CamelCase too."""
    out = {}
    for name, kind in dtypes:
        v = Value(F.col(prefix + name), _KINDS.get(kind, "list" if kind.startswith("array") else "num"))
        out[name] = out["".join(p.capitalize() for p in name.split("_"))] = v
    return out


def compile_expression(source: str, dtypes: list[tuple[str, str]], item: bool = False) -> Column:
    """The expression as a boolean column over a DataFrame's columns (``item``: over the properties of a result's items); null counts as false."""
    v = _Parser(source, item_names(dtypes) if item else names_of(dtypes)).whole()
    if v.kind != "bool":
        raise ExpressionError("the expression is not a condition")
    return F.coalesce(v.column, F.lit(False))
