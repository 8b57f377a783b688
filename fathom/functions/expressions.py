"""A small typed expression language, compiled to Catalyst columns.

``compile_expression("round(${price} * 1.19, 2)", df.schema)`` returns a Column; nothing is evaluated in Python, so expressions
are folded, pruned and pushed down like any other. Arithmetic gives doubles, text + text concatenates, AND and OR follow
three-valued logic, and domain errors give null.

Syntax: ``${field}``, ``${param.name}``, numbers, "text" (escapes \\n \\t \\" \\\\), true, false, null, ``f(a, b)``, ``a |> f(b)`` for
``f(a, b)``, unary - and !, and, loosest first, |> || && comparisons + - * / %.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.rng import Rng


class ExpressionError(ValueError):
    """A text that is no expression, or a call with wrong arguments."""


# --- parsing

_TOKENS = re.compile(r"\s*(?:(?P<field>\$\{[^}]*\})|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<text>\"(?:[^\"\\]|\\.)*\")|(?P<op>\|>|\|\||&&|==|!=|<=|>=|[-+*/%<>!(),])|(?P<name>[A-Za-z_]\w*))")
_BINDING = {"|>": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_ESCAPES = {"n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Node:
    """kind: number, text, bool, null, field, call, unary or binary; value: literal, name or operator."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 12]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("unexpected end")
        token = self.tokens[self.at]
        if wanted and token != ("op", wanted):
            raise ExpressionError(f"expected {wanted!r}, found {token[1]!r}")
        self.at += 1
        return token

    def expression(self, least: int = 0) -> Node:
        left = self.operand()
        while (op := self.peek()) in _BINDING and _BINDING[op] > least:
            self.take()
            right = self.expression(_BINDING[op])
            if op == "|>":
                if right.kind != "call":
                    raise ExpressionError("|> needs a function call on its right")
                left = Node("call", right.value, (left, *right.args))
            else:
                left = Node("binary", op, (left, right))
        return left

    def operand(self) -> Node:
        kind, text = self.take()
        if kind == "number":
            return Node("number", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "text":
            return Node("text", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        if kind == "field":
            return Node("field", text[2:-1].strip())
        if kind == "name":
            if text in ("true", "false"):
                return Node("bool", text == "true")
            if text == "null":
                return Node("null")
            self.take("(")
            args = []
            if self.peek() != ")":
                args.append(self.expression())
                while self.peek() == ",":
                    self.take()
                    args.append(self.expression())
            self.take(")")
            return Node("call", text, tuple(args))
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if text in ("-", "!"):
            return Node("unary", text, (self.expression(6),))
        raise ExpressionError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.expression()
    if parser.at < len(parser.tokens):
        raise ExpressionError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return node


def fields_of(node: Node) -> set[str]:
    """Fields an expression reads, without parameters."""
    own = {node.value} if node.kind == "field" and not str(node.value).startswith("param.") else set()
    return own.union(*(fields_of(a) for a in node.args)) if node.args else own


def is_template(text: str) -> bool:
    """Whether a text is a template such as ``${a}@${b}`` rather than an expression."""
    if "${" not in text:
        return False
    try:
        parse(text)
    except ExpressionError:
        return True
    return False


# --- typed columns

INT, FLOAT, BOOL, TEXT, DATE, TIME, DURATION, NULL = "int", "float", "bool", "text", "date", "timestamp", "duration", "null"


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    literal: object = None


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, T.IntegralType):
        return INT
    if isinstance(dtype, T.NumericType):
        return FLOAT
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIME
    return TEXT


def _num(x: Typed) -> Column:
    if x.kind in (TIME, DATE):
        return F.unix_millis(_ts(x)).cast("double")
    return x.column.cast("double")


def _long(x: Typed) -> Column:
    return x.column.cast("long") if x.kind in (INT, DURATION, NULL) else F.try_to_number(x.column, F.lit("S999999999999999999")).cast("long") if x.kind == TEXT else _trunc(x.column)


def _trunc(x: Column) -> Column:
    """A double towards zero as a long, at most the range of longs; NaN gives null."""
    x = x.cast("double")
    inside = F.greatest(F.lit(-9.223372036854775e18), F.least(F.lit(9.223372036854775e18), x))
    return F.when(F.isnan(x), None).when(x >= 9.223372036854775e18, F.lit(2**63 - 1)).when(x <= -9.223372036854775e18, F.lit(-(2**63))).otherwise(inside.cast("long"))


def _ts(x: Typed) -> Column:
    """A timestamp of whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(x.column.cast("timestamp"))) if x.kind == TIME else x.column.cast("timestamp")


def number_text(x: Column) -> Column:
    """A double as text without exponent and without ".0"."""
    plain = x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x), "NaN").when(x == math.inf, "inf").when(x == -math.inf, "-inf").when(whole, x.cast("long").cast("string")).when(plain.contains("E") & (F.abs(x) < 1e20), wide).when((F.abs(x) >= 1e15) & (F.abs(x) < 1e37), x.try_cast("decimal(38,0)").cast("string")).otherwise(plain)


def _text(x: Typed) -> Column:
    if x.kind == FLOAT:
        return number_text(x.column.cast("double"))
    if x.kind == TIME:
        return F.date_format(_ts(x), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return x.column.cast("string")


def finite(x: Column) -> Column:
    """Null for NaN and infinite values."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def round_half_away(x: Column, digits: Column | int) -> Column:
    """Half away from zero of x*10^d in binary floating point, as plain double arithmetic does it."""
    scale = F.pow(F.lit(10.0), F.lit(digits) if isinstance(digits, int) else digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


# --- dates

#: strftime fields and Java date patterns: fixed values.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
_MILLIS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: Lengths that durations give to calendar units, in days.
_DAYS = {"month": 30, "quarter": 91, "year": 365}


def java_pattern(strftime: str) -> str:
    out, literal, i = "", "", 0

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]#{}]", literal) else literal

    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            code = strftime[i + 1]
            if code == "%":
                literal += "%"
                i += 2
                continue
            if strftime[i + 1 : i + 3] == "3f":
                field, i = "SSS", i + 3
            elif code in _STRFTIME:
                field, i = _STRFTIME[code], i + 2
            else:
                raise ExpressionError(f"unknown date field %{code}")
            out, literal = out + flush() + field, ""
        else:
            literal += c
            i += 1
    return out + flush()


def _unit(x: Typed) -> str:
    if not isinstance(x.literal, str):
        raise ExpressionError("a unit must be a literal text")
    u = x.literal.lower().rstrip("s")
    return {"m": "millisecond", "ms": "millisecond", "milli": "millisecond", "min": "minute", "sec": "second", "hr": "hour"}.get(u, u)


def _shift(ts: Column, n: Column, unit: str) -> Column:
    if unit in _MILLIS:
        return F.timestamp_millis(F.unix_millis(ts) + n * _MILLIS[unit])
    if unit in _MONTHS:
        day = F.add_months(F.to_date(ts), (n * _MONTHS[unit]).cast("int"))
        return F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + (F.unix_millis(ts) - F.unix_millis(F.date_trunc("day", ts))))
    return F.lit(None).cast("timestamp")


def _start_of(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts) if unit in _MILLIS or unit in _MONTHS else F.lit(None).cast("timestamp")


def _date_diff(a: Typed, b: Typed, unit: str) -> Column:
    x, y = _ts(a), _ts(b)
    if unit in _MILLIS:
        return ((F.unix_millis(x) - F.unix_millis(y)) / F.lit(_MILLIS[unit])).cast("long")
    months = (F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y)
    if unit == "month":
        return months.cast("long")
    if unit == "year":
        return (F.year(x) - F.year(y)).cast("long")
    if unit == "quarter":
        return ((F.year(x) - F.year(y)) * 4 + F.quarter(x) - F.quarter(y)).cast("long")
    return F.lit(None).cast("long")


def _format_duration(ms: Column, style: str) -> Column:
    sign, n = F.when(ms < 0, "-").otherwise(""), F.abs(ms)
    part = lambda unit, size: F.pmod(F.floor(n / _MILLIS[unit]), F.lit(size)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    days, hours = F.floor(n / _MILLIS["day"]).cast("long"), F.floor(n / _MILLIS["hour"]).cast("long")
    if style == "hms":
        return F.concat(sign, F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(part("minute", 60)), F.lit(":"), two(part("second", 60)))
    shown = [(days, "d"), (part("hour", 24), "h"), (part("minute", 60), "m"), (part("second", 60), "s")]
    if style == "human":
        words = F.array_join(F.array_compact(F.array(*[F.when(c > 0, F.concat(c.cast("string"), F.lit(u))) for c, u in shown])), " ")
        return F.when(F.floor(n / 1000) == 0, "0s").otherwise(F.concat(sign, words))
    if style == "iso":
        day = F.when(days > 0, F.concat(days.cast("string"), F.lit("D"))).otherwise("")
        clock = F.concat(*[F.when(c > 0, F.concat(c.cast("string"), F.lit(u.upper()))).otherwise("") for c, u in shown[1:]])
        return F.when(F.floor(n / 1000) == 0, "PT0S").otherwise(F.concat(sign, F.lit("P"), day, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise("")))
    return F.lit(None).cast("string")


def _zone(x: Typed) -> str | None:
    from zoneinfo import ZoneInfo

    try:
        return str(ZoneInfo(str(x.literal))) if isinstance(x.literal, str) else None
    except (KeyError, ValueError, OSError):
        return None


# --- functions

Maker = Callable[["_Compiler", list[Typed]], Typed]
FUNCTIONS: dict[str, tuple[int, int, Maker]] = {}


def _define(name: str, least: int, most: int, make: Maker) -> None:
    FUNCTIONS[name] = (least, most, make)


def _simple(name: str, args: int, kind: str, make: Callable[..., Column], as_: Callable[[Typed], Column] = _num) -> None:
    _define(name, args, args, lambda c, a: Typed(make(*[as_(x) for x in a]), kind))


def _common(values: list[Typed]) -> tuple[list[Column], str]:
    """Columns of one kind: int and float promote to float, nulls follow the others."""
    kinds = {v.kind for v in values} - {NULL}
    if not kinds:
        return [v.column.cast("string") for v in values], NULL
    if len(kinds) == 1:
        kind = kinds.pop()
        cast = {INT: "long", FLOAT: "double", BOOL: "boolean", TEXT: "string", DATE: "date", TIME: "timestamp", DURATION: "long"}[kind]
        return [v.column.cast(cast) for v in values], kind
    if kinds <= {INT, FLOAT, DURATION}:
        return [v.column.cast("double") for v in values], FLOAT
    if kinds <= {DATE, TIME}:
        return [_ts(v) if v.kind != NULL else v.column.cast("timestamp") for v in values], TIME
    return [_text(v) for v in values], TEXT


_define("abs", 1, 1, lambda c, a: Typed(F.abs(a[0].column), a[0].kind) if a[0].kind == INT else Typed(F.abs(_num(a[0])), FLOAT))
_simple("ceil", 1, FLOAT, lambda x: F.ceil(x).cast("double"))
_simple("floor", 1, FLOAT, lambda x: F.floor(x).cast("double"))
_define("round", 1, 2, lambda c, a: Typed(round_half_away(_num(a[0]), _num(a[1]) if len(a) > 1 else 0), FLOAT))
_simple("min", 2, FLOAT, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)))
_simple("max", 2, FLOAT, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)))
_simple("clamp", 3, FLOAT, lambda x, lo, hi: F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.greatest(F.least(x, hi), lo)))
_simple("sqrt", 1, FLOAT, lambda x: F.when(x >= 0, F.sqrt(x)))
_simple("pow", 2, FLOAT, lambda x, y: finite(F.pow(x, y)))
_simple("ln", 1, FLOAT, lambda x: F.when(x > 0, F.ln(x)))
_simple("log", 2, FLOAT, lambda x, b: F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b)))
_simple("exp", 1, FLOAT, lambda x: finite(F.exp(x)))
_simple("upper", 1, TEXT, F.upper, _text)
_simple("lower", 1, TEXT, F.lower, _text)
_simple("trim", 1, TEXT, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), _text)
_simple("len", 1, INT, lambda s: F.char_length(s).cast("long"), _text)
_define("concat", 2, 16, lambda c, a: Typed(F.concat(*[_text(x) for x in a]), TEXT))
_define("substr", 2, 3, lambda c, a: Typed(_substr(_text(a[0]), _long(a[1]), _long(a[2]) if len(a) > 2 else None), TEXT))
_define("replace", 3, 3, lambda c, a: Typed(_replace(*[_text(x) for x in a]), TEXT))
_simple("starts_with", 2, BOOL, lambda s, p: s.startswith(p), _text)
_simple("ends_with", 2, BOOL, lambda s, p: s.endswith(p), _text)
_simple("contains", 2, BOOL, lambda s, p: s.contains(p), _text)
_define("left", 2, 2, lambda c, a: Typed(F.left(_text(a[0]), F.greatest(F.lit(0), _long(a[1])).cast("int")), TEXT))
_define("right", 2, 2, lambda c, a: Typed(F.right(_text(a[0]), F.greatest(F.lit(0), _long(a[1])).cast("int")), TEXT))
_define("pad_left", 3, 3, lambda c, a: Typed(_pad(F.lpad, *a), TEXT))
_define("pad_right", 3, 3, lambda c, a: Typed(_pad(F.rpad, *a), TEXT))
_define("cast_int", 1, 1, lambda c, a: Typed(_cast_int(a[0]), INT))
_define("cast_float", 1, 1, lambda c, a: _cast_float(a[0]))
_define("cast_string", 1, 1, lambda c, a: Typed(_text(a[0]), TEXT))
_define("if", 3, 3, lambda c, a: _case([(a[0], a[1])], a[2]))
_define("case", 2, 32, lambda c, a: _case(list(zip(a[0 : len(a) - len(a) % 2 : 2], a[1::2], strict=False)), a[-1] if len(a) % 2 else None))
_define("coalesce", 2, 16, lambda c, a: (lambda cols, kind: Typed(F.coalesce(*cols), kind))(*_common(a)))
_define("nullif", 2, 2, lambda c, a: (lambda cols, kind: Typed(F.nullif(*cols), kind))(*_common(a)))
_define("hash", 1, 1, lambda c, a: Typed(F.xxhash64(_text(a[0])), INT))
_define("row_number", 0, 0, lambda c, a: Typed(c.row().cast("long"), INT))
_define("make_date", 3, 3, lambda c, a: Typed(F.try_to_date(F.format_string("%04d-%02d-%02d", *[_long(x) for x in a]), "yyyy-MM-dd"), DATE))
_define("make_time", 3, 3, lambda c, a: Typed(_clock(*[_long(x) for x in a]), DURATION))
_define("make_datetime", 6, 6, lambda c, a: Typed(F.try_make_timestamp(*[_long(x).cast("int") for x in a]), TIME))
_define("make_duration", 2, 2, lambda c, a: Typed(_duration(a[0], _unit(a[1])), DURATION))
_define("to_date", 2, 2, lambda c, a: Typed(F.try_to_timestamp(_text(a[0]), F.lit(java_pattern(str(a[1].literal)))).cast("date"), DATE))
_define("to_datetime", 2, 2, lambda c, a: Typed(F.try_to_timestamp(_text(a[0]), F.lit(java_pattern(str(a[1].literal)))), TIME))
_define("epoch_seconds", 1, 1, lambda c, a: Typed(F.unix_millis(_ts(a[0])) / 1000.0, FLOAT))
_define("from_epoch", 1, 1, lambda c, a: Typed(F.timestamp_millis((_num(a[0]) * 1000).cast("long")), TIME))
for _name, _f in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "day_of_week": F.weekday, "day_of_year": F.dayofyear, "week_of_year": F.weekofyear, "quarter": F.quarter}.items():
    _define(_name, 1, 1, lambda c, a, f=_f: Typed(f(_ts(a[0])).cast("long"), INT))
_define("date_add", 3, 3, lambda c, a: Typed(_shift(_ts(a[0]), _long(a[1]), _unit(a[2])), TIME))
_define("date_sub", 3, 3, lambda c, a: Typed(_shift(_ts(a[0]), -_long(a[1]), _unit(a[2])), TIME))
_define("date_diff", 3, 3, lambda c, a: Typed(_date_diff(a[0], a[1], _unit(a[2])), INT))
_define("duration_add", 2, 2, lambda c, a: Typed(_long(a[0]) + _long(a[1]), DURATION))
_define("start_of", 2, 2, lambda c, a: Typed(_start_of(_ts(a[0]), _unit(a[1])), TIME))
_define("end_of", 2, 2, lambda c, a: Typed(_shift(_shift(_start_of(_ts(a[0]), _unit(a[1])), F.lit(1), _unit(a[1])), F.lit(-1), "millisecond"), TIME))
_define("format_date", 2, 2, lambda c, a: Typed(F.date_format(_ts(a[0]), java_pattern(str(a[1].literal))), TEXT))
_define("format_duration", 2, 2, lambda c, a: Typed(_format_duration(_long(a[0]), str(a[1].literal)), TEXT))
_define("to_timezone", 2, 2, lambda c, a: Typed(F.from_utc_timestamp(_ts(a[0]), z) if (z := _zone(a[1])) else F.lit(None).cast("timestamp"), TIME))
_define("timezone_offset", 2, 2, lambda c, a: Typed(_offset(_ts(a[0]), _zone(a[1])), TEXT))
_define("random_int", 2, 2, lambda c, a: Typed((F.floor(c.draw() * (_long(a[1]) - _long(a[0]) + 1)) + _long(a[0])).cast("long"), INT))
_define("random_float", 2, 2, lambda c, a: Typed(_num(a[0]) + c.draw() * (_num(a[1]) - _num(a[0])), FLOAT))
_define("random_duration", 2, 2, lambda c, a: Typed((F.floor(c.draw() * (_long(a[1]) - _long(a[0]) + 1)) + _long(a[0])).cast("long"), DURATION))


def _substr(s: Column, start: Column, size: Column | None) -> Column:
    at = (F.greatest(F.lit(0).cast("long"), start) + 1).cast("int")
    length = F.char_length(s) if size is None else F.greatest(F.lit(0).cast("long"), size).cast("int")
    return F.when(start.isNotNull(), F.substring(s, at, length))


def _replace(s: Column, old: Column, new: Column) -> Column:
    between = F.concat(new, F.array_join(F.transform(F.split(s, ""), lambda ch: F.concat(ch, new)), ""))
    return F.when((old == "") & (s == ""), new).when(old == "", between).otherwise(F.replace(s, old, new))


def _pad(pad: Callable[..., Column], s: Typed, n: Typed, fill: Typed) -> Column:
    text, size, ch = _text(s), _long(n).cast("int"), F.left(_text(fill), F.lit(1))
    return F.when((F.char_length(text) < size) & (ch != ""), pad(text, size, ch)).when(size.isNotNull() & ch.isNotNull(), text)


def _cast_int(x: Typed) -> Column:
    if x.kind == TEXT:
        return F.when(F.trim(x.column).rlike(r"^[+-]?\d{1,19}$"), F.trim(x.column).try_cast("long"))
    if x.kind == BOOL:
        return x.column.cast("int").cast("long")
    if x.kind in (TIME, DATE):
        return F.unix_millis(_ts(x))
    return x.column.cast("long") if x.kind in (INT, DURATION, NULL) else _trunc(x.column)


def _cast_float(x: Typed) -> Typed:
    if x.kind == TEXT:
        raise ExpressionError("cast_float does not take text")
    return Typed(_num(x), FLOAT)


def _case(pairs: list[tuple[Typed, Typed]], default: Typed | None) -> Typed:
    columns, kind = _common([v for _, v in pairs] + ([default] if default else []))
    out = None
    for (cond, _), value in zip(pairs, columns, strict=False):
        test = cond.column.cast("boolean")
        out = F.when(test, value) if out is None else out.when(test, value)
    return Typed(out.otherwise(columns[-1]) if default else out, kind)


def _clock(h: Column, m: Column, s: Column) -> Column:
    return F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), h * 3_600_000 + m * 60_000 + s * 1000)


def _duration(n: Typed, unit: str) -> Column:
    size = _MILLIS.get(unit) or _DAYS.get(unit, 0) * _MILLIS["day"]
    if unit == "microsecond":
        return (_num(n) / 1000).cast("long")
    return (_num(n) * size).cast("long") if size else F.lit(None).cast("long")


def _offset(ts: Column, zone: str | None) -> Column:
    if zone is None:
        return F.lit(None).cast("string")
    minutes = ((F.unix_millis(F.from_utc_timestamp(ts, zone)) - F.unix_millis(ts)) / 60_000).cast("long")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


# --- compilation


class _Compiler:
    def __init__(self, kinds: dict[str, str], params: dict[str, object], row: Column | None, rng: Rng | None):
        self.kinds, self.params, self._row, self.rng, self.draws = kinds, params, row, rng, 0

    def row(self) -> Column:
        if self._row is None:
            raise ExpressionError("this expression needs a row number column")
        return self._row

    def draw(self) -> Column:
        """A uniform column of its own for every call in the text."""
        self.draws += 1
        rng = self.rng or Rng(0, "expression", self.row())
        return rng.uniform("call", self.draws)

    def literal(self, v: object) -> Typed:
        if v is None:
            return Typed(F.lit(None), NULL)
        kind = BOOL if isinstance(v, bool) else INT if isinstance(v, int) else FLOAT if isinstance(v, float) else TEXT
        return Typed(F.lit(v).cast({INT: "long", FLOAT: "double"}.get(kind, "boolean" if kind == BOOL else "string")), kind, v)

    def compile(self, n: Node) -> Typed:
        if n.kind in ("number", "text", "bool", "null"):
            return self.literal(n.value)
        if n.kind == "field":
            name = str(n.value)
            if name.startswith("param."):
                if name[6:] not in self.params:
                    raise ExpressionError(f"unknown parameter {name[6:]}")
                return self.literal(self.params[name[6:]])
            if name not in self.kinds:
                raise ExpressionError(f"unknown field {name}")
            return Typed(F.col(f"`{name}`"), self.kinds[name])
        if n.kind == "unary":
            x = self.compile(n.args[0])
            if n.value == "!":
                return Typed(~x.column.cast("boolean"), BOOL)
            lit = -x.literal if isinstance(x.literal, (int, float)) and not isinstance(x.literal, bool) else None
            return Typed(-x.column, x.kind, lit) if x.kind in (INT, FLOAT, DURATION) else Typed(-_num(x), FLOAT)
        if n.kind == "binary":
            return self.binary(str(n.value), self.compile(n.args[0]), self.compile(n.args[1]))
        name = str(n.value)
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        least, most, make = FUNCTIONS[name]
        if not least <= len(n.args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments")
        return make(self, [self.compile(a) for a in n.args])

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("&&", "||"):
            x, y = a.column.cast("boolean"), b.column.cast("boolean")
            return Typed(x & y if op == "&&" else x | y, BOOL)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if {a.kind, b.kind} & {INT, FLOAT, DURATION} and not {a.kind, b.kind} & {TEXT}:
                x, y = _num(a), _num(b)
            elif {a.kind, b.kind} <= {DATE, TIME}:
                x, y = _ts(a), _ts(b)
            else:
                (x, y), _ = _common([a, b])
            return Typed({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOL)
        if op == "+" and a.kind == b.kind == TEXT:
            return Typed(F.concat(a.column, b.column), TEXT)
        x, y = _num(a), _num(b)
        if op == "%":
            if a.kind == b.kind == INT:
                return Typed(F.try_mod(a.column.cast("long"), b.column.cast("long")), INT)
            return Typed(F.try_mod(x, y), FLOAT)
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op](), FLOAT)


def compile_expression(text: str, schema: T.StructType, params: dict[str, object] | None = None, row: Column | None = None, rng: Rng | None = None) -> Column:
    """The column of an expression over rows of ``schema``. ``row`` is a 0-based row number, for row_number() and random functions."""
    kinds = {f.name: _kind(f.dataType) for f in schema.fields}
    return _Compiler(kinds, params or {}, row, rng).compile(parse(text)).column


def compile_template(text: str, schema: T.StructType) -> Column:
    """``${field}`` placeholders in a text filled in; null if any of them is."""
    kinds = {f.name: _kind(f.dataType) for f in schema.fields}
    parts = re.split(r"(\$\{[^}]*\})", text)
    return F.concat(*[_text(Typed(F.col(f"`{p[2:-1]}`"), kinds[p[2:-1]])) if p.startswith("${") else F.lit(p) for p in parts if p])


def with_expressions(df, expressions: dict[str, str], **options):
    """Add derived columns in the order their dependencies need; a circle of dependencies is an error."""
    from graphlib import TopologicalSorter

    graph = {name: (fields_of(parse(e)) if not is_template(e) else set(re.findall(r"\$\{([^}]*)\}", e))) & expressions.keys() for name, e in expressions.items()}
    for name in TopologicalSorter(graph).static_order():
        e = expressions[name]
        df = df.withColumn(name, compile_template(e, df.schema) if is_template(e) else compile_expression(e, df.schema, **options))
    return df
