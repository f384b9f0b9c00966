"""Boost functions: numbers, fields, dates with date math, and calls of a fixed table of functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.errors import SearchError

#: NOW or a literal time, then rounding and shifts.
MATH = r"(?:NOW|\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?)?Z?)(?:/[A-Z]+|[+-]\d+[A-Z]+)*"
TOKEN = re.compile(rf"\s*(?:(?P<date>{MATH})(?![\w.])|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>[(),]))")
UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
#: Other names of units.
ALIASES = {"DATE": "DAY", "MILLI": "MILLISECOND", "MILLISECOND": "MILLISECOND"}


class Value(NamedTuple):
    column: Column
    kind: str  # number or date


def unit(word: str) -> str:
    name = word.removesuffix("S")
    name = ALIASES.get(name, name)
    if name not in (*UNITS, "MILLISECOND"):
        raise SearchError(f"unknown unit of time {word}")
    return name


def date_math(text: str) -> Column:
    """NOW or a literal time, shifted by +/-n units and cut to /unit, from left to right."""
    text = text.strip()
    m = re.fullmatch(MATH, text)
    if not m:
        raise SearchError(f"not a date: {text}")
    base, steps = re.fullmatch(r"(NOW|\d{4}-\d\d-\d\d(?:T[\d:.]+)?Z?)(.*)", text).groups()
    if base == "NOW":
        out = F.current_timestamp().cast("timestamp_ntz")
    else:
        import datetime as dt

        try:
            out = F.lit(dt.datetime.fromisoformat(base.rstrip("Z"))).cast("timestamp_ntz")
        except ValueError:
            raise SearchError(f"not a date: {text}") from None
    for cut, sign, n, word in re.findall(r"/([A-Z]+)|([+-])(\d+)([A-Z]+)", steps):
        if cut:
            out = F.date_trunc(unit(cut), out).cast("timestamp_ntz")
        else:
            out = out + F.expr(f"interval '{sign}{n}' {unit(word)}")
    return out


def ms(value: Value) -> Column:
    if value.kind != "date":
        raise SearchError("ms takes dates")
    return F.unix_millis(value.column.cast("timestamp")).cast("double")


def numbers(function: Callable[..., Column]) -> Callable[..., Column]:
    def call(*args: Value) -> Column:
        if any(a.kind != "number" for a in args):
            raise SearchError("a date stands where a number is needed; ms gives its milliseconds")
        return function(*(a.column for a in args))

    return call


def elapsed(*args: Value) -> Column:
    """Milliseconds of now, of a date, or from the second date to the first."""
    if not args:
        return ms(Value(F.current_timestamp().cast("timestamp_ntz"), "date"))
    return ms(args[0]) - (ms(args[1]) if len(args) == 2 else F.lit(0.0))


def fold(combine: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return numbers(lambda *x: reduce(combine, x))


#: Name: fewest and most arguments, and what they make.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "recip": (4, 4, numbers(lambda x, m, a, b: a / F.nullif(m * x + b, F.lit(0.0)))),
    "ms": (0, 2, elapsed),
    "log": (1, 1, numbers(F.log10)),
    "sqrt": (1, 1, numbers(F.sqrt)),
    "pow": (2, 2, numbers(F.pow)),
    "abs": (1, 1, numbers(F.abs)),
    "field": (1, 1, numbers(lambda x: x)),
    "sum": (1, 99, fold(lambda a, b: a + b)),
    "product": (1, 99, fold(lambda a, b: a * b)),
    "min": (1, 99, fold(F.least)),
    "max": (1, 99, fold(F.greatest)),
}
NUMERIC = ("int", "float", "long", "double")


class _Reader:
    def __init__(self, text: str, available: set[str] | None):
        self.text, self.available, self.tokens, at = text, available, [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise SearchError(f"cannot parse the function at {at}: {text[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, sign: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise SearchError(f"the function {self.text} ends too early")
        found = self.tokens[self.at]
        if sign and found != ("sign", sign):
            raise SearchError(f"{sign} is missing before {found[1]} in the function {self.text}")
        self.at += 1
        return found

    def follows(self, sign: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == ("sign", sign)

    def value(self) -> Value:
        kind, word = self.take()
        if kind == "number":
            return Value(F.lit(float(word)), "number")
        if kind == "date":
            return Value(date_math(word), "date")
        if kind == "sign":
            raise SearchError(f"{word} is not expected in the function {self.text}")
        return self.call(word) if self.follows("(") else self.named(word)

    def named(self, name: str) -> Value:
        f = schema.field(name)
        if self.available is not None and name not in self.available:
            raise SearchError(f"the documents have no field {name}")
        if f.many or f.kind not in (*NUMERIC, "date"):
            raise SearchError(f"field {name} is neither a number nor a date")
        return Value(F.col(name), "date") if f.kind == "date" else Value(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), "number")

    def call(self, name: str) -> Value:
        if name not in FUNCTIONS:
            raise SearchError(f"unknown function {name}")
        args = []
        self.take("(")
        while not self.follows(")"):
            args.append(self.value())
            if not self.follows(")"):
                self.take(",")
                if self.follows(")"):
                    raise SearchError(f"an argument is missing in the function {self.text}")
        self.take(")")
        fewest, most, make = FUNCTIONS[name]
        if not fewest <= len(args) <= most:
            raise SearchError(f"{name} takes {fewest if fewest == most else f'{fewest} to {most}'} arguments, not {len(args)}")
        return Value(F.coalesce(make(*args).cast("double"), F.lit(0.0)), "number")


def boost_function(text: str, available: set[str] | None = None) -> Column:
    """The number that ``bf`` adds to a score; a missing value counts as 0. ``available``: fields that the documents have."""
    reader = _Reader(text, available)
    out = reader.value()
    if reader.at != len(reader.tokens):
        raise SearchError(f"cannot parse the function {text} after {reader.tokens[reader.at - 1][1]}")
    if out.kind != "number":
        raise SearchError("a boost function gives a number")
    return out.column
