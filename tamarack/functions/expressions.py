"""Expressions of queries, as small trees that compile to Spark columns."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import LookupSyntaxError
from tamarack.fields import Field
from tamarack.functions import formats
from tamarack.lookups import Lookup, parse


class Scope:
    """What an expression is compiled against: columns by path, and aggregates where they are done already."""

    def __init__(self, resolve: Callable[[tuple[str, ...]], tuple[Column, T.DataType]], done: dict | None = None):
        self.resolve = resolve
        self.done = done or {}

    def column(self, node: Node) -> Column:
        return self.done[node.key()] if node.key() in self.done else node.compile(self)


class Node:
    """Base of expressions. Operators build arithmetic and comparisons between expressions."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def compile(self, scope: Scope) -> Column:
        raise NotImplementedError

    def key(self) -> Any:
        return (type(self).__name__, *[c.key() for c in self.children()])

    @property
    def is_aggregate(self) -> bool:
        return any(isinstance(n, Aggregate) for n in self.walk())

    def __add__(self, other):
        return Arithmetic("+", self, node(other, text=False))

    def __sub__(self, other):
        return Arithmetic("-", self, node(other, text=False))

    def __mul__(self, other):
        return Arithmetic("*", self, node(other, text=False))

    def __truediv__(self, other):
        return Arithmetic("/", self, node(other, text=False))


def node(value: Any, *, text: bool = True) -> Node:
    """Strings are paths (or, where ``text`` is false, text); other values are literals."""
    if isinstance(value, Node):
        return value
    if isinstance(value, Column):
        return Raw(value)
    return Ref(value) if isinstance(value, str) and text else Value(value)


class Ref(Node):
    """A field by its path, with transforms."""

    def __init__(self, lookup: str | Lookup):
        self.lookup = lookup if isinstance(lookup, Lookup) else parse(lookup)

    def key(self):
        return ("ref", self.lookup.path, self.lookup.transforms)

    def typed(self, scope: Scope) -> tuple[Column, T.DataType]:
        column, kind = scope.resolve(self.lookup.path)
        for name in self.lookup.transforms:
            column, kind = formats.transform(column, kind, name)
        return column, kind

    def compile(self, scope: Scope) -> Column:
        return self.typed(scope)[0]


class Value(Node):
    """A literal; strings are never part of any SQL text."""

    def __init__(self, value: Any):
        self.value = value

    def key(self):
        return ("value", type(self.value).__name__, repr(self.value))

    def compile(self, scope: Scope) -> Column:
        return F.lit(self.value)


class Raw(Node):
    """Any Spark column that the caller has made."""

    def __init__(self, column: Column):
        self.column = column

    def key(self):
        return ("raw", str(self.column))

    def compile(self, scope: Scope) -> Column:
        return self.column


class Arithmetic(Node):
    def __init__(self, operator: str, left: Node, right: Node):
        self.operator, self.left, self.right = operator, left, right

    def children(self):
        return self.left, self.right

    def key(self):
        return (self.operator, self.left.key(), self.right.key())

    def compile(self, scope: Scope) -> Column:
        a, b = scope.column(self.left), scope.column(self.right)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[self.operator]


class Aggregate(Node):
    name = ""

    def __init__(self, over: Any = "*", distinct: bool = False):
        self.over = Value(1) if over == "*" else node(over)
        self.distinct = distinct
        if self.over.is_aggregate:
            raise LookupSyntaxError("an aggregate within an aggregate")

    def children(self):
        return (self.over,)

    def key(self):
        return (self.name, self.distinct, self.over.key())

    def compile(self, scope: Scope) -> Column:
        column = scope.column(self.over)
        plain = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}
        if not self.distinct or self.name in ("max", "min"):
            return plain[self.name](column)
        return {"sum": F.sum_distinct, "count": F.count_distinct, "avg": lambda c: F.sum_distinct(c.cast("double")) / F.count_distinct(c)}[self.name](column)


class Sum(Aggregate):
    name = "sum"


class Avg(Aggregate):
    name = "avg"


class Count(Aggregate):
    name = "count"


class Max(Aggregate):
    name = "max"


class Min(Aggregate):
    name = "min"


class Function(Node):
    """A function of expressions and fixed arguments."""

    def __init__(self, name: str, args: tuple[Node, ...], make: Callable[..., Column], fixed: tuple = ()):
        self.name, self.args, self.make, self.fixed = name, args, make, fixed

    def children(self):
        return self.args

    def key(self):
        return (self.name, self.fixed, *[a.key() for a in self.args])

    def compile(self, scope: Scope) -> Column:
        return self.make(*[scope.column(a) for a in self.args])


def _type_name(kind: Any) -> str | T.DataType:
    return kind.spark_type if isinstance(kind, Field) else kind


def _cast(column: Column, kind: Any) -> Column:
    kind = _type_name(kind)
    return column if kind is None else column.cast(kind) if isinstance(kind, T.DataType) else formats.cast(column, kind)


def Cast(of: Any, kind: Any) -> Node:
    return Function("cast", (node(of),), lambda c: _cast(c, kind), (str(_type_name(kind)),))


def Concat(parts: list, output_field: Any = None) -> Node:
    """Texts in a row; nulls are left out."""
    return Function("concat", tuple(node(p) for p in parts), lambda *c: _cast(F.concat_ws("", *[x.cast("string") for x in c]), output_field), (str(_type_name(output_field)),))


def Extract(of: Any, part: str, kind: Any = None) -> Node:
    kind = kind.removeprefix("::") if isinstance(kind, str) else kind
    return Function("extract", (node(of),), lambda c: _cast(formats.extract(c, part), kind), (part, str(kind)))


def To_char(of: Any, pattern: str) -> Node:
    return Function("to_char", (node(of),), lambda c: F.date_format(c, formats.spark_pattern(pattern)), (pattern,))


class _Transformed(Node):
    def __init__(self, name: str, of: Any):
        self.name, self.of = name, node(of)

    def children(self):
        return (self.of,)

    def key(self):
        return (self.name, self.of.key())

    def compile(self, scope: Scope) -> Column:
        column, kind = self.of.typed(scope) if isinstance(self.of, Ref) else (scope.column(self.of), T.TimestampType())
        return formats.transform(column, kind, self.name)[0]


def _transformer(name: str) -> Callable[[Any], Node]:
    return lambda of: _Transformed(name, of)


YEAR, MONTH, DAY, QUARTER, QUADRIMESTER, DATE, Y_M = map(_transformer, ("year", "month", "day", "quarter", "quadrimester", "date", "yyyy_mm"))


class When(Node):
    """A condition and what follows from it: within ``Case``, or alone with its own ``_else``."""

    def __init__(self, *conditions: Any, then: Any = 0, _else: Any = None):
        self.condition, self.then, self.other = Q(*conditions), node(then, text=False), node(_else, text=False)

    def children(self):
        return self.condition, self.then, self.other

    def compile(self, scope: Scope) -> Column:
        return F.when(scope.column(self.condition), scope.column(self.then)).otherwise(scope.column(self.other))


class Case(Node):
    def __init__(self, whens: When | list[When], default: Any = None, output_field: Any = None):
        self.whens = [whens] if isinstance(whens, When) else list(whens)
        self.default, self.output = node(default, text=False), output_field
        if not self.whens:
            raise LookupSyntaxError("Case asks for a When")

    def children(self):
        return (*self.whens, self.default)

    def key(self):
        return ("case", str(_type_name(self.output)), *[c.key() for c in self.children()])

    def compile(self, scope: Scope) -> Column:
        made = None
        for w in self.whens:
            condition, then = scope.column(w.condition), scope.column(w.then)
            made = F.when(condition, then) if made is None else made.when(condition, then)
        return _cast(made.otherwise(scope.column(self.default)), self.output)


class Over(Node):
    """A window: an aggregate, or ``row_number``, ``rank``, ``dense_rank``, over rows of one partition in an order."""

    def __init__(self, function: Any, partition_by: tuple | list = (), order_by: tuple | list = (), rows: tuple[int, int] | None = None):
        self.function = function if isinstance(function, str) else node(function)
        self.parts, self.orders, self.rows = [node(p) for p in partition_by], [Order.of(o) for o in order_by], rows

    def children(self):
        return (*self.parts, *[o.by for o in self.orders])  # its aggregate is no aggregate of the query

    def walk(self):
        yield from super().walk()
        if isinstance(self.function, Node):
            for c in self.function.children():
                yield from c.walk()

    def key(self):
        return ("over", self.function if isinstance(self.function, str) else self.function.key(), self.rows, *[c.key() for c in self.children()], *[o.descending for o in self.orders])

    def compile(self, scope: Scope) -> Column:
        window = Window.partitionBy(*[scope.column(p) for p in self.parts])
        if self.orders:
            window = window.orderBy(*[o.compile(scope) for o in self.orders])
        if self.rows:
            window = window.rowsBetween(*self.rows)
        named = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
        return (named[self.function]() if isinstance(self.function, str) else self.function.compile(scope)).over(window)


@dataclass
class Order:
    """A sort key; nulls stand as PostgreSQL puts them: last upwards, first downwards."""

    by: Node
    descending: bool = False
    alias: str | None = None

    @classmethod
    def of(cls, key: Any) -> Order:
        if isinstance(key, Order):
            return key
        if isinstance(key, str):
            name = key.removeprefix("-")
            return cls(Ref(name), key.startswith("-"), name)
        return cls(node(key))

    def compile(self, scope: Scope) -> Column:
        return self.direct(scope.column(self.by))

    def direct(self, column: Column) -> Column:
        return column.desc_nulls_first() if self.descending else column.asc_nulls_last()


class Condition(Node):
    def __invert__(self) -> Condition:
        return Not(self)

    def __and__(self, other: Condition) -> Condition:
        return Q(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Qor(self, other)


class Not(Condition):
    def __init__(self, of: Condition):
        self.of = of

    def children(self):
        return (self.of,)

    def compile(self, scope: Scope) -> Column:
        return ~scope.column(self.of)


class Q(Condition):
    """All of its conditions: pairs (lookup, value), dicts, keywords or conditions."""

    joined = staticmethod(lambda a, b: a & b)

    def __init__(self, *conditions: Any, **pairs: Any):
        self.parts = list(_conditions((*conditions, pairs)))
        if not self.parts:
            raise LookupSyntaxError(f"{type(self).__name__} asks for a condition")

    def children(self):
        return tuple(self.parts)

    def compile(self, scope: Scope) -> Column:
        made = None
        for p in self.parts:
            column = scope.column(p)
            made = column if made is None else self.joined(made, column)
        return made


class Qor(Q):
    """Any of its conditions."""

    joined = staticmethod(lambda a, b: a | b)


def _conditions(given: Any) -> Iterator[Condition]:
    for c in given:
        if isinstance(c, Condition):
            yield c
        elif isinstance(c, dict):
            for k, v in c.items():
                yield compare(k, v)
        elif isinstance(c, tuple) and len(c) == 2 and isinstance(c[0], str | Node):
            yield compare(*c)
        elif isinstance(c, tuple | list):
            yield from _conditions(c)
        elif isinstance(c, Node):
            yield Truth(c)
        elif isinstance(c, Column):
            yield Truth(Raw(c))
        else:
            raise LookupSyntaxError(f"{c!r} is no condition")


class Truth(Condition):
    """A boolean expression as a condition."""

    def __init__(self, of: Node):
        self.of = of

    def children(self):
        return (self.of,)

    def compile(self, scope: Scope) -> Column:
        return scope.column(self.of)


OPERATORS = ("=", ">", "<", ">=", "<=", "<>", "!=", "in", "nin", "isnull", "contains", "icontains")


def compare(key: str | Node, value: Any) -> Condition:
    if isinstance(key, Node):
        return OP(key, value)
    found = parse(key, compares=True)
    return OP(Ref(Lookup(found.path, found.transforms)), found.comparator, value)


class OP(Condition):
    """``left operator value``; the operator may be left out, and is ``=`` then."""

    def __init__(self, left: Any, *rest: Any):
        if len(rest) not in (1, 2):
            raise LookupSyntaxError("OP(left, [operator,] value)")
        operator = str(rest[0]).lower().replace("not in", "nin").replace("<>", "!=") if len(rest) == 2 else "="
        if operator not in OPERATORS:
            raise LookupSyntaxError(f"unknown operator {rest[0]!r}; there are {', '.join(OPERATORS)}")
        self.left, self.operator, self.value = node(left), operator, rest[-1]
        if operator in ("contains", "icontains") and not isinstance(self.value, str):
            raise LookupSyntaxError(f"{operator} asks for text, not {self.value!r}")
        if operator == "isnull" and not isinstance(self.value, bool):
            raise LookupSyntaxError("isnull is True or False")

    def children(self):
        return (self.left, self.value) if isinstance(self.value, Node) else (self.left,)

    def key(self):
        return ("op", self.operator, self.left.key(), self.value.key() if isinstance(self.value, Node) else repr(self.value))

    def compile(self, scope: Scope) -> Column:
        if narrowed := self._range(scope):
            return narrowed[0]
        left, op, value = scope.column(self.left), self.operator, self.value
        if op == "isnull":
            return left.isNull() if value else left.isNotNull()
        if op in ("contains", "icontains"):
            pattern = F.lit("%" + value.replace("\\", "\\\\") + "%")  # % and _ of the value stay wild
            return (F.like if op == "contains" else F.ilike)(left, pattern)
        if op in ("in", "nin"):
            made = left.isin(self._rows(value)) if not isinstance(value, list | tuple | set | frozenset | range) else self._listed(left, list(value))
            return made if op == "in" else ~made
        right = scope.column(value) if isinstance(value, Node) else F.lit(value)
        if value is None:
            raise LookupSyntaxError("compare with null by __@isnull")
        return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]

    @staticmethod
    def _listed(left: Column, values: list) -> Column:
        return left.isin(values) if values else F.lit(False)

    @staticmethod
    def _rows(value: Any) -> DataFrame:
        frame = value if isinstance(value, DataFrame) else value.list() if hasattr(value, "list") else None
        if frame is None:
            raise LookupSyntaxError(f"in asks for a list or a query, not {value!r}")
        if len(frame.columns) != 1:
            raise LookupSyntaxError("a sub-query of in has one column")
        return frame

    def _range(self, scope: Scope) -> tuple[Column] | None:
        """A comparison of a year, month or day as a range of the field itself, which reaches the scan."""
        left = self.left
        if not isinstance(left, Ref) or len(left.lookup.transforms) != 1 or self.operator not in ("=", "<", "<=", ">", ">=") or left.key() in scope.done:
            return None
        column, kind = scope.resolve(left.lookup.path)
        span = _span(left.lookup.transforms[0], self.value) if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else None
        if span is None:
            return None
        start, end = (F.lit(d.isoformat()).cast(kind) for d in span)
        return ({"=": (column >= start) & (column < end), "<": column < start, "<=": column < end, ">": column >= end, ">=": column >= start}[self.operator],)


def _span(transform: str, value: Any) -> tuple[datetime.date, datetime.date] | None:
    """First day, and first day after, of a year, month or day; None where there is no such range."""
    try:
        if transform == "year" and isinstance(value, int) and not isinstance(value, bool) and 1 <= value < 9999:
            return datetime.date(value, 1, 1), datetime.date(value + 1, 1, 1)
        if transform == "yyyy_mm" and isinstance(value, str) and len(value) == 7:
            first = datetime.date.fromisoformat(value + "-01")
            return first, (first.replace(day=28) + datetime.timedelta(4)).replace(day=1)
        if transform == "date":
            day = datetime.date.fromisoformat(value) if isinstance(value, str) and len(value) == 10 else value if type(value) is datetime.date else None
            return day and (day, day + datetime.timedelta(1))
    except (ValueError, OverflowError):
        return None
    return None
