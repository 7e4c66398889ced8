"""From a query's paths to one DataFrame: a trie of joins, filters, groups, order and page."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import FieldError, LookupSyntaxError
from tamarack.functions.expressions import Aggregate, Condition, Node, Order, Ref, Scope
from tamarack.model import Edge, Model


@dataclass
class Spec:
    """What a query asks for."""

    model: Model
    values: list[tuple[str, Node]] = field(default_factory=list)
    filters: list[Condition] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
    distinct: bool = False


@dataclass
class Joined:
    """A table of the query: its alias, how it is joined, and what is joined to it."""

    alias: str
    model: Model
    edge: Edge | None = None
    how: str = "inner"
    children: dict[str, Joined] = field(default_factory=dict)
    columns: dict[str, None] = field(default_factory=dict)

    def physical(self, column: str) -> str:
        return f"{self.alias}__{column}"

    def need(self, column: str) -> str:
        self.columns[column] = None
        return self.physical(column)


class Plan:
    def __init__(self, spec: Spec, load):
        self.spec, self.load = spec, load
        self.root = Joined("Tb", spec.model)
        self.count = 0
        self.aliases = dict(spec.values)
        for _, n in spec.values:
            self._visit(n)
        self.filters = [self._named(c) for c in spec.filters]
        for c in self.filters:
            self._visit(c)
        self.orders = [Order(self._named(o.by), o.descending, o.alias) for o in spec.orders]
        for o in self.orders:
            self._visit(o.by)

    def _named(self, n: Any) -> Any:
        """A reference to a projected alias means what is projected."""
        if isinstance(n, Ref) and not n.lookup.transforms:
            return self.aliases.get("__".join(n.lookup.path), n)
        if isinstance(n, Node):
            for name, value in vars(n).items():
                if isinstance(value, Node):
                    new = self._named(value)
                elif isinstance(value, list):
                    new = [self._named(v) for v in value]
                else:
                    continue
                if new is not value and new != value:
                    n = _copy(n)
                    setattr(n, name, new)
        return n

    def _visit(self, n: Node) -> None:
        for x in n.walk():
            if isinstance(x, Ref):
                self._place(x.lookup.path)

    def _place(self, path: tuple[str, ...]) -> tuple[Joined, str]:
        """The table and field at a path; joins that are missing are added. Equal paths share a join, others never do."""
        at = self.root
        for name in path[:-1]:
            if name not in at.children:
                edge = at.model.edge(name)
                left = at.model.registry.settings.nullable_fk_left and edge.fk.null
                self.count += 1
                at.need(edge.key)
                at.children[name] = Joined(f"Tb_{self.count}", edge.target, edge, edge.fk.how or ("left" if left else "inner"))
                at.children[name].need(edge.target_key)
            at = at.children[name]
        at.model.field(path[-1])
        at.need(path[-1])
        return at, path[-1]

    def resolve(self, path: tuple[str, ...]) -> tuple[Column, T.DataType]:
        at, name = self._place(path)
        return F.col(at.physical(name)), self.types[at.physical(name)]

    def joined(self) -> DataFrame:
        """All tables under unique physical names, with the columns that are used."""
        if not self.spec.values:
            for name in self.spec.model.fields:
                self.root.need(name)
        df = self._frame(self.root)
        stack = [self.root]
        while stack:
            at = stack.pop()
            for child in at.children.values():
                on = F.col(at.physical(child.edge.key)) == F.col(child.physical(child.edge.target_key))
                df = df.join(self._frame(child), on, child.how)
                stack.append(child)
        self.types = {f.name: f.dataType for f in df.schema.fields}
        return df

    def _frame(self, at: Joined) -> DataFrame:
        source = self.load(at.model)
        stored = {c.lower(): c for c in source.columns}
        picked = []
        for name in at.columns or [next(iter(at.model.fields))]:
            where = (at.model.fields[name].db_column or name).lower()
            if where not in stored:
                raise FieldError(f"{at.model.name}: the data has no column {where}; it has {', '.join(source.columns)}")
            picked.append(F.col(f"`{stored[where]}`").alias(at.physical(name)))
        return source.select(*picked)

    def compile(self, *, paged: bool = True) -> DataFrame:
        spec = self.spec
        df = self.joined()
        scope = Scope(self.resolve)
        for c in self.filters:
            if not c.is_aggregate:
                df = df.filter(scope.column(c))
        having = [c for c in self.filters if c.is_aggregate]
        values = spec.values or [(n, Ref(n)) for n in spec.model.fields]
        if any(n.is_aggregate for _, n in values) or having or any(o.by.is_aggregate for o in self.orders):
            df = self._grouped(df, scope, values, having)
        else:
            hidden = [(f"__order_{k}", o.by) for k, o in enumerate(self.orders)] if paged else []
            projected = df.select(*[scope.column(n).alias(a) for a, n in values], *[scope.column(n).alias(a) for a, n in hidden] if not spec.distinct else [])
            if spec.distinct:
                projected = projected.distinct()
            if paged and self.orders:
                by_key = {n.key(): a for a, n in values}
                if spec.distinct and any(o.by.key() not in by_key for o in self.orders):
                    raise LookupSyntaxError("distinct rows can only be ordered by what is projected")
                projected = projected.orderBy(*[o.direct(F.col(f"`{by_key.get(o.by.key(), f'__order_{k}')}`")) for k, o in enumerate(self.orders)])
            df = projected
        if paged:
            df = df.offset(spec.offset) if spec.offset else df
            df = df.limit(spec.limit) if spec.limit else df
        return df.select(*[F.col(f"`{a}`") for a, _ in values])

    def _grouped(self, df: DataFrame, scope: Scope, values: list[tuple[str, Node]], having: list[Condition]) -> DataFrame:
        """Groups by everything projected or sorted by that is no aggregate; conditions on aggregates come after."""
        keys: dict[Any, tuple[str, Node]] = {}
        found: dict[Any, tuple[str, Node]] = {}
        for a, n in [*values, *[(f"__order_{k}", o.by) for k, o in enumerate(self.orders)]]:
            if not n.is_aggregate:
                keys.setdefault(n.key(), (f"__key_{len(keys)}", n))
        for n in [n for _, n in values] + having + [o.by for o in self.orders]:
            for x in n.walk():
                if isinstance(x, Aggregate):
                    found.setdefault(x.key(), (f"__agg_{len(found)}", x))
        aggregates = [scope.column(n).alias(a) for a, n in found.values()]
        grouped = df.groupBy(*[scope.column(n).alias(a) for a, n in keys.values()]) if keys else df
        df = grouped.agg(*aggregates) if aggregates else grouped.agg(F.count(F.lit(1)).alias("__agg_0"))
        done = {k: F.col(a) for k, (a, _) in [*keys.items(), *found.items()]}

        def outside(path: tuple[str, ...]):
            raise LookupSyntaxError(f"{'__'.join(path)} stands beside an aggregate but is neither grouped nor aggregated")

        after = Scope(outside, done)
        for c in having:
            df = df.filter(after.column(c))
        if self.spec.distinct:
            return df.select(*[after.column(n).alias(a) for a, n in values]).distinct()
        hidden = [after.column(o.by).alias(f"__order_{k}") for k, o in enumerate(self.orders)]
        df = df.select(*[after.column(n).alias(a) for a, n in values], *hidden)
        return df.orderBy(*[o.direct(F.col(f"__order_{k}")) for k, o in enumerate(self.orders)]) if self.orders else df


def _copy(n: Node) -> Node:
    new = object.__new__(type(n))
    new.__dict__.update(n.__dict__)
    return new
