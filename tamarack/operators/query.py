"""The query object: projection, filters, order and page, compiled to one lazy DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from tamarack.errors import LookupSyntaxError
from tamarack.functions.expressions import Node, Order, Q, Ref, node
from tamarack.lookups import parse
from tamarack.model import Model
from tamarack.plans.planner import Plan, Spec


class Query:
    """Rows of a model. ``filter`` accumulates, ``values`` and ``order_by`` replace, and each returns the query."""

    def __init__(self, model: Model, source: Any):
        self.model, self.source = model, source
        self.spec = Spec(model)

    @property
    def spark(self) -> SparkSession:
        return self.source.spark

    def values(self, *columns: Any, **named: Any) -> Query:
        """Paths (their own alias, transforms joined by __), pairs (alias, expression) and keywords."""
        found: list[tuple[str, Node]] = []
        for c in columns:
            if isinstance(c, str):
                lookup = parse(c)
                found.append((lookup.alias, Ref(lookup)))
            elif isinstance(c, tuple) and len(c) == 2 and isinstance(c[0], str):
                found.append((c[0], node(c[1])))
            elif isinstance(c, dict):
                found += [(a, node(n)) for a, n in c.items()]
            elif isinstance(c, Node | Column):
                raise LookupSyntaxError("an expression asks for an alias: (alias, expression)")
            else:
                raise LookupSyntaxError(f"{c!r} cannot be projected")
        found += [(a, node(n)) for a, n in named.items()]
        if len({a for a, _ in found}) < len(found):
            raise LookupSyntaxError("an alias is given twice")
        self.spec.values = found
        return self

    def filter(self, *conditions: Any, **pairs: Any) -> Query:
        self.spec.filters.append(Q(*conditions, **pairs))
        return self

    def exclude(self, *conditions: Any, **pairs: Any) -> Query:
        self.spec.filters.append(~Q(*conditions, **pairs))
        return self

    def order_by(self, *keys: Any) -> Query:
        self.spec.orders = [Order.of(k) for k in keys]
        return self

    def page(self, limit: int = 10, offset: int = 0) -> Query:
        """At most ``limit`` rows after the first ``offset``; 0 stands for no limit and no offset."""
        if limit < 0 or offset < 0:
            raise LookupSyntaxError("limit and offset are not negative")
        self.spec.limit, self.spec.offset = limit, offset
        return self

    def distinct(self) -> Query:
        self.spec.distinct = True
        return self

    def list(self) -> DataFrame:
        """The rows, lazily."""
        return Plan(self.spec, self.source.load).compile()

    frame = list

    def count(self) -> int:
        """How many rows there are without the page; of groups, if there are aggregates."""
        return Plan(self.spec, self.source.load).compile(paged=False).count()

    def exists(self) -> bool:
        return not Plan(self.spec, self.source.load).compile(paged=False).isEmpty()

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text."""
        df = self.list()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def union(self, other: Query, all: bool = False) -> DataFrame:
        both = self.list().unionByName(other.list())
        return both if all else both.distinct()

    def intersect(self, other: Query, all: bool = False) -> DataFrame:
        return self.list().intersectAll(other.list()) if all else self.list().intersect(other.list())

    def except_(self, other: Query, all: bool = False) -> DataFrame:
        return self.list().exceptAll(other.list()) if all else self.list().subtract(other.list())
