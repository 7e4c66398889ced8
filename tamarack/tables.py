"""Models of the standard tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tamarack.fields import BigIntegerField, DateTimeField, FloatField, ForeignKey, IDField, IntegerField, TextField
from tamarack.model import Model, Registry
from tamarack.settings import Settings
from tamarack.sources.source import ParquetSource


def models() -> list[Model]:
    number = lambda: IntegerField(primary_key=True)
    text, real = (lambda: TextField(null=True)), (lambda: FloatField(null=True))
    moment = lambda: DateTimeField(null=True, with_zone=False)
    return [
        Model("region", r_regionkey=number(), r_name=text()),
        Model("nation", n_nationkey=number(), n_name=text(), n_regionkey=ForeignKey("region")),
        Model("customer", c_custkey=IDField(), c_name=text(), c_nationkey=ForeignKey("nation"), c_acctbal=real(), c_mktsegment=text()),
        Model("supplier", s_suppkey=IDField(), s_name=text(), s_nationkey=ForeignKey("nation"), s_acctbal=real()),
        Model("part", p_partkey=IDField(), p_name=text(), p_brand=text(), p_type=text(), p_size=IntegerField(null=True), p_retailprice=real()),
        Model("orders", o_orderkey=IDField(), o_custkey=ForeignKey("customer"), o_orderstatus=text(), o_totalprice=real(), o_orderdate=moment(), o_orderpriority=text()),
        Model("lineitem", l_orderkey=ForeignKey("orders"), l_partkey=ForeignKey("part"), l_suppkey=ForeignKey("supplier"), l_linenumber=IntegerField(null=True), l_quantity=real(), l_extendedprice=real(), l_discount=real(), l_tax=real(), l_returnflag=text(), l_linestatus=text(), l_shipdate=moment()),
        Model("events", event_id=IDField(), ts=moment(), user_id=BigIntegerField(null=True), event_type=text(), value=real(), props=text()),
        Model("documents", doc_id=IDField(), text=text(), lang=text(), source=text(), n_chars=BigIntegerField(null=True)),
        Model("labels", doc_id=ForeignKey("documents", how="left"), quality=IntegerField(null=True), toxic=IntegerField(null=True)),
    ]


def source(spark: SparkSession, folder: str, settings: Settings | None = None) -> ParquetSource:
    return ParquetSource(spark, Registry(*models(), settings=settings), folder)
