"""Named queries over the standard tables, and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import tables
from tamarack.errors import DataError
from tamarack.fields import BigIntegerField, CharField, FloatField, ForeignKey, IDField, IntegerField
from tamarack.functions.expressions import QUARTER, Avg, Case, Cast, Concat, Count, Extract, Max, Min, Over, Q, Qor, Ref, Sum, To_char, Value, When
from tamarack.model import Model, Registry
from tamarack.operators import dml, migrate
from tamarack.operators.query import Query
from tamarack.settings import Settings
from tamarack.sources.source import CsvSource
from tamarack.sources.store import Store
from tamarack.streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

T = "l_orderkey__o_custkey__c_nationkey"


def register(table: str | None, sql: str):
    """Add a query: given the table's query object (or the session and folder), it gives a query or a frame."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if table is None:
                return make(spark, sf_dir)
            made = make(tables.source(spark, sf_dir).query(table))
            return made.list() if isinstance(made, Query) else made

        _QUERIES[make.__name__] = run
        _SQL[make.__name__] = sql
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- paths, joins and aggregates


@register("lineitem", "SELECT r.r_name region, n.n_name nation, count(t.l_linenumber) c, max(t.l_quantity) mx, min(t.l_quantity) mn, round(sum(t.l_extendedprice), 2) rev FROM lineitem t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'F' GROUP BY 1, 2")
def path_agg(q: Query) -> DataFrame:
    q.filter(l_orderkey__o_orderstatus="F").values(region=Ref(f"{T}__n_regionkey__r_name"), nation=Ref(f"{T}__n_name"), c=Count("l_linenumber"), mx=Max("l_quantity"), mn=Min("l_quantity"), rev=Sum("l_extendedprice"))
    return q.list().withColumn("rev", F.round("rev", 2))


@register("nation", "SELECT n.n_name, count(c.c_custkey) cc FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def reverse_agg(q):
    return q.values("n_name", cc=Count("customer__c_custkey"))


@register("region", "SELECT r.r_name, count(o.o_orderkey) n FROM region r JOIN nation a ON a.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = a.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def reverse_chain(q):
    return q.values("r_name", n=Count("nation__customer__orders__o_orderkey"))


@register("documents", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_how(q):
    return q.values("doc_id", quality=Ref("labels__quality"))


@register("lineitem", "SELECT n1.n_name cn, n2.n_name sn, count(*) n FROM lineitem t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n1 ON c.c_nationkey = n1.n_nationkey JOIN supplier s ON t.l_suppkey = s.s_suppkey JOIN nation n2 ON s.s_nationkey = n2.n_nationkey GROUP BY 1, 2")
def diamond(q):
    return q.values(cn=Ref(f"{T}__n_name"), sn=Ref("l_suppkey__s_nationkey__n_name"), n=Count("*"))


@register("orders", "SELECT c.c_name, count(o.o_orderkey) oc FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1 HAVING count(o.o_orderkey) >= 15")
def having(q):
    return q.values(c_name=Ref("o_custkey__c_name"), oc=Count("o_orderkey")).filter({"oc__@gte": 15})


@register("orders", "SELECT o_orderpriority, CAST(sum(DISTINCT o_custkey) AS BIGINT) sd, round(avg(DISTINCT o_custkey), 4) ad, count(DISTINCT o_custkey) cd FROM orders GROUP BY 1")
def distinct_aggs(q):
    q.values("o_orderpriority", sd=Sum("o_custkey", distinct=True), ad=Avg("o_custkey", distinct=True), cd=Count("o_custkey", distinct=True))
    return q.list().withColumn("ad", F.round("ad", 4))


@register("orders", "SELECT count(*) n, round(avg(o_totalprice), 2) a FROM orders")
def global_agg(q):
    return q.values(n=Count("*"), a=Avg("o_totalprice")).list().withColumn("a", F.round("a", 2))


@register("orders", "SELECT o_orderstatus, count(*) n FROM orders GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderpriority")
def order_by_hidden_key(q):
    return q.values("o_orderstatus", n=Count("*")).order_by("o_orderpriority")


# ---- predicates


@register("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_and(q):
    return q.values("o_orderkey").filter({"o_totalprice__@gte": 100000}).filter(o_orderstatus="F")


@register("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_totalprice >= 1000 AND o_totalprice <= 50000)")
def q_or(q):
    return q.values("o_orderkey").filter(Qor(("o_orderstatus", "F"), Q({"o_totalprice__@gte": 1000, "o_totalprice__@lte": 50000})))


@register("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 90000 AND o_totalprice > 20000")
def neq_lt_gt(q):
    return q.values("o_orderkey").filter({"o_orderstatus__@neq": "F", "o_totalprice__@lt": 90000, "o_totalprice__@gt": 20000})


@register("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
def negated(q):
    return q.values("o_orderkey").filter(~Qor(("o_orderstatus", "F"), {"o_totalprice__@lt": 50000}))


@register("part", "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%'")
def contains(q):
    return q.values("p_partkey").filter({"p_name__@contains": "widget"})


@register("part", "SELECT p_partkey FROM part WHERE p_name ILIKE '%WID_ET%'")
def icontains(q):
    return q.values("p_partkey").filter({"p_name__@icontains": "WID_ET"})


@register("orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(q):
    return q.values("o_orderkey").filter({"o_orderpriority__@in": ["1-URGENT", "2-HIGH"]})


@register("orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def nin_list(q):
    return q.values("o_orderkey").filter({"o_orderpriority__@nin": ["1-URGENT", "2-HIGH"]})


def _building(q: Query) -> Query:
    return q.source.query("customer").filter(c_mktsegment="BUILDING").values("c_custkey")


@register("orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_query(q):
    return q.values("o_orderkey").filter({"o_custkey__@in": _building(q)})


@register("orders", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def nin_query(q):
    return q.values("o_orderkey").filter({"o_custkey__@nin": _building(q)})


@register("lineitem", "SELECT count(*) n FROM lineitem t JOIN orders o ON t.l_orderkey = o.o_orderkey WHERE o.o_custkey IN (SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name LIKE '%A%') OR o.o_orderstatus = 'F'")
def in_joined_query(q):
    inner = q.source.query("customer").filter({"c_nationkey__n_name__@contains": "A"}).values("c_custkey")
    return q.values(n=Count("*")).filter(Qor({"l_orderkey__o_custkey__@in": inner}, l_orderkey__o_orderstatus="F"))


@register("orders", "SELECT count(*) c FROM orders WHERE o_totalprice IS NOT NULL")
def isnull_count(q):
    n = q.filter({"o_totalprice__@isnull": False}).count()
    return q.spark.range(1).select(F.lit(n).cast("long").alias("c"))


@register("orders", "SELECT count(*) > 0 e, false f FROM orders WHERE o_totalprice > 100")
def exists(q):
    found, none = q.filter({"o_totalprice__@gt": 100}).exists(), q.source.query("orders").filter(o_orderstatus="?").exists()
    return q.spark.range(1).select(F.lit(found).alias("e"), F.lit(none).alias("f"))


# ---- order and page


@register("customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 10 OFFSET 5")
def topk_page(q):
    return q.values("c_custkey", "c_acctbal").order_by("-c_acctbal", "c_custkey").page(10, 5)


@register("nation", "SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey ORDER BY r.r_name DESC NULLS FIRST, n.n_name LIMIT 7")
def order_by_path(q):
    return q.values("n_name").order_by("-n_regionkey__r_name", "n_name").page(limit=7)


@register("customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(q):
    return q.values("c_mktsegment", "c_nationkey").distinct()


# ---- transforms and functions


@register("orders", "SELECT CAST(extract(year FROM o_orderdate) AS INT) o_orderdate__year, CAST(extract(month FROM o_orderdate) AS INT) o_orderdate__month, CAST(extract(day FROM o_orderdate) AS INT) o_orderdate__day, count(*) n FROM orders WHERE extract(year FROM o_orderdate) = 1996 GROUP BY 1, 2, 3")
def ymd(q):
    return q.filter({"o_orderdate__@year": 1996}).values("o_orderdate__@year", "o_orderdate__@month", "o_orderdate__@day", n=Count("o_orderkey"))


@register("orders", "SELECT strftime(o_orderdate, '%Y-%m') m, count(*) n FROM orders WHERE strftime(o_orderdate, '%Y-%m') > '1994-05' GROUP BY 1")
def yyyy_mm(q):
    return q.filter({"o_orderdate__@yyyy_mm__@gt": "1994-05"}).values(m=Ref("o_orderdate__@yyyy_mm"), n=Count("*"))


@register("orders", "SELECT strftime(o_orderdate, '%Y-%m-%d') d, count(*) n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1995-03-15' GROUP BY 1")
def date(q):
    return q.filter({"o_orderdate__@date__@lte": "1995-03-15"}).values(d=Ref("o_orderdate__@date"), n=Count("*"))


@register("orders", "SELECT concat(CAST(extract(year FROM o_orderdate) AS VARCHAR), '-Q', CAST(extract(quarter FROM o_orderdate) AS VARCHAR)) qr, count(*) n FROM orders GROUP BY 1")
def quarter(q):
    return q.values(qr=QUARTER("o_orderdate"), n=Count("*"))


@register("orders", "SELECT concat(CAST(extract(year FROM o_orderdate) AS VARCHAR), '-Q', CAST(CASE WHEN extract(month FROM o_orderdate) <= 4 THEN 1 WHEN extract(month FROM o_orderdate) <= 8 THEN 2 ELSE 3 END AS VARCHAR)) qd, count(*) n FROM orders GROUP BY 1")
def quadrimester(q):
    return q.values(qd=Ref("o_orderdate__@quadrimester"), n=Count("*"))


@register("orders", "SELECT CAST(extract(year FROM o_orderdate) AS INT) y, count(*) n FROM orders GROUP BY 1")
def composed_transforms(q):
    return q.values(y=Ref("o_orderdate__@date__@year"), n=Count("*"))


@register("orders", "SELECT CAST(extract(dow FROM o_orderdate) AS INT) dow, CAST(extract(week FROM o_orderdate) AS INT) wk, count(*) n FROM orders GROUP BY 1, 2")
def extract_parts(q):
    return q.values(dow=Extract("o_orderdate", "DOW"), wk=Extract("o_orderdate", "WEEK", "::int"), n=Count("*"))


@register("orders", "SELECT strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') s, count(*) n FROM orders GROUP BY 1")
def to_char(q):
    return q.values(s=To_char("o_orderdate", "DD/MM/YYYY HH24:MI:SS"), n=Count("*"))


@register("orders", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) f, CAST(sum(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 50000 THEN 2 WHEN o_orderstatus = 'P' OR o_totalprice < 20000 THEN 1 ELSE 0 END) AS BIGINT) s FROM orders GROUP BY 1")
def sum_case(q):
    marks = Case([When(("o_orderstatus", "O"), {"o_totalprice__@gt": 50000}, then=2), When(Qor(("o_orderstatus", "P"), {"o_totalprice__@lt": 20000}), then=1)], default=0)
    return q.values("o_orderpriority", f=Sum(Case(When(("o_orderstatus", "F"), then=1), default=0)), s=Sum(marks))


@register("part", "SELECT p_partkey, CAST(p_size AS VARCHAR) v, CAST(p_retailprice AS BIGINT) b FROM part WHERE p_retailprice = round(p_retailprice)")
def cast(q):
    return q.filter((Cast("p_retailprice", "BIGINT"), Ref("p_retailprice"))).values("p_partkey", v=Cast("p_size", "VARCHAR(10)"), b=Cast("p_retailprice", "BIGINT"))


@register("supplier", "SELECT concat(s_name, '-', CAST(s_nationkey AS VARCHAR)) c FROM supplier")
def concat(q):
    return q.values(c=Concat(["s_name", Value("-"), Cast("s_nationkey", "VARCHAR")]))


@register("lineitem", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem WHERE l_quantity > l_linenumber * 5 GROUP BY 1")
def arithmetic(q):
    price = Ref("l_extendedprice") * (Value(1) - Ref("l_discount"))
    return q.filter({"l_quantity__@gt": Ref("l_linenumber") * 5}).values("l_returnflag", revenue=Sum(price)).list().withColumn("revenue", F.round("revenue", 2))


# ---- windows and set operations


@register("orders", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) k, count(*) OVER (PARTITION BY o_custkey) n FROM orders) WHERE k <= 3")
def window_top(q):
    ranked = q.values("o_custkey", "o_orderkey", k=Over("row_number", ["o_custkey"], ["-o_totalprice", "o_orderkey"]), n=Over(Count("*"), ["o_custkey"]))
    return ranked.list().where("k <= 3")


def _status(q: Query, status: str) -> Query:
    return q.source.query("orders").filter(o_orderstatus=status).values("o_custkey")


@register("orders", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def union(q):
    return _status(q, "F").union(_status(q, "P"))


@register("orders", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect(q):
    return _status(q, "F").intersect(_status(q, "P"))


@register("orders", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_(q):
    return _status(q, "F").except_(_status(q, "P"))


# ---- changes, on a store of their own


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return tempfile.mkdtemp(prefix="tamarack-store-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _filled_store(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> Store:
    registry = Registry(*tables.models(), settings=Settings(change_data=True, change_db=True))
    store = Store(spark, registry, _folder(spark))
    read = tables.source(spark, sf_dir)
    for name in names:
        dml.bulk_insert(store.query(name), read.load(registry.model(name)))
    return store


@register(None, "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'ATLANTIS', 1")
def insert(spark, sf_dir):
    store = _filled_store(spark, sf_dir, ("region", "nation"))
    dml.create(store.query("nation"), n_nationkey=25, n_name="ATLANTIS", n_regionkey=1)
    return store.query("nation").list()


@register(None, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END c_acctbal, c_mktsegment FROM customer")
def update(spark, sf_dir):
    store = _filled_store(spark, sf_dir, ("region", "nation", "customer"))
    dml.update(store.query("customer").filter({"c_acctbal__@lt": 0}), c_acctbal=0.0)
    return store.query("customer").list()


@register(None, "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN concat(c_name, '!') ELSE c_name END c_name FROM customer")
def bulk_update(spark, sf_dir):
    store = _filled_store(spark, sf_dir, ("region", "nation", "customer"))
    new = store.query("customer").filter(c_nationkey=3).values("c_custkey", c_name=Concat(["c_name", Value("!")])).list()
    dml.bulk_update(store.query("customer"), new)
    return store.query("customer").values("c_custkey", "c_name").list()


@register(None, "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey <> 2")
def delete_cascade(spark, sf_dir):
    store = _filled_store(spark, sf_dir, ("region", "nation", "customer", "orders"))
    dml.delete(store.query("region").filter(r_regionkey=2))
    return store.query("orders").values("o_orderkey").list()


@register(None, "SELECT CAST(s_suppkey AS BIGINT) s_suppkey, s_name supplier_name, CAST(0.5 AS DOUBLE) rating FROM supplier")
def migration(spark, sf_dir):
    store = _filled_store(spark, sf_dir, ("region", "nation", "supplier"))
    changed = Registry(Model("region", r_regionkey=IntegerField(primary_key=True), r_name=CharField(null=True)), Model("supplier", s_suppkey=IDField(), supplier_name=CharField(null=True), rating=FloatField(default=0.5)), settings=store.registry.settings)
    steps = migrate.plan(store, changed, renamed_fields={("supplier", "s_name"): "supplier_name"})
    migrate.apply(store, changed, steps)
    return Store(spark, changed, store.root).query("supplier").list()


def _customers(spark: SparkSession, sf_dir: str, key) -> Store:
    """A store of nations, and of customers whose ``c_nationkey`` is the given field."""
    models = Model("nation", n_nationkey=IntegerField(primary_key=True), n_name=CharField(null=True)), Model("customer", c_custkey=IDField(), c_nationkey=key)
    store = Store(spark, Registry(*models, settings=Settings(change_data=True, change_db=True)), _folder(spark))
    read = tables.source(spark, sf_dir)
    for m in models:
        dml.bulk_insert(store.query(m.name), read.load(read.registry.model(m.name)).select(*m.fields))
    return store


@register(None, "SELECT CAST(c_custkey AS BIGINT) c_custkey, CASE WHEN c_nationkey <> 3 THEN c_nationkey END c_nationkey FROM customer")
def delete_set_null(spark, sf_dir):
    store = _customers(spark, sf_dir, ForeignKey("nation", null=True, on_delete="SET_NULL"))
    dml.delete(store.query("nation").filter(n_nationkey=3))
    return store.query("customer").list()


@register(None, "SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n.n_nationkey)")
def delete_restrict(spark, sf_dir):
    """A deletion of all nations is refused; after that, one of those without customers goes through."""
    store = _customers(spark, sf_dir, ForeignKey("nation", on_delete="RESTRICT"))
    try:
        dml.delete(store.query("nation"), allow_delete_all=True)
    except DataError:
        dml.delete(store.query("nation").filter({"n_nationkey__@nin": store.query("customer").values("c_nationkey")}))
    return store.query("nation").list()


@register(None, "SELECT CAST(c_custkey AS BIGINT) c_custkey, n_name nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def foreign_key_added(spark, sf_dir):
    store = _customers(spark, sf_dir, BigIntegerField(null=True))
    changed = Registry(store.registry.model("nation"), Model("customer", c_custkey=IDField(), c_nationkey=ForeignKey("nation")), settings=store.registry.settings)
    migrate.apply(store, changed, migrate.plan(store, changed))
    return Store(spark, changed, store.root).query("customer").values("c_custkey", nation=Ref("c_nationkey__n_name")).list()


@register(None, "SELECT r_regionkey, r_name FROM region")
def csv_source(spark, sf_dir):
    folder = _folder(spark)
    registry = Registry(*tables.models())
    tables.source(spark, sf_dir).load(registry.model("region")).write.option("header", True).option("nullValue", "\\N").csv(f"{folder}/region.csv")
    return CsvSource(spark, registry, folder).query("region").list()


@register(None, "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000")
def inferred_models(spark, sf_dir):
    read = tables.source(spark, sf_dir)
    made = [Model.from_schema(n, read.load(read.registry.model(n)).schema, key) for n, key in (("orders", "o_orderkey"), ("customer", "c_custkey"))]
    made[0].fields["o_custkey"] = ForeignKey("customer", null=True)
    made[0].fields["o_custkey"].name = "o_custkey"
    return type(read)(spark, Registry(*made), sf_dir).query("orders").filter({"o_totalprice__@gt": 100000}).values("o_orderkey", c_name=Ref("o_custkey__c_name")).list()


# ---- event time


def _events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The stream of events, run to its end into a folder of results."""
    model = Registry(*tables.models()).model("events")
    rows = windows.stream(spark, model, sf_dir, "events.parquet")
    folder = _folder(spark)
    windows.run_available(windows.windowed(rows, model, "ts", {"n": Count("*"), "v": Sum("value")}, late="0 seconds", **options), f"{folder}/out", f"{folder}/log", "append")
    return spark.read.parquet(f"{folder}/out")


@register(None, "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) s, event_type, count(*) n, round(sum(value), 2) v FROM events GROUP BY 1, 2) SELECT s window_start, event_type, n, v FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def stream_tumbling(spark, sf_dir):
    return _events(spark, sf_dir, by=("event_type",), size="1 hour").select("window_start", "event_type", "n", F.round("v", 2).alias("v"))


@register("events", "SELECT s + INTERVAL (30 * k) MINUTE window_start, count(*) n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE s, unnest([0, 1]) k FROM events) GROUP BY 1")
def sliding_window(q):
    return windows.windowed(q.list(), q.model, "ts", {"n": Count("*")}, size="1 hour", slide="30 minutes").select("window_start", "n")


@register("events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) window_start, max(ts) + INTERVAL 30 MINUTE window_end, count(*) n FROM s GROUP BY user_id, k")
def session_window(q):
    return windows.windowed(q.list(), q.model, "ts", {"n": Count("*")}, by=("user_id",), gap="30 minutes")

