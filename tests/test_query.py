import datetime

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tamarack as tk
from tamarack.errors import FieldError, LookupSyntaxError
from tamarack.functions.formats import spark_pattern
from tamarack.sources.source import FrameSource

NTZ = dict(with_zone=False, null=True)


def models(**fk):
    return tk.Model("city", id=tk.IDField(), name=tk.TextField(null=True)), tk.Model("team", key=tk.IDField(), label=tk.TextField(null=True), city=tk.ForeignKey("city", null=True, **fk)), tk.Model("game", id=tk.IDField(), home=tk.ForeignKey("team"), away=tk.ForeignKey("team", related_name="visits"), goals=tk.IntegerField(null=True), at=tk.DateTimeField(**NTZ))


@pytest.fixture
def source(spark):
    return make(spark)


def make(spark, settings=None, **fk):
    day = datetime.datetime
    frames = {
        "city": spark.createDataFrame([(1, "Oslo"), (2, "a%b_c\\d'e"), (3, None)], "id long, name string"),
        "team": spark.createDataFrame([(10, "x", 1), (20, "y", 2), (30, "z", None)], "key long, label string, city long"),
        "game": spark.createDataFrame([(1, 10, 20, 3, day(2020, 3, 31, 23)), (2, 20, 10, None, day(2020, 4, 30)), (3, 10, 30, 1, day(2020, 5, 1)), (4, 30, 10, 2, day(2020, 8, 31)), (5, 30, 20, 2, day(2020, 12, 31)), (6, 10, 20, 0, None)], "id long, home long, away long, goals int, at timestamp_ntz"),
    }
    return FrameSource(spark, tk.Registry(*models(**fk), settings=settings), frames)


def rows(q):
    return [tuple(r) for r in (q.list() if isinstance(q, tk.Query) else q).collect()]


def test_two_paths_to_one_table_do_not_share_a_join(source):
    q = source.query("game").values(h=tk.Ref("home__city__name"), a=tk.Ref("away__city__name")).order_by("id")
    assert rows(q) == [("Oslo", "a%b_c\\d'e"), ("a%b_c\\d'e", "Oslo"), ("Oslo", "a%b_c\\d'e")]
    again = source.query("game").filter(home__city__name="Oslo").values("home__city__name", "home__label").order_by("home__city__id", "id")
    assert again.explain().count("HashJoin") + again.explain().count("SortMergeJoin Inner") <= 4 and len(rows(again)) == 3


def test_join_types(spark):
    inner = make(spark).query("team").values("label", "city__name").order_by("label")
    assert rows(inner) == [("x", "Oslo"), ("y", "a%b_c\\d'e")]
    for q in (make(spark, how="LEFT"), make(spark, settings=tk.Settings(nullable_fk_left=True))):
        assert rows(q.query("team").values("label", "city__name").order_by("label"))[2] == ("z", None)
    full = make(spark, how="FULL").query("team").values("label", "city__id")
    assert len(rows(full)) == 4 and len(rows(make(spark, how="RIGHT").query("team").values("label", "city__id"))) == 3


def test_reverse_paths_and_columns(source):
    q = source.query("city").values("name", n=tk.Count("team__visits__id"), m=tk.Max("team__game__goals")).order_by("-n")
    assert rows(q) == [("Oslo", 6, 3), ("a%b_c\\d'e", 3, None)]
    assert source.query("team").list().columns == ["key", "label", "city"]
    assert source.query("game").filter(home__city__name="Oslo").list().columns == ["id", "home", "away", "goals", "at"]


def test_filters(source):
    ids = lambda *c, **k: [r[0] for r in rows(source.query("game").filter(*c, **k).values("id").order_by("id"))]
    assert ids({"goals__@isnull": True}) == [2] and ids({"goals__@in": []}) == [] and ids({"goals__@nin": [2, 3]}) == [3, 6]
    assert ids({"goals__@neq": 2}) == [1, 3, 6] and ids(~tk.Q(goals=2)) == [1, 3, 6]
    assert ids(tk.OP("goals", ">=", tk.Ref("id"))) == [1] and ids(tk.OP(tk.Ref("goals") + 1, 3)) == [4, 5]
    assert ids(tk.Q(goals=2) & tk.Q(home=30)) == [4, 5] and ids(tk.Qor(("goals", 3), tk.Q({"goals__@lt": 1}))) == [1, 6]
    assert ids({"home__@in": source.query("team").filter(label="z").values("key")}) == [4, 5]
    nulls = source.query("game").values("goals")
    assert ids({"id__@nin": nulls}) == [] and ids({"id__@nin": nulls.filter({"goals__@isnull": False})}) == [4, 5, 6]
    assert ids(tk.Qor({"home__@in": source.query("team").filter(label="z").values("key")}, id=1)) == [1, 4, 5]
    assert ids(F.col("Tb__goals") > 2, {"goals__@gt": 0}) == [1]
    name = lambda **k: [r[0] for r in rows(source.query("city").filter({f"name__@{a}": b for a, b in k.items()}).values("id"))]
    assert name(contains="%") == [1, 2] and name(contains="b_c") == [2] and name(contains="\\") == [2] and name(contains="d'e") == [2] and name(icontains="OS_O") == [1] and name(contains="os") == []
    q = source.query("game").filter(home=10)
    assert len(rows(q)) == 3 and len(rows(q.filter(goals=1))) == 1 and q.count() == 1 and q.exists() and not q.exclude(goals=1).exists()


def test_ranges_reach_the_scan_and_agree(source, spark, tmp_path):
    import itertools

    path = str(tmp_path / "g.parquet")
    source.frames["game"].write.parquet(path)
    source.frames["game"] = spark.read.parquet(path)
    for transform, values in (("year", [2019, 2020]), ("yyyy_mm", ["2020-04", "2020-12", "x"]), ("date", ["2020-04-30", "2020-05-02"])):
        for op, value in itertools.product(("", "__@lt", "__@lte", "__@gt", "__@gte"), values):
            q = source.query("game").filter({f"at__@{transform}{op}": value}).values("id")
            plain = {"year": F.year("at"), "yyyy_mm": F.date_format("at", "yyyy-MM"), "date": F.date_format("at", "yyyy-MM-dd")}[transform]
            test = {"": plain == value, "__@lt": plain < value, "__@lte": plain <= value, "__@gt": plain > value, "__@gte": plain >= value}[op]
            assert sorted(rows(q)) == sorted((r.id,) for r in source.frames["game"].where(test).collect()), (transform, op, value)
    assert "GreaterThanOrEqual(at,2020-01-01" in source.query("game").filter({"at__@year": 2020}).values("id").explain()


def test_transforms_at_their_edges(source):
    q = source.query("game").values("id", "at__@quarter", "at__@quadrimester", ym=tk.Y_M("at"), dow=tk.Extract("at", "dow"), c=tk.Ref("at__@yyyy_mm__@month"), t=tk.To_char("at", 'DD "of" Month')).order_by("id")
    assert rows(q)[0][1:] == ("2020-Q1", "2020-Q1", "2020-03", 2, 3, "31 of March") and [r[2] for r in rows(q)] == ["2020-Q1", "2020-Q1", "2020-Q2", "2020-Q2", "2020-Q3", None]
    assert spark_pattern("YYYY-MM-DDTHH24:MI:SS.SSS") == "yyyy-MM-dd'T'HH:mm:ss.SSS"


def test_expressions(source):
    q = source.query("game").values("id", c=tk.Concat(["home__label", tk.Value("-"), "goals"]), k=tk.Case([tk.When({"goals__@gte": 2}, then="many"), tk.When(tk.OP("goals", "isnull", True), then="none")], default="few"), d=tk.Cast("goals", tk.BigIntegerField()), w=tk.When(goals_two(), then=1, _else=9), r=tk.Over("row_number", ["home"], ["-id"]), s=tk.Over(tk.Sum("goals"), ["home"])).order_by("id")
    assert rows(q)[:2] == [(1, "x-3", "many", 3, 9, 3, 4), (2, "y-", "none", None, 9, 1, None)]


def goals_two():
    return tk.Q(goals=2)


def test_groups(source):
    q = source.query("game").values("home__label", n=tk.Count("*"), g=tk.Sum("goals", distinct=True)).filter({"n__@gt": 1}).order_by("-g")
    assert rows(q) == [("x", 3, 4), ("z", 2, 2)] and q.count() == 2
    assert rows(source.query("game").values(n=tk.Count("goals"), a=tk.Avg("goals", distinct=True))) == [(5, 1.5)]
    assert rows(source.query("game").values("home", x=tk.Sum(tk.Ref("goals") * 2) + tk.Count("*")).order_by("home")) == [(10, 11), (20, None), (30, 10)]
    with pytest.raises(LookupSyntaxError):
        rows(source.query("game").values("home", n=tk.Count("*")).filter(tk.Qor({"n__@gt": 1}, goals=1)))


def test_order_and_page(source):
    ids = lambda *k: [r[0] for r in rows(source.query("game").values("id").order_by(*k))]
    assert ids("goals", "id")[-1] == 2 and ids("-goals", "id")[0] == 2
    assert [r[0] for r in rows(source.query("game").values("id").order_by("id").page(2, 3))] == [4, 5]
    assert len(rows(source.query("game").page(0, 4).order_by("id"))) == 2 and source.query("game").page(1).count() == 6
    assert rows(source.query("game").values("home").distinct().order_by("-home")) == [(30,), (20,), (10,)]


def test_errors(source):
    q = lambda: source.query("game")
    for wrong, error in ((lambda: q().values("nope").list(), FieldError), (lambda: q().values("home__nope__x").list(), FieldError), (lambda: q().filter(home__name=1).list(), FieldError), (lambda: q().values(tk.Count("id")), LookupSyntaxError), (lambda: q().values("id__@gte"), LookupSyntaxError), (lambda: q().order_by("id__@lt"), LookupSyntaxError), (lambda: q().filter({"id__@contains": 3}), LookupSyntaxError), (lambda: q().filter(goals=None).list(), LookupSyntaxError), (lambda: tk.OP("a", "~", 1), LookupSyntaxError), (lambda: q().filter(), LookupSyntaxError), (lambda: q().filter({"id__@in": source.query("team")}).list(), LookupSyntaxError), (lambda: tk.Sum(tk.Max("a")), LookupSyntaxError), (lambda: tk.Cast("a", "SHAPE") and q().values(x=tk.Cast("id", "SHAPE")).list(), LookupSyntaxError), (lambda: q().values("id", id=tk.Ref("home")), LookupSyntaxError), (lambda: q().page(-1), LookupSyntaxError)):
        with pytest.raises(error):
            wrong()


CONDITION = st.recursive(st.tuples(st.sampled_from(["o_totalprice", "o_custkey", "o_orderkey"]), st.sampled_from(["", "gt", "gte", "lt", "lte", "neq"]), st.integers(0, 900)), lambda c: st.tuples(st.sampled_from(["and", "or", "not"]), st.lists(c, min_size=1, max_size=3)), max_leaves=5)


def both(c):
    if len(c) == 3:
        op = {"": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "neq": "<>"}[c[1]]
        value = c[2] * (100 if c[0] == "o_totalprice" else 1)
        return tk.Q((c[0] + (f"__@{c[1]}" if c[1] else ""), value)), f"{c[0]} {op} {value}"
    parts = [both(x) for x in c[1]]
    if c[0] == "not":
        return ~tk.Q(*[p[0] for p in parts]), "NOT (" + " AND ".join(p[1] for p in parts) + ")"
    return (tk.Q if c[0] == "and" else tk.Qor)(*[p[0] for p in parts]), "(" + f" {c[0]} ".join(p[1] for p in parts) + ")"


@settings(max_examples=12, deadline=None)
@given(CONDITION)
def test_random_conditions_agree_with_sql(spark, condition):
    from tamarack import tables

    q, sql = both(condition)
    want = duckdb.sql(f"SELECT count(*) FROM '/root/testdata/sf0.001/orders.parquet' WHERE {sql}").fetchall()[0][0]
    assert tables.source(spark, "/root/testdata/sf0.001").query("orders").filter(q).count() == want
