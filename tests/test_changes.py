import datetime
import decimal

import pytest

import tamarack as tk
from tamarack.errors import DataError, FieldError, GuardError
from tamarack.operators import dml, migrate
from tamarack.sources.source import read_csv
from tamarack.sources.store import Store


def registry(**settings):
    return tk.Registry(
        tk.Model("club", id=tk.IDField(), name=tk.CharField(max_length=8, unique=True), kind=tk.CharField(max_length=3, default="fc", choices=["fc", "sc"])),
        tk.Model("player", id=tk.IDField(), name=tk.TextField(), club=tk.ForeignKey("club"), coach=tk.ForeignKey("player", null=True, on_delete="SET_NULL", related_name="pupils"), fee=tk.DecimalField(max_digits=5, decimal_places=2, null=True), joined=tk.DateField(auto_now_add=True), seen=tk.DateTimeField(auto_now=True)),
        tk.Model("award", id=tk.IDField(), player=tk.ForeignKey("player", on_delete="RESTRICT")),
        tk.Model("note", text=tk.TextField(null=True), player=tk.ForeignKey("player")),
        tk.Model("fan", id=tk.IDField(), club=tk.ForeignKey("club", null=True, default=1, on_delete="SET_DEFAULT")),
        settings=tk.Settings(**{"change_data": True, "change_db": True} | settings),
    )


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, registry(), str(tmp_path / "store"))
    tk.bulk_insert(made.query("club"), spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, name string"))
    tk.bulk_insert(made.query("player"), spark.createDataFrame([(1, "ann", 1, None), (2, "bob", 1, 1), (3, "cy'd", 2, 1), (4, "dee", 2, 3)], "id int, NAME string, team long, coach long"), ["id", "NAME", ("team", "club"), "coach"])
    tk.bulk_insert(made.query("award"), spark.createDataFrame([(1, 1)], "id long, player long"))
    tk.bulk_insert(made.query("note"), spark.createDataFrame([("a", 4), ("a", 4), ("b", 2)], "text string, player long"))
    tk.bulk_insert(made.query("fan"), spark.createDataFrame([(1, 2), (2, None), (3, 3)], "id long, club long"))
    return made


def rows(q, *columns):
    return sorted((tuple(r) for r in q.values(*columns).list().collect()), key=str)


def test_insert_fills_and_checks(store, spark):
    assert rows(store.query("club"), "id", "kind") == [(1, "fc"), (2, "fc"), (3, "fc")]
    first = store.query("player").filter(id=3).list().first()
    assert first.name == "cy'd" and first.joined <= datetime.date.today() + datetime.timedelta(1) and first.seen is not None and first.fee is None
    made = tk.create(store.query("player"), name="eve", club=1, fee="12.50")
    assert made["id"] == 5 and made["fee"] == decimal.Decimal("12.50") and store.query("player").count() == 5
    more = spark.createDataFrame([(f"p{k}", 1) for k in range(20)], "name string, club long").repartition(3)
    assert tk.bulk_insert(store.query("player"), more) == 20
    assert [r[0] for r in rows(store.query("player").filter({"id__@gt": 5}), "id")] == sorted(range(6, 26), key=lambda k: str((k,)))
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    before = store.manifest()["version"]
    for wrong, what in (
        (lambda: tk.bulk_insert(store.query("club"), frame([(9, None)], "id long, name string")), "name is null"),
        (lambda: tk.bulk_insert(store.query("club"), frame([(9, "x" * 9)], "id long, name string")), "longer than 8"),
        (lambda: tk.bulk_insert(store.query("club"), frame([(9, "x", "zz")], "id long, name string, kind string")), "choices"),
        (lambda: tk.bulk_insert(store.query("club"), frame([(1, "x")], "id long, name string")), "exists already: 1"),
        (lambda: tk.bulk_insert(store.query("club"), frame([(8, "x"), (9, "x")], "id long, name string")), "exists already: x"),
        (lambda: tk.bulk_insert(store.query("player"), frame([("x", 99)], "name string, club long")), "club has no 99"),
        (lambda: tk.bulk_insert(store.query("player"), frame([("x",)], "name string")), "club is asked for"),
        (lambda: tk.create(store.query("player"), name="x", club=1, fee=1000), "digits"),
    ):
        with pytest.raises(DataError, match=what):
            wrong()
    with pytest.raises(FieldError):
        tk.create(store.query("club"), nope=1)
    assert store.manifest()["version"] == before


def test_update(store):
    assert tk.update(store.query("player").filter({"name__@contains": "b"}), name="bobby", fee=1) == 1
    assert rows(store.query("player").filter({"fee__@isnull": False}), "id", "name") == [(2, "bobby")]
    assert tk.update(store.query("player").filter(id=99), name="x") == 0
    for wrong in (lambda: tk.update(store.query("player"), name="x"), lambda: tk.update(store.query("player").filter(id=1), id=7), lambda: tk.update(store.query("player").filter(club__name="one"), name="x"), lambda: tk.update(store.query("player").filter(id=1), club=77), lambda: tk.update(store.query("club").filter(id=1), name="x" * 9)):
        with pytest.raises(DataError):
            wrong()


def test_bulk_update(store, spark):
    new = spark.createDataFrame([(1, "A"), (4, "D"), (99, "Z")], "id long, n string")
    assert tk.bulk_update(store.query("player"), new, ["id", ("n", "name")]) == 2
    assert rows(store.query("player"), "id", "name") == [(1, "A"), (2, "bob"), (3, "cy'd"), (4, "D")]
    by_club = spark.createDataFrame([(2, 7.5)], "club long, fee double")
    assert tk.bulk_update(store.query("player").filter({"id__@gt": 3}), by_club, keys=["club"]) == 1
    with pytest.raises(DataError, match="twice"):
        tk.bulk_update(store.query("player"), new.union(new), ["id", ("n", "name")])
    with pytest.raises(DataError):
        tk.bulk_update(store.query("note"), new.selectExpr("n AS text"))


def test_delete_cascades(store):
    with pytest.raises(DataError, match="refers to rows of player"):
        tk.delete(store.query("player").filter(id=1))
    assert tk.delete(store.query("club").filter(id=2)) == (5, {"club": 1, "player": 2, "note": 2})
    assert rows(store.query("player"), "id", "coach") == [(1, None), (2, 1)] and store.query("note").count() == 1
    assert rows(store.query("fan"), "id", "club") == [(1, 1), (2, 1), (3, 3)]
    tk.delete(store.query("award"), allow_delete_all=True)
    assert tk.delete(store.query("player").filter(id=1))[1] == {"player": 1} and rows(store.query("player"), "id", "coach") == [(2, None)]
    with pytest.raises(DataError):
        tk.delete(store.query("player"))
    assert tk.delete(store.query("player").filter(id=77)) == (0, {})


def test_guards_and_order(spark, tmp_path):
    closed = Store(spark, registry(change_data=False, change_db=False), str(tmp_path / "c"))
    one = spark.createDataFrame([(1, "x")], "id long, name string")
    for change in (lambda: tk.bulk_insert(closed.query("club"), one), lambda: tk.create(closed.query("club"), name="x"), lambda: tk.update(closed.query("club").filter(id=1), name="y"), lambda: tk.delete(closed.query("club").filter(id=1)), lambda: tk.bulk_update(closed.query("club"), one), lambda: migrate.apply(closed, closed.registry, [])):
        with pytest.raises(GuardError):
            change()
    order = dml.deletion_order(list(closed.registry.models.values()))
    assert order.index("award") < order.index("player") < order.index("club")
    a, b = tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("b")), tk.Model("b", id=tk.IDField(), a=tk.ForeignKey("a"))
    tk.Registry(a, b)
    with pytest.raises(DataError, match="circle"):
        dml.deletion_order([a, b])


def test_cascade_in_a_circle(spark, tmp_path):
    a, b = tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("b", null=True)), tk.Model("b", id=tk.IDField(), a=tk.ForeignKey("a"))
    store = Store(spark, tk.Registry(a, b, settings=tk.Settings(change_data=True)), str(tmp_path))
    tk.bulk_insert(store.query("a"), spark.createDataFrame([(1, None), (2, None), (3, None)], "id long, b long"))
    tk.bulk_insert(store.query("b"), spark.createDataFrame([(1, 1), (2, 2)], "id long, a long"))
    tk.update(store.query("a").filter(id=2), b=1)
    tk.update(store.query("a").filter(id=1), b=2)
    assert tk.delete(store.query("a").filter(id=1)) == (4, {"a": 2, "b": 2}) and rows(store.query("a"), "id") == [(3,)]


def test_commits_are_whole(store):
    manifest = store.manifest()
    tk.update(store.query("club").filter(id=1), kind="sc")
    with pytest.raises(RuntimeError):
        store.commit(manifest)
    assert rows(store.query("club").filter(kind="sc"), "id") == [(1,)]


def test_migrations(store, spark, tmp_path):
    changed = tk.Registry(
        tk.Model("society", id=tk.IDField(), title=tk.CharField(max_length=20), founded=tk.IntegerField(default=1900), note=tk.TextField(null=True)),
        tk.Model("fan", id=tk.IDField(), club=tk.FloatField(null=True)),
        tk.Model("ground", id=tk.IDField(), society=tk.ForeignKey("society", null=True)),
        settings=store.registry.settings,
    )
    steps = migrate.plan(store, changed, renamed_tables={"club": "society"}, renamed_fields={("club", "name"): "title"})
    assert [(s.action, s.table, s.field) for s in steps] == [("new_model", "ground", None), ("drop_table", "award", None), ("drop_table", "note", None), ("drop_table", "player", None), ("rename_table", "club", None), ("rename_field", "society", "name"), ("add_field", "society", "founded"), ("add_field", "society", "note"), ("remove_field", "society", "kind"), ("alter_field", "society", "title"), ("alter_field", "fan", "club")]
    migrate.save(steps, str(tmp_path / "plan.json"))
    assert migrate.read(str(tmp_path / "plan.json")) == steps
    migrate.apply(store, changed, steps)
    after = Store(spark, changed, store.root)
    assert rows(after.query("society"), "id", "title", "founded", "note") == [(1, "one", 1900, None), (2, "two", 1900, None), (3, "three", 1900, None)]
    assert rows(after.query("fan"), "club") == [(1.0,), (2.0,), (3.0,)] and after.query("ground").count() == 0 and migrate.plan(after, changed) == []
    short = tk.Registry(tk.Model("society", id=tk.IDField(), title=tk.CharField(max_length=4), founded=tk.IntegerField(), note=tk.TextField(null=True)), settings=store.registry.settings)
    with pytest.raises(DataError, match="longer than 4"):
        migrate.apply(after, short, migrate.plan(after, short))
    strict = tk.Registry(tk.Model("society", id=tk.IDField(), extra=tk.IntegerField()), settings=store.registry.settings)
    with pytest.raises(DataError, match="asks for a default"):
        migrate.apply(after, strict, migrate.plan(after, strict))


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('circuitId,Name,lat\n1,"Spa, \\""x\\""",50.4\n2,\\N,\\N\n')
    m = tk.Model("circuit", circuitid=tk.IDField(), name=tk.TextField(null=True), lat=tk.FloatField(null=True))
    got = [tuple(r) for r in read_csv(spark, str(path), m).collect()]
    assert got[1] == (2, None, None) and got[0][0] == 1 and got[0][2] == 50.4


def test_updates_keep_keys_and_references(store, spark):
    before = store.manifest()["version"]
    frame = spark.createDataFrame
    for wrong, what in (
        (lambda: tk.bulk_update(store.query("player"), frame([(1, 99)], "id long, club long")), "club has no 99"),
        (lambda: tk.bulk_update(store.query("club"), frame([(1, "same"), (2, "same")], "id long, name string")), "exists already: same"),
        (lambda: tk.bulk_update(store.query("club"), frame([(1, "two")], "id long, name string")), "exists already: two"),
        (lambda: tk.update(store.query("club").filter({"id__@lte": 2}), name="dup"), "exists already: dup"),
        (lambda: tk.update(store.query("player").filter(id=1), club=99), "club has no 99"),
    ):
        with pytest.raises(DataError, match=what):
            wrong()
    assert store.manifest()["version"] == before
    assert tk.bulk_update(store.query("club"), frame([(1, "two"), (2, "one")], "id long, name string")) == 2
    assert tk.update(store.query("club").filter(id=3), name="last") == 1


def test_one_of_two_writers_wins(store):
    mine, theirs = store.manifest(), store.manifest()
    assert store.commit(mine) == mine["version"] + 1
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        store.commit(theirs)


def test_vacuum(store):
    was = {n: sorted(map(str, store.query(n).list().collect())) for n in ("club", "player", "note")}
    tk.update(store.query("club").filter(id=3), kind="sc")
    assert store.vacuum(keep=2) == 0 and store.vacuum() == 1 and store.vacuum() == 0
    assert sorted(map(str, store.query("player").list().collect())) == was["player"] and sorted(map(str, store.query("note").list().collect())) == was["note"]
    tk.update(store.query("club").filter(id=3), kind="fc")
    assert sorted(map(str, store.query("club").list().collect())) == was["club"]


def test_added_foreign_keys_are_checked_on_stored_rows(spark, tmp_path):
    settings = tk.Settings(change_data=True, change_db=True)
    plain = tk.Registry(tk.Model("club", id=tk.IDField()), tk.Model("fan", id=tk.IDField(), club=tk.BigIntegerField(null=True)), settings=settings)
    store = Store(spark, plain, str(tmp_path / "keys"))
    tk.bulk_insert(store.query("club"), spark.createDataFrame([(1,)], "id long"))
    tk.bulk_insert(store.query("fan"), spark.createDataFrame([(1, 1), (2, None), (3, 7)], "id long, club long"))

    def keyed(rule):
        return tk.Registry(tk.Model("club", id=tk.IDField()), tk.Model("fan", id=tk.IDField(), club=tk.ForeignKey("club", null=True, on_delete=rule)), settings=settings)

    before = store.manifest()
    steps = migrate.plan(store, keyed("CASCADE"))
    assert [(s.action, s.field, s.changes) for s in steps] == [("alter_field", "club", {"references": [None, "club"], "on_delete": [None, "CASCADE"]})]
    with pytest.raises(DataError, match="7"):
        migrate.apply(store, keyed("CASCADE"), steps)
    assert store.manifest() == before
    tk.delete(store.query("fan").filter(id=3))
    migrate.apply(store, keyed("CASCADE"), migrate.plan(store, keyed("CASCADE")))
    after = Store(spark, keyed("SET_NULL"), store.root)
    assert migrate.plan(after, keyed("CASCADE")) == []
    assert [s.changes for s in migrate.plan(after, after.registry)] == [{"on_delete": ["CASCADE", "SET_NULL"]}]
    assert after.query("fan").count() == 2
