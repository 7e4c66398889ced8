import datetime
import decimal

import pytest
from pyspark.sql import types as T

import tamarack as tk
from tamarack import settings as S
from tamarack.errors import FieldError, LookupSyntaxError, ModelError
from tamarack.lookups import Lookup, parse
from tamarack.sources import importers
from tamarack.sources.source import JdbcSource


def test_lookups():
    assert parse("raceid__circuitid__name") == Lookup(("raceid", "circuitid", "name"))
    assert parse("d__@date__@year__@gte", compares=True) == Lookup(("d",), ("date", "year"), ">=")
    assert parse("d__@yyyy_mm").alias == "d__yyyy_mm"
    for bad in ("a__@nope", "@year", "a____b", "a__@gte__@year", "a__@year__b", ""):
        with pytest.raises(LookupSyntaxError):
            parse(bad, compares=True)
    with pytest.raises(LookupSyntaxError, match="no place"):
        parse("a__@gte")


def test_fields_check_their_options():
    for bad in (
        lambda: tk.CharField(max_length=0),
        lambda: tk.CharField(max_length=256),
        lambda: tk.CharField(max_length=True),
        lambda: tk.CharField(max_length=3, default="four"),
        lambda: tk.CharField(choices=[("a", "A")], default="b"),
        lambda: tk.IntegerField(default="x"),
        lambda: tk.IntegerField(null="yes"),
        lambda: tk.IntegerField(size=3),
        lambda: tk.IntegerField(primary_key=True, null=True),
        lambda: tk.DecimalField(max_digits=3, decimal_places=4),
        lambda: tk.BooleanField(default="maybe"),
        lambda: tk.DateField(default="1/2/2020"),
        lambda: tk.ForeignKey("x", how="SIDEWAYS"),
        lambda: tk.ForeignKey("x", on_delete="EXPLODE"),
    ):
        with pytest.raises(ModelError):
            bad()
    assert tk.BooleanField().convert("1") is True and tk.IntegerField().convert("7") == 7 and tk.FloatField().convert("2") == 2.0
    assert tk.DateField().convert(datetime.datetime(2020, 1, 2, 3)) == datetime.date(2020, 1, 2) == tk.DateField().convert("2020-01-02")
    assert tk.DecimalField(max_digits=5).convert("1.25") == decimal.Decimal("1.25") and tk.DecimalField(max_digits=5).spark_type == T.DecimalType(5, 2)
    assert tk.CharField(default="it's").default == "it's"
    assert tk.ForeignKey("x", on_delete="models.SET_NULL", null=True).on_delete == "SET_NULL"
    assert tk.OneToOneField("x").unique and tk.IDField().primary_key and tk.DurationField().spark_type == T.DayTimeIntervalType()


def test_names_and_graph():
    with pytest.raises(ModelError):
        tk.Model("t", a__b=tk.TextField())
    with pytest.raises(ModelError):
        tk.Model("t", a=1)
    m = tk.Model("T", _End=tk.TextField(), A=tk.IDField())
    assert m.name == "t" and list(m.fields) == ["end", "a"] and m.pk == "a"
    team = tk.Model("team", code=tk.CharField(primary_key=True, max_length=3), name=tk.TextField())
    game = tk.Model("game", id=tk.IDField(), home=tk.ForeignKey("team"), away=tk.ForeignKey(team), won=tk.ForeignKey("team", related_name="wins", null=True), cup=tk.OneToOneField("team", related_name="cup"))
    tk.Registry(team, game)
    assert set(team.related) == {"game", "game_away", "wins", "cup"} and game.fields["home"].spark_type == T.StringType()
    assert game.edge("home").target_key == "code" and team.edge("wins").target is game
    with pytest.raises(FieldError, match="name"):
        team.field("nope")
    for bad in (
        [tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("missing"))],
        [tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("a", on_delete="SET_NULL"))],
        [tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("a", on_delete="SET_DEFAULT"))],
        [tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("a", related_name="x"), c=tk.ForeignKey("a", related_name="x"))],
        [tk.Model("a", id=tk.IDField(), b=tk.ForeignKey("a", pk_field="nope"))],
    ):
        with pytest.raises(ModelError):
            tk.Registry(*bad)


def test_schema_and_source_round_trip():
    m = tk.Model("thing", id=tk.IDField(), name=tk.CharField(max_length=9, default="x"), price=tk.DecimalField(max_digits=7, decimal_places=3, null=True), at=tk.DateTimeField(auto_now=True), other=tk.ForeignKey("thing", null=True, how="left", related_name="others"))
    tk.Registry(m)
    back = tk.Model.from_schema("thing", T.StructType.fromJson(__import__("json").loads(m.schema().json())))
    assert back.fields["name"].max_length == 9 and back.fields["price"].spark_type == T.DecimalType(7, 3) and back.pk == "id"
    names = {n: getattr(tk, n) for n in ("Model", "IDField", "CharField", "DecimalField", "DateTimeField", "ForeignKey")}
    exec(m.to_source(), names)
    again = names["Thing"]
    tk.Registry(again)
    assert all(again.fields[n].same_column(f) for n, f in m.fields.items()) and again.to_source() == m.to_source()


def test_written_source_can_be_imported(tmp_path):
    import importlib.util

    a, b = tk.Model("class", id=tk.IDField(), size=tk.IntegerField(default=3)), tk.Model("pupil", id=tk.IDField(), room=tk.ForeignKey("class", null=True))
    tk.Registry(a, b)
    importers.write_source([a, b], str(tmp_path / "made.py"))
    spec = importlib.util.spec_from_file_location("made", tmp_path / "made.py")
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    tk.Registry(made._class, made.Pupil)
    assert made._class.fields["size"].default == 3 and made.Pupil.edge("room").target is made._class


def test_django():
    made = importers.from_django(
        """
from django.db import models
class Author(models.Model):
    name = models.CharField(max_length=40, default="it's, (odd)")
    born = models.DateField(null=True, default=timezone.now)
    boss = models.ForeignKey('self', models.SET_NULL, null=True, related_name='staff')
    class Meta:
        db_table = 'people'
class Book(models.Model):
    isbn = models.CharField(max_length=13, primary_key=True)
    title = models.CharField(max_length=900)
    writer = models.ForeignKey(to='app.Author', on_delete=models.CASCADE)
    tags = models.JSONField()
    def __str__(self): return self.isbn
class Helper: pass
"""
    )
    people, book = made
    assert people.name == "people" and list(people.fields) == ["id", "name", "born", "boss"] and people.fields["name"].default == "it's, (odd)"
    assert book.pk == "isbn" and type(book.fields["title"]).__name__ == "TextField" and book.fields["writer"].target_name == "Author"


def test_settings(tmp_path, monkeypatch, spark):
    path = S.scaffold(str(tmp_path / "db"))
    assert S.Settings.from_yaml(path).change_data is False and S.scaffold(str(tmp_path / "db")) == path
    (tmp_path / "c.yml").write_text("# x\ndev:\n  adapter: PostgreSQL\n  host: h # here\n  port: 5433\n  database: 'd b'\n  config:\n    change_data: true\n    time_zone: Europe/Paris\nprod:\n  adapter: SQLite\n  database: f.db\n")
    dev = S.Settings.from_yaml(str(tmp_path / "c.yml"))
    assert (dev.port, dev.database, dev.change_data, dev.change_db, dev.time_zone) == (5433, "d b", True, False, "Europe/Paris")
    monkeypatch.setenv(S.ENV_VARIABLE, "prod")
    prod = S.Settings.from_yaml(str(tmp_path / "c.yml"))
    m = tk.Model("t", id=tk.IDField())
    assert JdbcSource(spark, tk.Registry(m, settings=prod)).url() == "jdbc:sqlite:f.db"
    made = JdbcSource(spark, tk.Registry(m, settings=dev), {"t": ("id", 1, 9, 4)}).options(m)
    assert made["url"] == "jdbc:postgresql://h:5433/d b" and made["numPartitions"] == "4" and made["dbtable"] == "t"
    with pytest.raises(ValueError):
        S.Settings.from_yaml(path, "nowhere")
    S.connect("main", dev)
    assert S.connection("main") is dev
    with pytest.raises(KeyError):
        S.connection("other")
