"""Models from what exists: a catalog's tables, or the text of Django models."""

from __future__ import annotations

import ast

from pyspark.sql import SparkSession

from tamarack.errors import ModelError
from tamarack.fields import FIELDS, CharField, Field, ForeignKey, IDField, TextField
from tamarack.model import Model

#: Names of Django fields that have another name here (fixed values).
RENAMED = {"BigAutoField": "IDField", "SmallIntegerField": "IntegerField", "PositiveIntegerField": "IntegerField", "PositiveSmallIntegerField": "IntegerField", "PositiveBigIntegerField": "BigIntegerField", "NullBooleanField": "BooleanField", "SlugField": "CharField", "URLField": "TextField", "FileField": "ImageField", "UUIDField": "TextField", "JSONField": "TextField"}
KEEP = {"verbose_name", "primary_key", "unique", "blank", "null", "db_index", "default", "editable", "db_column"}


def from_catalog(spark: SparkSession, database: str | None = None) -> list[Model]:
    """A model per table of the catalog."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return [Model.from_schema(n, spark.table(f"{database}.{n}" if database else n).schema) for n in names]


def from_django(text: str) -> list[Model]:
    """The models that classes of a ``models.py`` declare; the text is parsed, never run."""
    made = []
    for item in ast.parse(text).body:
        if isinstance(item, ast.ClassDef) and any("Model" in ast.unparse(b) for b in item.bases):
            fields: dict[str, Field] = {}
            for line in item.body:
                if isinstance(line, ast.Assign) and len(line.targets) == 1 and isinstance(line.targets[0], ast.Name) and isinstance(line.value, ast.Call):
                    if field := _field(item.name, line.targets[0].id, line.value):
                        fields[line.targets[0].id] = field
            if not any(f.primary_key for f in fields.values()):
                fields = {"id": IDField()} | fields
            made.append(Model(_table(item) or item.name, **fields))
    return made


def _table(item: ast.ClassDef) -> str | None:
    for meta in item.body:
        if isinstance(meta, ast.ClassDef) and meta.name == "Meta":
            for line in meta.body:
                if isinstance(line, ast.Assign) and ast.unparse(line.targets[0]) == "db_table":
                    return ast.literal_eval(line.value)
    return None


def _value(item: ast.expr):
    try:
        return ast.literal_eval(item)
    except ValueError:
        return ast.unparse(item)


def _field(model: str, name: str, call: ast.Call) -> Field | None:
    kind = ast.unparse(call.func).rpartition(".")[2]
    kind = RENAMED.get(kind, kind)
    if kind not in FIELDS:
        return TextField(null=True) if kind.endswith("Field") else None
    given = {k.arg: _value(k.value) for k in call.keywords if k.arg}
    found = FIELDS[kind]
    if issubclass(found, ForeignKey):
        to = given.pop("to", None) or (_value(call.args[0]) if call.args else None)
        if to is None:
            raise ModelError(f"{model}.{name} refers to nothing")
        rule = given.get("on_delete") or (_value(call.args[1]) if len(call.args) > 1 else "CASCADE")
        options = {k: v for k, v in given.items() if k in KEEP or k == "related_name"} | {"on_delete": str(rule).partition("(")[0]}
        if "to_field" in given:
            options["pk_field"] = given["to_field"]
        if isinstance(options.get("default"), str) and options["default"].isidentifier():
            del options["default"]
        target = str(to).rpartition(".")[2]
        return found(model if target == "self" else target, **options)
    options = {k: v for k, v in given.items() if k in KEEP or k in found.extra}
    if callable_default(options.get("default"), found):
        options.pop("default")
    if issubclass(found, CharField) and options.get("max_length", 0) and options["max_length"] > 255:
        options.pop("max_length")
        options.pop("choices", None)
        found = TextField
    return found(**options)


def write_source(models: list[Model], path: str) -> None:
    """A Python file that declares the models again."""
    with open(path, "w", encoding="utf-8") as file:
        file.write('"""Written from the declared models."""\n\nfrom tamarack.fields import *\nfrom tamarack.model import Model\n\n' + "\n".join(m.to_source() for m in models))


def callable_default(value, kind: type[Field]) -> bool:
    """A default such as ``timezone.now`` or ``dict``, which only Django could call."""
    return isinstance(value, str) and str not in kind.python
