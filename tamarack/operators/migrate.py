"""Schema changes: the difference between stored tables and declared models, as a plan that can be kept and applied."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import DataError, GuardError
from tamarack.fields import Field
from tamarack.model import Model, Registry
from tamarack.operators.dml import _checked, _literal, _references, _unique
from tamarack.sources.store import Store

#: The order in which actions are applied.
ACTIONS = ("new_model", "drop_table", "rename_table", "rename_field", "add_field", "remove_field", "alter_field")


@dataclass
class Step:
    action: str
    table: str
    field: str | None = None
    to: str | None = None
    changes: dict = dataclasses.field(default_factory=dict)


def plan(store: Store, registry: Registry, *, renamed_tables: dict[str, str] | None = None, renamed_fields: dict[tuple[str, str], str] | None = None) -> list[Step]:
    """What turns the stored tables into the declared models; renames are given, not guessed."""
    tables, renamed_tables, renamed_fields = store.manifest()["tables"], renamed_tables or {}, renamed_fields or {}
    steps: list[Step] = []
    back = {new: old for old, new in renamed_tables.items() if old in tables}
    for name, model in registry.models.items():
        old = back.get(name, name)
        if old not in tables:
            steps.append(Step("new_model", name))
            continue
        if old != name:
            steps.append(Step("rename_table", old, to=name))
        steps += _fields(name, T.StructType.fromJson(tables[old]["schema"]), model, {f: to for (t, f), to in renamed_fields.items() if t in (old, name)})
    steps += [Step("drop_table", t) for t in tables if t not in registry.models and t not in back.values()]
    return sorted(steps, key=lambda s: ACTIONS.index(s.action))


def _fields(table: str, stored: T.StructType, model: Model, renamed: dict[str, str]) -> list[Step]:
    steps, have = [], {f.name: f for f in stored.fields}
    for old, new in renamed.items():
        if old in have and new in model.fields:
            steps.append(Step("rename_field", table, old, to=new))
            have[new] = have.pop(old)
    for name, declared in model.fields.items():
        if name not in have:
            steps.append(Step("add_field", table, name))
        elif changes := _changes(have[name], declared):
            steps.append(Step("alter_field", table, name, changes=changes))
    return steps + [Step("remove_field", table, n) for n in have if n not in model.fields]


def _changes(old: T.StructField, new: Field) -> dict:
    """Attributes that differ: [before, after]."""
    made, found = new.struct_field(), {}
    if old.dataType != made.dataType:
        found["type"] = [old.dataType.simpleString(), made.dataType.simpleString()]
    if old.nullable != made.nullable:
        found["null"] = [old.nullable, made.nullable]
    for key in ("primary_key", "unique", "max_length", "default", "references", "on_delete", "db_index"):
        a, b = old.metadata.get(key), made.metadata.get(key)
        if a != b:
            found[key] = [a, b]
    return found


def save(steps: list[Step], path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump([asdict(s) for s in steps], file, indent=1)


def read(path: str) -> list[Step]:
    with open(path, encoding="utf-8") as file:
        return [Step(**s) for s in json.load(file)]


def apply(store: Store, registry: Registry, steps: list[Step]) -> int:
    """Apply a plan in one commit; data that do not fit the new declarations raise DataError, and nothing changes.

    Foreign keys that are added, or refer to something else than before, are checked on the stored rows.
    """
    if not registry.settings.change_db:
        raise GuardError("the settings do not allow changes of tables (change_db)")
    manifest = store.manifest()
    tables, frames = dict(manifest["tables"]), {}

    def rows(name: str) -> DataFrame:
        if name not in frames:
            parts = [f"{store.root}/{p}" for p in tables[name]["parts"]]
            schema = T.StructType.fromJson(tables[name]["schema"])
            frames[name] = store.spark.read.schema(schema).parquet(*parts) if parts else store.spark.createDataFrame([], schema)
        return frames[name]

    for s in sorted(steps, key=lambda s: ACTIONS.index(s.action)):
        if s.action == "new_model":
            tables[s.table] = {"parts": [], "schema": json.loads(registry.model(s.table).schema().json())}
        elif s.action == "drop_table":
            tables.pop(s.table)
        elif s.action == "rename_table":
            tables[s.to] = tables.pop(s.table)
        elif s.action == "rename_field":
            frames[s.table] = rows(s.table).withColumnRenamed(s.field, s.to)
        elif s.action == "remove_field":
            frames[s.table] = rows(s.table).drop(s.field)
        else:
            declared = registry.model(s.table).field(s.field)
            frames[s.table] = rows(s.table).withColumn(s.field, _added(s.table, declared) if s.action == "add_field" else F.col(s.field).cast(declared.spark_type))
    for name in {s.to or s.table for s in steps if s.action == "rename_table"} | set(frames) | {s.table for s in steps if s.action == "alter_field"}:
        model = registry.model(name)
        if name in frames:
            made = _checked(model, frames[name].select(*model.fields))
            _unique(model, made, None)
            tables[name] = {"parts": [store.write_part(model, made)], "schema": json.loads(model.schema().json())}
    planned = Store(store.spark, registry, store.root)
    planned.manifest = lambda: {"tables": tables}  # what is about to be committed
    for name in {s.to or s.table for s in steps if s.action in ("new_model", "rename_table", "add_field", "alter_field")}:
        asked = {s.field for s in steps if s.table == name and (s.action == "add_field" or "references" in s.changes)}
        if asked:
            _references(registry.model(name), planned.load(registry.model(name)), planned, asked)
    return store.commit(manifest | {"tables": tables})


def _added(table: str, declared: Field):
    if declared.default is not None:
        return _literal(declared, declared.default)
    if getattr(declared, "auto_now", False) or getattr(declared, "auto_now_add", False):
        return F.current_timestamp().cast(declared.spark_type)
    if not declared.null:
        raise DataError(f"{table}.{declared.name} is not null, so it asks for a default for the rows there are")
    return F.lit(None).cast(declared.spark_type)
