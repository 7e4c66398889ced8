"""Inserts, updates and cascading deletes on a store's tables."""

from __future__ import annotations

import graphlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.errors import DataError, FieldError, GuardError
from tamarack.fields import CharField, DateField, DecimalField, Field, ForeignKey
from tamarack.functions.expressions import Condition, Q, Ref, Scope
from tamarack.model import Edge, Model
from tamarack.operators.query import Query
from tamarack.plans.planner import Plan
from tamarack.sources.store import Store


def _guard(store: Store) -> None:
    if not store.registry.settings.change_data:
        raise GuardError("the settings do not allow changes of data (change_data)")


def _now(field: Field) -> Column:
    return (F.current_date() if isinstance(field, DateField) else F.current_timestamp()).cast(field.spark_type)


def _literal(field: Field, value: Any) -> Column:
    return F.lit(field.convert(value)).cast(field.spark_type)


def _align(model: Model, rows: DataFrame, columns: list | None) -> DataFrame:
    """The given columns under the model's names; pairs (source, field) rename."""
    picked: dict[str, Column] = {}
    for c in columns or rows.columns:
        source, name = c if isinstance(c, tuple) else (c, c)
        if name.lower() not in model.fields:
            raise FieldError(f"{model.name} has no field {name}; it has {', '.join(model.fields)}")
        picked[name.lower()] = F.col(f"`{source}`")
    return rows.select(*[c.alias(n) for n, c in picked.items()])


def _filled(model: Model, rows: DataFrame, store: Store, *, inserting: bool) -> DataFrame:
    """All fields of the model: given, by default, by the clock, numbered, or null where that is allowed."""
    given, out = set(rows.columns), []
    for name, field in model.fields.items():
        if name in given:
            value = F.col(name).cast(field.spark_type) if not isinstance(field, CharField) else F.col(name).cast("string")
            if field.default is not None:
                value = F.coalesce(value, _literal(field, field.default))
        elif getattr(field, "auto_now", False) or inserting and getattr(field, "auto_now_add", False):
            value = _now(field)
        elif field.default is not None:
            value = _literal(field, field.default)
        elif field.null or hasattr(field, "auto"):
            value = F.lit(None).cast(field.spark_type)
        else:
            raise DataError(f"{model.name}.{name} is asked for: it has no default and is not null")
        out.append(value.alias(name))
    made = rows.select(*out)
    key = model.pk
    if key and hasattr(model.fields[key], "auto"):
        made = _numbered(model, made, store.load(model))
    return made


def _numbered(model: Model, rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Missing keys follow the largest one, without gaps: counted by partition, then within it."""
    key, kind = model.pk, model.fields[model.pk].spark_type
    if rows.where(F.col(key).isNull()).isEmpty():
        return rows
    top = max(x for x in (0, stored.agg(F.max(key)).first()[0], rows.agg(F.max(key)).first()[0]) if x is not None)
    given, missing = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    placed = missing.withColumn("\x01part", F.spark_partition_id()).withColumn("\x01row", F.monotonically_increasing_id())
    sizes = placed.groupBy("\x01part").agg(F.count("*").alias("\x01n"))
    before = F.coalesce(F.sum("\x01n").over(Window.orderBy("\x01part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("\x01part", before.alias("\x01before"))  # a row per partition
    # a row's number within its partition is in the low bits of its id
    number = F.lit(top + 1) + F.col("\x01before") + F.col("\x01row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(offsets), "\x01part").withColumn(key, number.cast(kind))
    return given.unionByName(numbered.select(*rows.columns))


def _checked(model: Model, rows: DataFrame) -> DataFrame:
    """Raises DataError for nulls, long texts, unknown choices and numbers with too many digits; one pass."""
    faults: dict[str, Column] = {}
    for name, field in model.fields.items():
        column = F.col(name)
        if not field.null:
            faults[f"{name} is null"] = column.isNull()
        if isinstance(field, CharField):
            faults[f"{name} is longer than {field.max_length}"] = F.length(column) > field.max_length
            if field.choices:
                faults[f"{name} is not among its choices"] = ~column.isin([c for c, _ in field.choices])
        if getattr(field, "max_length", None) and not isinstance(field, CharField):
            faults[f"{name} is longer than {field.max_length}"] = F.octet_length(column) > field.max_length
    if faults:
        found = rows.agg(*[F.count_if(c).alias(f"f{k}") for k, c in enumerate(faults.values())]).first()
        wrong = [f"{n} row(s): {what}" for what, n in zip(faults, found, strict=True) if n]
        if wrong:
            raise DataError(f"{model.name}: {'; '.join(wrong)}")
    return rows


def _unique(model: Model, rows: DataFrame, stored: DataFrame | None, only: set[str] | None = None) -> None:
    """Raises DataError where a unique field (of ``only``, if given) holds a value twice, in ``rows`` or in them and ``stored``."""
    for name, field in model.fields.items():
        if not (field.primary_key or field.unique) or only is not None and name not in only:
            continue
        keys = rows.where(F.col(name).isNotNull()).select(name)
        twice = keys.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
        met = keys.join(stored.select(name), name, "left_semi").limit(5).collect() if stored is not None and not twice else []
        if twice or met:
            raise DataError(f"{model.name}.{name}: key exists already: {', '.join(str(r[0]) for r in twice or met)}")


def _references(model: Model, rows: DataFrame, store: Store, only: set[str] | None = None) -> None:
    """Raises DataError where a foreign key (of ``only``, if given) names a row that is not there."""
    for name, field in model.fields.items():
        if isinstance(field, ForeignKey) and field.db_constraint and (only is None or name in only):
            edge = model.edge(name)
            wanted = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("k")).distinct()
            have = rows if edge.target is model else None
            stored = store.load(edge.target).select(F.col(edge.target_key).alias("k"))
            stored = stored.union(have.select(F.col(edge.target_key).alias("k"))) if have is not None else stored
            lost = wanted.join(stored, "k", "left_anti").limit(5).collect()
            if lost:
                raise DataError(f"{model.name}.{name}: {edge.target.name} has no {', '.join(str(r.k) for r in lost)}")


def _replace(store: Store, model: Model, rows: DataFrame, changed: set[str]) -> None:
    """Put ``rows`` in the place of all stored ones, in one commit; what changed is checked on the written part before that."""
    manifest = store.manifest()
    part = store.write_part(model, _checked(model, rows))  # a part that no manifest names is not there
    written = store.spark.read.schema(model.schema()).parquet(f"{store.root}/{part}")
    _unique(model, written, None, changed)
    _references(model, written, store, changed)
    store.commit(manifest | {"tables": manifest["tables"] | {model.name: {"parts": [part], "schema": json.loads(model.schema().json())}}})


def bulk_insert(query: Query, rows: DataFrame, columns: list | None = None) -> int:
    """Add rows; returns how many. Everything is checked before anything is written, in one commit."""
    store: Store = query.source
    _guard(store)
    model = query.model
    made = _filled(model, _align(model, rows, columns), store, inserting=True)
    part = store.write_part(model, _checked(model, made))  # a part that no manifest names is not there
    written = store.spark.read.schema(model.schema()).parquet(f"{store.root}/{part}")
    _unique(model, written, store.load(model))
    _references(model, written, store)
    manifest = store.manifest()
    table = manifest["tables"].get(model.name, {"parts": []})
    store.commit(manifest | {"tables": manifest["tables"] | {model.name: {"parts": [*table["parts"], part], "schema": json.loads(model.schema().json())}}})
    return written.count()


def create(query: Query, **values: Any) -> dict:
    """Add one row; returns it."""
    store: Store = query.source
    _guard(store)
    model = query.model
    row = {}
    for name, value in values.items():
        field = model.field(name.lower())
        row[name.lower()] = field.convert(value)
        if isinstance(field, DecimalField) and value is not None and row[name.lower()].adjusted() + 1 > field.max_digits - field.decimal_places:
            raise DataError(f"{model.name}.{name} has more than {field.max_digits} digits")
    schema = T.StructType([T.StructField(n, model.fields[n].spark_type) for n in row])
    one = store.spark.createDataFrame([tuple(row.values())], schema) if row else store.spark.range(1).select()
    made = _checked(model, _filled(model, one, store, inserting=True)).collect()
    bulk_insert(query, store.spark.createDataFrame(made, T.StructType([T.StructField(n, f.spark_type) for n, f in model.fields.items()])))
    return made[0].asDict()


def _own(query: Query, what: str) -> Condition:
    """The query's conditions, which must be on the model's own fields."""
    if not query.spec.filters:
        raise DataError(f"{what} asks for a filter")
    found = Q(*query.spec.filters)
    if any(isinstance(n, Ref) and len(n.lookup.path) > 1 for n in found.walk()):
        raise DataError(f"{what} takes conditions on {query.model.name}'s own fields only")
    return found


def update(query: Query, **values: Any) -> int:
    """Set fields of the rows that the filters find; returns how many there are."""
    store: Store = query.source
    _guard(store)
    model, condition = query.model, _own(query, "update")
    rows = store.load(model)
    hit = F.coalesce(condition.compile(Scope(lambda path: (F.col(path[-1]), model.field(path[-1]).spark_type))), F.lit(False))
    changed = {}
    for name, value in values.items():
        field = model.field(name.lower())
        if field.primary_key:
            raise DataError(f"{name} is the primary key")
        changed[name.lower()] = _literal(field, value)
    for name, field in model.fields.items():
        if getattr(field, "auto_now", False) and name not in changed:
            changed[name] = _now(field)
    if not changed:
        raise DataError("update asks for values")
    count = rows.where(hit).count()
    if count:
        new = rows.select(*[F.when(hit, changed[n]).otherwise(F.col(n)).alias(n) if n in changed else F.col(n) for n in model.fields])
        _replace(store, model, new, set(changed))
    return count


def bulk_update(query: Query, rows: DataFrame, columns: list | None = None, keys: list[str] | None = None) -> int:
    """Set the given columns of stored rows that match ``rows`` by key (the primary key by default); returns how many.

    The query's own filters limit which stored rows change.
    """
    store: Store = query.source
    _guard(store)
    model = query.model
    keys = [k.lower() for k in keys or ([model.pk] if model.pk else [])]
    if not keys:
        raise DataError(f"{model.name} has no primary key; name the key columns")
    given = _align(model, rows, columns if columns is None else [*columns, *[k for k in keys if k not in columns]])
    if missing := [k for k in keys if k not in given.columns]:
        raise DataError(f"the rows lack the key {', '.join(missing)}")
    sets = [c for c in given.columns if c not in keys and not model.fields[c].primary_key]
    if not sets:
        raise DataError("bulk_update asks for columns besides the key")
    if twice := given.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise DataError(f"keys occur twice: {', '.join(str(tuple(r)[:-1]) for r in twice)}")
    new = given.select(*[F.col(k).cast(model.fields[k].spark_type).alias(f"\x01{k}") for k in keys], *[F.col(c).cast(model.fields[c].spark_type).alias(f"\x01{c}") for c in sets], F.lit(True).alias("\x01hit"))
    stored = store.load(model)
    on = [stored[k] == new[f"\x01{k}"] for k in keys]
    if query.spec.filters:
        on.append(_own(query, "bulk_update").compile(Scope(lambda path: (stored[path[-1]], model.field(path[-1]).spark_type))))
    joined = stored.join(new, on, "left")
    hit = F.col("\x01hit").isNotNull()
    made = [F.when(hit, F.col(f"\x01{n}")).otherwise(F.col(n)).alias(n) if n in sets else F.when(hit, _now(f)).otherwise(F.col(n)).alias(n) if getattr(f, "auto_now", False) else F.col(n) for n, f in model.fields.items()]
    count = joined.where(hit).count()
    if count:
        _replace(store, model, joined.select(*made), set(sets))
    return count


def delete(query: Query, allow_delete_all: bool = False) -> tuple[int, dict[str, int]]:
    """Delete the rows found, and what their deletion entails; returns the total and counts by model.

    The rows of every model that go are gathered as tables of keys, wave by wave, until a wave
    finds no more; then all models are rewritten in one commit. RESTRICT and PROTECT refuse while
    rows that stay refer to rows that go.
    """
    store: Store = query.source
    _guard(store)
    model = query.model
    if not query.spec.filters and not allow_delete_all:
        raise DataError("delete asks for a filter, or allow_delete_all=True")
    if model.pk is None:
        raise DataError(f"{model.name} has no primary key")
    registry, gone = store.registry, {}
    spec = type(query.spec)(model, [(model.pk, Ref(model.pk))], query.spec.filters)
    wave = {model.name: _kept(Plan(spec, store.load).compile(paged=False).distinct(), model.pk)}
    while wave:
        fresh = {}
        for name, keys in wave.items():
            pk = registry.model(name).pk
            new = keys.join(gone[name], pk, "left_anti") if name in gone else keys
            new = _kept(new, pk)
            if not new.isEmpty():
                gone[name] = _kept(gone[name].union(new), pk) if name in gone else new
                fresh[name] = new
        wave = {}
        for name, keys in fresh.items():
            for edge in registry.model(name).related.values():
                if edge.fk.on_delete == "CASCADE" and edge.target.pk is not None:
                    found = _referring(store, edge, keys).select(edge.target.pk).distinct()
                    wave[edge.target.name] = wave[edge.target.name].union(found).distinct() if edge.target.name in wave else found
    changes: dict[str, DataFrame] = {}
    loose: dict[str, int] = {}
    for name, keys in gone.items():
        m = registry.model(name)
        changes[name] = changes.get(name, store.load(m)).join(keys, m.pk, "left_anti").select(*m.fields)
    for name, keys in gone.items():
        for edge in registry.model(name).related.values():
            rule, holder = edge.fk.on_delete, edge.target
            if rule == "DO_NOTHING" or rule == "CASCADE" and holder.pk is not None:
                continue
            rows = changes.get(holder.name, store.load(holder))
            if rule == "CASCADE":  # rows without a key, to which nothing can refer
                targets = _target_keys(store, edge, keys)
                if n := rows.join(targets, edge.fk.name, "left_semi").count():
                    loose[holder.name] = loose.get(holder.name, 0) + n
                    changes[holder.name] = rows.join(targets, edge.fk.name, "left_anti").select(*holder.fields)
                continue
            hit = rows.join(_target_keys(store, edge, keys), edge.fk.name, "left_semi")
            if rule in ("RESTRICT", "PROTECT"):
                if stays := hit.limit(5).collect():
                    raise DataError(f"{holder.name}.{edge.fk.name} refers to rows of {name}: {', '.join(str(r[holder.pk or edge.fk.name]) for r in stays)}")
            elif not hit.isEmpty():
                value = {"SET_NULL": None, "SET_DEFAULT": edge.fk.default, "SET": edge.fk.set_value}[rule]
                marks = _target_keys(store, edge, keys).withColumn("\x01hit", F.lit(True))
                marked = rows.join(marks, edge.fk.name, "left")
                changes[holder.name] = marked.select(*[F.when(F.col("\x01hit").isNotNull(), F.lit(value).cast(f.spark_type)).otherwise(F.col(n)).alias(n) if n == edge.fk.name else F.col(n) for n, f in holder.fields.items()])
    counts = {name: keys.count() for name, keys in gone.items()} | loose
    if counts:
        store.change({registry.model(n): df for n, df in changes.items()})
    return sum(counts.values()), counts


def _kept(keys: DataFrame, pk: str) -> DataFrame:
    """Keys of one wave, on disk: later waves must not find their lineage again."""
    return keys.select(pk).checkpoint() if keys.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else keys.select(pk).persist()


def _target_keys(store: Store, edge: Edge, keys: DataFrame) -> DataFrame:
    """The values of the referring column that mean rows of ``keys``."""
    if edge.key == edge.model.pk:
        return keys.select(F.col(edge.key).alias(edge.fk.name))
    return store.load(edge.model).join(keys, edge.model.pk, "left_semi").select(F.col(edge.key).alias(edge.fk.name)).distinct()


def _referring(store: Store, edge: Edge, keys: DataFrame) -> DataFrame:
    return store.load(edge.target).join(_target_keys(store, edge, keys), edge.fk.name, "left_semi")


def deletion_order(models: list[Model]) -> list[str]:
    """Models, those that refer to others first; a cycle of references raises DataError."""
    order: graphlib.TopologicalSorter = graphlib.TopologicalSorter()
    for m in models:
        order.add(m.name)
        for f in m.fields.values():
            if isinstance(f, ForeignKey) and f.target_name != m.name:
                order.add(f.target_name, m.name)
    try:
        return list(order.static_order())
    except graphlib.CycleError as error:
        raise DataError(f"references go in a circle: {' -> '.join(error.args[1])}") from error
